"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causetrace.llm import decontam, exact_dedup, fim, language, line_dedup, pii, prefix_trie, sentencepieces, simhash, suffix_dedup, token_counts, toxicity, warc
from causetrace.llm.common import table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.fresh_index(spark, "op2")
    told = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), index)
    index.drop()  # what is told is staged; a standing index would stay for the next batch
    return told


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), piece_model())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(table(spark, sf_dir, "documents"), piece_model())


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_exact_dedup, op3_suffix_dedup, op4_line_dedup, op5_pii_pseudonyms, op6_simhash_near_dedup, op7_token_counts, op8_language_id, op9_decontamination, op10_sentencepiece, op11_warc, op12_prefix_trie, op13_fill_in_middle)
}

#: Unsigned CRC-32 of a decimal number: the polynomial of zlib, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, k: xor(r >> 1, (r & 1) * 3988292384 + k))), 4294967295::BIGINT)"
_BASE32 = "array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr({0}, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '')"

ORACLE_SQL: dict[str, str] = {
    "op11_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages)
        SELECT page_id, strlen(html) AS payload_bytes, {_BASE32.format("sha1(html)")} AS payload_digest, CASE WHEN page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to, CASE WHEN page_id IS NOT DISTINCT FROM keep THEN true END AS intact FROM p""",
    "op12_prefix_trie": f"""
        WITH t AS (SELECT conv_id, list(md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || lpad(strlen(coalesce(text, ''))::VARCHAR, 10, '0') ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, s, ({_CRC.format("conv_id")} % 9)::INT AS h FROM t),
        r AS (SELECT h.conv_id, list_concat(coalesce(b.s, [])[1:h], h.s[h + 1:]) AS s FROM h LEFT JOIN t b ON b.conv_id = base),
        m AS (SELECT conv_id, len(s) AS n, d AS depth, md5(array_to_string(s[1:d], '')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(s[1:d - 1], '')) END AS up, CASE WHEN d > 0 THEN right(s[d], 10)::BIGINT ELSE 0 END AS bytes FROM r, LATERAL (SELECT unnest(generate_series(0, len(s))) AS d)),
        nodes AS (SELECT depth, node, up, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY 1, 2, 3),
        kids AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
        full_nodes AS (SELECT x.*, coalesce(k.n, 0) AS n_children FROM nodes x LEFT JOIN kids k USING (node, depth)),
        pairs AS (SELECT DISTINCT a.node AS top, a.depth AS top_depth, b.node, b.depth FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
        sums AS (SELECT top AS node, top_depth AS depth, CAST(sum((n_children = 0)::INT) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens FROM pairs JOIN full_nodes USING (node, depth) GROUP BY 1, 2)
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256 FROM full_nodes f JOIN sums USING (node, depth) LEFT JOIN full_nodes p ON p.node = f.up AND p.depth = f.depth - 1""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS x FROM documents),
        h AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4, regexp_extract_all(text, '[^
]*
|[^
]+') AS u FROM d),
        c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
        k AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
        SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM k""",
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
        FROM n WINDOW w AS (PARTITION BY h)""",
    "op9_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
              FROM b, LATERAL (SELECT unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM g),
        p AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
              FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i)),
        m AS (SELECT doc_id, i, n, item_id FROM p JOIN g USING (n, s)),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM m, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS k) GROUP BY doc_id),
        it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
