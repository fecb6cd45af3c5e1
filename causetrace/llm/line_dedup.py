"""Fuzzy line deduplication by MinHash (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causetrace.llm.buckets import band_keys, verified_components
from causetrace.llm.common import stage, unstage

#: Characters of a shingle; bands and rows in a band. Two lines of similarity 0.8 share a band with probability 0.987, of 0.9 with 0.9996.
SHINGLE, BANDS, ROWS = 12, 6, 3
SIMILARITY = 0.8
#: MinHash values (of 18) that a candidate pair must agree in; one of similarity 0.8 does with probability 0.984.
AGREE = 11
#: Bits of a shingle's hash that sketch it: a line has at most 2^16 such marks.
MARK = 16
#: One mask for each value, evenly spread, as shingles are hashed once: multiples of 2^64 over the golden ratio, read as signed numbers.
MASKS = [(k * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for k in range(1, BANDS * ROWS + 1)]


def _written(line: str):
    """A lower-cased line in UTF-32: every character takes four bytes, so a shingle is found by its place at once."""
    return F.encode(F.lower(line), "UTF-32")


def _places(w: str) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.octet_length(w) - (4 * SHINGLE - 1), F.lit(1)), F.lit(4))


def _shingle(w: str, at: Column) -> Column:
    """The hash of the run of ``SHINGLE`` characters at a place; a shorter line is one shingle."""
    return F.xxhash64(F.substring(w, at, F.lit(4 * SHINGLE)))


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that isn't blank: ``doc_id, th`` (which text), ``n`` (place), ``line``."""
    split = docs.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))
    return split.select("doc_id", "th", F.posexplode("lines").alias("n", "line")).where(F.trim("line") != "")


def _identity() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")]


def _signatures(texts: DataFrame) -> DataFrame:
    """``h1, h2`` and the MinHash values ``m`` of each distinct line: of the hashes of its shingles the least under each of ``MASKS``, so the one nearest to a place of its own."""
    each = texts.select("h1", "h2", _written("line").alias("w")).select("h1", "h2", "w", F.explode(_places("w")).alias("at"))
    each = each.select("h1", "h2", _shingle("w", F.col("at")).alias("s"))
    minima = [F.min(F.col("s").bitwiseXOR(F.lit(k))).alias(f"m{i}") for i, k in enumerate(MASKS)]
    values = F.array(*[F.shiftright(f"m{i}", 32).cast("int") for i in range(BANDS * ROWS)])
    return each.groupBy("h1", "h2").agg(*minima).select("h1", "h2", values.alias("m"))


def _set(w: str) -> Column:
    """The hashes of the different shingles of a written line."""
    return F.array_distinct(F.transform(_places(w), lambda at: _shingle(w, at)))


def _once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with more columns, each computed once a row: a later filter on them is not merged into their making."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets of all shingles have an exact Jaccard similarity of at least ``similarity``.

    Both lines of a pair meet in one row, dealt by pair into many small parts; the sets are made and compared there, without another shuffle.
    """
    of = lambda c: texts.select(F.col("id").alias(c), F.col("line").alias(f"l{c}")).hint("merge")
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "la", "lb")
    both = both.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    both = _once(both, wa=_written("la"), wb=_written("lb")).select("a", "b", "wa", "wb")
    both = _once(both, sa=_set("wa"), sb=_set("wb")).select("a", "b", "sa", "sb")
    counts = _once(both, common=F.size(F.array_intersect("sa", "sb")), both=F.size("sa") + F.size("sb")).select("a", "b", "common", "both")
    return stage(counts.where(F.col("common") >= similarity * (F.col("both") - F.col("common"))).select("a", "b"), "links")


def _sketched(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, size, marks`` of the lines ``ids``: how many different shingles they have, and the different values of ``MARK`` bits of their hashes."""
    each = _once(texts.join(ids.hint("merge"), "id"), w=_written("line")).select("id", "w")
    each = _once(each, s=_set("w")).select("id", "s")
    return each.select("id", F.size("s").alias("size"), F.array_distinct(F.transform("s", lambda x: x.bitwiseAND(F.lit((1 << MARK) - 1)).cast("int"))).alias("marks"))


def line_components(lines: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(distinct lines ``h1, h2, copies, line``, ``node, component`` of the linked ones).

    Copies of a line collapse, by partial aggregates, before anything else is done with them. Lines that share a band meet
    in a bucket, and are candidates if they agree in at least ``AGREE`` MinHash values (see ``verified_components``).
    """
    distinct = stage(lines.groupBy("line").agg(F.count(F.lit(1)).alias("copies")).select(*_identity(), "copies", "line"), "distinct")
    signed = stage(_signatures(distinct), "signatures")
    banded = signed.select("h1", "h2", F.explode(F.array(*band_keys(F.col("m"), BANDS, ROWS))).alias("key"))
    shared = stage(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"), "shared")
    met = stage(banded.join(shared.hint("merge"), "key"), "met")
    unstage(shared)
    member = F.struct(F.struct("h1", "h2").alias("id"), "m").alias("x")
    members = stage(met.join(signed.hint("merge"), ["h1", "h2"]).select("key", member), "members")
    for x in (met, signed):
        unstage(x)
    # the lines that meet another one anywhere
    wanted = members.select("x.id.h1", "x.id.h2").distinct()
    texts = stage(distinct.join(wanted.hint("merge"), ["h1", "h2"]).select(F.struct("h1", "h2").alias("id"), "line"), "texts")
    comp = verified_components(members, BANDS * ROWS, AGREE, lambda pairs: _verified(pairs, texts, similarity), sketch=lambda ids: _sketched(ids, texts), similarity=similarity)
    for x in (members, texts):
        unstage(x)
    return distinct, comp


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, counts: bool = True) -> DataFrame:
    """Every row of ``docs`` with one line kept for each component of near-equal lines.

    ``text`` loses its removed lines, all other columns stay (``n_chars`` follows the text when present); with ``counts``,
    ``n_lines`` and ``n_removed`` are added, in place of columns of these names. The kept line of a component is its
    first: smallest doc_id, then a hash of the text, then place. Blank lines are never touched. A null text stays null with 0 lines; an
    empty table gives an empty one; rows that repeat a doc_id and text share one decision.
    """
    base = docs.drop("n_lines", "n_removed") if counts else docs
    lines = _lines(base)
    distinct, comp = line_components(lines, similarity)
    node = F.struct("h1", "h2")
    named = distinct.select("h1", "h2", "copies", node.alias("node")).join(comp.hint("merge"), "node", "left")
    repeated = stage(named.where("copies > 1 or component is not null").select("h1", "h2", F.coalesce("component", "node").alias("comp")), "repeated")
    unstage(distinct)
    hits = stage(lines.select("doc_id", "th", "n", *_identity()).join(repeated.hint("merge"), ["h1", "h2"]).select("doc_id", "th", "n", "comp"), "hits")
    place = F.struct("doc_id", "th", "n")
    firsts = stage(hits.groupBy("comp").agg(F.min(place).alias("first")), "firsts")
    gone = hits.join(firsts.hint("merge"), "comp").where(place != F.col("first"))
    gone = gone.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(F.collect_set("n").alias("__gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("__row")
    marked = base.select(row).join(gone.hint("merge"), F.col("__row.doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("__row.text") == F.col("__t")), "left")
    # written out once for each row: inside a lambda the text would be split again for each line
    parts = F.struct("__row", "__gone", F.split("__row.text", "\n", -1).alias("__lines")).alias("__x")
    marked = marked.select(F.explode(F.array(parts))).select("col.*")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    text = F.when(F.col("__gone").isNull(), F.col("__row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.col("__lines")[i]), "\n"))
    n_chars = F.length(text).cast(base.schema["n_chars"].dataType) if "n_chars" in base.columns else None
    out = [text.alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c) for c in base.columns]
    if counts:
        out.append(F.coalesce(F.size(F.filter("__lines", lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias("n_lines"))
        out.append(F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))
    return marked.select(*out)


def report(docs: DataFrame) -> DataFrame:
    """Per document how many lines it had, how many went, and the digest of the text that is left.

    One row for each row of ``docs``, whatever repeats; null and empty texts have no lines and the digest of the empty text. An empty table gives an empty one.
    """
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
