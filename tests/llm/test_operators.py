"""Operators against brute force on a small fixture with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from causetrace.llm import anchors, buckets, components, decontam, exact_dedup, language, line_dedup, pii, sentencepieces, simhash, suffix_dedup, token_counts, toxicity
from causetrace.llm.queries import piece_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "th", "re", "on", "is", "zu", "ei", "qu", "ó", "ñ"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(k, "\n".join(words(rng, rng.randint(3, 25)) for _ in range(rng.randint(1, 6)))) for k in range(120)]
    shared = words(rng, 70)
    for k in range(120, 150):
        base = out[k - 120][1]
        out.append((k, [base, base.replace("\n", " \t"), base + "\n" + shared, shared + " " + base, re.sub("an", "xx", base, count=1)][k % 5]))
    out += [(200, None), (201, ""), (202, "   \n\t "), (203, words(rng, 30_000)), (204, "x" * 3000), (3, out[3][1]), (5, "another text with a known id"), (205, "\n\n"), (206, "字漢字漢字漢字漢字漢 é 🙂" * 40), (None, "a row without an id"), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EMPTY)


def union_find(n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(500, k) for k in range(501, 700)] + [(7, 7)]
    parent, find = union_find(800)
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark, docs, none, rows, tmp_path):
    index = exact_dedup.fresh_index(spark, "t1")
    got = exact_dedup.exact_dedup(docs, index).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        want[i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    # what comes later meets the index, and running a batch again appends nothing
    n = index.read().count()
    later = spark.createDataFrame([(-1, rows[0][1]), (-2, "a text that is new")], "doc_id long, text string")
    told = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(later, exact_dedup.DigestIndex(spark, index.location, index.buckets)).collect()}
    assert told == {-1: 0, -2: -2} and index.read().count() == n + 1
    exact_dedup.exact_dedup(later, index).collect()
    assert index.read().count() == n + 1
    assert exact_dedup.exact_dedup(none, exact_dedup.fresh_index(spark, "t2")).count() == 0


def test_indexes_are_apart(spark, tmp_path):
    """Two indexes whose folders have one name; one of them compacted, then dropped."""
    a, b = (exact_dedup.DigestIndex(spark, str(tmp_path / d / "idx"), 2) for d in "ab")
    df = spark.createDataFrame([(1, "x", 0), (2, "x ", 0), (3, None, 0), (3, None, 0)], "doc_id long, text string, digest int")
    for k in range(3):
        exact_dedup.exact_dedup(df.where(f"doc_id <> {k}"), a).collect()
    assert a.read().count() == 3 and b.read().count() == 0
    before = sorted(map(str, a.read().collect()))
    a.compact()
    assert sorted(map(str, a.read().collect())) == before and len(list((tmp_path / "a" / "idx").glob("*.parquet"))) <= 2
    assert {r.keep_id for r in exact_dedup.exact_dedup(df.where("doc_id = 3"), a).collect()} == {3}
    a.drop()
    assert not (tmp_path / "a" / "idx").exists() and b.read().count() == 0


def test_rows_repeated_often(spark):
    """Rows that repeat one id and text: their ranges are listed once, and all is as with different ids."""
    rng = random.Random(8)
    part = words(rng, 120)
    rows = [(None, part)] * 40 + [(1, words(rng, 60) + part[:300]), (2, words(rng, 90))]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_removed, r.n_spans) for r in got.collect()) == {(None, len(part.encode()), 1): 40, (1, len(part[:300].encode()), 1): 1, (2, 0, 0): 1}
    spans = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert spans.groupBy("doc_id").count().where("doc_id is null").first()["count"] <= 40 * 60


def test_repeated_strings(docs, none, rows):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.without_repeats(docs).collect())
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = Counter()
    for (i, _), b in zip(rows, raw, strict=True):
        spans = suffix_dedup.merge_ranges([(s, s + 200) for s in range(len(b) - 199) if seen[b[s : s + 200]] > 1])
        gone = np.zeros(len(b), dtype=bool)
        for s, e in spans:
            gone[s:e] = True
        want[i, len(b), int(gone.sum()), len(spans), np.frombuffer(b, np.uint8)[~gone].tobytes()] += 1
    assert got == want
    assert suffix_dedup.without_repeats(none).count() == 0


def test_repeats_across_buffers(spark, monkeypatch):
    """Texts longer than a buffer are cut into overlapping chunks; what is found stays the same."""
    rng = random.Random(3)
    part = words(rng, 400)
    small = [(k, words(rng, 300) + part[k * 17 :] + words(rng, 200)) for k in range(6)]
    df = spark.createDataFrame(small, "doc_id long, text string")
    want = sorted(map(tuple, suffix_dedup.without_repeats(df).collect()))
    texts = [t.encode() for _, t in small]
    monkeypatch.setattr(anchors, "BUFFER", 2048)
    f = suffix_dedup._first_pieces(200, 64)
    cut = f([t for _, t in small])
    assert all(sum(n) == max(0, len(t) - 199) for n, t in zip(cut["n"], texts, strict=True))  # every window once
    assert any(r[2] for r in want)


def line_brute(rows):
    """The places (doc_id, hash-free text, line number) that stay, over every overlapping run of 12 characters, all pairs compared."""
    first = defaultdict(set)
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                first[line].add(((i is not None, i or 0), t, n))
    lines = list(first)
    sets = [{x[k : k + 12] for k in range(max(1, len(x) - 11))} for x in map(str.lower, lines)]
    parent, find = union_find(len(lines))
    for a in range(len(lines)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = defaultdict(set)
    for k, x in enumerate(lines):
        groups[find(k)] |= first[x]
    return groups.values()


def test_line_dedup(docs, none, rows):
    got = line_dedup.dedup_lines(docs).collect()
    by = Counter(r.doc_id for r in got)
    assert by == Counter(i for i, _ in rows)
    unique = [(i, t) for i, t in dict.fromkeys(rows)]
    groups = line_brute(unique)
    kept = {(i, t): [x for x in t.split("\n") if x.strip(" ")] if t else [] for i, t in unique}
    for g in groups:  # all but the first place of a group go; texts that share a doc_id may be in either order
        for (known, i), t, n in sorted(g, key=lambda x: x[0])[1:]:
            kept[i if known else None, t].remove(t.split("\n")[n])
    want = sorted((str(i), x) for (i, _), xs in kept.items() for x in xs)
    left = sorted((str(r.doc_id), x) for r in {(r.doc_id, r.text): r for r in got}.values() for x in (r.text or "").split("\n") if x.strip(" "))
    removed = sum(len(g) - 1 for g in groups)
    assert sum(((Counter(left) - Counter(want)) + (Counter(want) - Counter(left))).values()) <= 0.03 * removed
    text = {r.doc_id: r.text for r in got}
    assert text[200] is None and text[201] == "" and text[202] == "   \n\t " and text[205] == "\n\n"
    assert next(r for r in got if r.doc_id == 0).text == rows[0][1]
    assert line_dedup.dedup_lines(none).count() == 0
    same = line_dedup.dedup_lines(docs.withColumns({"n_lines": F.lit(1), "gone": F.lit("x")}), counts=False)
    assert same.columns == [*docs.columns, "n_lines", "gone"] and same.where("gone = 'x' and n_lines = 1").count() == len(rows)


def test_pseudonyms(spark, docs, none):
    texts = [
        "card 4111 1111 1111 1111 or 4111111111111112, call +1 (415) 555-0132",
        "mail Jane.Doe7@mail.example.com or 10.20.30.40 not 999.1.1.1",
        "born 1984-02-29 not 1985-02-29, met 31.12.1999, ssn 123-45-6789, iban GB82 WEST 1234 5698 7654 32",
        "again 4111 1111 1111 1111 and Jane.Doe7@mail.example.com; plain 12345 stays",
    ]
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "doc_id long, text string, pii_kinds int")
    got = {r.doc_id: r for r in pii.pseudonymise(df, b"secret").collect()}
    assert got[0].pii_kinds == ["card", "phone"] and got[1].pii_kinds == ["email", "ip"]
    assert sorted(got[2].pii_kinds) == ["dmydate", "iban", "isodate", "ssn"]
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[0].text)[0]
    assert card in got[3].text and card != "4111 1111 1111 1111"
    digits = card.replace(" ", "")
    assert pii.luhn(digits[:-1]) == int(digits[-1])
    assert "4111111111111112" in got[0].text and "999.1.1.1" in got[1].text and "1985-02-29" in got[2].text and "12345 stays" in got[3].text
    mail = re.search(r"\S+@\S+", got[1].text)[0]
    assert mail in got[3].text and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}\d@mail\.example\.com", mail)
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.permute(x, size, b"k", "t") for x in range(size)) == list(range(size))
    assert pii.pseudonymise(none).count() == 0
    clean = pii.pseudonymise(docs).where("size(pii_kinds) > 0").count()
    assert clean == 0


def test_simhash(docs, none, rows):
    got = simhash.report(docs).collect()
    prints = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    parent, find = union_find(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)] += [i] if i is not None else []
    want = Counter((i, f"{prints[k]:016x}", min(ids[find(k)], default=None)) for k, (i, _) in enumerate(rows))
    assert Counter(map(tuple, got)) == want
    assert simhash.report(none).count() == 0


def test_links_in_large_buckets(spark):
    """Thousands of near fingerprints, linked through one-bit neighbourhoods, against all pairs."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    flips = rng.integers(0, 64, size=(400, 4))
    fps = sorted({centre ^ sum(1 << int(b) for b in set(f[: 1 + k % 4])) for k, f in enumerate(flips)} | {int(x) for x in rng.integers(1 << 62, size=100)})
    signed = [simhash._signed(x) for x in fps]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    got = {r.node: r.component for r in components.connected_components(simhash.link_fingerprints(nodes)).collect()}
    parent, find = union_find(len(fps))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert all(got.get(k, k) == find(k) for k in range(len(fps)))


def test_near_duplicates_go(docs, none, rows):
    left = simhash.drop_near_duplicates(docs.withColumn("fp", F.lit(1)))
    assert left.columns == [*docs.columns, "fp"]
    kept = Counter(r.doc_id for r in left.collect())
    assert kept[0] == 1 and kept[None] == 2
    assert sum(kept[i] for i in (200, 201, 202, 205)) == 1  # texts without words are equal
    assert all(kept[i] for i in range(120))
    assert not any(kept[k] for k in range(120, 150) if k % 5 == 0)
    assert simhash.drop_near_duplicates(none).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_tokenizers_equal_the_library(docs, none, rows, library):
    counts = Counter(map(tuple, token_counts.token_counts(docs, piece_model(), 100).collect()))
    coded = Counter(map(tuple, sentencepieces.digests(docs, piece_model()).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want_counts, want_coded = Counter(), Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want_counts[i, len((t or "").encode()), len(ids) - 2, len(ids) - 2 > 100] += 1
        want_coded[i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode(ids).encode())] += 1
    assert counts == want_counts and coded == want_coded
    assert token_counts.token_counts(none, piece_model()).count() == 0


def test_tokenizers_on_odd_strings(library, monkeypatch):
    rng = random.Random(11)
    letters = [*"abcdethTHe  ▁\n\t.,0123é漢字🙂Ａ́", "the", "▁", "   ", "<s>", "</s>", "<0x0A>", "ing", "ation"]
    t, table = token_counts.CountTransducer(token_counts.piece_scores(piece_model())), sentencepieces.ChunkTable(piece_model())
    assert table.independent
    for size in (1 << 16, 7):
        monkeypatch.setattr(token_counts, "BLOCK_CHARS", size)
        for _ in range(1500):
            x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
            ids = library.encode(x, add_bos=True, add_eos=True)
            assert t.count(x) == len(ids) - 2, x
            assert table.encode(x) == (np.array(ids, dtype="<u4").tobytes(), library.decode(ids).encode()), x


def test_block_maps_compose(library):
    t = token_counts.CountTransducer(token_counts.piece_scores(piece_model()))
    text = "▁" + "the quick brown foxes jumped over unbelievably lazy dogs ".replace(" ", "▁") * 3
    for cut in (3, 11, 40):
        maps = [t.block_map(text[i : i + cut]) for i in range(0, len(text), cut)]
        left = maps[0]
        for m in maps[1:]:
            left = t.compose(left, m)
        pairs, n = t.scan(maps), t.read(token_counts.START, text)[1]
        assert t.apply(left, token_counts.START) == t.apply(pairs, token_counts.START) and t.apply(left, token_counts.START)[1] == n
        assert n == len(library.encode(text.replace("▁", " ")[1:]))


def test_transducer_is_bounded(library, monkeypatch):
    """A long text without a word start, over many blocks, with compilation starting afresh again and again."""
    rng = random.Random(12)
    t = token_counts.CountTransducer(token_counts.piece_scores(piece_model()))
    for name, n in (("MAX_STATES", 60), ("PIECE_CHARS", 16), ("BLOCK_CHARS", 64)):
        monkeypatch.setattr(token_counts, name, n)
    x = "".join(rng.choice("abcdefghinorst") for _ in range(3000))
    assert t.count(x) == len(library.encode(x)) and len(t.states) < 200


BENCH = [(1, None), (2, "Alpha beta, gamma; delta"), (3, "one two three four five six seven eight nine ten eleven twelve"), (30, "one two three four five six seven eight nine ten"), (4, ""), (5, "ALPHA-beta gamma delta")]


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    texts = {
        1: "zero one Two three four five six seven eight nine TEN eleven end",
        2: "so alpha beta gamma delta it is, alpha beta",
        3: "one two three four five six seven eight nine",
        4: "é one two three four five six seven eight nine ten! eleven twelve one two three four five six seven eight nine ten",
        5: None,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    def want(t):
        w = decontam.words_of(t)
        hit, items = set(), set()
        for i, x in BENCH:
            v = decontam.words_of(x)
            n = min(10, len(v))
            for s in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == s:
                        hit |= set(range(k, k + n))
                        items.add(str(i))
        return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)

    got = {r.doc_id: tuple(r)[1:] for r in decontam.report(df, bench).collect()}
    assert got == {i: want(t) for i, t in texts.items()}
    assert got[2][1] == 4 and got[3][1] == 0 and got[1][1] == 11
    one, many = decontam.decontaminate(df, bench), decontam.decontaminate(df, bench, block_bytes=20)  # several broadcasts
    key = lambda d: sorted(map(str, d.select("doc_id", "n_words", "n_hit", "starts", "ends", "items").collect()))
    assert key(one) == key(many)
    cut = {r.doc_id: r.text for r in decontam.remove_spans(df.withColumn("n_hit", F.lit(3)), bench, drop_share=0.99).collect()}
    assert cut[1] == "zero  end" and cut[3] == texts[3] and cut[5] is None and 4 in cut
    assert decontam.report(none, bench).count() == 0 and decontam.report(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_odd_items(spark):
    """Windows of an item without an id hit but aren't listed; windows of equal hash are told apart by their words."""
    bench = spark.createDataFrame([(None, "alpha beta gamma delta"), (4, "one two three four")], "item_id long, text string")
    df = spark.createDataFrame([(1, "so alpha beta gamma delta"), (1, "so alpha beta gamma delta"), (2, "one two three four five")], "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in decontam.report(df, bench).collect())
    assert got == [(1, 5, 4, 0), (1, 5, 4, 0), (2, 5, 4, 1)]
    index = decontam.ngram_index([(1, "a b c"), (2, "d e f")])
    index.hashes[3][:] = 7
    assert index.items(3, b"a b c") == [] and len(index.places[3]) == 2


def test_language(spark, none, docs):
    rng = random.Random(2)
    parts = {"en": ["the", "th", "ing", "and", "of"], "de": ["ich", "sch", "und", "der", "ung"], "fr": ["eau", "les", "que", "é", "ou"], "es": ["ción", "os", "la", "ñ", "ado"]}
    rows = [(k, " ".join("".join(rng.choice(parts[c]) for _ in range(rng.randint(1, 3))) for _ in range(40)), c) for k, c in enumerate(list(parts) * 60)]
    df = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "123 !?", "en"), (1002, "", None), (1003, rows[0][1], None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.report(df).collect()}
    test = [k for k, _, _ in rows if got[k].held_out]
    assert len(test) > 50 and np.mean([got[k].lang_pred == rows[k][2] for k in test]) > 0.97
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.report(none).count() == 0
    odd = language.predict(docs.withColumnsRenamed({"source": "lang_pred.x"}), language.fit(df), keep=("doc_id", "lang_pred.x")).collect()
    assert Counter(r.doc_id for r in odd) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert {r.lang_pred for r in odd if r.doc_id in (200, 201, 202, 205)} == {"und"} and len({(r.lang_pred, r.score) for r in odd if r.doc_id == 3}) == 1
    few = language.fit(df, per_language=3, most_chars=1000)
    assert sorted(c for f in few.families.values() for c in f) == ["de", "en", "es", "fr"]


def test_toxicity(spark, none, docs):
    rng = random.Random(4)
    bad = ["frobnark", "gluzzle", "snorvex", "quimble"]
    rows, labels = [], []
    for k in range(600):
        w = words(rng, 60).split()
        if k % 4 == 0:
            for _ in range(6):
                w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(k % 4 == 0)))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (902, 1, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.report(df, lab).collect()}
    test = [k for k in range(600) if got[k].held_out]
    assert np.mean([got[k].predicted == int(k % 4 == 0) for k in test]) > 0.95
    assert got[900].predicted == 0 and got[901].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())
    model = toxicity.fit(df, lab)
    left = toxicity.drop_toxic(df.withColumn("score", F.lit("mine")), model)
    assert left.columns == ["doc_id", "text", "score"] and {r.doc_id for r in left.collect()} == {k for k, r in got.items() if r.score < 0.7}
    odd = toxicity.scores(docs, model).collect()
    assert Counter(r.doc_id for r in odd) == Counter(r.doc_id for r in docs.select("doc_id").collect()) and len({r.score for r in odd if r.doc_id == 3}) == 1
    assert [len(x) for x in map(toxicity.windows, ("", " \n", None))] == [0, 0, 0] and len(toxicity.windows("a b " * 20)) == 3
    gains = model.measure()
    assert max(gains(" ".join(rows[4][1].split()))) > max([0, *gains(rows[5][1])])
    assert toxicity.report(none, lab).count() == 0 and toxicity.report(df, lab.limit(0)).count() == len(got)


def test_pipeline(spark, tmp_path, rows, library):
    """All stages against brute force: lines and near copies by all pairs, benchmark words, the tokenizer's own library."""
    import corpus_pipeline

    rng = random.Random(9)
    item = words(rng, 12)
    rows = [*rows, (300, "before " + item + " after " + words(rng, 40)), (301, item)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    gone = {x for g in line_brute(set(rows)) for x in sorted(g, key=lambda x: x[0])[1:]}
    cut = [(i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if ((i is not None, i or 0), t, n) not in gone)) for i, t in rows]
    known = sorted({(i, t or "") for i, t in cut if i is not None})
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in known]
    parent, find = union_find(len(known))
    for x in range(len(known)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if (not sets[x] and not sets[y]) or both and both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                u, v = find(x), find(y)
                parent[max(u, v)] = min(u, v)
    first = {known[find(k)] for k in range(len(known))}
    want = Counter()
    for i, t in cut:
        hit = (t or "").count(item) * 12
        if (i is None or (i, t or "") in first) and 2 * hit <= len(decontam.words_of(t)):
            ids = library.encode((t or "").replace(item, ""), add_bos=True, add_eos=True)
            want[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()] += 1
    assert (300,) in {k[:1] for k in got} and (301,) not in {k[:1] for k in got}
    assert sum(((got - want) + (want - got)).values()) <= 0.03 * sum(want.values())
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, step, str(tmp_path)).columns == step.columns


def test_spans_of_several_blocks(spark):
    """What is cut and dropped doesn't depend on how the benchmark is split."""
    rng = random.Random(24)
    items = [(k, words(rng, 30)) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, items[0][1] + " " + items[1][1] + " " + words(rng, 40)), (2, " ".join(x for _, x in items[2:5]) + " " + words(rng, 40)), (3, words(rng, 50)), (4, None)]
    texts.append((5, items[0][1] + " " + words(rng, 200) + " " + " ".join(items[0][1].split()[:9] + items[5][1].split())))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("__starts0", F.lit("mine"))
    key = lambda d: sorted(map(str, d.collect()))
    df = df.withColumn("a.b", F.lit(1))
    one, many = decontam.remove_spans(df, bench), decontam.remove_spans(df, bench, block_bytes=100)
    assert many.columns == df.columns and key(one) == key(many)
    assert {r.doc_id for r in many.collect()} == {3, 4, 5}


def test_pseudonyms_are_permutations():
    """Each kind over its whole format, or all of a slice of it: different values stay different, and every pseudonym is valid."""
    key = b"secret"
    of = lambda kind, values: [pii.pseudonym(kind, v, key) for v in values]
    days = [pii.dt.date.fromordinal(pii.FIRST_DAY + k) for k in range(pii.DAYS)]
    iso = of("isodate", [d.isoformat() for d in days])
    assert sorted(iso) == sorted(d.isoformat() for d in days)
    dmy = of("dmydate", [f"{d.day:02d}/{d.month:02d}/{d.year}" for d in days[::5]])
    mdy = of("dmydate", [f"{d.month:02d}/{d.day:02d}/{d.year}" for d in days[::5] if d.day > 12])
    assert len(set(dmy) | set(mdy)) == len(dmy) + len(mdy)
    assert sorted(pii._numbers(f"{k:03d}", key, "card") for k in range(1000)) == [f"{k:03d}" for k in range(1000)]
    cards = of("card", [b + str(pii.luhn(b)) for b in (f"4{k:014d}" for k in range(3000))])
    assert len(set(cards)) == 3000 and all(pii.luhn(c[:-1]) == int(c[-1]) for c in cards)
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    banks = [(c, f"AB{k:03d}CDEF{k:03d}") for c in ("GB", "DE") for k in range(1000)]
    flat = [f"{c}{98 - number(b + c + '00') % 97:02d}{b}" for c, b in banks]
    new = of("iban", flat)
    assert len(set(new)) == len(flat) and all(number(x[4:] + x[:4]) % 97 == 1 and x[:2] == f[:2] for x, f in zip(new, flat, strict=True))
    small = ["".join(x) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")]
    assert sorted(pii._letters(x, key, "t") for x in small) == sorted(small)
    assert len(set(of("ip", [f"10.{a}.{b}.7" for a in range(60) for b in range(60)]))) == 3600
    assert len(set(of("ssn", [f"123-45-{k:04d}" for k in range(1, 3000)]))) == 2999
    rng = random.Random(5)
    long = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(64)) for _ in range(1000)]
    assert sum(pii._letters(x, key, "email")[:3] == x[:3] for x in long) < 3


def test_values_at_borders():
    f = lambda t: pii.pseudonymise_text(t, b"secret", {})
    for text, kinds in {
        "call 555-123-4567.": ["phone"],
        "born 12.03.1980.": ["dmydate"],
        "on 1984-02-29. Or 123-45-6789.": ["isodate", "ssn"],
        "4111 1111 1111 1111 12/27": ["card"],
        "4111 1111 1111 1111 123": ["card"],
        "DE89 3704 0044 0532 0130 00 BIC COBADEFF": ["iban"],
    }.items():
        new, got = f(text)
        assert got == kinds and new != text, text
    assert f("4111 1111 1111 1111 12/27")[0].endswith(" 12/27") and f("DE89 3704 0044 0532 0130 00 BIC COBADEFF")[0].endswith(" BIC COBADEFF")
    assert f("version 1.12.03.1980.7 and 1555-123-4567-8 stay")[1] == []


def edited(rng, text, share):
    """The text with about ``share`` of its words replaced, each at a place of its own."""
    return " ".join(words(rng, 1) if rng.random() < share else w for w in text.split(" "))


def test_scattered_edits_are_near_duplicates(spark):
    """All pairs of similarity 0.8 or more, by brute force: far beyond two bits of a fingerprint."""
    rng = random.Random(21)
    base = [words(rng, 300) for _ in range(60)]
    texts = base + [edited(rng, t, 0.005 + 0.02 * rng.random()) for t in base]
    parent, find = union_find(len(texts))
    for a in range(len(texts)):
        for b in range(a):
            if simhash.jaccard(texts[a], texts[b], 5) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {find(k) for k in range(len(texts))}
    assert len(want) < 100
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_links_not_to_the_first(spark, monkeypatch):
    """Two near copies both go to one, though the first of their chain of fingerprints is like neither."""
    rng = random.Random(22)
    a, b = words(rng, 300), words(rng, 300)
    df = spark.createDataFrame([(1, a), (2, b), (3, b + " end")], "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprint", lambda hashes: 5)
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == {1, 2}


def test_lines_of_one_template(spark):
    """Near copies within a large bucket of lines that share most of a template."""
    rng = random.Random(23)
    frame = words(rng, 60).split()
    lines = []
    for _ in range(150):
        own = list(frame)
        for k in rng.sample(range(len(frame)), 5):
            own[k] = words(rng, 1)
        lines += [" ".join(own), " ".join(own) + "x"]
    sets = [{x[i : i + 12] for i in range(len(x) - 11)} for x in lines]
    parent, find = union_find(len(lines))
    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    want = len(lines) - len({find(k) for k in range(len(lines))})
    got = line_dedup.dedup_lines(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string"))
    assert 0.99 * want <= got.agg(F.sum("n_removed")).first()[0] <= want


def test_small_buckets_are_compared_whole(spark):
    """Every candidate pair of a bucket of at most FEW members is verified; the rounds go on with the larger ones only."""
    rng = random.Random(31)
    rows, keys = [], {}
    for key in range(20):
        base = [rng.randrange(10**6) for _ in range(18)]
        for _ in range(rng.choice((2, 5, buckets.FEW, 3 * buckets.FEW))):
            m = [v if rng.random() < 0.75 else rng.randrange(10**6) for v in base]
            keys.setdefault(key, []).append((len(rows), m))
            rows.append((key, (len(rows), m)))
    members = spark.createDataFrame(rows, "key long, x struct<id: long, m: array<int>>")
    pairs, rest = buckets._first(members, 18, 11)
    got = {(r.a, r.b) for r in pairs.collect()}
    alike = lambda p, q: sum(u == v for u, v in zip(p, q, strict=True)) >= 11
    small = {(i, j) for ms in keys.values() if len(ms) <= buckets.FEW for i, p in ms for j, q in ms if i < j and alike(p, q)}
    every = {(i, j) for ms in keys.values() for i, p in ms for j, q in ms if i < j and alike(p, q)}
    assert small and small <= got <= every
    assert {r.key for r in rest.collect()} == {k for k, ms in keys.items() if len(ms) > buckets.FEW}


def test_links_join_named_components(spark):
    """Components that grow by more links equal those of all links at once; repeated links, links within a component and new nodes too."""
    rng = random.Random(37)
    link = lambda n: [(rng.randrange(60), rng.randrange(60)) for _ in range(n)]
    first, more = link(25), [*link(25), (1, 1)]
    more += more[:5]
    df = lambda x: spark.createDataFrame(x, "a long, b long")
    told = lambda c: {r.node: r.component for r in c.collect() if r.node != r.component}
    grown = buckets._joined(components.connected_components(df(first)), df(more))
    assert told(grown) == told(components.connected_components(df(first + more)))
    assert len({r.node for r in grown.collect()}) == grown.count()


def test_long_tokens_differ_in_lines(spark):
    """What stands beyond the first 12 characters of a token counts."""
    rows = [(1, "sha 9f86d081884c7d65"), (2, "sha 9f86d081884cffff"), (3, "Donaudampfschifffahrt"), (4, "Donaudampfschiffsmotor"), (5, "202401011200004711"), (6, "202401011200000815")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == dict(rows)


def test_line_pair_recall(spark):
    """Pairs around similarity 0.8, each alone in its neighbourhood: at least 0.95 of those at 0.8 or more are found, and none below."""
    rng = random.Random(31)
    lines, pairs = [], []
    for _ in range(900):
        a = words(rng, rng.randint(10, 40))
        cut = rng.randint(1, max(2, len(a) // 7))
        b = a[:-cut] + words(rng, 1 + cut // 6)
        pairs.append((len(lines), len(lines) + 1))
        lines += [a, b]
    sets = [{x[k : k + 12] for k in range(max(1, len(x) - 11))} for x in map(str.lower, lines)]
    near = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 for a, b in pairs]
    assert 300 < sum(near) < 850
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    found = [bool(got[b]) for _, b in pairs]
    assert not any(f and not n for f, n in zip(found, near, strict=True))
    assert sum(found) >= 0.95 * sum(near)


def test_lines_of_a_very_long_text(spark):
    """Thousands of removed lines in one text, and columns with odd names."""
    rng = random.Random(32)
    lines = [words(rng, 6) + f" {k}" for k in range(4000)]
    df = spark.createDataFrame([(1, "\n".join(lines), 0), (2, "\n".join([*lines, "a line of its own here"]), 0)], "doc_id long, text string, `__gone.x` int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1].text == "\n".join(lines) and got[2].text == "a line of its own here" and got[2].n_removed == 4000 and "__gone.x" in got[1].asDict()


def test_exact_dedup_of_rows_without_ids(spark):
    """A text that only rows without an id have is kept once, is known from then on, and is counted as any other."""
    schema = "doc_id long, text string"
    index = exact_dedup.fresh_index(spark, "nulls")
    batches = [[(None, "a b"), (None, "a  b"), (None, "a\tb"), (1, "c"), (None, "c")], [(5, "a b"), (6, "a b")], [(3, "a b"), (2, "d"), (None, "d")]]
    told = [exact_dedup.exact_dedup(spark.createDataFrame(b, schema).repartition(3), index).collect() for b in batches]
    assert sorted((r.group_size, r.kept, r.keep_id) for r in told[0] if r.group_size == 3) == [(3, False, None), (3, False, None), (3, True, None)]
    assert sorted((str(r.doc_id), r.kept, r.keep_id) for r in told[0] if r.group_size == 2) == [("1", True, 1), ("None", False, 1)]
    assert not any(r.kept for r in told[1]) and all(r.keep_id is None for r in told[1])
    assert {(r.doc_id, r.kept) for r in told[2]} == {(3, False), (2, True), (None, False)}
    assert index.read().count() == 3
    index.drop()


def test_letters(spark):
    for text in ("\u00bd \u00b2 \u2460", "\u2167 12", "\u0301", "1_2", "", None, "\u3007"):
        assert not language.has_letter(text), text
    for text in ("\u02b0", "\u00aa", "\u4e2d", "1 x", "\u0915"):
        assert language.has_letter(text), text


def test_many_unlisted_languages(spark):
    """Families of similar languages keep the machines few; every language is still told apart; the sample doesn't depend on the layout of the table."""
    import random

    r = random.Random(4)
    alphabets = {f"x{k:02d}": "".join(r.sample("abcdefghijklmnopqrstuvwxyz", 9)) for k in range(20)}
    rows = [(i * 20 + k, " ".join("".join(r.choices(a, k=r.randrange(2, 8))) for _ in range(30)), c) for i in range(24) for k, (c, a) in enumerate(alphabets.items())]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert sum(map(len, model.families.values())) == 20 and max(map(len, model.families.values())) <= 5 and len(model.families) <= 5
    assert len(model.between) + len(model.within) < 60 and all(w.dtype == "float32" for w in model.within.values())
    held = {d for d, *_ in rows if zlib.crc32(str(d).encode()) % 3 == 1}
    got = {r.doc_id: r.lang_pred for r in language.predict(df, model).collect()}
    assert sum(got[d] == c for d, _, c in rows if d in held) >= 0.9 * sum(d in held for d, *_ in rows)
    other = language.fit(df.repartition(7, "text"), most_chars=40_000)
    again = language.fit(df.coalesce(1), most_chars=40_000)
    assert all((other.within[k] == again.within[k]).all() for k in again.within)
    with pytest.raises(ValueError):
        language.fit(df, most_languages=19)


def test_decontamination_with_clashing_names(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    bench = spark.createDataFrame([(1, passage), (2, passage + " more words here")], "item_id long, text string")
    names = ["__words", "__s", "__s0", "__i", "__starts", "__ends", "__items", "n_words__", "c0", "a.b", "n_words"]
    df = spark.createDataFrame([(1, f"before {passage} after and much more text to stay here than there was before it all began", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    for block in (32 << 20, 60):
        got = decontam.remove_spans(df, bench, block_bytes=block)
        assert got.columns == df.columns
        row = got.first()
        assert row[2:] == tuple(range(len(names))) and passage not in row.text and row.text.startswith("before")
        assert [r.n_hit for r in decontam.decontaminate(df, bench, block_bytes=block).collect()] == [12]


def test_window_of_every_item_is_verified_once():
    index = decontam.ngram_index([(k, "a b c d e f g h i j k") for k in range(50)])
    words = decontam.words_of("a b c d e f g h i j k " * 200)
    spans, found = decontam.scan(words, index)
    assert len(found) == 50 and len(index.told) == 2 and spans == [(0, 2200)]


def test_toxicity_sample_is_bounded(spark):
    """A text that exceeds the room is passed over, not the end of its class; repeated rows count once; the held-out fold is never learned."""
    words = "plain words of no harm stand here".split()
    rows = [(i, " ".join(words * 4) + f" {i}") for i in range(60)] + [(100 + i, "you utter zork and grumf go away " * 3 + str(i)) for i in range(60)]
    rows += [(200, "zork grumf " * 400), (201, "plain " * 400), (3, "another text of the same id"), (7, None)] + rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame([(i, int(100 <= i <= 200)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    seen = []
    was, toxicity.train = toxicity.train, seen.append
    try:
        toxicity.fit(df, lab, longest=3000, max_chars=2500)
        toxicity.fit(df, lab, per_class=(5, 4))
    finally:
        toxicity.train = was
    for got in seen:
        assert len(got) == len(set(got)) and {k for _, k in got} == {0, 1}
        ids = {i for i, t in rows if (t, 0) in got or (t, 1) in got}
        assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids if i < 100 and i != 3)
    assert all(sum(len(t) for t, k in seen[0] if k == c) <= 2500 for c in (0, 1)) and sum(k for _, k in seen[0]) > 10
    assert [sum(k == c for _, k in seen[1]) for c in (0, 1)] == [5, 4]
    model = toxicity.train(seen[0])
    score = model.scorer()
    assert score("you utter zork and grumf go away now") > 0.5 > score("plain words of no harm stand here too")


def test_fingerprint_without_id_joins_two_components(spark, monkeypatch):
    """Fingerprints 0 and 4 bits apart meet through one, two bits from each, that only rows without an id have."""
    def made(docs, width=3):
        return docs.select("doc_id", F.col("text").cast("long").alias("fp"))

    monkeypatch.setattr(simhash, "fingerprints", made)
    df = spark.createDataFrame([(9, "0"), (None, "3"), (None, "3"), (4, "15"), (5, str(7 << 40)), (None, str(1 << 20 | 1 << 50 | 1 << 60))], "doc_id long, text string")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.simhash_groups(df).collect()), key=str)
    assert got == sorted([(9, 0, 4), (None, 3, 4), (None, 3, 4), (4, 15, 4), (5, 7 << 40, 5), (None, 1 << 20 | 1 << 50 | 1 << 60, None)], key=str)



@pytest.mark.parametrize("most", [60, 10**6])
def test_no_candidate_of_a_large_bucket_is_lost(spark, monkeypatch, most):
    """One bucket of lines whose values are all common, so that neither its leader nor a rare value nor a few draws find their links; against all pairs."""
    monkeypatch.setattr(buckets, "SHARE", 100)
    rng = random.Random(41)
    lines = [[rng.randrange(4) for _ in range(18)] for _ in range(600)]
    agree = lambda p, q: sum(u == v for u, v in zip(lines[p], lines[q], strict=True))
    near = [(a, b) for a in range(600) for b in range(a + 1, 600) if agree(a, b) >= 11]
    parent, find = union_find(600)
    for a, b in near:
        if (a + b) % 3:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert sum((a + b) % 3 > 0 for a, b in near) > 100
    members = spark.createDataFrame([(1, (k, m)) for k, m in enumerate(lines)], "key long, x struct<id: long, m: array<int>>")
    asked = []

    def verify(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return buckets.stage(pairs.where("(a + b) % 3 > 0"), "links")

    got = {r.node: r.component for r in buckets.verified_components(members, 18, 11, verify, most=most).collect()}
    assert all(got.get(k, k) == find(k) for k in range(600))
    assert len(asked) == len(set(asked)) and set(asked) <= set(near)


def test_candidates_that_cannot_be_alike_are_no_rows(spark):
    """Lines of one template that stay apart: each candidate is a row once, none that the sketches rule out is, and all links are still among them."""
    rng = random.Random(41)
    frame, lines = words(rng, 60).split(), []
    for k in range(60):
        own = list(frame)
        for at in rng.sample(range(len(frame)), 2 + k % 7):
            own[at] = words(rng, 1)
        lines.append(" ".join(own).lower())
    sets = [{x[i : i + 12] for i in range(len(x) - 11)} for x in lines]
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    m = [[(min(zlib.crc32(f"{i} {s}".encode()) for s in x) >> 3) % 4 for i in range(18)] for x in sets]
    df = spark.createDataFrame([(0, (k, m[k]), k) for k in range(60)], "key long, x struct<id: long, m: array<int>>, c long")
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    seen = spark.createDataFrame([], "a long, b long")
    alike = {(a, b) for b in range(60) for a in range(b) if sum(u == v for u, v in zip(m[a], m[b], strict=True)) >= 11}
    plain = [(r.a, r.b) for r in buckets._left_over(df, seen, 18, 11).collect()]
    told = [(r.a, r.b) for r in buckets._left_over(df, seen, 18, 11, lambda ids: line_dedup._sketched(ids, texts), 0.8).collect()]
    assert sorted(plain) == sorted(alike)
    assert len(told) == len(set(told)) and {p for p in alike if sim(*p) >= 0.8} <= set(told) <= alike
    assert not any(sim(*p) < 0.7 for p in told) and len(told) < len(alike)
    sizes = {r.id: r["size"] for r in line_dedup._sketched(texts.select("id"), texts).collect()}
    assert sizes == {k: len(x) for k, x in enumerate(sets)}


def test_a_linked_group_makes_few_rows(spark, monkeypatch):
    """A group whose lines are nearly all linked with each other: rows left over grow with its lines, not with their pairs, and no link is lost."""
    monkeypatch.setattr(buckets, "DRAWN", 8, raising=False)
    n, made, plain = 300, [], buckets.stage

    def stage(df, tag="stage"):
        out = plain(df, tag)
        if tag == "left":
            made.append(out.count())
        return out

    monkeypatch.setattr(buckets, "stage", stage)
    near = lambda a, b: (a + b) % 3 > 0 or (a, b) == (0, 3)
    parent, find = union_find(n + 1)
    for b in range(n):
        for a in range(b):
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    # line n is a candidate of all, linked with none
    rows = [(1, (k, list(range(14)) + [100 + 4 * k + i for i in range(4)])) for k in range(n + 1)]
    members = spark.createDataFrame(rows, "key long, x struct<id: long, m: array<int>>")
    verify = lambda pairs: plain(pairs.where(f"((a + b) % 3 > 0 or (a = 0 and b = 3)) and b < {n}"), "links")
    got = {r.node: r.component for r in buckets.verified_components(members, 18, 11, verify).collect()}
    assert all(got.get(k, k) == find(k) for k in range(n + 1))
    assert sum(made) <= 20 * n
