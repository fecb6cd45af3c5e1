"""SimHash near-duplicates: word-shingle fingerprints, pigeonhole blocks, Hamming verification, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causetrace.llm.buckets import band_keys, verified_components
from causetrace.llm.common import columns_of, fresh, map_text, stage, text_or_empty, unstage
from causetrace.llm.components import connected_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Buckets of more members are linked through one-bit neighbourhoods instead of pairs; both ways are exact.
PAIR_LIMIT = 8
#: MinHash bands of the pipeline's stage, values in a band, and how many of all values a candidate pair must agree in (0.8: probability 0.998).
BANDS, ROWS, AGREE = 12, 4, 30
_RANDOM = np.random.default_rng(20240101)
FACTORS = _RANDOM.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 (seed 42) of every run of ``width`` words, repeats included; fewer words form one shingle, none give none."""
    words = (text or "").encode().translate(LOWER).split()
    n = len(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return [digest(b" ".join(words), 42)] if n else []
    if width == 3:
        return [digest(b"%b %b %b" % t, 42) for t in zip(words, words[1:], words[2:], strict=False)]
    return [digest(b" ".join(t), 42) for t in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprint(hashes: list[int]) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the hashes; no hashes give zero."""
    if not hashes:
        return 0
    h = np.array(hashes, dtype=np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed long) of every whole text; null and empty texts get zero. No shuffle."""

    def make():
        return lambda texts: {"fp": [fingerprint(shingle_hashes(t, width)) for t in texts]}

    return map_text(docs, make, "fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(radius: int, spare: int = 3) -> list[int]:
    """Masks of ``radius + spare`` blocks, ``spare`` at a time: fingerprints that differ in at most ``radius``
    bits agree on a whole mask (pigeonhole). More spare blocks give wider, more selective masks."""
    n = radius + spare
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(n)]
    return [sum(c) for c in combinations(blocks, spare)]


def link_fingerprints(nodes: DataFrame, radius: int = 2, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links ``a, b`` whose closure joins all of ``nodes(node, fp)`` within ``radius`` bits, each fp given once.

    Nodes meet in buckets that agree on a pigeonhole mask. Pairs of a small bucket are compared directly.
    In a larger one, each member also stands at its fingerprint and at all those one bit off within the
    free bits: members that stand at the same place differ in at most two bits, and any two within two bits
    do share a place. For ``radius`` 2 that replaces pairs by a number of rows in proportion to the members,
    so a group of thousands of near copies costs no square. Every link is verified by its Hamming distance.
    """
    masks = block_masks(radius)
    key = [F.struct(F.lit(i).cast("short").alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)]
    placed = nodes.select("node", "fp", F.explode(F.array(*key)).alias("k")).select("node", "fp", "k.i", "k.v")
    sizes = placed.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(placed.join(sizes.hint("merge"), ["i", "v"]), "blocks")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
    small = shared.where(F.col("n") <= pair_limit) if radius == 2 else shared
    other = small.select("i", "v", F.col("node").alias("b"), F.col("fp").alias("fp2"))
    links = small.hint("merge").join(other, ["i", "v"]).where(F.col("node") < F.col("b")).where(near).select(F.col("node").alias("a"), "b")
    if radius != 2:
        return links
    ball = F.coalesce(
        *[
            F.when(F.col("i") == i, F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64) if not m >> b & 1], F.col("fp")))
            for i, m in enumerate(masks)
        ]
    )
    stands = shared.where(F.col("n") > pair_limit).select("i", "node", "fp", F.explode(ball).alias("place"))
    # at one place stand at most 65 - bits(mask) different fingerprints, so the list is bounded
    met = stands.groupBy("i", "place").agg(F.min(F.struct("node", "fp")).alias("first"), F.collect_list(F.struct("node", "fp")).alias("all")).where(F.size("all") > 1)
    star = met.select(F.explode("all").alias("x"), "first").select(F.col("first.node").alias("a"), F.col("x.node").alias("b"), F.col("first.fp").alias("fp"), F.col("x.fp").alias("fp2"))
    return links.unionByName(star.where("a <> b").where(near).select("a", "b")).distinct()


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: texts whose fingerprints differ in at most ``radius`` bits are
    linked, and the component is the smallest doc_id reachable. Empty and null texts share fingerprint zero. Rows without
    an id link like any other; a component in which no row has one has no id either.

    Equal fingerprints collapse to one node before any comparison, so copies, however many, cost one row.
    """
    fps = stage(fingerprints(docs, width), "fps")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("smallest")).select("fp", F.col("fp").alias("node"), "smallest"), "nodes")
    comp = connected_components(link_fingerprints(nodes, radius))
    placed = nodes.join(comp.hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("c"), "smallest")
    placed = stage(placed, "placed")
    unstage(nodes)
    names = placed.groupBy("c").agg(F.min("smallest").alias("component_id"))
    named = stage(placed.join(names.hint("merge"), "c").select("fp", "component_id"), "named")
    unstage(placed)
    return fps.join(named.hint("merge"), "fp", "left").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the operator's result: one row for each row of ``docs``, those that repeat included; see ``simhash_groups`` for nulls and ties."""
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def jaccard(a: str | None, b: str | None, width: int) -> float:
    """Similarity of the shingle sets of two texts; two texts without words are equal."""
    x, y = set(shingle_hashes(a, width)), set(shingle_hashes(b, width))
    return len(x & y) / len(x | y) if x or y else 1.0


def drop_near_duplicates(docs: DataFrame, width: int = 5, radius: int = 2, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns as they were.

    Candidates are the fingerprints within ``radius`` bits over ``width``-word shingles and, as two texts of similarity 0.8 differ in
    ten bits or so, the texts that share a MinHash band (probability 0.998 at 0.8, 0.99998 at 0.9). Candidates are linked if their
    shingle sets have a Jaccard similarity of at least ``similarity``; of each component of links the smallest doc_id stays.
    Empty and null texts are equal. Rows that repeat a doc_id and text share one decision; rows with a null doc_id always stay.
    """
    key = ["doc_id", fresh(docs, "__th"), fresh(docs, "__tk")]
    keyed = docs.withColumns({key[1]: F.xxhash64(text_or_empty()), key[2]: F.xxhash64(F.lit(7), text_or_empty())})
    told = map_text(keyed, _signer(width), "fp bigint, h1 bigint, h2 bigint, m array<int>", keep=tuple(key))
    told = stage(told.where("doc_id is not null").select(*key, "fp", F.struct("h1", "h2").alias("id"), "m"), "fps")
    # each run of words once; any row that has it lends its text
    nodes = stage(told.groupBy("id").agg(F.min(F.struct(*key)).alias("k"), F.first("fp").alias("fp"), F.first("m").alias("m")), "nodes")
    banded = nodes.where(F.size("m") > 0).select(F.struct("id", "m").alias("x"), F.explode(F.array(*band_keys(F.col("m"), BANDS, ROWS))).alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = stage(banded.join(shared.hint("merge"), "key"), "members")
    prints = stage(nodes.groupBy("fp").agg(F.min("id").alias("node")), "prints")
    close = link_fingerprints(prints, radius).select("a", "b")
    heads = nodes.join(prints.select("fp", "node").hint("merge"), "fp").where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    close = stage(close.unionByName(heads), "close")
    wanted = members.select("x.id").unionByName(close.select(F.col("a").alias("id"))).unionByName(close.select(F.col("b").alias("id"))).distinct()
    wanted = nodes.join(wanted.hint("merge"), "id").select("id", "k.*")
    texts = stage(keyed.select(*key, "text").join(wanted.hint("merge"), key).select("id", "text").dropDuplicates(["id"]), "texts")
    verify = lambda pairs: _verified(pairs, texts, width, similarity)
    comp = verified_components(members, BANDS * ROWS, AGREE, verify, verify(close))
    named = stage(told.select(*key, "id").join(comp.withColumnRenamed("node", "id").hint("merge"), "id", "left").select(*key, F.coalesce("component", "id").alias("comp")), "named")
    first = named.groupBy("comp").agg(F.min(F.struct(*key)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("comp", "first")
    gone = stage(named.join(first.hint("merge"), "comp").where(F.struct(*key) != F.col("first")).select(*key).distinct(), "gone")
    for x in (told, nodes, members, prints, close, texts, comp, named):
        unstage(x)
    left = keyed.join(gone.hint("merge"), key, "left_anti")
    return left.select(*columns_of(docs))


def minhash(hashes: list[int]) -> list[int]:
    """``BANDS * ROWS`` MinHash values of a list of shingle hashes; none give none."""
    if not hashes:
        return []
    h, low = np.array(hashes, dtype=np.uint64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 4096):
        low = np.minimum(low, (h[None, at : at + 4096] * FACTORS[:, None] + TERMS[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()


def _signer(width: int):
    def f(texts: list) -> dict[str, list]:
        out: dict[str, list] = {"fp": [], "h1": [], "h2": [], "m": []}
        for text in texts:
            hashes = shingle_hashes(text, width)
            whole = xxhash.xxh3_128_intdigest(b" ".join((text or "").encode().translate(LOWER).split()))
            out["fp"].append(fingerprint(hashes))
            out["h1"].append(_signed(whole >> 64))
            out["h2"].append(_signed(whole & (1 << 64) - 1))
            out["m"].append(minhash(hashes))
        return out

    return lambda: f


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts have a Jaccard similarity of at least ``similarity``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ok = [jaccard(a, b, width) >= similarity for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(2)], names=["a", "b"]).filter(pa.array(ok, type=pa.bool_()))

    of = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")).hint("merge")
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb")
    return stage(both.mapInArrow(run, pairs.select("a", "b").schema), "links")
