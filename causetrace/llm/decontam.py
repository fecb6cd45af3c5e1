"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned over every training text."""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causetrace.llm.common import SLICE_ROWS, columns_of, map_text

WINDOW = 10
#: Broadcast the windows of at most so many bytes of benchmark text at once (five times that in each task); a larger benchmark takes
#: one scan for each block, with the same result.
BLOCK_BYTES = 32 << 20
#: Windows whose items a task remembers.
TOLD = 4096
#: Fixed value: bytes that separate words after A-Z are lower-cased (00-2F, 3A-60, 7B-7F become a space).
FOLD = bytes(b + 32 if 65 <= b <= 90 else (32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text, as UTF-8."""
    return (text or "").encode().translate(FOLD).split()


@dataclass
class Index:
    """A hash set of the windows of some benchmark items, by window length, and what is needed to verify a hit.

    A window takes 16 bytes: its hash, in order, and its place (item and first byte) in the items' normalised texts.
    """

    ids: list[str | None]
    texts: list[bytes]
    hashes: dict[int, np.ndarray]
    places: dict[int, np.ndarray]
    words: dict[int, set[bytes]]
    #: Items of the windows that occurred of late, so that one that every item holds is verified once, not at each place.
    told: dict[bytes, list[int]] = field(default_factory=dict)
    listed: int = 0

    def items(self, n: int, window: bytes) -> list[int]:
        """The items in which the window of ``n`` words occurs: those of its hash, each verified."""
        if (known := self.told.get(window)) is not None:
            return known
        h = np.uint64(xxhash.xxh3_64_intdigest(window))
        lo = int(np.searchsorted(self.hashes[n], h))
        out = []
        while lo < len(self.hashes[n]) and self.hashes[n][lo] == h:
            item, at = divmod(int(self.places[n][lo]), 1 << 32)
            if self.texts[item][at : at + len(window)] == window:
                out.append(item)
            lo += 1
        if out:
            self.listed += len(out)
            if len(self.told) >= TOLD or self.listed > 100 * TOLD:
                self.told.clear()
                self.listed = len(out)
            self.told[window] = out
        return out


def ngram_index(items: list[tuple], window: int = WINDOW) -> Index:
    """The index of ``items`` (id, text). A null id is never listed, but its windows hit."""
    found: dict[int, tuple[array, array]] = {}
    texts, vocabulary = [], {}
    for k, (_, text) in enumerate(items):  # one item's words at a time, eight bytes a hash and a place
        words = words_of(text)
        n, seen, at = min(window, len(words)), set(), 0
        texts.append(b" ".join(words))
        if not n:
            continue
        hashes, places = found.setdefault(n, (array("Q"), array("q")))
        vocabulary.setdefault(n, set()).update(words)
        for i in range(len(words) - n + 1):
            h = xxhash.xxh3_64_intdigest(b" ".join(words[i : i + n]))
            if h not in seen:
                seen.add(h)
                hashes.append(h)
                places.append(k << 32 | at)
            at += len(words[i]) + 1
    sorted_hashes, sorted_places = {}, {}
    for n, (h, p) in found.items():
        h, p = np.frombuffer(h, dtype=np.uint64), np.frombuffer(p, dtype=np.int64)
        order = np.argsort(h, kind="stable")
        sorted_hashes[n], sorted_places[n] = h[order], p[order]
    return Index([None if i is None else str(i) for i, _ in items], texts, sorted_hashes, sorted_places, vocabulary)


def scan(words: list[bytes], index: Index) -> tuple[list[tuple[int, int]], set[int]]:
    """Hit word ranges (start, end), merged, and the items with an occurring window.

    Only runs of at least n words that all occur in n-word windows can hold one, so the look-up runs over those alone.
    """
    spans, found = [], set()
    for n in index.hashes:
        inside = bytes(map(index.words[n].__contains__, words))
        for run in re.finditer(b"\x01{%d,}" % n, inside):
            for i in range(run.start(), run.end() - n + 1):
                items = index.items(n, b" ".join(words[i : i + n]))
                if items:
                    spans.append((i, i + n))
                    found.update(items)
    spans.sort()
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, found


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark in blocks of a bounded size: each is small enough to broadcast, whatever the total."""
    total = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield n, [(r["item_id"], r["text"]) for r in part.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Report benchmark windows in every text: ``doc_id, n_words, n_hit, starts, ends, items``.

    ``starts``/``ends`` are merged hit ranges in words, ``items`` the distinct item ids as sorted
    strings. A null or empty text or item has no words; a repeated item counts once per item_id.
    Documents are scanned where they lie, without a shuffle. The broadcast holds one block of at
    most ``block_bytes`` of benchmark text; a larger benchmark takes one scan for each block, and
    the hits of the blocks are merged by document.
    """
    out = _hits(docs.select("doc_id", "text"), benchmark, window, block_bytes, ("doc_id",))
    out = out.select("doc_id", F.col("__words").alias("n_words"), F.col("__starts").alias("starts"), F.col("__ends").alias("ends"), F.col("__items").alias("items"))
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return out.withColumn("n_hit", hit)


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` with ``__words, __starts, __ends, __items``: the hits of all blocks in the uncut text, merged."""
    spark, out, n = docs.sparkSession, docs, 0
    for n_blocks, rows in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(ngram_index(rows, window))
        kept = keep if n == n_blocks - 1 else (*keep, *(c for c in ("text",) if c not in keep))
        before = tuple(f"__{c}{k}" for k in range(n) for c in "sei")
        found = map_text(out, _scanner(shared), "n_words__ bigint, __s array<bigint>, __e array<bigint>, __i array<string>", keep=(*kept, *before))
        out = found.withColumnsRenamed({"__s": f"__s{n}", "__e": f"__e{n}", "__i": f"__i{n}", "n_words__": "__words"})
        out, n = out.drop("__words") if n < n_blocks - 1 else out, n + 1
    kept = [F.col(f"`{c}`") for c in keep]
    if n == 1:
        return out.select(*kept, "__words", F.col("__s0").alias("__starts"), F.col("__e0").alias("__ends"), F.col("__i0").alias("__items"))
    spans = F.array_sort(F.concat(*[F.arrays_zip(F.col(f"__s{k}").alias("starts"), F.col(f"__e{k}").alias("ends")) for k in range(n)]))
    merged = F.aggregate(spans, F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"), _merge_span)
    items = F.array_sort(F.array_distinct(F.concat(*[F.col(f"__i{k}") for k in range(n)])))
    out = out.select(*kept, "__words", merged.alias("__m"), items.alias("__items"))
    return out.select(*kept, "__words", F.col("__m.starts").alias("__starts"), F.col("__m.ends").alias("__ends"), "__items")


def _merge_span(acc, x):
    last = F.element_at(acc, -1)
    longer = F.array(F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], x["ends"]).alias("ends")))
    touches = F.when(F.size(acc) > 0, last["ends"] >= x["starts"]).otherwise(F.lit(False))
    return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), longer)).otherwise(F.concat(acc, F.array(x)))


def _scanner(shared):
    def make():
        index = shared.value

        def f(texts: list) -> dict[str, list]:
            out: dict[str, list] = {"n_words__": [], "__s": [], "__e": [], "__i": []}
            for text in texts:
                words = words_of(text)
                spans, found = scan(words, index)
                out["n_words__"].append(len(words))
                out["__s"].append([a for a, _ in spans])
                out["__e"].append([b for _, b in spans])
                out["__i"].append(sorted({index.ids[k] for k in found} - {None}))
            return out

        return f

    return make


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut_spans(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the hit words and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(_LOWER))]
    out, last = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without benchmark passages: hit spans are cut out, and a document of which more than
    ``drop_share`` of the words are hit is dropped. One scan for each block of the benchmark; the hits of all blocks
    are merged before anything is cut or judged. All columns of ``docs`` remain, ``n_chars`` follows the text when
    present. Null texts stay null, empty texts empty; repeated rows are treated alike; empty tables are allowed."""
    import pyarrow as pa

    plain = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # any name may come in, those used inside too
    rows = docs.select(*[c.alias(n) for c, n in zip(columns_of(docs), plain, strict=True)])
    hits = _hits(rows, benchmark, window, block_bytes, tuple(plain))
    share = F.aggregate(F.zip_with("__starts", "__ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    left = hits.where(share <= drop_share * F.col("__words")).select(*plain, "__starts", "__ends")

    def cut(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                old, starts, ends = (part.column(c).to_pylist() for c in (at, part.num_columns - 2, part.num_columns - 1))
                new = [cut_spans(t, a, b) if a else t for t, a, b in zip(old, starts, ends, strict=True)]
                cols = [pa.array(new, type=pa.string()) if c == at else part.column(c) for c in range(part.num_columns - 2)]
                yield pa.RecordBatch.from_arrays(cols, names=plain)

    out = left.mapInArrow(cut, rows.schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``; a null text has no words, repeated rows get equal rows."""
    hits = decontaminate(docs, benchmark)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
