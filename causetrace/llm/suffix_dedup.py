"""Repeated byte strings: buckets of q-grams, refined recursively by the identifiers of longer strings around them.

A string of ``window`` bytes that occurs twice has equal q-grams at equal offsets, so one q-gram of each window
stands for it: the one with the least hash (its anchor). Windows that share an anchor in place form a run, and all
occurrences of a q-gram as an anchor form the initial bucket. A bucket is refined by the identifier of the
whole string that a run covers: occurrences that agree on it are repeated in full, a bucket of one occurrence holds
no repeat, and only the rest goes on to shorter pieces of the run, down to single windows. Each round refines the
buckets that the one before left open, so the work falls off quickly and no step needs a row for every byte.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causetrace.llm import anchors
from causetrace.llm.common import map_text, stage, unstage

WINDOW = 200
GRAM = 64
#: Windows in a piece at each refinement after the first; the last is a single window.
PIECES = (8, 1)

_KEYS = ["doc_id", "th"]


def _chunks(texts: list[bytes], window: int):
    """(text number, first byte, bytes) so that every window lies in exactly one chunk."""
    step = anchors.BUFFER - window + 1
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - window + 1), step):
            yield k, at, t[at : at + anchors.BUFFER]


def _first_pieces(window: int, q: int):
    """Runs of each text: arrays of bucket (anchor identifier), string identifier, first window, windows, anchor."""

    def one(group: list, out: list) -> None:
        data, bounds = b"".join(c for _, _, c in group), []
        for _, _, c in group:
            bounds.append((bounds[-1][1] if bounds else 0, (bounds[-1][1] if bounds else 0) + len(c)))
        spans = anchors.Spans(anchors.buffer_of(data))
        first, last, anchor = anchors.runs(spans, bounds, window, q)
        cols = (spans.of(anchor, anchor + q), spans.of(first, last + window), first, last - first + 1, anchor)
        cuts = np.searchsorted(first, [b for _, b in bounds])
        begin = 0
        for (k, at, _), (a, _), end in zip(group, bounds, cuts, strict=True):
            shift = at - a
            part = [c[begin:end] for c in cols]
            out[k].append((part[0].view(np.int64), part[1].view(np.int64), part[2] + shift, part[3], part[4] + shift))
            begin = end

    def f(texts: list) -> dict[str, list]:
        out: list[list] = [[] for _ in texts]
        group, size = [], 0
        for c in _chunks([(t or "").encode() for t in texts], window):
            if len(c[2]) < window:
                continue
            if size + len(c[2]) > anchors.BUFFER:
                one(group, out)
                group, size = [], 0
            group.append(c)
            size += len(c[2])
        if group:
            one(group, out)
        none = np.zeros(0, dtype=np.int64)
        joined = [[np.concatenate(x) for x in zip(*o, strict=True)] if o else [none] * 5 for o in out]
        return {n: [j[i] for j in joined] for i, n in enumerate(("b", "f", "s", "n", "a"))}

    return f


def _next_pieces(window: int, width: int):
    """The open runs of a text cut into pieces of ``width`` windows, aligned to the anchor, with their identifiers."""

    def cut(raw: bytes, rows: np.ndarray) -> list[np.ndarray]:
        b, s, n, a = rows
        top, low = a - s, a - s - n + 1  # how far the anchor lies behind the first and the last window
        blocks = top // width - low // width + 1
        row = np.repeat(np.arange(len(s)), blocks)
        k = top[row] // width - (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        first = a[row] - np.minimum(top[row], k * width + width - 1)
        last = a[row] - np.maximum(low[row], k * width)
        core = a[row] - k * width, a[row] - k * width - width + 1 + window
        done = [np.zeros(len(row), dtype=np.uint64) for _ in range(2)]
        order = np.argsort(first, kind="stable")
        i = 0
        while i < len(order):  # in buffers that hold the pieces whole
            base = min(int(first[order[i]]), int(core[0][order[i]]))
            base = max(0, base - window)
            j = int(np.searchsorted(first[order], base + anchors.BUFFER - 3 * window - width))
            j = max(j, i + 1)
            spans = anchors.Spans(anchors.buffer_of(raw[base : base + anchors.BUFFER]))
            at = order[i:j]
            done[0][at] = spans.of(core[0][at] - base, core[1][at] - base)
            done[1][at] = spans.of(first[at] - base, last[at] + window - base)
            i = j
        bucket = anchors._mix(done[0] ^ anchors._mix(b[row].view(np.uint64) + k.astype(np.uint64)))
        return [bucket.view(np.int64), done[1].view(np.int64), first, last - first + 1, a[row]]

    def f(texts: list, todo: list) -> list[list[np.ndarray]]:
        return [cut((t or "").encode(), np.array([[r[c] for r in rows] for c in ("b", "s", "n", "a")], dtype=np.int64)) for t, rows in zip(texts, todo, strict=True)]

    return f


def _settle(pieces: DataFrame, window: int, final: bool) -> tuple[DataFrame, DataFrame | None]:
    """(repeated byte ranges, pieces still open) of staged ``pieces(doc_id, th, b, f, s, n, a)``.

    Counts are partial aggregates and every join is a sort-merge join of two shuffles, so a bucket that a third of
    all pieces share does not sit in one task.
    """
    span = [*_KEYS, "s", (F.col("s") + F.col("n") - 1 + window).alias("e")]
    if final:
        twice = pieces.groupBy("b", "f").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("b", "f")
        return stage(pieces.join(twice.hint("merge"), ["b", "f"], "left_semi").select(*span), "repeats"), None
    shared = stage(pieces.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("b"), "buckets")
    met = stage(pieces.join(shared.hint("merge"), "b", "left_semi"), "met")
    oid = F.xxhash64("doc_id", "th", "s")
    classes = stage(met.groupBy("b", "f").agg(F.count(F.lit(1)).alias("c"), F.min(oid).alias("rep")), "classes")
    mixed = stage(classes.groupBy("b").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("c") == 1).cast("long")).alias("u")).where("k > 1 and u > 0").select("b", F.lit(True).alias("open")), "mixed")
    known = classes.join(mixed.hint("merge"), "b", "left")
    known = stage(known.where("c > 1 or open").select("b", "f", "c", "rep", F.coalesce("open", F.lit(False)).alias("open")), "known")
    told = met.join(known.hint("merge"), ["b", "f"])
    repeats = stage(told.where("c > 1").select(*span), "repeats")
    # of pieces that agree, one goes on to stand for all
    rest = stage(told.where(F.col("open") & ((F.col("c") == 1) | (oid == F.col("rep")))).select(*_KEYS, "b", "s", "n", "a"), "open")
    for x in (shared, met, classes, mixed, known):
        unstage(x)
    return repeats, rest


def _with_text(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    right = lists.withColumnsRenamed({"doc_id": "__d", "th": "__t"})
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("th").eqNullSafe(F.col("__t"))
    return docs.join(right.hint("merge"), on, how).drop("__d", "__t")


def repeated_spans(docs: DataFrame, window: int = WINDOW, q: int = GRAM) -> DataFrame:
    """``doc_id, th, s, e``: byte ranges (of UTF-8) covered by repeated ``window``-byte strings; ranges may overlap."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    arrays = map_text(keyed, lambda: _first_pieces(window, q), "b array<bigint>, f array<bigint>, s array<bigint>, n array<bigint>, a array<bigint>", keep=("doc_id", "th"))
    pieces = stage(arrays.select("doc_id", "th", F.explode(F.arrays_zip("b", "f", "s", "n", "a")).alias("x")).select("doc_id", "th", "x.*"), "anchors")
    repeats, rest = _settle(pieces, window, final=False)
    unstage(pieces)
    parts = [repeats]
    for width in PIECES:
        todo = rest.groupBy(*_KEYS).agg(F.collect_set(F.struct("b", "s", "n", "a")).alias("todo"))
        arrays = _cut_open(_with_text(keyed, todo, "inner"), window, width)
        pieces = stage(arrays.select("doc_id", "th", F.explode(F.arrays_zip("b", "f", "s", "n", "a")).alias("x")).select("doc_id", "th", "x.*"), "pieces")
        unstage(rest)
        repeats, rest = _settle(pieces, window, final=width == 1)
        unstage(pieces)
        parts.append(repeats)
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _cut_open(rows: DataFrame, window: int, width: int) -> DataFrame:
    import pyarrow as pa

    names = ("b", "f", "s", "n", "a")

    def run(batches):
        cut = _next_pieces(window, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                got = cut(part.column(2).to_pylist(), part.column(3).to_pylist())
                cols = [pa.array([g[i] for g in got], type=pa.list_(pa.int64())) for i in range(5)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["doc_id", "th", *names])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "th", "text", "todo").mapInArrow(run, f"doc_id {id_type}, th bigint, " + ", ".join(f"{n} array<bigint>" for n in names))


def merge_ranges(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, q: int = GRAM) -> DataFrame:
    """Every row as ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary): the UTF-8 bytes that no repeated string covers.

    A byte goes if a string of ``window`` bytes around it starts anywhere else too, in the same text or another;
    strings are judged on the input. Null counts as empty. Each row of a repeated doc_id is a document of its own;
    rows that repeat doc_id and text count as two occurrences. Cut bytes may split a character, hence binary.
    """
    import pyarrow as pa

    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    # rows that repeat both share their ranges; each range is listed once, however many such rows there are
    ranges = repeated_spans(docs, window, q).groupBy(*_KEYS).agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    rows = _with_text(keyed, ranges, "left")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                cuts = [merge_ranges([(x["s"], x["e"]) for x in r or ()]) for r in part.column(2).to_pylist()]
                kept = []
                for t, c in zip(raw, cuts, strict=True):
                    edges = [0, *[e for _, e in c]], [*[s for s, _ in c], len(t)]
                    kept.append(b"".join(t[a:b] for a, b in zip(*edges, strict=True)))
                cols = [[len(t) for t in raw], [len(t) - len(k) for t, k in zip(raw, kept, strict=True)], [len(c) for c in cuts]]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, type=pa.int64()) for c in cols], pa.array(kept, type=pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the operator's result: one row for each row of ``docs``; see ``without_repeats`` for nulls and repeats."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
