"""Fill-in-the-middle transformation: whole texts cut at line or character boundaries and dealt in two orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causetrace.llm.common import SLICE_ROWS

MARKS = ("<P>", "<S>", "<M>")
#: Values that one container spans, and the bytes of a bitmap over them.
SPAN, BITMAP_BYTES = 1 << 16, 8192


class _Array:
    """Sorted 16-bit values as they are."""

    def __init__(self, low: np.ndarray):
        self.values = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class _Bitmap:
    """A bit for each of the 65,536 values, and how many are set before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(inside)[k - self.before[word]])


class _Runs:
    """First values of runs of successive values, and how many values are before each run."""

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.starts = low[first].astype(np.uint16)
        self.before = first

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class BoundarySet:
    """The offsets at which a text may be cut, as compressed containers by their high bits.

    Each container of 65,536 offsets takes the smallest form: sorted array, bitmap or runs. ``select(k)`` gives the ``k``-th smallest
    offset: binary search in the cumulative cardinalities finds the container, a select inside it the offset.
    """

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        at = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(offsets) else np.zeros(0, dtype=np.int64)
        self.keys = high[at]
        self.before = np.concatenate([at, [len(offsets)]])
        self.containers = [self._container(offsets[a:b] & (SPAN - 1)) for a, b in zip(at, self.before[1:], strict=True)]

    def __len__(self) -> int:
        return int(self.before[-1])

    @staticmethod
    def _container(low: np.ndarray) -> _Array | _Bitmap | _Runs:
        first = np.flatnonzero(np.concatenate([[True], np.diff(low) != 1]))
        runs, array = 4 * len(first), 2 * len(low)
        if runs <= min(array, BITMAP_BYTES):
            return _Runs(low, first)
        return _Array(low) if array <= BITMAP_BYTES else _Bitmap(low)

    def select(self, k: int) -> int:
        c = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.keys[c]) << 16) + self.containers[c].select(k - int(self.before[c]))


def boundaries(text: str, unit: str = "line") -> BoundarySet:
    """0 and the end of every unit, in code points. A line is closed by its line feed; the last may lack one."""
    if unit == "char":
        return BoundarySet(np.arange(len(text) + 1))
    points = np.frombuffer(text.encode("ascii"), dtype=np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = np.flatnonzero(points == 10) + 1
    last = [len(text)] if len(text) and (not len(ends) or ends[-1] != len(text)) else []
    return BoundarySet(np.concatenate([[0], ends, last]).astype(np.int64))


def _drawn(doc_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit draws of a document: the first 8-digit groups of a SHA-256. A null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])


def transform(docs: DataFrame, unit: str = "line", fim_share: int = 100, spm_share: int = 50, seed: int = 7, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row: the text cut in three and put in another order.

    ``n`` counts the units. ``form`` is ``psm`` (marked prefix, suffix, middle), ``spm`` (marked suffix, prefix, middle) or ``plain`` (the text as it is): an empty or
    null text, one that contains a mark, and all but ``fim_share`` in a hundred. ``spm_share`` in a hundred of the others are ``spm``. Cuts and form depend on
    ``doc_id`` and ``seed`` alone, so rows that repeat an id and a text get the same output. Texts are taken whole, whatever their length; other columns are
    ignored, whatever their names; an empty table gives an empty result. No shuffle.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _drawn(F.col("doc_id"), seed).alias("h"))
    p, s, m = marks

    def one(text: str, h: list[int]) -> tuple:
        cuts = boundaries(text, unit)
        n = len(cuts) - 1
        if not text or any(x in text for x in marks) or h[2] % 100 >= fim_share:
            return n, "plain", None, None, text
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = cuts.select(low), cuts.select(high)
        if h[3] % 100 < spm_share:
            return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
        return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = zip(*map(one, part.column(1).to_pylist(), part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, type=t) for x, t in zip(out, types, strict=True)]], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from its transformed form. A text with a mark stays plain, so the three marks of the others are the only ones."""
    x = F.split(output, "|".join(rf"\Q{k}\E" for k in marks), -1)
    return F.when(form == "psm", F.concat(x[1], x[3], x[2])).when(form == "spm", F.concat(x[2], x[3], x[1])).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: units, form, lengths, digests of the transformed text and of the text restored from it. Nulls, ties and repeats as in ``transform``."""
    back = restored(F.col("output"), F.col("form"))
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
