"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text, compared window by window."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causetrace.llm.common import fresh, map_text, stage, unstage

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Words of a window.
WINDOW_WORDS = 16
#: Bytes of each trained dictionary; of the ordinary text behind both (together within the compressor's chain of 2 MB); and of the samples that the dictionary builder gets.
DICTIONARY, BACKGROUND, SAMPLE = 32 << 10, (2 << 20) - (128 << 10), 400
#: Folds of the labelled texts: each is measured with dictionaries made from the others.
FOLDS = 3
#: The dictionary builder's segment and d-mer lengths: runs of 8 bytes that recur in many samples, in segments of 16.
SEGMENT, DMER = 16, 8


def windows(text: str | None) -> list[bytes]:
    """The windows of a text: ``WINDOW_WORDS`` lower-cased words each, the last one shorter; without words there is none."""
    words = WORD.findall((text or "").lower().encode())
    return [b" %b " % b" ".join(words[i : i + WINDOW_WORDS]) for i in range(0, len(words), WINDOW_WORDS)]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    background: bytes
    least_gain: int
    weights: list[float]

    def measure(self):
        """text -> by how many bytes the toxic dictionary compresses each window better than the ordinary one."""
        toxic, ordinary = (_compressor(d + self.background) for d in (self.toxic, self.ordinary))
        return lambda text: [len(ordinary(w)) - len(toxic(w)) for w in windows(text)]

    def scorer(self):
        gains = self.measure()

        def score(text: str | None) -> float:
            z = sum(w * v for w, v in zip(self.weights, features(gains(text), self.least_gain), strict=True))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _compressor(content: bytes):
    import zstandard as zs

    p = zs.ZstdCompressionParameters.from_level(
        19, write_content_size=False, write_checksum=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS,
        window_log=23, hash_log=21, chain_log=21, min_match=6, strategy=zs.STRATEGY_GREEDY, search_log=5, target_length=32,
    )
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p).compress


def _dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary trained on whole texts, cut into samples; texts too few to train on are taken as they are."""
    import zstandard as zs

    joined = [b"".join(windows(t)) for t in texts]
    samples = [t[i : i + SAMPLE] for t in joined for i in range(0, len(t), SAMPLE)]
    try:
        return zs.train_dictionary(DICTIONARY, samples, k=SEGMENT, d=DMER).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[:DICTIONARY]


def features(gains: list[int], least: int) -> list[float]:
    """Intercept; log of how many windows gain ``least`` bytes or more, and of how many lose as much; shares of both; log of the greatest gain; mean gain."""
    n, hits, losses = max(len(gains), 1), sum(g >= least for g in gains), sum(g <= -least for g in gains)
    return [1.0, math.log1p(hits), math.log1p(losses), 10 * hits / n, 10 * losses / n, math.log1p(max([0, *gains])), max(-5.0, min(5.0, sum(gains) / n))]


def _made(parts: list[list[str]]) -> Model:
    """A model without weights: a dictionary of each class, and ordinary text that stands, the same, behind both, so that what is common costs both alike."""
    made = [_dictionary(x) for x in parts]
    size, background = min(map(len, made)), b"".join(w for t in parts[0] for w in windows(t))[:BACKGROUND]
    return Model(made[1][-size:], made[0][-size:], background, 1, [])


def train(rows: list[tuple[str, int]]) -> Model:
    """Dictionaries, the threshold on a window's gain, and weights, from labelled texts.

    All texts of a class train its dictionary. What calibrates are the gains that a text has with dictionaries made without it, in ``FOLDS`` folds: the threshold that best separates
    them, and a logistic regression, in which the classes weigh the same, from the gains of a text to its score. Distinct texts count once.
    """
    of = [sorted({t for t, y in rows if y == k}, key=hash_of) for k in (0, 1)]
    if not of[0] or not of[1]:  # nothing to tell apart
        return Model(b" ", b" ", b" ", 1, [-3.0 if of[0] else 3.0 if of[1] else 0.0, 0, 0, 0, 0, 0, 0])
    gains: list[list] = [[], []]
    for f in range(FOLDS):
        # a class of one text has no text left without it
        measure = _made([[t for i, t in enumerate(x) if i % FOLDS != f] or x for x in of]).measure()
        for k in (0, 1):
            gains[k] += [measure(t) for i, t in enumerate(of[k]) if i % FOLDS == f]
    y = np.repeat([0.0, 1.0], [len(g) for g in gains])
    each, best = np.where(y == 1, 0.5 / len(gains[1]), 0.5 / len(gains[0])), None
    for least in range(1, 9):
        x = np.array([features(w, least) for k in (0, 1) for w in gains[k]])
        weights = _logistic(x, y, each)
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        loss = -(np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-9)) * each).sum()
        if best is None or loss < best[0]:
            best = (loss, least, weights.tolist())
    model = _made(of)
    return Model(model.toxic, model.ordinary, model.background, best[1], best[2])


def hash_of(text: str) -> bytes:
    """Order of the training texts that has nothing to do with their place in the table."""
    return hashlib.blake2b(text.encode(), digest_size=8).digest()


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the classes weigh the same."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (3000, 1500), max_chars: int = 10_000_000, longest: int = 100_000) -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out fold.

    The sample takes, in the order of a hash of doc_id, at most ``per_class`` ordinary and toxic texts, whole texts of at most ``longest`` characters, and passes over those with which
    a class would exceed ``max_chars`` characters. Rows with a null text or label are not used; of rows that repeat an id, the text that sorts first is, with the larger label.
    """
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__y")).where(~held_out())
    at = F.xxhash64("doc_id").alias("__at")
    ids = None
    for k in (0, 1):
        some = y.where(F.col("__y") == k).select("doc_id", "__y", at).orderBy("__at", "doc_id").limit(per_class[k])
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.select("doc_id", "text").where("text is not null").where(F.length("text") <= longest)
    rows = stage(texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "__y", "__at").agg(F.min("text").alias("text")), "labelled")
    room, wanted = [max_chars, max_chars], []
    for r in sorted(rows.select("__at", "doc_id", "__y", F.length("text").alias("n")).collect()):
        if r["n"] <= room[r["__y"]]:
            room[r["__y"]] -= r["n"]
            wanted.append((r["doc_id"],))
    chosen = []
    if wanted:
        kept = docs.sparkSession.createDataFrame(wanted, rows.select("doc_id").schema)
        chosen = [(r["text"], r["__y"]) for r in rows.join(F.broadcast(kept), "doc_id").toLocalIterator()]
    unstage(rows)
    return train(chosen)


def scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5) for every whole text; null counts as empty."""

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = shared.value.scorer()

        def f(texts: list) -> dict[str, list]:
            s = [score(t) for t in texts]
            return {"score": s, "predicted": [int(v >= 0.5) for v in s]}

        return f

    return map_text(docs, make, "score double, predicted int", keep=keep)


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``least`` (a filter loses few ordinary texts at 0.7), all columns as they were. A null or empty text has no window and stays
    unless nearly all training texts were toxic; repeated rows get the same score and stay or go together; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    toxic = fresh(docs, "__toxic")

    def make():
        score = shared.value.scorer()
        return lambda texts: {toxic: [score(t) >= least for t in texts]}

    return map_text(docs, make, f"{toxic} boolean", keep=tuple(docs.columns)).where(~F.col(toxic)).drop(toxic)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, repeated ones too; a null doc_id is not held out, a null text counts as empty."""
    return scores(docs, fit(docs, labels)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
