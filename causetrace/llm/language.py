"""Language identification in two levels: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causetrace.llm.common import map_text

#: Families of languages by code. Others are families of their own, or if they are many, of languages with similar texts.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "is"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BITS = 13
#: Unlisted languages up to which each is a family of its own.
ALONE = 8


def has_letter(text: str | None) -> bool:
    """Whether a character is of a letter category; digits of any kind, such as fractions and circled or Roman ones, are not."""
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 2- and 3-grams of the lower-cased text: their numbers, and the square roots of their counts scaled to length 1."""
    b = np.frombuffer(b"  " + text.lower().encode() + b" ", dtype=np.uint8).astype(np.uint32)
    two = b[1:] * np.uint32(257) + b[:-1]
    three = two[1:] * np.uint32(65599) + b[:-2]
    mix = np.uint32(2654435761)
    n = np.bincount((two * mix) >> np.uint32(33 - BITS), minlength=1 << BITS)[: 1 << BITS].astype(np.float32)
    n += np.bincount((three * mix) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(n)
    v = np.sqrt(n[at])
    return at.astype(np.uint16), v / max(1e-9, float(np.linalg.norm(v)))


def features(texts: list[str]) -> np.ndarray:
    """One dense row for each text, plus 1."""
    out = np.zeros((len(texts), (1 << BITS) + 1), dtype=np.float32)
    for k, t in enumerate(texts):
        at, v = grams(t)
        out[k, at], out[k, -1] = v, 1
    return out


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 30.0, epochs: int = 40) -> np.ndarray:
    """Linear L2-loss support vector machine by dual coordinate descent over sparse rows; y is -1 or 1, the classes weigh the same."""
    n = len(y)
    cost = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y < 0).sum())))
    alpha, w = np.zeros(n), np.zeros((1 << BITS) + 1)
    q = np.array([float(v @ v) + 1 for _, v in rows]) + 0.5 / cost
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(n):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[-1]) - 1 + 0.5 / cost[i] * alpha[i]
            if alpha[i] == 0 and g >= 0:
                continue
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


@dataclass
class Model:
    families: dict[str, list[str]]
    between: dict[tuple[str, str], np.ndarray]
    within: dict[tuple[str, str], np.ndarray]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [has_letter(t) for t in texts]
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        at = [i for i, k in enumerate(known) if k]
        if not at or not self.families:
            return out
        x = features([texts[i] for i in at])
        family, sure = self._vote(x, sorted(self.families), self.between)
        for f in sorted(set(family)):
            rows = [i for i, g in enumerate(family) if g == f]
            lang, margin = self._vote(x[rows], self.families[f], self.within)
            for i, code, m in zip(rows, lang, margin, strict=True):
                out[at[i]] = (code, float(min(sure[i], m)))
        return out

    @staticmethod
    def _vote(x: np.ndarray, names: list[str], machines: dict) -> tuple[list[str], np.ndarray]:
        """One-versus-one: most votes win, sums of margins break ties; sureness is that of the winner's closest duel."""
        if len(names) == 1:
            return names * len(x), np.ones(len(x))
        votes, weakest = np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
        for a, b in combinations(range(len(names)), 2):
            m = x @ machines[names[a], names[b]]
            for k, s in ((a, m), (b, -m)):
                votes[:, k] += (s > 0) + 1e-3 * np.tanh(s)
                weakest[:, k] = np.minimum(weakest[:, k], s)
        win = votes.argmax(axis=1)
        return [names[k] for k in win], 1 / (1 + np.exp(-2 * np.clip(weakest[np.arange(len(x)), win], -15, 15)))


def grouped(codes: list[str], x: list[tuple], lang: np.ndarray) -> dict[str, str]:
    """A family for each of the unlisted ``codes``: its own while they are few, else about as many families as each has members, of languages whose mean texts are near.

    So the machines grow with the number of languages to the power of 1.5, not with its square.
    """
    if len(codes) <= ALONE:
        return {c: f"only {c}" for c in codes}
    means = np.zeros((len(codes), 1 << BITS), dtype=np.float32)
    for k, c in enumerate(codes):
        for i in np.flatnonzero(lang == c):
            means[k, x[i][0]] += x[i][1]
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    near = means @ means.T
    size, left, out = math.ceil(math.sqrt(len(codes))), list(range(len(codes))), {}
    while left:  # the language least like the others, with those most like it
        seed = min(left, key=lambda k: (float(near[k, left].sum()), k))
        members = sorted(left, key=lambda k: (k != seed, -float(near[seed, k]), k))[:size]
        out |= {codes[k]: f"like {codes[seed]}" for k in members}
        left = [k for k in left if k not in members]
    return out


def train(rows: list[tuple[str, str]]) -> Model:
    """Family machines and, in each family, one machine for every pair of its languages."""
    rows = [(t, lang) for t, lang in rows if has_letter(t)]
    langs = sorted({lang for _, lang in rows})
    x, lang = [grams(t) for t, _ in rows], np.array([c for _, c in rows])
    family_of = {c: FAMILY_OF[c] for c in langs if c in FAMILY_OF} | grouped([c for c in langs if c not in FAMILY_OF], x, lang)
    families: dict[str, list[str]] = {}
    for code in langs:
        families.setdefault(family_of[code], []).append(code)
    family = np.array([family_of[c] for _, c in rows])

    def duel(of: np.ndarray, a: str, b: str) -> np.ndarray:
        at = np.flatnonzero((of == a) | (of == b))
        return svm([x[i] for i in at], np.where(of[at] == a, 1.0, -1.0)).astype(np.float32)

    return Model(
        families,
        {(a, b): duel(family, a, b) for a, b in combinations(sorted(families), 2)},
        {(a, b): duel(lang, a, b) for f in families.values() for a, b in combinations(f, 2)},
    )


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, per_language: int = 500, most_texts: int = 20_000, most_chars: int = 30_000_000, longest: int = 100_000, most_languages: int = 400) -> Model:
    """Train on a bounded sample outside the held-out fold, in hash order of doc_id: at most ``per_language`` texts of each non-null language,
    fewer if ``most_texts`` or ``most_chars`` would be passed in all; whole texts of at most ``longest`` characters, of rows with a doc_id.

    Every language is learned; more than ``most_languages`` are an error, as the model (130 MB then) goes to every worker. The sample and its sparse rows (about 10 KB a text) are all that reaches
    the driver. Ids are first thinned by their hash, at a rate that follows from the language's count, so that a common language costs no task more than
    a few times its sample. Rows that repeat an id and a text count once; the sample doesn't depend on how the table is stored.
    """
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and doc_id is not null").where(F.length("text") <= longest).where(~held_out())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    counts = {r["lang"]: r["__n"] for r in sizes.limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError("too many languages")
    quota, room = min(per_language, most_texts // max(1, len(counts))), most_chars // max(1, len(counts))
    share = docs.sparkSession.createDataFrame([(c, 1.0 if n <= 8 * quota else 8 * quota / n) for c, n in counts.items()], "lang string, __share double")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    thin = rows.select("doc_id", "lang", F.xxhash64("text").alias("__t"), F.length("text").alias("__len"), at.alias("__at")).join(F.broadcast(share), "lang").where(F.col("__at") < F.col("__share") * (1 << 40))
    order = Window.partitionBy("lang").orderBy("__at", "doc_id", "__t")
    placed = thin.drop("__share").distinct().select("doc_id", "lang", "__t", F.row_number().over(order).alias("__k"), F.sum("__len").over(order).alias("__sum"))
    ids = placed.where((F.col("__k") <= quota) & ((F.col("__sum") <= room) | (F.col("__k") == 1))).select("doc_id", "lang", "__t")
    found = rows.withColumn("__t", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "lang", "__t"]).groupBy("doc_id", "lang", "__t").agg(F.first("text").alias("text"))
    sample = sorted((r["lang"], str(r["doc_id"]), r["text"]) for r in found.toLocalIterator())
    return train([(t, code) for code, _, t in sample])


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0 to 1). A null text or one without a letter is ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def f(texts: list) -> dict[str, list]:
            got = model.predict(texts)
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return f

    return map_text(docs, make, "lang_pred string, score double", keep=keep)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, repeated ones too; a null doc_id is neither held out nor learned from."""
    return predict(docs, fit(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
