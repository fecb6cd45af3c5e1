"""Mergeable moments of windows: count, mean and scatter matrix that add up across tasks, buckets of time and days (behind D1, D20)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the greatest eigenvalue under which a direction is noise of the arithmetic.
NOISE = 1e-12
STATE = "n bigint, mean array<double>, scatter array<double>"


def merged(n: np.ndarray, mean: np.ndarray, scatter: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """One state from several (index 0): the scatter within them and that between their means."""
    total = int(n.sum())
    centre = n @ mean / total
    off = mean - centre
    return total, centre, scatter.sum(axis=0) + (off * n[:, None]).T @ off


def _states(keys: list[str], pdf: pd.DataFrame, rows: bool) -> pd.DataFrame:
    """A state for each key of ``pdf``: of rows ``x``, or of states."""
    out = []
    for key, part in pdf.groupby(keys, sort=False, dropna=False):
        if rows:
            x = np.vstack(part["x"].to_list())
            mean = x.mean(axis=0)
            n, scatter = len(x), (x - mean).T @ (x - mean)
        else:
            p = len(part["mean"].iloc[0])
            n, mean, scatter = merged(part["n"].to_numpy(), np.vstack(part["mean"].to_list()), np.stack([s.reshape(p, p) for s in part["scatter"]]))
        out.append((*key, n, mean, scatter.ravel()))
    return pd.DataFrame(out, columns=[*keys, "n", "mean", "scatter"])


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), STATE])


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, n, mean, scatter``: the states of equal keys added up."""
    kept = states.select(*keys, "n", "mean", "scatter")
    return kept.groupBy(*keys).applyInPandas(lambda pdf: _states(keys, pdf, rows=False), _schema(kept, keys))


def moment_states(windows: DataFrame, *by: str, bucket: Column | None = None) -> DataFrame:
    """``*by, bucket, n, mean, scatter`` of ``windows(*by, x)``, a state for each ``bucket`` (a column of the windows, such as the day they begin), else one.

    Each task adds up the windows it has, a batch at a time; only states are shuffled. States of later days are appended to those
    that are kept, and never change.
    """
    keys = [*by, "bucket"]
    rows = windows.select(*by, (bucket if bucket is not None else F.lit(None).cast("timestamp_ntz")).alias("bucket"), "x")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield _states(keys, pdf, rows=True)

    return merge_states(rows.mapInPandas(run, _schema(rows, keys)), keys)


def components(n: int, mean: np.ndarray, scatter: np.ndarray, latent: int) -> np.ndarray:
    """Main directions of the scatter, at most ``latent``, none that the rows don't span."""
    values, vectors = np.linalg.eigh(scatter)
    order = np.argsort(values)[::-1][: min(latent, len(mean) - 1, max(n - 1, 0))]
    return vectors[:, order[values[order] > NOISE * max(values.max(), 1e-300)]].T


def models(states: DataFrame, latent: int, scale: DataFrame | None = None) -> DataFrame:
    """``entity, mean, components`` from the states of each entity, added up.

    With ``scale(entity, lo, width)``, arrays as long as ``mean``, the model is that of (x - lo) / width: an affine map of the windows is one of their moments.
    """
    total = merge_states(states, ["entity"])
    scaled = scale is not None
    if scaled:
        total = total.join(scale, "entity")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                mean, scatter = np.asarray(row.mean), np.asarray(row.scatter).reshape(len(row.mean), -1)
                if scaled:
                    lo, width = np.asarray(row.lo), np.asarray(row.width)
                    mean, scatter = (mean - lo) / width, scatter / np.outer(width, width)
                out.append((row.entity, mean, list(components(row.n, mean, scatter, latent))))
            yield pd.DataFrame(out, columns=["entity", "mean", "components"])

    return total.mapInPandas(run, f"entity {total.schema['entity'].dataType.simpleString()}, mean array<double>, components array<array<double>>")
