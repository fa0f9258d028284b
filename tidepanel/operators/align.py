"""Banded global alignment of code strings with affine gaps, in steps over rows for many pairs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.panel import spread

_LOW = -1e18


def banded_scores(a: np.ndarray, b: np.ndarray, s: Settings, band: int | None = None) -> np.ndarray:
    """Scores of a[k] against b[k], all of one length. Cell (i, j) is column j - i + band; a row's horizontal gaps are a running maximum."""
    band = s.band if band is None else band
    pairs, n = a.shape
    width = 2 * band + 1
    cost = s.gap_extend * np.arange(width)
    diag = np.full((pairs, width + 1), _LOW)  # one more column: beyond the band
    up, side = diag.copy(), diag.copy()
    diag[:, band] = 0.0
    for j in range(1, min(band, n) + 1):
        side[:, band + j] = s.gap_open + s.gap_extend * j
    padded = np.full((pairs, n + 2 * band + 1), -99.0)
    padded[:, band + 1 : band + 1 + n] = b
    for i in range(1, n + 1):
        best = np.maximum(np.maximum(diag, up), side)[:, :width]
        letters = padded[:, i : i + width]
        gap = np.abs(letters - a[:, i - 1 : i])
        score = np.where(gap == 0, s.match, -gap)
        inside = (np.arange(width) - band + i >= 1) & (np.arange(width) - band + i <= n)
        new = np.where(inside, best + score, _LOW)
        rise = np.maximum(diag[:, 1:] + s.gap_open, up[:, 1:]) + s.gap_extend
        edge = np.arange(width) - band + i == 0
        rise = np.where(edge, s.gap_open + s.gap_extend * i if i <= band else _LOW, np.where(inside, rise, _LOW))
        reach = np.maximum.accumulate(new - cost, axis=1)
        flat = np.full((pairs, width), _LOW)
        flat[:, 1:] = np.where(inside[1:], reach[:, :-1] + s.gap_open + cost[1:], _LOW)
        diag[:, :width], up[:, :width], side[:, :width] = new, rise, flat
    return np.maximum(np.maximum(diag, up), side)[:, band]


def local_scores(a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """Best local scores of a[k] against b[k], without a band; gaps too restart at 0. A row's horizontal gaps are a running maximum."""
    pairs, n = a.shape
    m = b.shape[1]
    cost = s.gap_extend * np.arange(m + 1)
    diag, up, side = (np.zeros((pairs, m + 1)) for _ in range(3))
    best = np.zeros(pairs)
    for i in range(n):
        gap = np.abs(b - a[:, i : i + 1])
        new = np.zeros((pairs, m + 1))
        new[:, 1:] = np.maximum(0, np.maximum(np.maximum(diag, up), side)[:, :-1] + np.where(gap == 0, s.match, -gap))
        up = np.maximum(0, np.maximum(diag + s.gap_open, up) + s.gap_extend)
        side = np.zeros((pairs, m + 1))
        side[:, 1:] = np.maximum(0, np.maximum.accumulate(new - cost, axis=1)[:, :-1] + s.gap_open + cost[1:])
        diag = new
        best = np.maximum(best, np.maximum(np.maximum(diag, up), side).max(1))
    return best


def codes(symbols: DataFrame, keys: tuple[str, ...] = ("window_id",)) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])
    return symbols.groupBy(*keys, "asset").agg(ordered.alias("codes"))


def pair_distances(strings: DataFrame, s: Settings, keys: tuple[str, ...] = ("window_id",), band: int | None = None, local: bool = False) -> DataFrame:
    """keys, a, b, score, d for a < b: d = max(0, 1 - score / (match * length)), as a string scores match * length against itself."""
    left = strings.select(*keys, F.col("asset").alias("a"), F.col("codes").alias("x"))
    right = strings.select(*keys, F.col("asset").alias("b"), F.col("codes").alias("y"))
    pairs = left.join(right, list(keys)).where("a < b")
    scores = local_scores if local else lambda x, y, s: banded_scores(x, y, s, band)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["x"].map(len)
            score = np.empty(len(pdf))
            for n in lengths.unique():
                at = np.flatnonzero(lengths == n)
                score[at] = scores(np.stack(pdf["x"].iloc[at]).astype(float), np.stack(pdf["y"].iloc[at]).astype(float), s)
            out = pdf.drop(columns=["x", "y"])
            out["score"] = score
            out["d"] = np.maximum(0, 1 - score / (s.match * lengths.to_numpy()))
            yield out

    kinds = ", ".join(f"{k} {strings.schema[k].dataType.simpleString()}" for k in (*keys,))
    kind = strings.schema["asset"].dataType.simpleString()
    return spread(pairs, *keys, "a", "b").mapInPandas(run, f"{kinds}, a {kind}, b {kind}, score double, d double")
