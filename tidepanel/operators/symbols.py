"""Returns as codes 0 to 4 by quantile edges of a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from .returns import market_neutral


def edges(train: DataFrame, s: Settings, scope: str = "per_stock") -> DataFrame:
    if scope not in ("per_stock", "pooled"):
        raise ValueError(f"unknown scope {scope}")
    keys = ["window_id", "asset"] if scope == "per_stock" else ["window_id"]
    return train.groupBy(*keys).agg(F.percentile("r", F.array(*map(F.lit, s.cutoffs))).alias("edges"))


def symbolize(train: DataFrame, s: Settings, scope: str = "per_stock", neutral: bool = False) -> DataFrame:
    """window_id, asset, pos, code: how many edges a return reaches; 2 where all edges are equal; null stays null."""
    if neutral:
        train = market_neutral(train, ("window_id", "dt"))
    cut = edges(train, s, scope)
    keys = [c for c in cut.columns if c != "edges"]
    reached = F.size(F.filter("edges", lambda e: F.col("r") >= e))
    flat = F.array_min("edges") == F.array_max("edges")
    return train.join(cut, keys).select("window_id", "asset", "pos", F.when(F.col("r").isNotNull(), F.when(flat, 2).otherwise(reached)).cast("int").alias("code"))
