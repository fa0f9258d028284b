"""Walk-forward results and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings


def turnover(weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, window_id, turnover: sum of changes of target weights, for each of keys by itself. Before the first window all weights are 0,
    and an asset without a row in a window has weight 0 there, so that leaving and coming back both cost."""
    by = [*keys, "window_id"]
    grid = weights.select(*by).distinct().crossJoin(F.broadcast(weights.select("asset").distinct()))
    full = grid.join(weights.select(*by, "asset", "w"), [*by, "asset"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    last = F.lag("w", 1, 0.0).over(Window.partitionBy(*keys, "asset").orderBy("window_id"))
    return full.withColumn("move", F.abs(F.col("w") - last)).groupBy(*by).agg(F.sum("move").alias("turnover"))


def gross_returns(forward: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return forward.join(weights, ["window_id", "asset"]).groupBy(*keys, "window_id", "dt").agg(F.sum(F.col("r") * F.col("w")).alias("r"))


def net_returns(gross: DataFrame, turn: DataFrame, bps, keys: tuple[str, ...] = ()) -> DataFrame:
    """The cost of a rebalance falls on the first day of its period; a window without a turnover costs nothing."""
    by = [*keys, "window_id"]
    first = F.row_number().over(Window.partitionBy(*by).orderBy("dt")) == 1
    cost = F.when(F.col("first"), F.coalesce("turnover", F.lit(0.0)) * F.lit(bps) / 1e4).otherwise(0.0)
    return gross.withColumn("first", first).join(turn, by, "left").select(*by, "dt", (F.col("r") - cost).alias("r"))


def drawdown(net: DataFrame, keys: list[str]) -> DataFrame:
    up_to = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    grown = net.withColumn("cum", F.product(1 + F.col("r")).over(up_to))
    return grown.withColumn("drawdown", F.col("cum") / F.max("cum").over(up_to) - 1)


def metrics(net: DataFrame, s: Settings, keys: list[str]) -> DataFrame:
    year = float(s.periods)
    sd = F.stddev_pop("r")
    return drawdown(net, keys).groupBy(*keys).agg(
        (F.pow(F.product(1 + F.col("r")), year / F.count("r")) - 1).alias("ann_return"),
        (sd * year**0.5).alias("ann_vol"),
        F.when(sd > 1e-12, F.avg("r") / sd * year**0.5).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
    )
