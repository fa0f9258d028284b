"""Returns, common days and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def simple_returns(prices: DataFrame, fill: str = "drop") -> DataFrame:
    """asset, dt, r over the grid of all days and assets, without the first day. A gap makes two returns null; with fill="pad" the last price stands in."""
    grid = prices.select("dt").distinct().crossJoin(F.broadcast(prices.select("asset").distinct())).join(prices, ["asset", "dt"], "left")
    by = Window.partitionBy("asset").orderBy("dt")
    if fill == "pad":
        grid = grid.withColumn("price", F.last("price", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return grid.select("asset", "dt", (F.col("price") / F.lag("price").over(by) - 1).alias("r"), F.row_number().over(by).alias("row")).where("row > 1").drop("row")


def common_days(returns: DataFrame) -> DataFrame:
    """asset, dt, pos, r on days when every asset has a return; pos counts those days from 0."""
    assets = returns.select("asset").distinct().agg(F.count("*").alias("assets"))
    days = returns.groupBy("dt").agg(F.count("r").alias("have")).join(F.broadcast(assets)).where("have = assets").select("dt", (F.row_number().over(Window.orderBy("dt")) - 1).alias("pos"))
    return returns.join(F.broadcast(days), "dt").select("asset", "dt", "pos", "r")


def time_split(returns: DataFrame, fraction: float = 0.7) -> DataFrame:
    n = returns.agg((F.max("pos") + 1).alias("n"))
    return returns.join(F.broadcast(n)).withColumn("part", F.when(F.col("pos") < F.floor(F.col("n") * fraction), "tune").otherwise("report")).drop("n")


def market_neutral(returns: DataFrame, keys: tuple[str, ...] = ("dt",)) -> DataFrame:
    return returns.withColumn("r", F.col("r") - F.avg("r").over(Window.partitionBy(*keys)))
