"""Walk-forward windows by arithmetic on positions: no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings


def schedule(returns: DataFrame, s: Settings) -> DataFrame:
    """window_id, i: offsets train, train + hold, ... of full holding periods."""
    n = returns.agg((F.max("pos") + 1).alias("n")).where(F.col("n") >= s.train + s.hold)
    return n.select(F.posexplode(F.sequence(F.lit(s.train).cast("int"), (F.col("n") - s.hold).cast("int"), F.lit(s.hold))).alias("window_id", "i"))


def _count(returns: DataFrame, s: Settings) -> DataFrame:
    return F.broadcast(returns.agg(F.floor((F.max("pos") + 1 - s.train) / s.hold).cast("int").alias("windows")))


def train_rows(returns: DataFrame, s: Settings) -> DataFrame:
    """Each row once for each window that trains on it."""
    low = F.greatest(F.lit(0), F.floor((F.col("pos") - s.train) / s.hold) + 1)
    high = F.least(F.floor(F.col("pos") / s.hold), F.col("windows") - 1)
    return returns.join(_count(returns, s)).where(low <= high).withColumn("window_id", F.explode(F.sequence(low.cast("int"), high.cast("int")))).drop("windows")


def forward_rows(returns: DataFrame, s: Settings) -> DataFrame:
    """Each row in the window that holds over it."""
    k = F.floor((F.col("pos") - s.train) / s.hold).cast("int")
    return returns.join(_count(returns, s)).withColumn("window_id", k).where((k >= 0) & (k < F.col("windows"))).drop("windows")
