"""Weights: caps, inverse volatility, two stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings


def capped(weights: DataFrame, keys: list[str], w: str = "w", cap: str = "cap") -> DataFrame:
    """Clips weights to caps and gives the excess to others in proportion to their room; one pass is enough, as the excess never exceeds all
    room. Caps that can't hold the total are an error; groups whose total isn't positive stay as they are."""
    over = Window.partitionBy(*keys)
    total = F.sum(w).over(over)
    excess = F.sum(F.greatest(F.col(w) - F.col(cap), F.lit(0.0))).over(over)
    room = F.greatest(F.col(cap) - F.col(w), F.lit(0.0))
    moved = F.least(F.col(w), F.col(cap)) + F.when(excess > 0, excess * room / F.nullif(F.sum(room).over(over), F.lit(0.0))).otherwise(0.0)
    small = F.sum(cap).over(over) < total - 1e-12
    return weights.withColumn(w, F.when(total <= 0, F.col(w)).when(small, F.raise_error(F.lit("infeasible caps: they add up to less than the weights")).cast("double")).otherwise(F.coalesce(moved, F.least(F.col(w), F.col(cap)))))


def _inverse(vol: str, keys: list[str]):
    over = Window.partitionBy(*keys)
    good = F.when(F.col(vol) > 0, F.col(vol))
    return F.coalesce(1 / F.coalesce(good, F.avg(good).over(over)), F.lit(1.0))


def equal_weight(train: DataFrame) -> DataFrame:
    return train.select("window_id", "asset").distinct().withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("window_id")))


def inverse_vol(train: DataFrame) -> DataFrame:
    vols = train.groupBy("window_id", "asset").agg(F.stddev_pop("r").alias("vol")).withColumn("inv", _inverse("vol", ["window_id"]))
    return vols.select("window_id", "asset", (F.col("inv") / F.sum("inv").over(Window.partitionBy("window_id"))).alias("w"))


def cluster_weights(train: DataFrame, clusters: DataFrame, s: Settings, method: str = "risk_parity", forecasts: DataFrame | None = None) -> DataFrame:
    """window_id, cluster, size, n, w: first stage, capped at size times an asset's cap. The tilt follows forecasts (window_id, cluster,
    expected_return), historical means without them; a cluster without a forecast counts as 0."""
    inside = train.join(clusters, [c for c in ("window_id", "asset") if c in clusters.columns])
    daily = inside.groupBy("window_id", "cluster", "dt").agg(F.avg("r").alias("r"), F.count("*").alias("size"))
    stats = daily.groupBy("window_id", "cluster").agg(F.stddev_pop("r").alias("vol"), F.avg("r").alias("mean"), F.max("size").alias("size"))
    if forecasts is not None:
        stats = stats.join(forecasts.select("window_id", "cluster", "expected_return"), ["window_id", "cluster"], "left").withColumn("mean", F.coalesce("expected_return", F.lit(0.0)))
    over = Window.partitionBy("window_id")
    if method not in ("equal", "risk_parity", "forecast_tilt"):
        raise ValueError(f"unknown first stage {method}")
    if method == "risk_parity":
        raw = _inverse("vol", ["window_id"])
    elif method == "forecast_tilt":
        spread = F.stddev_pop("mean").over(over)
        raw = F.greatest(F.lit(0.05), 1 + s.tilt * F.when(spread > 0, (F.col("mean") - F.avg("mean").over(over)) / spread).otherwise(0.0))
    else:
        raw = F.lit(1.0)
    stats = stats.withColumn("raw", raw).withColumn("w", F.col("raw") / F.sum("raw").over(over)).withColumn("n", F.sum("size").over(over))
    cap = F.greatest(F.lit(s.cap_floor), s.cap_factor / F.col("n"))
    return capped(stats.withColumn("cap", F.col("size") * cap), ["window_id"]).select("window_id", "cluster", "size", "n", "w")


def two_stage(train: DataFrame, clusters: DataFrame, s: Settings, method: str = "risk_parity", within: str = "inverse_vol", forecasts: DataFrame | None = None) -> DataFrame:
    """window_id, asset, w: clusters first, then assets within them."""
    if within not in ("equal", "inverse_vol"):
        raise ValueError(f"unknown second stage {within}")
    keys = [c for c in ("window_id", "asset") if c in clusters.columns]
    vols = train.groupBy("window_id", "asset").agg(F.stddev_pop("r").alias("vol")).join(clusters, keys)
    group = ["window_id", "cluster"]
    inv = _inverse("vol", group) if within == "inverse_vol" else F.lit(1.0)
    shares = vols.withColumn("inv", inv).withColumn("share", F.col("inv") / F.sum("inv").over(Window.partitionBy(*group)))
    first = cluster_weights(train, clusters, s, method, forecasts).withColumnRenamed("w", "cluster_w")
    both = shares.join(first, group).withColumn("w", F.col("share") * F.col("cluster_w")).withColumn("cap", F.greatest(F.lit(s.cap_floor), s.cap_factor / F.col("n")))
    out = capped(both, group)
    return out.select("window_id", "asset", (F.col("w") / F.sum("w").over(Window.partitionBy("window_id"))).alias("w"))
