"""Walk-forward studies: methods of allocation on the same windows, their results, intervals and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from . import align, alloc, engine, grouping, inference, optimise, outlook, symbols

METHODS = ("alignment", "equal_weight", "inverse_vol", "sector", "correlation", "random", "min_variance", "mean_variance")


def correlation_pairs(train: DataFrame) -> DataFrame:
    """window_id, a, b, d: one less the correlation."""
    a = train.select("window_id", "pos", F.col("asset").alias("a"), F.col("r").alias("x"))
    b = train.select("window_id", "pos", F.col("asset").alias("b"), F.col("r").alias("y"))
    return a.join(b, ["window_id", "pos"]).where("a < b").groupBy("window_id", "a", "b").agg((1 - F.corr("x", "y")).alias("d"))


def strings(train: DataFrame, s: Settings, **how) -> DataFrame:
    return align.codes(symbols.symbolize(train, s, **how))


def alignment_clusters(train: DataFrame, s: Settings, **how) -> DataFrame:
    return grouping.clusters(align.pair_distances(strings(train, s, **how), s), s).select("window_id", "asset", "cluster")


def gated_weights(train: DataFrame, clusters: DataFrame, gate: DataFrame, s: Settings, allocator: str = "risk_parity", within: str = "inverse_vol", model: str = "arima") -> DataFrame:
    """window_id, asset, w, gate_passed: two stages on the clusters, with forecasts of their composites where the allocator tilts, and
    equal weights in windows whose gate failed. A window without a gate counts as failed."""
    ahead = outlook.forecasts(outlook.composites(train, clusters), s.hold, model=model) if allocator == "forecast_tilt" else None
    two = alloc.two_stage(train, clusters, s, allocator, within, ahead).withColumnRenamed("w", "two")
    equal = alloc.equal_weight(train)
    both = equal.join(two, ["window_id", "asset"], "left").join(gate.select("window_id", "passed"), "window_id", "left")
    passed = F.coalesce("passed", F.lit(False))
    return both.select("window_id", "asset", F.when(passed, F.coalesce("two", F.lit(0.0))).otherwise(F.col("w")).alias("w"), passed.alias("gate_passed"))


def method_weights(train: DataFrame, sectors: DataFrame, s: Settings, method: str, draws: int = 1000, allocator: str = "risk_parity", gate: DataFrame | None = None, aligned: DataFrame | None = None) -> DataFrame:
    """window_id, asset, w, gate_passed (null but for "alignment") of one of METHODS in every window. A gate and clusters by alignment that
    are known already may be given."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; there are {', '.join(METHODS)}")
    if method in ("alignment", "random") and aligned is None:
        aligned = alignment_clusters(train, s)
    if method == "alignment":
        gate = inference.null_gate(strings(train, s), s, draws) if gate is None else gate
        return gated_weights(train, aligned, gate, s, allocator)
    if method == "equal_weight":
        w = alloc.equal_weight(train)
    elif method == "inverse_vol":
        w = alloc.inverse_vol(train)
    elif method == "sector":
        w = alloc.two_stage(train, sectors, s, allocator)
    elif method == "correlation":
        w = alloc.two_stage(train, grouping.clusters(correlation_pairs(train), s).select("window_id", "asset", "cluster"), s, allocator)
    elif method == "random":
        sizes = aligned.groupBy("window_id", "cluster").agg(F.count("*").alias("size"))
        w = alloc.two_stage(train, grouping.shuffled_clusters(train, sizes), s, allocator)
    else:
        w = optimise.optimised(train, s, *((0.5, True) if method == "mean_variance" else ()))
    return w.select("window_id", "asset", "w", F.lit(None).cast("boolean").alias("gate_passed"))


def weights_of(train: DataFrame, sectors: DataFrame, s: Settings, methods: tuple[str, ...], **how) -> DataFrame:
    """method, window_id, asset, w, gate_passed, in one table for all methods."""
    out = None
    for m in methods:
        one = method_weights(train, sectors, s, m, **how).withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def run(forward: DataFrame, weights: DataFrame, s: Settings, keys: tuple[str, ...] = ("method",), bps: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Daily returns net of costs (keys, window_id, dt, r), and rebalances (keys, window_id, turnover, gate_passed), one plan for all keys.
    Weights are read twice: materialise them where they are dear."""
    turn = engine.turnover(weights, keys)
    passed = weights.groupBy(*keys, "window_id").agg(F.bool_and("gate_passed").alias("gate_passed"))
    net = engine.net_returns(engine.gross_returns(forward, weights, keys), turn, s.cost_bps if bps is None else bps, keys)
    return net, turn.join(passed, [*keys, "window_id"])


def table(net: DataFrame, rebalances: DataFrame, s: Settings, keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """Metrics with avg_turnover and, where there is a gate, the share of windows that passed."""
    more = rebalances.groupBy(*keys).agg(F.avg("turnover").alias("avg_turnover"), F.avg(F.col("gate_passed").cast("int")).alias("gate_pass_fraction"))
    return engine.metrics(net, s, list(keys)).join(more, list(keys))


def passed_view(net: DataFrame, rebalances: DataFrame, s: Settings, reference: str = "alignment") -> DataFrame:
    """The table of all methods on the windows in which the reference's gate passed; empty if it never did."""
    keep = rebalances.where((F.col("method") == reference) & F.col("gate_passed")).select("window_id")
    only = lambda df: df.join(F.broadcast(keep), "window_id", "left_semi")
    return table(only(net), only(rebalances), s).drop("gate_pass_fraction")


def paired(net: DataFrame, method: str, key: str = "method") -> DataFrame:
    """baseline, pos, x, y: daily returns of a method beside those of every other one, on their common days."""
    x = net.where(F.col(key) == method).select("dt", F.col("r").alias("x"))
    both = net.where(F.col(key) != method).select(F.col(key).alias("baseline"), "dt", F.col("r").alias("y")).join(F.broadcast(x), "dt")
    return both.select("baseline", (F.row_number().over(Window.partitionBy("baseline").orderBy("dt")) - 1).alias("pos"), "x", "y")


def intervals(net: DataFrame, method: str, s: Settings, resamples: int = 5000, block: int = 20, by_dependence: bool = False, key: str = "method") -> DataFrame:
    """baseline, stat, lo, hi of a method against every other one."""
    return inference.bootstrap_intervals(paired(net, method, key), s, resamples, block, keys=("baseline",), by_dependence=by_dependence)


def verdicts(found: DataFrame) -> DataFrame:
    """baseline, lo, hi, verdict of the difference of Sharpe ratios: supported above 0, failed below, else not supported."""
    word = F.when((F.col("lo") > 0) & (F.col("hi") > 0), "supported").when(F.col("hi") < 0, "failed").otherwise("not supported")
    return found.where("stat = 'sharpe_diff'").select("baseline", "lo", "hi", word.alias("verdict"))


def allocators(train: DataFrame, clusters: DataFrame, gate: DataFrame, s: Settings) -> DataFrame:
    """variant, window_id, asset, w, gate_passed: every pair of stages on one gated clustering."""
    out = None
    for first in ("equal", "risk_parity", "forecast_tilt"):
        for within in ("equal", "inverse_vol"):
            one = gated_weights(train, clusters, gate, s, first, within).withColumn("variant", F.lit(f"{first}/{within}"))
            out = one if out is None else out.unionByName(one)
    return out


#: Ways to make symbols, by name, with parameters of `symbolize` and other cutoffs.
SYMBOLS = {
    "per_stock": {}, "pooled": {"scope": "pooled"}, "per_stock_neutral": {"neutral": True}, "pooled_neutral": {"scope": "pooled", "neutral": True},
    "wide": {"cutoffs": (0.15, 0.35, 0.65, 0.85)}, "wide_neutral": {"cutoffs": (0.15, 0.35, 0.65, 0.85), "neutral": True},
}


def symbol_variants(train: DataFrame, s: Settings, variants=SYMBOLS) -> DataFrame:
    """variant, window_id, asset, cluster: ungated clusters for each way to make symbols."""
    from dataclasses import replace

    out = None
    for name, how in variants.items():
        rest = {k: v for k, v in how.items() if k != "cutoffs"}
        one = alignment_clusters(train, replace(s, cutoffs=how.get("cutoffs", s.cutoffs)), **rest).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def mean_agreement(variants: DataFrame, baseline: str = "per_stock") -> DataFrame:
    """variant, ari: agreement with the baseline's clusters, mean over windows."""
    base = variants.where(F.col("variant") == baseline).select("window_id", "asset", "cluster")
    keyed = lambda df: df.withColumn("at", F.concat_ws(":", "variant", "window_id"))
    names = variants.select("variant").distinct()
    each = grouping.rand_index(keyed(variants), keyed(base.crossJoin(F.broadcast(names))), "at")
    return each.groupBy(F.regexp_extract("at", "^(.*):", 1).alias("variant")).agg(F.avg("ari").alias("ari"))


def variant_weights(train: DataFrame, variants: DataFrame, s: Settings) -> DataFrame:
    """variant, window_id, asset, w, gate_passed (null): two stages on each variant's clusters, and equal weights as a variant. Windows of
    all variants are told apart by numbers of their own, so that one plan serves all."""
    names = variants.select("variant").distinct().withColumn("k", F.row_number().over(Window.orderBy("variant")) - 1)  # a row for each variant
    span = 1_000_000
    at = (F.col("k") * span + F.col("window_id")).cast("int")
    many = train.crossJoin(F.broadcast(names)).withColumn("window_id", at).drop("k", "variant")
    groups = variants.join(F.broadcast(names), "variant").select(at.alias("window_id"), "asset", "cluster")
    two = alloc.two_stage(many, groups, s).withColumn("k", F.floor(F.col("window_id") / span).cast("int")).join(F.broadcast(names), "k")
    two = two.select("variant", (F.col("window_id") % span).alias("window_id"), "asset", "w")
    return two.unionByName(alloc.equal_weight(train).withColumn("variant", F.lit("equal_weight"))).withColumn("gate_passed", F.lit(None).cast("boolean"))
