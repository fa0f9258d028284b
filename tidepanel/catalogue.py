"""Queries of the library by name, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import align, alloc, engine, grouping, inference, optimise, outlook, returns, study, symbols, windows
from .sources import panel

S = Settings()
#: Draws of a null, as in the reference's reports.
DRAWS = 1000
NUMBERS = ("ann_return", "ann_vol", "sharpe", "max_drawdown", "avg_turnover")


def _panel(spark: SparkSession, d: str, fill: str = "drop") -> DataFrame:
    prices = panel.once(spark, ("prices", d), lambda: panel.unit_prices(spark, d))
    return panel.once(spark, ("panel", d, fill), lambda: returns.common_days(returns.simple_returns(prices, fill)))


def _train(spark, d):
    return panel.once(spark, ("train", d), lambda: windows.train_rows(_panel(spark, d), S))


def _forward(spark, d):
    return panel.once(spark, ("forward", d), lambda: windows.forward_rows(_panel(spark, d), S))


def _rounded(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _weights(spark, d, method="risk_parity", within="inverse_vol"):
    return alloc.two_stage(_train(spark, d), panel.sectors(spark, d), S, method, within)


PLAIN = ("equal_weight", "inverse_vol", "sector")


def _method_weights(spark, d, methods=PLAIN):
    """method, window_id, asset, w, gate_passed of several methods; each is kept, as it is read more than once."""
    out = None
    for m in methods:
        how = {"gate": _gate(spark, d)} if m == "alignment" else {}
        if m in ("alignment", "random"):
            how["aligned"] = _aligned(spark, d)
        one = panel.once(spark, ("weights", d, m), lambda m=m, how=how: study.weights_of(_train(spark, d), panel.sectors(spark, d), S, (m,), **how))
        out = one if out is None else out.unionByName(one)
    return out


def _aligned(spark, d):
    return panel.once(spark, ("clusters", d), lambda: study.alignment_clusters(_train(spark, d), S))


def _gate(spark, d):
    return panel.once(spark, ("gate", d), lambda: inference.gate(_draws(spark, d)))


def _draws(spark, d):
    return panel.once(spark, ("draws", d), lambda: inference.null_draws(_strings(spark, d), S, DRAWS))


def _run(spark, d, methods=PLAIN):
    """Daily returns and rebalances, kept: one row a day and one a window for each method."""
    found = study.run(_forward(spark, d), _method_weights(spark, d, methods), S)
    return tuple(panel.once(spark, (name, d, methods), lambda df=df: df) for name, df in zip(("net", "turns"), found))


def _methods(spark, d):
    """method, window_id, dt, r net of costs, for methods that need no search."""
    return _run(spark, d)[0]


def _strings(spark, d, **how):
    return align.codes(symbols.symbolize(_train(spark, d), S, **how))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.table(*_run(spark, sf_dir), S)


def _price_panel(spark, d):
    return panel.unit_prices(spark, d)


def _simple_returns(spark, d):
    return returns.simple_returns(panel.unit_prices(spark, d)).where("r is not null")


def _forward_fill(spark, d):
    return returns.simple_returns(panel.unit_prices(spark, d), "pad").where("r is not null")


def _split(spark, d):
    return returns.time_split(_panel(spark, d)).groupBy("part").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


def _edges(scope):
    def run(spark, d):
        e = symbols.edges(_train(spark, d), S, scope)
        return e.select(*[c for c in e.columns if c != "edges"], *[F.round(F.col("edges")[k], 9).alias(f"e{k + 1}") for k in range(4)])

    return run


def _shares(**how):
    return lambda spark, d: symbols.symbolize(_train(spark, d), S, **how).groupBy("window_id", "asset", "code").agg(F.count("*").alias("n"))


def _cost_sweep(spark, d):
    w = _weights(spark, d)
    gross, turn = engine.gross_returns(_forward(spark, d), w), engine.turnover(w)
    costs = spark.createDataFrame([(c,) for c in S.costs], "bps double")
    net = engine.net_returns(gross, turn, 0.0).withColumnRenamed("r", "gross").join(turn, "window_id").crossJoin(F.broadcast(costs))
    first = F.row_number().over(engine.Window.partitionBy("bps", "window_id").orderBy("dt")) == 1
    net = net.withColumn("r", F.col("gross") - F.when(first, F.col("turnover") * F.col("bps") / 1e4).otherwise(0.0))
    return _rounded(engine.metrics(net, S, ["bps"]), "ann_return", "ann_vol", "sharpe", "max_drawdown", digits=7)


def _bootstrap(spark, d):
    """Four intervals of the sector method against the others: 1,000 resamples of blocks of 5 months."""
    return _rounded(study.intervals(_methods(spark, d), "sector", S, 1000, 5), "lo", "hi", digits=6)


def _autocorrelations(spark, d):
    net = _methods(spark, d).where("method = 'equal_weight'").select((F.row_number().over(engine.Window.orderBy("dt")) - 1).alias("pos"), "r")
    return _rounded(inference.autocorrelations(net, 10), "rho", digits=7)


def _distances(spark, d):
    return _rounded(align.pair_distances(_strings(spark, d), S), "score", "d")


def _correlation_pairs(spark, d):
    return study.correlation_pairs(_train(spark, d))


def _alignment_clusters(spark, d):
    return grouping.clusters(align.pair_distances(_strings(spark, d), S), S)


def _correlation_clusters(spark, d):
    return grouping.clusters(_correlation_pairs(spark, d), S)


def _agreement(spark, d):
    return _rounded(grouping.rand_index(_alignment_clusters(spark, d), _correlation_clusters(spark, d)), "ari")


def _band_sweep(spark, d):
    strings = _strings(spark, d)
    last = strings.join(F.broadcast(strings.agg(F.max("window_id").alias("window_id"))), "window_id")
    out = None
    for band in (2, 5, 10):
        one = grouping.clusters(align.pair_distances(last, S, band=band), S).withColumn("band", F.lit(band))
        out = one if out is None else out.unionByName(one)
    return out


def _local_distances(spark, d):
    return _rounded(align.pair_distances(_strings(spark, d), S, local=True).drop("d"), "score")


def _random_clusters(spark, d):
    sizes = panel.sectors(spark, d).groupBy("cluster").agg(F.count("*").alias("size"))
    return grouping.random_clusters(_train(spark, d), sizes)


def _pair_pvalues(spark, d):
    return _rounded(inference.benjamini_hochberg(inference.drawn_pvalues(_draws(spark, d), DRAWS)), "d", "p")


def _fdr_fraction(spark, d):
    found = inference.benjamini_hochberg(inference.drawn_pvalues(_draws(spark, d), DRAWS))
    return found.groupBy("window_id").agg(F.avg(F.col("significant").cast("int")).alias("fraction"))


def _block_length(spark, d):
    net = _methods(spark, d).where("method = 'equal_weight'").select((F.row_number().over(engine.Window.orderBy("dt")) - 1).alias("pos"), "r")
    return inference.block_length(net)


ALL = ("alignment", "equal_weight", "sector", "correlation", "random", "min_variance", "mean_variance")


def _alignment_backtest(spark, d):
    """All seven methods on the same windows, the alignment behind its gate."""
    return _rounded(study.table(*_run(spark, d, ALL), S), *NUMBERS, digits=7)


def _passed_view(spark, d):
    return _rounded(study.passed_view(*_run(spark, d, ALL), S), *NUMBERS, digits=7)


def _full_intervals(spark, d):
    """The alignment against every other method, blocks of 5 months."""
    return _rounded(study.intervals(_run(spark, d, ALL)[0], "alignment", S, 1000, 5), "lo", "hi", digits=6)


def _variants(spark, d):
    return panel.once(spark, ("variants", d), lambda: study.symbol_variants(_train(spark, d), S))


def _symbol_ablation(spark, d):
    w = panel.once(spark, ("variant weights", d), lambda: study.variant_weights(_train(spark, d), _variants(spark, d), S))
    return _rounded(study.table(*study.run(_forward(spark, d), w, S, ("variant",)), S, ("variant",)), *NUMBERS, digits=7)


def _allocator_sweep(spark, d):
    w = panel.once(spark, ("allocators", d), lambda: study.allocators(_train(spark, d), _aligned(spark, d), _gate(spark, d), S))
    return _rounded(study.table(*study.run(_forward(spark, d), w, S, ("variant",)), S, ("variant",)), *NUMBERS, digits=7)


def _holdout(spark, d):
    """Verdicts on the report's part of time: the variants of symbols against equal weights, for windows that hold after the cut."""
    w = panel.once(spark, ("variant weights", d), lambda: study.variant_weights(_train(spark, d), _variants(spark, d), S))
    late = returns.time_split(_panel(spark, d), S.tune_fraction).where("part = 'report'").select("dt").distinct()
    net, _ = study.run(_forward(spark, d), w, S, ("variant",))
    net = net.join(F.broadcast(late), "dt", "left_semi").withColumn("method", F.col("variant"))
    out = None
    for name in ("per_stock", "pooled_neutral"):
        one = study.verdicts(study.intervals(net.where(F.col("method").isin(name, "equal_weight")), name, S, 1000, 5)).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return _rounded(out, "lo", "hi", digits=6)


def report(spark, d, methods, draws=DRAWS, settings=S, bps=None, band_only=False) -> dict[str, DataFrame]:
    """Tables of a full report by name: clusters by band, metrics, the view of passed windows, intervals and costs. Only the bands, with
    band_only; views and intervals need the alignment among the methods."""
    out = {"bands": _band_sweep(spark, d)}
    if band_only:
        return out
    s, train = settings, panel.stored(windows.train_rows(_panel(spark, d), settings))
    w = study.weights_of(train, panel.sectors(spark, d), s, tuple(methods), draws=draws, allocator=s.allocator)
    w, forward = panel.stored(w), panel.stored(windows.forward_rows(_panel(spark, d), s))
    net, turns = (panel.stored(df) for df in study.run(forward, w, s, bps=bps))
    out["metrics"] = study.table(net, turns, s)
    if "alignment" in methods:
        out["passed"] = study.passed_view(net, turns, s)
        out["intervals"] = study.intervals(net, "alignment", s, s.resamples, s.block)
    costs = None
    for c in s.costs:
        one = study.table(*study.run(forward, w, s, bps=c), s).withColumn("bps", F.lit(c))
        costs = one if costs is None else costs.unionByName(one)
    return out | {"costs": costs}


def _composites(spark, d):
    return outlook.composites(_train(spark, d), panel.sectors(spark, d))


def queries() -> dict:
    w = ["window_id", "asset", "w"]
    rounded_w = lambda f: lambda spark, d: _rounded(f(spark, d).select(*w), "w")
    return {
        "price_panel": _price_panel,
        "simple_returns": _simple_returns,
        "forward_fill_panel": _forward_fill,
        "common_days": _panel,
        "time_split": _split,
        "market_neutral": lambda s, d: _rounded(returns.market_neutral(_panel(s, d)), "r"),
        "rebalance_schedule": lambda s, d: windows.schedule(_panel(s, d), S),
        "train_windows": lambda s, d: _train(s, d).select("window_id", "asset", "pos", "r"),
        "forward_windows": lambda s, d: _forward(s, d).select("window_id", "asset", "pos", "r"),
        "quantile_edges": _edges("per_stock"),
        "pooled_edges": _edges("pooled"),
        "symbols_per_stock": _shares(),
        "symbols_pooled": _shares(scope="pooled"),
        "equal_weight": rounded_w(lambda s, d: alloc.equal_weight(_train(s, d))),
        "inverse_vol": rounded_w(lambda s, d: alloc.inverse_vol(_train(s, d))),
        "cluster_risk_parity": lambda s, d: _rounded(alloc.cluster_weights(_train(s, d), panel.sectors(s, d), S), "w"),
        "cluster_forecast_tilt": lambda s, d: _rounded(alloc.cluster_weights(_train(s, d), panel.sectors(s, d), S, "forecast_tilt"), "w"),
        "two_stage_weights": rounded_w(_weights),
        "turnover": lambda s, d: _rounded(engine.turnover(_weights(s, d)), "turnover"),
        "gross_returns": lambda s, d: _rounded(engine.gross_returns(_forward(s, d), _weights(s, d)), "r"),
        "net_returns": lambda s, d: _rounded(_methods(s, d), "r"),
        "metrics_table": lambda s, d: _rounded(entry(s, d).drop("gate_pass_fraction"), *NUMBERS, digits=7),
        "cost_sweep": _cost_sweep,
        "correlation_distance": lambda s, d: _rounded(_correlation_pairs(s, d), "d"),
        "autocorrelations": _autocorrelations,
        "block_bootstrap_ci": _bootstrap,
        "distance_pairs": _distances,
        "local_scores": _local_distances,
        "min_variance": rounded_w(lambda s, d: optimise.optimised(_train(s, d), S)),
        "mean_variance": rounded_w(lambda s, d: optimise.optimised(_train(s, d), S, 0.5, True)),
        "random_clusters": _random_clusters,
        "pair_pvalues": _pair_pvalues,
        "block_length": _block_length,
        "alignment_clusters": _alignment_clusters,
        "correlation_clusters": _correlation_clusters,
        "cluster_agreement": _agreement,
        "band_sweep": _band_sweep,
        "null_gate": _gate,
        "fdr_fraction": _fdr_fraction,
        "gate_passed_view": _passed_view,
        "report_intervals": _full_intervals,
        "symbol_ablation": _symbol_ablation,
        "symbol_agreement": lambda s, d: _rounded(study.mean_agreement(_variants(s, d)), "ari"),
        "allocator_sweep": _allocator_sweep,
        "holdout_verdicts": _holdout,
        "cluster_map": lambda s, d: grouping.cluster_map(_alignment_clusters(s, d)).select("window_id", F.to_json("clusters").alias("clusters")),
        "arima_forecast": lambda s, d: _rounded(outlook.forecasts(_composites(s, d), S.hold, 20, "arima"), "expected_return", digits=6),
        "alignment_backtest": _alignment_backtest,
        "hist_mean_forecast": lambda s, d: _rounded(outlook.historical_mean(_composites(s, d), S.hold), "expected_return"),
        # training windows have 24 months, so 20 returns are enough here
        "spline_forecast": lambda s, d: _rounded(outlook.forecasts(_composites(s, d), S.hold, 20), "expected_return"),
    }


_BASE = """
WITH RECURSIVE prices AS (
  SELECT CAST(s_nationkey AS INTEGER) AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
grid AS (
  SELECT a.asset, t.dt, p.price FROM (SELECT DISTINCT asset FROM prices) a CROSS JOIN (SELECT DISTINCT dt FROM prices) t
  LEFT JOIN prices p ON p.asset = a.asset AND p.dt = t.dt),
padded AS (SELECT asset, dt, last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS price FROM grid),
ret AS (SELECT asset, dt, price / lag(price) OVER (PARTITION BY asset ORDER BY dt) - 1 AS r FROM grid QUALIFY row_number() OVER (PARTITION BY asset ORDER BY dt) > 1),
days AS (
  SELECT dt, CAST(row_number() OVER (ORDER BY dt) - 1 AS INTEGER) AS pos FROM (
    SELECT dt FROM ret GROUP BY dt HAVING count(r) = (SELECT count(DISTINCT asset) FROM ret))),
panel AS (SELECT asset, dt, pos, r FROM ret JOIN days USING (dt)),
sched AS (SELECT CAST((i - 24) // 3 AS INTEGER) AS window_id, CAST(i AS INTEGER) AS i FROM range(24, 100000, 3) t(i) WHERE i + 3 <= (SELECT count(*) FROM days)),
train AS (SELECT window_id, asset, dt, pos, r FROM sched JOIN panel ON pos >= i - 24 AND pos < i),
fwd AS (SELECT window_id, asset, dt, pos, r FROM sched JOIN panel ON pos >= i AND pos < i + 3),
edges AS (SELECT window_id, asset, quantile_cont(r, [0.2, 0.4, 0.6, 0.8]) AS e FROM train GROUP BY 1, 2),
pooled AS (SELECT window_id, quantile_cont(r, [0.2, 0.4, 0.6, 0.8]) AS e FROM train GROUP BY 1),
sectors AS (SELECT CAST(n_regionkey AS INTEGER) AS cluster, CAST(n_nationkey AS INTEGER) AS asset FROM nation),
vols AS (SELECT window_id, asset, stddev_pop(r) AS vol FROM train GROUP BY 1, 2),
eq AS (SELECT window_id, asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY window_id) AS w FROM vols),
iv AS (SELECT window_id, asset, (1 / vol) / sum(1 / vol) OVER (PARTITION BY window_id) AS w FROM vols),
comp AS (SELECT window_id, cluster, dt, avg(r) AS r, count(*) AS size FROM train JOIN sectors USING (asset) GROUP BY 1, 2, 3),
cstat AS (SELECT window_id, cluster, stddev_pop(r) AS vol, avg(r) AS mean, max(size) AS size FROM comp GROUP BY 1, 2),
craw AS (
  SELECT *, (1 / vol) / sum(1 / vol) OVER w AS rp, CAST(sum(size) OVER w AS BIGINT) AS n,
         greatest(0.05, 1 + 0.25 * coalesce((mean - avg(mean) OVER w) / nullif(stddev_pop(mean) OVER w, 0), 0)) AS tilt
  FROM cstat WINDOW w AS (PARTITION BY window_id)),
ccap AS (SELECT *, tilt / sum(tilt) OVER (PARTITION BY window_id) AS ft, size * greatest(0.1, 1.5 / n) AS cap FROM craw),
cw AS (
  SELECT window_id, cluster, size, n,
    least(rp, cap) + coalesce(sum(greatest(rp - cap, 0)) OVER p * greatest(cap - rp, 0) / nullif(sum(greatest(cap - rp, 0)) OVER p, 0), 0) AS w,
    least(ft, cap) + coalesce(sum(greatest(ft - cap, 0)) OVER p * greatest(cap - ft, 0) / nullif(sum(greatest(cap - ft, 0)) OVER p, 0), 0) AS wt
  FROM ccap WINDOW p AS (PARTITION BY window_id)),
share AS (SELECT window_id, asset, cluster, (1 / vol) / sum(1 / vol) OVER (PARTITION BY window_id, cluster) AS share FROM vols JOIN sectors USING (asset)),
raw2 AS (SELECT s.window_id, asset, cluster, share * w AS w, greatest(0.1, 1.5 / n) AS cap FROM share s JOIN cw USING (window_id, cluster)),
cap2 AS (
  SELECT window_id, asset, least(w, cap) + coalesce(sum(greatest(w - cap, 0)) OVER p * greatest(cap - w, 0) / nullif(sum(greatest(cap - w, 0)) OVER p, 0), 0) AS w
  FROM raw2 WINDOW p AS (PARTITION BY window_id, cluster)),
ts AS (SELECT window_id, asset, w / sum(w) OVER (PARTITION BY window_id) AS w FROM cap2),
allw AS (SELECT 'equal_weight' AS method, * FROM eq UNION ALL SELECT 'inverse_vol', * FROM iv UNION ALL SELECT 'sector', * FROM ts),
allgrid AS (
  SELECT k.method, k.window_id, a.asset, coalesce(w.w, 0) AS w FROM (SELECT DISTINCT method, window_id FROM allw) k CROSS JOIN (SELECT DISTINCT asset FROM allw) a
  LEFT JOIN allw w ON w.method = k.method AND w.window_id = k.window_id AND w.asset = a.asset),
moves AS (SELECT method, window_id, abs(w - lag(w, 1, 0) OVER (PARTITION BY method, asset ORDER BY window_id)) AS m FROM allgrid),
turns AS (SELECT method, window_id, sum(m) AS turnover FROM moves GROUP BY 1, 2),
gross AS (SELECT method, window_id, dt, sum(r * w) AS r FROM fwd JOIN allw USING (window_id, asset) GROUP BY 1, 2, 3),
firsts AS (SELECT *, row_number() OVER (PARTITION BY method, window_id ORDER BY dt) = 1 AS is_first FROM gross),
net AS (SELECT method, window_id, dt, r - CASE WHEN is_first THEN turnover * 10.0 / 1e4 ELSE 0 END AS r FROM firsts JOIN turns USING (method, window_id)),
swept AS (SELECT CAST(bps AS DOUBLE) AS bps, dt, r - CASE WHEN is_first THEN turnover * bps / 1e4 ELSE 0 END AS r FROM firsts JOIN turns USING (method, window_id), (VALUES (0.0), (5.0), (10.0), (15.0), (20.0), (25.0)) c(bps) WHERE method = 'sector'),
pairs AS (SELECT CAST(row_number() OVER (ORDER BY a.dt) - 1 AS INTEGER) AS pos, a.r AS x, b.r AS y FROM net a JOIN net b ON a.dt = b.dt AND a.method = 'sector' AND b.method = 'equal_weight')
"""


def _metrics_sql(source: str, key: str) -> str:
    return f"""
SELECT {key}, round(pow(product(1 + r), 12.0 / count(r)) - 1, 7) AS ann_return, round(stddev_pop(r) * sqrt(12.0), 7) AS ann_vol,
       round(avg(r) / stddev_pop(r) * sqrt(12.0), 7) AS sharpe, round(min(dd), 7) AS max_drawdown
FROM (SELECT *, cum / max(cum) OVER (PARTITION BY {key} ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (
  SELECT *, product(1 + r) OVER (PARTITION BY {key} ORDER BY dt ROWS UNBOUNDED PRECEDING) AS cum FROM {source})) GROUP BY {key}"""


def oracle_sql() -> dict[str, str]:
    code = "CASE WHEN e[1] = e[4] THEN 2 ELSE CAST(r >= e[1] AS INT) + CAST(r >= e[2] AS INT) + CAST(r >= e[3] AS INT) + CAST(r >= e[4] AS INT) END"
    sharpe = "CASE WHEN stddev_pop({0}) > 1e-12 THEN avg({0}) / stddev_pop({0}) * sqrt(12.0) END"
    four = ", ".join(f"round(e[{k}], 9) AS e{k}" for k in range(1, 5))
    tails = {
        "price_panel": "SELECT * FROM prices",
        "simple_returns": "SELECT * FROM ret WHERE r IS NOT NULL",
        "forward_fill_panel": "SELECT * FROM (SELECT asset, dt, price / lag(price) OVER (PARTITION BY asset ORDER BY dt) - 1 AS r FROM padded) WHERE r IS NOT NULL",
        "common_days": "SELECT * FROM panel",
        "time_split": "SELECT CASE WHEN pos < floor(n * 0.7) THEN 'tune' ELSE 'report' END AS part, count(*) AS n, max(pos) AS last FROM panel, (SELECT count(*) AS n FROM days) c GROUP BY 1",
        "market_neutral": "SELECT asset, dt, pos, round(r - avg(r) OVER (PARTITION BY dt), 8) AS r FROM panel",
        "rebalance_schedule": "SELECT * FROM sched",
        "train_windows": "SELECT window_id, asset, pos, r FROM train",
        "forward_windows": "SELECT window_id, asset, pos, r FROM fwd",
        "quantile_edges": f"SELECT window_id, asset, {four} FROM edges",
        "pooled_edges": f"SELECT window_id, {four} FROM pooled",
        "symbols_per_stock": f"SELECT window_id, asset, CAST({code} AS INTEGER) AS code, count(*) AS n FROM train JOIN edges USING (window_id, asset) GROUP BY 1, 2, 3",
        "symbols_pooled": f"SELECT window_id, asset, CAST({code} AS INTEGER) AS code, count(*) AS n FROM train JOIN pooled USING (window_id) GROUP BY 1, 2, 3",
        "equal_weight": "SELECT window_id, asset, round(w, 8) AS w FROM eq",
        "inverse_vol": "SELECT window_id, asset, round(w, 8) AS w FROM iv",
        "cluster_risk_parity": "SELECT window_id, cluster, size, n, round(w, 8) AS w FROM cw",
        "cluster_forecast_tilt": "SELECT window_id, cluster, size, n, round(wt, 8) AS w FROM cw",
        "two_stage_weights": "SELECT window_id, asset, round(w, 8) AS w FROM ts",
        "turnover": "SELECT window_id, round(turnover, 8) AS turnover FROM turns WHERE method = 'sector'",
        "gross_returns": "SELECT window_id, dt, round(r, 8) AS r FROM gross WHERE method = 'sector'",
        "net_returns": "SELECT method, window_id, dt, round(r, 8) AS r FROM net",
        "metrics_table": "SELECT m.*, round(t.avg_turnover, 7) AS avg_turnover FROM (" + _metrics_sql("net", "method") + ") m JOIN (SELECT method, avg(turnover) AS avg_turnover FROM turns GROUP BY method) t USING (method)",
        "random_clusters": """SELECT window_id, asset, cluster FROM (
  SELECT window_id, asset, row_number() OVER (PARTITION BY window_id ORDER BY md5('42:' || window_id || ':' || asset), asset) AS rank FROM (SELECT DISTINCT window_id, asset FROM train)) r
  JOIN (SELECT cluster, size, sum(size) OVER (ORDER BY cluster) AS upto FROM (SELECT cluster, count(*) AS size FROM sectors GROUP BY cluster)) c ON rank > upto - size AND rank <= upto""",
        "cost_sweep": _metrics_sql("swept", "bps"),
        "correlation_distance": "SELECT a.window_id, a.asset AS a, b.asset AS b, round(1 - corr(a.r, b.r), 8) AS d FROM train a JOIN train b ON a.window_id = b.window_id AND a.pos = b.pos AND a.asset < b.asset GROUP BY 1, 2, 3",
        "hist_mean_forecast": "SELECT window_id, cluster, round(avg(r) * 3, 8) AS expected_return FROM comp GROUP BY 1, 2",
        "autocorrelations": "SELECT k AS lag, round(sum(a.y * b.y) / (SELECT sum(y * y) FROM cy), 7) AS rho FROM (SELECT pos, y - (SELECT avg(y) FROM pairs) AS y FROM pairs) a JOIN cy b ON b.pos > a.pos JOIN (SELECT CAST(k AS INTEGER) AS k FROM range(1, 11) t(k)) l ON b.pos = a.pos + k GROUP BY k",
        "block_bootstrap_ci": f"""SELECT baseline, stat, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM (
  UNPIVOT (SELECT baseline, q, {sharpe.format('x')} AS sharpe_method, {sharpe.format('y')} AS sharpe_baseline, {sharpe.format('x')} - {sharpe.format('y')} AS sharpe_diff,
    pow(product(1 + x), 12.0 / count(x)) - pow(product(1 + y), 12.0 / count(y)) AS return_diff
  FROM (
    SELECT q, CAST(('0x' || substr(md5('start:' || q || ':' || b), 1, 15))::BIGINT % (n - 4) AS INTEGER) + s AS pos
    FROM (SELECT count(*) AS n FROM pairs) c, range(0, 1000) t(q), range(0, 100000) u(b), range(0, 5) v(s) WHERE b < ceil(n / 5.0) AND b * 5 + s < n) d
  JOIN (SELECT row_number() OVER (PARTITION BY b.method ORDER BY a.dt) - 1 AS pos, b.method AS baseline, a.r AS x, b.r AS y FROM net a JOIN net b ON a.dt = b.dt AND a.method = 'sector' AND b.method <> 'sector') p
  USING (pos) GROUP BY baseline, q) ON sharpe_method, sharpe_baseline, sharpe_diff, return_diff INTO NAME stat VALUE value) GROUP BY baseline, stat""",
    }
    base = _BASE + ", cy AS (SELECT pos, y - (SELECT avg(y) FROM pairs) AS y FROM pairs)\n"
    return {k: base + v for k, v in tails.items()}
