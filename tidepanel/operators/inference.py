"""Null gate and resampling, with randomness as data."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.panel import spread
from .align import banded_scores, pair_distances
from .grouping import constrained_labels


def shift_offset(band: int, length, draw, asset):
    """An offset in band + 1 .. length - band - 3 by arithmetic. It repeats after length - 2 * band - 3 draws: for plain counts, not for a null."""
    room = length - 2 * band - 3
    return band + 1 + F.pmod(draw * 7 + asset * 13 + draw * asset * 3, room)


def hashed_offset(band: int, length, draw, asset):
    """An offset in band + 1 .. length - band - 2 from a hash of window, draw and asset: draws don't repeat, and each asset turns on its own."""
    room = length - 2 * band - 2
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", "window_id", draw, asset).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.when(room > 0, band + 1 + F.pmod(hashed, F.greatest(room, F.lit(1)))).otherwise(F.raise_error(F.lit("strings are too short to turn beyond the band")))


def shifted(strings: DataFrame, draws: int, s: Settings, offset=hashed_offset) -> DataFrame:
    """window_id, draw, asset, codes: every string turned by its offset."""
    each = strings.crossJoin(F.broadcast(strings.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))))
    n = F.size("codes")
    off = offset(s.band, n, F.col("draw"), F.col("asset")).cast("int")
    return each.withColumn("off", off).select("window_id", "draw", "asset", F.concat(F.slice("codes", F.col("off") * -1, F.col("off")), F.slice("codes", F.lit(1), n - F.col("off"))).alias("codes"))


def offset_of(window, draw, asset, length: int, band: int) -> int:
    """The same offset as `hashed_offset`, in a kernel."""
    room = length - 2 * band - 2
    if room <= 0:
        raise ValueError("strings are too short to turn beyond the band")
    return band + 1 + int(hashlib.md5(f"{window}:{draw}:{asset}".encode()).hexdigest()[:15], 16) % room


def null_draws(strings: DataFrame, s: Settings, draws: int, batch: int = 50) -> DataFrame:
    """window_id, draw, silhouette, a, b, d, near. Rows with a draw hold a silhouette, draw -1 that of the data itself; rows with a pair
    hold its distance and in how many draws of a batch it came as near.

    A window's strings go to one task for each batch of draws and are turned there, so each is sent once a batch; all pairs of all
    draws of the batch are aligned in one sweep."""
    parts = strings.sparkSession.range(-(-draws // batch)).select(F.col("id").cast("int").alias("part"))
    kind = strings.schema["asset"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("asset")
        window, part, names = pdf["window_id"].iloc[0], int(pdf["part"].iloc[0]), pdf["asset"].tolist()
        x = np.stack(pdf["codes"]).astype(float)
        length, n = x.shape[1], len(names)
        i, j = np.triu_indices(n, 1)
        which = list(range(part * batch, min(draws, (part + 1) * batch)))
        turned = [x, *(np.stack([np.roll(row, offset_of(window, k, name, length, s.band)) for row, name in zip(x, names)]) for k in which)]
        d = np.maximum(0, 1 - banded_scores(np.concatenate([t[i] for t in turned]), np.concatenate([t[j] for t in turned]), s) / (s.match * length)).reshape(len(turned), -1)
        sils = []
        for row in d:
            full = np.zeros((n, n))
            full[i, j] = full[j, i] = row
            sils.append(constrained_labels(full, s)[1])
        first = 0 if part == 0 else 1  # the data itself is told once
        one = pd.DataFrame({"draw": [-1, *which][first:], "silhouette": sils[first:]})
        near = (d[1:] <= d[0]).sum(0)
        two = pd.DataFrame({"a": [names[k] for k in i], "b": [names[k] for k in j], "d": d[0], "near": near})
        out = pd.concat([one, two], ignore_index=True).astype({"draw": "Int32", "near": "Int64"})
        return out.assign(window_id=window)[["window_id", "draw", "silhouette", "a", "b", "d", "near"]]

    schema = f"window_id int, draw int, silhouette double, a {kind}, b {kind}, d double, near long"
    return spread(strings.crossJoin(F.broadcast(parts)), "window_id", "part").groupBy("window_id", "part").applyInPandas(run, schema)


def gate(found: DataFrame, percentile: float = 0.95) -> DataFrame:
    """window_id, silhouette, threshold, passed: whether the data's silhouette exceeds the percentile of the draws'; without one it fails."""
    real = F.max(F.when(F.col("draw") < 0, F.nanvl("silhouette", F.lit(None))))
    null = F.percentile(F.when(F.col("draw") >= 0, F.nanvl("silhouette", F.lit(None))), F.lit(percentile))
    out = found.where("draw is not null").groupBy("window_id").agg(real.alias("silhouette"), null.alias("threshold"))
    return out.withColumn("passed", F.coalesce(F.col("silhouette") > F.col("threshold"), F.lit(False)))


def null_gate(strings: DataFrame, s: Settings, draws: int, percentile: float = 0.95) -> DataFrame:
    return gate(null_draws(strings, s, draws), percentile)


def drawn_pvalues(found: DataFrame, draws: int) -> DataFrame:
    """window_id, a, b, d, p of the pairs of `null_draws`: the share of draws, itself counted, that bring a pair as near as it is."""
    near = found.where("draw is null").groupBy("window_id", "a", "b").agg(F.max("d").alias("d"), F.sum("near").alias("m"))
    return near.select("window_id", "a", "b", "d", ((F.col("m") + 1) / (draws + 1)).alias("p"))


def benjamini_hochberg(pvalues: DataFrame, alpha: float = 0.05, key: str = "window_id") -> DataFrame:
    """pvalues with significant: p at most the largest p under the line rank / n * alpha."""
    by = Window.partitionBy(key)
    ranked = pvalues.withColumn("rank", F.row_number().over(by.orderBy("p"))).withColumn("n", F.count("*").over(by))
    limit = F.max(F.when(F.col("p") <= F.col("rank") / F.col("n") * alpha, F.col("p"))).over(by)
    return ranked.withColumn("significant", F.coalesce(F.col("p") <= limit, F.lit(False))).drop("rank", "n")


def hashed_start(resample, block, room):
    """A start in 0 .. room - 1 from a hash of resample and block: resamples don't repeat each other."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("start"), resample, block).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.pmod(hashed, room).cast("int")


def bootstrap_intervals(pairs: DataFrame, s: Settings, resamples: int = 5000, block: int = 20, confidence: float = 0.95, keys: tuple[str, ...] = (), by_dependence: bool = False) -> DataFrame:
    """keys, stat, lo, hi for stats sharpe_method, sharpe_baseline, sharpe_diff and return_diff of x (method) and y (baseline): moving
    blocks, the same ones for both. pairs: keys, pos (from 0 in each of keys), x, y.

    Each resample draws ceil(n / block) starts by hash, the same for all keys, and is cut to n rows. With by_dependence a block's length is
    Politis and White's choice for x, one for all keys of one x. Fewer than 10 rows give null bounds; a resample without variance has
    no Sharpe ratio and is left out of its intervals.
    """
    spark = pairs.sparkSession
    if by_dependence:
        one = pairs.select(*keys).distinct().limit(1) if keys else None
        block = block_length((pairs.join(F.broadcast(one), list(keys)) if keys else pairs).select("pos", F.col("x").alias("r"))).first()[0]
    sizes = pairs.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
    width = F.least(F.lit(block), F.col("n"))
    base = F.broadcast(sizes).crossJoin(spark.range(resamples).select(F.col("id").cast("int").alias("resample"))).withColumn("width", width)
    blocks = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("width")).cast("int") - 1)))
    rows = blocks.withColumn("start", hashed_start(F.col("resample"), F.col("block"), F.col("n") - F.col("width") + 1)).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    rows = rows.where(F.col("block") * F.col("width") + F.col("step") < F.col("n"))
    drawn = rows.select(*keys, "resample", "n", (F.col("start") + F.col("step")).alias("pos")).join(F.broadcast(pairs), [*keys, "pos"])
    year = float(s.periods)
    sharpe = lambda c: F.when(F.stddev_pop(c) > 1e-12, F.avg(c) / F.stddev_pop(c) * year**0.5)
    annual = lambda c: F.pow(F.product(1 + F.col(c)), year / F.count(c)) - 1
    each = drawn.groupBy(*keys, "resample").agg(sharpe("x").alias("sharpe_method"), sharpe("y").alias("sharpe_baseline"), (sharpe("x") - sharpe("y")).alias("sharpe_diff"), (annual("x") - annual("y")).alias("return_diff"), F.max("n").alias("n"))
    long = each.where("resample >= 0").unpivot([*keys, "resample", "n"], ["sharpe_method", "sharpe_baseline", "sharpe_diff", "return_diff"], "stat", "value")
    bound = lambda p: F.when(F.max("n") >= 10, F.percentile("value", F.lit(p)))
    return long.groupBy(*keys, "stat").agg(bound((1 - confidence) / 2).alias("lo"), bound((1 + confidence) / 2).alias("hi"))


def autocorrelations(series: DataFrame, lags: int) -> DataFrame:
    """lag, rho of a column r in order of pos."""
    mean = F.broadcast(series.agg(F.avg("r").alias("m")))
    x = series.join(mean).select("pos", (F.col("r") - F.col("m")).alias("c"))
    later = x.select((F.col("pos")).alias("q"), F.col("c").alias("e"))
    moved = x.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("q", F.col("pos") + F.col("lag")).join(later, "q")
    total = F.broadcast(x.agg(F.sum(F.col("c") * F.col("c")).alias("all")))
    return moved.groupBy("lag").agg(F.sum(F.col("c") * F.col("e")).alias("part")).join(total).select("lag", F.when(F.col("all") > 0, F.col("part") / F.col("all")).otherwise(0.0).alias("rho"))


def pair_pvalues(strings: DataFrame, s: Settings, draws: int, offset=shift_offset) -> DataFrame:
    """window_id, a, b, d, p: the share of draws, itself counted, that bring a pair as near as it is. A null of many draws needs hashed_offset."""
    real = pair_distances(strings, s).select("window_id", "a", "b", "d")
    null = pair_distances(shifted(strings, draws, s, offset), s, ("window_id", "draw")).select("window_id", "a", "b", F.col("d").alias("e"))
    near = null.join(real, ["window_id", "a", "b"]).groupBy("window_id", "a", "b").agg(F.max("d").alias("d"), F.sum((F.col("e") <= F.col("d")).cast("int")).alias("m"))
    return near.select("window_id", "a", "b", "d", ((F.col("m") + 1) / (draws + 1)).alias("p"))


def block_length(series: DataFrame, kind: str = "cb") -> DataFrame:
    """length: Politis and White's (2004) choice for circular ("cb") or stationary ("sb") blocks, for a column r in order of pos.

    Series of fewer than 50 rows, without variance or without positive dependence get the root of their length. Only the number
    of rows goes to the driver.
    """
    series = series.select("pos", "r").persist()  # read several times
    n = series.count()
    root = float(max(1, round(n**0.5)))
    if n < 50:
        return series.sparkSession.range(1).select(F.lit(int(root)).alias("length"))
    look = min(n - 1, max(5, int(np.ceil(10 * np.log10(n)))))
    most = min(n - 1, 3 * look)
    limit = 2 * (np.log10(n) / n) ** 0.5
    rho = autocorrelations(series, most).persist()
    ahead = F.max(F.abs("rho")).over(Window.orderBy("lag").rowsBetween(1, look))  # a row for each lag
    calm = rho.withColumn("ahead", ahead).agg(F.min(F.when((F.col("lag") <= look) & (F.col("ahead") < limit), F.col("lag"))).alias("m"))
    reach = calm.select(F.least(2 * F.coalesce(F.col("m"), F.lit(look)), F.lit(most)).alias("reach"))
    t = F.col("lag") / F.col("reach")
    taper = F.when(t <= 0.5, 1.0).when(t <= 1, 2 * (1 - t)).otherwise(0.0)
    sums = rho.join(F.broadcast(reach)).agg((1 + 2 * F.sum(taper * F.col("rho"))).alias("s"), (2 * F.sum(taper * F.col("lag") * F.col("rho"))).alias("g"))
    d = (2.0 if kind == "sb" else 4 / 3) * F.col("s") * F.col("s")
    b = F.pow(2 * F.col("g") * F.col("g") / d, F.lit(1 / 3)) * float(n) ** (1 / 3)
    return sums.select(F.greatest(F.lit(1), F.least(F.lit(n), F.bround(F.when((F.col("g") > 0) & (F.col("s") != 0), b).otherwise(root)).cast("int"))).alias("length"))
