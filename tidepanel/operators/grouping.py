"""Average linkage with limits on clusters, silhouettes and agreement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.panel import spread


def linkage_cuts(d: np.ndarray, ks: list[int]) -> dict[int, np.ndarray]:
    """Labels at each number of clusters, numbered by smallest member; ties merge the smallest members first."""
    n = len(d)
    own = np.arange(n)
    near = d.astype(float).copy()
    np.fill_diagonal(near, np.inf)
    size, out = np.ones(n), {}
    for k in range(n, 0, -1):
        if k in ks:
            out[k] = np.unique(own, return_inverse=True)[1]
        if k == 1:
            break
        low = np.round(near, 12)
        i, j = divmod(int(np.argmin(low)), n)
        i, j = min(i, j), max(i, j)
        merged = (size[i] * near[i] + size[j] * near[j]) / (size[i] + size[j])
        near[i] = near[:, i] = merged
        near[i, i] = np.inf
        near[j] = near[:, j] = np.inf
        size[i] += size[j]
        own[own == j] = i
    return out


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    groups = np.unique(labels)
    if len(groups) < 2:
        return float("nan")
    sums = np.stack([d[:, labels == g].sum(1) for g in groups], 1)
    counts = np.array([(labels == g).sum() for g in groups])
    at = np.searchsorted(groups, labels)
    rows = np.arange(len(d))
    inner = sums[rows, at] / np.maximum(1, counts[at] - 1)
    means = sums / counts
    means[rows, at] = np.inf
    outer = means.min(1)
    high = np.maximum(inner, outer)
    value = np.where((counts[at] > 1) & (high > 0), (outer - inner) / np.where(high > 0, high, 1), 0.0)
    return float(value.mean())


def constrained_labels(d: np.ndarray, s: Settings) -> tuple[np.ndarray, float, bool]:
    """Of cuts within the limits, first those without small clusters, then the highest silhouette, then the fewest clusters."""
    n = len(d)
    if n < 2:
        raise ValueError("at least two assets are needed")
    top = s.k_cap(n)
    if top < s.k_min:
        return np.zeros(n, int), float("nan"), False
    best = None
    for k, labels in sorted(linkage_cuts(d, list(range(s.k_min, top + 1))).items()):
        ok = np.bincount(labels).min() >= s.min_cluster
        key = (ok, silhouette(d, labels))
        if best is None or key > best[0]:
            best = (key, labels)
    return best[1], best[0][1], bool(best[0][0])


def square(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    names = sorted(set(pdf["a"]) | set(pdf["b"]))
    at = {x: k for k, x in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
    d[i, j] = d[j, i] = pdf["d"].to_numpy()
    return names, d


def clusters(distances: DataFrame, s: Settings, key: str = "window_id") -> DataFrame:
    """key, asset, cluster, k, silhouette, min_size_ok of each key's pairs."""
    kind = distances.schema["a"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = square(pdf)
        labels, sil, ok = constrained_labels(d, s)
        return pd.DataFrame({key: pdf[key].iloc[0], "asset": names, "cluster": labels, "k": int(labels.max()) + 1, "silhouette": sil, "min_size_ok": ok})

    return spread(distances, key).groupBy(key).applyInPandas(run, f"{key} int, asset {kind}, cluster int, k int, silhouette double, min_size_ok boolean")


def rand_index(left: DataFrame, right: DataFrame, key: str = "window_id") -> DataFrame:
    """key, ari: adjusted agreement of two clusterings of the same assets."""
    both = left.select(key, "asset", F.col("cluster").alias("x")).join(right.select(key, "asset", F.col("cluster").alias("y")), [key, "asset"])
    pairs = lambda c: c * (c - 1) / 2
    total = lambda by, name: both.groupBy(key, *by).agg(F.count("*").alias("m")).groupBy(key).agg(F.sum(pairs(F.col("m"))).alias(name))
    sums = total(["x", "y"], "same").join(total(["x"], "rows"), key).join(total(["y"], "cols"), key).join(total([], "all"), key)
    expected = F.col("rows") * F.col("cols") / F.nullif(F.col("all"), F.lit(0.0))
    top = (F.col("rows") + F.col("cols")) / 2 - expected
    return sums.select(key, F.when(F.abs(top) < 1e-12, 1.0).otherwise((F.col("same") - expected) / F.nullif(top, F.lit(0.0))).alias("ari"))


def random_clusters(assets: DataFrame, sizes: DataFrame, seed: int = 42) -> DataFrame:
    """window_id, asset, cluster: each window's assets in an order of hashes, dealt out to clusters of the given sizes (cluster, size).
    Assets beyond the sum of sizes have no row."""
    order = Window.partitionBy("window_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "window_id", "asset").cast("binary")), "asset")
    ranked = assets.select("window_id", "asset").distinct().withColumn("rank", F.row_number().over(order))
    upto = F.sum("size").over(Window.orderBy("cluster"))  # a row for each cluster
    bounds = sizes.select("cluster", (upto - F.col("size")).alias("after"), upto.alias("upto"))
    places = bounds.select("cluster", F.explode(F.sequence((F.col("after") + 1).cast("int"), F.col("upto").cast("int"))).alias("rank"))
    return ranked.join(places, "rank").select("window_id", "asset", "cluster")


def shuffled_clusters(assets: DataFrame, sizes: DataFrame, seed: int = 42) -> DataFrame:
    """The same with sizes of each window: window_id, cluster, size."""
    order = Window.partitionBy("window_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "window_id", "asset").cast("binary")), "asset")
    ranked = assets.select("window_id", "asset").distinct().withColumn("rank", F.row_number().over(order))
    upto = F.sum("size").over(Window.partitionBy("window_id").orderBy("cluster"))
    bounds = sizes.select("window_id", "cluster", (upto - F.col("size")).alias("after"), upto.alias("upto"))
    places = bounds.select("window_id", "cluster", F.explode(F.sequence((F.col("after") + 1).cast("int"), F.col("upto").cast("int"))).alias("rank"))
    return ranked.join(places, ["window_id", "rank"]).select("window_id", "asset", "cluster")


def cluster_map(clusters: DataFrame, key: str = "window_id") -> DataFrame:
    """key, clusters: a map from each cluster's number to its assets in order."""
    inside = clusters.groupBy(key, "cluster").agg(F.array_sort(F.collect_list("asset")).alias("assets"))  # the assets of a window
    return inside.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cluster", "assets")))).alias("clusters"))
