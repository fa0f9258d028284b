"""Price panels from fact tables, long form: asset, dt, price."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_prices(spark: SparkSession, sf_dir: str, grain: str = "month") -> DataFrame:
    """Unit price of each supplier nation and period. Sums are exact decimals, so the order of rows doesn't matter."""
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    nations = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("asset"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    period = F.to_date(F.date_trunc(grain, F.col("l_shipdate").cast("timestamp"))).alias("dt")
    return items.join(nations, "l_suppkey").groupBy("asset", period).agg((exact("l_extendedprice") / exact("l_quantity")).alias("price"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on this machine alone may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "_tidepanel_folder" not in spark.__dict__:
        spark.__dict__["_tidepanel_folder"] = tempfile.mkdtemp(prefix="panels-")
    return spark.__dict__["_tidepanel_folder"]


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what follows is planned on a plain scan, and a lost executor costs a read."""
    path = f"{shared_folder(df.sparkSession)}/panel-{uuid.uuid4().hex}"
    df.sparkSession.__dict__.setdefault("_tidepanel_paths", []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def once(spark: SparkSession, key: tuple, make) -> DataFrame:
    """What make() gives, stored under a key of this session. For panels, windows of them and what studies find in these, which are small
    beside the fact tables they come from. A session sees the tables as they were at the first call."""
    kept = spark.__dict__.setdefault("_tidepanel_kept", {})
    if key not in kept:
        kept[key] = stored(make())
    return kept[key]


def forget(spark: SparkSession) -> None:
    """Deletes all that was stored in this session."""
    spark.__dict__.pop("_tidepanel_kept", None)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in spark.__dict__.pop("_tidepanel_paths", []):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to all shuffle partitions. Adaptive execution joins partitions of few bytes, and kernels that take seconds a
    group would run one after the other."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide file, first column the date and one column for each asset, as long rows; empty cells are null."""
    wide = spark.read.csv(path, header=True)
    day, *assets = wide.columns
    return wide.unpivot([day], assets, "asset", "price").select("asset", F.to_date(day).alias("dt"), F.col("price").cast("double").alias("price"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sector, asset: nations by region."""
    return read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("cluster"), F.col("n_nationkey").cast("int").alias("asset"))
