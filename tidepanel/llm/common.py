"""What the operators of this subpackage share: reading tables, Arrow batches, checkpoints, word bytes."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: 0x20 and 0x09-0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPACES = bytes([9, 10, 11, 12, 13])
_TO_SPACE = bytes(0x20 if b in _SPACES else b for b in range(256))
#: Folders that `cut` has written.
_CUTS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Bounds what one Arrow batch brings into a Python worker, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)


def once_per_worker(key, make):
    """What make() gave on its first call with this key in this Python worker; workers outlive tasks."""
    kept = sys.modules.setdefault("_tidepanel_worker", types.ModuleType("_tidepanel_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def latest_per_worker(token, make):
    """What make() gave on its first call with this token in this Python worker; what it gave for any other token goes, so that a worker
    that outlives a stage doesn't hold the models and tables of all stages."""
    kept = once_per_worker("latest", dict)
    if kept.get("token") != token:
        kept.clear()
        kept.update(token=token, value=make())
    return kept["value"]


def set_aside(df: DataFrame, names) -> tuple[DataFrame, list]:
    """df with other names for its columns that are called like one of names, in any case, and the columns that bring the old ones back."""
    taken = {n.lower() for n in names}
    new = {c: f"__own_{k}" for k, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in df.columns]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on this machine alone may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return once_per_worker("folder", lambda: tempfile.mkdtemp(prefix="cuts-"))
    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back, so that nothing before it runs again
    and the loss of an executor costs no more than a read. `drop_cuts` removes what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    _CUTS.append(path)
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Deletes all that `cut` has written from this driver; to be called once results are stored."""
    jvm = spark.sparkContext._jvm
    while _CUTS:
        path = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dominant(df: DataFrame, key: str, share: int = 2000) -> DataFrame:
    """The values of key that at least one row in `share` has: no more than `share` of them, whatever df's size."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = df.agg(F.count("*").alias("__all"))
    return counts.join(F.broadcast(total)).where(F.col("__n") * share >= F.col("__all")).select(key)


def join_one(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """left with the columns of right's row of the same key, null where there is none; right has one row for each key.

    Rows whose key dominates left never meet in one task: the rows of right for such keys, at most as many as `dominant` gives, are
    broadcast; all other rows are shuffled, those of dominating keys by a hash of their own."""
    values = [c for c in right.columns if c != key]
    hot = dominant(left, key) if hot is None else hot
    few = F.broadcast(right.join(F.broadcast(hot), key).select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__h_{c}") for c in values]))
    wide = left.join(few, F.col(key) == F.col("__hot"), "left")
    wide = wide.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key)))
    wide = wide.withColumn("__deal", F.when(F.col("__key").isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])).otherwise(F.lit(0)))
    rest = right.select(F.col(key).alias("__key"), F.lit(0).cast("long").alias("__deal"), *[F.col(c).alias(f"__r_{c}") for c in values])
    out = wide.join(rest, ["__key", "__deal"], "left")
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.coalesce(f"__h_{c}", f"__r_{c}").alias(c) for c in values])


def maybe_among(df: DataFrame, names, members: DataFrame, rows: int, most: int = 1 << 20) -> DataFrame:
    """df with __among: false only where the 64-bit column `names` is surely none of members' (a column `name` of `rows` values).

    One bit stands for a name, with 8 bits for each member and 64 * `most` bits at the most, broadcast as at most `most` pairs of
    numbers. Beyond some 8 * `most` members more and more others pass; nothing is ever lost."""
    words = 1
    while words < most and words * 8 < rows:
        words *= 2
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(71)), F.lit(words * 64))
    bits = members.select(place(F.col("name")).alias("at")).groupBy(F.shiftright("at", 6).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("__bits"))
    df = df.withColumn("__at", place(names))
    out = df.join(F.broadcast(bits), F.shiftright("__at", 6) == F.col("__word"), "left")
    found = F.call_function("shiftright", F.col("__bits"), (F.col("__at") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return out.withColumn("__among", F.coalesce(found, F.lit(False))).drop("__at", "__word", "__bits")


def free_memory() -> None:
    """Gives a worker's freed memory back to the machine; workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def raw_bytes(df: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a text column: what numbers of buckets are derived from."""
    got = df.agg(F.sum(F.octet_length(column)).alias("b")).first()
    return int(got["b"] or 0)


def spaced(data: bytes) -> bytes:
    """Every white-space byte becomes 0x20; offsets stay."""
    return data.translate(_TO_SPACE)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes other than 0x20."""
    word = np.empty(len(data) + 2, np.int8)
    word[0] = word[-1] = 0
    np.not_equal(data, 0x20, out=word[1:-1].view(np.bool_))
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number, zeros behind the end: a view of overlapping numbers, to be indexed or copied."""
    return np.ndarray(len(data) + 1, np.uint64, np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end), equal for equal runs wherever they stand.

    A run is cut into 8-byte pieces, last one padded, and the pieces are folded with mix64; the run's length goes in too.
    """
    eight = eights(data)
    length = ends - starts
    h = mix64(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(starts)), starts.copy()
    while len(live):
        left = ends[live] - at[live]
        piece = eight[at[live]]
        short = left < 8
        keep = np.where(short, (np.uint64(1) << (np.uint64(8) * np.minimum(left, 7).astype(np.uint64))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        h[live] = mix64(h[live] * np.uint64(0x9E3779B97F4A7C15) ^ (piece & keep))
        live = live[left > 8]
        at[live] += 8
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive entries, by doubling; len(x) - width + 1 results."""
    if len(x) < width:
        return x[:0]
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        rest = width - span
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out
