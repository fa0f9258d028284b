"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

#: Per source, shuffled documents fall into GRID x GRID ranges of their hash, and the queue into QUEUE ranges per unit of finish time.
GRID, QUEUE = 64, 2048


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share=1.5, repeats=2) -> DataFrame:
    """(skey, source, source_size) -> the same with weight and target.

    Weights repeat over the sources in code-point order, null last. Together the targets make share times all words;
    none exceeds repeats times its source, and what that cuts off is shared out again by weight. Filling in order of
    cap / weight finds the common level in one pass. There is one row for each source here, not for each document.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    by_level = every.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        caps.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("left"))
        .withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    )
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return level.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * common)).select("skey", "source", "source_size", "weight", "target", "budget")


def mix_to_weights(docs: DataFrame, weights=(5, 2, 1), share=1.5, repeats=2, seed="mix", carry=()) -> DataFrame:
    """How many words a mix takes from each document: doc_id, source, size, source_size, target, taken, copies.

    Documents of a source are shuffled by md5 of their id. Each of up to `repeats` passes over the source gives a document
    a virtual finish time: the source's words up to and with it, divided by the source's target. All are sorted by that time
    and taken, whole, until the next would exceed the total budget. Prefix sums go by ranges of the hash and of the time,
    so no source and no queue is ever in one task.

    Nulls: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is shuffled like an id.
    Rows that agree in id, source and size are interchangeable: which of them is taken is undetermined, how many is not.
    An empty table gives no rows. Columns named in carry come along with their rows; others are ignored.
    """
    sized = docs.select("doc_id", "source", *carry, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long").alias("size"))
    # a hash's hexadecimal digits in order are the shuffled order of a source's documents
    keyed = sized.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("h", F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    top = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")  # 12 bits: GRID x GRID ranges in the hash's order
    keyed = keyed.withColumn("coarse", F.floor(top / GRID).cast("int")).withColumn("fine", top % GRID)
    keyed = cut(keyed)  # a few numbers for each document; texts are read and counted once

    fine = keyed.groupBy("skey", "coarse", "fine").agg(F.sum("size").alias("words"), F.max("source").alias("source"))
    coarse = fine.groupBy("skey", "coarse").agg(F.sum("words").alias("words"), F.max("source").alias("source"))
    sources = source_targets(coarse.groupBy("skey").agg(F.max("source").alias("source"), F.sum("words").alias("source_size")), weights, share, repeats)
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    coarse_at = coarse.select("skey", "coarse", F.coalesce(F.sum("words").over(before("skey", "coarse")), zero).alias("coarse_at"))
    offsets = (
        fine.select("skey", "coarse", "fine", F.coalesce(F.sum("words").over(before("skey", "coarse", "fine")), zero).alias("fine_at"))
        .join(coarse_at, ["skey", "coarse"])
        .join(sources.drop("source"), "skey")
        .withColumn("at", F.col("coarse_at") + F.col("fine_at"))
        .drop("coarse_at", "fine_at")
    )
    cell = Window.partitionBy("skey", "coarse", "fine").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        keyed.withColumn("row", F.row_number().over(cell))
        .withColumn("within", F.sum("size").over(cell))
        .join(offsets, ["skey", "coarse", "fine"])
        .withColumn("cum", F.col("at") + F.col("within"))
        .withColumn("pass", F.explode(F.array(*[F.lit(k) for k in range(repeats)])))
        .withColumn("finish", F.when(F.col("target") > 0, (F.col("pass") * F.col("source_size") + F.col("cum")) / F.col("target")).otherwise(F.lit(0.0)))
        .withColumn("slot", F.least(F.floor(F.col("finish") * QUEUE), F.lit(4 * QUEUE)).cast("int"))
    )
    queued = cut(queued.select("doc_id", "source", *carry, "size", "skey", "coarse", "fine", "row", "h", "source_size", "target", "budget", "pass", "finish", "slot"))
    slots = queued.groupBy("slot").agg(F.sum("size").alias("words"))  # at most 4 * QUEUE + 1 rows
    slot_at = slots.select("slot", F.coalesce(F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("slot_at"))
    turn = Window.partitionBy("slot").orderBy("finish", "skey", "pass", "h", "row").rowsBetween(Window.unboundedPreceding, 0)
    served = (
        queued.withColumn("in_slot", F.sum("size").over(turn))
        .join(F.broadcast(slot_at), "slot")
        .withColumn("took", (F.col("slot_at") + F.col("in_slot") <= F.col("budget")).cast("int"))
    )
    one = lambda c: F.first(c).alias(c)
    return (
        served.groupBy("skey", "coarse", "fine", "row")
        .agg(one("doc_id"), one("source"), *map(one, carry), one("size"), one("source_size"), one("target"), F.sum(F.col("size") * F.col("took")).alias("taken"), F.sum("took").cast("int").alias("copies"))
        .drop("skey", "coarse", "fine", "row")
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that the mix takes, those it takes twice two times, with the columns of docs. Rows that agree in id and text
    are interchangeable."""
    names = docs.columns
    same = ["__did", "__key"]
    keyed = docs.withColumn("__did", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("__key", F.xxhash64("text"))
    taken = mix_to_weights(keyed, carry=same, **settings).where("copies > 0").groupBy(*same).agg(F.sort_array(F.collect_list("copies"), False).alias("__copies"))
    numbered = keyed.withColumn("__row", F.row_number().over(Window.partitionBy(*same).orderBy("source")))
    kept = numbered.join(taken, same).where(F.col("__row") <= F.size("__copies"))
    return kept.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.element_at("__copies", F.col("__row"))))).select(*[f"`{c}`" for c in names])
