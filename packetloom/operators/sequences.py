"""Cells to training rows: contexts, sequences, balanced samples, class weights, volume surges, episode splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators import scans
from packetloom.operators.cells import SEGMENT, in_segment
from packetloom.operators.risk import draw


def whole() -> Window:
    return Window.partitionBy(*SEGMENT)


def context(df: DataFrame, column: str, steps: int) -> DataFrame:
    """context: the last `steps` values, oldest first; the segment's first value stands for what is before it."""
    seen = F.collect_list(column).over(in_segment().rowsBetween(1 - steps, 0))
    return df.withColumn("_seen", seen).withColumn("context", F.concat(F.array_repeat(F.col("_seen")[0], steps - F.size("_seen")), "_seen")).drop("_seen")


def waves(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df by segment (windows over segments shuffle no more), in as many parts as tasks run at once, or in a multiple of that where parts would have more rows than that: a model
    passes over the parts hundreds of times, and each pass would wait for a part more than tasks."""
    at_once = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(at_once * max(1, -(-df.count() // (at_once * rows))), *SEGMENT)


def training_sequences(df: DataFrame, column: str, steps: int, ahead: int, benign_stride: int = 1) -> DataFrame:
    """sequence and mask of steps + ahead places around each cell, clamped to the segment; every benign_stride-th cell of segments without a positive."""
    w = in_segment()
    out = df.withColumn("_pos", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole()))
    out = out.withColumn("_bad", F.max(((F.col("stage") > 0) | (F.col("y_future") > 0)).cast("int")).over(whole())).withColumn("_seen", F.collect_list(column).over(w.rowsBetween(1 - steps, ahead)))
    out = out.where((F.col("_bad") == 1) | (F.col("_pos") % benign_stride == 0))
    before = F.greatest(steps - 1 - F.col("_pos"), F.lit(0)).cast("int")
    after = F.greatest(F.col("_pos") + ahead - F.col("_n") + 1, F.lit(0)).cast("int")
    size = F.size("_seen")
    values = F.concat(F.array_repeat(F.col("_seen")[0], before), "_seen", F.array_repeat(F.element_at("_seen", -1), after))
    mask = F.concat(F.array_repeat(F.lit(0), before), F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), after))
    return out.withColumn("sequence", values).withColumn("mask", mask).drop("_pos", "_n", "_bad", "_seen")


def balanced_sample(df: DataFrame, target: str, cap: int, key: list[str]) -> DataFrame:
    """Up to cap rows: positives (half of cap at most) and negatives for the rest, by a hash of the key."""
    counts = df.agg(F.count("*").alias("n"), F.count_if(F.col(target) > 0).alias("p")).first()
    if counts["n"] <= cap:
        return df
    first = lambda rows, k: rows.orderBy(F.md5(F.concat_ws("|", *key)), *key).limit(k)
    pos, neg = df.where(F.col(target) > 0), df.where(F.col(target) <= 0)
    return (first(pos, cap // 2) if counts["p"] > cap // 2 else pos).unionByName(first(neg, max(cap - counts["p"], cap // 2)))


def class_weights(df: DataFrame, classes: int = 7) -> DataFrame:
    """stage, weight: the root of total over frequency (one added to each count), with mean one."""
    counts = df.groupBy("stage").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("stage")).join(counts, "stage", "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    total = every.agg(F.sum("n").alias("total"))
    raw = every.join(F.broadcast(total)).select("stage", F.sqrt(F.col("total") / F.col("n")).alias("weight"))
    return raw.join(F.broadcast(raw.agg(F.avg("weight").alias("_mean")))).select("stage", (F.col("weight") / F.col("_mean")).alias("weight"))


def surge(df: DataFrame, columns: list[str], least: float, most: float) -> DataFrame:
    """Log volumes of benign segments raised by a factor drawn for each segment; labels stay."""
    factor = F.log(least + (most - least) * draw(F.lit("surge"), *SEGMENT))
    out = df.withColumn("_bad", F.max("stage").over(whole()))
    return out.withColumns({c: F.col(c) + F.when(F.col("_bad") == 0, factor).otherwise(0.0) for c in columns}).drop("_bad")


def episode_split(df: DataFrame, train: float, val: float) -> DataFrame:
    """Whole segments of a capture to train, val, test in order of their first cell."""
    first = scans.ranked(df.groupBy(*SEGMENT).agg(F.min("wid").alias("_from")), ["capture"], ["_from", "src_ip", "run"], "_i")
    first = first.join(first.groupBy("capture").agg(F.count("*").alias("_n")), "capture")
    a = F.greatest(F.bround(F.col("_n") * F.lit(train)), F.lit(1.0))
    b = F.greatest(F.least(F.bround(F.col("_n") * F.lit(train + val)), F.col("_n") - 1), F.lit(1.0))
    named = first.select(*SEGMENT, F.when(F.col("_i") < a, "train").when(F.col("_i") < b, "val").otherwise("test").alias("split_temporal"))
    return df.join(named, SEGMENT)
