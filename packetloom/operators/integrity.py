"""Integrity checks: what time and identity alone can tell, causality, and benign traffic out of distribution."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators import models
from packetloom.operators.cells import SEGMENT
from packetloom.operators.metrics import ranking
from packetloom.operators.reports import schedule


def identity_probe(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: average precision on test of the smoothed rate of each capture in train, and test's prevalence."""
    rate = train.groupBy("capture").agg(((F.sum("y_future") + 1) / (F.count("*") + 2)).alias("_rate"))
    t = test.join(rate, "capture", "left").select(F.lit(1).alias("_all"), F.col("y_future").alias("y"), F.round(F.coalesce("_rate", F.lit(0.5)), 9).alias("score"))
    return ranking(t, ["_all"]).join(t.groupBy("_all").agg(F.avg("y").alias("prevalence")), "_all").select("ap", "prevalence")


def schedule_probe(train: DataFrame, test: DataFrame, seconds: int, model_ap: float, kind: str = "forest") -> DataFrame:
    """One row: average precision of a classifier that knows only the time, its share of the model's lift over prevalence, and the verdict on that share."""
    inputs = F.array("hour_sin", "hour_cos", F.col("weekday").cast("double"), F.col("elapsed").cast("double"))
    own = lambda df: schedule(df, seconds).withColumn("x", inputs)
    scores = models.score(models.fit(own(train), "x", "y_future", kind), own(test), "x").select(F.lit(1).alias("_all"), F.col("y_future").alias("y"), F.round("score", 9).alias("score"))
    out = ranking(scores, ["_all"]).join(scores.groupBy("_all").agg(F.avg("y").alias("prevalence")), "_all")
    share = F.greatest(F.lit(0.0), (F.col("ap") - F.col("prevalence")) / F.greatest(F.lit(model_ap) - F.col("prevalence"), F.lit(1e-9)))
    return out.select("ap", "prevalence", share.alias("share"), F.when(share < 0.25, "ok").when(share < 0.5, "notice").otherwise("warning").alias("verdict"))


def causality(df: DataFrame, column: str, pipeline: Callable[[DataFrame], DataFrame], outputs: list[str], cut: int) -> DataFrame:
    """One row: cells up to wid `cut`, how many of their outputs change when later inputs do, and whether later outputs react."""
    key = [*SEGMENT, "wid"]
    changed = pipeline(df.withColumn(column, F.col(column) + F.when(F.col("wid") > cut, 1.0).otherwise(0.0)))
    both = pipeline(df).select(*key, *[F.col(c).alias(f"{c}_a") for c in outputs]).join(changed.select(*key, *[F.col(c).alias(f"{c}_b") for c in outputs]).hint("merge"), key)
    moved = F.lit(False)
    for c in outputs:
        moved = moved | ~F.round(f"{c}_a", 9).eqNullSafe(F.round(f"{c}_b", 9))
    before = F.col("wid") <= cut
    return both.agg(F.count_if(before).alias("kept"), F.count_if(before & moved).alias("changed_before"), (F.count_if(~before & moved) > 0).alias("reacts"))


def shared_captures(df: DataFrame, column: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """left, right, capture: the captures that two splits have in common. df is read once, to a row for each capture."""
    held = df.where(F.col(column).isin(*splits)).groupBy("capture").agg(F.collect_set(column).alias("_held"))
    pairs = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for i, a in enumerate(splits) for b in splits[i + 1 :]])
    both = lambda p: F.array_contains(F.col("_held"), p["left"]) & F.array_contains(F.col("_held"), p["right"])
    return held.select("capture", F.explode(F.filter(pairs, both)).alias("p")).select("p.left", "p.right", "capture")


def truncation(df: DataFrame, pipeline: Callable[[DataFrame], DataFrame], outputs: list[str], cut: int) -> DataFrame:
    """The rows (key and outputs, rounded) up to wid `cut` that the pipeline gives for all of df but not for df without what follows the cut: what its
    outputs know of the future. Causal outputs give no rows."""
    seen = lambda rows: rows.where(F.col("wid") <= cut).select(*SEGMENT, "wid", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in outputs])
    return seen(pipeline(df)).exceptAll(seen(pipeline(df.where(F.col("wid") <= cut))))


def least_shifts(params: DataFrame, k: int = 3) -> dict[str, float]:
    """The k columns of least scale (ties by name), each with a push far outside its range. params: one row for each column (column, scale)."""
    return {r["column"]: 20 * r["scale"] + 1 for r in params.orderBy("scale", "column").limit(k).collect()}


def out_of_distribution(df: DataFrame, score: Callable[[DataFrame], Column], threshold: float, volumes: list[str], shifts: dict[str, float], factor: float = 5.0) -> DataFrame:
    """variant, rate, fine: alert rates on benign segments as they are, with a flash crowd (log volumes raised) and with features shifted; fine up to
    three times the original rate, 5 % at least."""
    benign = df.withColumn("_worst", F.max("stage").over(Window.partitionBy(*SEGMENT))).where("_worst = 0").drop("_worst")
    crowd = benign.withColumns({c: F.col(c) + math.log(factor) for c in volumes}).withColumn("variant", F.lit("flash_crowd"))
    moved = benign.withColumns({c: F.col(c) + by for c, by in shifts.items()}).withColumn("variant", F.lit("shifted"))
    every = benign.withColumn("variant", F.lit("original")).unionByName(crowd).unionByName(moved)
    rates = every.groupBy("variant").agg(F.avg((score(every) >= threshold).cast("int")).alias("rate"))
    base = rates.where("variant = 'original'").select(F.col("rate").alias("_base"))
    return rates.crossJoin(F.broadcast(base)).select("variant", "rate", (F.col("rate") <= F.greatest(3 * F.col("_base"), F.lit(0.05))).alias("fine"))  # one row
