"""Reports: curves, horizon tables, triage totals, seed means, schedule features, split checks, first warnings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.cells import SEGMENT, in_segment
from packetloom.operators.metrics import cumulated, macro_f1, ratio


def curves(scores: DataFrame, by: list[str], most: int = 120) -> DataFrame:
    """i, score, tpr, fpr, precision: at most `most` evenly indexed points of the ROC and PR curves, best score first."""
    g = scores.groupBy(*by, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"), F.lit(1).alias("one"))
    ends = g.groupBy(*by).agg(F.count("*").alias("_k"), F.sum("p").alias("_pos"), F.sum("n").alias("_neg"))
    at = cumulated(g, by, {"p": "tp", "n": "fp", "one": "i"}).withColumn("i", F.col("i") - 1).join(F.broadcast(ends), by)
    few = F.least(F.col("_k"), F.lit(most))
    picks = F.transform(F.sequence(F.lit(0), few - 1), lambda m: F.floor(m * (F.col("_k") - 1) / F.greatest(few - 1, F.lit(1))))
    points = at.where(F.array_contains(picks, F.col("i")))
    return points.select(*by, "i", "score", ratio(F.col("tp"), F.col("_pos")).alias("tpr"), ratio(F.col("fp"), F.col("_neg")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def stage_horizon(pairs: DataFrame) -> DataFrame:
    """By k and method: macro F1, accuracy, accuracy on cells whose stage changes, counts. Columns k, method, stage, truth, pred."""
    moved = F.col("truth") != F.col("stage")
    changes = pairs.groupBy("k", "method").agg(F.avg(F.when(moved, (F.col("truth") == F.col("pred")).cast("int"))).alias("transition_acc"), F.count_if(moved).alias("n_transitions"))
    return macro_f1(pairs, ["k", "method"]).join(changes, ["k", "method"])


def malicious_segments(df: DataFrame) -> DataFrame:
    return df.withColumn("_bad", F.max("stage").over(Window.partitionBy(*SEGMENT))).where("_bad > 0").drop("_bad")


def triage_totals(table: DataFrame) -> DataFrame:
    """One row: what either channel catches and what it flags in vain."""
    sick, risk, odd = F.col("infected") == 1, F.col("by_risk"), F.col("by_anomaly")
    return table.agg(
        F.count("*").alias("slots"), F.count_if(sick).alias("infected"), F.count_if(sick & (risk | odd)).alias("caught"), F.count_if(sick & risk).alias("caught_by_risk"), F.count_if(sick & odd & ~risk).alias("caught_only_by_anomaly"),
        F.count_if(~sick & (risk | odd)).alias("false_alarms"), F.count_if(~sick & risk).alias("risk_only_false_alarms"), F.avg(F.when(~sick, (risk | odd).cast("int"))).alias("false_alarm_rate"),
    )


def over_seeds(results: DataFrame, values: list[str]) -> DataFrame:
    """Mean and population deviation of each value by method; NaN counts as missing."""
    v = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in values}
    return results.groupBy("method").agg(*[f(x).alias(f"{c}_{name}") for c, x in v.items() for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def wide(results: DataFrame, value: str, horizons: list[int]) -> DataFrame:
    """A row for each method with a column for each horizon."""
    return results.groupBy("method").pivot("k", horizons).agg(F.first(value)).select("method", *[F.col(str(k)).alias(f"h{k}") for k in horizons])


def schedule(df: DataFrame, seconds: int) -> DataFrame:
    """hour_sin, hour_cos, weekday (Monday 0) and elapsed (share of the capture's span) of each cell's start."""
    t = F.timestamp_seconds(F.col("wid") * seconds)
    turn = (F.hour(t) + F.minute(t) / 60) * (2 * math.pi / 24)
    ends = df.groupBy("capture").agg(F.min("wid").alias("_lo"), F.max("wid").alias("_hi"))
    span = F.greatest((F.col("_hi") - F.col("_lo")) * seconds, F.lit(1))
    return df.join(F.broadcast(ends), "capture").withColumns({"hour_sin": F.sin(turn), "hour_cos": F.cos(turn), "weekday": F.weekday(t), "elapsed": (F.col("wid") - F.col("_lo")) * seconds / span}).drop("_lo", "_hi")


def split_overlaps(df: DataFrame, split: str) -> DataFrame:
    """capture, a, b, overlap for the pairs of train, val and test that a capture has: whether a reaches into b in time."""
    r = df.where(F.col(split).isin("train", "val", "test")).groupBy("capture", split).agg(F.min("wid").alias("lo"), F.max("wid").alias("hi"))
    order = F.array_position(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col(split))
    a = r.select("capture", F.col(split).alias("a"), order.alias("_a"), "hi")
    b = r.select("capture", F.col(split).alias("b"), order.alias("_b"), "lo")
    return a.join(b, "capture").where("_a < _b").select("capture", "a", "b", (F.col("hi") >= F.col("lo")).alias("overlap"))


def first_warnings(scored: DataFrame, threshold: float) -> DataFrame:
    """The place of each segment's first cell at or above the threshold (null without)."""
    s = scored.withColumn("_pos", F.row_number().over(in_segment()) - 1)
    return s.groupBy(*SEGMENT).agg(F.min(F.when(F.col("risk") >= threshold, F.col("_pos"))).alias("first_warning"), F.count("*").alias("cells"))


def focus_segment(targets: DataFrame) -> DataFrame:
    """One row: the segment with most pre-attack cells, then most malicious ones, then the first by key."""
    s = targets.groupBy(*SEGMENT).agg(F.count_if(F.col("phase") == "pre_attack").alias("pre_attack"), F.count_if(F.col("stage") > 0).alias("malicious"))
    return s.orderBy(F.desc("pre_attack"), F.desc("malicious"), *SEGMENT).limit(1)


def with_hosts(alerts: DataFrame, df: DataFrame) -> DataFrame:
    """alerts with the capture and host of their segment (a number)."""
    hosts = df.groupBy("segment").agg(F.first("capture").alias("capture"), F.first("src_ip").alias("src_ip"))
    return alerts.join(hosts.hint("merge"), "segment", "left")


#: Each packet-level attribute with the flag of its absence (none: there or null) and the feature that it feeds.
ATTRIBUTES = [("ttl", "ttl_missing", "ttl_mean"), ("payload_sizes", "payload_missing", "log_payload_mean"), ("ip_fragment_flags", "frag_missing", "frag_frac"), ("iat_max", "iat_max_missing", "log_iat_max"), ("port_sweep_shape", None, "scan_seq_frac")]


def attribute_coverage(full: DataFrame, by: list[str]) -> DataFrame:
    """by, attribute, cells_carried, share, mean_when_carried (null where none is): one aggregate over the cells, whatever the number of attributes."""
    def told(name: str, flag: str | None, feature: str) -> Column:
        has = F.col(feature).isNotNull() & (F.lit(True) if flag is None else F.col(flag) == 0)
        return F.struct(F.lit(name).alias("attribute"), F.count_if(has).alias("cells_carried"), F.avg(has.cast("double")).alias("share"), F.avg(F.when(has, F.col(feature))).alias("mean_when_carried"))

    held = full.groupBy(*by).agg(*[told(*a).alias(a[0]) for a in ATTRIBUTES])
    return held.select(*by, F.explode(F.array(*[a[0] for a in ATTRIBUTES])).alias("x")).select(*by, "x.*")
