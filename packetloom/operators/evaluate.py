"""Evaluation of many methods at once, over one long table (cell keys, phase, exploit_now, y, method, score, threshold)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.cells import SEGMENT
from packetloom.operators.metrics import ranking, ratio


def methods(scores: DataFrame, horizon: int) -> DataFrame:
    """A row for each method: confusion, ranking overall and early (exploit_now = 0), alert rates by phase, lead times."""
    on, y = F.col("score") >= F.col("threshold"), F.col("y") == 1
    tp, fp, fn, tn = F.count_if(on & y), F.count_if(on & ~y), F.count_if(~on & y), F.count_if(~on & ~y)
    rate = lambda p, name: F.avg(F.when(F.col("phase") == p, on.cast("int"))).alias(name)
    flat = scores.groupBy("method").agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr"),
        rate("benign", "rate_benign"), rate("pre_attack", "rate_pre_attack"), rate("during_attack", "rate_during"),
    )
    early = ranking(scores.where("exploit_now = 0"), ["method"]).select("method", F.col("ap").alias("ap_early"), F.col("auc").alias("auc_early"))
    return flat.join(ranking(scores, ["method"]), "method").join(early, "method", "left").join(leads(scores, horizon), "method", "left")


def leads(scores: DataFrame, horizon: int) -> DataFrame:
    """incidents, mean and median of their lead times in cells, and the share that was warned of at all, by method."""
    w = Window.partitionBy("method", *SEGMENT).orderBy("wid")
    s = scores.withColumn("pos", F.row_number().over(w) - 1)
    past = F.coalesce(F.max("exploit_now").over(w.rowsBetween(-horizon, -1)), F.lit(0))
    off = F.coalesce(F.max(F.when(F.col("score") < F.col("threshold"), F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    s = s.withColumn("_past", past).withColumn("lead", F.least(F.lit(horizon), F.col("pos") - off - 1)).where("exploit_now = 1 AND pos > 0 AND _past = 0")
    return s.groupBy("method").agg(F.count("*").alias("incidents"), F.avg("lead").alias("lead_mean"), F.percentile("lead", 0.5).alias("lead_median"), F.avg((F.col("lead") > 0).cast("int")).alias("warned"))


def summary(evaluated: DataFrame) -> DataFrame:
    return evaluated.select("method", "f1", "ap", "fpr", "ap_early", "lead_mean", "warned")


def compared(runs: dict[str, DataFrame], labels: DataFrame, checks: DataFrame) -> DataFrame:
    """Summaries of several data sets under one roof: dataset, its label (columns dataset, label) and how many of its checks (dataset, fine) are flagged."""
    out = None
    for name, run in sorted(runs.items()):
        run = run.withColumn("dataset", F.lit(name))
        out = run if out is None else out.unionByName(run, allowMissingColumns=True)
    flagged = checks.groupBy("dataset").agg(F.count_if(~F.col("fine")).alias("flagged"))
    return out.join(labels, "dataset", "left").join(flagged, "dataset", "left").withColumn("flagged", F.coalesce("flagged", F.lit(0)))


def subset(df: DataFrame, benign: int) -> DataFrame:
    """Cells of all segments that ever go malicious and of `benign` others, the first by hash of their key."""
    s = df.groupBy(*SEGMENT).agg(F.max("stage").alias("_worst"))
    some = s.where("_worst = 0").orderBy(F.md5(F.concat_ws("|", *SEGMENT)), *SEGMENT).limit(benign)
    return df.join(s.where("_worst > 0").unionByName(some).select(*SEGMENT), SEGMENT, "left_semi")


def channel_aucs(scored: DataFrame) -> DataFrame:
    """level (cell, host), channel (risk, surprise), auc: against y_future by cell, against ever malicious by segment."""
    host = scored.groupBy(*SEGMENT).agg(F.max((F.col("stage") > 0).cast("int")).alias("y"), F.max("risk").alias("risk"), F.avg("surprise").alias("surprise"))
    both = lambda df, level, y: df.select(F.lit(level).alias("level"), F.col(y).alias("y"), F.explode(F.create_map(F.lit("risk"), F.col("risk"), F.lit("surprise"), F.col("surprise"))).alias("channel", "score"))
    every = both(scored, "cell", "y_future").unionByName(both(host, "host", "y")).withColumn("score", F.round("score", 9))
    return ranking(every, ["level", "channel"]).select("level", "channel", "auc")


def ablation(df: DataFrame, combos: dict[str, list[str]]) -> DataFrame:
    """combo, ap, auc of the mean of each combination of score columns (column y)."""
    each = [F.struct(F.lit(name).alias("combo"), F.round(sum((F.col(c) for c in parts[1:]), F.col(parts[0])) / len(parts), 6).alias("score")) for name, parts in combos.items()]
    return ranking(df.select("y", F.explode(F.array(*each)).alias("m")).select("y", "m.*"), ["combo"])
