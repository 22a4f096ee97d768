"""Calibration and evaluation over long score tables (method, y, score); all grouped, none collects rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators import scans
from packetloom.operators.cells import in_segment
from packetloom.sources import shared


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(scores: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    on, y = F.col("score") >= threshold, F.col("y") == 1
    c = scores.groupBy(*by).agg(F.count_if(on & y).alias("tp"), F.count_if(on & ~y).alias("fp"), F.count_if(~on & y).alias("fn"), F.count_if(~on & ~y).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * p * r, p + r)).withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def cumulated(g: DataFrame, by: list[str], sums: dict[str, str], bins: int = 4096) -> DataFrame:
    """g with running sums from the best score down. Totals of bins first: a window holds the bins of a group, or the scores of a bin."""
    g = g.withColumn("_bin", F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * bins))
    above = Window.partitionBy(*by).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    tops = g.groupBy(*by, "_bin").agg(*[F.sum(c).alias(c) for c in sums])
    tops = tops.select(*by, "_bin", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in sums])
    w = Window.partitionBy(*by, "_bin").orderBy(F.desc("score"))
    return g.join(tops, [*by, "_bin"]).withColumns({name: F.sum(c).over(w) + F.col(f"_{c}") for c, name in sums.items()}).drop("_bin", *[f"_{c}" for c in sums])


def counted(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, score, p, n: how many rows with and without y have each score; scores has y, or p and n that were counted before."""
    p, n = (F.sum("p"), F.sum("n")) if "y" not in scores.columns else (F.sum("y"), F.sum(1 - F.col("y")))
    return scores.groupBy(*by, "score").agg(p.alias("p"), n.alias("n"))


def ranking(scores: DataFrame, by: list[str]) -> DataFrame:
    """Average precision and ROC-AUC with ties, from distinct scores (see counted)."""
    g = counted(scores, by)
    g = cumulated(g, by, {"p": "tp", "n": "fp"})
    pos, neg = F.sum("p"), F.sum("n")
    return g.groupBy(*by).agg(F.when(pos > 0, F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / pos).alias("ap"), F.when((pos > 0) & (neg > 0), F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / F.lit(2.0))) / (pos * neg)).alias("auc"))


def thresholds(scores: DataFrame, max_fpr: float, by: list[str], candidates: int = 501) -> DataFrame:
    """The threshold of best F1 under a false-positive budget, or of the lowest false-positive rate where none holds it; the least on ties, among quantiles of the scores.
    Candidates join the distinct scores as rows without labels, and one running sum from the best score down counts what each would flag."""
    g = shared.kept(counted(scores, by).withColumn("c", F.col("p") + F.col("n")), "scores")
    totals = g.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    asked = scans.quantiles_of_counts(g.withColumnRenamed("score", "value").where("value IS NOT NULL"), by, candidates - 1).select(*by, F.col("value").alias("score"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked"))
    g = g.drop("c").withColumn("asked", F.lit(0)).unionByName(asked).groupBy(*by, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("asked").alias("asked"))
    cand = cumulated(g, by, {"p": "tp", "n": "fp"}).where("asked = 1").drop("p", "n")
    cand = cand.join(totals, by)
    f1 = F.round(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), 9)
    cand = cand.withColumn("f1", f1).withColumn("fpr", ratio(F.col("fp"), F.col("neg")))
    holds = F.col("fpr") <= max_fpr
    rank = F.struct(holds.alias("holds"), F.when(holds, F.col("f1")).otherwise(-F.col("fpr")).alias("worth"), (-F.col("score")).alias("least"))
    best = cand.groupBy(*by).agg(F.max_by(F.struct(F.col("score").alias("threshold"), "f1", "fpr"), rank).alias("x"))
    return best.select(*by, "x.*")


def phase_rates(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.groupBy("phase").agg(F.count("*").alias("cells"), F.avg((F.col("risk") >= threshold).cast("int")).alias("alert_rate"))


def lead_times(scored: DataFrame, threshold: float, horizon: int) -> DataFrame:
    """A row for each incident: how many cells right before it were alerted, horizon at most."""
    w = in_segment()
    s = scored.withColumn("pos", F.row_number().over(w) - 1).withColumn("alert", F.col("risk") >= threshold)
    s = s.withColumn("_past", F.coalesce(F.max("exploit_now").over(w.rowsBetween(-horizon, -1)), F.lit(0))).withColumn("_off", F.coalesce(F.max(F.when(~F.col("alert"), F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    return s.where((F.col("exploit_now") == 1) & (F.col("pos") > 0) & (F.col("_past") == 0)).withColumn("lead", F.least(F.lit(horizon), F.col("pos") - F.col("_off") - 1).cast("long"))


def macro_f1(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Macro F1 over the classes present in truth or prediction, and accuracy; columns truth, pred."""
    c = pairs.groupBy(*by, "truth", "pred").agg(F.count("*").alias("n"))
    sides = c.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("_class"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("_class"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), "n", (F.col("truth") == F.col("pred")).alias("hit"))
    per = sides.groupBy(*by, F.col("s._class").alias("_class")).agg(F.sum(F.when(F.col("hit") & (F.col("s.t") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("both"))
    acc = c.groupBy(*by).agg((F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    return per.groupBy(*by).agg(F.avg(2 * F.col("tp") / F.col("both")).alias("macro_f1")).join(acc, by)
