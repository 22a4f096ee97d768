"""Fusion weights, ensembles, selection scores and resampling, over score tables; grids and replicates are rows, aggregates come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators import scans
from packetloom.operators.metrics import counted, cumulated, ranking, ratio, thresholds
from packetloom.operators.risk import draw
from packetloom.sources import shared


def simplex(step: float) -> list[tuple[float, float, float]]:
    """Weights of three parts that sum to one."""
    n = round(1 / step)
    return [(i / n, j / n, (n - i - j) / n) for i in range(n + 1) for j in range(n + 1 - i)]


def weighted(parts: list[str], weights: list[Column], digits: int = 6) -> Column:
    return F.round(sum((F.col(c) * w for c, w in zip(parts, weights, strict=True)), F.lit(0.0)), digits)


def to_digits(x: Column, digits: int) -> Column:
    """x to so many digits by binary arithmetic, halves as the product falls (the same in any engine)."""
    return F.floor(x * float(10**digits) + 0.5) / F.lit(float(10**digits))


def fusion(df: DataFrame, parts: list[str], step: float = 0.1) -> DataFrame:
    """w0, w1, w2, ap: the weights of three score columns with the best average precision on cells not yet exploited (columns y, exploit_now); the first of the grid on ties."""
    few = df.where("exploit_now = 0").groupBy(*parts).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(x).alias(f"w{k}") for k, x in enumerate(w)]) for i, w in enumerate(simplex(step))])).alias("g")
    g = few.select(grid, *parts, "p", "n").select("g.*", weighted(parts, [F.col(f"g.w{k}") for k in range(3)]).alias("score"), "p", "n")
    ap = precision_of(g.groupBy("i", "w0", "w1", "w2", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ["i", "w0", "w1", "w2"])
    return ap.orderBy(F.desc(F.round("ap", 9)), "i").limit(1).select("w0", "w1", "w2", "ap")


def precision_of(g: DataFrame, by: list[str]) -> DataFrame:
    """Average precision from p and n at each score."""
    g = cumulated(g, by, {"p": "tp", "n": "fp"})
    return g.groupBy(*by).agg(F.when(F.sum("p") > 0, F.sum(ratio(F.col("p") * F.col("tp"), F.col("tp") + F.col("fp"))) / F.sum("p")).alias("ap"))


def few(df: DataFrame, parts: list[str]) -> DataFrame:
    """parts, exploit_now, p, n: how many cells with and without y have each combination of scores, written once. Grids multiply these, not the cells."""
    return shared.kept(df.groupBy(*parts, "exploit_now").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")), "few")


def selection(scores: DataFrame, by: list[str]) -> DataFrame:
    """The mean of average precision early (exploit_now = 0) and over all; the one that there is, else 0. scores has y, or p and n that were counted before."""
    g = counted(scores, [*by, "exploit_now"])
    all_, early = ranking(g, by).select(*by, F.col("ap").alias("ap_all")), ranking(g.where("exploit_now = 0"), by).select(*by, F.col("ap").alias("ap_early"))
    both = all_.join(early, by, "left")
    return both.withColumn("selection", F.coalesce((F.col("ap_all") + F.col("ap_early")) / 2, "ap_all", "ap_early", F.lit(0.0)))


def mixtures(df: DataFrame, fused: str, partners: list[str], step: float = 0.1) -> DataFrame:
    """partner, weight, score, exploit_now, p, n: the score of each weight of `fused` beside each partner, over counts of equal scores."""
    n = round(1 / step)
    out = None
    for c in partners:
        grid = F.explode(F.array(*[F.struct(F.lit(c).alias("partner"), F.lit(i / n).alias("weight"), F.round(F.col(fused) * (i / n) + F.col(c) * (1 - i / n), 6).alias("score")) for i in range(n + 1)])).alias("g")
        part = few(df, [fused, c]).select("exploit_now", "p", "n", grid).select("exploit_now", "p", "n", "g.*")
        out = part if out is None else out.unionByName(part)
    return out


def ensemble(df: DataFrame, fused: str, partners: list[str], step: float = 0.1, max_fpr: float = 0.05) -> DataFrame:
    """One row: the partner and the weight of `fused` with the best selection score, and the threshold that goes with them. On a stored table it recalibrates."""
    scores = mixtures(df, fused, partners, step)
    best = selection(scores, ["partner", "weight"]).orderBy(F.desc(F.round("selection", 9)), "partner", F.desc("weight")).limit(1)
    (r,) = best.collect() or [None]
    if r is None:
        return best.select("partner", "weight", "selection", *[F.lit(None).cast("double").alias(c) for c in ("threshold", "f1", "fpr")])
    own = scores.where((F.col("partner") == r["partner"]) & (F.col("weight") == r["weight"]))
    return thresholds(own, max_fpr, ["partner", "weight"]).withColumn("selection", F.lit(r["selection"]))


def best_run(results: DataFrame) -> DataFrame:
    """run, selection of the run with the best selection score; the first by name on ties."""
    return results.orderBy(F.desc("selection"), "run").limit(1).select("run", "selection")


def bootstrap(scores: DataFrame, threshold: float, unit: list[str], replicates: int = 200, digits: int = 2) -> DataFrame:
    """metric, low, high: 2.5 and 97.5 % points of f1, recall, fpr and ap over resampled units. Columns unit, y, score; ap on scores at so many digits."""
    held = scores.groupBy(*unit, to_digits(F.col("score"), digits).alias("score"), (F.col("score") >= threshold).alias("on")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    units = scans.ranked(scores.select(*unit).distinct(), [], unit, "_i")
    count = units.count()
    picks = scores.sparkSession.range(replicates * count).select(F.floor(F.col("id") / count).alias("b"), F.floor(draw(F.floor(F.col("id") / count), F.pmod("id", F.lit(count))) * count).alias("_i"))
    weights = picks.groupBy("b", "_i").agg(F.count("*").alias("w"))
    each = held.join(units, unit).join(weights, "_i").groupBy("b", "score", "on").agg(F.sum(F.col("p") * F.col("w")).alias("p"), F.sum(F.col("n") * F.col("w")).alias("n"))
    on = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    tp, fp, fn, tn = on("p", F.col("on")), on("n", F.col("on")), on("p", ~F.col("on")), on("n", ~F.col("on"))
    flat = each.groupBy("b").agg(ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr"))
    flat = flat.join(precision_of(each.groupBy("b", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ["b"]), "b")
    long = flat.select(F.explode(F.create_map(*[x for c in ("f1", "recall", "fpr", "ap") for x in (F.lit(c), F.col(c))])).alias("metric", "v"))
    return long.groupBy("metric").agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))


def permutation(scores: DataFrame, key: list[str], replicates: int = 200) -> DataFrame:
    """One row: the observed average precision and the share of label shuffles that reach it. A shuffle gives the labels to the rows of the least draws.
    Draws are even, so the last of these lies near the share of labels: rows clearly below are counted by score in the pass that draws, and only those
    near it are ranked. Rows at a score or above are the same many in each shuffle."""
    rows = shared.kept(scores.select("score", "y", F.concat_ws("|", *key).alias("_key"), *key), "permuted")
    counts = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    spread = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: a small file would be one task's
    share, total = counts["p"] / max(counts["n"], 1), max(counts["n"], 1)
    for wide in (8, 32, total):  # deviations; the last takes all rows
        off = wide * ((share * (1 - share) / total) ** 0.5 + 1 / total)
        drawn = rows.repartition(spread, "_key").select("score", *key, "_key", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).withColumn("u", draw(F.col("rep"), "_key")).where(F.col("u") < share + off)
        at = F.when(F.col("u") >= share - off, F.struct("u", *key)).alias("at")
        g = shared.kept(drawn.groupBy("rep", "score", at).agg(F.count("*").alias("p")), "drawn")
        sides = g.groupBy("rep").agg(F.sum(F.when(F.col("at").isNull(), F.col("p")).otherwise(0)).alias("sure"), F.sum("p").alias("reached"))
        told = sides.agg(F.count("*").alias("k"), F.count_if((F.col("sure") > counts["p"]) | (F.col("reached") < counts["p"])).alias("missed")).first()
        if not counts["p"] or (told["k"] == replicates and not told["missed"]):
            break
    order = Window.partitionBy("rep").orderBy("at.u", *[f"at.{c}" for c in key])
    edge = g.where("at IS NOT NULL").withColumn("_place", F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(F.broadcast(sides), "rep").where(F.col("_place") <= counts["p"] - F.col("sure"))  # sides: a row for each replicate
    picked = g.where("at IS NULL").select("rep", "score", "p").unionByName(edge.select("rep", "score", "p")).groupBy("rep", "score").agg(F.sum("p").alias("p"))
    above = cumulated(rows.groupBy(F.lit(0).alias("_all"), "score").agg(F.count("*").alias("c")), ["_all"], {"c": "above"}).select("score", "above")
    ap = cumulated(picked, ["rep"], {"p": "tp"}).join(above, "score").groupBy("rep").agg((F.sum(F.col("p") * F.col("tp") / F.col("above")) / F.sum("p")).alias("ap"))
    seen = ranking(rows.select(F.lit(0).alias("_all"), "y", "score"), ["_all"]).select(F.col("ap").alias("observed"))
    null = scores.sparkSession.range(replicates).select(F.col("id").cast("int").alias("rep")).join(ap, "rep", "left").crossJoin(F.broadcast(seen))  # one row
    reached = F.count_if(F.round("ap", 9) >= F.round("observed", 9))
    return null.agg(F.first("observed").alias("observed"), F.avg("ap").alias("null_mean"), ((reached + 1) / (F.count("*") + 1)).alias("p_value"))
