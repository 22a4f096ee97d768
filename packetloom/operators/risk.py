"""Kill-chain Markov risk, rollouts, fusion and alerts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from packetloom.functions.stages import EXPLOIT, severity, tactic
from packetloom.operators import scans, walks
from packetloom.operators.cells import HOST, SEGMENT, in_segment


def draw(rep: Column, *key) -> Column:
    """A number in [0, 1) that depends on its arguments only, not on partitions."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", rep, *key)), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def transitions(states: DataFrame, alpha: float = 0.5) -> DataFrame:
    """from_stage, to_stage, p: all 49 pairs, smoothed counts of steps within segments."""
    steps = states.withColumn("to_stage", F.lead("stage").over(in_segment())).where("to_stage IS NOT NULL").groupBy(F.col("stage").alias("from_stage"), "to_stage").agg(F.count("*").alias("n"))
    stages = F.explode(F.sequence(F.lit(0), F.lit(6)))
    pairs = states.sparkSession.range(1).select(stages.alias("from_stage")).withColumn("to_stage", stages)
    n = F.coalesce("n", F.lit(0)) + alpha
    return pairs.join(steps, ["from_stage", "to_stage"], "left").withColumn("p", n / F.sum(n).over(Window.partitionBy("from_stage"))).select("from_stage", "to_stage", "p")


def matrix(transitions_: DataFrame) -> list[list[float]]:
    """The 7 x 7 table on the driver: 49 numbers, whatever the input."""
    out = [[0.0] * 7 for _ in range(7)]
    for r in transitions_.collect():
        out[r["from_stage"]][r["to_stage"]] = r["p"]
    return out


def propagated(p: list[list[float]], steps: int) -> list[list[list[float]]]:
    """P^k for k = 1..steps."""
    out = [p]
    for _ in range(steps - 1):
        out.append([[sum(row[m] * p[m][j] for m in range(7)) for j in range(7)] for row in out[-1]])
    return out


def first_passage(p: list[list[float]], steps: int) -> list[float]:
    """By start stage: the chance to meet an exploitation stage within steps."""
    stay = [1.0] * 7
    for _ in range(steps):
        stay = [sum(p[i][j] * stay[j] for j in range(7) if j not in EXPLOIT) for i in range(7)]
    return [1 - x for x in stay]


def belief() -> list[Column]:
    """Smoothed shares of a labelled cell's stage counts."""
    n = sum((F.col(f"cnt_{i}") for i in range(1, 7)), F.col("cnt_0"))
    return [(F.col(f"cnt_{i}") + 0.5) / (n + 3.5) for i in range(7)]


def with_risk(states: DataFrame, p: list[list[float]], steps: int, beliefs: list[Column] | None = None) -> DataFrame:
    """risk_markov: the belief's chance of first passage. beliefs: a column for each stage, else shares of labels."""
    chance = first_passage(p, steps)
    return states.withColumn("risk_markov", sum((b * F.lit(c) for b, c in zip(beliefs or belief(), chance, strict=True)), F.lit(0.0)))


def stage_paths(states: DataFrame, p: list[list[float]], steps: int) -> DataFrame:
    """A row per cell, step and stage: the belief carried forward. The weights of each step and stage are one constant, so the code for a row stays small
    whatever the number of steps: a method of all sums would be too large to compile."""
    powers = propagated(p, steps)
    weights = [F.struct(F.lit(k + 1).alias("k"), F.lit(j).alias("to_stage"), F.array(*[F.lit(powers[k][i][j]) for i in range(7)]).alias("w")) for k in range(steps) for j in range(7)]
    each = states.select(*SEGMENT, "wid", *[x.alias(f"_b{i}") for i, x in enumerate(belief())], F.explode(F.array(*weights)).alias("x"))
    return each.select(*SEGMENT, "wid", "x.k", "x.to_stage", sum((F.col(f"_b{i}") * F.col("x.w")[i] for i in range(7)), F.lit(0.0)).alias("prob"))


def walks_of(states: DataFrame, tell: Callable, types: dict[str, pa.DataType], p: list[list[float]], particles: int, steps: int, stride: int | None = None, beliefs: list[Column] | None = None) -> DataFrame:
    """SEGMENT, wid and an array column for each of types: what `tell` has for a cell's walks. Draws go by cell and particle * stride + step, so runs of one stride share them.
    A walk costs hundreds of MD5 sums a cell, so cells are dealt to all tasks and go to Python as they are, a row each."""
    key, b = [*HOST, "wid"], beliefs or belief()
    spread = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not by HOST and wid alone: Spark drops a repartition by the keys of the join before, and packs that join's small rows into few tasks
    out = states.repartition(spread, *SEGMENT, "wid").select(*SEGMENT, "wid", F.concat_ws("|", *key).alias("_key"), F.array(*[sum(b[1 : j + 1], b[0]) for j in range(6)]).alias("_b"))
    schema = T.StructType([*out.schema.fields[:-2], *[T.StructField(c, T.ArrayType(from_arrow_type(t))) for c, t in types.items()]])
    return out.mapInArrow(walks.mapper(tell, list(types.values()), p, particles, steps, stride or steps + 1), schema)


def walked(states: DataFrame, p: list[list[float]], particles: int, steps: int, stride: int | None = None, beliefs: list[Column] | None = None) -> DataFrame:
    """SEGMENT, wid, particle and the sampled stages s0 to s<steps> of each."""
    out = walks_of(states, walks.stages, {"_s": pa.int16()}, p, particles, steps, stride, beliefs)
    out = out.select(*SEGMENT, "wid", "_s", F.explode(F.sequence(F.lit(0), F.lit(particles - 1))).alias("particle"))
    return out.select(*SEGMENT, "wid", "particle", *[F.col("_s")[F.col("particle") * (steps + 1) + k].cast("int").alias(f"s{k}") for k in range(steps + 1)])


def rollout_grid(states: DataFrame, p: list[list[float]], particles: list[int], steps: list[int], stride: int | None = None, beliefs: list[Column] | None = None) -> DataFrame:
    """Per cell, number of particles and number of steps: Monte-Carlo risk, share of particles that hit, median steps to a hit (-1 without), all from one run of
    the largest; columns particles and steps tell which."""
    particles, steps, told = sorted(particles), sorted(steps), {c: pa.float64() for c in ("_risk", "_share", "_eta")}
    out = walks_of(states, walks.summed(p, particles, steps), told, p, max(particles), max(steps), stride, beliefs)
    cell = lambda i, n, k: F.struct(F.lit(n).alias("particles"), F.lit(k).alias("steps"), *[F.col(c)[i].alias(name) for c, name in zip(told, ("risk_rollout", "hit_share", "eta"), strict=True)])
    each = [cell(i, n, k) for i, (n, k) in enumerate((n, k) for n in particles for k in steps)]
    return out.select(*SEGMENT, "wid", F.explode(F.array(*each)).alias("x")).select(*SEGMENT, "wid", "x.*")


def rollout(states: DataFrame, p: list[list[float]], particles: int, steps: int, stride: int | None = None, beliefs: list[Column] | None = None) -> DataFrame:
    """Per cell: Monte-Carlo risk, share of particles that hit, and median steps to a hit (-1 without)."""
    return rollout_grid(states, p, [particles], [steps], stride, beliefs).drop("particles", "steps")


def alerts(scored: DataFrame, threshold: float, min_run: int, seconds: int) -> DataFrame:
    """Runs of at least min_run cells at or above the threshold."""
    w = in_segment()
    on = scored.withColumn("_pos", F.row_number().over(w)).where(F.col("risk") >= threshold)
    on = on.withColumn("_run", F.col("_pos") - F.row_number().over(w))
    runs = on.groupBy(*SEGMENT, "_run").agg(F.min("wid").alias("first_wid"), F.max("wid").alias("last_wid"), F.count("*").alias("cells"), F.max("risk").alias("peak"), F.min_by("stage", "wid").alias("first_stage")).where(F.col("cells") >= min_run)
    return runs.select(*SEGMENT, (F.col("first_wid") * seconds).alias("start"), ((F.col("last_wid") + 1) * seconds).alias("end"), "cells", "peak", "first_stage", severity(F.col("peak")).alias("severity"))


def alert_table(scored: DataFrame, threshold: float, min_run: int, seconds: int) -> DataFrame:
    """Alerts as analysts read them: a number in order of their segment and begin, duration, stage and tactic that the first cell forecasts, minutes to go,
    the stage that it shows and the true phase. Columns risk, forecast_stage, eta, stage_now, phase."""
    w = in_segment()
    on = scored.withColumn("_pos", F.row_number().over(w)).where(F.col("risk") >= threshold)
    on = on.withColumn("_run", F.col("_pos") - F.row_number().over(w))
    at = lambda c: F.min_by(c, "wid").alias(c)
    runs = on.groupBy(*SEGMENT, "_run").agg(F.min("wid").alias("_first"), F.max("wid").alias("_last"), F.count("*").alias("cells"), F.max("risk").alias("peak_risk"), *map(at, ("forecast_stage", "eta", "stage_now", "phase"))).where(F.col("cells") >= min_run).drop("_run")
    numbered = scans.ranked(runs, [], [*SEGMENT, "_first"], "_i")
    told, minutes = tactic(F.col("forecast_stage")), seconds / 60
    return numbered.select(
        F.format_string("A%04d", F.col("_i") + 1).alias("alert_id"), *SEGMENT, (F.col("_first") * seconds).alias("start"), ((F.col("_last") + 1) * seconds).alias("end"), (F.col("cells") * minutes).alias("duration_min"), "peak_risk", severity(F.col("peak_risk")).alias("severity"),
        "forecast_stage", F.concat(told["tactic"], F.lit(" ("), told["id"], F.lit(")")).alias("tactic"), told["techniques"].alias("techniques"), F.when(F.col("eta") > 0, F.col("eta") * minutes).alias("eta_min"), F.col("stage_now").alias("observed_stage_at_start"), F.col("phase").alias("true_phase_at_start"))


def triage_ranking(table: DataFrame, k: int | None = None) -> DataFrame:
    """Triage rows in the order that analysts take them, with the channel that flags them: risk, anomaly, both, or none. k: the first k."""
    channel = F.when(F.col("by_risk") & F.col("by_anomaly"), "risk + anomaly").when(F.col("by_risk"), "risk").when(F.col("by_anomaly"), "anomaly").otherwise("-")
    order = [F.desc("by_risk"), F.desc("max_risk"), F.desc("z"), *SEGMENT]
    out = table.withColumn("channel", channel).orderBy(*order)
    return out if k is None else out.limit(k)


def robust_z(df: DataFrame, column: str, groups: list[str]) -> DataFrame:
    """df with z: the distance from the group's median in units of its median absolute deviation."""
    median = lambda rows, c, name: F.broadcast(scans.quantiles(rows, groups, [c], 2, [1]).select(*groups, F.col("value").alias(name)))  # noqa: E731  a row for each group
    off = df.join(median(df, column, "_mid"), groups, "left").withColumn("_off", F.abs(F.col(column) - F.col("_mid")))
    return off.join(median(off, "_off", "_mad"), groups, "left").withColumn("z", (F.col(column) - F.col("_mid")) / (1.4826 * F.col("_mad") + 1e-6)).drop("_mid", "_mad", "_off")


def triage(scored: DataFrame, threshold: float, z: float) -> DataFrame:
    """Per segment: infected or not, its largest risk, the robust z of its mean surprise, and what flags it."""
    s = scored.groupBy(*SEGMENT).agg(F.max((F.col("stage") > 0).cast("int")).alias("infected"), F.max("risk").alias("max_risk"), F.avg("surprise").alias("mean_surprise"))
    out = robust_z(s, "mean_surprise", ["capture"])
    return out.withColumn("by_risk", F.col("max_risk") >= threshold).withColumn("by_anomaly", F.col("z") >= z)


def alert(risk: Column, threshold: float) -> Column:
    return risk >= threshold


def forecast_stage(states: DataFrame, p: list[list[float]], steps: int, beliefs: list[Column] | None = None) -> DataFrame:
    """The exploitation stage with most probability over the steps to come; the lowest on ties."""
    powers, b = propagated(p, steps), beliefs or belief()
    mass = {j: F.round(sum((b[i] * F.lit(sum(m[i][j] for m in powers)) for i in range(7)), F.lit(0.0)), 9) for j in EXPLOIT}
    best = F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(-j).alias("j")) for j, v in mass.items()]))
    return states.select(*SEGMENT, "wid", (-best["j"]).alias("forecast_stage"))


def rollout_paths(states: DataFrame, p: list[list[float]], particles: int, steps: int) -> DataFrame:
    """A row for each cell, particle and step k: the sampled stage."""
    out = walks_of(states, walks.stages, {"_s": pa.int16()}, p, particles, steps).select(*SEGMENT, "wid", F.posexplode("_s").alias("_i", "stage"))
    return out.select(*SEGMENT, "wid", F.expr(f"CAST(_i div {steps + 1} AS INT)").alias("particle"), (F.col("_i") % (steps + 1)).alias("k"), F.col("stage").cast("int").alias("stage")).where("k > 0")


def fan(states: DataFrame, p: list[list[float]], particles: int, steps: int) -> DataFrame:
    """low, mid, high: the 10, 50 and 90 % points of the particles' chance of exploitation at each step."""
    out = walks_of(states, walks.fans(p, particles, steps), {c: pa.float64() for c in ("low", "mid", "high")}, p, particles, steps)
    return out.select(*SEGMENT, "wid", F.explode(F.array(*[F.struct(F.lit(k + 1).alias("k"), *[F.col(c)[k].alias(c) for c in ("low", "mid", "high")]) for k in range(steps)])).alias("x")).select(*SEGMENT, "wid", "x.*")


def signed(z: DataFrame, target: Column, threshold: float) -> DataFrame:
    """z with the sign that ranks the target above chance, and odd: z at the threshold or above."""
    from packetloom.operators.metrics import ranking

    r = ranking(z.select(F.lit(1).alias("_all"), target.alias("y"), F.round("z", 6).alias("score")), ["_all"]).first()
    out = z.withColumn("z", F.col("z") * (1 if r is None or r["auc"] is None or r["auc"] >= 0.5 else -1))
    return out.withColumn("odd", F.col("z") >= threshold)


def forecast_and_truth(states: DataFrame, p: list[list[float]], steps: int) -> DataFrame:
    """A row for each cell and step k: the likeliest stage from its own (the lowest on ties) and the true one."""
    best = [[max(range(7), key=lambda j: (round(row[j], 9), -j)) for row in m] for m in propagated(p, steps)]
    w = in_segment()
    pairs = F.array(*[F.struct(F.lit(k + 1).alias("k"), F.lead("stage", k + 1).over(w).alias("truth"), F.element_at(F.array(*map(F.lit, row)), F.col("stage") + 1).alias("forecast")) for k, row in enumerate(best)])
    return states.withColumn("_pairs", pairs).select(*SEGMENT, "wid", "stage", F.explode("_pairs").alias("x")).select(*SEGMENT, "wid", "stage", "x.*").where("truth IS NOT NULL")


def heat(paths: DataFrame) -> DataFrame:
    """For each cell and exploitation stage the largest probability over the steps."""
    return paths.where(F.col("to_stage").isin(EXPLOIT)).groupBy(*SEGMENT, "wid", "to_stage").agg(F.max("prob").alias("heat"))


def belief_shift(df: DataFrame, columns: list[str], short: int, long: int, least: float = 0.01) -> DataFrame:
    """df with shift: the divergence of a Gaussian of recent cells from one of many cells, summed over columns; variances are `least` at least."""
    df, total, means = df, F.lit(0.0), []
    for c in columns:
        df = df.withColumn(f"_sq_{c}", F.col(c) * F.col(c))
        means += [(x, span, f"_{m}{tag}_{c}") for span, tag in ((short, "s"), (long, "l")) for x, m in ((c, "m"), (f"_sq_{c}", "q"))]
    df = scans.decayed(df, SEGMENT, "wid", means)
    for c in columns:
        vs, vl = (F.greatest(F.col(f"_q{t}_{c}") - F.col(f"_m{t}_{c}") * F.col(f"_m{t}_{c}"), F.lit(least)) for t in "sl")
        total = total + F.log(F.sqrt(vl) / F.sqrt(vs)) + (vs + F.pow(F.col(f"_ms_{c}") - F.col(f"_ml_{c}"), F.lit(2.0))) / (2 * vl) - 0.5
    return df.withColumn("shift", total).drop(*[f"_sq_{c}" for c in columns], *[name for _, _, name in means])


def scaled_surprise(df: DataFrame, columns: list[str], params: DataFrame, span: int) -> DataFrame:
    """df with surprise: the mean over columns of the squared distance from the short mean one cell before, in units of each column's scale (params: column, center, scale)."""
    scale = {r["column"]: r["scale"] for r in params.collect()}  # a row for each column
    out = scans.decayed(df, SEGMENT, "wid", [(c, span, f"_m_{c}") for c in columns], before=True)
    error = sum((F.pow((F.col(c) - F.coalesce(f"__m_{c}", F.col(c))) / F.lit(scale[c]), F.lit(2.0)) for c in columns), F.lit(0.0)) / len(columns)
    return out.withColumn("surprise", error).drop(*[f"{p}m_{c}" for c in columns for p in ("_", "__")])
