"""A trained forecaster as a folder: learned from labelled flows once, loaded in any session, applied to flows without labels.

The folder holds Spark ML models (chance of exploitation ahead, stage of a cell) and small tables: scaler, transitions, weights of the risk's
parts, threshold, and settings. What a forecast needs beside the flows is all there: inputs are features alone, the belief in a cell's stage comes from the
stage model, and Markov risk, rollout, forecast stage and alerts follow from that belief.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators import batches, calibrate, cells, metrics, models, risk
from packetloom.sources import shared

KEY = [*cells.SEGMENT, "wid"]
COUNTS = [f"cnt_{i}" for i in range(7)]
#: What a bundle has beside its models and tables.
SETTINGS = {"seconds": 60, "gap": 10, "short": 3, "long": 15, "horizon": 10, "particles": 32, "purge": 6, "max_fpr": 0.05, "min_run": 2, "anomaly": 3.0, "train": 0.7, "val": 0.15}


class Bundle(NamedTuple):
    settings: dict
    scaler: list[tuple[str, float, float]]
    transitions: list[list[float]]
    weights: dict[str, float]
    threshold: float
    forecaster: LogisticRegressionModel | float
    stages: LogisticRegressionModel | int


def feature_names(states: DataFrame) -> list[str]:
    """The features of a cell: what isn't its key, its label counts, a flag for missing columns, its part of a split, or made from labels."""
    no = {*KEY, *COUNTS, "is_filled", "stage", "n_flows", "row", "exploit_now", "y_future", "time_to_attack", "phase", "split_temporal"}
    return [c for c in states.columns if c not in no and not c.endswith("_missing") and not c.startswith("stage_")]


def scaled_inputs(states: DataFrame, short: int, long: int) -> tuple[DataFrame, list[str]]:
    """states with each feature's burst and trend, and the names of all inputs: value, burst, trend. A segment's rows pass one task in their order; the task holds a batch of them."""
    names = feature_names(states)
    rest = [c for c in states.columns if c not in names]
    inputs = [x for c in names for x in (c, f"{c}__burst", f"{c}__trend")]
    wide = states.repartition(*cells.SEGMENT).sortWithinPartitions(*cells.SEGMENT, "wid").select(*rest, *[F.col(c).cast("double").alias(c) for c in names])
    schema = T.StructType([*[states.schema[c] for c in rest], *[T.StructField(c, T.DoubleType()) for c in inputs]])
    return wide.mapInArrow(batches.burst_and_trend(cells.SEGMENT, names, short, long), schema), inputs


def states_of(flows: DataFrame, seconds: int, gap: int) -> DataFrame:
    return cells.segments(cells.full(flows, seconds), gap)


def with_vector(rows: DataFrame, rest: list[str], inputs: list[str], scaler: list[tuple[str, float, float]]) -> DataFrame:
    """The columns in rest and x, the inputs as one array, scaled; missing values are 0, the rest stays within 10."""
    schema = T.StructType([*[rows.schema[c] for c in rest], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return rows.select(*rest, *[F.col(c).cast("double").alias(c) for c in inputs]).mapInArrow(batches.scaled(inputs, scaler, rest), schema)


def fitted_stages(rows: DataFrame) -> LogisticRegressionModel | int:
    """A multinomial model of the stage (column stage) from x; the only stage where there is one."""
    classes = [r[0] for r in rows.select("stage").distinct().limit(2).collect()]
    if len(classes) < 2:
        return int(classes[0]) if classes else 0
    return LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", regParam=1e-4, maxIter=100).fit(rows.select(array_to_vector("x").alias("_x"), F.col("stage").cast("double").alias("_y")))


def beliefs() -> list[Column]:
    return [F.element_at("belief", i + 1) for i in range(7)]


def believed(model, rows: DataFrame) -> DataFrame:
    """rows with belief, a chance for each of the seven stages, and stage_now, the likeliest (the lowest on ties)."""
    if isinstance(model, int):
        out = rows.withColumn("belief", F.array(*[F.lit(float(i == model)) for i in range(7)]))
    else:
        out = model.transform(rows.withColumn("_x", array_to_vector("x"))).withColumn("_p", vector_to_array("probability")).drop("_x", "rawPrediction", "probability", "prediction")
        out = out.withColumn("belief", F.concat("_p", F.array_repeat(F.lit(0.0), 7 - model.numClasses))).drop("_p")
    best = F.array_max(F.transform("belief", lambda p, i: F.struct(F.round(p, 9).alias("p"), (-i).alias("i"))))
    return out.withColumn("stage_now", (-best["i"]).cast("int"))


def parts_of(rows: DataFrame, b: Bundle) -> DataFrame:
    """rows (with x) with belief, stage_now, direct, markov, rollout, eta and forecast_stage."""
    s = b.settings
    out = shared.kept(believed(b.stages, models.score(b.forecaster, rows, "x").withColumnRenamed("score", "direct")), "believed")
    out = risk.with_risk(out, b.transitions, s["horizon"], beliefs()).withColumnRenamed("risk_markov", "markov")
    walks = risk.rollout(out, b.transitions, s["particles"], s["horizon"], None, beliefs()).select(*KEY, F.col("risk_rollout").alias("rollout"), "eta")
    ahead = risk.forecast_stage(out, b.transitions, s["horizon"], beliefs())
    return out.join(walks.hint("merge"), KEY).join(ahead.hint("merge"), KEY)


def training_table(flows: DataFrame, s: dict, horizons: tuple = ()) -> tuple[DataFrame, list[str], list[tuple[str, float, float]]]:
    """The rows that models train on, written once: keys, targets, split, stage_k for each horizon k, and x, all inputs scaled by what the training cells say. Also the inputs' names and the scaler."""
    # targets and split first: they deal segments to tasks while rows are narrow, and burst and trend take the rows as they lie
    narrow = cells.targets(states_of(flows, s["seconds"], s["gap"]), s["horizon"])
    for k in horizons:
        narrow = cells.future_stage(narrow, k)
    states, inputs = scaled_inputs(cells.temporal_split(narrow, s["train"], s["val"], s["purge"]), s["short"], s["long"])
    rows = shared.kept(states, "bundle-states")
    scaler = [(r["column"], r["center"], r["scale"]) for r in cells.scaler_table(rows.where("split_temporal = 'train'"), inputs).orderBy("column").collect()]  # a row for each input
    known = {c for c, _, _ in scaler}
    scaler += [(c, 0.0, 1.0) for c in inputs if c not in known]
    rest = [*KEY, "is_filled", "stage", "y_future", "exploit_now", "phase", "split_temporal", *[f"stage_{k}" for k in horizons]]
    out = shared.kept(with_vector(rows, rest, inputs, scaler), "bundle-rows")
    shared.gone(rows)  # the inputs before scaling are as large as the table and of no use to a model
    return out, inputs, scaler


def train(flows: DataFrame, **settings) -> Bundle:
    """A bundle from labelled flows (column stage)."""
    s = SETTINGS | settings
    rows, inputs, scaler = training_table(flows, s)
    seen = rows.where("split_temporal = 'train'")
    b = Bundle(s | {"inputs": inputs}, scaler, risk.matrix(risk.transitions(seen)), {"direct": 1.0, "rollout": 0.0, "markov": 0.0}, 0.5, models.fit(seen, "x", "y_future", "logistic", C=0.5), fitted_stages(seen))
    val = shared.kept(parts_of(rows.where("split_temporal = 'val'"), b).withColumn("y", F.col("y_future")), "bundle-val")
    best = calibrate.fusion(val, ["direct", "rollout", "markov"]).first()
    weights = dict(zip(("direct", "rollout", "markov"), (best["w0"], best["w1"], best["w2"]), strict=True)) if best else b.weights
    scores = val.withColumn("score", F.round(models.fused(weights), 4)).select(F.lit("fused").alias("method"), "y", "score")
    limit = metrics.thresholds(scores, s["max_fpr"], ["method"]).first()
    return b._replace(weights=weights, threshold=limit["threshold"] if limit else 0.5)


def save(b: Bundle, spark: SparkSession, path: str) -> None:
    table = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
    table([(c, center, scale) for c, center, scale in b.scaler], "column string, center double, scale double", "scaler")
    table([(i, j, p) for i, row in enumerate(b.transitions) for j, p in enumerate(row)], "i int, j int, p double", "transitions")
    table(list(b.weights.items()), "part string, weight double", "weights")
    constant = lambda m: None if hasattr(m, "write") else float(m)
    s = b.settings
    table([(b.threshold, constant(b.forecaster), constant(b.stages), s["inputs"], {k: float(v) for k, v in s.items() if k != "inputs"})], "threshold double, forecaster double, stages double, inputs array<string>, settings map<string, double>", "settings")
    for name, model in (("forecaster", b.forecaster), ("stages", b.stages)):
        if hasattr(model, "write"):
            model.write().overwrite().save(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Bundle:
    read = lambda schema, name: spark.read.schema(schema).json(f"{path}/{name}").collect()
    (s,) = read("threshold double, forecaster double, stages double, inputs array<string>, settings map<string, double>", "settings")
    p = [[0.0] * 7 for _ in range(7)]
    for r in read("i int, j int, p double", "transitions"):
        p[r["i"]][r["j"]] = r["p"]
    settings = {k: type(SETTINGS[k])(v) for k, v in s["settings"].items()} | {"inputs": s["inputs"]}
    model = lambda name, kind: LogisticRegressionModel.load(f"{path}/{name}") if s[name] is None else kind(s[name])
    order = {"direct": 0, "rollout": 1, "markov": 2}
    weights = {r["part"]: r["weight"] for r in sorted(read("part string, weight double", "weights"), key=lambda r: order[r["part"]])}
    return Bundle(settings, sorted(tuple(r) for r in read("column string, center double, scale double", "scaler")), p, weights, s["threshold"], model("forecaster", float), model("stages", int))


def forecast(b: Bundle, flows: DataFrame) -> DataFrame:
    """A row for each cell of flows (no labels needed): its belief, parts, fused risk, forecast stage, minutes to go, surprise and alert flag; the true phase where flows have labels."""
    s = b.settings
    labelled = flows if "stage" in flows.columns else flows.withColumn("stage", F.lit(0))
    states, inputs = scaled_inputs(cells.targets(states_of(labelled, s["seconds"], s["gap"]), s["horizon"]), s["short"], s["long"])
    if set(inputs) != set(s["inputs"]):
        raise ValueError("the flows have other features than the bundle was trained on")
    # the squared error of each feature's short mean one cell before, over scaled features
    scale = {c: sc for c, _, sc in b.scaler}
    features = [c for c in s["inputs"] if "__" not in c]
    error = sum((F.pow(F.col(f"{c}__burst") / F.lit(scale[c]), F.lit(2.0)) for c in features), F.lit(0.0)) / len(features)
    rest = [*KEY, "is_filled", "stage", "phase", "y_future", "surprise"]
    out = parts_of(with_vector(states.withColumn("surprise", error), rest, s["inputs"], b.scaler), b).drop("x")
    fused = models.fused(b.weights)
    return out.withColumn("risk", fused).withColumn("alert", risk.alert(fused, b.threshold))


def alerts(b: Bundle, forecast_: DataFrame) -> DataFrame:
    return risk.alert_table(forecast_, b.threshold, b.settings["min_run"], b.settings["seconds"])


def triage(b: Bundle, forecast_: DataFrame) -> DataFrame:
    return risk.triage_ranking(risk.triage(forecast_, b.threshold, b.settings["anomaly"]))
