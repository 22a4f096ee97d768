"""Trained forecasters on Spark ML: features are array columns, scores are the chance of the positive class."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAKERS = {
    "logistic": lambda **o: LogisticRegression(**{"maxIter": 100, "regParam": 1e-3, "standardization": True} | o),
    "boosted": lambda **o: GBTClassifier(**{"maxIter": 300, "stepSize": 0.08, "seed": 0} | o),
    "forest": lambda **o: RandomForestClassifier(**{"numTrees": 150, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt", "seed": 0} | o),
}


def persistence(stage: Column, exploit_only: bool = False) -> Column:
    return F.when(stage >= (2 if exploit_only else 1), 1.0).otherwise(0.0)


def balanced(train: DataFrame, target: str) -> DataFrame:
    """_w: the weight that gives either class half of the total."""
    n = train.agg(F.count("*").alias("n"), F.count_if(F.col(target) > 0).alias("p")).first()
    share = lambda k: n["n"] / (2 * k) if k else 1.0
    return train.withColumn("_w", F.when(F.col(target) > 0, share(n["p"])).otherwise(share(n["n"] - n["p"])))


def fit(train: DataFrame, features: str, target: str, kind: str, **options):
    """A model of MAKERS, classes balanced by weight; a constant where there is one class only. C: the L2 weight is 1 / (C n) for n rows."""
    classes = [r[0] for r in train.select(target).distinct().limit(2).collect()]
    if len(classes) < 2:
        return float(classes[0]) if classes else 0.0
    rows = balanced(train, target).select(array_to_vector(features).alias("_x"), F.col(target).cast("double").alias("_y"), "_w")
    if "C" in options:
        options["regParam"] = 1 / (options.pop("C") * train.count())
    return MAKERS[kind](featuresCol="_x", labelCol="_y", weightCol="_w", **options).fit(rows)


def score(model, df: DataFrame, features: str) -> DataFrame:
    """df with score."""
    if isinstance(model, float):
        return df.withColumn("score", F.lit(model))
    out = model.transform(df.withColumn("_x", array_to_vector(features)))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def fused(parts: dict[str, float]) -> Column:
    """The weighted mean of score columns."""
    return sum((F.col(c) * w for c, w in parts.items()), F.lit(0.0)) / sum(parts.values())


def surprise(column: str, short: str) -> Column:
    """The squared error of the short mean one cell before."""
    return F.pow(F.col(column) - F.col(short), F.lit(2.0))


def ensemble(fused_: DataFrame, tree: DataFrame, weight: float, key: tuple = ("capture", "src_ip", "run", "wid")) -> DataFrame:
    """Cell keys with weight * fused + (1 - weight) * tree; columns score."""
    both = fused_.join(tree.select(*key, F.col("score").alias("_tree")).hint("merge"), list(key))  # neither side is small, whatever Spark takes them for
    return both.select(*key, (weight * F.col("score") + (1 - weight) * F.col("_tree")).alias("score"))


def stage_horizons(train: DataFrame, df: DataFrame, features: str, horizons: list[int]) -> DataFrame:
    """df with stage_k for each horizon k: multinomial logistic regression on the stage k cells on (column stage_k of train, null: unknown), of all rows; the only class where there is one."""
    for k in horizons:
        rows = train.where(f"stage_{k} IS NOT NULL").select(array_to_vector(features).alias("_x"), F.col(f"stage_{k}").cast("double").alias("_y"))
        classes = [r[0] for r in rows.select("_y").distinct().limit(2).collect()]
        if len(classes) < 2:
            df = df.withColumn(f"pred_{k}", F.lit(int(classes[0]) if classes else 0))
            continue
        model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", regParam=1e-4, maxIter=100, predictionCol="_p").fit(rows)
        df = model.transform(df.withColumn("_x", array_to_vector(features))).withColumn(f"pred_{k}", F.col("_p").cast("int")).drop("_x", "_p", "rawPrediction", "probability")
    return df


def attributions(df: DataFrame, columns: list[str], coefficients: DataFrame, background: DataFrame) -> DataFrame:
    """key columns of df with feature, attribution: (value - background's mean) * coefficient, summed over a feature's scales
    (columns named feature__scale). coefficients: column, coef. Means and coefficients are one row beside each cell, so cells stay where they are."""
    mean = background.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("_mean"))
    held = coefficients.groupBy("column").agg(F.sum("coef").alias("coef")).agg(F.map_from_entries(F.collect_list(F.struct("column", "coef"))).alias("_coef"))
    keys = [c for c in df.columns if c not in columns]
    product = lambda c: (F.col(c).cast("double") - F.col("_mean")[c]) * F.try_element_at("_coef", F.lit(c))
    each = []
    for name in dict.fromkeys(c.split("__")[0] for c in columns):
        mine = [c for c in columns if c.split("__")[0] == name]
        known = F.arrays_overlap(F.map_keys("_coef"), F.array(*map(F.lit, mine)))
        told = sum((F.coalesce(product(c), F.lit(0.0)) for c in mine[1:]), F.coalesce(product(mine[0]), F.lit(0.0)))
        each.append(F.struct(F.lit(name).alias("feature"), known.alias("known"), F.when(F.coalesce(*map(product, mine)).isNotNull(), told).alias("attribution")))
    wide = df.crossJoin(F.broadcast(held.crossJoin(F.broadcast(mean))))  # one row
    return wide.select(*keys, F.explode(F.filter(F.array(*each), lambda x: x["known"])).alias("x")).select(*keys, "x.feature", "x.attribution")


def top_features(attributed: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Each key's k features of the largest attribution either way, by rank; ties by name."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs(F.round("attribution", 9))), "feature"))
    return attributed.withColumn("rank", rank).where(F.col("rank") <= k)
