"""Training tables and models over all of their rows and inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import batches, bundle, cells, models, registry, registry_reports, scans  # noqa: F401
from packetloom.sources import shared


def test_stage_horizons_take_all_rows(spark, monkeypatch):
    """No cap on the rows that a stage model sees, and no sort of them."""
    df = spark.range(31_000).select(F.array(F.col("id") % 7 + 0.0).alias("x"), F.when(F.col("id") > 500, F.col("id") % 3).cast("int").alias("stage_1"))
    seen = []

    class Counted(models.LogisticRegression):
        def fit(self, rows):
            seen.append(rows.count())
            assert "Sort" not in rows._jdf.queryExecution().executedPlan().toString()
            return super().fit(rows)

    monkeypatch.setattr(models, "LogisticRegression", Counted)
    out = models.stage_horizons(df, df.limit(5), "x", [1])
    assert seen == [31_000 - 501] and out.select("pred_1").distinct().count() >= 1


def rows_of(spark, n=60):
    rng = np.random.default_rng(0)
    rows = [(f"c{i % 2}", None if i % 3 == 0 else f"h{i % 3}", 0, i // 6, float(rng.normal()), None if i == 7 else float(i % 5), i % 4) for i in range(n)]
    return spark.createDataFrame(rows, "capture string, src_ip string, run long, wid long, a double, b double, stage_3 int")


def test_burst_and_trend_as_scans(spark, monkeypatch):
    """The same as from windows, over batches of any size and keys with nulls; a stage ahead is no input."""
    df = rows_of(spark).withColumn("b", F.coalesce("b", F.lit(0.0)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = scans.decayed(df, cells.SEGMENT, "wid", [(c, span, f"{c}__{k}") for c in "ab" for span, k in ((3, "short"), (15, "trend"))], before=True)
    want = want.select(*bundle.KEY, *[x for c in "ab" for x in (c, (F.col(c) - F.coalesce(f"_{c}__short", F.col(c))).alias(f"{c}__burst"), f"{c}__trend")])
    key = lambda r: tuple(map(str, r[:4]))
    expected = sorted(map(tuple, want.collect()), key=key)
    for size in ("7", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out, inputs = bundle.scaled_inputs(df, 3, 15)
        got = sorted(map(tuple, out.select(*want.columns).collect()), key=key)
        assert inputs == want.columns[4:] and len(got) == len(expected) == 60
        for g, w in zip(got, expected, strict=True):
            assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=1e-12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    r = bundle.scaled_inputs(rows_of(spark), 3, 15)[0].where("b IS NULL").first()
    assert (r["b"], r["b__burst"]) == (None, None) and r["b__trend"] is not None and r["stage_3"] == 3


def test_scaled_vector(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, None, float("nan")), (3, 1e9, -1e9)], "k int, a double, b double")
    got = bundle.with_vector(df, ["k"], ["b", "a"], [("a", 1.0, 2.0), ("b", None, 1.0)]).orderBy("k").collect()
    assert [r["x"] for r in got] == [[0.0, 2.0], [0.0, 0.0], [0.0, 10.0]]


def test_scaler_of_many_rows(spark):
    """Exact quartiles though tasks send a sketch; deviations as Spark's; NaN counts as the greatest value, as before."""
    df = spark.range(0, 50_000, 1, 3).selectExpr("id * 7919 % 50000 / 7D a", "IF(id % 50 = 0, id / 7D, 0D) b", "IF(id < 2, id + 0.5D, NULL) c", "CAST(NULL AS DOUBLE) d")
    found = {r["column"]: r for r in scans.sketched(df, df.columns, 4, [1, 2, 3])}
    for c in "abc":
        assert found[c]["s"] == pytest.approx(df.agg(F.stddev_pop(c)).first()[0]) and not found[c]["odd"]
    told = {r["column"]: (r["center"], r["scale"]) for r in cells.scaler_table(df, df.columns).collect()}
    a = np.sort(np.arange(50_000) * 7919 % 50_000 / 7)
    assert told["a"] == pytest.approx((np.quantile(a, 0.5), np.quantile(a, 0.75) - np.quantile(a, 0.25))) and told["b"][1] == pytest.approx(found["b"]["s"]) and "d" not in told
    odd = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "a double")
    assert scans.few_quantiles(odd, ["a"], 2, [1]).first()["value"] == 2.0 and scans.sketched(odd, ["a"], 2, [1])[0]["odd"]
    assert cells.scaler_table(df.where("a < 0"), ["a"]).count() == 0


def test_picked_stands_for_all():
    rng = np.random.default_rng(1)
    v = rng.exponential(size=9000)
    picked, weights = batches._picked(v, np.ones(9000), 1000)
    assert len(picked) == 1000 and weights.sum() == pytest.approx(9000) and max(abs((v <= x).mean() - (i + 0.5) / 1000) for i, x in enumerate(picked)) < 0.001


def test_unscaled_table_goes(spark):
    df = shared.kept(spark.range(3), "short-lived")
    (folder,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path)
    shared.gone(df)
    assert not fs.exists(path)


@pytest.mark.parametrize("name", ["g3_logistic_stacked", "g5_forest_stacked"])
def test_stacks_have_all_inputs(spark, monkeypatch, name):
    """Burst and trend too, of each of the eight cells, oldest first."""
    seen = []
    table = spark.createDataFrame([("c", "h", 0, w, "test" if w == 9 else "train", w % 2, [float(100 * w + i) for i in range(6)]) for w in range(10)], "capture string, src_ip string, run long, wid long, split_temporal string, y_future int, x array<double>")
    monkeypatch.setattr(registry_reports, "training_rows", lambda *_: table)
    monkeypatch.setattr(models, "fit", lambda train, *_, **__: float(seen.extend(train.orderBy("wid").collect()) or 0))
    registry.QUERIES[name](spark, "none")
    assert len(seen) == 9 and seen[8]["x"] == [float(100 * w + i) for w in range(1, 9) for i in range(6)] and seen[0]["x"] == [float(i) for i in range(6)] * 8
