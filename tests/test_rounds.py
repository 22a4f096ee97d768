"""What a model's rounds pass over, and what the driver does before the first of them."""

import py4j.java_gateway
import pytest
from pyspark.sql import functions as F

from packetloom.operators import models, registry, registry_reports, scans, sequences  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_parts_fill_tasks(spark, monkeypatch):
    """No pass of a round has a last part that waits for the others' tasks."""
    seen = []
    monkeypatch.setattr(models, "fit", lambda train, *_, **__: float(seen.append(train.rdd.getNumPartitions()) or 0))
    registry.QUERIES["g4_boosted_stacked"](spark, SF)
    assert seen == [spark.sparkContext.defaultParallelism]


@pytest.mark.parametrize("rows,parts", [(100, 4), (40, 4), (39, 4), (7, 16), (1, 100)])
def test_waves(spark, rows, parts):
    df = spark.range(100).select(F.lit("c").alias("capture"), F.col("id").cast("string").alias("src_ip"), F.lit(0).alias("run"), "id")
    out = sequences.waves(df, rows)
    assert spark.sparkContext.defaultParallelism == 4 and out.rdd.getNumPartitions() == parts
    assert sorted(r["id"] for r in out.collect()) == list(range(100))


def test_one_call_for_each_mean(spark, monkeypatch):
    """A mean costs the driver a few calls of the JVM, not one for each operand."""
    calls, plain = [], py4j.java_gateway.JavaMember.__call__
    names = [f"c{i}" for i in range(20)]
    df = spark.range(10).select(F.lit("a").alias("k"), F.col("id").alias("t"), *[F.col("id").cast("double").alias(c) for c in names])
    monkeypatch.setattr(py4j.java_gateway.JavaMember, "__call__", lambda self, *args: calls.append(1) or plain(self, *args))
    scans.decayed(df, ["k"], "t", [(c, span, f"{c}_{span}") for c in names for span in (3, 15)])
    assert len(calls) < 100 * len(names)


def test_literals(spark):
    for x in (0.1, -2.5e-300, 1e16, float("inf"), float("-inf"), 1 / 3):
        assert spark.range(1).select(F.expr(scans.literal(x))).first()[0] == x
    assert spark.range(1).select(F.expr(f"isnan({scans.literal(float('nan'))})"), F.expr(scans.literal(None))).first()[:] == (True, None)
