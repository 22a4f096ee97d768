"""One streaming query from packets to alerts, and streamed entropies, against the batch operators."""

import time

import pytest
from pyspark.sql import functions as F

from packetloom.operators import cells, packets, registry, risk
from packetloom.sources import events
from packetloom.streaming import cells as live
from packetloom.streaming import chain

SF = "/root/testdata/sf0.001"
IDLE, ACTIVE, W, GAP = 21600.0, 86400.0, 21600, 10
STAGE = "CASE WHEN rst >= 2 THEN 6 WHEN syn >= 2 THEN 1 WHEN retrans > 0 THEN 4 ELSE 0 END"
P = [[0.9 if i == j else 0.1 / 6 for j in range(7)] for i in range(7)]


@pytest.fixture(scope="module")
def seen(spark):
    chain.stored_in_rocksdb(spark)
    return events.packets(spark, SF).where("ts IS NOT NULL").withColumn("flags", F.expr("CAST(event_id % 7 * 9 % 64 AS INT)")).cache()


def batch(seen):
    """Flows with their first packet's source, cells in segments, alerts."""
    first = packets.keyed(seen).groupBy(*packets.KEY, "ts").agg(F.min_by("src", "event_id").alias("src_ip"))
    flows = packets.to_flows(seen, IDLE, int(ACTIVE)).join(first, [*packets.KEY, "ts"]).withColumns({"capture": F.lit("live"), "dst_port": F.lit(0), "stage": F.expr(STAGE)})
    segs = cells.segments(cells.build(flows, W), GAP)
    return flows, segs


def written(df, path, parts, jitter):
    """Files in the order of time but for rows up to `jitter` seconds off, and a last row far in the future."""
    lo, hi = df.agg(F.min("ts"), F.max("ts")).first()
    place = F.floor((F.col("ts") + F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000 * jitter - lo) / (hi - lo + jitter + 1) * parts)
    for i in range(parts):
        df.where(place == i).orderBy(F.md5(F.col("event_id").cast("string"))).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read by age
    last(df).coalesce(1).write.mode("append").parquet(path)


def last(df):
    ends = {"ts": F.lit(4e9), "src": F.lit("end"), "capture": F.lit("end")}
    return df.limit(1).select(*[ends[c].alias(c) if c in ends else F.col(c) for c in df.columns])


def stream(spark, df, path, a_batch=1):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", a_batch).parquet(path)


def bag(df):
    return sorted(tuple(round(x + 1.3e-9, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_packets_to_alerts(spark, seen, tmp_path):
    """Packets up to two hours out of order, in five batches: the batch's flows, segments and alerts."""
    written(seen, str(tmp_path / "packets"), 5, 7200)
    flows, segs = batch(seen)
    made = chain.alerts(stream(spark, seen, str(tmp_path / "packets")), "live", IDLE, ACTIVE, W, GAP, STAGE, P, 5, 0.3, 2, "2 hours")
    got = live.drained(made, "alerts_chain", str(tmp_path / "alerts"), str(tmp_path / "a"))
    want = risk.alerts(risk.with_risk(segs, P, 5).withColumnRenamed("risk_markov", "risk"), 0.3, 2, W)
    columns = ["src_ip", "start", "end", "cells", "peak", "first_stage", "severity"]
    assert bag(got.where("src_ip <> 'end'").select(*columns)) == bag(want.select(*columns)) and want.count() >= 5


def test_restart(spark, seen, tmp_path):
    """Stopped after some files and started anew from its checkpoint: every segment's cell once, means and all."""
    path = str(tmp_path / "packets")
    lo, hi = seen.agg(F.min("ts"), F.max("ts")).first()
    half = (lo + hi) / 2
    make = lambda: chain.states(chain.flows(stream(spark, seen, path), "live", IDLE, ACTIVE, "2 hours"), W, GAP, 3, 15, IDLE + ACTIVE, STAGE)
    seen.where(F.col("ts") < half).coalesce(1).write.parquet(path)
    some = live.drained(make(), "states_one", str(tmp_path / "states"), str(tmp_path / "c")).count()
    seen.where(F.col("ts") >= half).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)
    last(seen).coalesce(1).write.mode("append").parquet(path)
    got = live.drained(make(), "states_two", str(tmp_path / "states"), str(tmp_path / "c")).where("src_ip <> 'end'")
    _, segs = batch(seen)
    want = segs
    for c in ("log_bytes", "syn_ratio"):
        want = cells.multi_scale(want, c, 3, 15).withColumnRenamed("burst", f"{c}_burst").withColumnRenamed("trend", f"{c}_trend")
    columns = ["src_ip", "wid", "is_filled", "n_flows", "log_bytes", "retrans_rate", "cnt_1", "log_bytes_burst", "log_bytes_trend", "syn_ratio_burst", "syn_ratio_trend"]
    assert bag(got.select(*columns)) == bag(want.select(*columns)) and 0 < some < want.count()


def test_streamed_entropies(spark, tmp_path):
    """Two aggregations in a row give d8's numbers, late rows within the watermark included."""
    f = registry.flows(spark, SF).where("ts IS NOT NULL")
    written(f, str(tmp_path / "flows"), 3, 3600)
    made = live.entropies(stream(spark, f, str(tmp_path / "flows")), registry.W, "dst_port", "1 hour")
    got = live.drained(made, "entropies", str(tmp_path / "out"), str(tmp_path / "c")).where("capture <> 'end'")
    want = cells.entropy(f, registry.W, "dst_port").select("capture", "src_ip", "wid", "n_distinct", "entropy")
    assert bag(got) == bag(want) == bag(live.entropies(f, registry.W, "dst_port"))
