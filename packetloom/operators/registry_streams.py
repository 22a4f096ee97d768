"""Queries that run as streams to their end, and the SQL of what they have to give; added to those of registry.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import risk
from packetloom.operators.registry import FLOWS, GAP, W, base, flows, query
from packetloom.sources import events, shared
from packetloom.streaming import cells as live
from packetloom.streaming import chain

IDLE, ACTIVE, HORIZON, LIMIT = 21600, 86400, 5, 0.3
STAGE = "CASE WHEN rst >= 2 THEN 6 WHEN syn >= 2 THEN 1 WHEN retrans > 0 THEN 4 ELSE 0 END"
P = [[0.9 if i == j else 0.1 / 6 for j in range(7)] for i in range(7)]


def arriving(spark: SparkSession, df: DataFrame, name: str, batches: int = 4) -> DataFrame:
    """df as a stream of files in the order of time, and a last row far in the future that lets the watermark pass all others."""
    path, df = shared.folder(spark, name), shared.kept(df.where("ts IS NOT NULL"), f"{name}-rows")
    lo, hi = df.agg(F.min("ts"), F.max("ts")).first()
    for i in range(batches):
        df.where(F.floor((F.col("ts") - lo) / (hi - lo + 1) * batches) == i).write.mode("append").parquet(path)
    ends = {"ts": F.lit(4e9), "src": F.lit("end"), "src_ip": F.lit("end")}
    df.limit(1).select(*[ends[c].alias(c) if c in ends else F.col(c) for c in df.columns]).write.mode("append").parquet(path)
    # several files a batch: they are read by age, which hardly tells files of one second apart
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(path)


@query("l1_streamed_entropy", base(FLOWS) + "SELECT capture, src_ip, wid, count(DISTINCT dst_port) AS n_distinct, round(entropy(dst_port), 6) + 0.0 AS entropy FROM flows WHERE ts IS NOT NULL GROUP BY ALL")
def _(spark, d):
    made = live.entropies(arriving(spark, flows(spark, d), "flows"), W, "dst_port", "400 days")
    out = live.drained(made, "entropy", shared.folder(spark, "entropy"), shared.folder(spark, "entropy-state"))
    return out.where("src_ip <> 'end'")


_CHANCE = " + ".join(f"(coalesce(cnt_{i}, 0) + 0.5::DOUBLE) / (coalesce(cnt_0 + cnt_1 + cnt_2 + cnt_3 + cnt_4 + cnt_5 + cnt_6, 0) + 3.5::DOUBLE) * {c!r}::DOUBLE" for i, c in enumerate(risk.first_passage(P, HORIZON)))
_COUNTS = [f"cnt_{i}" for i in range(7)]


@query("l5_packets_to_alerts", f"""WITH RECURSIVE p0 AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, event_id % 2 = 0 AS ahead, '10.0.0.' || user_id % 20 AS a, '10.0.1.' || CAST(json_extract(props, '$.k') AS INT) % 5 AS b, event_id % 7 * 9 % 64 AS flags, event_id % 50 AS seq, floor(value) AS payload FROM events WHERE ts IS NOT NULL),
p1 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY a, b ORDER BY t, event_id) > {IDLE} THEN 1 ELSE 0 END AS cut FROM p0), p2 AS (SELECT *, sum(cut) OVER (PARTITION BY a, b ORDER BY t, event_id) AS run FROM p1),
s AS (SELECT a, b, run, min(t) AS t FROM p2 GROUP BY ALL UNION ALL SELECT * FROM (SELECT s.a, s.b, s.run, min(p2.t) AS t FROM s JOIN p2 ON p2.a = s.a AND p2.b = s.b AND p2.run = s.run AND p2.t - s.t > {ACTIVE} GROUP BY s.a, s.b, s.run, s.t)),
f AS (SELECT p2.*, (SELECT max(s.t) FROM s WHERE s.a = p2.a AND s.b = p2.b AND s.run = p2.run AND s.t <= p2.t) AS start FROM p2),
fl AS (SELECT arg_min(CASE WHEN ahead THEN a ELSE b END, (t, event_id)) AS src_ip, min(t) AS ts, count(*) FILTER (WHERE flags & 2 > 0) AS syn, count(*) FILTER (WHERE flags & 4 > 0) AS rst, count(*) FILTER (WHERE payload > 0) - count(DISTINCT (ahead, seq)) FILTER (WHERE payload > 0) AS retrans FROM f GROUP BY a, b, run, start),
c AS (SELECT src_ip, floor(ts / {W})::BIGINT AS wid, {', '.join(f'count(*) FILTER (WHERE st = {i}) AS cnt_{i}' for i in range(7))} FROM (SELECT *, {STAGE} AS st FROM fl) GROUP BY ALL),
g AS (SELECT *, CASE WHEN wid - lag(wid) OVER (PARTITION BY src_ip ORDER BY wid) > {GAP} THEN 1 ELSE 0 END AS new FROM c), r AS (SELECT *, sum(new) OVER (PARTITION BY src_ip ORDER BY wid) AS run FROM g),
e AS (SELECT src_ip, run, unnest(generate_series(min(wid), max(wid))) AS wid FROM r GROUP BY src_ip, run), x AS (SELECT e.src_ip, e.run, e.wid, {_CHANCE} AS risk FROM e LEFT JOIN r ON r.src_ip = e.src_ip AND r.wid = e.wid),
i AS (SELECT *, wid - row_number() OVER (PARTITION BY src_ip, run ORDER BY wid) AS island FROM x WHERE risk >= {LIMIT})
SELECT src_ip, (min(wid) * {W})::BIGINT AS start, ((max(wid) + 1) * {W})::BIGINT AS "end", count(*) AS cells, round(max(risk), 6) + 0.0 AS peak, CASE WHEN max(risk) >= 0.9 THEN 'CRITICAL' WHEN max(risk) >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM i GROUP BY src_ip, run, island HAVING count(*) >= 2""")
def _(spark, d):
    """One streaming query from packets to alerts: flows, cells, host states and alert runs keep state one after the other."""
    before = spark.conf.get(chain.STORE)
    chain.stored_in_rocksdb(spark)
    try:
        p = events.packets(spark, d).withColumn("flags", F.expr("CAST(event_id % 7 * 9 % 64 AS INT)"))
        made = chain.alerts(arriving(spark, p, "packets"), "live", IDLE, ACTIVE, W, GAP, STAGE, P, HORIZON, LIMIT, 2, "400 days")
        out = live.drained(made, "alerts", shared.folder(spark, "alerts"), shared.folder(spark, "alerts-state"))
    finally:
        spark.conf.set(chain.STORE, before)
    return out.where("src_ip <> 'end'").select("src_ip", "start", "end", "cells", "peak", "severity")
