"""Queries over folders of flow files, written from the fixture in several layouts, and their SQL; added to those of registry.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.registry import FLOWS, GAP, W, base, flows, query
from packetloom.sources import files, normalize, shared


def folder(spark: SparkSession, d: str) -> str:
    """A folder of captures: c0 under one header with its time format, c1 under the same header with another and compressed, c2 as
    a botnet scenario under another header with a third. Some times are garbage, some lines have a field too many; one file has no times at all."""
    path, f = shared.folder(spark, "captures"), flows(spark, d)

    def write(capture: str, layout: str, to: str, time: str, pattern: str, **options) -> None:
        out = normalize.written(f.where(F.col("capture") == capture), layout, "event_id")
        stamp = F.date_format(F.try_to_timestamp(time, F.lit(normalize.FORMATS[0 if layout == "cic" else 2])), pattern)
        out = out.withColumn(time, F.when(F.col("event_id") % 97 == 0, "not-a-date").otherwise(stamp)).withColumn("Label", F.when(F.col("event_id") % 53 == 0, F.concat("Label", F.lit(",more"))).otherwise(F.col("Label")))
        out.drop("event_id").repartition(2).write.csv(f"{path}/{to}", header=True, quote="", **options)

    write("c0", "cic", "c0.csv", "Timestamp", "dd/MM/yyyy HH:mm:ss")
    write("c1", "cic", "c1.csv", "Timestamp", "yyyy-MM-dd HH:mm:ss", compression="gzip")
    write("c2", "binetflow", "CTU-13-Dataset/2/c2.binetflow", "StartTime", "yyyy/MM/dd HH:mm:ss.SSSSSS")
    f.limit(3).select(F.col("src_ip").alias("Src IP"), F.col("duration").alias("Dur")).coalesce(1).write.csv(f"{path}/notes.csv", header=True)
    return path


@query("a2_mixed_folder", base(FLOWS) + """SELECT CASE WHEN capture = 'c2' THEN '2' ELSE capture END AS capture, floor(ts)::BIGINT AS second, src_ip, dst_ip, src_port::BIGINT AS src_port, dst_port::BIGINT AS dst_port, proto::BIGINT AS proto, round(CASE WHEN capture = 'c2' THEN duration ELSE round(duration * 1000000) / 1000000 END, 6) + 0.0 AS duration,
 (CASE WHEN capture = 'c2' THEN fwd_pkts + bwd_pkts ELSE fwd_pkts END)::DOUBLE AS fwd_pkts, (CASE WHEN capture = 'c2' THEN 0 ELSE bwd_pkts END)::DOUBLE AS bwd_pkts, round(fwd_bytes, 6) + 0.0 AS fwd_bytes, round(bwd_bytes, 6) + 0.0 AS bwd_bytes, CASE WHEN capture = 'c2' THEN NULL ELSE ttl_mean END AS ttl_mean,
 CASE WHEN capture <> 'c2' THEN raw_stage WHEN raw_stage = 0 THEN 0 WHEN raw_stage = 1 THEN 1 ELSE 4 END::BIGINT AS stage FROM flows WHERE event_id % 97 <> 0 AND event_id % 53 <> 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = files.scan(spark, folder(spark, d))
    return out.select("capture", F.floor("ts").alias("second"), "src_ip", "dst_ip", "src_port", "dst_port", "proto", "duration", "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "ttl_mean", "stage")


@query("a9_folder_accounting", base(FLOWS) + """, r AS (SELECT CASE WHEN capture = 'c2' THEN '2' ELSE capture END AS capture, src_ip, wid, CASE WHEN event_id % 53 = 0 THEN 'bad' WHEN event_id % 97 = 0 THEN 'time' ELSE 'flow' END AS status, src_ip LIKE '10.0.0.%' AS inside FROM flows),
n AS (SELECT capture, count(*) AS lines, count(*) FILTER (WHERE status = 'flow') AS flows, count(*) FILTER (WHERE status = 'flow' AND inside) AS flows_kept, count(*) FILTER (WHERE status = 'bad') AS bad_lines, count(*) FILTER (WHERE status = 'time') AS no_time FROM r GROUP BY ALL),
c AS (SELECT DISTINCT capture, src_ip, wid FROM r WHERE status = 'flow' AND inside), g AS (SELECT *, CASE WHEN wid - lag(wid) OVER (PARTITION BY capture, src_ip ORDER BY wid) > 10 THEN 1 ELSE 0 END AS cut FROM c), s AS (SELECT *, sum(cut) OVER (PARTITION BY capture, src_ip ORDER BY wid) AS run FROM g),
e AS (SELECT capture, src_ip, run, max(wid) - min(wid) + 1 AS k FROM s GROUP BY ALL), m AS (SELECT capture, count(DISTINCT src_ip) AS hosts, sum(k)::BIGINT AS windows, count(*) AS segments FROM e GROUP BY ALL)
SELECT capture, 2::BIGINT AS files, lines, flows, flows_kept, bad_lines, no_time, coalesce(hosts, 0) AS hosts, coalesce(windows, 0) AS windows, coalesce(segments, 0) AS segments, 0::BIGINT AS skipped_files FROM n LEFT JOIN m USING (capture) UNION ALL SELECT 'notes', 0, 0, 0, 0, 0, 0, 0, 0, 0, 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The lines are stored once, counted as they are written; the counts by capture come from what was stored."""
    lines, skipped = files.rows(spark, folder(spark, d))
    path = shared.folder(spark, "lines")
    seen = files.stored(lines, path)
    out = files.accounting(spark.read.schema(lines.schema).parquet(path), skipped, W, GAP, ["10.0.0."])
    told = out.agg(*[F.sum(c).alias(c) for c in seen]).first().asDict()
    if told != seen:
        raise ValueError(f"stored {told}, observed {seen}")
    return out
