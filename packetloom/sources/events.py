"""Flows and packets as views of the `events` table (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.stages import LATERAL_PORTS, stage_of

PORTS = [443, 80, 53, 22, 445, 3389, 8080, 123, 25, 993, 135, 21]
LABEL = """CASE WHEN event_type = 'error' AND value >= 100 THEN 'DDOS attack-HOIC' WHEN event_type = 'signup' AND value >= 100 THEN 'PortScan'
 WHEN event_type = 'purchase' AND value >= 120 THEN 'Bot' WHEN event_type = 'click' AND value >= 150 THEN 'SSH-Bruteforce'
 WHEN event_type = 'view' AND value >= 200 THEN 'Exfiltration' ELSE 'Benign' END"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    port = F.element_at(F.array(*map(F.lit, PORTS)), F.col("k") % 12 + 1)
    e = e.select(
        "event_id", "ts", F.expr("concat('c', user_id % 3)").alias("capture"), F.expr("concat('10.0.', user_id div 250, '.', user_id % 250)").alias("src_ip"),
        F.expr("CASE WHEN k < 40 THEN concat('10.0.1.', k % 20) ELSE concat('203.0.113.', k) END").alias("dst_ip"), port.alias("dst_port"),
        F.expr("1 + event_id % 7").alias("fwd_pkts"), F.expr("event_id % 5").alias("bwd_pkts"), F.expr("round(value * 100)").alias("fwd_bytes"), F.expr("floor(value) * 10 * (event_id % 5)").cast("double").alias("bwd_bytes"),
        F.expr("(event_id % 1000) / 100D").alias("duration"), F.expr("event_id % 2").alias("syn"), F.expr("event_id % 6").alias("ack"), F.expr("CAST(event_id % 11 = 0 AS INT)").alias("rst"),
        F.expr("CASE WHEN event_id % 4 <> 0 THEN 64D + event_id % 5 END").alias("ttl_mean"), F.expr("CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 3 AS DOUBLE) END").alias("ttl_std"), F.expr("CAST(event_id % 13 = 0 AS INT)").alias("retrans"), F.expr(LABEL).alias("label"),
        F.expr("1024 + event_id % 60000").alias("src_port"), F.expr("(event_id % 1000) / 1000D").alias("iat_mean"), F.expr("(event_id % 1000) / 2000D").alias("iat_std"), F.expr("event_id % 2").alias("fin"), F.expr("event_id % 3").alias("psh"), F.lit(0).alias("urg"),
        *[F.expr(f"CASE WHEN user_id % 2 = 0 THEN CAST({x} AS DOUBLE) END").alias(c) for c, x in (("payload_mean", "40 + event_id % 400"), ("payload_std", "event_id % 50"), ("payload_small_pkts", "event_id % 3"), ("frag_pkts", "event_id % 2"), ("df_pkts", "event_id % 4"), ("iat_max", "(event_id % 500) / 10D"))],
        F.element_at(F.array(*map(F.lit, [0, 8192, 29200, 64240])), (F.col("event_id") % 4 + 1).cast("int")).alias("init_win"),
    )
    inside = F.col("src_ip").startswith("10.") & F.col("dst_ip").startswith("10.")
    stage = stage_of(F.col("label"))
    return e.withColumn("proto", F.when(F.col("dst_port").isin(53, 123), 17).otherwise(6)).withColumn("raw_stage", stage).withColumn("stage", F.when((F.col("raw_stage") > 0) & inside & F.col("dst_port").isin(LATERAL_PORTS), 3).otherwise(F.col("raw_stage")))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    a, b, ahead = "concat('10.0.0.', user_id % 20)", "concat('10.0.1.', CAST(get_json_object(props, '$.k') AS INT) % 5)", "event_id % 2 = 0"
    return e.select("event_id", "ts", F.expr(f"IF({ahead}, {a}, {b})").alias("src"), F.expr(f"IF({ahead}, {b}, {a})").alias("dst"), F.expr(f"IF({ahead}, 40000, 443)").alias("sport"), F.expr(f"IF({ahead}, 443, 40000)").alias("dport"), F.lit(6).alias("proto"),
                    F.expr("CAST(event_id * 7 % 64 AS INT)").alias("flags"), F.expr("event_id % 50").alias("seq"), F.expr("floor(value)").alias("payload"), F.expr("40 + floor(value)").alias("length"), F.expr("64 - event_id % 3").alias("ttl"), F.expr("event_id % 3").alias("ip_flags"), F.expr("8192 + event_id % 100").alias("window"))
