"""Cells and sessions as flows arrive; the same calls take batch DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(flows: DataFrame, late: str) -> DataFrame:
    """flows with event_time, and with a watermark: rows later than `late` are dropped in a stream."""
    return flows.withColumn("event_time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long"))).withWatermark("event_time", late)


def cells(flows: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Decomposable features of tumbling windows by host; distinct counts are approximate in a stream."""
    w = F.window("event_time", f"{seconds} seconds")
    pkts = F.col("fwd_pkts") + F.col("bwd_pkts")
    out = timed(flows, late).groupBy(w.alias("w"), "capture", "src_ip").agg(
        F.count("*").alias("n_flows"), F.log1p(F.sum(F.col("fwd_bytes") + F.col("bwd_bytes"))).alias("log_bytes"), F.log1p(F.sum(pkts)).alias("log_pkts"),
        (F.sum("syn") / F.greatest(F.sum(pkts), F.lit(1))).alias("syn_ratio"), F.approx_count_distinct("dst_ip").alias("n_dst"), *[F.count_if(F.col("stage") == i).alias(f"cnt_{i}") for i in range(7)],
    )
    return out.withColumn("wid", F.floor(F.unix_micros("w.start") / (seconds * 1_000_000)).cast("long")).drop("w")


def sessions(flows: DataFrame, gap_s: int, late: str = "1 hour") -> DataFrame:
    """Conversations split by gap_s of silence: start and end of each in microseconds, and its flows."""
    w = F.session_window("event_time", f"{gap_s} seconds")
    out = timed(flows, late).groupBy(w.alias("w"), "capture", "src_ip", "dst_ip").agg(F.count("*").alias("n"), F.max("event_time").alias("_last"))
    return out.select("capture", "src_ip", "dst_ip", F.unix_micros("w.start").alias("start_us"), F.unix_micros("_last").alias("last_us"), "n")


def entropies(flows: DataFrame, seconds: int, value: str, late: str = "1 hour") -> DataFrame:
    """Distinct values and Shannon entropy (base 2) of each window and host, exactly: one aggregation counts each value, a second one that follows it adds up."""
    width = f"{seconds} seconds"
    counts = timed(flows, late).groupBy(F.window("event_time", width).alias("w"), "capture", "src_ip", value).agg(F.count("*").alias("c"))
    n = F.sum("c")
    out = counts.groupBy(F.window("w", width).alias("v"), "capture", "src_ip").agg(F.count("*").alias("n_distinct"), (F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("entropy"))
    return out.select("capture", "src_ip", F.floor(F.unix_micros("v.start") / (seconds * 1_000_000)).cast("long").alias("wid"), "n_distinct", "entropy")


def drained(stream: DataFrame, name: str, path: str, checkpoint: str) -> DataFrame:
    """What a stream gives for all that its source has, appended to Parquet files at path; run again with the same checkpoint, it goes on."""
    spark = stream.sparkSession
    stream.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
