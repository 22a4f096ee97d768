"""Packets to bidirectional flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["ip_a", "port_a", "ip_b", "port_b", "proto"]


def keyed(packets: DataFrame) -> DataFrame:
    """Both directions of a conversation under one key: the lesser endpoint first."""
    a, b = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return packets.withColumn("ip_a", lo["ip"]).withColumn("port_a", lo["port"]).withColumn("ip_b", hi["ip"]).withColumn("port_b", hi["port"])


def active_starts(p: DataFrame, active_s: int) -> DataFrame:
    """p (with flow, runs without silence) cut where a flow's age passes active_s: a flow begins with its run's first packet or the first one over
    active_s after the flow's own beginning. Each packet knows the beginning that would follow it; those that follow the run's first are found by doubling."""
    run = [*KEY, "flow"]
    w = Window.partitionBy(*run).orderBy("ts")
    sweep = Window.partitionBy(*run).orderBy(F.desc("_at"), F.col("_asked").isNotNull())
    p = p.withColumn("_t0", F.min("ts").over(Window.partitionBy(*run)))
    span = p.agg(F.max((F.col("ts") - F.col("_t0")) / active_s)).first()[0] or 0
    if span <= 1:
        return p.drop("_t0")
    times = p.select(*run, "ts").distinct()
    # times and questions (the first time at _at or later) in one order from the last: a frame that ends at each row grows by it, one that begins there is scanned anew
    asked = times.select(*run, (F.col("ts") + active_s).cast("double").alias("_at"), F.col("ts").alias("_asked"), F.lit(None).cast("double").alias("_time"))
    both = asked.unionByName(times.select(*run, F.col("ts").cast("double").alias("_at"), F.lit(None).cast("double").alias("_asked"), F.col("ts").alias("_time")))
    found = F.last("_time", ignorenulls=True).over(sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nxt = both.withColumn("to", found).where("_asked IS NOT NULL").select(*run, F.col("_asked").alias("ts"), "to")
    later = times.withColumn("after", F.lead("ts").over(w)).select(*run, F.col("ts").alias("to"), "after")
    over = F.col("to") - F.col("at") > active_s  # exactly active_s later is not over it
    jump = nxt.withColumnRenamed("ts", "at").join(later, [*run, "to"], "left").select(*run, "at", F.when(over, F.col("to")).otherwise(F.col("after")).alias("to"))
    starts = p.groupBy(*run).agg(F.min("ts").alias("at"))
    for _ in range(int(span).bit_length()):
        starts = starts.unionByName(starts.join(jump, [*run, "at"]).where("to IS NOT NULL").select(*run, F.col("to").alias("at"))).distinct()
        step = jump.select(*run, F.col("at").alias("to"), F.col("to").alias("far"))
        jump = jump.join(step, [*run, "to"], "left").select(*run, "at", F.col("far").alias("to"))
    marked = p.join(starts.select(*run, F.col("at").alias("ts"), F.lit(1).alias("_start")), [*run, "ts"], "left")
    first = F.row_number().over(Window.partitionBy(*run, "ts").orderBy("event_id")) == 1
    marked = marked.withColumn("_new", F.when(F.col("_start").isNotNull() & first & (F.col("ts") > F.col("_t0")), 1).otherwise(0))
    order = Window.partitionBy(*KEY).orderBy("flow", "ts", "event_id")
    again = F.when(F.col("flow") != F.lag("flow").over(order), 1).otherwise(F.col("_new"))
    return marked.withColumn("_cut", again).withColumn("flow", F.sum("_cut").over(order)).drop("_t0", "_start", "_new", "_cut")


def to_flows(packets: DataFrame, idle_s: float, active_s: int | None = None) -> DataFrame:
    """Flows that end after idle_s of silence, or once they are older than active_s (whole seconds); the first packet's direction is forward."""
    w = Window.partitionBy(*KEY).orderBy("ts", "event_id")
    p = keyed(packets).withColumn("_new", F.when(F.col("ts") - F.lag("ts").over(w) > idle_s, 1).otherwise(0))
    p = p.withColumn("flow", F.sum("_new").over(w)).drop("_new")
    if active_s is not None:
        p = active_starts(p, active_s)
    return summarise(p)


def summarise(p: DataFrame) -> DataFrame:
    """A row for each flow of packets with their key and `flow`."""
    f = Window.partitionBy(*KEY, "flow").orderBy("ts", "event_id")
    p = p.withColumn("fwd", F.col("src") == F.first("src").over(f)).withColumn("gap", F.col("ts") - F.lag("ts").over(f))
    p = p.withColumn("gap", F.when(F.col("gap").isNotNull(), F.greatest("gap", F.lit(0.0))))  # the first packet has none
    tcp = F.col("proto") == 6
    bit = lambda i: F.count_if(tcp & (F.col("flags").bitwiseAND(F.lit(1 << i)) > 0))
    seqs = F.when(tcp & (F.col("payload") > 0), F.struct("fwd", "seq"))
    return p.groupBy(*KEY, "flow").agg(
        F.min("ts").alias("ts"), F.count_if("fwd").alias("fwd_pkts"), F.count_if(~F.col("fwd")).alias("bwd_pkts"), F.sum(F.when(F.col("fwd"), F.col("length")).otherwise(0)).alias("fwd_bytes"), F.sum(F.when(~F.col("fwd"), F.col("length")).otherwise(0)).alias("bwd_bytes"),
        (F.max("ts") - F.min("ts")).alias("duration"), F.avg("ttl").alias("ttl_mean"), F.stddev_pop("ttl").alias("ttl_std"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("iat_mean"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("iat_std"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("iat_max"),
        bit(1).alias("syn"), bit(4).alias("ack"), bit(0).alias("fin"), bit(2).alias("rst"), bit(3).alias("psh"), bit(5).alias("urg"), *([F.coalesce(F.min_by("window", F.when(F.col("fwd") & tcp, F.struct("ts", "event_id"))), F.lit(0)).alias("init_win")] if "window" in p.columns else []), (F.count(seqs) - F.count_distinct(seqs)).alias("retrans"), F.count_if(F.col("ip_flags").bitwiseAND(F.lit(1)) > 0).alias("frag_pkts"), F.count_if(F.col("ip_flags").bitwiseAND(F.lit(2)) > 0).alias("df_pkts"),
        F.count_if(F.col("payload") <= 64).alias("small_pkts"), F.avg("payload").alias("payload_mean"), F.stddev_pop("payload").alias("payload_std"),
    )
