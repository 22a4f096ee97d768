"""Cells that merge: sums of moments and distinct-count sketches, from which wider windows and other granularities follow without the flows.

Means, ratios and deviations of a cell are functions of sums, so cells are stored as sums: `moments` aggregates flows once, `rolled` adds cells up
(several groupings at once by GROUPING SETS), `features` computes what `cells.build` computes from flows. Distinct counts are HyperLogLog
sketches of 2^lg_k registers: exact while a cell has few values, else within a relative standard error of 1.04 / sqrt(2^lg_k), 1.6 % at 12.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.cells import KEYS, windowed

DISTINCT = {"dst_ip": "n_dst_ips", "dst_port": "n_dst_ports"}


def moments(flows: DataFrame, seconds: int, keys: list[str] | None = None, lg_k: int = 12) -> DataFrame:
    """Sums and sketches of each cell."""
    pk = F.col("fwd_pkts") + F.col("bwd_pkts")
    s = lambda c, name: F.sum(c).alias(f"m_{name}")
    return windowed(flows, seconds).groupBy(*(keys or KEYS)).agg(
        F.count("*").alias("m_n"), s("fwd_bytes", "fwd"), s("bwd_bytes", "bwd"), s(pk, "pk"), s("duration", "duration"), s("syn", "syn"), s("ack", "ack"), s("rst", "rst"), s("retrans", "retrans"),
        F.count("ttl_mean").alias("m_ttl_n"), F.coalesce(F.sum("ttl_mean"), F.lit(0.0)).alias("m_ttl"), F.coalesce(F.sum(F.col("ttl_mean") * F.col("ttl_mean")), F.lit(0.0)).alias("m_ttl2"), F.count("ttl_std").alias("m_std_n"), F.coalesce(F.sum(F.col("ttl_std") * F.col("ttl_std")), F.lit(0.0)).alias("m_std2"),
        F.count_if(pk <= 2).alias("m_small"), F.count_if(F.col("proto") == 17).alias("m_udp"), F.count_if(F.col("dst_port") == 53).alias("m_dns"), *[F.count_if(F.col("stage") == i).alias(f"m_cnt_{i}") for i in range(7)],
        *[F.hll_sketch_agg(c, F.lit(lg_k)).alias(f"h_{c}") for c in DISTINCT],
    )


def added(cells: DataFrame) -> list[Column]:
    return [F.sum(c).alias(c) if c.startswith("m_") else F.hll_union_agg(c).alias(c) for c in cells.columns if c.startswith(("m_", "h_"))]


def rolled(cells: DataFrame, sets: list[list[str]]) -> DataFrame:
    """The cells added up by each set of columns, in one pass over the cells; columns that a set lacks are null, and `level` is the number of its set."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    bits = {sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in s): n for n, s in enumerate(sets)}
    level = F.element_at(F.create_map(*[F.lit(x) for b, n in bits.items() for x in (b, n)]), F.grouping_id().cast("int"))
    return cells.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(*added(cells), level.alias("level"))


def widened(cells: DataFrame, factor: int, keys: list[str] | None = None) -> DataFrame:
    """Cells of windows that are `factor` times as wide."""
    return cells.withColumn("wid", F.floor(F.col("wid") / factor)).groupBy(*(keys or KEYS)).agg(*added(cells))


def features(cells: DataFrame) -> DataFrame:
    """The features of `cells.build` and approximate distinct counts, from sums and sketches."""
    m = lambda c: F.col(f"m_{c}")
    pk, n, t = F.greatest(m("pk"), F.lit(1)), m("n"), m("ttl_n")
    within = F.when(m("std_n") > 0, m("std2") / m("std_n"))
    between = F.when(t > 0, (t * m("ttl2") - m("ttl") * m("ttl")) / (t * t))  # of whole numbers exactly
    return cells.select(
        *[c for c in cells.columns if not c.startswith(("m_", "h_"))], n.alias("n_flows"), F.log1p(m("fwd") + m("bwd")).alias("log_bytes"), F.log1p(m("pk")).alias("log_pkts"), F.log1p(m("duration") / n).alias("log_mean_duration"),
        *[(m(c) / pk).alias(f"{c}_ratio") for c in ("syn", "ack", "rst")], (m("retrans") / pk).alias("retrans_rate"), F.coalesce(F.when(t > 0, m("ttl") / t), F.lit(0.0)).alias("ttl_mean"), F.coalesce(F.sqrt(within + F.greatest(between, F.lit(0.0))), F.lit(0.0)).alias("ttl_std"),
        (t == 0).cast("int").alias("ttl_missing"), *[(m(c) / n).alias(name) for c, name in (("small", "small_flow_frac"), ("udp", "udp_frac"), ("dns", "dns_frac"))], (F.log1p(m("fwd")) - F.log1p(m("bwd"))).alias("log_out_in_ratio"),
        *[m(f"cnt_{i}").alias(f"cnt_{i}") for i in range(7)], *[F.hll_sketch_estimate(f"h_{c}").alias(name) for c, name in DISTINCT.items()],
    )
