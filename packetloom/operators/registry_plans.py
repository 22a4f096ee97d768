"""Queries of mergeable cells, grouping sets and set operations, and their SQL; added to those of registry.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import cells, integrity, moments, reports, sequences  # noqa: F401
from packetloom.operators.registry import FEATURE_NAMES, FEATURES, FLOWS, GAP, H, KEYS, SEGW, UP_TO_SEGS, UP_TO_TARGETS, W, base, flows, full_sql, query, r6, segs, targets
from packetloom.operators.registry_reports import SPLIT, split
from packetloom.sources import shared

COUNTS = ", ".join(f"cnt_{i}" for i in range(7))
DISTINCT = "count(DISTINCT dst_ip) AS n_dst_ips, count(DISTINCT dst_port) AS n_dst_ports"


@query("d2_grouping_sets", base(FLOWS) + f"SELECT level, capture, src_ip, wid, n_flows, {r6(FEATURE_NAMES)}, ttl_missing::BIGINT AS ttl_missing, {COUNTS}, n_dst_ips, n_dst_ports FROM (SELECT GROUPING(src_ip)::BIGINT AS level, capture, src_ip, wid, {FEATURES}, {DISTINCT} FROM flows GROUP BY GROUPING SETS ((capture, src_ip, wid), (capture, wid)))")
def _(spark, d):
    """Host and network cells: flows are aggregated once, and the cells' sums once more by both groupings."""
    return moments.features(moments.rolled(moments.moments(flows(spark, d), W), [["capture", "src_ip", "wid"], ["capture", "wid"]]))


@query("d7_merged_windows", base(FLOWS) + f"SELECT capture, src_ip, wid, n_flows, {r6(FEATURE_NAMES)}, ttl_missing::BIGINT AS ttl_missing, {COUNTS}, n_dst_ips, n_dst_ports FROM (SELECT capture, src_ip, wid // 4 AS wid, {FEATURES}, {DISTINCT} FROM flows GROUP BY capture, src_ip, wid // 4)")
def _(spark, d):
    """Windows of a day from stored cells of six hours; a host meets too few addresses for the sketches to err."""
    return moments.features(moments.widened(shared.kept(moments.moments(flows(spark, d), W), "moments"), 4))


@query("j9_grouping_sets", base(*UP_TO_TARGETS) + SPLIT + """ SELECT GROUPING(stage, split_temporal, phase)::BIGINT AS level, stage::BIGINT AS stage, split_temporal, phase, count(*) AS cells, sum(y_future)::BIGINT AS positives, count(*) FILTER (WHERE is_filled = 1) AS filled FROM split GROUP BY GROUPING SETS ((stage), (phase), (split_temporal, phase))""")
def _(spark, d):
    """Counts by stage, by phase, and by split and phase, in one pass."""
    s = split(spark, d)
    out = s.groupingSets([[F.col("stage")], [F.col("phase")], [F.col("split_temporal"), F.col("phase")]], "stage", "split_temporal", "phase")
    return out.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("cells"), F.sum("y_future").alias("positives"), F.count_if("is_filled").alias("filled"))


@query("j5_shared_captures", base(*UP_TO_TARGETS) + SPLIT + """, f AS (SELECT capture, CASE capture WHEN 'c0' THEN 'train' WHEN 'c1' THEN 'val' ELSE 'train' END AS s FROM split UNION ALL SELECT capture, 'test' FROM split WHERE capture = 'c2' AND wid % 2 = 0), p AS (SELECT 'temporal' AS protocol, capture, split_temporal AS s FROM split UNION ALL SELECT 'family', capture, s FROM f)
SELECT DISTINCT a.protocol, a.s AS "left", b.s AS "right", a.capture FROM (SELECT DISTINCT * FROM p) a JOIN (SELECT DISTINCT * FROM p) b ON a.protocol = b.protocol AND a.capture = b.capture WHERE (a.s, b.s) IN (('train', 'val'), ('train', 'test'), ('val', 'test'))""")
def _(spark, d):
    """A family split that has put one capture on both sides, beside the temporal split, whose splits share all captures."""
    s = split(spark, d)
    family = cells.family_split(s, {"c0": "train", "c1": "val", "c2": "train"}).select("capture", "split_family")
    family = family.unionByName(s.where("capture = 'c2' AND wid % 2 = 0").select("capture", F.lit("test").alias("split_family")))
    named = lambda df, column, protocol: integrity.shared_captures(df, column).withColumn("protocol", F.lit(protocol))
    return named(s, "split_temporal", "temporal").unionByName(named(family, "split_family", "family"))


_CUT = "(SELECT (min(wid) + max(wid)) // 2 FROM cells)"
_CUT_TARGETS = UP_TO_TARGETS[3].replace("t0 AS", "t0c AS").replace("FROM segs", f"FROM segs WHERE wid <= {_CUT}").replace("t1 AS", "t1c AS").replace("FROM t0)", "FROM t0c)").replace("targets AS", "targetsc AS").replace("FROM t1)", "FROM t1c)")


@query("j6_truncation", base(*UP_TO_TARGETS, _CUT_TARGETS) + f"SELECT 'label' AS output, f.capture, f.src_ip, f.run, f.wid FROM targets f JOIN targetsc c USING (capture, src_ip, run, wid) WHERE f.y_future <> c.y_future")
def _(spark, d):
    """Burst and trend know nothing of what follows; the label of the cells to come, planted beside them, does."""
    s = segs(spark, d)
    ends = s.where("NOT is_filled").agg(F.min("wid"), F.max("wid")).first()
    cut = (ends[0] + ends[1]) // 2
    pipelines = {"scales": (lambda df: cells.multi_scale(df, "log_bytes", 3, 15), ["burst", "trend"]), "label": (lambda df: cells.targets(df, H), ["y_future"])}
    out = None
    for name, (pipeline, outputs) in pipelines.items():
        part = integrity.truncation(s, pipeline, outputs, cut).select(F.lit(name).alias("output"), *cells.SEGMENT, "wid")
        out = part if out is None else out.unionByName(part)
    return out


_COVERED = " UNION ALL ".join(f"SELECT capture, '{a}' AS attribute, count(*) FILTER (WHERE {flag or 0} = 0) AS cells_carried, round(avg(({flag or 0} = 0)::INT), 6) + 0.0 AS share, round(avg({f}) FILTER (WHERE {flag or 0} = 0), 5) + 0.0 AS mean_when_carried FROM f GROUP BY capture"
                              for a, flag, f in reports.ATTRIBUTES)


@query("j8_attribute_coverage", f"WITH f AS ({full_sql('capture, src_ip, wid')}) {_COVERED}")
def _(spark, d):
    out = reports.attribute_coverage(cells.full(flows(spark, d), W), ["capture"])
    return out.withColumn("mean_when_carried", F.round("mean_when_carried", 5) + 0.0)


_SCALED = ["log_bytes", "log_pkts", "n_flows", "syn_ratio", "rst_ratio", "retrans_rate", "udp_frac"]
_SCALES = " UNION ALL ".join(f"SELECT '{c}' AS c, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) > 1e-6 THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) WHEN stddev_pop({c}) > 1e-6 THEN stddev_pop({c}) ELSE 1 END AS scale FROM x" for c in _SCALED)
_PUSHED = ", ".join(f"{c} + coalesce((SELECT 20 * scale + 1 FROM low WHERE c = '{c}'), 0) AS {c}" for c in _SCALED)
_CROWD = ", ".join(f"{c} + ln(5.0::DOUBLE) AS {c}" if c in ("log_bytes", "log_pkts") else c for c in _SCALED)


@query("j7_least_scales", base(*UP_TO_SEGS) + f""", x AS (SELECT s.capture, s.src_ip, s.run, s.stage, {', '.join(f'coalesce(c.{c}, 0)::DOUBLE AS {c}' for c in _SCALED)} FROM segs s LEFT JOIN cells c USING (capture, src_ip, wid)), scales AS ({_SCALES}), low AS (SELECT * FROM scales ORDER BY round(scale, 9), c LIMIT 3),
b AS (SELECT * FROM (SELECT *, max(stage) OVER (PARTITION BY capture, src_ip, run) AS worst FROM x) WHERE worst = 0), v AS (SELECT 'original' AS variant, {', '.join(_SCALED)} FROM b UNION ALL SELECT 'flash_crowd', {_CROWD} FROM b UNION ALL SELECT 'shifted', {_PUSHED} FROM b),
r AS (SELECT variant, avg((1 / (1 + exp(-round(0.4::DOUBLE * log_bytes - 4 + syn_ratio + 0.02::DOUBLE * rst_ratio + 0.02::DOUBLE * udp_frac, 9))) >= 0.5)::INT) AS rate FROM v GROUP BY ALL)
SELECT variant, round(rate, 6) + 0.0 AS rate, (rate <= greatest(3 * (SELECT rate FROM r WHERE variant = 'original'), 0.05))::BIGINT AS fine FROM r""")
def _(spark, d):
    """The features whose scale is least are found in the scaler's table, not named."""
    s = segs(spark, d).select(*KEYS, "stage", *[F.col(c).cast("double").alias(c) for c in _SCALED])
    shifts = integrity.least_shifts(cells.scaler_table(s, _SCALED).withColumn("scale", F.round("scale", 9)))
    score = lambda x: 1 / (1 + F.exp(-F.round(0.4 * F.col("log_bytes") - 4 + F.col("syn_ratio") + 0.02 * F.col("rst_ratio") + 0.02 * F.col("udp_frac"), 9)))
    return integrity.out_of_distribution(s, score, 0.5, ["log_bytes", "log_pkts"], shifts)
