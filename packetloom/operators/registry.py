"""Queries over the telemetry fixtures, one for each operator, and their SQL in DuckDB's dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.stages import STAGES
from packetloom.operators import cells, metrics, packets, risk
from packetloom.sources import events

W, GAP, H, PURGE, PARTICLES = 21600, 10, 10, 6, 32
KEYS = ["capture", "src_ip", "run", "wid"]
QUERIES: dict = {}
ORACLE: dict = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six places (summation order differs between engines), whole numbers as long."""
    kinds = {"double": lambda c: F.round(c, 6) + 0.0, "int": lambda c: F.col(c).cast("long"), "boolean": lambda c: F.col(c).cast("long")}
    return df.select(*[kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---- SQL building blocks
FLOWS = """f0 AS (SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k, epoch_us(ts) / 1e6 AS ts FROM events),
f1 AS (SELECT event_id, ts, 'c' || user_id % 3 AS capture, '10.0.' || user_id // 250 || '.' || user_id % 250 AS src_ip, CASE WHEN k < 40 THEN '10.0.1.' || k % 20 ELSE '203.0.113.' || k END AS dst_ip,
 [443,80,53,22,445,3389,8080,123,25,993,135,21][k % 12 + 1] AS dst_port, 1 + event_id % 7 AS fwd_pkts, event_id % 5 AS bwd_pkts, round(value * 100) AS fwd_bytes, floor(value) * 10 * (event_id % 5) AS bwd_bytes, (event_id % 1000) / 100.0::DOUBLE AS duration,
 event_id % 2 AS syn, event_id % 6 AS ack, (event_id % 11 = 0)::INT AS rst, CASE WHEN event_id % 4 <> 0 THEN (64 + event_id % 5)::DOUBLE END AS ttl_mean, CASE WHEN event_id % 4 <> 0 THEN (event_id % 3)::DOUBLE END AS ttl_std, (event_id % 13 = 0)::INT AS retrans, 1024 + event_id % 60000 AS src_port, (event_id % 1000) / 1000.0::DOUBLE AS iat_mean, (event_id % 1000) / 2000.0::DOUBLE AS iat_std, event_id % 2 AS fin, event_id % 3 AS psh, 0 AS urg,
 CASE WHEN user_id % 2 = 0 THEN (40 + event_id % 400)::DOUBLE END AS payload_mean, CASE WHEN user_id % 2 = 0 THEN (event_id % 50)::DOUBLE END AS payload_std, CASE WHEN user_id % 2 = 0 THEN (event_id % 3)::DOUBLE END AS payload_small_pkts, CASE WHEN user_id % 2 = 0 THEN (event_id % 2)::DOUBLE END AS frag_pkts,
 CASE WHEN user_id % 2 = 0 THEN (event_id % 4)::DOUBLE END AS df_pkts, CASE WHEN user_id % 2 = 0 THEN (event_id % 500) / 10.0::DOUBLE END AS iat_max, [0, 8192, 29200, 64240][event_id % 4 + 1] AS init_win,
 CASE WHEN event_type = 'error' AND value >= 100 THEN 6 WHEN event_type = 'signup' AND value >= 100 THEN 1 WHEN event_type = 'purchase' AND value >= 120 THEN 4 WHEN event_type = 'click' AND value >= 150 THEN 2 WHEN event_type = 'view' AND value >= 200 THEN 5 ELSE 0 END AS raw_stage FROM f0),
flows AS (SELECT *, CASE WHEN dst_port IN (53, 123) THEN 17 ELSE 6 END AS proto, CASE WHEN raw_stage > 0 AND dst_ip LIKE '10.%' AND dst_port IN (22,23,135,139,445,3389,5900,5985) THEN 3 ELSE raw_stage END AS stage, floor(ts / 21600)::BIGINT AS wid FROM f1)"""
FEATURES = """count(*) AS n_flows, ln(1 + sum(fwd_bytes + bwd_bytes)) AS log_bytes, ln(1 + sum(fwd_pkts + bwd_pkts)) AS log_pkts, ln(1 + avg(duration)) AS log_mean_duration,
 sum(syn) / greatest(sum(fwd_pkts + bwd_pkts), 1) AS syn_ratio, sum(ack) / greatest(sum(fwd_pkts + bwd_pkts), 1) AS ack_ratio, sum(rst) / greatest(sum(fwd_pkts + bwd_pkts), 1) AS rst_ratio, sum(retrans) / greatest(sum(fwd_pkts + bwd_pkts), 1) AS retrans_rate,
 coalesce(avg(ttl_mean), 0) AS ttl_mean, coalesce(sqrt(avg(ttl_std * ttl_std) + var_pop(ttl_mean)), 0) AS ttl_std, (count(ttl_mean) = 0)::INT AS ttl_missing, avg((fwd_pkts + bwd_pkts <= 2)::INT) AS small_flow_frac, avg((proto = 17)::INT) AS udp_frac, avg((dst_port = 53)::INT) AS dns_frac,
 ln(1 + sum(fwd_bytes)) - ln(1 + sum(bwd_bytes)) AS log_out_in_ratio, """ + ", ".join(f"count(*) FILTER (WHERE stage = {i}) AS cnt_{i}" for i in range(7))
CELLS = f"cells AS (SELECT capture, src_ip, wid, {FEATURES} FROM flows GROUP BY ALL)"
DOMINANT = "CASE WHEN list_max([cnt_1,cnt_2,cnt_3,cnt_4,cnt_5,cnt_6]) > 0 THEN list_position([cnt_1,cnt_2,cnt_3,cnt_4,cnt_5,cnt_6], list_max([cnt_1,cnt_2,cnt_3,cnt_4,cnt_5,cnt_6])) ELSE 0 END"
SEGS = f"""r0 AS (SELECT *, CASE WHEN wid - lag(wid) OVER (PARTITION BY capture, src_ip ORDER BY wid) > 10 THEN 1 ELSE 0 END AS cut FROM cells),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY capture, src_ip ORDER BY wid) AS run FROM r0),
ends AS (SELECT capture, src_ip, run, min(wid) AS a, max(wid) AS b FROM runs GROUP BY ALL), span AS (SELECT capture, src_ip, run, unnest(generate_series(a, b)) AS wid FROM ends),
segs AS (SELECT s.capture, s.src_ip, s.run::BIGINT AS run, s.wid, (n_flows IS NULL)::INT AS is_filled, coalesce(n_flows, 0) AS n_flows, coalesce(log_bytes, 0) AS log_bytes, coalesce(syn_ratio, 0) AS syn_ratio,
 {', '.join(f'coalesce(cnt_{i}, 0) AS cnt_{i}' for i in range(7))}, coalesce({DOMINANT}, 0) AS stage FROM span s LEFT JOIN runs r ON r.capture = s.capture AND r.src_ip = s.src_ip AND r.wid = s.wid)"""
SEGW = "(PARTITION BY capture, src_ip, run ORDER BY wid"
TARGETS = f"""t0 AS (SELECT *, (stage >= 2)::INT AS exploit_now FROM segs),
t1 AS (SELECT *, min(CASE WHEN exploit_now = 1 THEN wid END) OVER {SEGW} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nx FROM t0),
targets AS (SELECT * EXCLUDE (nx), (nx IS NOT NULL)::INT AS y_future, coalesce(nx - wid, -1) AS time_to_attack, CASE WHEN exploit_now = 1 THEN 'during_attack' WHEN nx IS NOT NULL THEN 'pre_attack' ELSE 'benign' END AS phase FROM t1)"""
DRAW = "('0x' || substr(md5({r} || '|' || capture || '|' || src_ip || '|' || wid), 1, 8))::UBIGINT / 4294967296.0::DOUBLE"
SCORES = f"scored AS (SELECT *, round(0.55::DOUBLE * y_future * {DRAW.format(r='0')} + 0.45::DOUBLE * {DRAW.format(r='100')}, 4) AS risk FROM targets)"
base = lambda *parts: "WITH " + ",\n".join(parts) + "\n"
UP_TO_SEGS = (FLOWS, CELLS, SEGS)
UP_TO_TARGETS = (*UP_TO_SEGS, TARGETS)
UP_TO_SCORES = (*UP_TO_TARGETS, SCORES)


# ---- the same in Spark
def flows(spark: SparkSession, d: str) -> DataFrame:
    return events.flows(spark, d)


def segs(spark: SparkSession, d: str) -> DataFrame:
    return cells.segments(cells.build(flows(spark, d), W), GAP)


def targets(spark: SparkSession, d: str) -> DataFrame:
    return cells.targets(segs(spark, d), H)


def scored(spark: SparkSession, d: str) -> DataFrame:
    u, v = (risk.draw(F.lit(r), "capture", "src_ip", "wid") for r in (0, 100))
    return targets(spark, d).withColumn("risk", F.round(0.55 * F.col("y_future") * u + 0.45 * v, 4))


r6 = lambda cols: ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)
FEATURE_NAMES = ["log_bytes", "log_pkts", "log_mean_duration", "syn_ratio", "ack_ratio", "rst_ratio", "retrans_rate", "ttl_mean", "ttl_std", "small_flow_frac", "udp_frac", "dns_frac", "log_out_in_ratio"]


@query("b10_label_stage", base(FLOWS) + "SELECT raw_stage, stage, count(*) AS n FROM flows GROUP BY ALL")
def _(spark, d):
    return flows(spark, d).groupBy("raw_stage", "stage").agg(F.count("*").alias("n"))


@query("b12_monitored_hosts", base(FLOWS) + "SELECT capture, count(*) AS n, count(DISTINCT src_ip) AS hosts FROM flows WHERE src_ip LIKE '10.0.0.%' OR src_ip LIKE '10.0.1.%' GROUP BY ALL")
def _(spark, d):
    return flows(spark, d).where(F.col("src_ip").startswith("10.0.0.") | F.col("src_ip").startswith("10.0.1.")).groupBy("capture").agg(F.count("*").alias("n"), F.count_distinct("src_ip").alias("hosts"))


@query("a9_ingest_accounting", base(FLOWS) + "SELECT capture, count(*) AS flows, count(DISTINCT src_ip) AS hosts, count(DISTINCT wid) AS windows, count(*) FILTER (WHERE stage > 0) AS malicious FROM flows GROUP BY ALL")
def _(spark, d):
    return cells.windowed(flows(spark, d), W).groupBy("capture").agg(F.count("*").alias("flows"), F.count_distinct("src_ip").alias("hosts"), F.count_distinct("wid").alias("windows"), F.count_if(F.col("stage") > 0).alias("malicious"))


@query("c_packet_flows", """WITH p0 AS (SELECT *, epoch_us(ts) / 1e6 AS t, '10.0.0.' || user_id % 20 AS a, '10.0.1.' || CAST(json_extract(props, '$.k') AS INT) % 5 AS b FROM events),
p1 AS (SELECT event_id, t AS ts, a AS ip_a, 40000 AS port_a, b AS ip_b, 443 AS port_b, event_id % 2 = 0 AS ahead, event_id * 7 % 64 AS flags, event_id % 50 AS seq, floor(value) AS payload, 40 + floor(value) AS length, 64 - event_id % 3 AS ttl, event_id % 3 AS ip_flags FROM p0),
p2 AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > 21600 THEN 1 ELSE 0 END AS cut FROM p1 WINDOW w AS (PARTITION BY ip_a, ip_b ORDER BY ts, event_id)),
p3 AS (SELECT *, sum(cut) OVER (PARTITION BY ip_a, ip_b ORDER BY ts, event_id) AS flow FROM p2),
p4 AS (SELECT *, ahead = first_value(ahead) OVER w AS fwd, CASE WHEN lag(ts) OVER w IS NOT NULL THEN greatest(ts - lag(ts) OVER w, 0) END AS gap FROM p3 WINDOW w AS (PARTITION BY ip_a, ip_b, flow ORDER BY ts, event_id))
SELECT ip_a, port_a, ip_b, port_b, flow::BIGINT AS flow, round(min(ts), 6) AS ts, count(*) FILTER (WHERE fwd) AS fwd_pkts, count(*) FILTER (WHERE NOT fwd) AS bwd_pkts, coalesce(sum(length) FILTER (WHERE fwd), 0)::BIGINT AS fwd_bytes, coalesce(sum(length) FILTER (WHERE NOT fwd), 0)::BIGINT AS bwd_bytes,
 round(avg(ttl), 6) AS ttl_mean, round(stddev_pop(ttl), 6) AS ttl_std, count(*) FILTER (WHERE flags & 2 > 0) AS syn, count(*) FILTER (WHERE flags & 16 > 0) AS ack, count(*) FILTER (WHERE flags & 1 > 0) AS fin, count(*) FILTER (WHERE flags & 4 > 0) AS rst, count(*) FILTER (WHERE flags & 8 > 0) AS psh, count(*) FILTER (WHERE flags & 32 > 0) AS urg, coalesce(arg_min(8192 + event_id % 100, (ts, event_id)) FILTER (WHERE fwd), 0) AS init_win,
 round(max(ts) - min(ts), 5) + 0.0 AS duration, round(coalesce(avg(gap), 0), 5) + 0.0 AS iat_mean, round(coalesce(stddev_pop(gap), 0), 4) + 0.0 AS iat_std, round(coalesce(max(gap), 0), 5) + 0.0 AS iat_max, round(stddev_pop(payload), 6) + 0.0 AS payload_std,
 count(*) FILTER (WHERE payload > 0) - count(DISTINCT (fwd, seq)) FILTER (WHERE payload > 0) AS retrans, count(*) FILTER (WHERE ip_flags & 1 > 0) AS frag_pkts, count(*) FILTER (WHERE ip_flags & 2 > 0) AS df_pkts, count(*) FILTER (WHERE payload <= 64) AS small_pkts, round(avg(payload), 6) AS payload_mean FROM p4 GROUP BY ALL""")
def _(spark, d):
    out = packets.to_flows(events.packets(spark, d), W).drop("proto")
    return out.withColumns({c: F.round(c, k) for c, k in (("duration", 5), ("iat_mean", 5), ("iat_std", 4), ("iat_max", 5))})


@query("c2_active_timeout", """WITH RECURSIVE p0 AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, '10.0.0.' || user_id % 20 AS a, '10.0.1.' || CAST(json_extract(props, '$.k') AS INT) % 5 AS b FROM events),
p1 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY a, b ORDER BY t, event_id) > 21600 THEN 1 ELSE 0 END AS cut FROM p0), p2 AS (SELECT *, sum(cut) OVER (PARTITION BY a, b ORDER BY t, event_id) AS run FROM p1),
s AS (SELECT a, b, run, min(t) AS t FROM p2 GROUP BY ALL UNION ALL SELECT * FROM (SELECT s.a, s.b, s.run, min(p2.t) AS t FROM s JOIN p2 ON p2.a = s.a AND p2.b = s.b AND p2.run = s.run AND p2.t - s.t > 172800 GROUP BY s.a, s.b, s.run, s.t)),
f AS (SELECT p2.*, (SELECT max(s.t) FROM s WHERE s.a = p2.a AND s.b = p2.b AND s.run = p2.run AND s.t <= p2.t) AS start FROM p2)
SELECT a AS ip_a, b AS ip_b, round(min(t), 5) + 0.0 AS ts, count(*) AS pkts, round(max(t) - min(t), 5) + 0.0 AS duration FROM f GROUP BY a, b, run, start""")
def _(spark, d):
    out = packets.to_flows(events.packets(spark, d), W, 172800)
    return out.select("ip_a", "ip_b", F.round("ts", 5).alias("ts"), (F.col("fwd_pkts") + F.col("bwd_pkts")).alias("pkts"), F.round("duration", 5).alias("duration"))


PK = "greatest(sum(fwd_pkts + bwd_pkts), 1)"
FULL = {"log_flows": "ln(1 + count(*))", "log_bytes": "ln(1 + sum(fwd_bytes + bwd_bytes))", "log_pkts": "ln(1 + sum(fwd_pkts + bwd_pkts))", "log_mean_duration": "ln(1 + avg(duration))", "log_bytes_per_flow": "ln(1 + sum(fwd_bytes + bwd_bytes) / count(*))", "n_src_ips": "ln(1 + count(DISTINCT src_ip))",
        "n_dst_ips": "ln(1 + count(DISTINCT dst_ip))", "n_dst_ports": "ln(1 + count(DISTINCT dst_port))", "dst_port_entropy": "entropy(dst_port)", "dst_ip_entropy": "entropy(dst_ip)", **{f"{f}_ratio": f"sum({f}) / {PK}" for f in ("syn", "ack", "fin", "rst", "psh", "urg")},
        "flag_bitmask_entropy": "entropy((syn > 0)::INT + 2 * (ack > 0)::INT + 4 * (fin > 0)::INT + 8 * (rst > 0)::INT + 16 * (psh > 0)::INT)", "ttl_mean": "coalesce(avg(ttl_mean), 0)", "ttl_std": "sqrt(coalesce(avg(ttl_std * ttl_std), 0) + coalesce(var_pop(ttl_mean), 0))",
        "init_win_mean": "coalesce(ln(1 + avg(init_win) FILTER (WHERE proto = 6 AND init_win > 0)), 0)", "init_win_std": "coalesce(ln(1 + stddev_pop(init_win) FILTER (WHERE proto = 6 AND init_win > 0)), 0)", **{f"log_iat_{k}": f"coalesce(ln(1 + 1000 * avg(iat_{k})), 0)" for k in ("mean", "std", "max")},
        "retrans_rate": f"sum(retrans) / {PK}", "small_flow_frac": "avg((fwd_pkts + bwd_pkts <= 2)::INT)", "log_out_in_ratio": "ln(1 + sum(fwd_bytes)) - ln(1 + sum(bwd_bytes))", "lateral_frac": "avg((dst_ip LIKE '10.%' AND dst_port NOT IN (53, 123))::INT)",
        "sensitive_port_frac": "avg((dst_port IN (21, 22, 23, 135, 139, 445, 1433, 3306, 3389, 5900, 5985))::INT)", "udp_frac": "avg((proto = 17)::INT)", "dns_frac": "avg((dst_port = 53)::INT)", "log_payload_mean": f"coalesce(ln(1 + sum(payload_mean * (fwd_pkts + bwd_pkts)) / {PK}), 0)",
        "payload_std": f"coalesce(sqrt(greatest(sum((payload_mean * payload_mean + payload_std * payload_std) * (fwd_pkts + bwd_pkts)) / {PK} - pow(sum(payload_mean * (fwd_pkts + bwd_pkts)) / {PK}, 2), 0)), 0)",
        **{a: f"coalesce(sum({b}) / {PK}, 0)" for a, b in (("payload_small_frac", "payload_small_pkts"), ("frag_frac", "frag_pkts"), ("df_frac", "df_pkts"))}}
SEQUENCE = """g1 AS (SELECT *, ts - lag(ts) OVER (PARTITION BY capture, src_ip, dst_ip, dst_port ORDER BY ts, event_id) AS gap, abs(dst_port - lag(dst_port) OVER (PARTITION BY KEYS ORDER BY ts, event_id)) AS step FROM flows),
bea AS (SELECT KEYS, max(1 / (1 + s / m) * least(n / 6, 1)) AS beacon_score FROM (SELECT KEYS, capture AS _c, src_ip AS _s, dst_ip, dst_port, count(*) AS n, avg(gap) AS m, stddev_samp(gap) AS s FROM g1 WHERE gap > 0.5 GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL),
sca AS (SELECT KEYS, ln(1 + avg(step)) AS scan_step_mean, avg((step <= 2)::INT) AS scan_seq_frac FROM g1 WHERE step > 0 GROUP BY ALL)"""


def full_sql(keys: str) -> str:
    missing = ", ".join(f"(count({c}) = 0)::BIGINT AS {n}_missing" for n, c in (("ttl", "ttl_mean"), ("payload", "payload_mean"), ("frag", "frag_pkts"), ("iat_max", "iat_max")))
    full = f"full_ AS (SELECT {keys}, count(*) AS n_flows, {', '.join(f'round({x}, 6) + 0.0 AS {c}' for c, x in FULL.items())}, {missing}, {', '.join(f'count(*) FILTER (WHERE stage = {i}) AS cnt_{i}' for i in range(7))} FROM flows GROUP BY ALL)"
    rest = ", ".join(f"round(coalesce({c}, 0), 6) + 0.0 AS {c}" for c in ("beacon_score", "scan_step_mean", "scan_seq_frac"))
    return base(FLOWS, SEQUENCE.replace("KEYS", keys), full) + f"SELECT full_.*, {rest} FROM full_ LEFT JOIN bea USING ({keys}) LEFT JOIN sca USING ({keys})"


@query("d14_cells", full_sql("capture, src_ip, wid"))
def _(spark, d):
    return cells.full(flows(spark, d), W)


@query("d14_network_cells", full_sql("capture, wid"))
def _(spark, d):
    return cells.full(flows(spark, d), W, ["capture", "wid"])


@query("d2_network_cells", base(FLOWS) + f"SELECT capture, wid, n_flows, {r6(FEATURE_NAMES)}, ttl_missing::BIGINT AS ttl_missing, {', '.join(f'cnt_{i}' for i in range(7))} FROM (SELECT capture, wid, {FEATURES} FROM flows GROUP BY ALL)")
def _(spark, d):
    return cells.build(flows(spark, d), W, ["capture", "wid"])


for _value in ("dst_port", "dst_ip"):
    @query(f"d8_entropy_{_value}", base(FLOWS) + f"SELECT capture, src_ip, wid, count(*) AS n_distinct, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0 AS entropy FROM (SELECT capture, src_ip, wid, {_value}, count(*) AS c FROM flows GROUP BY ALL) GROUP BY ALL")
    def _(spark, d, value=_value):
        return cells.entropy(flows(spark, d), W, value)


DENSE = FLOWS.replace("'10.0.' || user_id // 250 || '.' || user_id % 250 AS src_ip, CASE WHEN k < 40 THEN '10.0.1.' || k % 20 ELSE '203.0.113.' || k END AS dst_ip", "'10.0.0.' || user_id % 5 AS src_ip, '10.0.1.' || k % 4 AS dst_ip").replace("[443,80,53,22,445,3389,8080,123,25,993,135,21][k % 12 + 1]", "[22,445,8443][k % 3 + 1]").replace("21600", "86400")


def dense(spark, d):
    """Flows whose conversations repeat."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.expr("concat('c', user_id % 3)").alias("capture"), F.expr("concat('10.0.0.', user_id % 5)").alias("src_ip"), F.expr("concat('10.0.1.', k % 4)").alias("dst_ip"), F.element_at(F.array(F.lit(22), F.lit(445), F.lit(8443)), F.col("k") % 3 + 1).alias("dst_port"))


@query("d12_beacon", base(DENSE) + """, g AS (SELECT capture, src_ip, dst_ip, dst_port, wid, ts - lag(ts) OVER (PARTITION BY capture, src_ip, dst_ip, dst_port ORDER BY ts, event_id) AS gap FROM flows),
h AS (SELECT capture, src_ip, wid, dst_ip, dst_port, count(*) AS n, avg(gap) AS m, stddev_samp(gap) AS s FROM g WHERE gap > 0.5 GROUP BY ALL HAVING count(*) >= 3)
SELECT capture, src_ip, wid, round(max(1 / (1 + s / m) * least(n / 6, 1)), 6) + 0.0 AS beacon_score FROM h GROUP BY ALL""")
def _(spark, d):
    return cells.beacon(dense(spark, d), 86400)


@query("d13_scan_shape", base(DENSE) + """, g AS (SELECT capture, src_ip, wid, abs(dst_port - lag(dst_port) OVER (PARTITION BY capture, src_ip, wid ORDER BY ts, event_id)) AS step FROM flows)
SELECT capture, src_ip, wid, round(ln(1 + avg(step)), 6) + 0.0 AS scan_step_mean, round(avg((step <= 2)::INT), 6) + 0.0 AS scan_seq_frac FROM g WHERE step > 0 GROUP BY ALL""")
def _(spark, d):
    return cells.scan_shape(dense(spark, d), 86400)


@query("e2_priority_stage", base(FLOWS, CELLS) + "SELECT capture, src_ip, wid, CASE WHEN cnt_6 > 0 THEN 6 WHEN cnt_5 > 0 THEN 5 WHEN cnt_3 > 0 THEN 3 WHEN cnt_2 > 0 THEN 2 WHEN cnt_4 > 0 THEN 4 WHEN cnt_1 > 0 THEN 1 ELSE 0 END::BIGINT AS stage FROM cells")
def _(spark, d):
    return cells.build(flows(spark, d), W).select("capture", "src_ip", "wid", cells.priority_stage().alias("stage"))


@query("e3_select_hosts", base(FLOWS, CELLS) + f""", h AS (SELECT capture, src_ip, sum(n_flows) AS n, count(*) AS active, max(({DOMINANT} > 0)::INT) AS bad FROM cells GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY capture, bad ORDER BY n DESC, src_ip) AS r FROM h WHERE bad = 1 OR active >= 5)
SELECT capture, src_ip, count(*) AS cells, sum(n_flows)::BIGINT AS flows FROM cells SEMI JOIN (SELECT * FROM k WHERE bad = 1 OR r <= 3) USING (capture, src_ip) GROUP BY ALL""")
def _(spark, d):
    return cells.select_hosts(cells.build(flows(spark, d), W), 3, 5).groupBy("capture", "src_ip").agg(F.count("*").alias("cells"), F.sum("n_flows").alias("flows"))


@query("e6_segments", base(*UP_TO_SEGS) + "SELECT capture, src_ip, run, wid, is_filled::BIGINT AS is_filled, n_flows, round(log_bytes, 6) + 0.0 AS log_bytes, stage::BIGINT AS stage FROM segs")
def _(spark, d):
    return segs(spark, d).select(*KEYS, "is_filled", "n_flows", F.col("log_bytes").cast("double").alias("log_bytes"), "stage")


@query("f1_multi_scale", base(*UP_TO_SEGS) + f""", n AS (SELECT *, row_number() OVER {SEGW}) - 1 AS pos FROM segs), u AS (SELECT *, pos // 256 AS blk, pos % 256 AS j FROM n),
v AS (SELECT *, log_bytes * CASE WHEN pos = 0 THEN 1 ELSE 0.5::DOUBLE END AS c, log_bytes * CASE WHEN pos = 0 THEN 1 ELSE 0.125::DOUBLE END AS e FROM u),
m AS (SELECT *, pow(0.5, j) * sum(c * pow(0.5, -j)) OVER (PARTITION BY capture, src_ip, run, blk ORDER BY pos) + pow(0.5, j + 1) * coalesce(sum(c * pow(0.5, 255 - j)) OVER (PARTITION BY capture, src_ip, run ORDER BY blk RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS short,
 pow(0.875, j) * sum(e * pow(0.875, -j)) OVER (PARTITION BY capture, src_ip, run, blk ORDER BY pos) + pow(0.875, j + 1) * coalesce(sum(e * pow(0.875, 255 - j)) OVER (PARTITION BY capture, src_ip, run ORDER BY blk RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS trend FROM v)
SELECT capture, src_ip, run, wid, round(log_bytes, 6) + 0.0 AS log_bytes, round(log_bytes - coalesce(lag(short) OVER {SEGW}), log_bytes), 6) + 0.0 AS burst, round(trend, 6) + 0.0 AS trend FROM m""")
def _(spark, d):
    s = segs(spark, d).select(*KEYS, F.col("log_bytes").cast("double").alias("log_bytes"))
    return cells.multi_scale(s, "log_bytes", 3, 15).select(*KEYS, "log_bytes", "burst", "trend")


@query("f4_targets", base(*UP_TO_TARGETS) + "SELECT capture, src_ip, run, wid, stage::BIGINT AS stage, exploit_now::BIGINT AS exploit_now, y_future::BIGINT AS y_future, time_to_attack, phase FROM targets")
def _(spark, d):
    return targets(spark, d).select(*KEYS, "stage", "exploit_now", "y_future", "time_to_attack", "phase")


@query("f7_temporal_split", base(*UP_TO_TARGETS) + f""", e AS (SELECT *, min(wid) OVER (PARTITION BY capture) AS lo, max(wid) OVER (PARTITION BY capture) AS hi FROM targets), c AS (SELECT *, lo + floor((hi - lo + 1) * 0.7::DOUBLE) AS a, lo + floor((hi - lo + 1) * 0.85::DOUBLE) AS b FROM e)
SELECT capture, CASE WHEN (wid < a AND wid >= a - {PURGE}) OR (wid < b AND wid >= b - {PURGE}) THEN 'purged' WHEN wid < a THEN 'train' WHEN wid < b THEN 'val' ELSE 'test' END AS split_temporal, phase, count(*) AS n FROM c GROUP BY ALL""")
def _(spark, d):
    return cells.temporal_split(targets(spark, d), 0.7, 0.15, PURGE).groupBy("capture", "split_temporal", "phase").agg(F.count("*").alias("n"))


@query("f9_family_split", base(*UP_TO_TARGETS) + "SELECT CASE capture WHEN 'c0' THEN 'train' WHEN 'c1' THEN 'val' ELSE 'unused' END AS split_family, count(*) AS n, sum(y_future)::BIGINT AS positives FROM targets GROUP BY ALL")
def _(spark, d):
    return cells.family_split(targets(spark, d), {"c0": "train", "c1": "val"}).groupBy("split_family").agg(F.count("*").alias("n"), F.sum("y_future").alias("positives"))


@query("f10_scaler", base(*UP_TO_SEGS) + "SELECT capture, src_ip, run, wid, round(greatest(-10, least(10, (log_bytes - c) / s)), 6) + 0.0 AS z FROM segs, (SELECT quantile_cont(log_bytes, 0.5) AS c, CASE WHEN quantile_cont(log_bytes, 0.75) - quantile_cont(log_bytes, 0.25) > 1e-6 THEN quantile_cont(log_bytes, 0.75) - quantile_cont(log_bytes, 0.25) WHEN stddev_pop(log_bytes) > 1e-6 THEN stddev_pop(log_bytes) ELSE 1 END AS s FROM segs)")
def _(spark, d):
    s = segs(spark, d).select(*KEYS, F.col("log_bytes").cast("double").alias("log_bytes"))
    p = cells.scaler(s, "log_bytes").first()
    return s.select(*KEYS, F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (F.col("log_bytes") - p["center"]) / p["scale"])).alias("z"))


@query("f13_stacked", base(*UP_TO_SEGS) + f"SELECT capture, src_ip, run, wid, coalesce(lag(stage, 3) OVER {SEGW}), first_value(stage) OVER {SEGW}))::BIGINT AS s0, coalesce(lag(stage, 1) OVER {SEGW}), first_value(stage) OVER {SEGW}))::BIGINT AS s2, stage::BIGINT AS s3 FROM segs")
def _(spark, d):
    return cells.stacked(segs(spark, d), "stage", 4).select(*KEYS, F.col("stack")[0].alias("s0"), F.col("stack")[2].alias("s2"), F.col("stack")[3].alias("s3"))


@query("f15_future_stage", base(*UP_TO_SEGS) + f"SELECT stage::BIGINT AS stage, stage_3::BIGINT AS stage_3, count(*) AS n FROM (SELECT stage, lead(stage, 3) OVER {SEGW}) AS stage_3 FROM segs) GROUP BY ALL")
def _(spark, d):
    return cells.future_stage(segs(spark, d), 3).groupBy("stage", "stage_3").agg(F.count("*").alias("n"))


MARKOV = f"""steps AS (SELECT stage AS i, lead(stage) OVER {SEGW}) AS j FROM segs), cnt AS (SELECT i, j, count(*) AS n FROM steps WHERE j IS NOT NULL GROUP BY ALL),
p AS (SELECT a.i, b.j, (coalesce(n, 0) + 0.5::DOUBLE) / sum(coalesce(n, 0) + 0.5::DOUBLE) OVER (PARTITION BY a.i) AS p FROM range(7) a(i) CROSS JOIN range(7) b(j) LEFT JOIN cnt ON cnt.i = a.i AND cnt.j = b.j)"""
PASSAGE = MARKOV + """, pass AS (WITH RECURSIVE s(k, i, stay) AS (SELECT 0, i, 1.0::DOUBLE FROM range(7) t(i) UNION ALL SELECT k + 1, p.i, q.x FROM (SELECT s.k, p.i, sum(p.p * s.stay) AS x FROM s JOIN p ON p.j = s.i AND p.j < 2 WHERE s.k < 10 GROUP BY ALL) q JOIN p ON p.i = q.i AND p.j = 0) SELECT i, 1 - stay AS r FROM s WHERE k = 10)"""


@query("g8_markov_fit", base(*UP_TO_SEGS, MARKOV) + "SELECT i::BIGINT AS from_stage, j::BIGINT AS to_stage, round(p, 6) AS p FROM p")
def _(spark, d):
    return risk.transitions(segs(spark, d))


@query("g9_markov_paths", base(*UP_TO_SEGS, MARKOV) + f""", b AS (SELECT capture, src_ip, run, wid, i, (c + 0.5::DOUBLE) / (cnt_0 + cnt_1 + cnt_2 + cnt_3 + cnt_4 + cnt_5 + cnt_6 + 3.5::DOUBLE) AS b FROM (SELECT *, unnest([cnt_0, cnt_1, cnt_2, cnt_3, cnt_4, cnt_5, cnt_6]) AS c, unnest(range(7)) AS i FROM segs)),
k1 AS (SELECT capture, src_ip, run, wid, p.j AS i, sum(b * p) AS b FROM b JOIN p USING (i) GROUP BY ALL), k2 AS (SELECT capture, src_ip, run, wid, p.j AS i, sum(b * p) AS b FROM k1 JOIN p USING (i) GROUP BY ALL)
SELECT k, to_stage, round(avg(prob), 6) + 0.0 AS mean_prob FROM (SELECT 1::BIGINT AS k, i AS to_stage, b AS prob FROM k1 UNION ALL SELECT 2, i, b FROM k2) GROUP BY ALL""")
def _(spark, d):
    s = segs(spark, d)
    return risk.stage_paths(s, risk.matrix(risk.transitions(s)), 2).groupBy("k", "to_stage").agg(F.avg("prob").alias("mean_prob"))


# g9_markov_paths stops at step 2 as its SQL does; all H steps here. The mean belief is carried forward in SQL, as the steps are linear.
@query("g9_markov_horizon", base(*UP_TO_SEGS, MARKOV) + f""", m AS (SELECT i, avg(b) AS b FROM (SELECT unnest(range(7)) AS i, (unnest([cnt_0, cnt_1, cnt_2, cnt_3, cnt_4, cnt_5, cnt_6]) + 0.5::DOUBLE) / (cnt_0 + cnt_1 + cnt_2 + cnt_3 + cnt_4 + cnt_5 + cnt_6 + 3.5::DOUBLE) AS b FROM segs) GROUP BY ALL),
s AS (WITH RECURSIVE s(k, i, b) AS (SELECT 0::BIGINT, i, b FROM m UNION ALL SELECT k + 1, j, x FROM (SELECT s.k, p.j, sum(s.b * p.p) AS x FROM s JOIN p ON p.i = s.i WHERE s.k < {H} GROUP BY ALL)) SELECT * FROM s WHERE k > 0)
SELECT k, i AS to_stage, round(b, 6) + 0.0 AS mean_prob FROM s""")
def _(spark, d):
    s = segs(spark, d)
    return risk.stage_paths(s, risk.matrix(risk.transitions(s)), H).groupBy("k", "to_stage").agg(F.avg("prob").alias("mean_prob"))


@query("g10_first_passage", base(*UP_TO_SEGS, PASSAGE) + """SELECT capture, src_ip, run, wid, round(sum((c + 0.5::DOUBLE) / (n + 3.5::DOUBLE) * r), 6) + 0.0 AS risk_markov
FROM (SELECT capture, src_ip, run, wid, cnt_0 + cnt_1 + cnt_2 + cnt_3 + cnt_4 + cnt_5 + cnt_6 AS n, unnest([cnt_0, cnt_1, cnt_2, cnt_3, cnt_4, cnt_5, cnt_6]) AS c, unnest(range(7)) AS i FROM segs) JOIN pass USING (i) GROUP BY ALL""")
def _(spark, d):
    s = segs(spark, d)
    return risk.with_risk(s, risk.matrix(risk.transitions(s)), H).select(*KEYS, "risk_markov")


ROLLOUT = f""", cum AS (SELECT i, list(c ORDER BY j) AS c, sum(p) FILTER (WHERE j >= 2) AS soft FROM (SELECT i, j, p, sum(p) OVER (PARTITION BY i ORDER BY j) AS c FROM p) GROUP BY i),
cell AS (SELECT capture, src_ip, run, wid, list_transform(range(7), lambda m: (list_sum([cnt_0, cnt_1, cnt_2, cnt_3, cnt_4, cnt_5, cnt_6][1:m + 1]) + 0.5::DOUBLE * (m + 1)) / (cnt_0 + cnt_1 + cnt_2 + cnt_3 + cnt_4 + cnt_5 + cnt_6 + 3.5::DOUBLE)) AS c FROM segs),
start AS (SELECT capture, src_ip, run, wid, q, least(len(list_filter(c, lambda x: x <= ('0x' || substr(md5(q * {H + 1} || '|' || capture || '|' || src_ip || '|' || wid), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)), 6) AS s FROM cell, range({PARTICLES}) t(q)),
roll AS (WITH RECURSIVE r(k, capture, src_ip, run, wid, q, s, soft, hit) AS (SELECT 0, capture, src_ip, run, wid, q, s, 0.0::DOUBLE, NULL::INT FROM start
 UNION ALL SELECT k + 1, capture, src_ip, run, wid, q, s2, greatest(soft, more), coalesce(hit, CASE WHEN s2 >= 2 THEN k + 1 END) FROM (SELECT r.*, cum.soft AS more, least(len(list_filter(cum.c, lambda x: x <= ('0x' || substr(md5((q * {H + 1} + k + 1) || '|' || capture || '|' || src_ip || '|' || wid), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)), 6) AS s2 FROM r JOIN cum ON cum.i = r.s WHERE k < {H})) SELECT * FROM r)"""


@query("g11_rollout", base(*UP_TO_SEGS, MARKOV) + ROLLOUT + f"SELECT capture, src_ip, run, wid, round(avg(soft), 6) + 0.0 AS risk_rollout, round(avg((hit IS NOT NULL)::INT), 6) + 0.0 AS hit_share, round(coalesce(quantile_cont(hit, 0.5), -1), 6) + 0.0 AS eta FROM roll WHERE k = {H} GROUP BY ALL")
def _(spark, d):
    s = segs(spark, d)
    return risk.rollout(s, risk.matrix(risk.transitions(s)), PARTICLES, H)


METHODS = "SELECT 'a' AS method, y_future AS y, risk AS score FROM scored UNION ALL SELECT 'b', y_future, round(risk * risk, 2) FROM scored"


def methods(spark, d):
    s = scored(spark, d)
    return s.select(F.explode(F.array(F.struct(F.lit("a").alias("method"), F.col("risk").alias("score")), F.struct(F.lit("b").alias("method"), F.round(F.col("risk") * F.col("risk"), 2).alias("score")))).alias("m"), F.col("y_future").alias("y")).select("m.*", "y")


THRESHOLD = """, q AS (SELECT method, sum(y) AS pos, sum(1 - y) AS neg, unnest(list_distinct(quantile_cont(score, list_transform(range(501), lambda i: i / 500.0::DOUBLE)))) AS t FROM m GROUP BY method),
h AS (SELECT q.method, t, pos, neg, sum(y) AS tp, sum(1 - y) AS fp FROM q JOIN m ON m.method = q.method AND m.score >= q.t GROUP BY ALL),
f AS (SELECT *, round(CASE WHEN tp + fp + pos > 0 THEN 2 * tp / (tp + fp + pos) ELSE 0 END, 9) AS f1, CASE WHEN neg > 0 THEN fp / neg ELSE 0 END AS fpr FROM h),
best AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY fpr <= 0.05 DESC, CASE WHEN fpr <= 0.05 THEN f1 ELSE -fpr END DESC, t) AS r FROM f)"""


@query("h1_threshold", base(*UP_TO_SCORES, f"m AS ({METHODS})") + THRESHOLD + "SELECT method, round(t, 6) + 0.0 AS threshold, round(f1, 6) + 0.0 AS f1, round(fpr, 6) + 0.0 AS fpr FROM best WHERE r = 1")
def _(spark, d):
    return metrics.thresholds(methods(spark, d), 0.05, ["method"])


@query("i1_confusion", base(*UP_TO_SCORES, f"m AS ({METHODS})") + """, c AS (SELECT method, count(*) FILTER (WHERE score >= 0.3 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.3 AND y = 0) AS fp, count(*) FILTER (WHERE score < 0.3 AND y = 1) AS fn, count(*) FILTER (WHERE score < 0.3 AND y = 0) AS tn FROM m GROUP BY ALL)
SELECT *, round(tp / greatest(tp + fp, 1), 6) + 0.0 AS precision, round(tp / greatest(tp + fn, 1), 6) + 0.0 AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) + 0.0 AS f1, round(fp / greatest(fp + tn, 1), 6) + 0.0 AS fpr FROM c""")
def _(spark, d):
    return metrics.confusion(methods(spark, d), 0.3, ["method"])


@query("i2_ranking", base(*UP_TO_SCORES, f"m AS ({METHODS})") + """, g AS (SELECT method, score, sum(y) AS p, sum(1 - y) AS n FROM m GROUP BY ALL), w AS (SELECT *, sum(p) OVER (PARTITION BY method ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY method ORDER BY score DESC) AS fp FROM g)
SELECT method, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS ap, round(sum(n * (tp - p + p / 2)) / (sum(p) * sum(n)), 6) AS auc FROM w GROUP BY ALL""")
def _(spark, d):
    return metrics.ranking(methods(spark, d), ["method"])


@query("i5_phase_rates", base(*UP_TO_SCORES) + "SELECT phase, count(*) AS cells, round(avg((risk >= 0.4)::INT), 6) + 0.0 AS alert_rate FROM scored GROUP BY ALL")
def _(spark, d):
    return metrics.phase_rates(scored(spark, d), 0.4)


@query("i6_lead_times", base(*UP_TO_SCORES) + f""", n AS (SELECT *, row_number() OVER {SEGW}) - 1 AS pos FROM scored), q AS (SELECT *, coalesce(max(exploit_now) OVER {SEGW} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS past, coalesce(max(CASE WHEN risk < 0.2 THEN pos END) OVER {SEGW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS off FROM n)
SELECT capture, src_ip, run, wid, least(10, pos - off - 1) AS lead FROM q WHERE exploit_now = 1 AND pos > 0 AND past = 0""")
def _(spark, d):
    return metrics.lead_times(scored(spark, d), 0.2, H).select(*KEYS, "lead")


@query("i8_macro_f1", base(*UP_TO_SEGS) + f""", q AS (SELECT lead(stage, 1) OVER {SEGW}) AS truth, stage AS pred FROM segs), c AS (SELECT truth, pred, count(*) AS n FROM q WHERE truth IS NOT NULL GROUP BY ALL),
k AS (SELECT k, (SELECT coalesce(sum(n), 0) FROM c WHERE truth = k AND pred = k) AS tp, (SELECT coalesce(sum(n), 0) FROM c WHERE truth = k) + (SELECT coalesce(sum(n), 0) FROM c WHERE pred = k) AS n2 FROM range(7) t(k))
SELECT 1::BIGINT AS horizon, round(avg(2 * tp / n2), 6) AS macro_f1, (SELECT round(sum(n) FILTER (WHERE truth = pred) / sum(n), 6) FROM c) AS accuracy, (SELECT sum(n)::BIGINT FROM c) AS n FROM k WHERE n2 > 0""")
def _(spark, d):
    s = cells.future_stage(segs(spark, d), 1).where("stage_1 IS NOT NULL").select(F.lit(1).alias("horizon"), F.col("stage_1").alias("truth"), F.col("stage").alias("pred"))
    return metrics.macro_f1(s, ["horizon"])


@query("j8_coverage", base(FLOWS, CELLS) + "SELECT capture, round(avg(1 - ttl_missing), 6) + 0.0 AS carried, round(avg(CASE WHEN ttl_missing = 0 THEN ttl_mean END), 6) AS mean_carried FROM cells GROUP BY ALL")
def _(spark, d):
    return cells.build(flows(spark, d), W).groupBy("capture").agg(F.avg(1 - F.col("ttl_missing")).alias("carried"), F.avg(F.when(F.col("ttl_missing") == 0, F.col("ttl_mean"))).alias("mean_carried"))


@query("j9_profile", base(*UP_TO_TARGETS) + "SELECT capture, phase, count(*) AS cells, round(avg(y_future), 6) + 0.0 AS positive_rate, count(DISTINCT src_ip) AS hosts FROM targets GROUP BY GROUPING SETS ((capture, phase), (phase), ())")
def _(spark, d):
    t = targets(spark, d)
    return t.groupingSets([[F.col("capture"), F.col("phase")], [F.col("phase")], []], F.col("capture"), F.col("phase")).agg(F.count("*").alias("cells"), F.avg("y_future").alias("positive_rate"), F.count_distinct("src_ip").alias("hosts"))


@query("k1_alerts", base(*UP_TO_SCORES) + f""", n AS (SELECT *, row_number() OVER {SEGW}) AS pos FROM scored), o AS (SELECT *, pos - row_number() OVER {SEGW}) AS island FROM n WHERE risk >= 0.3),
g AS (SELECT capture, src_ip, run, island, min(wid) AS a, max(wid) AS b, count(*) AS cells, max(risk) AS peak, arg_min(stage, wid) AS first_stage FROM o GROUP BY ALL HAVING count(*) >= 2)
SELECT capture, src_ip, run, a * 21600 AS start, (b + 1) * 21600 AS "end", cells, round(peak, 6) AS peak, first_stage::BIGINT AS first_stage, CASE WHEN peak >= 0.9 THEN 'CRITICAL' WHEN peak >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM g""")
def _(spark, d):
    return risk.alerts(scored(spark, d), 0.3, 2, W)


@query("k4_triage", base(*UP_TO_SCORES) + """, s AS (SELECT capture, src_ip, run, max((stage > 0)::INT) AS infected, max(risk) AS max_risk, avg(abs(risk - 0.25)) AS mean_surprise FROM scored GROUP BY ALL), m AS (SELECT *, quantile_cont(mean_surprise, 0.5) OVER (PARTITION BY capture) AS mid FROM s),
z AS (SELECT *, (mean_surprise - mid) / (1.4826::DOUBLE * quantile_cont(abs(mean_surprise - mid), 0.5) OVER (PARTITION BY capture) + 1e-6) AS z FROM m)
SELECT capture, src_ip, run, infected::BIGINT AS infected, round(max_risk, 6) + 0.0 AS max_risk, round(mean_surprise, 6) + 0.0 AS mean_surprise, round(z, 4) + 0.0 AS z, (max_risk >= 0.6)::BIGINT AS by_risk, (z >= 3)::BIGINT AS by_anomaly FROM z""")
def _(spark, d):
    out = risk.triage(scored(spark, d).withColumn("surprise", F.abs(F.col("risk") - 0.25)), 0.6, 3.0)
    return out.withColumn("z", F.round("z", 4))


@query("k3_stage_lookup", base(*UP_TO_SEGS) + f"SELECT {STAGES}[stage + 1] AS stage_name, count(*) AS cells FROM segs GROUP BY ALL")
def _(spark, d):
    return segs(spark, d).groupBy(F.element_at(F.array(*map(F.lit, STAGES)), F.col("stage") + 1).alias("stage_name")).agg(F.count("*").alias("cells"))
