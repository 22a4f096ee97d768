"""Queries of training rows, forecasters, reports and sessions, and their SQL; added to those of registry.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import bundle, cells, models, reports, risk, sequences
from packetloom.operators.registry import DENSE, FLOWS, GAP, H, KEYS, METHODS, PURGE, SEGW, UP_TO_SCORES, UP_TO_SEGS, UP_TO_TARGETS, W, base, dense, flows, methods, query, scored, segs, targets
from packetloom.sources import files, normalize, shared
from packetloom.streaming import cells as live

TRIAGE = """, s AS (SELECT capture, src_ip, run, max((stage > 0)::INT) AS infected, max(risk) AS max_risk, avg(abs(risk - 0.25)) AS mean_surprise FROM scored GROUP BY ALL), m AS (SELECT *, quantile_cont(mean_surprise, 0.5) OVER (PARTITION BY capture) AS mid FROM s),
z AS (SELECT *, max_risk >= 0.45 AS r, (mean_surprise - mid) / (1.4826::DOUBLE * quantile_cont(abs(mean_surprise - mid), 0.5) OVER (PARTITION BY capture) + 1e-6) >= 1 AS o FROM m)"""
SPLIT = f""", e AS (SELECT *, min(wid) OVER (PARTITION BY capture) AS lo, max(wid) OVER (PARTITION BY capture) AS hi FROM targets), c AS (SELECT *, lo + floor((hi - lo + 1) * 0.7::DOUBLE) AS a, lo + floor((hi - lo + 1) * 0.85::DOUBLE) AS b FROM e),
split AS (SELECT * EXCLUDE (a, b), CASE WHEN (wid < a AND wid >= a - {PURGE}) OR (wid < b AND wid >= b - {PURGE}) THEN 'purged' WHEN wid < a THEN 'train' WHEN wid < b THEN 'val' ELSE 'test' END AS split_temporal FROM c)"""
PAIRS = f"""f AS (SELECT *, max(stage) OVER (PARTITION BY capture, src_ip, run) AS worst, coalesce(lag(stage) OVER {SEGW}), stage) AS earlier, lead(stage, 1) OVER {SEGW}) AS t1, lead(stage, 3) OVER {SEGW}) AS t3 FROM segs),
g AS (SELECT 1 AS k, stage, earlier, t1 AS truth FROM f WHERE worst > 0 AND t1 IS NOT NULL UNION ALL SELECT 3, stage, earlier, t3 FROM f WHERE worst > 0 AND t3 IS NOT NULL),
pairs AS (SELECT k, 'persistence' AS method, stage, truth, stage AS pred FROM g UNION ALL SELECT k, 'earlier', stage, truth, earlier FROM g),
q AS (SELECT k, method, truth, pred, count(*) AS n FROM pairs GROUP BY ALL), sides AS (SELECT k, method, truth AS c, n, CASE WHEN truth = pred THEN n ELSE 0 END AS hit FROM q UNION ALL SELECT k, method, pred, n, 0 FROM q),
per AS (SELECT k, method, c, 2 * sum(hit) / sum(n) AS f1 FROM sides GROUP BY ALL), mf AS (SELECT k, method, avg(f1) AS macro_f1 FROM per GROUP BY ALL),
horizon AS (SELECT p.k, p.method, any_value(macro_f1) AS macro_f1, avg((truth = pred)::INT) AS accuracy, count(*) AS n, avg(CASE WHEN truth <> stage THEN (truth = pred)::INT END) AS transition_acc, count(*) FILTER (WHERE truth <> stage) AS n_transitions FROM pairs p JOIN mf ON mf.k = p.k AND mf.method = p.method GROUP BY ALL)"""


def split(spark, d):
    return cells.temporal_split(targets(spark, d), 0.7, 0.15, PURGE)


def horizon_pairs(spark, d):
    s = reports.malicious_segments(segs(spark, d).select(*KEYS, "stage").withColumn("earlier", F.coalesce(F.lag("stage").over(cells.in_segment()), F.col("stage"))))
    for k in (1, 3):
        s = cells.future_stage(s, k)
    truths = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"stage_{k}").alias("truth")) for k in (1, 3)]))
    s = s.select("stage", "earlier", truths.alias("t")).select("stage", "earlier", "t.*").where("truth IS NOT NULL")
    return s.select("k", "stage", "truth", F.explode(F.create_map(F.lit("persistence"), F.col("stage"), F.lit("earlier"), F.col("earlier"))).alias("method", "pred"))


@query("a11_cic_layout", base(FLOWS) + """SELECT strftime(make_timestamp((ts * 1000000)::BIGINT), '%d/%m/%Y %H:%M:%S') AS t, proto::VARCHAR AS proto, count(*) AS n, sum(round(duration * 1000000)::BIGINT)::BIGINT AS duration_us FROM flows GROUP BY ALL""")
def _(spark, d):
    out = normalize.to_cic(flows(spark, d))
    return out.groupBy(F.col("Timestamp").alias("t"), F.col("Protocol").alias("proto")).agg(F.count("*").alias("n"), F.sum(F.col("Flow Duration").cast("long")).alias("duration_us"))


@query("a2_from_cic", base(FLOWS) + "SELECT floor(ts)::BIGINT AS second, src_ip, dst_port::BIGINT AS dst_port, fwd_pkts::BIGINT AS fwd_pkts, stage_own::BIGINT AS stage, round(duration, 6) + 0.0 AS duration FROM (SELECT *, raw_stage AS stage_own FROM flows) WHERE event_id % 97 <> 0")
def _(spark, d):
    f = flows(spark, d)
    raw = normalize.to_cic(f.where("event_id % 97 <> 0")).unionByName(normalize.to_cic(f.where("event_id % 97 = 0")).withColumn("Timestamp", F.lit("not-a-date")))
    out = normalize.flows(raw)
    return out.select(F.floor("ts").alias("second"), "src_ip", *[F.col(c).cast("long").alias(c) for c in ("dst_port", "fwd_pkts", "stage")], "duration")


@query("a10_split_rows", base(*UP_TO_TARGETS) + SPLIT + " SELECT capture, src_ip, run, wid, y_future::BIGINT AS y_future FROM split WHERE split_temporal = 'val'")
def _(spark, d):
    return files.of_split(split(spark, d), "val").select(*KEYS, "y_future")


@query("f8_episode_split", base(*UP_TO_SEGS) + """, g AS (SELECT capture, src_ip, run, min(wid) AS first, count(*) AS cells FROM segs GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY first, src_ip, run) - 1 AS i, count(*) OVER (PARTITION BY capture) AS n FROM g)
SELECT capture, src_ip, run, cells, CASE WHEN i < greatest(round_even(n * 0.7::DOUBLE, 0), 1) THEN 'train' WHEN i < greatest(least(round_even(n * 0.85::DOUBLE, 0), n - 1), 1) THEN 'val' ELSE 'test' END AS split_temporal FROM i""")
def _(spark, d):
    return sequences.episode_split(segs(spark, d), 0.7, 0.15).groupBy("capture", "src_ip", "run", "split_temporal").agg(F.count("*").alias("cells"))


@query("f12_context", base(*UP_TO_SEGS) + f", a AS (SELECT capture, src_ip, run, wid, list(stage) OVER {SEGW} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS a FROM segs) SELECT capture, src_ip, run, wid, array_to_string(list_concat(list_transform(range(6 - len(a)), lambda x: a[1]), a), ',') AS context FROM a")
def _(spark, d):
    return sequences.context(segs(spark, d).select(*KEYS, "stage"), "stage", 6).select(*KEYS, F.array_join(F.col("context").cast("array<string>"), ",").alias("context"))


@query("f14_training_sequences", base(*UP_TO_TARGETS) + f""", a AS (SELECT *, row_number() OVER {SEGW}) - 1 AS pos, count(*) OVER (PARTITION BY capture, src_ip, run) AS n, max((stage > 0 OR y_future > 0)::INT) OVER (PARTITION BY capture, src_ip, run) AS bad, list(stage) OVER {SEGW} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS a FROM targets),
b AS (SELECT *, range(greatest(3 - pos, 0)) AS l, range(greatest(pos + 3 - n, 0)) AS r FROM a WHERE bad = 1 OR pos % 4 = 0)
SELECT capture, src_ip, run, wid, array_to_string(list_concat(list_concat(list_transform(l, lambda x: a[1]), a), list_transform(r, lambda x: a[-1])), ',') AS sequence, array_to_string(list_concat(list_concat(list_transform(l, lambda x: 0), list_transform(a, lambda x: 1)), list_transform(r, lambda x: 0)), ',') AS mask FROM b""")
def _(spark, d):
    s = sequences.training_sequences(targets(spark, d).select(*KEYS, "stage", "y_future"), "stage", 4, 2, 4)
    return s.select(*KEYS, *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("sequence", "mask")])


@query("f16_balanced_sample", base(*UP_TO_TARGETS) + """, t AS (SELECT *, row_number() OVER (PARTITION BY y_future ORDER BY md5(capture || '|' || src_ip || '|' || wid), capture, src_ip, wid) AS r, count(*) FILTER (WHERE y_future = 1) OVER () AS p, count(*) OVER () AS n FROM targets)
SELECT capture, src_ip, run, wid, y_future::BIGINT AS y_future FROM t WHERE n <= 1000 OR (y_future = 1 AND (p <= 500 OR r <= 500)) OR (y_future = 0 AND r <= greatest(1000 - p, 500))""")
def _(spark, d):
    return sequences.balanced_sample(targets(spark, d).select(*KEYS, "y_future"), "y_future", 1000, ["capture", "src_ip", "wid"])


@query("f17_class_weights", base(*UP_TO_SEGS) + ", c AS (SELECT i, 1 + (SELECT count(*) FROM segs WHERE stage = i) AS n FROM range(7) t(i)), w AS (SELECT i, sqrt(sum(n) OVER () / n) AS w FROM c) SELECT i::BIGINT AS stage, round(w / avg(w) OVER (), 6) + 0.0 AS weight FROM w")
def _(spark, d):
    return sequences.class_weights(segs(spark, d))


@query("f18_surge", base(*UP_TO_SEGS) + """, b AS (SELECT *, max(stage) OVER (PARTITION BY capture, src_ip, run) AS worst, ('0x' || substr(md5('surge|' || capture || '|' || src_ip || '|' || run), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM segs)
SELECT capture, src_ip, run, wid, round(log_bytes + CASE WHEN worst = 0 THEN ln(2 + 18 * u) ELSE 0 END, 6) + 0.0 AS log_bytes FROM b""")
def _(spark, d):
    return sequences.surge(segs(spark, d).select(*KEYS, "stage", F.col("log_bytes").cast("double").alias("log_bytes")), ["log_bytes"], 2.0, 20.0).select(*KEYS, "log_bytes")


@query("g1_persistence", base(*UP_TO_TARGETS) + "SELECT (stage > 0)::INT::DOUBLE AS score, (stage > 1)::INT::DOUBLE AS exploit_score, y_future::BIGINT AS y_future, count(*) AS n FROM targets GROUP BY ALL")
def _(spark, d):
    s = targets(spark, d).withColumn("score", models.persistence(F.col("stage"))).withColumn("exploit_score", models.persistence(F.col("stage"), True))
    return s.groupBy("score", "exploit_score", "y_future").agg(F.count("*").alias("n"))


#: Kind, stacked cells and options beside the operator's defaults.
FORECASTERS = {"g2_logistic": ("logistic", 1, {"C": 0.5}), "g3_logistic_stacked": ("logistic", 8, {"C": 0.1}), "g4_boosted_stacked": ("boosted", 8, {}), "g5_forest_stacked": ("forest", 8, {})}
def training_rows(spark, d, horizons=()):
    """All features of a cell with burst and trend, scaled: 117 inputs, none of them made from labels; and the stage of each horizon."""
    return bundle.training_table(flows(spark, d), bundle.SETTINGS | {"seconds": W, "gap": GAP, "horizon": H, "purge": PURGE}, horizons)[0]


for _name, (_kind, _steps, _options) in FORECASTERS.items():
    @query(_name)
    def _(spark, d, kind=_kind, steps=_steps, options=_options):
        s = training_rows(spark, d)
        if kind == "boosted":  # the features' values alone
            s = s.withColumn("x", F.filter("x", lambda v, i: i % 3 == 0))
        s = shared.kept(sequences.context(sequences.waves(s), "x", steps).select(*KEYS, "split_temporal", "y_future", F.flatten("context").alias("x")), "stacked") if steps > 1 else s
        model = models.fit(files.of_split(s, "train"), "x", "y_future", kind, **options)
        return models.score(model, files.of_split(s, "test"), "x").select(*KEYS, "y_future", "score")


@query("g15_fusion", base(*UP_TO_SCORES) + "SELECT capture, src_ip, run, wid, round((0.5::DOUBLE * risk + 0.35::DOUBLE * y_future + 0.15::DOUBLE * exploit_now) / 1.0::DOUBLE, 6) + 0.0 AS fused, ((0.5::DOUBLE * risk + 0.35::DOUBLE * y_future + 0.15::DOUBLE * exploit_now) >= 0.3)::BIGINT AS alert FROM scored")
def _(spark, d):
    s = scored(spark, d).withColumn("fused", models.fused({"risk": 0.5, "y_future": 0.35, "exploit_now": 0.15}))
    return s.select(*KEYS, "fused", (F.col("fused") >= 0.3).alias("alert"))


@query("g17_surprise", base(*UP_TO_SEGS) + f""", p AS (SELECT *, row_number() OVER {SEGW}) AS pos FROM segs) SELECT a.capture, a.src_ip, a.run, a.wid, round(pow(a.log_bytes - coalesce(b.log_bytes, a.log_bytes), 2), 6) + 0.0 AS surprise
FROM p a LEFT JOIN p b ON b.capture = a.capture AND b.src_ip = a.src_ip AND b.run = a.run AND b.pos = a.pos - 1""")
def _(spark, d):
    s = segs(spark, d).select(*KEYS, F.col("log_bytes").cast("double").alias("log_bytes"))
    s = s.withColumn("short", F.coalesce(F.lag("log_bytes").over(cells.in_segment()), F.col("log_bytes")))
    return s.select(*KEYS, models.surprise("log_bytes", "short").alias("surprise"))


@query("i4_curves", base(*UP_TO_SCORES, f"m AS ({METHODS})") + """, g AS (SELECT method, score, sum(y) AS p, sum(1 - y) AS n FROM m GROUP BY ALL),
w AS (SELECT method, score, sum(p) OVER u AS tp, sum(n) OVER u AS fp, row_number() OVER u - 1 AS i, count(*) OVER v AS k, sum(p) OVER v AS pos, sum(n) OVER v AS neg FROM g WINDOW u AS (PARTITION BY method ORDER BY score DESC), v AS (PARTITION BY method))
SELECT method, i, round(score, 6) AS score, round(CASE WHEN pos > 0 THEN tp / pos ELSE 0 END, 6) + 0.0 AS tpr, round(CASE WHEN neg > 0 THEN fp / neg ELSE 0 END, 6) + 0.0 AS fpr, round(tp / (tp + fp), 6) + 0.0 AS precision
FROM w WHERE list_contains(list_transform(range(least(k, 120)), lambda x: x * (k - 1) // greatest(least(k, 120) - 1, 1)), i)""")
def _(spark, d):
    return reports.curves(methods(spark, d), ["method"])


@query("i9_stage_horizon", base(*UP_TO_SEGS, PAIRS) + "SELECT k::BIGINT AS k, method, round(macro_f1, 6) + 0.0 AS macro_f1, round(accuracy, 6) + 0.0 AS accuracy, n, round(transition_acc, 6) + 0.0 AS transition_acc, n_transitions FROM horizon")
def _(spark, d):
    return reports.stage_horizon(horizon_pairs(spark, d))


@query("i14_wide_horizons", base(*UP_TO_SEGS, PAIRS) + "SELECT method, round(max(accuracy) FILTER (WHERE k = 1), 6) + 0.0 AS h1, round(max(accuracy) FILTER (WHERE k = 3), 6) + 0.0 AS h3 FROM horizon GROUP BY ALL")
def _(spark, d):
    return reports.wide(reports.stage_horizon(horizon_pairs(spark, d)), "accuracy", [1, 3])


@query("i10_triage_totals", base(*UP_TO_SCORES) + TRIAGE + """SELECT count(*) AS slots, count(*) FILTER (WHERE infected = 1) AS infected, count(*) FILTER (WHERE infected = 1 AND (r OR o)) AS caught, count(*) FILTER (WHERE infected = 1 AND r) AS caught_by_risk, count(*) FILTER (WHERE infected = 1 AND o AND NOT r) AS caught_only_by_anomaly,
 count(*) FILTER (WHERE infected = 0 AND (r OR o)) AS false_alarms, count(*) FILTER (WHERE infected = 0 AND r) AS risk_only_false_alarms, round(avg((r OR o)::INT) FILTER (WHERE infected = 0), 6) + 0.0 AS false_alarm_rate FROM z""")
def _(spark, d):
    return reports.triage_totals(risk.triage(scored(spark, d).withColumn("surprise", F.abs(F.col("risk") - 0.25)), 0.45, 1.0))


@query("i12_over_seeds", base(*UP_TO_SCORES, f"m AS ({METHODS})") + """, s AS (SELECT method, t, count(*) FILTER (WHERE score >= t AND y = 1) / count(*) FILTER (WHERE y = 1) AS recall FROM m, (VALUES (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE)) v(t) GROUP BY ALL)
SELECT method, round(avg(recall), 6) + 0.0 AS recall_mean, round(stddev_pop(recall), 6) + 0.0 AS recall_std FROM s GROUP BY ALL""")
def _(spark, d):
    runs = methods(spark, d).withColumn("t", F.explode(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.4))))
    runs = runs.groupBy("method", "t").agg((F.count_if((F.col("score") >= F.col("t")) & (F.col("y") == 1)) / F.count_if(F.col("y") == 1)).alias("recall"))
    return reports.over_seeds(runs, ["recall"])


@query("j1_schedule", base(*UP_TO_SEGS) + f""", t AS (SELECT *, make_timestamp(wid * {W} * 1000000) AS t, min(wid) OVER (PARTITION BY capture) AS lo, max(wid) OVER (PARTITION BY capture) AS hi FROM segs), u AS (SELECT *, (hour(t) + minute(t) / 60) * 2 * pi() / 24 AS turn FROM t)
SELECT capture, src_ip, run, wid, round(sin(turn), 6) + 0.0 AS hour_sin, round(cos(turn), 6) + 0.0 AS hour_cos, isodow(t) - 1 AS weekday, round((wid - lo) * {W} / greatest((hi - lo) * {W}, 1), 6) + 0.0 AS elapsed FROM u""")
def _(spark, d):
    return reports.schedule(segs(spark, d).select(*KEYS), W)


@query("j5_split_overlaps", base(*UP_TO_TARGETS) + SPLIT + """, r AS (SELECT capture, split_temporal AS s, list_position(['train', 'val', 'test'], split_temporal) AS i, min(wid) AS lo, max(wid) AS hi FROM split WHERE split_temporal <> 'purged' GROUP BY ALL)
SELECT a.capture, a.s AS a, b.s AS b, (a.hi >= b.lo)::BIGINT AS overlap FROM r a JOIN r b ON a.capture = b.capture AND a.i < b.i""")
def _(spark, d):
    return reports.split_overlaps(split(spark, d), "split_temporal")


@query("k8_focus_segment", base(*UP_TO_TARGETS) + "SELECT capture, src_ip, run, count(*) FILTER (WHERE phase = 'pre_attack') AS pre_attack, count(*) FILTER (WHERE stage > 0) AS malicious FROM targets GROUP BY ALL ORDER BY pre_attack DESC, malicious DESC, capture, src_ip, run LIMIT 1")
def _(spark, d):
    return reports.focus_segment(targets(spark, d))


@query("k9_first_warning", base(*UP_TO_SCORES) + f", n AS (SELECT *, row_number() OVER {SEGW}) - 1 AS pos FROM scored) SELECT capture, src_ip, run, min(pos) FILTER (WHERE risk >= 0.44) AS first_warning, count(*) AS cells FROM n GROUP BY ALL")
def _(spark, d):
    return reports.first_warnings(scored(spark, d), 0.44)


@query("l6_sessions", base(DENSE) + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > 21600 THEN 1 ELSE 0 END AS cut FROM flows WINDOW w AS (PARTITION BY capture, src_ip, dst_ip ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY capture, src_ip, dst_ip ORDER BY ts) AS s FROM g)
SELECT capture, src_ip, dst_ip, round(min(ts) * 1000000)::BIGINT AS start_us, round(max(ts) * 1000000)::BIGINT AS last_us, count(*) AS n FROM s GROUP BY capture, src_ip, dst_ip, s""")
def _(spark, d):
    return live.sessions(dense(spark, d), 21600)


@query("l1_window_cells", base(FLOWS) + "SELECT capture, src_ip, wid, count(*) AS n_flows, round(ln(1 + sum(fwd_bytes + bwd_bytes)), 6) + 0.0 AS log_bytes, round(ln(1 + sum(fwd_pkts + bwd_pkts)), 6) + 0.0 AS log_pkts, count(*) FILTER (WHERE stage = 6) AS cnt_6 FROM flows GROUP BY ALL")
def _(spark, d):
    return live.cells(flows(spark, d), W).select("capture", "src_ip", "wid", "n_flows", "log_bytes", "log_pkts", "cnt_6")
