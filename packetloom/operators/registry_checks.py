"""Queries of calibration, evaluation and integrity checks, and their SQL; added to those of registry.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.stages import TACTICS, status, tactic
from packetloom.operators import bundle, calibrate, cells, evaluate, integrity, metrics, models, reports, risk
from packetloom.operators.registry import DRAW, GAP, H, KEYS, MARKOV, METHODS, PURGE, ROLLOUT, SEGW, THRESHOLD, UP_TO_SCORES, UP_TO_SEGS, UP_TO_TARGETS, W, FLOWS, base, flows, query, r6, scored, segs, targets
from packetloom.operators.registry_reports import SPLIT, TRIAGE, split, training_rows
from packetloom.sources import files, normalize, shared

PARTS = ["direct", "rollout", "markov"]
PARTED = f"parted AS (SELECT *, y_future AS y, floor(risk * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS direct, floor((0.3::DOUBLE * y_future + 0.7::DOUBLE * {DRAW.format(r='1')}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS rollout, floor({DRAW.format(r='2')} * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS markov FROM scored)"
AP = lambda by, src: f"""(SELECT {by}, sum(p * tp / (tp + fp)) / sum(p) AS ap, sum(n * (tp - p + p / 2)) / (sum(p) * sum(n)) AS auc FROM (SELECT *, sum(p) OVER (PARTITION BY {by} ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY {by} ORDER BY score DESC) AS fp
 FROM (SELECT {by}, score, sum(y) AS p, sum(1 - y) AS n FROM {src} GROUP BY ALL)) GROUP BY {by})"""  # noqa: E731


def parted(spark, d):
    s = scored(spark, d).withColumn("y", F.col("y_future"))
    u = lambda r: risk.draw(F.lit(r), "capture", "src_ip", "wid")
    return s.withColumns({"direct": calibrate.to_digits(F.col("risk"), 2), "rollout": calibrate.to_digits(0.3 * F.col("y") + 0.7 * u(1), 2), "markov": calibrate.to_digits(u(2), 2)})


@query("h2_fusion_weights", base(*UP_TO_SCORES, PARTED) + f""", grid AS (SELECT i, j, i / 10.0::DOUBLE AS w0, j / 10.0::DOUBLE AS w1, (10 - i - j) / 10.0::DOUBLE AS w2 FROM range(11) a(i), range(11) b(j) WHERE i + j <= 10),
m AS (SELECT i * 100 + j AS g, w0, w1, w2, y, round(w0 * direct + w1 * rollout + w2 * markov, 6) AS score FROM parted, grid WHERE exploit_now = 0)
SELECT round(i / 10.0::DOUBLE, 6) + 0.0 AS w0, round(j / 10.0::DOUBLE, 6) + 0.0 AS w1, round(w2, 6) + 0.0 AS w2, round(ap, 6) AS ap FROM {AP('g', 'm')} a JOIN grid ON a.g = i * 100 + j ORDER BY round(ap, 9) DESC, g LIMIT 1""")
def _(spark, d):
    return calibrate.fusion(parted(spark, d), PARTS)


ENSEMBLE = f""", e AS (SELECT partner, i / 10.0::DOUBLE AS weight, y, exploit_now, round(direct * (i / 10.0::DOUBLE) + p * (1 - i / 10.0::DOUBLE), 6) AS score FROM (SELECT *, unnest(['rollout', 'markov']) AS partner, unnest([rollout, markov]) AS p FROM parted), range(11) t(i)),
sel AS (SELECT a.partner, a.weight, a.ap AS ap_all, b.ap AS ap_early, (a.ap + b.ap) / 2 AS selection FROM {AP('partner, weight', 'e')} a JOIN {AP('partner, weight', '(SELECT * FROM e WHERE exploit_now = 0)')} b ON a.partner = b.partner AND a.weight = b.weight)"""


@query("h4_selection_score", base(*UP_TO_SCORES, PARTED) + ENSEMBLE + "SELECT partner, round(weight, 6) + 0.0 AS weight, round(ap_all, 6) AS ap_all, round(ap_early, 6) AS ap_early, round(selection, 6) AS selection FROM sel")
def _(spark, d):
    return calibrate.selection(calibrate.mixtures(parted(spark, d), "direct", ["rollout", "markov"]), ["partner", "weight"])


@query("h3_ensemble", base(*UP_TO_SCORES, PARTED) + ENSEMBLE + ", one AS (SELECT * FROM sel ORDER BY round(selection, 9) DESC, partner, weight DESC LIMIT 1), m AS (SELECT 'x' AS method, y, score FROM e JOIN one USING (partner, weight))" + THRESHOLD
       + "SELECT partner, round(weight, 6) + 0.0 AS weight, round(selection, 6) AS selection, round(t, 6) + 0.0 AS threshold, round(f1, 6) + 0.0 AS f1, round(fpr, 6) + 0.0 AS fpr FROM best, one WHERE r = 1")
def _(spark, d):
    return calibrate.ensemble(parted(spark, d), "direct", ["rollout", "markov"])


@query("h5_best_run", base(*UP_TO_SCORES, PARTED) + ENSEMBLE + "SELECT round(weight, 6) + 0.0 AS run, round(selection, 6) AS selection FROM sel WHERE partner = 'markov' ORDER BY selection DESC, run LIMIT 1")
def _(spark, d):
    runs = calibrate.mixtures(parted(spark, d), "direct", ["markov"]).withColumnRenamed("weight", "run")
    return calibrate.best_run(calibrate.selection(runs, ["run"]))


EVALUATED = f""", t AS (SELECT 'risk' AS method, capture, src_ip, run, wid, phase, exploit_now, y_future AS y, risk AS score, 0.3::DOUBLE AS threshold FROM scored UNION ALL SELECT 'inverse', capture, src_ip, run, wid, phase, exploit_now, y_future, round(1 - risk, 4), 0.6::DOUBLE FROM scored),
c AS (SELECT method, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE score < threshold AND y = 1) AS fn, count(*) FILTER (WHERE score < threshold AND y = 0) AS tn,
 avg((score >= threshold)::INT) FILTER (WHERE phase = 'benign') AS rate_benign, avg((score >= threshold)::INT) FILTER (WHERE phase = 'pre_attack') AS rate_pre_attack, avg((score >= threshold)::INT) FILTER (WHERE phase = 'during_attack') AS rate_during FROM t GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY method, capture, src_ip, run ORDER BY wid) - 1 AS pos FROM t), k AS (SELECT *, coalesce(max(exploit_now) OVER (PARTITION BY method, capture, src_ip, run ORDER BY wid ROWS BETWEEN {H} PRECEDING AND 1 PRECEDING), 0) AS past, coalesce(max(CASE WHEN score < threshold THEN pos END) OVER (PARTITION BY method, capture, src_ip, run ORDER BY wid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS off FROM n),
l AS (SELECT method, count(*) AS incidents, avg(lead) AS lead_mean, quantile_cont(lead, 0.5) AS lead_median, avg((lead > 0)::INT) AS warned FROM (SELECT method, least({H}, pos - off - 1) AS lead FROM k WHERE exploit_now = 1 AND pos > 0 AND past = 0) GROUP BY ALL),
a AS {AP('method', 't')}, b AS {AP('method', "(SELECT * FROM t WHERE exploit_now = 0)")},
ev AS (SELECT c.method, tp, fp, fn, tn, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fn) AS recall, fp / (fp + tn) AS fpr, a.ap, a.auc, b.ap AS ap_early, b.auc AS auc_early, rate_benign, rate_pre_attack, rate_during, incidents, lead_mean, lead_median, warned FROM c JOIN a ON a.method = c.method JOIN b ON b.method = c.method JOIN l ON l.method = c.method)"""
EV_NUMBERS = ["f1", "recall", "fpr", "ap", "auc", "ap_early", "auc_early", "rate_benign", "rate_pre_attack", "rate_during", "lead_mean", "lead_median", "warned"]


def evaluated(spark, d):
    s = scored(spark, d)
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), x.alias("score"), F.lit(t).alias("threshold")) for m, x, t in (("risk", F.col("risk"), 0.3), ("inverse", F.round(1 - F.col("risk"), 4), 0.6))])).alias("m")
    return evaluate.methods(s.select(*KEYS, "phase", "exploit_now", F.col("y_future").alias("y"), long).select(*KEYS, "phase", "exploit_now", "y", "m.*"), H)


@query("i7_evaluate_methods", base(*UP_TO_SCORES) + EVALUATED + f"SELECT method, tp, fp, fn, tn, {r6(EV_NUMBERS)}, incidents FROM ev")
def _(spark, d):
    return evaluated(spark, d)


@query("i13_summary", base(*UP_TO_SCORES) + EVALUATED + f"SELECT method, {r6(['f1', 'ap', 'fpr', 'ap_early', 'lead_mean', 'warned'])} FROM ev")
def _(spark, d):
    return evaluate.summary(evaluated(spark, d))


@query("i11_bootstrap", base(*UP_TO_SCORES) + f""", held AS (SELECT capture, src_ip, run, floor(risk * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS score, risk >= 0.3 AS "on", sum(y_future) AS p, sum(1 - y_future) AS n FROM scored GROUP BY ALL),
u AS (SELECT *, row_number() OVER (ORDER BY capture, src_ip, run) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT capture, src_ip, run FROM scored)),
w AS (SELECT b, i, count(*) AS w FROM (SELECT b, floor(('0x' || substr(md5(b || '|' || j), 1, 8))::UBIGINT / 4294967296.0::DOUBLE * k) AS i FROM range(200) t(b), (SELECT i AS j, k FROM u)) GROUP BY ALL),
e AS (SELECT b, score, "on", sum(p * w) AS p, sum(n * w) AS n FROM held JOIN u USING (capture, src_ip, run) JOIN w USING (i) GROUP BY ALL),
f AS (SELECT b, coalesce(sum(p) FILTER (WHERE "on"), 0) AS tp, coalesce(sum(n) FILTER (WHERE "on"), 0) AS fp, coalesce(sum(p) FILTER (WHERE NOT "on"), 0) AS fn, coalesce(sum(n) FILTER (WHERE NOT "on"), 0) AS tn FROM e GROUP BY b),
x AS (SELECT b, sum(p * tp / greatest(tp + fp, 1)) / sum(p) AS ap FROM (SELECT *, sum(p) OVER (PARTITION BY b ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY b ORDER BY score DESC) AS fp FROM (SELECT b, score, sum(p) AS p, sum(n) AS n FROM e GROUP BY ALL)) GROUP BY b),
y AS (SELECT b, unnest(['f1', 'recall', 'fpr', 'ap']) AS metric, unnest([CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, ap]) AS v FROM f JOIN x USING (b))
SELECT metric, round(quantile_cont(v, 0.025), 6) + 0.0 AS low, round(quantile_cont(v, 0.975), 6) + 0.0 AS high FROM y GROUP BY metric""")
def _(spark, d):
    return calibrate.bootstrap(scored(spark, d).withColumnRenamed("risk", "score").withColumn("y", F.col("y_future")), 0.3, cells.SEGMENT)


@query("i18_channel_aucs", base(*UP_TO_SCORES) + f""", z AS (SELECT *, abs(risk - 0.25) AS odd FROM scored), s AS (SELECT capture, src_ip, run, max((stage > 0)::INT) AS bad, max(risk) AS risk, avg(odd) AS odd FROM z GROUP BY ALL),
m AS (SELECT 'cell' AS level, 'risk' AS channel, y_future AS y, risk AS score FROM z UNION ALL SELECT 'cell', 'surprise', y_future, odd FROM z UNION ALL SELECT 'host', 'risk', bad, risk FROM s UNION ALL SELECT 'host', 'surprise', bad, odd FROM s)
SELECT level, channel, round(auc, 6) AS auc FROM {AP('level, channel', '(SELECT * REPLACE (round(score, 9) AS score) FROM m)')}""")
def _(spark, d):
    return evaluate.channel_aucs(scored(spark, d).withColumn("surprise", F.abs(F.col("risk") - 0.25)))


@query("g14_forecast_stage", base(*UP_TO_SEGS, MARKOV) + f""", b AS (SELECT capture, src_ip, run, wid, i, (c + 0.5::DOUBLE) / (n + 3.5::DOUBLE) AS b FROM (SELECT capture, src_ip, run, wid, cnt_0 + cnt_1 + cnt_2 + cnt_3 + cnt_4 + cnt_5 + cnt_6 AS n, unnest([cnt_0, cnt_1, cnt_2, cnt_3, cnt_4, cnt_5, cnt_6]) AS c, unnest(range(7)) AS i FROM segs)),
s AS (WITH RECURSIVE s(k, i, j, x) AS (SELECT 1, i, j, p FROM p UNION ALL SELECT k + 1, i, j, x FROM (SELECT s.k, s.i, p.j, sum(s.x * p.p) AS x FROM s JOIN p ON p.i = s.j WHERE s.k < {H} GROUP BY ALL)) SELECT i, j, sum(x) AS x FROM s GROUP BY ALL),
f AS (SELECT capture, src_ip, run, wid, j, round(sum(b * x), 9) AS v FROM b JOIN s USING (i) WHERE j >= 2 GROUP BY ALL) SELECT capture, src_ip, run, wid, arg_min(j, (-v, j))::BIGINT AS forecast_stage FROM f GROUP BY ALL""")
def _(spark, d):
    s = segs(spark, d)
    return risk.forecast_stage(s, risk.matrix(risk.transitions(s)), H)


@query("g11_stage_paths", base(*UP_TO_SEGS, MARKOV) + ROLLOUT + "SELECT k::BIGINT AS k, s::BIGINT AS stage, count(*) AS particles FROM roll WHERE k > 0 GROUP BY ALL")
def _(spark, d):
    s = segs(spark, d)
    return risk.rollout_paths(s, risk.matrix(risk.transitions(s)), 32, H).groupBy("k", "stage").agg(F.count("*").alias("particles"))


@query("g12_fan", base(*UP_TO_SEGS, MARKOV) + ROLLOUT + ", v AS (SELECT k, capture, src_ip, run, wid, cum.soft AS v FROM roll JOIN cum ON cum.i = s WHERE k < 10) SELECT capture, src_ip, run, wid, (k + 1)::BIGINT AS k, round(quantile_cont(v, 0.1), 6) + 0.0 AS low, round(quantile_cont(v, 0.5), 6) + 0.0 AS mid, round(quantile_cont(v, 0.9), 6) + 0.0 AS high FROM v GROUP BY ALL")
def _(spark, d):
    s = segs(spark, d)
    return risk.fan(s, risk.matrix(risk.transitions(s)), 32, H)


@query("g16_alert_flag", base(*UP_TO_SCORES) + "SELECT (risk >= 0.44)::BIGINT AS alert, phase, count(*) AS n FROM scored GROUP BY ALL")
def _(spark, d):
    return scored(spark, d).groupBy(risk.alert(F.col("risk"), 0.44).alias("alert"), "phase").agg(F.count("*").alias("n"))


@query("g20_ensemble", base(*UP_TO_SCORES, PARTED) + f"SELECT capture, src_ip, run, wid, round(0.6::DOUBLE * direct + 0.4::DOUBLE * markov, 6) + 0.0 AS score FROM parted")
def _(spark, d):
    p = parted(spark, d)
    return models.ensemble(p.select(*KEYS, F.col("direct").alias("score")), p.select(*KEYS, F.col("markov").alias("score")), 0.6)


@query("g19_robust_z", base(*UP_TO_SCORES) + f""", m AS (SELECT *, quantile_cont(risk, 0.5) OVER (PARTITION BY capture) AS mid FROM scored), z AS (SELECT *, (risk - mid) / (1.4826::DOUBLE * quantile_cont(abs(risk - mid), 0.5) OVER (PARTITION BY capture) + 1e-6) AS z FROM m),
t AS (SELECT 1 AS one, y_future AS y, round(z, 6) AS score FROM z), sign AS (SELECT CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS s FROM {AP('one', 't')})
SELECT capture, src_ip, run, wid, round(s * z, 4) + 0.0 AS z, (s * z >= 1)::BIGINT AS odd FROM z, sign""")
def _(spark, d):
    z = risk.robust_z(scored(spark, d), "risk", ["capture"])
    out = risk.signed(z, F.col("y_future"), 1.0)
    return out.select(*KEYS, F.round("z", 4).alias("z"), "odd")


@query("e4_merged_cells", base(*UP_TO_SEGS) + ", x AS (SELECT capture, src_ip, wid, n_flows, CASE WHEN wid % 2 = 0 THEN log_bytes END AS log_bytes, 2 AS tie FROM cells UNION ALL SELECT capture, src_ip, wid, n_flows + 1, log_bytes, 1 FROM cells WHERE wid % 3 = 0) SELECT capture, src_ip, wid, arg_min(n_flows, tie) AS n_flows, round(arg_min(log_bytes, tie) FILTER (WHERE log_bytes IS NOT NULL), 6) + 0.0 AS log_bytes FROM x GROUP BY ALL")
def _(spark, d):
    c = cells.build(flows(spark, d), W).select("capture", "src_ip", "wid", "n_flows", "log_bytes")
    a = c.withColumn("log_bytes", F.when(F.col("wid") % 2 == 0, F.col("log_bytes"))).withColumn("tie", F.lit(2))
    return cells.merged(a.unionByName(c.where("wid % 3 = 0").withColumn("n_flows", F.col("n_flows") + 1).withColumn("tie", F.lit(1))), "tie")


@query("e7_segment_numbers", base(*UP_TO_SEGS) + "SELECT capture, src_ip, run, wid, dense_rank() OVER (ORDER BY capture, src_ip, run) - 1 AS segment FROM segs")
def _(spark, d):
    return cells.numbered(segs(spark, d).select(*KEYS))


@query("f11_scaled", base(*UP_TO_SEGS) + """, q AS (SELECT quantile_cont(log_bytes, [0.25, 0.5, 0.75]) AS a, quantile_cont(syn_ratio, [0.25, 0.5, 0.75]) AS b, stddev_pop(log_bytes) AS sa, stddev_pop(syn_ratio) AS sb FROM segs),
p AS (SELECT a[2] AS ca, CASE WHEN a[3] - a[1] > 1e-6 THEN a[3] - a[1] WHEN sa > 1e-6 THEN sa ELSE 1 END AS xa, b[2] AS cb, CASE WHEN b[3] - b[1] > 1e-6 THEN b[3] - b[1] WHEN sb > 1e-6 THEN sb ELSE 1 END AS xb FROM q)
SELECT capture, src_ip, run, wid, round(greatest(-10, least(10, (log_bytes - ca) / xa)), 6) + 0.0 AS log_bytes, round(greatest(-10, least(10, (syn_ratio - cb) / xb)), 6) + 0.0 AS syn_ratio FROM segs, p""")
def _(spark, d):
    s = segs(spark, d).select(*KEYS, *[F.col(c).cast("double").alias(c) for c in ("log_bytes", "syn_ratio")])
    return cells.scaled(s, ["log_bytes", "syn_ratio"], cells.scaler_table(s, ["log_bytes", "syn_ratio"]))


@query("j3_identity_probe", base(*UP_TO_TARGETS) + SPLIT + f""", r AS (SELECT capture, (sum(y_future) + 1) / (count(*) + 2) AS rate FROM split WHERE split_temporal = 'train' GROUP BY ALL), t AS (SELECT 1 AS one, y_future AS y, round(coalesce(rate, 0.5::DOUBLE), 9) AS score FROM split LEFT JOIN r USING (capture) WHERE split_temporal = 'test')
SELECT round(ap, 6) AS ap, (SELECT round(avg(y), 6) FROM t) AS prevalence FROM {AP('one', 't')}""")
def _(spark, d):
    s = split(spark, d)
    return integrity.identity_probe(s.where("split_temporal = 'train'"), s.where("split_temporal = 'test'"))


@query("j4_permutation", base(*UP_TO_SCORES) + f""", q AS (SELECT rep, risk AS score, y_future, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5(rep || '|' || capture || '|' || src_ip || '|' || wid), 1, 8))::UBIGINT, capture, src_ip, wid) AS r, sum(y_future) OVER (PARTITION BY rep) AS p FROM scored, range(200) t(rep)),
z AS (SELECT rep, score, (r <= p)::INT AS y FROM q), o AS (SELECT ap FROM {AP('one', '(SELECT 1 AS one, y_future AS y, risk AS score FROM scored)')})
SELECT round(any_value(o.ap), 6) AS observed, round(avg(n.ap), 6) AS null_mean, round((count(*) FILTER (WHERE round(n.ap, 9) >= round(o.ap, 9)) + 1) / (count(*) + 1), 6) AS p_value FROM {AP('rep', 'z')} n, o""")
def _(spark, d):
    return calibrate.permutation(scored(spark, d).select("capture", "src_ip", "wid", F.col("y_future").alias("y"), F.col("risk").alias("score")), ["capture", "src_ip", "wid"])


@query("j6_causality", base(*UP_TO_SEGS) + "SELECT count(*) FILTER (WHERE wid <= (SELECT (min(wid) + max(wid)) // 2 FROM segs)) AS kept, 0::BIGINT AS changed_before, 1::BIGINT AS reacts FROM segs")
def _(spark, d):
    s = segs(spark, d).select(*KEYS, F.col("log_bytes").cast("double").alias("log_bytes"))
    lo, hi = s.agg(F.min("wid"), F.max("wid")).first()
    cut = (lo + hi) // 2
    return integrity.causality(s, "log_bytes", lambda x: cells.multi_scale(x, "log_bytes", 3, 15), ["burst", "trend"], cut)


@query("j7_out_of_distribution", base(*UP_TO_SEGS) + f""", b AS (SELECT *, max(stage) OVER (PARTITION BY capture, src_ip, run) AS worst FROM segs), v AS (SELECT 'original' AS variant, log_bytes AS x, syn_ratio AS s FROM b WHERE worst = 0 UNION ALL SELECT 'flash_crowd', log_bytes + ln(5.0::DOUBLE), syn_ratio FROM b WHERE worst = 0 UNION ALL SELECT 'shifted', log_bytes, syn_ratio + 1.5::DOUBLE FROM b WHERE worst = 0),
r AS (SELECT variant, avg((1 / (1 + exp(-(x - 10 + s))) >= 0.5)::INT) AS rate FROM v GROUP BY ALL) SELECT variant, round(rate, 6) + 0.0 AS rate, (rate <= greatest(3 * (SELECT rate FROM r WHERE variant = 'original'), 0.05))::BIGINT AS fine FROM r""")
def _(spark, d):
    s = segs(spark, d).select(*KEYS, "stage", *[F.col(c).cast("double").alias(c) for c in ("log_bytes", "syn_ratio")])
    return integrity.out_of_distribution(s, lambda x: 1 / (1 + F.exp(-(F.col("log_bytes") - 10 + F.col("syn_ratio")))), 0.5, ["log_bytes"], {"syn_ratio": 1.5})


@query("k5_forecast_truth", base(*UP_TO_SEGS, MARKOV) + f""", a AS (SELECT i, j, p FROM p), best AS (SELECT i, arg_min(j, (-round(p, 9), j)) AS f FROM a GROUP BY i), t AS (SELECT stage, lead(stage, 1) OVER {SEGW}) AS truth FROM segs)
SELECT stage::BIGINT AS stage, truth::BIGINT AS truth, f::BIGINT AS forecast, count(*) AS n FROM t JOIN best ON best.i = stage WHERE truth IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    s = segs(spark, d)
    out = risk.forecast_and_truth(s.select(*KEYS, "stage"), risk.matrix(risk.transitions(s)), 1)
    return out.groupBy("stage", "truth", "forecast").agg(F.count("*").alias("n"))


@query("k6_heat_strip", base(*UP_TO_SEGS, MARKOV) + f""", m AS (SELECT capture, src_ip, run, wid, i, (c + 0.5::DOUBLE) / (n + 3.5::DOUBLE) AS b FROM (SELECT capture, src_ip, run, wid, cnt_0 + cnt_1 + cnt_2 + cnt_3 + cnt_4 + cnt_5 + cnt_6 AS n, unnest([cnt_0, cnt_1, cnt_2, cnt_3, cnt_4, cnt_5, cnt_6]) AS c, unnest(range(7)) AS i FROM segs)),
s AS (WITH RECURSIVE s(k, i, j, x) AS (SELECT 1, i, j, p FROM p UNION ALL SELECT k + 1, i, j, x FROM (SELECT s.k, s.i, p.j, sum(s.x * p.p) AS x FROM s JOIN p ON p.i = s.j WHERE s.k < 3 GROUP BY ALL)) SELECT * FROM s),
f AS (SELECT capture, src_ip, run, wid, k, j, sum(b * x) AS v FROM m JOIN s USING (i) WHERE j >= 2 GROUP BY ALL) SELECT capture, src_ip, run, wid, j::BIGINT AS to_stage, round(max(v), 6) + 0.0 AS heat FROM f GROUP BY ALL""")
def _(spark, d):
    s = segs(spark, d)
    return risk.heat(risk.stage_paths(s, risk.matrix(risk.transitions(s)), 3))


@query("k7_alert_hosts", base(*UP_TO_SCORES) + f""", g AS (SELECT *, dense_rank() OVER (ORDER BY capture, src_ip, run) - 1 AS segment, row_number() OVER {SEGW}) AS pos FROM scored), o AS (SELECT *, pos - row_number() OVER {SEGW}) AS island FROM g WHERE risk >= 0.3)
SELECT segment, min(wid) * 21600 AS start, capture, src_ip, count(*) AS cells FROM o GROUP BY segment, capture, src_ip, island HAVING count(*) >= 2""")
def _(spark, d):
    s = scored(spark, d)
    ids = cells.numbered(s.select(*cells.SEGMENT).distinct())
    return reports.with_hosts(risk.alerts(s, 0.3, 2, W).join(ids.hint("merge"), cells.SEGMENT).select("segment", "start", "cells"), ids)


@query("j2_schedule_probe")
def _(spark, d):
    s = shared.kept(split(spark, d).select(*KEYS, "split_temporal", "y_future"), "split")  # the forest reads it again and again
    known = cells.temporal_split(scored(spark, d), 0.7, 0.15, PURGE).where("split_temporal = 'test'").select(F.lit("risk").alias("method"), F.col("y_future").alias("y"), F.col("risk").alias("score"))
    model = metrics.ranking(known, ["method"]).first()
    return integrity.schedule_probe(s.where("split_temporal = 'train'"), s.where("split_temporal = 'test'"), W, model["ap"] if model and model["ap"] is not None else 0.0)


@query("g6_stage_horizons")
def _(spark, d):
    s = training_rows(spark, d, (1, 2, 3, 5, 7, 10))
    out = models.stage_horizons(s.where("split_temporal = 'train'"), s.where("split_temporal = 'test'"), "x", [1, 2, 3, 5, 7, 10])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"stage_{k}").alias("truth"), F.col(f"pred_{k}").alias("pred")) for k in (1, 2, 3, 5, 7, 10)])).alias("p")
    return metrics.macro_f1(out.select(pairs).select("p.*").where("truth IS NOT NULL"), ["k"])


@query("g21_top_features", base(*UP_TO_SEGS) + """, m AS (SELECT avg(log_bytes) AS a, avg(syn_ratio) AS b, avg(n_flows) AS c FROM segs), x AS (SELECT capture, src_ip, run, wid, unnest(['bytes', 'syn', 'flows']) AS feature, unnest([(log_bytes - a) * 0.5::DOUBLE + (syn_ratio - b) * 0.25::DOUBLE, (syn_ratio - b) * 2, (n_flows - c) * -0.1::DOUBLE]) AS v FROM segs, m)
SELECT capture, src_ip, run, wid, feature, round(v, 6) + 0.0 AS attribution, rank FROM (SELECT *, row_number() OVER (PARTITION BY capture, src_ip, run, wid ORDER BY abs(round(v, 9)) DESC, feature) AS rank FROM x) WHERE rank <= 2""")
def _(spark, d):
    s = segs(spark, d).select(*KEYS, *[F.col(a).cast("double").alias(b) for a, b in (("log_bytes", "bytes__now"), ("syn_ratio", "bytes__trend"), ("syn_ratio", "syn__now"), ("n_flows", "flows__now"))])
    names = [c for c in s.columns if "__" in c]
    coefficients = spark.createDataFrame(list(zip(names, (0.5, 0.25, 2.0, -0.1), strict=True)), "column string, coef double")
    return models.top_features(models.attributions(s, names, coefficients, s), KEYS, 2)


@query("i17_evaluation_subset", base(*UP_TO_SEGS) + """, s AS (SELECT capture, src_ip, run, max(stage) AS worst FROM segs GROUP BY ALL), k AS (SELECT * FROM s WHERE worst > 0 UNION ALL (SELECT * FROM s WHERE worst = 0 ORDER BY md5(capture || '|' || src_ip || '|' || run), capture, src_ip, run LIMIT 5))
SELECT capture, count(*) AS cells FROM segs SEMI JOIN k USING (capture, src_ip, run) GROUP BY ALL""")
def _(spark, d):
    return evaluate.subset(segs(spark, d), 5).groupBy("capture").agg(F.count("*").alias("cells"))


def dirty(raw, of_header):
    """raw (with event_id) with bad times, infinite bytes, hexadecimal ports, a lost window and repeated headers."""
    for c, every, bad in (("ts", 97, "not-a-date"), ("fwd_bytes", 89, "Infinity"), ("init_win", 83, "-1"), ("dst_port", 79, "0x0050")):
        if of_header.get(c):
            raw = raw.withColumn(of_header[c], F.when(F.col("event_id") % every == 0, bad).otherwise(F.col(of_header[c])))
    names = [c for c in raw.columns if c != "event_id"]
    return raw.select(*[F.when(F.col("event_id") % 101 == 0, F.lit(c)).otherwise(F.col(c)).alias(c) for c in names])


def with_id(make, df):
    """make(df) with event_id beside it: the layouts keep the order of columns and rows."""
    return make(df.withColumn("label", F.concat_ws("#", "label", F.col("event_id").cast("string"))))


SHOWN = ["src_ip", "dst_ip", "dst_port", "proto", "fwd_pkts", "bwd_pkts", "syn", "psh", "stage"]


@query("b13_normalise_cic", base(FLOWS) + """SELECT floor(ts)::BIGINT AS second, src_ip, dst_ip, CASE WHEN event_id % 79 = 0 THEN 0 ELSE dst_port END::BIGINT AS dst_port, proto::BIGINT AS proto, round(round(duration * 1000000) / 1000000, 6) + 0.0 AS duration, fwd_pkts::DOUBLE AS fwd_pkts, bwd_pkts::DOUBLE AS bwd_pkts,
 round(CASE WHEN event_id % 89 = 0 THEN 0 ELSE fwd_bytes END, 6) + 0.0 AS fwd_bytes, syn::DOUBLE AS syn, psh::DOUBLE AS psh, round(CASE WHEN event_id % 83 = 0 THEN 0 ELSE init_win END, 6) + 0.0 AS init_win, round(iat_max, 6) AS iat_max, ttl_mean, payload_mean, raw_stage::BIGINT AS stage FROM flows WHERE event_id % 97 <> 0 AND event_id % 101 <> 0""")
def _(spark, d):
    raw = with_id(normalize.to_cic, flows(spark, d)).withColumn("event_id", F.split_part("Label", F.lit("#"), F.lit(2)).cast("long")).withColumn("Label", F.split_part("Label", F.lit("#"), F.lit(1)))
    out = normalize.flows(dirty(raw, {"ts": "Timestamp", "fwd_bytes": "TotLen Fwd Pkts", "init_win": "Init Fwd Win Byts", "dst_port": "Dst Port"}))
    return out.select(F.floor("ts").alias("second"), *SHOWN, "duration", "fwd_bytes", "init_win", "iat_max", "ttl_mean", "payload_mean")


@query("b13_normalise_binetflow", base(FLOWS) + """SELECT floor(ts)::BIGINT AS second, src_ip, dst_ip, CASE WHEN event_id % 79 = 0 THEN 0 ELSE dst_port END::BIGINT AS dst_port, proto::BIGINT AS proto, round(duration, 6) + 0.0 AS duration, (fwd_pkts + bwd_pkts)::DOUBLE AS fwd_pkts, 0.0::DOUBLE AS bwd_pkts, round(fwd_bytes, 6) + 0.0 AS fwd_bytes, round(bwd_bytes, 6) + 0.0 AS bwd_bytes,
 CASE WHEN proto = 17 THEN 0 ELSE (syn > 0)::INT END::DOUBLE AS syn, CASE WHEN proto = 17 THEN 0 ELSE (psh > 0)::INT END::DOUBLE AS psh, CASE WHEN raw_stage = 0 THEN 0 WHEN raw_stage = 1 THEN 1 ELSE 4 END::BIGINT AS stage FROM flows WHERE event_id % 97 <> 0 AND event_id % 101 <> 0""")
def _(spark, d):
    raw = with_id(normalize.to_binetflow, flows(spark, d)).withColumn("event_id", F.split_part("Label", F.lit("#"), F.lit(2)).cast("long")).withColumn("Label", F.split_part("Label", F.lit("#"), F.lit(1)))
    raw = raw.withColumn("Label", F.when(F.col("Label").endswith("V42-Benign"), "flow=Background-Established-cmpgw-CVUT").otherwise(F.col("Label")))
    out = normalize.flows(dirty(raw, {"ts": "StartTime", "dst_port": "Dport"}))
    return out.select(F.floor("ts").alias("second"), *SHOWN, "duration", "fwd_bytes", "bwd_bytes")


@query("k2_status", base(*UP_TO_SCORES) + "SELECT CASE WHEN risk < 0.3 THEN 'NORMAL' WHEN risk >= 0.9 THEN 'CRITICAL' WHEN risk >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS status, count(*) AS n FROM scored GROUP BY ALL")
def _(spark, d):
    return scored(spark, d).groupBy(status(F.col("risk"), 0.3).alias("status")).agg(F.count("*").alias("n"))


_TACTICS = ", ".join(f"({i}, '{a}', '{b}', '{', '.join(c)}')" for i, (a, b, c) in enumerate(TACTICS))


@query("k3_tactics", base(*UP_TO_SEGS) + f"SELECT tactic, id, techniques, count(*) AS cells FROM segs JOIN (VALUES {_TACTICS}) v(i, tactic, id, techniques) ON i = stage GROUP BY ALL")
def _(spark, d):
    return segs(spark, d).select(tactic(F.col("stage")).alias("t")).groupBy("t.tactic", "t.id", "t.techniques").agg(F.count("*").alias("cells"))


@query("a5_union_captures", base(*UP_TO_SEGS) + "SELECT capture, count(*) AS cells, count(DISTINCT (src_ip, run)) AS segments FROM segs GROUP BY ALL")
def _(spark, d):
    s = segs(spark, d).select(*KEYS)
    every = files.union_captures({c: s.where(F.col("capture") == c).drop("capture") for c in ("c0", "c1", "c2")})
    return every.groupBy("capture").agg(F.count("*").alias("cells"), F.count_distinct("src_ip", "run").alias("segments"))


@query("f13_stacked_8", base(*UP_TO_SEGS) + f", f AS (SELECT *, first_value(n_flows) OVER {SEGW}) AS first FROM segs) SELECT capture, src_ip, run, wid, " + ", ".join(f"coalesce(lag(n_flows, {i}) OVER {SEGW}), first)::BIGINT AS s{7 - i}" for i in range(7, 0, -1)) + ", n_flows::BIGINT AS s7 FROM f")
def _(spark, d):
    return cells.stacked(segs(spark, d), "n_flows", 8).select(*KEYS, *[F.col("stack")[i].cast("long").alias(f"s{i}") for i in range(8)])


@query("g13_belief", base(*UP_TO_SEGS) + "SELECT capture, src_ip, run, wid, " + ", ".join(f"round((cnt_{i} + 0.5::DOUBLE) / (cnt_0 + cnt_1 + cnt_2 + cnt_3 + cnt_4 + cnt_5 + cnt_6 + 3.5::DOUBLE), 6) + 0.0 AS b{i}" for i in range(7)) + " FROM segs")
def _(spark, d):
    return segs(spark, d).select(*KEYS, *[b.alias(f"b{i}") for i, b in enumerate(risk.belief())])


def ema_sql(x: str, span: int, name: str) -> str:
    a = 2 / (span + 1)
    b, part = 1 - a, "PARTITION BY capture, src_ip, run"
    c = f"({x} * CASE WHEN pos = 0 THEN 1 ELSE {a}::DOUBLE END)"
    return f"pow({b}::DOUBLE, pos % 256) * sum({c} * pow({b}::DOUBLE, -(pos % 256))) OVER ({part}, pos // 256 ORDER BY pos) + pow({b}::DOUBLE, pos % 256 + 1) * coalesce(sum({c} * pow({b}::DOUBLE, 255 - pos % 256)) OVER ({part} ORDER BY pos // 256 RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS {name}"


@query("g18_belief_shift", base(*UP_TO_SEGS) + f", n AS (SELECT *, row_number() OVER {SEGW}) - 1 AS pos, log_bytes / 10.0::DOUBLE AS x FROM segs), e AS (SELECT capture, src_ip, run, wid, {ema_sql('x', 3, 'ms')}, {ema_sql('x', 15, 'ml')}, {ema_sql('(x * x)', 3, 'qs')}, {ema_sql('(x * x)', 15, 'ql')} FROM n), v AS (SELECT *, greatest(qs - ms * ms, 0.01::DOUBLE) AS vs, greatest(ql - ml * ml, 0.01::DOUBLE) AS vl FROM e)"
       + "SELECT capture, src_ip, run, wid, round(ln(sqrt(vl) / sqrt(vs)) + (vs + pow(ms - ml, 2)) / (2 * vl) - 0.5::DOUBLE, 5) + 0.0 AS shift FROM v")
def _(spark, d):
    s = segs(spark, d).select(*KEYS, (F.col("log_bytes").cast("double") / 10).alias("x"))
    return risk.belief_shift(s, ["x"], 3, 15).select(*KEYS, F.round("shift", 5).alias("shift"))


@query("i15_compared", base(*UP_TO_SCORES) + EVALUATED + f"SELECT method, {r6(['f1', 'ap', 'fpr', 'ap_early', 'lead_mean', 'warned'])}, 'first' AS dataset, 'One' AS label, 1::BIGINT AS flagged FROM ev UNION ALL SELECT method, {r6(['f1', 'ap', 'fpr', 'ap_early', 'lead_mean', 'warned'])}, 'second', NULL, 0 FROM ev WHERE method = 'risk'")
def _(spark, d):
    e = evaluate.summary(evaluated(spark, d))
    names = spark.createDataFrame([("first", "One")], "dataset string, label string")
    checks = spark.createDataFrame([("first", True), ("first", False), ("second", True)], "dataset string, fine boolean")
    return evaluate.compared({"first": e, "second": e.where("method = 'risk'")}, names, checks)


@query("i16_ablation", base(*UP_TO_SCORES, PARTED) + f", m AS (SELECT combo, y, round(s, 6) AS score FROM (SELECT y, unnest(['direct', 'direct+markov', 'direct+rollout+markov']) AS combo, unnest([direct, (direct + markov) / 2, (direct + rollout + markov) / 3]) AS s FROM parted)) SELECT combo, round(ap, 6) AS ap, round(auc, 6) AS auc FROM {AP('combo', 'm')}")
def _(spark, d):
    return evaluate.ablation(parted(spark, d), {"direct": ["direct"], "direct+markov": ["direct", "markov"], "direct+rollout+markov": PARTS})


GRID = [(n, k) for n in (1, 8, 32) for k in (2, 5, 10)]


@query("i16_rollout_grid", base(*UP_TO_SEGS, MARKOV) + ROLLOUT + ", each AS (" + " UNION ALL ".join(f"SELECT capture, src_ip, run, wid, {n}::BIGINT AS particles, {k}::BIGINT AS steps, avg(soft) AS risk_rollout, avg((hit IS NOT NULL)::INT) AS hit_share, coalesce(quantile_cont(hit, 0.5), -1) AS eta FROM roll WHERE k = {k} AND q < {n} GROUP BY ALL" for n, k in GRID)
       + ") SELECT capture, particles, steps, count(*) AS cells, round(avg(risk_rollout), 6) + 0.0 AS risk_rollout, round(avg(hit_share), 6) + 0.0 AS hit_share, round(avg(eta), 6) + 0.0 AS eta, round(max(eta), 6) + 0.0 AS eta_max FROM each GROUP BY ALL")
def _(spark, d):
    """Particles and horizons of an ablation, all from one run of the largest."""
    s = segs(spark, d)
    out = risk.rollout_grid(s, risk.matrix(risk.transitions(s)), [1, 8, 32], [2, 5, 10], H + 1)
    return out.groupBy("capture", "particles", "steps").agg(F.count("*").alias("cells"), F.avg("risk_rollout").alias("risk_rollout"), F.avg("hit_share").alias("hit_share"), F.avg("eta").alias("eta"), F.max("eta").alias("eta_max"))


@query("k1_alert_table", base(*UP_TO_SCORES) + f""", o AS (SELECT *, CASE WHEN stage >= 2 THEN stage ELSE 2 END AS fs, wid % 7 - 1 AS eta, row_number() OVER {SEGW}) AS pos FROM scored), i AS (SELECT *, pos - row_number() OVER {SEGW}) AS island FROM o WHERE risk >= 0.3),
r AS (SELECT capture, src_ip, run, min(wid) AS a, max(wid) AS b, count(*) AS n, max(risk) AS peak, arg_min(fs, wid) AS fs, arg_min(eta, wid) AS eta, arg_min(stage, wid) AS st, arg_min(phase, wid) AS phase FROM i GROUP BY capture, src_ip, run, island HAVING count(*) >= 2)
SELECT printf('A%04d', row_number() OVER (ORDER BY capture, src_ip, run, a)) AS alert_id, capture, src_ip, run, a * {W} AS start, (b + 1) * {W} AS "end", round(n * {W} / 60.0, 6) + 0.0 AS duration_min, round(peak, 6) + 0.0 AS peak_risk, CASE WHEN peak >= 0.9 THEN 'CRITICAL' WHEN peak >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, fs::BIGINT AS forecast_stage,
 v.tactic || ' (' || v.id || ')' AS tactic, v.techniques AS techniques, CASE WHEN eta > 0 THEN round(eta * {W} / 60.0, 6) + 0.0 END AS eta_min, st::BIGINT AS observed_stage_at_start, r.phase AS true_phase_at_start FROM r JOIN (VALUES {_TACTICS}) v(i, tactic, id, techniques) ON v.i = r.fs""")
def _(spark, d):
    s = scored(spark, d).withColumn("forecast_stage", F.when(F.col("stage") >= 2, F.col("stage")).otherwise(2)).withColumn("eta", F.col("wid") % 7 - 1).withColumn("stage_now", F.col("stage"))
    return risk.alert_table(s, 0.3, 2, W)


@query("k4_triage_ranking", base(*UP_TO_SCORES) + TRIAGE + """, q AS (SELECT capture, src_ip, run, r, o, max_risk, CASE WHEN r AND o THEN 'risk + anomaly' WHEN r THEN 'risk' WHEN o THEN 'anomaly' ELSE '-' END AS channel FROM z)
SELECT capture, src_ip, run, channel, round(max_risk, 6) + 0.0 AS max_risk FROM q ORDER BY r DESC, max_risk DESC, capture, src_ip, run LIMIT 10""")
def _(spark, d):
    """The ten segments that analysts see first; no two have the same risk."""
    t = risk.triage(scored(spark, d).withColumn("surprise", F.abs(F.col("risk") - 0.25)), 0.45, 1.0)
    return risk.triage_ranking(t, 10).select("capture", "src_ip", "run", "channel", "max_risk")


@query("g17_scaled_surprise", base(*UP_TO_SEGS) + f""", q AS (SELECT quantile_cont(log_bytes, 0.75) - quantile_cont(log_bytes, 0.25) AS sb, quantile_cont(syn_ratio, 0.75) - quantile_cont(syn_ratio, 0.25) AS ss, stddev_pop(log_bytes) AS db, stddev_pop(syn_ratio) AS ds FROM segs), n AS (SELECT *, row_number() OVER {SEGW}) - 1 AS pos FROM segs),
e AS (SELECT capture, src_ip, run, wid, pos, log_bytes, syn_ratio, {ema_sql('log_bytes', 3, 'mb')}, {ema_sql('syn_ratio', 3, 'ms')} FROM n), l AS (SELECT *, coalesce(lag(mb) OVER {SEGW}), log_bytes) AS pb, coalesce(lag(ms) OVER {SEGW}), syn_ratio) AS ps FROM e)
SELECT capture, src_ip, run, wid, round((pow((log_bytes - pb) / CASE WHEN sb > 1e-6 THEN sb WHEN db > 1e-6 THEN db ELSE 1 END, 2) + pow((syn_ratio - ps) / CASE WHEN ss > 1e-6 THEN ss WHEN ds > 1e-6 THEN ds ELSE 1 END, 2)) / 2, 5) + 0.0 AS surprise FROM l, q""")
def _(spark, d):
    s = segs(spark, d).select(*KEYS, *[F.col(c).cast("double").alias(c) for c in ("log_bytes", "syn_ratio")])
    return risk.scaled_surprise(s, ["log_bytes", "syn_ratio"], cells.scaler_table(s, ["log_bytes", "syn_ratio"]), 3).select(*KEYS, F.round("surprise", 5).alias("surprise"))


@query("k1_bundle_alerts")
def _(spark, d):
    """Trained on the fixture's flows, stored, loaded, and applied to the same flows without labels: the alerts of the forecast."""
    path, f = shared.folder(spark, "bundle"), flows(spark, d)
    bundle.save(bundle.train(f, seconds=W, gap=GAP, horizon=5, particles=8, max_fpr=0.2), spark, path)
    b = bundle.load(spark, path)
    return bundle.alerts(b, bundle.forecast(b, f.drop("stage", "raw_stage", "label")))
