"""A bundle trained on labelled flows, saved, loaded in another session, applied to flows without labels."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import bundle, registry, risk

SF = "/root/testdata/sf0.001"
SETTINGS = {"seconds": 21600, "gap": 10, "particles": 8, "horizon": 5, "max_fpr": 0.2, "min_run": 2, "anomaly": 1.0}


@pytest.fixture(scope="module")
def trained(spark):
    return bundle.train(registry.flows(spark, SF), **SETTINGS)


def bag(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_no_label_is_an_input(spark, trained):
    inputs = trained.settings["inputs"]
    assert len(inputs) == 39 * 3 and not [c for c in inputs if c.startswith("cnt_") or c in ("stage", "n_flows")]
    assert abs(sum(trained.weights.values()) - 1) < 1e-9 and 0 < trained.threshold < 1
    assert {len(row) for row in trained.transitions} == {7} and all(abs(sum(row) - 1) < 1e-9 for row in trained.transitions)


def test_saved_and_loaded(spark, trained, tmp_path):
    """Raw flows without labels to cells, alerts and triage: the same before saving and after loading in a new session."""
    bundle.save(trained, spark, str(tmp_path / "bundle"))
    again = bundle.load(spark.newSession(), str(tmp_path / "bundle"))
    assert (again.settings, again.scaler, again.transitions, again.weights, again.threshold) == (trained.settings, sorted(trained.scaler), trained.transitions, trained.weights, trained.threshold)
    flows = registry.flows(spark, SF)
    blind = flows.drop("stage", "raw_stage", "label")
    a, b = (bundle.forecast(x, blind) for x in (trained, again))
    columns = [*bundle.KEY, "direct", "markov", "rollout", "eta", "risk", "forecast_stage", "stage_now", "surprise", "alert"]
    rows = bag(a.select(*columns))
    assert rows == bag(b.select(*columns)) and len(rows) == registry.segs(spark, SF).count()
    told = bag(bundle.forecast(again, flows).select(*columns))
    assert rows == told  # labels change nothing but the true phase
    assert bag(bundle.alerts(trained, a)) == bag(bundle.alerts(again, b)) and bag(bundle.triage(trained, a)) == bag(bundle.triage(again, b))
    with pytest.raises(ValueError):
        bundle.forecast(again._replace(settings=again.settings | {"inputs": ["other"]}), flows)


def test_better_than_chance(spark, trained):
    """The forecast's risk ranks cells before an attack above others."""
    from packetloom.operators.metrics import ranking

    out = bundle.forecast(trained, registry.flows(spark, SF)).select(F.lit("m").alias("method"), F.col("y_future").alias("y"), F.round("risk", 6).alias("score"))
    r = ranking(out, ["method"]).first()
    assert r["auc"] > 0.55


def test_alert_table(spark):
    """Numbers, durations, minutes to go, first cell's forecast, shown stage and true phase."""
    rows = [("c", "h", 0, 10 + i, r, f, e, s, p) for i, (r, f, e, s, p) in enumerate([(0.1, 2, -1.0, 0, "benign"), (0.8, 4, 3.0, 1, "pre_attack"), (0.95, 6, 1.0, 4, "during_attack"), (0.2, 2, -1.0, 0, "benign"), (0.9, 5, -1.0, 0, "benign")])]
    rows += [("c", "a", 0, w, 0.6, 2, 2.0, 0, "benign") for w in (3, 4)]
    df = spark.createDataFrame(rows, "capture string, src_ip string, run long, wid long, risk double, forecast_stage int, eta double, stage_now int, phase string")
    got = [tuple(r) for r in risk.alert_table(df, 0.5, 1, 60).orderBy("alert_id").collect()]
    assert [r[:9] for r in got] == [("A0001", "c", "a", 0, 180, 300, 2.0, 0.6, "MEDIUM"), ("A0002", "c", "h", 0, 660, 780, 2.0, 0.95, "CRITICAL"), ("A0003", "c", "h", 0, 840, 900, 1.0, 0.9, "CRITICAL")]
    assert [(r[9], r[10], r[12], r[13], r[14]) for r in got] == [(2, "Initial Access / Credential Access (TA0001)", 2.0, 0, "benign"), (4, "Command and Control (TA0011)", 3.0, 1, "pre_attack"), (5, "Exfiltration (TA0010)", None, 0, "benign")]
    assert risk.alert_table(df, 0.5, 2, 60).count() == 2


def test_triage_ranking(spark):
    df = spark.createDataFrame([("c", "a", 0, False, 0.3, 9.0, True), ("c", "b", 0, True, 0.8, 1.0, False), ("c", "d", 0, True, 0.9, 5.0, True), ("c", "e", 0, False, 0.1, 0.0, False)], "capture string, src_ip string, run long, by_risk boolean, max_risk double, z double, by_anomaly boolean")
    got = risk.triage_ranking(df)
    assert [(r["src_ip"], r["channel"]) for r in got.collect()] == [("d", "risk + anomaly"), ("b", "risk"), ("a", "anomaly"), ("e", "-")]
    assert risk.triage_ranking(df, 2).count() == 2
