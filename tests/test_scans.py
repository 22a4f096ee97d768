"""Scans over keys against plain loops, and their spread over tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.operators import cells, metrics, risk, scans


def test_row_before(spark):
    """Blocks of any size, keys of one row, null values and null keys."""
    rng = np.random.default_rng(1)
    rows = [(k, int(t), int(rng.integers(9)) if rng.random() > 0.2 else None) for k in ("a", "b", None, "lone") for t in (rng.permutation(400)[:90] - 200 if k != "lone" else [7])]
    df = spark.createDataFrame(rows, "k string, t long, v int").repartition(4)
    want = {}
    for k, group in pd.DataFrame(rows, columns=["k", "t", "v"]).groupby("k", dropna=False):
        group = group.sort_values("t")
        want |= {(None if pd.isna(k) else k, t): None if pd.isna(v) else v for t, v in zip(group.t, group.v.shift(), strict=True)}
    for size in (1, 16, 1000):
        got = scans.lagged(df, ["k"], F.floor(F.col("t") / size), ["t"], {"was": "v"})
        assert got.columns == ["k", "t", "v", "was"] and {(r["k"], r["t"]): r["was"] for r in got.collect()} == want


@pytest.mark.parametrize("start", [-300, 0, 256, 13])
def test_decayed_means(spark, start):
    """Short and long spans, alone and together, whatever the first place; spans far apart in one call."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=900) + 5
    df = spark.createDataFrame([(k, start + i, float(v)) for k, n in (("a", 900), ("b", 1), ("c", 300)) for i, v in enumerate(x[:n])], "k string, t long, x double").repartition(5)
    means = [("x", span, f"m{span}") for span in (1, 3, 15, 200)]
    got = scans.decayed(df, ["k"], "t", means, before=True, block=64).toPandas().sort_values(["k", "t"])
    for k, group in got.groupby("k"):
        for _, span, name in means:
            a, y, out = 2 / (span + 1), None, []
            for v in group.x:
                y = v if y is None else (1 - a) * y + a * v
                out.append(y)
            np.testing.assert_allclose(group[name], out, rtol=1e-12)
            np.testing.assert_allclose(group[f"_{name}"], [np.nan, *out[:-1]], rtol=1e-12)
    assert len(got) == 1201


def test_places_and_sums(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else None if i % 2 else "k", i, int(rng.integers(5))) for i in rng.permutation(600).tolist()]
    df = spark.createDataFrame(rows, "k string, t long, w int").repartition(6)
    p = pd.DataFrame(rows, columns=["k", "t", "w"]).sort_values("t")
    p["k"] = p.k.fillna("none")
    p["place"], p["sum"] = p.groupby("k").cumcount(), p.groupby("k").w.cumsum() - p.w
    want = {t: (a, b) for t, a, b in zip(p.t, p.place, p["sum"], strict=True)}
    a = {r["t"]: r["p"] for r in scans.ranked(df, ["k"], ["t"], "p").collect()}
    b = {r["t"]: r["s"] for r in scans.ranked(df, ["k"], ["t"], "s", "w").collect()}
    assert {t: (a[t], b[t]) for t in a} == want
    assert sorted(r["p"] for r in scans.ranked(df, [], ["t"], "p").collect()) == list(range(600))
    assert scans.ranked(df.limit(0), ["k"], ["t"], "p").count() == 0


def test_quantiles(spark):
    """As percentile has them: ties of most rows, nulls, one row, two columns, few and many steps."""
    rng = np.random.default_rng(4)
    rows = [(g, float(rng.integers(3)) if i % 2 else float(rng.normal()), None if i % 5 == 0 else float(i)) for g, n in (("a", 400), ("b", 7), ("c", 1), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, u double, v double").repartition(5)
    for steps, which in ((4, [1, 2, 3]), (500, None), (3, None)):
        ps = [i / steps for i in (which or range(steps + 1))]
        want = df.groupBy("g").agg(*[F.percentile(c, F.array(*map(F.lit, ps))).alias(c) for c in ("u", "v")]).collect()
        want = {(r["g"], c, i): x for r in want for c in ("u", "v") if r[c] is not None for i, x in zip(which or range(steps + 1), r[c], strict=True)}
        got = {(r["g"], r["column"], r["i"]): r["value"] for r in scans.quantiles(df, ["g"], ["u", "v"], steps, which).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12) for k in want)
    assert scans.quantiles(df.limit(0), ["g"], ["u"], 4).count() == 0


def test_scaler(spark):
    df = spark.createDataFrame([(float(i), 3.0, float(i % 10 == 0)) for i in range(101)], "a double, b double, c double")
    got = {r["column"]: (r["center"], r["scale"]) for r in cells.scaler_table(df, ["a", "b", "c"]).collect()}
    assert got["a"] == (50.0, 50.0) and got["b"] == (3.0, 1.0) and got["c"][0] == 0.0 and got["c"][1] == pytest.approx(np.std([i % 10 == 0 for i in range(101)]))
    assert {r["column"]: (r["center"], r["scale"]) for r in cells.scaler_table(df, ["a", "b"], 1000).collect()} == {"a": (50.0, 50.0), "b": (3.0, 1.0)}


def test_threshold_of_any_scores(spark):
    """Continuous scores, no positives, no negatives, ties: as a loop over the candidates finds it."""
    rng = np.random.default_rng(5)
    rows = [("real", int(s + rng.normal() > 0.9), float(s)) for s in rng.random(700)] + [("none", 0, float(i % 3)) for i in range(20)] + [("all", 1, 0.5)] * 5 + [("ties", int(i % 4 == 0), float(i % 4 == 0 or i % 5 == 0)) for i in range(200)]
    got = {r["method"]: (r["threshold"], r["f1"], r["fpr"]) for r in metrics.thresholds(spark.createDataFrame(rows, "method string, y int, score double"), 0.1, ["method"]).collect()}
    for m in ("real", "none", "all", "ties"):
        y, s = (np.array([r[i] for r in rows if r[0] == m], float) for i in (1, 2))
        best = None
        for t in np.unique(np.percentile(s, np.linspace(0, 100, 501))):
            on = s >= t
            tp, fp = (y * on).sum(), ((1 - y) * on).sum()
            f1 = round(2 * tp / (tp + fp + y.sum()) if tp + fp + y.sum() else 0.0, 9)
            fpr = fp / (1 - y).sum() if (1 - y).sum() else 0.0
            key = (fpr <= 0.1, f1 if fpr <= 0.1 else -fpr, -t)
            best = max(best, (key, t, f1, fpr)) if best else (key, t, f1, fpr)
        assert got[m] == pytest.approx(best[1:], abs=1e-9), m


def test_segments_by_loop(spark):
    """Runs and fillings of hosts with many, few and no silences, over the borders of blocks."""
    rng = np.random.default_rng(6)
    wids = {"a": sorted(rng.choice(2000, 500, replace=False).tolist()), "b": [5], "c": list(range(95, 130)), "d": sorted((rng.choice(4000, 90, replace=False) - 2000).tolist())}
    f = lambda h, w: ("c0", h, w, 1, *([0] * 6), 1)
    df = spark.createDataFrame([f(h, w) for h, ws in wids.items() for w in ws], "capture string, src_ip string, wid long, n_flows int, " + ", ".join(f"cnt_{i} int" for i in range(6)) + ", cnt_6 int").repartition(4)
    for block in (10, 64, 4096):
        got = sorted((r["src_ip"], r["run"], r["wid"], r["is_filled"], r["stage"]) for r in cells.segments(df, 10, block).collect())
        want = []
        for h, ws in wids.items():
            run = 0
            for before, w in zip([None, *ws], ws, strict=False):
                if before is not None and w - before > 10:
                    run += 1
                elif before is not None:
                    want += [(h, run, x, True, 0) for x in range(before + 1, w)]
                want.append((h, run, w, False, 6))
        assert got == sorted(want)


def most_in_a_task(df) -> float:
    """The largest share of df's rows in one partition."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n) / sum(n)


def test_one_hot_host_spreads(spark):
    """One capture with one host: segments, means, the row before and places lie in all tasks."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        zero = [F.lit(0).alias(f"cnt_{i}") for i in range(7)]
        hot = spark.range(200_000).select(F.lit("c").alias("capture"), F.lit("h").alias("src_ip"), F.col("id").alias("wid"), F.lit(1).alias("n_flows"), F.rand(1).alias("x"), *zero)
        segs = cells.segments(hot, 10, 512)
        assert segs.count() == 200_000 and most_in_a_task(segs) < 0.15
        assert most_in_a_task(cells.multi_scale(segs, "x", 3, 15)) < 0.15
        assert most_in_a_task(scans.lagged(hot, ["capture", "src_ip"], F.floor(F.col("wid") / 512), ["wid"], {"was": "x"})) < 0.15
        assert most_in_a_task(scans.ranked(hot, ["capture"], ["wid"], "place")) < 0.35
        z = risk.robust_z(hot.select("capture", "wid", "x"), "x", ["capture"])
        assert z.count() == 200_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
