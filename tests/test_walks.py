"""Walks in numpy: the same draws as risk.draw, the same stages as a plain loop, a row a cell between Spark and Python."""

import hashlib
from statistics import median

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.operators import risk, walks

#: Messages of one, two and more blocks, empty and with letters of several bytes.
TEXTS = ["c0|10.0.0.1|19000", "", "é" * 30, *["x" * n for n in (50, 51, 52, 53, 54, 55, 56, 116, 117, 118, 200)]]


def u(number, key):
    return int(hashlib.md5(f"{number}|{key}".encode()).hexdigest()[:8], 16) / 2**32


@pytest.fixture
def states(spark):
    rows = [("c", f"h{i % 3}" if i else None, 0, i, *[(i * j) % 4 for j in range(7)]) for i in range(40)] + [("c", "none", 0, 0, *[None] * 7)]
    return spark.createDataFrame(rows, "capture string, src_ip string, run long, wid long, " + ", ".join(f"cnt_{i} long" for i in range(7)))


P = [[(1 + (i * j) % 3) / sum(1 + (i * k) % 3 for k in range(7)) for j in range(7)] for i in range(7)]


def test_draws(spark):
    got = walks.draws(pa.array(["before", *TEXTS]).slice(1), 101, 2, 11)
    assert all(got[q, k, i] == u(q * 11 + k, t) for i, t in enumerate(TEXTS) for q in (0, 1, 9, 10, 90, 91, 100) for k in range(3))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", risk.draw(F.lit(1101), "t").alias("u"))
    assert all(r["u"] == got[100, 1, r["i"]] for r in df.collect())


def walk(r, particle, steps, stride):
    n = sum(r[f"cnt_{i}"] for i in range(7)) + 3.5
    b, key = [(r[f"cnt_{i}"] + 0.5) / n for i in range(7)], "|".join(str(x) for x in (r["capture"], r["src_ip"], r["wid"]) if x is not None)
    out = []
    for k in range(steps + 1):
        weights = P[out[-1]] if out else b
        out.append(sum(sum(weights[1 : j + 1], weights[0]) <= u(particle * stride + k, key) for j in range(6)))
    return out


def test_walks_by_a_loop(spark, states):
    """Also of keys with a null; a belief with a null has no stage."""
    rows = {(r["src_ip"], r["wid"]): r for r in states.collect()}
    got = risk.walked(states, P, 12, 4, 7).collect()
    assert len(got) == 41 * 12
    for r in got:
        mine = rows[r["src_ip"], r["wid"]]
        assert [r[f"s{k}"] for k in range(5)] == ([None] * 5 if mine["cnt_0"] is None else walk(mine, r["particle"], 4, 7))


def test_grid_and_fan_by_a_loop(spark, states):
    rows = {(r["src_ip"], r["wid"]): r for r in states.collect() if r["cnt_0"] is not None}
    chance = [sum(row[2:]) for row in P]
    for r in risk.rollout_grid(states, P, [1, 12], [1, 2, 4], 5).collect():
        if r["src_ip"] == "none":
            assert (r["risk_rollout"], r["hit_share"], r["eta"]) == (None, 0.0, -1.0)
            continue
        each = [walk(rows[r["src_ip"], r["wid"]], q, 4, 5) for q in range(r["particles"])]
        hits = [k for w in each if (k := next((k for k in range(1, r["steps"] + 1) if w[k] >= 2), None))]
        assert r["risk_rollout"] == pytest.approx(sum(max(chance[s] for s in w[: r["steps"]]) for w in each) / r["particles"])
        assert (r["hit_share"], r["eta"]) == (len(hits) / r["particles"], median(hits) if hits else -1.0)
    for r in risk.fan(states.where("cnt_0 IS NOT NULL"), P, 11, 4).collect():
        v = sorted(chance[walk(rows[r["src_ip"], r["wid"]], q, 4, 5)[r["k"] - 1]] for q in range(11))
        assert (r["low"], r["mid"], r["high"]) == pytest.approx((v[1], v[5], v[9]))


def test_no_draw_in_the_plan(spark, states):
    """Sums are taken many at a time, not by an expression for each particle and step, and no row of a particle is shuffled."""
    for out in (risk.rollout(states, P, 8, 4), risk.rollout_paths(states, P, 8, 4), risk.fan(states, P, 8, 4), risk.rollout_grid(states, P, [1, 8], [2, 4])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "md5" not in plan and plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange")
