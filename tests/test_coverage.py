"""Attributes that cells carry, features of least scale, entropies together: against plain loops."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packetloom.operators import cells, integrity, reports


def test_attribute_coverage(spark):
    rows = [("a", 0, 64.0, 1, 0.0, 0, 0.5, 1, 0.0, 0.1), ("a", 1, 0.0, 0, 3.0, 0, 0.0, 1, 0.0, None), ("b", 1, 0.0, 1, 0.0, 1, 0.0, 1, 0.0, 0.3)]
    names = ["capture", "ttl_missing", "ttl_mean", "payload_missing", "log_payload_mean", "frag_missing", "frag_frac", "iat_max_missing", "log_iat_max", "scan_seq_frac"]
    df = spark.createDataFrame(rows, "capture string, ttl_missing int, ttl_mean double, payload_missing int, log_payload_mean double, frag_missing int, frag_frac double, iat_max_missing int, log_iat_max double, scan_seq_frac double")
    got = {(r["capture"], r["attribute"]): (r["cells_carried"], r["share"], r["mean_when_carried"]) for r in reports.attribute_coverage(df, ["capture"]).collect()}
    for capture in "ab":
        mine = [dict(zip(names, r)) for r in rows if r[0] == capture]
        for attribute, flag, feature in reports.ATTRIBUTES:
            has = [r[feature] for r in mine if r[feature] is not None and (flag is None or r[flag] == 0)]
            n, share, mean = got[capture, attribute]
            assert (n, share) == (len(has), pytest.approx(len(has) / len(mine)))
            assert mean == (pytest.approx(sum(has) / len(has)) if has else None)
    assert reports.attribute_coverage(df.limit(0), ["capture"]).count() == 0


def test_least_shifts(spark):
    params = spark.createDataFrame([("d", 0.5), ("b", 0.1), ("c", 0.1), ("a", 2.0), ("e", 0.1)], "column string, scale double")
    assert integrity.least_shifts(params) == pytest.approx({"b": 3.0, "c": 3.0, "e": 3.0})
    assert list(integrity.least_shifts(params, 4))[-1] == "d"
    assert integrity.least_shifts(params.limit(0)) == {}


def test_entropies_together(spark):
    rows = [("x", f"h{i % 3}", i * 7 % 50, None if i % 4 == 0 else f"d{i % 5}", i * i % 6) for i in range(200)]
    df = spark.createDataFrame(rows, "capture string, src_ip string, ts int, dst_ip string, dst_port int")
    got = {(r["src_ip"], r["wid"]): r for r in cells.entropies(df, 10, ["dst_ip", "dst_port"]).collect()}
    held = defaultdict(list)
    for r in rows:
        held[r[1], r[2] // 10].append(r)
    assert set(got) == set(held)
    for key, mine in held.items():
        for name, i in (("dst_ip", 3), ("dst_port", 4)):
            c = Counter(r[i] for r in mine).values()
            want = math.log2(sum(c)) - sum(x * math.log2(x) for x in c) / sum(c)
            assert (got[key][f"{name}_n"], got[key][f"{name}_entropy"]) == (len(c), pytest.approx(want, abs=1e-9))
    for name in ("dst_ip", "dst_port"):  # as one value at a time gives them
        one = cells.entropy(df, 10, name).select("src_ip", "wid", "n_distinct", F.round("entropy", 9)).collect()
        assert all((got[r[0], r[1]][f"{name}_n"], round(got[r[0], r[1]][f"{name}_entropy"], 9)) == (r[2], pytest.approx(r[3], abs=1e-8)) for r in one)
