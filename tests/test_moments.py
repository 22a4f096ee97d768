"""Cells as sums and sketches: merged they are what flows give; counts err as stated."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import cells, integrity, moments, registry

SF = "/root/testdata/sf0.001"


def bag(df):
    return sorted(tuple(round(x + 1.3e-9, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_merged_cells_equal_cells_of_flows(spark):
    """Wider windows, networks and both at once from stored sums; with nulls where a cell has no values."""
    f = registry.flows(spark, SF).where("ts IS NOT NULL")
    columns = [c for c in cells.build(f, 21600).columns if c not in cells.KEYS]
    small = moments.moments(f, 21600)
    assert bag(moments.features(small).select(*cells.KEYS, *columns)) == bag(cells.build(f, 21600).select(*cells.KEYS, *columns))
    assert bag(moments.features(moments.widened(small, 4)).select(*cells.KEYS, *columns)) == bag(cells.build(f, 4 * 21600).select(*cells.KEYS, *columns))
    both = moments.features(moments.rolled(small, [["capture", "src_ip", "wid"], ["capture", "wid"], []]))
    assert bag(both.where("level = 1").select("capture", "wid", *columns)) == bag(cells.build(f, 21600, ["capture", "wid"]).select("capture", "wid", *columns))
    assert both.where("level = 2").select("n_flows").collect() == [(f.count(),)] and both.where("level = 0").count() == small.count()


@pytest.mark.parametrize("lg_k", [10, 12])
def test_sketches_err_as_stated(spark, lg_k):
    """Thirty cells of 20,000 addresses each, merged from 8 windows: errors within four standard errors, about the stated one on average."""
    f = spark.range(30 * 8 * 4000).select(F.lit("c").alias("capture"), F.concat(F.lit("h"), F.col("id") % 30).alias("src_ip"), (F.floor(F.col("id") / 30) % 8 * 10.0).alias("ts"), F.concat(F.lit("a"), F.floor(F.col("id") / 30) % 20000, F.lit("-"), F.col("id") % 30).alias("dst_ip"),
                                         F.lit(1).alias("dst_port"), F.lit(6).alias("proto"), F.lit(0).alias("stage"), *[F.lit(1.0).alias(c) for c in ("fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "duration", "syn", "ack", "rst", "retrans", "ttl_mean", "ttl_std")])
    merged = moments.features(moments.widened(moments.moments(f, 10, lg_k=lg_k), 8))
    errors = [r["n_dst_ips"] / 20000 - 1 for r in merged.collect()]
    stated = 1.04 / 2 ** (lg_k / 2)
    assert len(errors) == 30 and max(map(abs, errors)) < 4 * stated and (sum(e * e for e in errors) / 30) ** 0.5 < 1.5 * stated


def test_truncation_and_shared_captures(spark):
    rows = [("c", "h", 0, w, float(w * w % 7), 2 * int(w == 15)) for w in range(30)]
    df = spark.createDataFrame(rows, "capture string, src_ip string, run long, wid long, x double, stage int")
    peeks = integrity.truncation(df, lambda d: cells.targets(d, 5), ["y_future"], 12)
    assert sorted(r["wid"] for r in peeks.collect()) == [10, 11, 12]
    assert integrity.truncation(df, lambda d: cells.multi_scale(d, "x", 3, 15), ["burst", "trend"], 12).count() == 0
    split = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val"), ("b", "train"), ("c", "test"), (None, "train"), (None, "val")], "capture string, s string")
    assert sorted(map(str, map(tuple, integrity.shared_captures(split, "s").collect()))) == sorted(map(str, [("train", "test", "a"), ("train", "val", "b"), ("train", "val", None)]))
