"""What keeps work in proportion to the input: joins without large broadcasts, code that compiles, scans that read once."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from packetloom.operators import calibrate, cells, integrity, models, packets, reports, risk
from packetloom.sources import normalize

SMALL = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def largest_method(spark, df):
    """Bytes of the largest generated method; the JVM interprets those over 8000."""
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))


@pytest.fixture
def plain(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def states(spark):
    rows = [(f"c{i % 2}", f"h{i % 5}", 0, i, i % 7, *[(i * j) % 4 for j in range(7)]) for i in range(60)]
    return spark.createDataFrame(rows, "capture string, src_ip string, run long, wid long, stage int, " + ", ".join(f"cnt_{i} long" for i in range(7)))


@pytest.mark.parametrize("name", ["g20_ensemble", "j6_truncation"])
def test_cells_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in executed(entry.queries()[name](spark, SMALL))


def test_shared_captures_reads_once(spark):
    df = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("concat('c', user_id % 3) capture", "IF(event_id % 2 = 0, 'train', 'test') s")
    out = integrity.shared_captures(df, "s")
    assert executed(out).count("FileScan") == 1 and sorted(map(tuple, out.collect())) == [("train", "test", f"c{i}") for i in range(3)]


def test_rows_by_capture_stay(plain, states):
    """A table with a row for each capture comes to the cells, not the cells to three tasks."""
    for out in (cells.temporal_split(states, 0.7, 0.15, 2), reports.schedule(states, 60), risk.robust_z(states, "stage", ["capture"]).where("z < 9")):
        joins = re.findall(r"(\w+Join) \[capture#\d+\], \[capture#\d+\]", executed(out))
        assert joins and "SortMergeJoin" not in joins


def test_walks_and_paths_compile(plain, states):
    p = risk.matrix(risk.transitions(states))
    assert largest_method(plain, risk.stage_paths(states, p, 10)) < 8000
    assert largest_method(plain, risk.walked(states, p, 32, 10)) < 8000


def test_draws_are_dealt(spark, states):
    """A walk costs hundreds of draws a cell; the shuffle of cells before it keeps all partitions."""
    filled = cells.segments(states.drop("run", "stage").withColumn("n_flows", F.lit(1)), 10)
    assert risk.walked(filled, risk.matrix(risk.transitions(states)), 2, 3).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_next_time_without_a_growing_frame(spark):
    """A frame from each row to the end of its key is scanned anew for each row."""
    rows = [(i, float(t), "a", "b", 1, 2, 6) for i, t in enumerate([0, 5, 10, 11, 12, 20, 21, 22, 23, 40, 41, 52, 52, 60])]
    p = packets.keyed(spark.createDataFrame(rows, "event_id long, ts double, src string, dst string, sport int, dport int, proto int")).withColumn("flow", F.lit(0))
    out = packets.active_starts(p, 10)
    assert not re.search(r"RangeFrame, (?!unbounded)", executed(out))
    want, start, flow = {}, 0.0, 0
    for i, t, *_ in rows:
        if t - start > 10:
            start, flow = t, flow + 1
        want[i] = flow
    assert {r["event_id"]: r["flow"] for r in out.collect()} == want


def test_attributions_without_a_shuffle(plain):
    rows = [(i, float(i), None if i % 3 else 2.0, float(i * i), None) for i in range(20)]
    df = plain.createDataFrame(rows, "id long, a__now double, a__trend double, b__now double, c__now double")
    coefficients = plain.createDataFrame([("a__now", 0.5), ("a__trend", 2.0), ("c__now", 1.0)], "column string, coef double")
    out = models.attributions(df, ["a__now", "a__trend", "b__now", "c__now"], coefficients, df)
    assert "SortMergeJoin" not in executed(out)
    got = {(r["id"], r["feature"]): r["attribution"] for r in out.collect()}
    assert got == {k: v for i in range(20) for k, v in (((i, "a"), (i - 9.5) * 0.5), ((i, "c"), None))}  # b has no coefficient


def test_selection_counts_equal_scores(spark):
    df = spark.range(3000).selectExpr("(id * 7 % 10) / 10D direct", "(id * 3 % 4) / 4D markov", "IF(id * 13 % 5 = 0, 1, 0) y", "IF(id % 6 = 0, 1, 0) exploit_now")
    out = calibrate.mixtures(df, "direct", ["markov"])
    assert out.count() <= 10 * 4 * 2 * 11 and out.where("weight = 0.5").agg(F.sum(F.col("p") + F.col("n"))).first()[0] == 3000
    rows = df.select("y", "exploit_now", F.lit("markov").alias("partner"), F.lit(0.3).alias("weight"), F.round(F.col("direct") * 0.3 + F.col("markov") * 0.7, 6).alias("score"))
    (want,) = calibrate.selection(rows, ["partner", "weight"]).collect()
    (got,) = calibrate.selection(out.where("weight = 0.3"), ["partner", "weight"]).collect()
    assert got == want


@pytest.mark.parametrize("positives", [0, 1, 37, 90])
def test_permutation_by_a_loop(spark, positives):
    """Also where no bracket holds at first; the input is computed once."""
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    rows = [(f"k{i}", int(i * 29 % 90 < positives), (i * 7 % 13) / 13) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, y int, score double").withColumn("score", F.udf(told, "double")("score"))
    got = calibrate.permutation(df, ["k"], 20).first()
    assert seen.value == 90

    def precision(labels):
        out, tp = 0.0, 0
        for s in sorted({s for _, _, s in rows}, reverse=True):
            p, every = sum(y for y, r in zip(labels, rows, strict=True) if r[2] == s), sum(r[2] >= s for r in rows)
            tp += p
            out += p * tp / every
        return out / sum(labels)

    if not positives:
        assert got["observed"] is None and got["null_mean"] is None and got["p_value"] == 1 / 21
        return
    observed, null = precision([y for _, y, _ in rows]), []
    for rep in range(20):
        order = sorted(range(90), key=lambda i: (int(hashlib.md5(f"{rep}|{rows[i][0]}".encode()).hexdigest()[:8], 16), rows[i][0]))
        first = set(order[:positives])
        null.append(precision([int(i in first) for i in range(90)]))
    assert got["observed"] == pytest.approx(observed) and got["null_mean"] == pytest.approx(sum(null) / 20)
    assert got["p_value"] == pytest.approx((sum(round(x, 9) >= round(observed, 9) for x in null) + 1) / 21)


def test_formats_try_only_what_may_fit(spark):
    """The shape of a value spares the formats that can't read it, and none that can."""
    values = ["13/01/2024 10:11:12", "1/2/2024 3:04:05", "01/02/2024 03:04:05 PM", "1/2/2024 3:04:05 am", "2024/1/2 3:04:05.5", "2024-01-02 03:04:05.123456", "2024-1-2 3:4:5", "1/13/2024 3:04", "+1/2/2024 3:04:05", "1/2/+12024 3:04:05", "31/02/2024 1:02:03", "not-a-date", "", None, "1700000000"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = df.select("v", *[F.struct(F.unix_micros(normalize.read(F.col("v"), f)).alias("got"), F.unix_micros(F.try_to_timestamp("v", F.lit(f))).alias("want"), F.col("v").rlike(normalize.SHAPES[f]).alias("tried")).alias(f"f{i}") for i, f in enumerate(normalize.FORMATS)]).collect()
    for r in out:
        each = [r[f"f{i}"] for i in range(len(normalize.FORMATS))]
        assert all(x["got"] == x["want"] for x in each), r["v"]
    assert sum(bool(out[0][f"f{i}"]["tried"]) for i in range(len(normalize.FORMATS))) == 1


def test_few_quantiles_of_many_columns(spark):
    """The same as from all values, for smooth, constant, sparse and short columns; few of the values are shuffled."""
    from packetloom.operators import scans

    df = spark.range(20000).selectExpr("id * 7919 % 20000 / 20000D smooth", "1.5D constant", "IF(id % 50 = 0, id / 7D, 0D) sparse", "IF(id < 3, CAST(id AS DOUBLE), NULL) short", "IF(id % 4 = 0, -1D, 1D) edge", "CAST(NULL AS DOUBLE) none")
    rows = lambda q: sorted(map(tuple, q.select("column", "i", "value").collect()))
    want = rows(scans.quantiles(df, [], df.columns, 4, [1, 2, 3]))
    assert rows(scans.few_quantiles(df, df.columns, 4, [1, 2, 3])) == want and len(want) == 15
    assert rows(scans.few_quantiles(df.limit(2), df.columns, 4, [1, 2, 3])) == rows(scans.quantiles(df.limit(2), [], df.columns, 4, [1, 2, 3]))


def test_targets_deal_rows_once(spark):
    """Burst and trend of all features come without a shuffle of their own after the targets."""
    from packetloom.operators import bundle
    from packetloom.sources import events

    states = cells.targets(bundle.states_of(events.flows(spark, SMALL), 21600, 10), 10)
    shuffles = lambda df: len(re.findall(r"Exchange hashpartitioning", executed(df)))
    out, inputs = bundle.scaled_inputs(states, 3, 15)
    assert shuffles(out) == shuffles(states) and len(inputs) == 117
