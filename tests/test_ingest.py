"""Folders of flow files in several layouts, on files written by hand."""

import gzip

import pytest
from pyspark.sql import functions as F

from packetloom.sources import files, normalize

CIC = "Src IP,Dst IP,Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,TotLen Fwd Pkts,Label\n"
ARGUS = "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,TotPkts,TotBytes,SrcBytes,Label\n"


def line(time, i=0):
    return f"10.0.0.{i},10.0.1.1,443,6,{time},2000000,3,40,Benign\n"


@pytest.fixture
def folder(tmp_path):
    """Two header families, five ways to write times, garbage, a field too many, a short line, quoted commas, a repeated header, names with patterns."""
    top = tmp_path / "in [1] {a}*"
    (top / "CTU-13-Dataset" / "7").mkdir(parents=True)
    (top / "day one.csv").write_text("﻿" + CIC + "".join(line(f"{d:02}/01/2018 10:00:00", d) for d in range(10, 31)) + CIC + line("not-a-date") + line("31/01/2018 10:00:00").rstrip() + ",more,and more\n" + "10.0.0.99,10.0.1.1,443,6,31/01/2018 10:00:00\n")
    with gzip.open(top / "us.csv.gz", "wt") as f:
        f.write(CIC + "".join(line(f"1/{d}/2018 10:00:00", d) for d in range(1, 31)))
    (top / "iso.csv").write_text(CIC + line('"2018-01-05 10:00:00"') + '10.0.0.1,10.0.1.1,443,6,2018-01-06 10:00:00,1,3,40,"Bot, perhaps"\n')
    (top / "epoch.csv").write_text("time,Dur,Label\n1515146400000,1.5,PortScan\n1515146401500,1.5,Benign\n")
    (top / "CTU-13-Dataset" / "7" / "x.binetflow").write_text(ARGUS + "2018/01/05 10:00:00.250000,1.5,tcp,10.0.0.1,0x0303,->,10.0.0.2,80,SPA_SPA,9,1000,300,flow=From-Botnet-V42-TCP-CC\n")
    (top / "empty.csv").write_text("")
    (top / "no times.csv").write_text("Src IP,Dur\n10.0.0.1,3\n")
    (top / "broken.csv.gz").write_bytes(b"no gzip at all")
    (top / "ignored.txt").write_text(CIC + line("10/01/2018 10:00:00"))
    return top


def test_mixed_folder(spark, folder):
    spark.createDataFrame([(1515146400_000_000, "10.0.0.5", 6), (1515146401_000_000, "10.0.0.5", 17)], "ts long, saddr string, proto int").coalesce(1).write.parquet(f"{folder}/tables.parquet")
    lines, skipped = files.rows(spark, files.literal(f"{folder}"))
    got = lines.groupBy("capture", "status").agg(F.count("*").alias("n"), F.min("ts"), F.max("ts"))
    day = 86400.0
    at = 1515146400.0  # 5 January 2018, 10:00
    assert {(r[0], r[1]): tuple(r[2:]) for r in got.collect()} == {
        ("day one", "flow"): (22, at + 5 * day, at + 26 * day), ("day one", "no time"): (2, None, None), ("day one", "bad line"): (1, at + 26 * day, at + 26 * day),
        ("us", "flow"): (30, at - 4 * day, at + 25 * day), ("iso", "flow"): (2, at, at + day), ("epoch", "flow"): (2, at, at + 1.5), ("7", "flow"): (1, at + 0.25, at + 0.25), ("tables", "flow"): (2, at, at + 1.0)}
    assert {(r["capture"], r["reason"].split(" column")[0]) for r in skipped.collect()} == {("empty", "no readable header"), ("no times", "no timestamp"), ("broken", "no readable header")}
    flows = {(r["capture"], r["src_ip"]): r for r in files.scan(spark, files.literal(f"{folder}")).collect()}
    assert (flows["7", "10.0.0.1"]["syn"], flows["7", "10.0.0.1"]["fwd_pkts"], flows["7", "10.0.0.1"]["bwd_bytes"], flows["7", "10.0.0.1"]["src_port"], flows["7", "10.0.0.1"]["stage"]) == (2, 9, 700, 0, 4)
    assert (flows["day one", "10.0.0.99"]["fwd_pkts"], flows["day one", "10.0.0.99"]["label"], flows["iso", "10.0.0.1"]["label"]) == (0, "Benign", "Bot, perhaps")
    assert flows["tables", "10.0.0.5"]["fwd_pkts"] == 0 and flows["epoch", "0.0.0.0"]["duration"] == 1.5


def test_families_and_accounting(spark, folder, tmp_path):
    families, _ = files.surveyed(spark, files.literal(f"{folder}"))
    assert {(len(f.header), f.times, len(f.paths)) for f in families} == {(9, normalize.Times(format=0), 1), (9, normalize.Times(format=6), 1), (9, normalize.Times(format=4), 1), (3, normalize.Times(factor=1e3), 1), (13, normalize.Times(format=2), 1)}
    lines, skipped = files.rows(spark, files.literal(f"{folder}"))
    seen = files.stored(lines, str(tmp_path / "lines"))
    assert seen == {"lines": 60, "flows": 57, "bad_lines": 1, "no_time": 2}
    told = {r["capture"]: r for r in files.accounting(spark.read.schema(lines.schema).parquet(str(tmp_path / "lines")), skipped, 3600, 10, ["10.0.0.1"]).collect()}
    assert {c: (r["files"], r["lines"], r["flows"], r["flows_kept"], r["bad_lines"], r["no_time"], r["hosts"], r["windows"], r["segments"], r["skipped_files"]) for c, r in told.items()} == {
        "day one": (1, 25, 22, 10, 1, 2, 10, 10, 10, 0), "us": (1, 30, 30, 11, 0, 0, 11, 11, 11, 0), "iso": (1, 2, 2, 1, 0, 0, 1, 1, 1, 0), "epoch": (1, 2, 2, 0, 0, 0, 0, 0, 0, 0), "7": (1, 1, 1, 1, 0, 0, 1, 1, 1, 0),
        "empty": (0, 0, 0, 0, 0, 0, 0, 0, 0, 1), "no times": (0, 0, 0, 0, 0, 0, 0, 0, 0, 1), "broken": (0, 0, 0, 0, 0, 0, 0, 0, 0, 1)}


def test_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    lines, skipped = files.rows(spark, str(tmp_path / "none"))
    assert lines.count() == 0 and skipped.count() == 0 and files.scan(spark, str(tmp_path / "none")).columns[:2] == ["ts", "src_ip"]


def test_times_of_one_table(spark):
    """One table with three known formats: the one that reads most decides where several read a value, and none is lost."""
    times = [f"{i % 28 + 1:02}/02/2018 10:00:00" for i in range(60)] + [f"2018-03-{i % 28 + 1:02} 10:00:00" for i in range(30)] + ["2018/04/05 10:00:00.500000"] * 3 + ["garbage", None, "", "9"]
    raw = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "StartTime string, Spkts int")
    got = sorted(r["ts"] for r in normalize.flows(raw).collect())
    assert len(got) == 93 and got[-1] == 1522922400.5
    numbers = spark.createDataFrame([(1_600_000_000_000 + 1000 * i,) for i in range(5)], "ts long")
    assert [r["ts"] for r in normalize.flows(numbers).orderBy("ts").collect()] == [1_600_000_000.0 + i for i in range(5)]
    stamps = spark.sql("SELECT timestamp'2018-01-05 10:00:00.25' AS Timestamp, 'udp' AS Protocol")
    assert [(r["ts"], r["proto"]) for r in normalize.flows(stamps).collect()] == [(1515146400.25, 17)]


def test_names_resolve():
    """Any case and punctuation; the leftmost of several columns of one name; factors of their own."""
    got = normalize.resolved(["Label", "SRC-IP", "src ip", "Flow_Duration", "dur", "init_win", "Init Fwd Win Byts", "nothing"])
    assert got == {"label": (0, 1.0), "src_ip": (1, 1.0), "duration": (3, 1e-6), "init_win": (5, 1.0)}
    assert normalize.resolved(["Dur", "Flow Duration"])["duration"] == (0, 1.0)


def test_layouts_round_trip(spark):
    row = dict.fromkeys(normalize.COLUMNS, 2.0) | {"ts": 1515146400.25, "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 5, "dst_port": 80, "proto": 6, "label": "Benign", "urg": 0.0, "ack": 0.0}
    f = spark.createDataFrame([tuple(row[c] for c in normalize.COLUMNS)], ", ".join(f"{c} {'string' if c in ('src_ip', 'dst_ip', 'label') else 'int' if c in ('src_port', 'dst_port', 'proto') else 'double'}" for c in normalize.COLUMNS))
    back = normalize.flows(normalize.to_cic(f)).first().asDict()
    assert {**back, "ts": 0, "stage": 0} == {**row, "ts": 0, "stage": 0} and back["ts"] == 1515146400.0
    raw = normalize.to_binetflow(f)
    assert raw.first()["State"] == "SFRP" and raw.drop("State").columns == [c for c in raw.columns if c != "State"]
    back = normalize.flows(raw).first()
    assert (back["ts"], back["fwd_pkts"], back["fwd_bytes"], back["bwd_bytes"], back["syn"], back["ack"], back["stage"]) == (1515146400.25, 4.0, 2.0, 2.0, 1.0, 0.0, 0)
