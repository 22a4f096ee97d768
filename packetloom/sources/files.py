"""Flow files: discovery, scans by header family, accounting, and sinks.

A folder may hold files of several layouts: each file has its own header and its own way to write times. `surveyed` looks at the top
of every file (one task a file, which ends after the first batch of lines) and puts files with the same header and the same
times into one family; `scan` reads each family once, with its columns and its time format as literals of the plan.
"""

from __future__ import annotations

import csv
from contextlib import contextmanager
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.stages import monitored
from packetloom.operators import cells
from packetloom.sources import normalize
from packetloom.sources.normalize import Times

ENDINGS = ["csv", "csv.gz", "binetflow", "parquet"]
BAD = "_bad"


class Family(NamedTuple):
    """Files that are read alike: their kind (text or parquet), header and times."""

    kind: str
    header: tuple[str, ...]
    times: Times
    paths: list[str]


def capture_of(path: Column) -> Column:
    """The scenario number of a file's path, else its name without endings; parts of a folder that Spark wrote have the folder's name."""
    whole = F.regexp_replace(path, r"/part-[^/]*$", "")
    number = F.regexp_extract(whole, r"CTU-13-Dataset/(\d+)/", 1)
    return F.when(number != "", number).otherwise(F.regexp_extract(F.url_decode(F.replace(whole, F.lit("+"), F.lit("%2B"))), r"([^/]+?)(?:\.[A-Za-z]+)*$", 1))


def listed(spark: SparkSession, path: str | list[str], endings: list[str] | None = None) -> list[str]:
    """The flow files below path, as Spark's own file listing has them; nothing is read."""
    pattern = f"*.{{{','.join(endings or ENDINGS)}}}"
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return sorted(unquote(p) for p in there.inputFiles())


def literal(path: str) -> str:
    """A path whose letters stand for themselves where patterns are allowed."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


def local(path: str) -> str:
    """One spelling of local paths."""
    return path.replace("file:///", "file:/", 1)


@contextmanager
def one_task_a_file(spark: SparkSession):
    names, whole = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), str(1 << 40)
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, whole)
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def tops(spark: SparkSession, paths: list[str], lines: int = 2000) -> DataFrame:
    """file, header, times: the first line's fields and the time column's values in the lines after it, for each text file."""

    def top(batches):
        for batch in batches:
            text = [v for v in batch.column("value").to_pylist()[: lines + 1] if v and v.strip()]
            if text:
                header, *rows = csv.reader(text)
                header[0] = header[0].removeprefix("\ufeff")
                at = normalize.resolved(header).get("ts", (len(header), 1.0))[0]
                times = [r[at].strip() for r in rows if len(r) > at]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("file")[0].as_py()]), pa.array([header], pa.list_(pa.string())), pa.array([times], pa.list_(pa.string()))], ["file", "header", "times"])
                return  # the rest of the file stays unread

    raw = spark.read.option("ignoreCorruptFiles", True).text([literal(p) for p in paths]).select(F.substring("value", 1, 1 << 16).alias("value"), F.col("_metadata.file_path").alias("file"))
    return raw.mapInArrow(top, "file string, header array<string>, times array<string>")


def surveyed(spark: SparkSession, path: str | list[str], endings: list[str] | None = None) -> tuple[list[Family], list[tuple[str, str]]]:
    """The families of the files below path, and (path, reason) of files that can't be read. A row for each file comes to the driver, which lists them anyway. Empty and corrupt files have no readable header."""
    there, skipped = listed(spark, path, endings), []
    text, tables = ([p for p in there if p.endswith(".parquet") is parquet] for parquet in (False, True))
    found: dict[tuple, list[str]] = {}
    if text:
        with one_task_a_file(spark):
            seen = tops(spark, text)
            votes = seen.select("file", "header", F.explode_outer("times").alias("v")).groupBy("file", "header").agg(*normalize.ballots(F.col("v"))).collect()
        for r in votes:
            found.setdefault(("text", tuple(r["header"]), normalize.elected(r)), []).append(unquote(r["file"]))
        read = {local(p) for paths in found.values() for p in paths}
        skipped += [(p, "no readable header") for p in text if local(p) not in read]
    if tables:
        raw = spark.read.option("mergeSchema", True).parquet(*[literal(p) for p in tables])
        header = tuple(raw.columns)
        if "ts" in (places := normalize.resolved(list(header))):
            c = header[places["ts"][0]]
            votes = raw.groupBy(F.col("_metadata.file_path").alias("file")).agg(*normalize.ballots(normalize.time_text(F.col(f"`{c}`"), dict(raw.dtypes)[c]))).collect()
            for r in votes:
                found.setdefault(("parquet", header, normalize.elected(r)), []).append(unquote(r["file"]))
        else:
            found["parquet", header, Times()] = tables
    families = []
    for (kind, header, times), paths in sorted(found.items(), key=str):
        if "ts" in normalize.resolved(list(header)):
            families.append(Family(kind, header, times, sorted(paths)))
        else:
            skipped += [(p, f"no timestamp column among {', '.join(header[:15])}") for p in paths]
    return families, sorted(skipped)


def rows_of(spark: SparkSession, family: Family) -> DataFrame:
    """The canonical columns and stage of every line of the family's files, with file, capture and status: flow, bad line (more
    fields than its header) or no time. Shorter lines lack their last values. Only the columns that flows need are kept, but lines are parsed
    whole: a parser that prunes columns doesn't see that a line has too many."""
    names = [f"_{i}" for i in range(len(family.header))]
    if family.kind == "parquet":
        raw, kinds = spark.read.option("mergeSchema", True).parquet(*[literal(p) for p in family.paths]), None
        raw = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(family.header, names, strict=True)], F.lit(None).cast("string").alias(BAD), F.col("_metadata.file_path").alias("file"))
        kinds = dict(raw.dtypes)
    else:
        schema = ", ".join(f"{n} string" for n in [*names, BAD])
        raw = spark.read.schema(schema).option("columnPruning", False).csv([literal(p) for p in family.paths], header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, escape='"').select(*names, BAD, F.col("_metadata.file_path").alias("file"))
        kinds = dict.fromkeys(names, "string")
    columns = {c: (F.col(names[i]), factor) for c, (i, factor) in normalize.resolved(list(family.header)).items()}
    ts = normalize.at(normalize.time_text(columns["ts"][0], kinds[names[normalize.resolved(list(family.header))["ts"][0]]]), family.times)
    fields = F.size(F.split(F.regexp_replace(BAD, r'"[^"]*"', ""), ","))
    status = F.when(F.col(BAD).isNotNull() & (fields > len(names)), "bad line").when(ts.isNull(), "no time").otherwise("flow")
    return raw.select(*normalize.projected(columns, ts), "file", capture_of(F.col("file")).alias("capture"), status.alias("status"))


def rows(spark: SparkSession, path: str | list[str], endings: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All lines below path (see rows_of), and file, capture, reason of skipped files."""
    families, skipped = surveyed(spark, path, endings)
    out = None
    for family in families:
        part = rows_of(spark, family)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], ", ".join([*[f"{c} {'string' if c in ('src_ip', 'dst_ip', 'label') else 'int' if c in ('src_port', 'dst_port', 'proto') else 'double'}" for c in normalize.COLUMNS], "stage int, file string, capture string, status string"]))
    lost = spark.createDataFrame(skipped, "file string, reason string").withColumn("capture", capture_of(F.col("file")))
    return out, lost


def scan(spark: SparkSession, path: str | list[str], endings: list[str] | None = None) -> DataFrame:
    """The flows below path with stage, file and capture, whatever layouts the files have."""
    return rows(spark, path, endings)[0].where("status = 'flow'").drop("status")


def stored(rows_: DataFrame, path: str) -> dict[str, int]:
    """Writes all lines by capture and counts them on the way: lines, flows, bad lines, lines without a time."""
    seen = Observation("lines")
    of = lambda s: F.count_if(F.col("status") == s)
    rows_.observe(seen, F.count(F.lit(1)).alias("lines"), of("flow").alias("flows"), of("bad line").alias("bad_lines"), of("no time").alias("no_time")).write.mode("overwrite").partitionBy("capture").parquet(path)
    return dict(seen.get)


def accounting(rows_: DataFrame, skipped: DataFrame, seconds: int, gap: int, prefixes: list[str]) -> DataFrame:
    """For each capture: files, skipped_files, lines, flows, flows_kept (of monitored hosts), bad_lines, no_time, hosts, windows (with filled ones), segments."""
    kept = (F.col("status") == "flow") & monitored(F.col("src_ip"), prefixes)
    by_file = rows_.groupBy("capture", "file").agg(F.count("*").alias("lines"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("flow", "flows"), ("bad line", "bad_lines"), ("no time", "no_time"))], F.count_if(kept).alias("flows_kept"))
    total = by_file.groupBy("capture").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("lines", "flows", "flows_kept", "bad_lines", "no_time")])
    segs = cells.segments(cells.build(rows_.where(kept), seconds), gap)
    runs = segs.groupBy(*cells.SEGMENT).agg(F.count("*").alias("n"))
    made = runs.groupBy("capture").agg(F.count_distinct("src_ip").alias("hosts"), F.sum("n").alias("windows"), F.count("*").alias("segments"))
    lost = skipped.groupBy("capture").agg(F.count("*").alias("skipped_files"))
    return total.join(made, "capture", "full").join(lost, "capture", "full").na.fill(0)


def write_cells(cells: DataFrame, path: str, rebuild: bool = False) -> None:
    """One partition for each capture; captures that are there already are skipped, or replaced with rebuild."""
    spark = cells.sparkSession
    if not rebuild:
        try:
            there = spark.read.parquet(path).select(F.col("capture").cast("string").alias("capture")).distinct()
            cells = cells.join(F.broadcast(there), "capture", "left_anti")
        except Exception as e:  # nothing has been built yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    mode = "overwrite" if rebuild else "append"
    cells.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("capture").parquet(path)


def of_split(cells: DataFrame, split: str, column: str = "split_temporal") -> DataFrame:
    if column not in cells.columns:
        raise ValueError(f"no split column {column}")
    return cells.where(F.col(column) == split)


def union_captures(parts: dict[str, DataFrame]) -> DataFrame:
    """Cells or segments of several captures under one roof; a segment is named by its capture, host and run, so none needs a new number."""
    out = None
    for name, part in sorted(parts.items()):
        part = part if "capture" in part.columns else part.withColumn("capture", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_states(states: DataFrame, path: str) -> None:
    """The states of all captures, one partition for each."""
    states.write.mode("overwrite").partitionBy("capture").parquet(path)


def write_report(report: DataFrame, path: str, kind: str = "csv") -> None:
    w = report.write.mode("overwrite")
    w.csv(path, header=True) if kind == "csv" else w.json(path) if kind == "json" else w.parquet(path)
