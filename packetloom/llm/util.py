"""What the operators share: tables, shared scratch space, Arrow batches, word hashing and a global order."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP, BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
_HELD: dict[str, str] = {}
_KEPT: dict[str, dict] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remove(spark: SparkSession, base: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone; its folder is the cluster's to clear
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir). A session's paths lie in one folder, which goes with the driver."""
    app = spark.sparkContext.applicationId
    if app not in _HELD:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp(prefix='packetloom-')}"
        _HELD[app] = f"{base}/packetloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _HELD[app])
    return f"{_HELD[app]}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Writes df to shared storage and reads it again: cuts the lineage and survives lost executors. The write's shuffle files go once it has ended.
    batch: rows that go to Python at a time, fewer where rows are texts."""
    spark = df.sparkSession
    path, confs = scratch(spark, name), {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def of(df: DataFrame, *columns: str) -> str:
    """The columns' part of a schema string: their types as they are."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def record(**columns) -> pa.RecordBatch:
    """A batch of Arrow arrays or lists; ids pass through as they came, nulls and all 64 bits included."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], list(columns))


def slices(batches, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), most):
            yield batch.slice(at, most)


def groups(batches, key: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and held[-1].column(key)[-1] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def summed(parts: DataFrame, key: str, values: str, kind: str, wide: str, last: str | None = None) -> dict[int, np.ndarray]:
    """Sums (of numpy type wide) of arrays (binary, of type kind) by key, in two levels so that no group holds all parts. Only the sums come to the driver,
    as type `last` (whole numbers, no more than it holds) if that is given."""

    def adder(given, out=None):
        def add(k, pdf):
            import pandas as pd

            total = np.frombuffer(pdf[values].iloc[0], given).astype(wide)
            for x in pdf[values].iloc[1:]:
                total += np.frombuffer(x, given)
            total = np.minimum(total, np.iinfo(out).max).astype(out) if out else total
            return pd.DataFrame({key: [k[0]], values: [total.tobytes()]})

        return add

    schema = f"{key} int, {values} binary"
    some = parts.groupBy(key, F.floor(F.spark_partition_id() / F.lit(256)).alias("_part")).applyInPandas(adder(kind), schema)
    return {r[key]: np.frombuffer(r[values], last or wide) for r in some.groupBy(key).applyInPandas(adder(wide, last), schema).collect()}


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Memo(dict):
    """f(key) by key, forgotten as a whole when it holds too many."""

    def __init__(self, f, most: int = 300_000):
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.f(key)
        return value


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps from one task to the next, for one owner at a time: another owner's goes, so that workers don't grow."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
    return _KEPT[owner]


def word_hashes() -> Memo:
    worker_cache("hashes")
    return Memo(xxhash.xxh64_intdigest)


def hashes(memo: Memo, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list, name: str, weight: str | None = None) -> DataFrame:
    """df with `rank`: the 0-based place of each row in the order; with weight, `start`: the sum of weights before it.

    Range partitions are sorted and written; only one total per partition goes to the driver. Ties
    must be broken by the order itself, else equal rows may come in either order.
    """
    spark = df.sparkSession
    placed = stash(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
                   .withColumn("_mid", F.monotonically_increasing_id()), name)
    part, row = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND((1 << 33) - 1)
    totals = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n"), (F.sum(weight) if weight else F.count("*")).alias("w"))
    before, n, w = {}, 0, 0
    for p, k, v in sorted(tuple(r) for r in totals.collect()):
        before[p] = (p, n, w)
        n, w = n + k, w + (v or 0)
    values = ", ".join(f"({p}L, {n}L, {w}L)" for p, n, w in before.values()) or "(-1L, 0L, 0L)"
    offsets = spark.sql(f"SELECT * FROM VALUES {values} AS t(_p, _n, _w)")
    out = placed.join(F.broadcast(offsets), part == F.col("_p"))
    if weight:  # a running sum in each sorted partition
        from pyspark.sql import Window

        out = out.withColumn("start", F.col("_w") + F.coalesce(F.sum(weight).over(
            Window.partitionBy("_p").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.withColumn("rank", F.col("_n") + row).drop("_p", "_n", "_w", "_mid")
