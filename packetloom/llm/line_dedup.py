"""Line dedup: a sharded minimal perfect hash over the line keys that more than one document holds.

Line keys go to 128-bit hashes. Hashes that at least two documents hold are dealt to shards; each shard
builds a minimal perfect hash (a cascade of bit arrays) over its 64 high bits (mixed with the low ones under another seed where
two keys agree in them), and compact arrays in
the order that it gives: the 64 low bits as fingerprint, the count of documents and the first of them.
Documents probe the arrays, and a line goes where its count is `min_docs` or more, so neither the lines nor the texts are
shuffled. Arrays up to `broadcast_bytes` are broadcast; beyond, probes travel to the shards, to so many copies of each
that a copy gets about `probes` lines.

Null and empty texts are one empty line. A document is its doc_id: repeated rows of one doc_id do not
make a line repeated. A null doc_id counts as the largest id. Columns besides doc_id and text are ignored
by `dedup_lines` (it replaces columns of the names that it adds) and kept by `clean`. No documents give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import as_bytes, fresh, record, slices, stash, table

BLANK = b" \t\n\x0b\x0c\r"
NONE_ID = (1 << 63) - 1  # stands for a null doc_id
U = np.uint64


def line_keys(data: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it is too short to count."""
    out = []
    for line in data.split(b"\n"):
        key = line.strip(BLANK)
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(key.lower() if long else None)
    return out


def key_hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & (1 << 64) - 1


def seeded(high: np.ndarray, low: np.ndarray, seed: int) -> np.ndarray:
    """What a shard hashes: the high bits, or with a seed a mixture of both."""
    return high if not seed else high ^ _mix(low, seed)


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ (U(level + 1) * U(0x9E3779B97F4A7C15))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class PerfectHash:
    """Keys (distinct uint64) to 0..n-1. A level keeps the keys alone in their slot; the others go on to the next."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.sums, before = levels, [], 0
        for bits in levels:
            counts = np.cumsum(bits, dtype=np.int64)
            self.sums.append((before, counts))
            before += int(counts[-1])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(1, int(gamma * len(keys)))
            slot = (_mix(keys, len(levels)) % U(size)).astype(np.int64)
            bits = np.bincount(slot, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[slot]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 where no level has it. A key that isn't in the set may get any index."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            slot = (_mix(keys[open_], level) % U(len(bits))).astype(np.int64)
            hit = bits[slot]
            before, counts = self.sums[level]
            out[open_[hit]] = before + counts[slot[hit]] - 1
            open_ = open_[~hit]
        return out


class Shard:
    def __init__(self, row):
        sizes = np.frombuffer(row["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sizes.sum()].astype(bool)
        self.hash = PerfectHash(np.split(bits, np.cumsum(sizes)[:-1])) if len(sizes) else PerfectHash([])
        self.seed = row["seed"]
        self.print_ = np.frombuffer(row["prints"], np.uint64)
        self.first = np.frombuffer(row["firsts"], np.int64)
        self.count = np.frombuffer(row["counts"], np.uint32)

    def first_holder(self, high: np.ndarray, low: np.ndarray, min_docs: int) -> np.ndarray:
        """The first document that holds each line, -1 for a line that fewer than min_docs hold."""
        at = self.hash.find(seeded(high, low, self.seed))
        ok = at >= 0
        ok[ok] = (self.print_[at[ok]] == low[ok]) & (self.count[at[ok]] >= min_docs)
        return np.where(ok, self.first[np.maximum(at, 0)], -1)


SHARD = "shard int, n long, seed long, sizes binary, bits binary, prints binary, firsts binary, counts binary"


def build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    high, low = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low"))
    seed = 0
    while len(np.unique(seeded(high, low, seed))) < len(high):
        seed += 1
    keys = seeded(high, low, seed)
    perfect = PerfectHash.build(keys)
    place = perfect.find(keys)
    put = lambda x: (lambda out: (out.__setitem__(place, x), out)[1])(np.empty_like(x))
    bits = np.concatenate(perfect.levels) if perfect.levels else np.zeros(0, bool)
    count = np.minimum(rows["count"].to_numpy(np.int64), (1 << 32) - 1).astype(np.uint32)
    return pd.DataFrame([{
        "shard": int(rows["shard"].iloc[0]), "n": len(high), "seed": seed, "sizes": np.array([len(x) for x in perfect.levels], np.int64).tobytes(),
        "bits": np.packbits(bits).tobytes(), "prints": put(low).tobytes(), "firsts": put(rows["first"].to_numpy(np.int64)).tobytes(), "counts": put(count).tobytes(),
    }])


def _id(docs: DataFrame):
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NONE_ID))


def repeated_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """high, low, first, count: the hashes of keys that at least two documents hold."""

    def keys(batches):
        for batch in slices(batches, 2000):
            found = [np.array(list({key_hash(k) for k in line_keys(as_bytes(t), min_chars) if k is not None}), U).reshape(-1, 2).view(np.int64) for t in batch.column("text").to_pylist()]
            lists = [pa.array([x[:, i] for x in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield record(id=batch.column("id"), high=lists[0], low=lists[1])

    lines = docs.select(_id(docs).alias("id"), "text").mapInArrow(keys, "id long, high array<long>, low array<long>")
    each = lines.select("id", F.explode(F.arrays_zip("high", "low")).alias("k")).select("id", "k.high", "k.low")
    held = each.groupBy("high", "low").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows"))
    some = stash(held.where("first < last").select("high", "low", "first", "rows"), "line-keys")
    # rows count as documents unless a doc_id has several rows
    twice = docs.groupBy(_id(docs).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    if not twice.take(1):
        return some.withColumnRenamed("rows", "count")
    counts = each.join(some.select("high", "low"), ["high", "low"], "left_semi").groupBy("high", "low").agg(F.count_distinct("id").alias("count"))
    return stash(some.drop("rows").join(counts, ["high", "low"]), "line-keys")


def line_index(docs: DataFrame, min_chars: int = 10, keys_per_shard: int = 100_000) -> tuple[DataFrame, int]:
    """One row of SHARD for each shard that has repeated lines, and the number of shards."""
    held = repeated_lines(docs, min_chars)
    shards = max(1, -(-held.count() // keys_per_shard))
    return stash(held.withColumn("shard", F.pmod("high", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build_shard, SHARD), "line-index"), shards


def _apply(text: str | None, doc_id: int, first: np.ndarray) -> tuple[int, int, bytes]:
    """first: the first holder of each line's key, -1 for a line that isn't repeated."""
    lines = as_bytes(text).split(b"\n")
    drop = (first >= 0) & (first != doc_id)
    kept = [x for x, d in zip(lines, drop.tolist(), strict=True) if not d] if drop.any() else lines
    return len(lines), int(drop.sum()), b"\n".join(kept)


ADDED = ("_lines", "_dropped", "_kept")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, broadcast_bytes: int = 64 << 20, probes: int = 1_000_000, keys_per_shard: int = 100_000) -> DataFrame:
    """docs with _lines, _dropped (counts) and _kept (the text without its repeated lines), row by row."""
    return _deduped(docs.drop(*ADDED), ADDED, min_chars, min_docs, broadcast_bytes, probes, keys_per_shard)


def _deduped(docs: DataFrame, names: tuple, min_chars: int = 10, min_docs: int = 2, broadcast_bytes: int = 64 << 20, probes: int = 1_000_000, keys_per_shard: int = 100_000) -> DataFrame:
    spark = docs.sparkSession
    index, shards = line_index(docs.select("doc_id", "text"), min_chars, keys_per_shard)
    size = index.agg(F.sum(F.length("prints") + F.length("firsts") + F.length("counts") + F.length("bits"))).first()[0] or 0
    if size > broadcast_bytes:
        return _dedup_by_shard(docs, names, index, shards, min_chars, min_docs, probes)
    arrays = spark.sparkContext.broadcast([r.asDict() for r in index.collect()])
    key = fresh("id", docs)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.StringType())])

    def probe(batches):
        held = {r["shard"]: Shard(r) for r in arrays.value}
        for batch in slices(batches, 2000):
            rows = []
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in (key, "text")), strict=True):
                keys = line_keys(as_bytes(text), min_chars)
                first = np.full(len(keys), -1, np.int64)
                if at := [i for i, k in enumerate(keys) if k is not None]:
                    high, low = np.array([key_hash(keys[i]) for i in at], U).T
                    shard, at = np.mod(high.view(np.int64), shards), np.array(at)
                    for s in set(shard.tolist()) & held.keys():
                        pick = shard == s
                        first[at[pick]] = held[s].first_holder(high[pick], low[pick], min_docs)
                rows.append(_apply(text, doc_id, first))
            lines, dropped, kept = zip(*rows, strict=True)
            same = {c: batch.column(c) for c in batch.schema.names if c != key}
            yield record(**same, **dict(zip(names, (pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array([x.decode("utf-8", "surrogatepass") for x in kept], pa.string())), strict=True)))

    return docs.withColumn(key, _id(docs)).mapInArrow(probe, schema)


def _dedup_by_shard(docs: DataFrame, names: tuple, index: DataFrame, shards: int, min_chars: int, min_docs: int, probes: int) -> DataFrame:
    """The same beyond the broadcast bound: line hashes travel to copies of their shard, only drops come back."""
    row, gone, every = (fresh(c, docs) for c in ("row", "gone", "every"))
    docs = stash(docs.withColumn(row, F.monotonically_increasing_id()), "line-docs")

    def hashed(batches):
        for batch in slices(batches, 2000):
            rows = [(r, d, i, *np.array(key_hash(k), U).view(np.int64).tolist()) for r, d, t in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "text")), strict=True) for i, k in enumerate(line_keys(as_bytes(t), min_chars)) if k is not None]
            row, doc, line, high, low = zip(*rows, strict=True) if rows else [()] * 5
            yield record(row=pa.array(row, pa.int64()), id=pa.array(doc, pa.int64()), line=pa.array(line, pa.int32()), high=pa.array(high, pa.int64()), low=pa.array(low, pa.int64()))

    def probe(lines: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if lines.empty or held.empty:
            return pd.DataFrame({"row": [], "line": []}, dtype="int64")
        first = Shard(held.iloc[0]).first_holder(*(lines[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low")), min_docs)
        return lines.loc[(first >= 0) & (first != lines["id"].to_numpy()), ["row", "line"]]

    lines = docs.select(F.col(row).alias("row"), _id(docs).alias("id"), "text").mapInArrow(hashed, "row long, id long, line int, high long, low long")
    lines = stash(lines.withColumn("shard", F.pmod("high", F.lit(shards)).cast("int")), "line-probes")
    # a row for each shard, of some 100,000 keys
    copies = lines.groupBy("shard").agg(F.ceil(F.count("*") / probes).cast("int").alias("copies")).join(index.select("shard"), "shard")
    lines = lines.join(F.broadcast(copies), "shard").withColumn("copy", F.pmod(F.xxhash64("row", "line"), F.col("copies")).cast("int")).drop("copies")
    held = index.join(F.broadcast(copies), "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    drops = lines.groupBy("shard", "copy").cogroup(held.groupBy("shard", "copy")).applyInPandas(probe, "row long, line int")
    none = F.array().cast("array<int>")
    out = docs.join(drops.groupBy(F.col("row").alias(row)).agg(F.collect_list("line").alias(gone)), row, "left")
    out = out.withColumn(gone, F.coalesce(gone, none)).withColumn(every, F.split(F.coalesce("text", F.lit("")), "\n", -1))
    kept = F.filter(every, lambda x, i: ~F.array_contains(gone, i))
    return out.select(*docs.drop(row).columns, F.size(every).cast("long").alias(names[0]), F.size(gone).cast("long").alias(names[1]), F.array_join(kept, "\n").alias(names[2]))


def clean(docs: DataFrame, **options) -> DataFrame:
    """docs with their texts cleaned (never null) and n_chars anew; other columns stay, whatever their names."""
    names = tuple(fresh(c, docs) for c in ADDED)
    out = _deduped(docs, names, **options).withColumn("text", F.col(names[2]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
k AS (SELECT r, doc_id, line, i, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
d AS (SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS drop FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT drop), '')) AS kept_sha256
FROM d GROUP BY r
"""
QUERIES, ORACLE = {"op9_line_dedup": op9_line_dedup}, {"op9_line_dedup": SQL}
