"""Vector code compression: product codes by exact integer rounds over Hilbert-sorted blocks.

Components become whole numbers floor(4096 x), vectors are cut into `parts` equal parts, and each part position has a
codebook of its own. The codes that come out are those of plain rounds over every vector and entry; blocks only spare work:

1. Each part of each vector gets its place on a Hilbert curve over the part's components, and (part, place, row) range-sorts
   all of them. Runs of `block` neighbours are flat blocks: their values, the corners of the box around them, and their sum.
2. A round reads the blocks once. From the distances between an entry and the near and far side of a box follows which entries can be nearest
   to something in the box: those whose near side is no farther than the least far side, ties included. Where only one is left, the stored sum
   counts whole; else a small kernel computes exact distances to these entries alone, the lowest index winning ties.
3. A task sends one sum and count for each entry; the sums of all tasks move the entries: floor(sum / count). The driver holds codebooks, nothing else.

Values up to 2^25 are computed in 64 bits, larger ones with Python's whole numbers. Rows whose vector is null or holds null or non-finite
components are left out. Vectors of another length than that of the first vector (smallest vec_id, ties by value, null ids last), and all of them if that length can't be cut into
equal parts, get null code and error. With fewer vectors than entries codebooks are smaller. Repeated rows are vectors like any other, null ids too.
An error of over 64 bits is null. Columns besides vec_id, embedding and label are ignored. No vectors give no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .curve_packing import hilbert
from .util import groups, of, record, slices, stash, summed, table

SMALL = 1 << 25
MOST_DIMS, MOST_BITS = 20, 10


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit numbers where they are small, else as Python's."""
    y = np.floor(x * float(scale))
    if not y.size or np.abs(y).max() < SMALL:
        return y.astype(np.int64)
    # a double of 2^53 or more is a whole number
    return np.array([math.floor(v * scale) if abs(v) < 2.0**53 else int(v) * scale for v in x.ravel().tolist()], object).reshape(x.shape)


def packed(x: np.ndarray) -> bytes:
    """Small values as 16 or 32 bits, others as text; a first byte tells."""
    if x.dtype == object:
        return b"t" + ",".join(map(str, x.ravel().tolist())).encode()
    kind = "<i2" if not x.size or np.abs(x).max() < 1 << 15 else "<i4"
    return kind[2:].encode() + x.astype(kind).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    if data[:1] == b"t":
        return np.array([int(v) for v in data[1:].split(b",")], object).reshape(-1, width)
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).astype(np.int64).reshape(-1, width)


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entries that may be nearest to a point of the box, ascending."""
    out = np.maximum(np.maximum(low - entries, entries - high), 0)
    far = np.maximum(np.abs(entries - low), np.abs(high - entries))
    return np.flatnonzero((out * out).sum(-1) <= (far * far).sum(-1).min())


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the place of the nearest entry, the first of several, and the squared distance."""
    d = x[:, None, :] - entries[None]
    d = (d * d).sum(-1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles), row (a number of its own) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return stash(vectors.select("vec_id", label, v.alias("embedding")).where(v.isNotNull() & fine).withColumn("row", F.monotonically_increasing_id()), "codes-vectors")


def spread(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each component, for the curve alone."""

    def sums(batches):
        total = np.zeros((2, width))
        n = 0
        for batch in slices(batches, 4096):
            x = np.clip(matrix(batch.column("embedding"), width), -1e100, 1e100)
            total += x.sum(0), (x * x).sum(0)
            n += len(x)
        if n:
            yield record(part=pa.array([0], pa.int32()), x=[np.concatenate([total.ravel(), [float(n)]]).tobytes()])

    got = summed(rows.select("embedding").mapInArrow(sums, "part int, x binary"), "part", "x", "<f8", "<f8")[0]
    mean, square = got[:width] / got[-1], got[width : 2 * width] / got[-1]
    return mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-12


def matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def blocks(rows: DataFrame, parts: int, width: int, scale: int, block: int) -> DataFrame:
    """part, rows (64-bit, little-endian), x, low, high, total: flat blocks of neighbours on each part's curve."""
    w = width // parts
    mean, deviation = spread(rows, width)
    dims = np.argsort(-deviation.reshape(parts, w), axis=1, kind="stable")[:, :MOST_DIMS]  # the curve runs through the components that vary most
    bits = min(MOST_BITS, 62 // dims.shape[1])

    def cut(batches):
        for batch in slices(batches, 4096):
            x = matrix(batch.column("embedding"), width)
            place = np.clip((x - mean) / deviation / 5 + 0.5, 0, 1 - 1e-9) * (1 << bits)
            for part in range(parts):
                mine = slice(part * w, part * w + w)
                y = whole(x[:, mine], scale)
                key = hilbert(place[:, mine][:, dims[part]].astype(np.int64), bits)
                yield record(part=pa.array(np.full(len(x), part), pa.int32()), key=pa.array(key, pa.int64()), row=batch.column("row"), x=pa.array([packed(small(v)) for v in y], pa.binary()))

    def gather(batches):
        for g in groups(batches, "part"):
            for at in range(0, len(g), block):
                some = g.slice(at, block)
                x = [unpacked(v, w) for v in some["x"].to_pylist()]
                x = np.concatenate([v.astype(object) for v in x] if any(v.dtype == object for v in x) else x)
                yield record(part=pa.array([g["part"][0].as_py()], pa.int32()), rows=[some["row"].to_numpy().astype("<i8").tobytes()], x=[packed(x)], low=[packed(x.min(0))], high=[packed(x.max(0))], total=[",".join(map(str, x.sum(0).tolist()))])

    order = ["part", "key", "row"]
    # a part's rows in a partition come in batches; groups() holds one part's share of one partition
    sorted_ = rows.select("row", "embedding").mapInArrow(cut, "part int, key long, row long, x binary").repartitionByRange(*order).sortWithinPartitions(*order)
    return stash(sorted_.mapInArrow(gather, "part int, rows binary, x binary, low binary, high binary, total string"), "codes-blocks")


def assigned(batch: pa.RecordBatch, books: list[np.ndarray], w: int, distances: bool):
    """For each block: part, its entry alone or the entries of its rows, squared distances (if asked for), values and sum."""
    for part, x, low, high, total in zip(*(batch.column(c).to_pylist() for c in ("part", "x", "low", "high", "total")), strict=True):
        few = shortlist(unpacked(low, w), unpacked(high, w), books[part])
        if len(few) == 1 and not distances:
            yield part, int(few[0]), None, (len(x) - 1) // (2 * w) if x[:1] == b"2" else len(unpacked(x, w)), total
            continue
        values = unpacked(x, w)
        at, d = nearest(values, books[part][few])
        yield part, few[at], d, values, None


def moved(found: DataFrame, books: list[np.ndarray], w: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    held = found.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        n, total = [np.zeros(len(b), np.int64) for b in held.value], [np.zeros((len(b), w), object) for b in held.value]
        for batch in batches:
            for part, at, _, values, whole_sum in assigned(batch, held.value, w, False):
                if whole_sum is not None:
                    n[part][at] += values
                    total[part][at] += np.array([int(v) for v in whole_sum.split(",")], object)
                    continue
                for e in np.unique(at).tolist():
                    mine = values[at == e]
                    n[part][e] += len(mine)
                    total[part][e] += mine.sum(0).astype(object)
        out = [(p, e, int(n[p][e]), ",".join(map(str, total[p][e].tolist()))) for p in range(len(n)) for e in np.flatnonzero(n[p]).tolist()]
        if out:
            part, entry, count, total_ = zip(*out, strict=True)
            yield record(part=pa.array(part, pa.int32()), entry=pa.array(entry, pa.int32()), n=pa.array(count, pa.int64()), total=pa.array(total_, pa.string()))

    def add(key, pdf):  # a row for each task
        import pandas as pd

        total = np.sum([np.array([int(v) for v in t.split(",")], object) for t in pdf["total"]], axis=0)
        return pd.DataFrame({"part": [key[0]], "entry": [key[1]], "n": [int(pdf["n"].sum())], "total": [",".join(map(str, total.tolist()))]})

    schema = "part int, entry int, n long, total string"
    some = found.mapInArrow(sums, schema).groupBy("part", "entry").applyInPandas(add, schema).collect()
    held.destroy()
    out = [b.astype(object) for b in books]
    for r in some:
        out[r["part"]][r["entry"]] = [int(v) // r["n"] for v in r["total"].split(",")]
    return [small(b) for b in out]


def small(x: np.ndarray) -> np.ndarray:
    """x as 64-bit numbers, if all are small."""
    return x.astype(np.int64) if x.dtype == object and all(abs(v) < SMALL for v in x.ravel().tolist()) else x


def uncoded(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))


def encode(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, block: int = 64) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error for each vector that takes part, and the codebooks (entries x width of each part)."""
    if not (0 < parts <= 8 and 0 < entries <= 256):
        raise ValueError("parts in 1 to 8, entries in 1 to 256")
    rows = usable(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding", "row").limit(1).select("embedding").collect()
    width = len(first[0][0]) if first else 0
    if not width or width % parts:
        return uncoded(rows), []
    w, fits = width // parts, F.size("embedding") == width
    same = rows.where(fits)
    start = same.orderBy(F.col("vec_id").asc_nulls_last(), "embedding", "row").limit(entries).select("embedding").collect()
    start = whole(np.array([r[0] for r in start], float), scale)
    books = [start[:, p * w : p * w + w] for p in range(parts)]
    made = blocks(same, parts, width, scale, block)
    for _ in range(rounds):
        books = moved(made, books, w)
    held = same.sparkSession.sparkContext.broadcast(books)

    def codes(batches):
        for batch in batches:
            for data, (part, at, d, _, _) in zip(batch.column("rows").to_pylist(), assigned(batch, held.value, w, True), strict=True):
                d = [v if v < 1 << 63 else None for v in d.tolist()]
                yield record(row=pa.array(np.frombuffer(data, "<i8"), pa.int64()), part=pa.array(np.full(len(at), part), pa.int32()), entry=pa.array(at, pa.int64()), d=pa.array(d, pa.int64()))

    # the vector's own row and those of its parts meet in one aggregate
    each = made.mapInArrow(codes, "row long, part int, entry long, d long").select("row", F.expr(f"shiftleft(entry, 8 * ({parts - 1} - part))").alias("code"), "d", F.lit(None).cast(same.schema["vec_id"].dataType).alias("vec_id"), F.lit(None).cast(same.schema["label"].dataType).alias("label"))
    own = same.select("row", F.lit(None).cast("long").alias("code"), F.lit(None).cast("long").alias("d"), "vec_id", "label")
    digits = 2 * parts
    out = own.unionByName(each).groupBy("row").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.substring(F.lpad(F.lower(F.hex(F.sum("code"))), digits, "0"), 1, digits).alias("code"), F.when(F.count("d") == parts, F.expr("try_sum(d)")).alias("error")).drop("row")
    return out.unionByName(uncoded(rows.where(~fits))), books


def digest(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, code, error, label_error (errors of a label together; nulls are one), codebooks_sha256."""
    coded = stash(coded, "codes")
    totals = stash(coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error")), "codes-labels")  # its size is known: small ones are broadcast
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    out = coded.join(totals, coded["label"].eqNullSafe(totals["label"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(*encode(table(spark, sf_dir, "embeddings")))


def sql(parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 64) -> str:
    w = width // parts
    steps = [f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT vec_id, label, part, q[part * {w} + 1 : part * {w} + {w}]::DOUBLE[] AS x FROM v, range({parts}) AS r(part)),
b0 AS (SELECT part, e, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {entries})"""]
    near = "SELECT vec_id, label, p.part, x, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS d, e FROM p JOIN {b} USING (part)"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT vec_id, any_value(label) AS label, part, any_value(x) AS x, min(d) AS d, arg_min(e, (d, e)) AS e FROM ({near.format(b=f'b{i}')}) GROUP BY vec_id, part)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT part, e, list(s ORDER BY i) AS c FROM (SELECT part, e, i, floor(sum(x[i]) / count(*)) AS s FROM a{i}, range(1, {w + 1}) AS r(i) GROUP BY part, e, i) GROUP BY part, e)")
            steps.append(f"b{i + 1} AS (SELECT part, e, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (part, e))")
    steps.append(f"done AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    steps.append(f"sha AS (SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY part, e)) AS h FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM done, sha"


QUERIES, ORACLE = {"op13_vector_codes": op13_vector_codes}, {"op13_vector_codes": sql()}
