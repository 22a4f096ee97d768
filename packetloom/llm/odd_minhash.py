"""MinHash near-duplicates: bands propose, odd sketches of the samples decide whom to compare, full sets confirm.

Two texts link when 100 * |A & B| >= 85 * |A | B| over their sets of distinct 5-word shingles. Equal sets are one class
throughout (by 64 bits of a hash, see jaccard_join); what follows joins classes.

1. A set's sample is the least value of each of 128 hash functions over its shingles. Folded into an odd sketch, each of its (function, value)
   pairs flips one of 512 bits: the exclusive or of two sketches is the sketch of the pairs that differ, and its population count estimates
   the similarity 1 + ln(1 - 2 * count / 512), most precisely where it is high.
2. Samples fall into 32 bands of 4 values. Classes that share a band make a region; regions with the same members are one.
   A pair of similarity 0.85 shares none with a chance of 6e-11.
3. In a region every pair of sketches is compared in memory and none is sent on: what comes out is a forest that connects the pairs whose
   sizes allow a link and whose count isn't above the bound that a pair of similarity 0.85 exceeds with a chance of 1e-12. Regions with more than
   `most` members count as connected whole.
4. Components of these forests are the groups that may link. Each member's full set goes to its group once, where
   jaccard_join joins exactly; groups beyond its bounds are cut by its Spark joins first.

So links are exact, and one is lost with a chance of less than 1e-10. A text with fewer than 5 words has its whole word sequence as its only
shingle; null, empty and wordless texts have none and are linked with nothing. Repeated rows are copies. A null doc_id has a
null component only where no document of its component has an id. Columns besides doc_id and text are ignored. No documents give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard_join import BATCH_ROWS, U, components, joined, mixed, name, sets_of, shingles, sized, split
from .util import of, record, slices, stash, table, word_hashes

LEAST = 85
SAMPLES, BANDS, BITS = 128, 32, 512
_RNG = np.random.default_rng(11)
FLIP, TIMES = (_RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)[:, None] for _ in range(2))
TIMES = TIMES << U(1) | U(1)


def sample(s: np.ndarray, step: int = 2048) -> np.ndarray:
    """The upper 32 bits of the least value of each hash function over the shingles s."""
    out = np.full(SAMPLES, ~U(0))
    for at in range(0, len(s), step):
        np.minimum(out, ((s[None, at : at + step] ^ FLIP) * TIMES).min(1), out=out)
    return out >> U(32)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit name for each band with its values."""
    rows, out = values.reshape(BANDS, -1), np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in rows.T:
        out = mixed(out ^ column) + column
    return mixed(out).view(np.int64)


def odd_sketch(values: np.ndarray) -> bytes:
    """The parity of the number of (function, value) pairs in each of BITS places."""
    place = mixed(values << U(8) | np.arange(SAMPLES, dtype=np.uint64)) & U(BITS - 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=BITS) & 1).tobytes()


def estimate(count):
    """The similarity that a population count speaks for."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(count) / BITS, 1e-9))


def most_odd(similarity: float, chance: float = 1e-12) -> int:
    """The count that sketches of sets of this similarity or more exceed with less than this chance."""
    odd, total = np.zeros(BITS + 1), np.zeros(BITS + 1)
    odd[0], k = 1.0, np.arange(BITS + 1)
    for d in range(SAMPLES + 1):
        total += math.comb(SAMPLES, d) * (1 - similarity) ** d * similarity ** (SAMPLES - d) * odd
        for _ in range(2):  # a place that differs flips two bits
            odd = np.append(0, (odd * (1 - k / BITS))[:-1]) + np.append((odd * k / BITS)[1:], 0)
    beyond = np.cumsum(total[::-1])[::-1]
    return int(np.flatnonzero(beyond >= chance).max())


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, fp (hash of the text), n, cid (null without shingles) of each row; keys and odd for a class's first row in a task."""

    def rows(batches):
        memo, seen = word_hashes(), set()
        for batch in slices(batches, 2000):
            n, cid, keys, odd = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, memo)
                c = name(s) if len(s) else None
                new = c is not None and c not in seen
                if new:
                    seen.add(c)
                    values = sample(s)
                n.append(len(s))
                cid.append(c)
                keys.append(band_keys(values) if new else None)
                odd.append(odd_sketch(values) if new else None)
            yield record(doc_id=batch.column("doc_id"), fp=batch.column("fp"), n=pa.array(n, pa.int64()), cid=pa.array(cid, pa.int64()), keys=pa.array(keys, pa.list_(pa.int64())), odd=pa.array(odd, pa.binary()))

    schema = f"{of(docs, 'doc_id')}, fp long, n long, cid long, keys array<long>, odd binary"
    return stash(docs.select("doc_id", "text", F.xxhash64("text").alias("fp")).mapInArrow(rows, schema), "minhash-profiles", BATCH_ROWS)


def regions(classes: DataFrame) -> DataFrame:
    """region, cid, k: classes that share a band with others, and how many they are."""
    cells = classes.select(F.explode("keys").alias("cell"), "cid")
    size = cells.groupBy("cell").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("cid")).alias("x")).where("k > 1")
    return stash(cells.join(size, "cell").select(F.xxhash64("x", "k").alias("region"), "cid", "k").distinct(), "minhash-regions")


def forest(n: np.ndarray, odd: np.ndarray, bound: int, least: int) -> list[tuple[int, int]]:
    """Pairs of members that connect all whose sketches are near and whose sizes allow a link."""
    near, step = np.zeros((len(n), len(n)), bool), max(1, 1_000_000 // len(n))
    for at in range(0, len(n), step):
        part = slice(at, at + step)
        count = np.bitwise_count(odd[part, None, :] ^ odd[None]).sum(-1, dtype=np.int64)
        near[part] = (count <= bound) & (100 * np.minimum(n[part, None], n[None]) >= least * np.maximum(n[part, None], n[None]))
    np.fill_diagonal(near, False)
    out, todo = [], near.any(1)
    while todo.any():
        edge = [int(todo.argmax())]
        todo[edge[0]] = False
        while edge:
            i = edge.pop()
            new = np.flatnonzero(near[i] & todo)
            todo[new] = False
            out += [(i, j) for j in new.tolist()]
            edge += new.tolist()
    return out


def near_pairs(rows: DataFrame, classes: DataFrame, bound: int, least: int) -> DataFrame:
    """a, b: the forests of the regions of rows (region, cid)."""

    def pairs(region, cid, n, odd):
        cuts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
        first, size = cuts[:-1], np.diff(cuts)
        two = first[size == 2]  # most regions: all at once
        a, b = two, two + 1
        close = np.bitwise_count(odd[a] ^ odd[b]).sum(-1, dtype=np.int64) <= bound
        close &= 100 * np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b])
        out = [np.stack([cid[a[close]], cid[b[close]]])]
        for at, k in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if found := forest(n[at : at + k], odd[at : at + k], bound, least):
                out.append(cid[at + np.array(found).T])
        return np.concatenate(out, 1)

    def run(batches):
        held = None
        for batch in batches:
            region, cid, n = (batch.column(c).to_numpy() for c in ("region", "cid", "n"))
            now = [region, cid, n, np.frombuffer(b"".join(batch.column("odd").to_pylist()), "<u8").reshape(len(region), -1)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(held[0]):
                open_ = int(np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]]))[-1])  # the last region may go on
                a, b = pairs(*(x[:open_] for x in held)) if open_ else ([], [])
                held = [x[open_:] for x in held]
                yield record(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))
        if held is not None and len(held[0]):
            a, b = pairs(*held)
            yield record(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    by_region = rows.join(classes.select("cid", "n", "odd"), "cid").repartition("region").sortWithinPartitions("region", "cid")
    return by_region.mapInArrow(run, "a long, b long")


def found_classes(docs: DataFrame, least: int = LEAST, most: int = 512, block: int = 8, weight: int = 8_000_000) -> tuple[DataFrame, DataFrame]:
    """The profile of each row, and cid, root (the smallest doc_id of its component) of each class."""
    rows = profiles(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.first("n").alias("n"), F.first("keys", True).alias("keys"), F.first("odd", True).alias("odd"), F.min(order).alias("first"))
    classes = stash(classes, "minhash-classes")
    banded = regions(classes)
    pairs = near_pairs(banded.where(F.col("k") <= most).select("region", "cid"), classes, most_odd(least / 100), least)
    whole = banded.where(F.col("k") > most)
    leader = whole.groupBy("region").agg(F.min("cid").alias("a"))
    pairs = pairs.unionByName(whole.join(leader, "region").select("a", F.col("cid").alias("b")))
    group = components(pairs).select(F.col("node").alias("cid"), F.col("comp").alias("region"))
    known = lambda c: F.lit(None).cast("long").alias(c)
    members = group.join(classes.select("cid", "n"), "cid").select("region", "cid", "n", F.lit(0).alias("pos"), known("comp"))
    small, large = sized(stash(members, "minhash-groups"), most, weight)
    large, links = stash(large, "minhash-large"), None
    if large.take(1):
        links, pieces = split(large, docs, rows, most, weight, least)
        small = small.unionByName(pieces)
    small = stash(small.select("region", "cid", "comp"), "minhash-small")
    found = joined(small, sets_of(docs, small.select("cid").distinct(), rows), block, least)
    comp = components(found if links is None else found.unionByName(links))
    ids = classes.select("cid", F.col("first.doc_id").alias("first")).join(comp.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    roots = ids.groupBy("comp").agg(F.min("first").alias("root"))
    return rows, stash(ids.join(roots, "comp").select("cid", "comp", "root"), "minhash-roots")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (it is the component's own id) for each row of docs."""
    rows, by_class = found_classes(docs.select("doc_id", "text"), **options)
    out = rows.join(by_class, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_odd_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES, ORACLE = {"op11_odd_minhash": op11_odd_minhash}, {}
