"""Ranked lexical search: impact vectors in buckets of falling length, bounds that prune, exact scores of what survives.

A document's impact of a term is the term's weight times its damped frequency, all in whole numbers; an item's score is the sum of the
impacts of its terms. As vectors over the terms of the items: the score is the inner product with the item's vector of ones.

1. Items come in blocks of bounded size, whose terms are broadcast. One pass over the documents counts each document's terms, and
   sums N, L and df over all of them.
2. With these, impacts follow. Vectors are range-sorted by falling length and cut into buckets, each written as its terms' postings,
   with the longest length, the lengths and the ids of its documents.
3. A bucket is closed to an item when the item's length times the longest is below its threshold (Cauchy-Schwarz). Inside, the largest impact of
   each coordinate bounds what it can add: terms are taken from the largest bound on until the rest together can't reach the
   threshold, so a document that has none of them is out; one that has some is out when its partial sum and the least of the rest's coordinate bounds and
   its Cauchy-Schwarz bound are too little. What is left is scored in 64-bit integers.
4. Thresholds: every `pilot`-th bucket is searched first, and the k-th score that an item has there holds for all others; a task raises
   it further as it goes. A bound equal to the threshold never prunes, so ties are found.

Null and empty texts have no terms, count nowhere and are never found; items without terms find nothing. Repeated rows and null doc_ids
are documents like any other, null ids last among equal scores. Of rows that repeat an item_id (a null one too) the least text counts.
Columns besides doc_id, item_id and text are ignored. No documents or no items give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import as_bytes, of, ranked, record, slices, stash, summed, table

#: ASCII letters (lower-cased) and digits are of terms, as is all beyond ASCII; the rest separates.
SEPARATED = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
SLACK = 1 + 1e-9  # rounding never prunes
PARTS = 16  # of the sums, so that no group holds them whole


def terms(text: str | None) -> list[bytes]:
    return as_bytes(text).translate(SEPARATED).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> tuple[DataFrame, np.ndarray, int, int]:
    """doc_id, row, n, terms, tf of the documents that hold a numbered term (numbers from 1 on); df by number, N, L over all."""
    held, most = docs.sparkSession.sparkContext.broadcast(numbers), len(numbers) + 1

    def rows(batches):
        get, df, kind, docs_, words_ = held.value.get, np.zeros(most, np.int64), None, 0, 0
        for batch in slices(batches, 2000):
            kind, out = batch.column("doc_id").type, []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = terms(text)
                if words:
                    docs_, words_ = docs_ + 1, words_ + len(words)
                    if tf := Counter(filter(None, map(get, words))):
                        t = np.fromiter(tf.keys(), "<u4", len(tf))
                        df[t] += 1
                        out.append((i, len(words), t.tobytes(), np.fromiter(tf.values(), "<u4", len(tf)).tobytes()))
            if out:
                i, n, t, tf = zip(*out, strict=True)
                yield record(doc_id=batch.column("doc_id").take(pa.array(i)), n=pa.array(n, pa.int64()), terms=pa.array(t, pa.binary()), tf=pa.array(tf, pa.binary()), part=pa.nulls(len(i), pa.int32()), sums=pa.nulls(len(i), pa.binary()))
        if docs_:
            sums = np.array_split(np.concatenate([[docs_, words_], df]), PARTS)
            none = lambda t: pa.nulls(PARTS, t)
            yield record(doc_id=none(kind), n=none(pa.int64()), terms=none(pa.binary()), tf=none(pa.binary()), part=pa.array(range(PARTS), pa.int32()), sums=[x.astype("<i8").tobytes() for x in sums])

    schema = f"{of(docs, 'doc_id')}, n long, terms binary, tf binary, part int, sums binary"
    made = stash(docs.select("doc_id", "text").mapInArrow(rows, schema).withColumn("row", F.monotonically_increasing_id()), "search-terms")
    got = summed(made.where("part IS NOT NULL").select("part", "sums"), "part", "sums", "<i8", "<i8")
    flat = np.concatenate([got[p] for p in range(PARTS)]) if got else np.zeros(most + 2, np.int64)
    held.destroy()
    return made.where("part IS NULL").drop("part", "sums"), flat[2:], int(flat[0]), int(flat[1])


def buckets(found: DataFrame, weights: np.ndarray, n_docs: int, n_words: int, per_bucket: int, postings: int) -> DataFrame:
    """number, longest, docs, lengths, terms, at, impacts: the documents in buckets of falling length, each as postings sorted by term."""
    held = found.sparkSession.sparkContext.broadcast(weights)

    def vectors(batches):
        for batch in slices(batches, 2000):
            length, impacts = [], []
            for n, t, tf in zip(*(batch.column(c).to_pylist() for c in ("n", "terms", "tf")), strict=True):
                m = 100 - 90 + 90 * n * n_docs // n_words
                f = np.frombuffer(tf, "<u4").astype(np.int64)
                x = held.value[np.frombuffer(t, "<u4")] * (1_000_000_000 * f // (1000 * f + 8 * m))
                length.append(float(np.sqrt((x.astype(float) ** 2).sum())))
                impacts.append(x.astype("<i8").tobytes())
            yield record(doc_id=batch.column("doc_id"), row=batch.column("row"), length=pa.array(length, pa.float64()), terms=batch.column("terms"), impacts=pa.array(impacts, pa.binary()))

    def bucket(ids, length, t, x):
        size = np.array([len(v) // 4 for v in t])
        term, impact, doc = np.frombuffer(b"".join(t), "<u4"), np.frombuffer(b"".join(x), "<i8"), np.repeat(np.arange(len(t)), size)
        order = np.lexsort((doc, term))
        return record(longest=pa.array([length[0]], pa.float64()), docs=pa.array([ids], pa.list_(kind)), lengths=[np.array(length, "<f8").tobytes()], terms=[term[order].tobytes()], at=[doc[order].astype("<u4").tobytes()], impacts=[impact[order].tobytes()])

    def cut(batches):
        held_, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "length", "terms", "impacts")), strict=True):
                if held_ and (len(held_) >= per_bucket or size + len(row[2]) // 4 > postings):
                    yield bucket(*zip(*held_, strict=True))
                    held_, size = [], 0
                held_.append(row)
                size += len(row[2]) // 4
        if held_:
            yield bucket(*zip(*held_, strict=True))

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(found.schema["doc_id"].dataType)
    each = found.mapInArrow(vectors, f"{of(found, 'doc_id')}, row long, length double, terms binary, impacts binary")
    by_length = each.repartitionByRange(F.desc("length"), "row").sortWithinPartitions(F.desc("length"), "row")
    ids = of(found, "doc_id").split(" ", 1)[1]
    out = stash(by_length.mapInArrow(cut, f"longest double, docs array<{ids}>, lengths binary, terms binary, at binary, impacts binary").withColumn("number", F.monotonically_increasing_id()), "search-buckets")
    held.destroy()
    return out


class Bucket:
    """Postings by term of the documents in one bucket."""

    def __init__(self, docs: list, lengths: bytes, terms_: bytes, at: bytes, impacts: bytes):
        self.docs, self.lengths, self.at, self.impact = docs, np.frombuffer(lengths, "<f8"), np.frombuffer(at, "<u4").astype(np.int64), np.frombuffer(impacts, "<i8")
        term = np.frombuffer(terms_, "<u4")
        self.first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        self.known, self.last = term[self.first], np.append(self.first[1:], len(term))
        self.top = np.maximum.reduceat(self.impact, self.first) if len(term) else self.impact

    def postings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = [slice(a, b) for a, b in zip(self.first[which].tolist(), self.last[which].tolist(), strict=True)]
        return np.concatenate([self.at[s] for s in some]), np.concatenate([self.impact[s] for s in some])

    def search(self, asked: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of least or more, and above 0, for an item's terms (ascending)."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.searchsorted(self.known, asked)
        which = which[(which < len(self.known)) & (self.known[np.minimum(which, len(self.known) - 1)] == asked)]
        which = which[np.argsort(-self.top[which], kind="stable")]  # coordinates by what they can add
        rest = np.append(np.cumsum(self.top[which][::-1])[::-1], 0)
        if not len(which) or rest[0] < least or rest[0] <= 0:
            return none
        focus = max(1, int(np.searchsorted(-rest, -least, side="right")))  # the rest after these is below least
        at, x = self.postings(which[:focus])
        part = np.bincount(at, weights=x, minlength=len(self.docs))
        more = np.minimum(float(rest[min(focus, len(which))]), math.sqrt(len(which) - min(focus, len(which))) * self.lengths)
        alive = (part > 0) & ((part + more) * SLACK >= least)
        if not alive.any():
            return none
        at, x = self.postings(which)
        mine = alive[at]
        score = np.zeros(len(self.docs), np.int64)
        np.add.at(score, at[mine], x[mine])
        good = np.flatnonzero((score >= max(least, 1)) & alive)
        return good, score[good]


def searched(held: DataFrame, items: list[np.ndarray], least: np.ndarray, k: int, doc_type: str) -> DataFrame:
    """item (a number), doc_id, score: each task's k best for each item, of those with `least` or more."""
    given = held.sparkSession.sparkContext.broadcast((items, least))

    def run(batches):
        asked, floor = given.value
        length, floor, best, kind = np.sqrt([len(t) for t in asked]), floor.copy(), {}, None
        for batch in slices(batches, 1):
            kind = batch.schema.field("docs").type.value_type
            longest, *parts = (batch.column(c)[0].as_py() for c in ("longest", "docs", "lengths", "terms", "at", "impacts"))
            wanted = np.flatnonzero(length * longest * SLACK >= floor)
            bucket = Bucket(*parts) if len(wanted) else None
            for i in wanted.tolist():
                docs, score = bucket.search(asked[i], int(floor[i]))
                if len(docs) > k:
                    good = score >= np.partition(score, len(score) - k)[len(score) - k]
                    docs, score = docs[good], score[good]
                if len(docs):
                    rows = best.get(i, []) + [(-s, bucket.docs[d] is None, bucket.docs[d]) for d, s in zip(docs.tolist(), score.tolist(), strict=True)]
                    best[i] = sorted(rows, key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[:k]
                    if len(best[i]) == k:
                        floor[i] = max(floor[i], -best[i][-1][0])
        out = [(i, d, -s) for i, rows in best.items() for s, _, d in rows]
        if out:
            i, d, s = zip(*out, strict=True)
            yield record(item=pa.array(i, pa.int32()), doc_id=pa.array(d, kind), score=pa.array(s, pa.int64()))

    return held.mapInArrow(run, f"item int, doc_id {doc_type}, score long")


def search_block(docs: DataFrame, asked: list, k: int, pilot: int, per_bucket: int, postings: int) -> DataFrame | None:
    """item, doc_id, score: candidates for the k best of each of the items asked (lists of terms)."""
    numbers = {t: i for i, t in enumerate(sorted({t for words in asked for t in words}), 1)}
    if not numbers:
        return None
    found, df, n_docs, n_words = counted(docs, numbers)
    if not n_docs:
        return None
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    held = buckets(found, weights, n_docs, n_words, per_bucket, postings)
    items = [np.array(sorted({numbers[t] for t in words}), np.int64) for words in asked]
    doc_type = of(docs, "doc_id").split(" ", 1)[1]
    is_pilot = F.pmod(F.xxhash64("number"), F.lit(pilot)) == 0
    first = stash(searched(held.where(is_pilot), items, np.ones(len(items), np.int64), k, doc_type), "search-pilot")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    least = np.ones(len(items), np.int64)
    for r in first.withColumn("place", place).where(F.col("place") == k).select("item", "score").collect():  # a row for each item of the block
        least[r["item"]] = r["score"]
    return first.unionByName(stash(searched(held.where(~is_pilot), items, least, k, doc_type), "search-rest"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 4 << 20, pilot: int = 16, per_bucket: int = 1024, postings: int = 1 << 18) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each item. A block of items has block_bytes of text, or one item."""
    one = items.select("item_id", "text").groupBy("item_id").agg(F.min("text").alias("text"))
    placed = stash(ranked(one.select("item_id", "text", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("size")), ["item_id"], "search-items", "size")
                   .select("item_id", "text", F.expr(f"CAST(start div {block_bytes} AS INT)").alias("block")), "search-blocks")
    spark, out = docs.sparkSession, None
    last = placed.agg(F.max("block")).first()[0]
    for block in range(-1 if last is None else last, -1, -1):
        rows = placed.where(F.col("block") == block).select("item_id", "text").collect()  # of bounded size
        found = search_block(docs, [terms(r["text"]) for r in rows], k, pilot, per_bucket, postings)
        if found is not None:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, {of(items, 'item_id')}")
            found = found.join(F.broadcast(names), "item").select("item_id", F.lit(block).alias("block"), "item", "doc_id", "score")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"{of(items, 'item_id')}, rank int, {of(docs, 'doc_id')}, score long")
    best = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
tot AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM d), q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY term),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // l)))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN f USING (term), tot GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10"""

QUERIES, ORACLE = {"op12_norm_search": op12_norm_search}, {"op12_norm_search": SQL}
