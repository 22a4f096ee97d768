"""Approximate nearest neighbours: vantage-point trees per shard.

On unit vectors the chord length is a metric that orders by cosine. A vantage-point tree splits its vectors at the median
distance from a vantage point, again and again; a query skips a side when its distance to the border exceeds `factor`
times its worst kept distance. Factor one is the triangle inequality and exact; smaller factors prune more.

1. A tree over a sample (at most `sample` vectors by a hash of their ids) cuts the space into at most `most_regions` regions, each
   about `per_shard` vectors while these suffice. Every vector goes to its region; a region with more falls into shards by hash.
2. Queries visit their own region first. The distance of their k-th there decides which other regions the tree leaves open,
   and only these are visited, with that distance as a bound from the start.
3. Each shard builds its own tree, which a block of queries walks together. A second walk with the k-th cosine found as
   its radius gathers all that tie with it. Each shard gives each query its k nearest with exact double-precision
   cosines, and the best k of all shards remain, ties to the smaller id.

Null or zero vectors and those with null or non-finite components take no part, neither as queries nor
as candidates; vectors of another length than a query's are no candidates for it. Vectors of lengths that the sample lacks
are a region of their own. Rows with a null id are left out; repeated rows of an id count once (the first by value).
Of equal vectors only the k + 1 smallest ids can be among the k nearest of a query, so large groups of copies cost no more
than those. Columns besides vec_id and embedding are ignored. No vectors give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import stash, table

LEAF = 64
SLACK = 1e-7  # rounding of distances never prunes a true neighbour
TIE = 1e-12  # cosines nearer than this may tie once computed exactly


class Tree:
    """Over distinct unit vectors. A node: (vantage row, median distance, near side, far side) or the number of a leaf."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.x, self.rng, self.leaves = x, np.random.default_rng(seed), []
        self.root = self._build(np.arange(len(x)), leaf)

    def _build(self, rows: np.ndarray, leaf: int):
        if len(rows) > leaf:
            vantage = rows[self.rng.integers(len(rows))]
            d = chord(self.x[rows] @ self.x[vantage])
            middle = np.median(d)
            near = d <= middle
            if near.any() and not near.all():
                return vantage, middle, self._build(rows[near], leaf), self._build(rows[~near], leaf)
        self.leaves.append(rows)
        return len(self.leaves) - 1

    def search(self, q: np.ndarray, k: int, factor: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest found for each query (-1 where fewer have more than its least cosine), in no order."""
        best, where = np.repeat(least[:, None].astype(float), k, axis=1), np.full((len(q), k), -1)
        self._walk(self.root, np.arange(len(q)), q, best, where, factor)
        return where, best

    def open_leaves(self, q: np.ndarray, reach: np.ndarray):
        """(leaf, queries) of the leaves that a query has within its reach."""
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, active = todo.pop()
            if not len(active):
                continue
            if not isinstance(node, tuple):
                yield node, active
                continue
            vantage, middle, near, far = node
            border = chord(q[active] @ self.x[vantage]) - middle
            todo += [(near, active[border <= reach[active]]), (far, active[-border <= reach[active]])]

    def homes(self, q: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out, todo = np.zeros(len(q), int), [(self.root, np.arange(len(q)))]
        while todo:
            node, active = todo.pop()
            if not isinstance(node, tuple):
                out[active] = node
                continue
            vantage, middle, near, far = node
            inside = chord(q[active] @ self.x[vantage]) <= middle
            todo += [(near, active[inside]), (far, active[~inside])]
        return out

    def within(self, q: np.ndarray, least: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) of cosine least or more (of each query), ordered by query."""
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for leaf, active in self.open_leaves(q, factor * chord(least) + SLACK):
            i, j = np.nonzero(q[active] @ self.x[self.leaves[leaf]].T >= least[active, None])
            found.append((active[i], self.leaves[leaf][j]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((j, i))
        return i[order], j[order]

    def _walk(self, node, active, q, best, where, factor) -> None:
        if not len(active):
            return
        if not isinstance(node, tuple):
            rows = self.leaves[node]
            c = q[active] @ self.x[rows].T
            both = np.concatenate([best[active], c], 1)
            rows = np.concatenate([where[active], np.broadcast_to(rows, c.shape)], 1)
            k = best.shape[1]
            top = np.argpartition(-both, k - 1, axis=1)[:, :k] if both.shape[1] > k else np.broadcast_to(np.arange(k), (len(both), k))
            best[active], where[active] = np.take_along_axis(both, top, 1), np.take_along_axis(rows, top, 1)
            return
        vantage, middle, near, far = node
        border = chord(q[active] @ self.x[vantage]) - middle
        inside = border <= 0
        for first, second, here in ((near, far, inside), (far, near, ~inside)):  # the side of the query comes first
            mine, gap = active[here], np.abs(border[here])
            self._walk(first, mine, q, best, where, factor)
            reach = chord(best[mine].min(1))
            self._walk(second, mine[gap <= factor * reach + SLACK], q, best, where, factor)


def chord(cosine):
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same bits wherever the rows stand."""
    dot = lambda x, y: np.multiply(x, y).sum(axis=-1)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def shard_search(held: pd.DataFrame, asked: pd.DataFrame, k: int, factor: float) -> pd.DataFrame:
    """query_id, vec_id, score: each query's k nearest in this shard, itself left out, of those whose cosine isn't below its `least`."""
    out = []
    for width in sorted(set(asked["embedding"].map(len)) & set(held["embedding"].map(len))):
        h, a = held[held["embedding"].map(len) == width].sort_values("vec_id"), asked[asked["embedding"].map(len) == width]
        x, ids = np.stack(h["embedding"].to_numpy()).astype(float), h["vec_id"].to_numpy()
        q, qid = np.stack(a["embedding"].to_numpy()).astype(float), a["vec_id"].to_numpy()
        distinct, inverse = np.unique(x, axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")  # ids ascend within a group of equal vectors
        ends = np.searchsorted(inverse.ravel()[order], np.arange(len(distinct) + 1))
        tree = Tree(distinct / np.linalg.norm(distinct, axis=1, keepdims=True))
        # one more than k distinct vectors, as the query's own may be one; k + 1 ids of each
        u = q / np.linalg.norm(q, axis=1, keepdims=True)
        _, best = tree.search(u, min(k + 1, len(distinct)), factor, a["least"].to_numpy())
        asked_by, row = tree.within(u, best.min(1) - TIE, factor)
        cuts = np.searchsorted(asked_by, np.arange(len(q) + 1))
        for i in range(len(q)):
            near = row[cuts[i] : cuts[i + 1]]
            score = cosines(distinct[near], q[i])
            if len(near) > k + 1:  # ids only of those that can be among the best
                best_k = score >= np.partition(score, len(near) - k - 1)[len(near) - k - 1]
                near, score = near[best_k], score[best_k]
            picks = [(-s, v) for s, r in zip(score.tolist(), near.tolist(), strict=True) for v in ids[order[ends[r] : min(ends[r + 1], ends[r] + k + 1)]].tolist() if v != qid[i]]
            out += [(int(qid[i]), v, -s) for s, v in sorted(picks)[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


class Regions:
    """A tree over a sample of vectors for each of their lengths; leaves are numbered on from `start`."""

    def __init__(self, sample: list[list[float]], most: int):
        self.trees, n = {}, 0
        for width in sorted({len(v) for v in sample}):
            x = np.unique([v for v in sample if len(v) == width], axis=0).astype(float)
            tree = Tree(np.unique(unit(x), axis=0), max(1, -(-len(sample) // most)))
            self.trees[width] = (n, tree)
            n += len(tree.leaves)
        self.count = n

    def homes(self, vectors: pd.Series) -> np.ndarray:
        out, widths = np.full(len(vectors), -1), vectors.map(len).to_numpy()
        for width, (start, tree) in self.trees.items():
            if (mine := widths == width).any():
                out[mine] = start + tree.homes(unit(np.stack(vectors[mine].to_numpy())))
        return out

    def others(self, vectors: pd.Series, home: np.ndarray, least: np.ndarray, factor: float) -> list[list[int]]:
        """For each query the regions besides its own that may hold a cosine of its least or more."""
        out, widths = [[] for _ in range(len(vectors))], vectors.map(len).to_numpy()
        for width, (start, tree) in self.trees.items():
            at = np.flatnonzero(widths == width)
            if len(at):
                q = unit(np.stack(vectors.iloc[at].to_numpy()))
                for leaf, active in tree.open_leaves(q, factor * chord(least[at]) + SLACK):
                    for i in at[active].tolist():
                        if start + leaf != home[i]:
                            out[i].append(start + leaf)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def visit(held: DataFrame, asked: DataFrame, k: int, factor: float, per_shard: int, per_block: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest that each query finds in each shard of the regions it asks."""
    parts = held.groupBy("region").agg(F.ceil(F.count("*") / per_shard).alias("shards")).join(asked.groupBy("region").agg(F.ceil(F.count("*") / per_block).alias("blocks")), "region")
    parts = F.broadcast(parts)  # a row for each region
    number = lambda c, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(c))
    copies = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    held = held.join(parts, "region").select("region", "vec_id", "embedding", number("shards", 1).alias("shard"), copies("blocks").alias("block"))
    asked = asked.join(parts, "region").select("region", "vec_id", "embedding", "least", number("blocks", 2).alias("block"), copies("shards").alias("shard"))
    key = ["region", "shard", "block"]
    return held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(lambda h, a: shard_search(h, a, k, factor), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query, k: int = 5, factor: float = 1.0, per_shard: int = 8192, per_block: int = 4096, sample: int = 4096, most_regions: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id; all rows are candidates."""
    rows = stash(usable(vectors), "vectors")
    first = Window.partitionBy("embedding").orderBy("vec_id")
    held = rows.withColumn("_copy", F.row_number().over(first)).where(F.col("_copy") <= k + 1).drop("_copy")
    some = [r[0] for r in rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).select("embedding").collect()]
    regions = Regions(some, min(most_regions, max(1, -(-rows.count() // per_shard))))

    def place(batches):
        for pdf in batches:
            yield pdf.assign(region=regions.homes(pdf["embedding"]))

    schema = "vec_id long, embedding array<double>, region int"
    held = stash(held.mapInPandas(place, schema), "vectors-placed")
    asked = stash(rows.where(is_query).mapInPandas(place, schema), "vectors-asked")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    found = visit(held, asked.withColumn("least", F.lit(-2.0)), k, factor, per_shard, per_block)
    if regions.count <= 1:
        return top(found)
    own = stash(top(found), "vectors-own")

    def route(batches):
        for pdf in batches:
            yield pdf.assign(to=regions.others(pdf["embedding"], pdf["region"].to_numpy(), pdf["least"].to_numpy(), factor))

    bound = own.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score") - TIE).alias("least"))
    rest = asked.join(bound, "vec_id", "left").select("vec_id", "embedding", "region", F.coalesce("least", F.lit(-2.0)).alias("least"))
    routed = rest.mapInPandas(route, "vec_id long, embedding array<double>, region int, least double, to array<int>")
    routed = stash(routed.select("vec_id", "embedding", "least", F.explode("to").alias("region")), "vectors-routed")
    return top(own.drop("rank").unionByName(visit(held, routed, k, factor, per_shard, per_block)))


def op8_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES, ORACLE = {"op8_vp_search": op8_vp_search}, {}
