"""N-gram Jaccard join: exact near-duplicate classes in the metric space of Jaccard distance.

Two texts link when 100 * |A & B| >= 75 * |A | B| over their sets of distinct 5-word shingles, a Jaccard
distance of at most 0.25. Equal sets are one class throughout (64 bits of a hash of the set name it; unlike sets meet
in one name with a chance of n^2 / 2^65); what follows joins classes.

1. Texts without a common shingle lie at distance 1, where whole texts as pivots separate nothing. So the space is
   first covered by the regions of singleton pivots {s}: to {s} a text is nearer than 1 only if it holds s, all of its
   shingles tie as its nearest pivots, and a fixed order breaks the tie. Texts within 0.25 of a text of n shingles lack at most
   n - ceil(0.75 n) of them, so replicating it to its first n - ceil(0.75 n) + 1 pivots makes linked texts meet. The
   order is rarest first by a count sketch of fixed size over all documents, so that common passages rarely make regions.
   Regions with the same members are one.
2. Counts of a text's shingles in 256 hash buckets are a contraction: the weighted Jaccard distance of two such
   vectors is no more than that of the sets. Regions fall into the parts that the contraction connects at 0.25; members with nobody near leave.
   Sets first go to one region each, the largest of theirs. Regions that the links found there make one component need no join; the others follow.
3. Each region is joined by `join_region`: texts as pivots create Voronoi regions by exact distance, a text goes to every
   region where it is at most 0.5 (twice 0.25, by the triangle inequality) farther from the pivot than from its nearest, regions
   join recursively, and small ones compare their pairs. Texts known to be connected need no comparison.
4. Regions with more than `most` members or `weight` shingles are cut the same way first, by Spark joins (`split`): pivots' distances
   to all members, nearest pivots, boundary replicas, labels of what is connected. Where pivots don't separate (a cut keeps over
   0.7 of a region), the region falls into blocks by size, and blocks whose sizes allow a link meet in pairs.

A text with fewer than 5 words has its whole word sequence as its only shingle; null, empty and wordless texts
have none and are linked with nothing. Repeated rows are copies. A null doc_id has a null component only where no
document of its component has an id. Columns besides doc_id and text are ignored. No documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import Memo, as_bytes, fresh, groups, hashes, of, record, slices, stash, summed, table, word_hashes

U = np.uint64
WORDS, NUM, DEN = 5, 3, 4
SKETCH_BITS, CHUNKS = 22, 16
BUCKETS, PIVOTS = 256, 4
BATCH_ROWS = 2000  # texts that go to Python at a time
MULTIPLIER = U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def shingles(text: str | None, memo: Memo) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes."""
    words = as_bytes(text).lower().split()
    if not words:
        return np.zeros(0, U)
    h = hashes(memo, words)
    with np.errstate(over="ignore"):
        if len(h) < WORDS:
            out = U(len(h))
            for x in h:
                out = out * MULTIPLIER + x
            return mixed(np.array([out ^ U(0xA5A5A5A5A5A5A5A5)], U))
        s = h[: len(h) - WORDS + 1].copy()
        for i in range(1, WORDS):
            s *= MULTIPLIER
            s += h[i : len(h) - WORDS + 1 + i]
    return np.unique(mixed(s))


def name(s: np.ndarray) -> int:
    """The class of a set: a signed 64-bit hash of its sorted shingles."""
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)), U).view(np.int64))


def profiles(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """doc_id, fp (hash of the text), n, cid (null without shingles), h (shingles by bucket) for each row, and the count sketch of shingles over all rows."""

    def rows(batches):
        memo, counts, kind = word_hashes(), np.zeros(1 << SKETCH_BITS, np.uint32), None
        for batch in slices(batches, 2000):
            kind = batch.column("doc_id").type
            sets = [shingles(t, memo) for t in batch.column("text").to_pylist()]
            every = np.concatenate(sets)
            np.add.at(counts, (every >> U(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            h = [np.bincount((s & U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype("<u4").tobytes() if len(s) else None for s in sets]
            cid = pa.array([name(s) if len(s) else None for s in sets], pa.int64())
            yield record(doc_id=batch.column("doc_id"), fp=batch.column("fp"), n=pa.array([len(s) for s in sets], pa.int64()), cid=cid, h=pa.array(h, pa.binary()), chunk=pa.nulls(len(sets), pa.int32()), counts=pa.nulls(len(sets), pa.binary()))
        if counts.any():
            none = lambda t: pa.nulls(CHUNKS, t)
            yield record(doc_id=none(kind), fp=none(pa.int64()), n=none(pa.int64()), cid=none(pa.int64()), h=none(pa.binary()), chunk=pa.array(range(CHUNKS), pa.int32()), counts=[np.minimum(x, 65535).astype("<u2").tobytes() for x in np.split(counts, CHUNKS)])

    schema = f"{of(docs, 'doc_id')}, fp long, n long, cid long, h binary, chunk int, counts binary"
    made = stash(docs.select("doc_id", "text", F.xxhash64("text").alias("fp")).mapInArrow(rows, schema), "jaccard-profiles", BATCH_ROWS)
    sketch = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.uint16)
    for chunk, counts in summed(made.where("chunk IS NOT NULL").select("chunk", "counts"), "chunk", "counts", "<u2", "<u4", "<u2").items():
        sketch[chunk] = counts
    return made.where("chunk IS NULL").select("doc_id", "fp", "n", "cid", "h"), sketch.ravel()


def prefix(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.75 n) + 1 shingles, rarest first, ties by hash."""
    n = len(s)
    order = np.argsort(sketch[(s >> U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    return s[order[: n - -(-NUM * n // DEN) + 1]]


def regions(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """region, cid, n, pos: the regions of singleton pivots that hold two classes at least, and the first pivot's place in the text's order.

    Of two texts that link, the smaller has 7 pos <= n at the first pivot they share (n - pos >= 3/7 (n + m), m >= n),
    and the larger 7 (m - at) >= 3 (n + m). Cells of one set of members are one region, with each member's least place.
    """
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def rows(batches):
        memo, seen = word_hashes(), set()
        for batch in slices(batches, 2000):
            cid, n, cells = [], [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t, memo)
                if len(s) and (c := name(s)) not in seen:
                    seen.add(c)
                    cid.append(c)
                    n.append(len(s))
                    cells.append(prefix(s, held.value).view(np.int64))
            yield record(cid=pa.array(cid, pa.int64()), n=pa.array(n, pa.int32()), cells=pa.array(cells, pa.list_(pa.int64())))

    each = docs.select("text").mapInArrow(rows, "cid long, n int, cells array<long>").select(F.posexplode("cells").alias("pos", "cell"), "cid", "n")
    cell = Window.partitionBy("cell")
    least = F.min(F.when(F.expr("7 * pos <= n"), F.col("n"))).over(cell)
    several = each.withColumn("_a", F.min("cid").over(cell)).withColumn("_b", F.max("cid").over(cell)).withColumn("_n", least)
    several = several.where("_a < _b AND (7 * pos <= n OR 3 * (n + _n) <= 7 * (n - pos))").select("cell", "cid", "n", "pos").distinct()
    several = several.withColumn("_k", F.count("*").over(cell)).withColumn("_x", F.bit_xor(F.xxhash64("cid")).over(cell)).where("_k > 1")
    out = stash(several.groupBy(F.xxhash64("_x", "_k").alias("region"), "cid").agg(F.min("n").alias("n"), F.min("pos").alias("pos")), "jaccard-regions", BATCH_ROWS)
    held.destroy()
    return out


def marked(rows: DataFrame, most_bits: int = 26) -> np.ndarray:
    """A bitmap of 2^most_bits bits at most, with the bit of each row (_id, _fp) set: 16 bits a row while these suffice."""
    bits = min(most_bits, max(15, (16 * rows.count()).bit_length()))
    place = F.pmod(F.xxhash64("_id", "_fp"), F.lit(1 << bits)) + 1  # bitmap functions count from 1
    out = np.zeros(1 << (bits - 3), np.uint8)
    chunks = rows.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("c")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("b"))
    for r in chunks.collect():  # 4 KB each
        out[(r["c"] - 1) << 12 : r["c"] << 12] = np.frombuffer(bytes(r["b"]), np.uint8)
    return out


def sets_of(docs: DataFrame, cids: DataFrame, profile: DataFrame) -> DataFrame:
    """cid, s: the shingles of the classes named, each from one of its documents (and of some other classes, by chance).

    A bitmap of bounded size tells which documents to shingle, so that only their sets move and no text does.
    """
    first = profile.join(cids, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("x"))
    first = stash(first.select(F.col("x.doc_id").alias("_id"), F.col("x.fp").alias("_fp")), "jaccard-active")
    held = docs.sparkSession.sparkContext.broadcast(marked(first))
    size = 8 * len(held.value)

    def rows(batches):
        memo, seen, wanted = word_hashes(), set(), held.value
        for batch in slices(batches, 2000):
            at = batch.column("at").to_numpy()
            hit = np.flatnonzero(wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            made = [(name(s), s.view(np.int64)) for t in batch.column("text").take(pa.array(hit)).to_pylist() if len(s := shingles(t, memo))]
            made = [(c, s) for c, s in made if c not in seen and not seen.add(c)]
            yield record(cid=pa.array([c for c, _ in made], pa.int64()), s=pa.array([s for _, s in made], pa.list_(pa.int64())))

    texts = docs.select("text", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(size)).alias("at"))
    out = stash(texts.mapInArrow(rows, "cid long, s array<long>").groupBy("cid").agg(F.first("s").alias("s")), "jaccard-sets", BATCH_ROWS)
    held.destroy()
    return out


def far_apart(i, t, least: int = 75):
    """Whether an overlap of i (at most) in sets of t shingles together is too little for a similarity of least percent."""
    return 100 * i < least * (t - i)


def parts(n: np.ndarray, pos: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """The members in parts that the contraction and the reach of their places keep apart; members with nobody near are left out."""
    near, left, step = np.zeros((len(n), len(n)), bool), n - pos, max(1, 4_000_000 // (len(n) * BUCKETS))
    for at in range(0, len(n), step):
        part = slice(at, at + step)
        most, t = np.minimum(h[part, None, :], h[None]).sum(-1, dtype=np.int64), n[part, None] + n[None]
        near[part] = ~far_apart(most, t) & (3 * t <= 7 * np.minimum(left[part, None], left[None]))
    np.fill_diagonal(near, False)
    out, todo = [], near.any(1)
    while todo.any():
        part = edge = np.arange(len(n)) == todo.argmax()
        while edge.any():
            edge = near[edge].any(0) & ~part
            part = part | edge
        out.append(np.flatnonzero(part))
        todo &= ~part
    return out


def promising(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """region, cid, comp: the parts of the regions. A part's members and what is known of them name it, so that parts which several regions have are one."""
    h = profile.select("cid", "h").join(rows.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"])

    def pick(batches):
        for g in groups(batches, "region"):
            h = np.frombuffer(b"".join(g["h"].to_pylist()), "<u4").reshape(-1, BUCKETS)
            found = parts(g["n"].to_numpy().astype(np.int64), g["pos"].to_numpy().astype(np.int64), h)
            if found:
                cid, comp = g["cid"].to_numpy(), g["comp"].to_pylist()
                names = [xxhash.xxh3_64_intdigest(cid[part].tobytes() + repr([comp[i] for i in part]).encode()) for part in found]
                every = np.concatenate(found)
                yield record(region=np.repeat(np.array(names, U).view(np.int64), [len(part) for part in found]), cid=cid[every], comp=pa.array([comp[i] for i in every], pa.int64()))

    by_region = rows.join(h, "cid").repartition("region").sortWithinPartitions("region", "cid")
    return stash(by_region.mapInArrow(pick, "region long, cid long, comp long").distinct(), "jaccard-promising")


def join_region(ids: list, sets: list[np.ndarray], comp: list, block: int, least: int = 75) -> list[tuple]:
    """Links (a, b) enough to connect what is connected in the region; members of one comp (not None) are connected already."""
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    ends, by_shingle = np.concatenate([[0], np.cumsum(np.bincount(number))]), owner[order]
    ends_of, up, out = np.concatenate([[0], np.cumsum(n)]), list(range(len(sets))), []

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def shared(i):  # with every member
        mine = number[ends_of[i] : ends_of[i + 1]]
        first, size = ends[mine], ends[mine + 1] - ends[mine]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(by_shingle[at], minlength=len(sets))

    def link(i, members, overlap):
        for j in members[~far_apart(overlap[members], n[members] + n[i], least)].tolist():
            a, b = root(i), root(j)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))

    seen: dict = {}
    for i, c in enumerate(comp):
        if c is not None:
            up[root(i)] = root(seen.setdefault(c, i))
    todo = [np.arange(len(sets))]
    while todo:
        members = todo.pop()
        roots = np.array([root(i) for i in members.tolist()])
        if (roots == roots[:1]).all():
            continue
        if len(members) <= block:
            for k, i in enumerate(members[:-1].tolist()):
                link(i, members[k + 1 :], shared(i))
            continue
        # pivots of different components, spread over the region
        pivots = members[np.unique(roots, return_index=True)[1]]
        pivots = pivots[np.linspace(0, len(pivots) - 1, min(PIVOTS, len(pivots))).astype(int)]
        overlap = np.stack([shared(i) for i in pivots.tolist()])
        for i, x in zip(pivots.tolist(), overlap, strict=True):
            link(i, members, x)
        rest = members[~np.isin(members, pivots)]
        d = 1 - overlap[:, rest] / (n[pivots][:, None] + n[rest] - overlap[:, rest])
        nearest = d.argmin(0)
        for k in range(len(pivots)):
            home = nearest == k
            if not home.any():
                continue
            inside = (d[k] <= d.min(0) + 0.5 + 1e-9) & (d[k] <= d[k][home].max() + 0.25 + 1e-9) & (d[k] >= d[k][home].min() - 0.25 - 1e-9)
            if inside.sum() <= 0.7 * len(members):
                todo.append(rest[inside])
            else:  # the pivot doesn't separate
                for i in rest[home].tolist():
                    link(i, rest[inside], shared(i))
    return out


def joined(rows: DataFrame, sets: DataFrame, block: int, least: int = 75) -> DataFrame:
    """a, b: links within the regions of rows (region, cid, comp)."""

    def links_(batches):
        for g in groups(batches, "region"):
            s = g["s"].combine_chunks()
            values, ends = s.values.to_numpy().view(U), s.offsets.to_numpy()
            found = join_region(g["cid"].to_pylist(), [values[a:b] for a, b in zip(ends, ends[1:], strict=False)], g["comp"].to_pylist(), block, least)
            yield record(a=pa.array([a for a, _ in found], pa.int64()), b=pa.array([b for _, b in found], pa.int64()))

    by_region = rows.join(sets, "cid").repartition("region").sortWithinPartitions("region", "cid")
    return stash(by_region.mapInArrow(links_, "a long, b long"), "jaccard-links")


def homes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each class in the largest of its regions alone; and all rows, with `home` where that is."""
    size = rows.groupBy("region").agg(F.count("*").alias("k"))
    home = rows.join(size, "region").groupBy("cid").agg(F.max(F.struct("k", "region")).alias("x"))
    all_ = stash(rows.join(home, "cid").withColumn("home", F.col("region") == F.col("x.region")).drop("x"), "jaccard-homes")
    at_home = all_.where("home").select("region", "cid", "comp")
    several = at_home.groupBy("region").agg(F.count("*").alias("k")).where("k > 1")
    return at_home.join(several.select("region"), "region", "left_semi"), all_


def undecided(rows: DataFrame, known: DataFrame) -> DataFrame:
    """region, cid, comp of the regions that neither lie in one known component (node, comp) nor were joined whole as homes."""
    rows = rows.join(known.select(F.col("node").alias("cid"), F.col("comp").alias("_c")), "cid", "left")
    rows = rows.select("region", "cid", F.coalesce("_c", "comp").alias("comp"), "home")
    label = F.coalesce("comp", "cid")
    left = rows.groupBy("region").agg(F.min(label).alias("_a"), F.max(label).alias("_b"), F.min("home").alias("_all")).where("_a < _b AND NOT _all")
    return stash(rows.join(left.select("region"), "region", "left_semi").select("region", "cid", "comp"), "jaccard-undecided")


def sized(rows: DataFrame, most: int, weight: int) -> tuple[DataFrame, DataFrame]:
    """The rows of regions within the bounds, and those of the others, with `k`; regions of one component go."""
    label = F.coalesce("comp", "cid")
    size = rows.groupBy("region").agg(F.count("*").alias("k"), F.sum("n").alias("_w"), F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a < _b")
    both = rows.join(size.select("region", "k", "_w"), "region")
    small = (F.col("k") <= most) & (F.col("_w") <= weight)
    return both.where(small).drop("k", "_w"), both.where(~small).drop("_w")


def split(large: DataFrame, docs: DataFrame, profile: DataFrame, most: int, weight: int, least: int = 75) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and regions within the bounds, which together decide all pairs of the large regions."""
    sets = sets_of(docs, large.select("cid").distinct(), profile)
    found = pieces = None
    add = lambda x, y: y if x is None else x.unionByName(y)
    linked = lambda i, t: ~far_apart(i, t, least)
    while large.take(1):
        order = F.struct(F.col("comp").isNotNull().alias("known"), F.xxhash64("cid", "region").alias("h"), "cid")
        chosen = large.groupBy("region", F.pmod(F.xxhash64("region", "cid"), F.lit(PIVOTS)).alias("slot")).agg(F.min(order).alias("x")).select("region", F.col("x.cid").alias("cid"))
        pivots = chosen.join(sets, "cid").groupBy("region").agg(F.array_sort(F.collect_list(F.struct("cid", "s"))).alias("p"))
        # of pivots that link, the least names them all
        name_of = lambda x: F.array_min(F.transform(F.filter("p", lambda y: linked(F.size(F.array_intersect(x["s"], y["s"])).cast("long"), (F.size(x["s"]) + F.size(y["s"])).cast("long"))), lambda y: y["cid"]))
        pivots = stash(pivots.withColumn("p", F.transform("p", lambda x: F.struct(x["cid"].alias("cid"), x["s"].alias("s"), name_of(x).alias("name")))), "jaccard-pivots")

        def seen(x):
            i, t = F.size(F.array_intersect("s", x["s"])).cast("long"), (F.size("s") + F.size(x["s"])).cast("long")
            return F.struct((1 - i / (t - i)).alias("d"), x["cid"].alias("cid"), x["name"].alias("name"), linked(i, t).alias("linked"))

        near = large.join(sets, "cid").join(pivots, "region").select("region", "cid", "n", "pos", "comp", "k", F.array_sort(F.transform("p", seen)).alias("x"))
        near = stash(near, "jaccard-distances")
        found = add(found, near.select(F.col("cid").alias("a"), F.explode(F.filter("x", lambda y: y["linked"])).alias("y")).select("a", F.col("y.cid").alias("b")).where("a <> b"))
        label = F.coalesce("comp", F.array_min(F.transform(F.filter("x", lambda y: y["linked"]), lambda y: y["name"])))
        rest = near.where(~F.exists("x", lambda y: y["cid"] == F.col("cid"))).withColumn("comp", label)
        inside = F.filter("x", lambda y: y["d"] <= F.col("x")[0]["d"] + 0.5 + 1e-9)
        rest = rest.select(F.col("region").alias("up"), "cid", "n", "pos", "comp", F.col("k").alias("of"), F.explode(inside).alias("y"))
        small, big = sized(rest.select(F.xxhash64("up", "y.cid").alias("region"), "cid", "n", "pos", "comp", "of"), most, weight)
        pieces = add(pieces, small.drop("of"))
        stuck = F.col("k") > 0.7 * F.col("of")
        big = stash(big, "jaccard-large")
        pieces = add(pieces, blocks(big.where(stuck), most, weight))
        large = big.where(~stuck).drop("of")
    return found, pieces


def blocks(rows: DataFrame, most: int, weight: int) -> DataFrame:
    """Regions cut into blocks of sizes within a factor of 4/3; two blocks of the same or neighbouring sizes make a region, unless one component holds both."""
    rows = rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3)))).withColumn("_c", F.coalesce("comp", F.lit(0)))
    key = ["region", "band", "_c"]
    parts = rows.groupBy(*key).agg(F.greatest(F.ceil(F.count("*") / (most / 2)), F.ceil(F.sum("n") / (weight / 2))).alias("_parts"))
    rows = rows.join(parts, key).withColumn("block", F.struct("band", "_c", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("_parts")).alias("i")))
    each = rows.select("region", "block").distinct()
    meet = each.join(each.withColumnRenamed("block", "other"), "region").where("block <= other AND abs(block.band - other.band) <= 1 AND (block._c <> other._c OR block._c = 0)")
    meet = meet.select("region", F.xxhash64("region", "block", "other").alias("to"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    return rows.join(meet, ["region", "block"]).select(F.col("to").alias("region"), "cid", "n", "pos", "comp")


def components(links: DataFrame) -> DataFrame:
    """node, comp: a node of each component that links (a, b) make. Each node takes the name of its least neighbour and links follow;
    names are hashes, so that a fair share of the nodes that are left goes in each round."""
    edges = stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    ups = []
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up")), "hooks")
        ups.append(up)
        new = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"{c}2"))  # noqa: B023, E731
        edges = stash(edges.join(new("a"), "a").join(new("b"), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a < b").distinct(), "links")
    if not ups:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out = ups[0].withColumnRenamed("up", "comp")
    for up in ups[1:]:
        out = out.join(up.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return stash(out, "components")


def links(docs: DataFrame, profile: DataFrame, sketch: np.ndarray, block: int = 8, most: int = 2048, weight: int = 8_000_000) -> DataFrame:
    """a, b: linked pairs of classes, enough of them to connect each component."""
    rows = regions(docs, sketch).withColumn("comp", F.lit(None).cast("long"))
    small, large = sized(rows, most, weight)
    large = stash(large, "jaccard-large")
    found = None
    if large.take(1):
        found, pieces = split(large, docs, profile, most, weight)
        small = small.unionByName(pieces)
    small = promising(small, profile)
    sets = sets_of(docs, small.select("cid").distinct(), profile)
    at_home, small = homes(small)
    first = joined(at_home, sets, block)
    found = first if found is None else first.unionByName(found)
    return found.unionByName(joined(undecided(small, components(found)), sets, block))


def found_classes(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The profile of each row, and cid, comp (a class of its component), root (its smallest doc_id) of each class."""
    profile, sketch = profiles(docs)
    comp = components(links(docs, profile, sketch, **options))
    ids = profile.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("first"))
    ids = ids.join(comp.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    roots = ids.groupBy("comp").agg(F.min("first").alias("root"))
    return profile, stash(ids.join(roots, "comp").select("cid", "comp", "root"), "jaccard-classes")


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    profile, by_class = found_classes(docs.select("doc_id", "text"), **options)
    out = profile.join(by_class, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest doc_id (null ids come last), then the
    smallest hash of its text; of rows equal in both any one. Rows without shingles (null, empty, wordless) all stay."""
    profile, by_class = found_classes(docs.select("doc_id", "text"), **options)
    rows = profile.join(by_class, "cid").groupBy("comp", "doc_id", "fp").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    least = rows.groupBy("comp").agg(F.min(order).alias("least"))
    told = stash(rows.join(least, "comp").select("doc_id", "fp", "rows", (order == F.col("least")).alias("kept")), "jaccard-told")
    same = lambda t: docs["doc_id"].eqNullSafe(t["doc_id"]) & (F.xxhash64(docs["text"]) == t["fp"])
    gone = told.where("NOT kept OR rows > 1")
    again, fp = told.where("kept AND rows > 1"), fresh("fp", docs)
    once = docs.join(again, same(again), "left_semi").withColumn(fp, F.xxhash64("text")).dropDuplicates(["doc_id", fp]).drop(fp)
    return docs.join(gone, same(gone), "left_anti").unionByName(once)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES, ORACLE = {"op5_jaccard_join": op5_jaccard_join}, {}
