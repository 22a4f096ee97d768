"""Sharding: balanced label propagation over documents with equal texts. DataFrame operations only.

Every document starts in the shard of its hash. Linked documents (equal texts) see their neighbours' shards through the
counts of their group: in each round a group wishes to go whole to the shard that holds most of it, and later to one with
room. A shard takes newcomers in order of size, then of a hash, as long as its quota holds: sums per (shard, size class,
hash bin), at most shards * `bins` * 64 numbers, tell the driver where to stop. Documents without neighbours are the ballast: they fill what is left, so
that counts differ by one at most (law `rows`). A group larger than a shard, or one that no shard has room for
after all rounds, is cut along the shards with most room, before the ballast. State is one row per (group, shard),
never per pair of documents.

Null texts count as no bytes and are linked with other null and empty texts. Null doc_ids and repeated rows are
documents of their own. Columns besides doc_id and text are ignored. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import ranked, stash, table


def _at(values: list, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def placed_groups(state: DataFrame, room: list[int], rounds: int, bins: int = 16) -> tuple[DataFrame | None, list[int]]:
    """g, shard of the groups that get a place whole, and the room left. state: g, shard, n."""
    room, placed = list(room), None
    for k in range(rounds):
        size = F.sum("n").alias("size")
        wish = state.groupBy("g").agg(F.max_by("shard", F.struct("n", F.xxhash64("g", "shard"))).alias("to"), size)
        if k:  # where its members are there was no room: shards with room, drawn in proportion to it
            total = sum(room)
            if not total:
                break
            ends = [sum(room[: s + 1]) for s in range(len(room))]
            u = F.pmod(F.xxhash64("g", F.lit(k)), F.lit(total))
            wish = wish.withColumn("to", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= u)))
        # the largest first; of one size class, by hash
        wish = wish.withColumn("bin", (F.lit(63) - F.floor(F.log2("size"))).cast("int") * bins + F.pmod(F.xxhash64("g", F.lit(-1 - k)), F.lit(bins)).cast("int"))
        wish = stash(wish, "shard-wishes")
        left, ok = list(room), [[] for _ in room]
        for s, b, n in sorted(tuple(r) for r in wish.groupBy("to", "bin").agg(F.sum("size")).collect()):
            if n <= left[s]:
                left[s] -= n
                ok[s].append(b)
        taken = F.array_contains(_at_lists(ok, F.col("to")), F.col("bin"))
        got = wish.where(taken).select("g", F.col("to").cast("int").alias("shard"))
        placed = got if placed is None else placed.unionByName(got)
        moved, room = left != room, left
        rest = wish.where(~taken)
        if not rest.take(1):
            break
        if moved or k == 0:
            state = rest.select("g", F.col("to").alias("shard"), F.col("size").alias("n"))
        else:
            bins *= 4  # classes too coarse to fit
    return placed, room


def _at_lists(lists: list[list[int]], i: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<int>") if x else none for x in lists]), (i + 1).cast("int"))


def shard(docs: DataFrame, shards: int = 40, rounds: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs."""
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                       F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("g")).withColumn("row", F.monotonically_increasing_id())
    rows = stash(rows.withColumn("home", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")), "shard-rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    members = stash(rows.groupBy("g").agg(F.count("*").alias("members")).where("members > 1"), "shard-groups")
    fits = members.where(F.col("members") <= max(1, min(quota)))
    start = rows.groupBy("g", F.col("home").alias("shard")).agg(F.count("*").alias("n")).join(fits.select("g"), "g", "left_semi")
    placed, room = placed_groups(stash(start, "shard-start"), quota, rounds)
    plan = members.select("g")
    plan = plan.withColumn("label", F.lit(None).cast("int")) if placed is None else plan.join(placed.withColumnRenamed("shard", "label"), "g", "left")
    # groups of over a 200th of all rows, 200 at most, are known by name: their rows meet copies of the plan
    hot = [r["g"] for r in members.where(F.col("members") > total / 200).select("g").collect()]
    salt = lambda key: F.when(F.col("g").isin(hot), key).otherwise(0) if hot else F.lit(0)
    copies = F.explode(F.when(F.col("g").isin(hot), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))) if hot else F.lit(0)
    joined = rows.withColumn("_s", salt(F.pmod("row", F.lit(64)).cast("int"))).join(plan.withColumn("linked", F.lit(True)).withColumn("_s", copies), ["g", "_s"], "left")
    # groups with a place, then those to be cut, then the ballast
    kind = F.when(F.col("label").isNotNull(), 0).when(F.col("linked"), 1).otherwise(2)
    tie = F.when(F.col("linked"), F.col("g")).otherwise("")
    side = ranked(joined.select("doc_id", "size", "text_crc32", kind.alias("kind"), F.coalesce("label", F.lit(-1)).alias("label"), tie.alias("tie"), "row"), ["kind", "label", "tie", "row"], "shard-order")
    held = [q - r for q, r in zip(quota, room, strict=True)]
    before = [sum(held[:s]) for s in range(shards)]
    order = sorted(range(shards), key=lambda s: (-room[s], s))
    ends = [sum(held) + sum(room[s] for s in order[: k + 1]) for k in range(shards)]
    k = F.least(F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("rank"))), F.lit(shards - 1))
    own = F.col("kind") == 0
    number = F.when(own, F.col("label")).otherwise(_at(order, k)).cast("int")
    first = F.when(own, _at(before, F.col("label"))).otherwise(_at([e - room[s] - held[s] for e, s in zip(ends, order, strict=True)], k))
    return side.select("doc_id", "size", "text_crc32", number.alias("shard"), (F.col("rank") - first).cast("long").alias("slot"))


def op7_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES, ORACLE = {"op7_balanced_sharding": op7_balanced_sharding}, {}
