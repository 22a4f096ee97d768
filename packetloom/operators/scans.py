"""Scans over ordered keys of any size: the row before, decayed means, places, running sums and exact quantiles.

A window over a key holds all of its rows in one task, however hot the key is. Here a key falls into blocks of its order; windows run
within (key, block), and what a block hands on is one row. Blocks are either given (a number that grows with the order) or
the ranges that a range partitioning finds, which split any key at any density.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from packetloom.operators import batches
from packetloom.sources import shared


def literal(x: float | None) -> str:
    """x as SQL's text of the same double."""
    return "CAST(NULL AS DOUBLE)" if x is None else f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def lagged(df: DataFrame, keys: list[str], block: Column, order: list[str], columns: dict[str, str]) -> DataFrame:
    """df with, under each name, the column's value in the key's row before. Only the first row of each block looks beyond it, at the blocks' last rows."""
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    last = F.last(F.struct(*columns.values())).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    local = df.withColumn("_block", block).select("*", F.row_number().over(w).alias("_n"), last.alias("_last"), *[F.lag(c).over(w).alias(name) for name, c in columns.items()])
    up = Window.partitionBy(*keys).orderBy("_block")
    first = local.where("_n = 1").withColumns({name: F.lag(F.col("_last")[c]).over(up) for name, c in columns.items()})
    return first.unionByName(local.where("_n > 1")).drop("_block", "_n", "_last")


def decayed(df: DataFrame, keys: list[str], at: str, means: list[tuple[str, int, str]], before: bool = False, block: int = 256) -> DataFrame:
    """df with recursive means y0 = x0, y = (1 - a) y + a x, a = 2 / (span + 1), for each (column, span, name) and, with before, the mean of the row before under _name.

    at counts the rows of a key without gaps, from any number. Sums within blocks of `at`; a block's last row goes to the next one as well and carries its
    sum there. What lies further back weighs less than 1e-15.
    """
    rate = lambda span: -math.log(1 - 2 / (span + 1)) if span > 1 else 0.0
    sizes = {span: max(block, math.ceil(35 / rate(span))) if span > 1 else block for _, span, _ in means}
    size = max(sizes.values())
    if size * max(map(rate, sizes)) > 600:  # powers that no double holds: spans far apart take a pass each
        for span in sizes:
            df = decayed(df, keys, at, [m for m in means if m[1] == span], before, block)
        return df
    # expressions are text and what means share is a column: a call of the JVM for each operand of each mean takes longer than a small table's scan
    text = lambda c: f"`{c}`"
    key, spans = ", ".join(map(text, keys)), list(sizes)
    w, v = f"(PARTITION BY {key}, _block ORDER BY {text(at)})", f"(PARTITION BY {key}, _to)"
    kept = {span: 1 - 2 / (span + 1) for span in spans}
    live = [k for k, span in enumerate(spans) if kept[span] > 0]
    u = df.withColumn("_block", F.floor(F.col(at) / size)).withColumn("_j", F.pmod(F.col(at), F.lit(size)))
    powers = {f"_{x}{k}": F.expr(f"pow({kept[spans[k]]!r}D, {j})") for k in live for x, j in (("p", "_j"), ("n", "-_j"), ("q", "_j + 1"))}
    u = u.withColumns({"_late": F.expr(f"row_number() OVER {w} = 1 AND _j > 0"), **powers})  # _late: the first row of a block that isn't its first place is the key's first
    own, firsts = {}, dict.fromkeys(c for c, span, _ in means if kept[span] > 0)
    for i, (c, span, _) in enumerate(means):
        k = spans.index(span)
        x = f"{text(c)} * CASE WHEN _late THEN 1.0D ELSE {2 / (span + 1)!r}D END"
        own[f"_y{i}"] = F.expr(f"_p{k} * sum({x} * _n{k}) OVER {w}" if k in live else f"CAST({text(c)} AS DOUBLE)")
    own |= {f"_x{i}": F.expr(f"CAST(first({text(c)}) OVER {w} AS DOUBLE)") for i, c in enumerate(firsts)}
    u = u.withColumns({**own, "_j0": F.expr(f"first(_j) OVER {w}")})
    to = F.explode(F.when(F.col("_j") == size - 1, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block")))
    u = u.withColumn("_to", to)
    u = u.withColumn("_guest", F.col("_to") > F.col("_block")).withColumn("_follows", F.expr(f"max(_guest) OVER {v}")).withColumn("_starts", F.expr("NOT _follows AND _j0 = 0"))
    out = {}
    for i, (c, span, name) in enumerate(means):
        k = spans.index(span)
        if k in live:
            carried, start = f"max(CASE WHEN _guest THEN _y{i} END) OVER {v}", f"CASE WHEN _starts THEN {kept[span]!r}D * _x{list(firsts).index(c)} * _p{k} ELSE 0.0D END"
            out[name] = F.expr(f"CASE WHEN _guest THEN _y{i} ELSE _y{i} + _q{k} * coalesce({carried}, 0.0D) + {start} END")
        else:
            out[name] = F.col(f"_y{i}")
    u = u.withColumns(out)
    if before:
        order = Window.partitionBy(*keys, "_to").orderBy(at)
        u = u.withColumns({f"_{name}": F.lag(name).over(order) for _, _, name in means})
    spare = [*own, *powers, "_block", "_j", "_j0", "_to", "_guest", "_follows", "_late", "_starts"]
    return u.where(~F.col("_guest")).drop(*spare)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """df with the place of each row within its key, from 0, or the sum of weights before it. The order has to be unique within a key.

    Ranges of (key, order) are sorted and written with their rows' places; each (key, range) has one row of totals.
    """
    by = [*keys, *order]
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_rk_at", F.monotonically_increasing_id())
    placed = shared.kept(sorted_, "ranked").withColumn("_rk_range", F.shiftright("_rk_at", 33))
    own = [F.col(k) for k in keys]
    totals = placed.groupBy(*own, "_rk_range").agg(F.min("_rk_at").alias("_rk_first"), (F.sum(weight) if weight else F.count("*")).alias("_rk_w"))
    up = Window.partitionBy(*own).orderBy("_rk_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_rk_k{i}") for i, k in enumerate(keys)], F.col("_rk_range").alias("_rk_r"), "_rk_first", F.coalesce(F.sum("_rk_w").over(up), F.lit(0)).alias("_rk_before"))
    same = F.col("_rk_range") == F.col("_rk_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_rk_k{i}"))
    out = placed.join(totals, same)
    if weight:
        here = Window.partitionBy("_rk_range", *own).orderBy("_rk_at").rowsBetween(Window.unboundedPreceding, -1)
        place = F.col("_rk_before") + F.coalesce(F.sum(weight).over(here), F.lit(0))
    else:
        place = F.col("_rk_before") + F.col("_rk_at") - F.col("_rk_first")
    return out.withColumn(name, place).drop("_rk_at", "_rk_range", "_rk_r", "_rk_first", "_rk_before", *[f"_rk_k{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, by: list[str], columns: list[str], steps: int, which: list[int] | None = None) -> DataFrame:
    """by, column, i, value: the exact quantiles i / steps of the columns, interpolated between neighbours; nulls don't count. which: the i wanted, else all.

    Equal values are one row before they are sorted, so a value that most rows have weighs no more than others; a group may span all ranges.
    """
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(*by, "x.*").where("value IS NOT NULL")
    return quantiles_of_counts(long.groupBy(*by, "column", "value").agg(F.count("*").alias("c")), [*by, "column"], steps, which)


def sketched(df: DataFrame, columns: list[str], steps: int, which: list[int]) -> list[Row]:
    """A row for each column: column, s (population deviation), odd (whether any value is NaN), ends (values just below and above each quantile i / steps, about)."""
    near = [p for i in which for p in (max(i / steps - 0.002, 0.0), min(i / steps + 0.002, 1.0))]
    each = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).mapInArrow(batches.sketch(columns), batches.SKETCH)
    return each.groupBy("column").applyInPandas(batches.ends(near), "column string, s double, odd boolean, ends array<double>").collect()


def few_quantiles(df: DataFrame, columns: list[str], steps: int, which: list[int], found: list[Row] | None = None) -> DataFrame:
    """column, i, value as `quantiles` gives them, of many columns and few quantiles. A sketch (found: if it was made before) tells where these lie; the values of each gap between are one row,
    with the least and the greatest of them, so only the values near a quantile are shuffled. The same result from either of the two is exact; else all values are."""
    found = found or sketched(df, columns, steps, which)
    told = {r["column"]: r["ends"] for r in found if r["ends"]}
    if not told or any(r["odd"] for r in found):
        return quantiles(df, [], columns, steps, which)
    counts = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in told]).mapInArrow(batches.near(told), batches.NEAR)
    counts = shared.kept(counts.groupBy("column", "_own", "_gap").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high")), "near")
    low, high = (quantiles_of_counts(counts.select("column", F.col(x).alias("value"), "c"), ["column"], steps, which) for x in ("low", "high"))
    low = shared.kept(low, "few-quantiles")
    missed = low.join(high.withColumnRenamed("value", "_high"), ["column", "i"]).where(~F.col("value").eqNullSafe(F.col("_high"))).limit(1).count()
    return quantiles(df, [], columns, steps, which) if missed else low


def quantiles_of_counts(counts: DataFrame, key: list[str], steps: int, which: list[int] | None = None) -> DataFrame:
    """key, i, value: the quantiles of values that occur c times; counts has key, value, c, a row for each value."""
    each = ranked(counts.select(*key, "value", "c"), key, ["value"], "start", "c")
    total = each.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.sum("c").alias("n"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    each = each.join(total, same).drop(*[f"_{k}" for k in key])
    end = F.col("start") + F.col("c")
    if which is None:  # the i whose place may lie in this row or just before it
        near = lambda x: F.floor(x * F.lit(float(steps)) / F.greatest(F.col("n") - 1, F.lit(1))).cast("int")
        wanted = F.when(F.col("n") == 1, F.sequence(F.lit(0), F.lit(steps))).otherwise(F.sequence(F.greatest(near(F.col("start") - 1) - 1, F.lit(0)), F.least(near(end) + 1, F.lit(steps))))
    else:
        wanted = F.array(*map(F.lit, which))
    at = (F.col("n") - 1) * (F.col("i") / F.lit(float(steps)))
    lower, upper = F.floor(at), F.ceil(at)
    inside = lambda place: (place >= F.col("start")) & (place < end)
    hit = each.withColumn("i", F.explode(wanted)).withColumn("lower", lower).withColumn("upper", upper).where(inside(F.col("lower")) | inside(F.col("upper")))
    low, high = F.max(F.when(inside(F.col("lower")), F.col("value"))), F.max(F.when(inside(F.col("upper")), F.col("value")))
    found = hit.groupBy(*key, "i", "n", "lower", "upper").agg(low.alias("a"), high.alias("b"))
    value = F.when((F.col("lower") == F.col("upper")) | (F.col("a") == F.col("b")), F.col("a")).otherwise((F.col("upper") - at) * F.col("a") + (at - F.col("lower")) * F.col("b"))
    return found.select(*key, "i", value.alias("value"))
