"""Flows to cells, segments, states and targets; every step is one DataFrame to one DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.stages import EXPLOIT
from packetloom.operators import scans

HOST = ["capture", "src_ip"]
KEYS = [*HOST, "wid"]
SEGMENT = [*HOST, "run"]


def windowed(flows: DataFrame, seconds: int) -> DataFrame:
    return flows.withColumn("wid", F.floor(F.col("ts") / seconds).cast("long"))


def build(flows: DataFrame, seconds: int, keys: list[str] | None = None) -> DataFrame:
    """Decomposable features of each cell in one partial and one final aggregate, with its stage counts."""
    pkts = F.greatest(F.sum(F.col("fwd_pkts") + F.col("bwd_pkts")), F.lit(1))
    rate = lambda c: (F.sum(c) / pkts).alias(f"{c}_ratio")
    share = lambda cond, name: F.avg(F.when(cond, 1.0).otherwise(0.0)).alias(name)
    total = F.sum(F.col("fwd_bytes") + F.col("bwd_bytes"))
    return windowed(flows, seconds).groupBy(*(keys or KEYS)).agg(
        F.count("*").alias("n_flows"), F.log1p(total).alias("log_bytes"), F.log1p(F.sum(F.col("fwd_pkts") + F.col("bwd_pkts"))).alias("log_pkts"),
        F.log1p(F.avg("duration")).alias("log_mean_duration"), rate("syn"), rate("ack"), rate("rst"), (F.sum("retrans") / pkts).alias("retrans_rate"),
        F.coalesce(F.avg("ttl_mean"), F.lit(0.0)).alias("ttl_mean"), F.coalesce(F.sqrt(F.avg(F.col("ttl_std") * F.col("ttl_std")) + F.var_pop("ttl_mean")), F.lit(0.0)).alias("ttl_std"),
        (F.count("ttl_mean") == 0).cast("int").alias("ttl_missing"), share(F.col("fwd_pkts") + F.col("bwd_pkts") <= 2, "small_flow_frac"), share(F.col("proto") == 17, "udp_frac"), share(F.col("dst_port") == 53, "dns_frac"),
        (F.log1p(F.sum("fwd_bytes")) - F.log1p(F.sum("bwd_bytes"))).alias("log_out_in_ratio"), *[F.count_if(F.col("stage") == i).alias(f"cnt_{i}") for i in range(7)],
    )


# Ports of remote services, and those of name and time service.
SENSITIVE_PORTS = [21, 22, 23, 135, 139, 445, 1433, 3306, 3389, 5900, 5985]
NAME_AND_TIME = [53, 123]
INTERNAL = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"


def full(flows: DataFrame, seconds: int, keys: list[str] | None = None) -> DataFrame:
    """Every feature of a cell: sums, means and variances in one aggregate; distinct counts and entropies of ports, hosts and flag masks together from counts
    per (cell, kind, value); beacon and scan shape. The parts are joined on the cell key, by which all are partitioned already."""
    keys = keys or KEYS
    packets, inside = F.col("fwd_pkts") + F.col("bwd_pkts"), F.col("src_ip").rlike(INTERNAL) & F.col("dst_ip").rlike(INTERNAL)
    mask = sum((F.when(F.col(f) > 0, 1 << i).otherwise(0) for i, f in enumerate(("syn", "ack", "fin", "rst", "psh", "urg"))), F.lit(0))
    own = flows.withColumn("mask", mask).withColumn("win", F.when((F.col("proto") == 6) & (F.col("init_win") > 0), F.col("init_win").cast("double"))).withColumn("pk", packets)
    n, p = F.count("*"), F.greatest(F.sum("pk"), F.lit(1))
    share = lambda cond, name: F.avg(F.when(cond, 1.0).otherwise(0.0)).alias(name)
    total, low = F.sum(F.col("fwd_bytes") + F.col("bwd_bytes")), lambda c: F.log1p(1000 * F.avg(c))
    load = F.sum(F.col("payload_mean") * F.col("pk")) / p
    square = F.sum((F.col("payload_mean") * F.col("payload_mean") + F.col("payload_std") * F.col("payload_std")) * F.col("pk")) / p
    base = windowed(own, seconds).groupBy(*keys).agg(
        n.alias("n_flows"), F.log1p(n.cast("double")).alias("log_flows"), F.log1p(total).alias("log_bytes"), F.log1p(F.sum("pk")).alias("log_pkts"), F.log1p(F.avg("duration")).alias("log_mean_duration"), F.log1p(total / n).alias("log_bytes_per_flow"),
        *[(F.sum(f) / p).alias(f"{f}_ratio") for f in ("syn", "ack", "fin", "rst", "psh", "urg")], F.avg("ttl_mean").alias("ttl_mean"), F.sqrt(F.coalesce(F.avg(F.col("ttl_std") * F.col("ttl_std")), F.lit(0.0)) + F.coalesce(F.var_pop("ttl_mean"), F.lit(0.0))).alias("ttl_std"),
        F.log1p(F.avg("win")).alias("init_win_mean"), F.log1p(F.stddev_pop("win")).alias("init_win_std"), low("iat_mean").alias("log_iat_mean"), low("iat_std").alias("log_iat_std"), low("iat_max").alias("log_iat_max"), (F.sum("retrans") / p).alias("retrans_rate"),
        share(F.col("pk") <= 2, "small_flow_frac"), (F.log1p(F.sum("fwd_bytes")) - F.log1p(F.sum("bwd_bytes"))).alias("log_out_in_ratio"), share(inside & ~F.col("dst_port").isin(NAME_AND_TIME), "lateral_frac"), share(F.col("dst_port").isin(SENSITIVE_PORTS), "sensitive_port_frac"),
        share(F.col("proto") == 17, "udp_frac"), share(F.col("dst_port") == 53, "dns_frac"), F.log1p(load).alias("log_payload_mean"), F.sqrt(F.greatest(square - load * load, F.lit(0.0))).alias("payload_std"),
        *[(F.sum(c) / p).alias(name) for c, name in (("payload_small_pkts", "payload_small_frac"), ("frag_pkts", "frag_frac"), ("df_pkts", "df_frac"))],
        *[(F.count(c) == 0).cast("int").alias(f"{name}_missing") for name, c in (("ttl", "ttl_mean"), ("payload", "payload_mean"), ("frag", "frag_pkts"), ("iat_max", "iat_max"))], *[F.count_if(F.col("stage") == i).alias(f"cnt_{i}") for i in range(7)],
    )
    values = {"dst_ip": ("n_dst_ips", "dst_ip_entropy"), "dst_port": ("n_dst_ports", "dst_port_entropy"), "mask": (None, "flag_bitmask_entropy")} | ({} if "src_ip" in keys else {"src_ip": ("n_src_ips", None)})
    told = entropies(own, seconds, list(values), keys)
    told = told.select(*keys, *[F.log1p(F.col(f"{v}_n").cast("double")).alias(n) for v, (n, _) in values.items() if n], *[F.col(f"{v}_entropy").alias(e) for v, (_, e) in values.items() if e])
    for part in (told, beacon(flows, seconds, keys), scan_shape(flows, seconds, keys)):
        base = base.join(part.hint("merge"), keys, "left")
    if "n_src_ips" not in base.columns:
        base = base.withColumn("n_src_ips", F.log1p(F.lit(1.0)))
    return base.na.fill(0.0)


def entropy(flows: DataFrame, seconds: int, value: str, keys: list[str] | None = None) -> DataFrame:
    """Per cell: distinct values and Shannon entropy (base 2), from counts per (cell, value)."""
    keys = keys or KEYS
    c = windowed(flows, seconds).groupBy(*dict.fromkeys([*keys, value])).agg(F.count("*").alias("c"))
    n = F.sum("c")
    return c.groupBy(*keys).agg(F.count("*").alias("n_distinct"), (F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("entropy"))


def entropies(flows: DataFrame, seconds: int, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Per cell and for each of values: <value>_n and <value>_entropy as `entropy` gives them, from one read of the flows and counts per
    (cell, which value, value) that combine before the shuffle."""
    keys = keys or KEYS
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(v).cast("string").alias("value")) for i, v in enumerate(values)]))
    c = windowed(flows, seconds).select(*keys, each.alias("x")).groupBy(*keys, "x.kind", "x.value").agg(F.count("*").alias("c"))
    of = lambda i, x: F.sum(F.when(F.col("kind") == i, x))
    bits = lambda i: F.log2(of(i, F.col("c"))) - of(i, F.col("c") * F.log2("c")) / of(i, F.col("c"))
    return c.groupBy(*keys).agg(*[x for i, v in enumerate(values) for x in (F.count_if(F.col("kind") == i).alias(f"{v}_n"), bits(i).alias(f"{v}_entropy"))])


def beacon(flows: DataFrame, seconds: int, keys: list[str] | None = None) -> DataFrame:
    """Per cell: the most regular conversation by gaps over half a second (three at least). A conversation's windows are blocks of their own."""
    talk = ["capture", "src_ip", "dst_ip", "dst_port"]
    used = windowed(flows, seconds).select(*dict.fromkeys([*(keys or KEYS), *talk, "ts", "event_id"]))
    g = scans.lagged(used, talk, F.col("wid"), ["ts", "event_id"], {"before": "ts"}).withColumn("gap", F.col("ts") - F.col("before")).where("gap > 0.5")
    g = g.groupBy(*dict.fromkeys([*(keys or KEYS), *talk])).agg(F.count("*").alias("n"), F.avg("gap").alias("m"), F.stddev_samp("gap").alias("s"))
    return g.where("n >= 3").groupBy(*(keys or KEYS)).agg(F.max(1 / (1 + F.col("s") / F.col("m")) * F.least(F.col("n") / 6, F.lit(1.0))).alias("beacon_score"))


def scan_shape(flows: DataFrame, seconds: int, keys: list[str] | None = None, blocks: int = 16) -> DataFrame:
    """Per cell: steps between the ports of consecutive flows. A cell's time falls into blocks."""
    keys = keys or KEYS
    used = windowed(flows, seconds).select(*dict.fromkeys([*keys, "ts", "event_id", "dst_port"]))
    s = scans.lagged(used, keys, F.floor(F.col("ts") * F.lit(blocks / seconds)), ["ts", "event_id"], {"before": "dst_port"})
    s = s.withColumn("step", F.abs(F.col("dst_port") - F.col("before"))).where("step > 0")
    return s.groupBy(*keys).agg(F.log1p(F.avg("step")).alias("scan_step_mean"), F.avg((F.col("step") <= 2).cast("int")).alias("scan_seq_frac"))


def dominant_stage() -> Column:
    """The malicious stage with most flows, the lowest on ties, 0 without any."""
    counts = F.array(*[F.col(f"cnt_{i}") for i in range(1, 7)])
    return F.when(F.array_max(counts) > 0, F.array_position(counts, F.array_max(counts))).otherwise(0).cast("int")


def priority_stage() -> Column:
    out = F.lit(0)
    for i in reversed([6, 5, 3, 2, 4, 1]):
        out = F.when(F.col(f"cnt_{i}") > 0, i).otherwise(out)
    return out


def select_hosts(cells: DataFrame, most_benign: int, least_active: int) -> DataFrame:
    """Cells of infected hosts and of each capture's busiest benign hosts."""
    hosts = cells.groupBy(*HOST).agg(F.sum("n_flows").alias("n"), F.count("*").alias("active"), F.max((dominant_stage() > 0).cast("int")).alias("bad"))
    rank = F.row_number().over(Window.partitionBy("capture").orderBy(F.desc("n"), "src_ip"))  # a top-k, cut in each task before the shuffle
    benign = hosts.where((F.col("bad") == 0) & (F.col("active") >= least_active)).withColumn("r", rank).where(F.col("r") <= most_benign)
    kept = hosts.where("bad = 1").select(*HOST).unionByName(benign.select(*HOST))
    return cells.join(kept, HOST, "left_semi")


def runs(cells: DataFrame, gap: int, block: int = 4096) -> DataFrame:
    """HOST, run, first, last: runs of cells that silence over gap splits. Only cells that begin a block of wids or follow a silence meet in a window over their host."""
    w = Window.partitionBy(*HOST, "_block").orderBy("wid")
    local = cells.select(*HOST, "wid").withColumn("_block", F.floor(F.col("wid") / block))
    local = local.select(*HOST, "wid", F.lag("wid").over(w).alias("_near"), F.max("wid").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_end"))
    edges = local.where(F.col("_near").isNull() | (F.col("wid") - F.col("_near") > gap))
    up = Window.partitionBy(*HOST).orderBy("wid")
    edges = edges.withColumn("_prev", F.coalesce("_near", F.lag("_end").over(up))).withColumn("_host_end", F.max("_end").over(Window.partitionBy(*HOST)))
    starts = edges.where(F.col("_prev").isNull() | (F.col("wid") - F.col("_prev") > gap))
    return starts.select(*HOST, (F.row_number().over(up) - 1).cast("long").alias("run"), F.col("wid").alias("first"), F.coalesce(F.lead("_prev").over(up), F.col("_host_end")).alias("last"))


def segments(cells: DataFrame, gap: int, block: int = 4096) -> DataFrame:
    """Runs of cells (silence over gap splits), filled with empty cells in between. Long runs are filled block by block. Cells are as many as the rows that
    they fill; Spark takes them for few once columns are pruned, and would send them all through the driver."""
    each = runs(cells, gap, block).withColumn("_block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))))
    span = F.sequence(F.greatest("first", F.col("_block") * block), F.least("last", F.col("_block") * block + block - 1))
    full = each.repartition(*HOST, "_block").select(*SEGMENT, F.explode(span).alias("wid"))
    rest = [c for c in cells.columns if c not in (*HOST, "wid")]
    joined = full.join(cells.hint("merge"), [*HOST, "wid"], "left")
    return joined.select(*SEGMENT, "wid", F.col("n_flows").isNull().alias("is_filled"), *[F.coalesce(F.col(c), F.lit(1 if c.endswith("_missing") else 0)).alias(c) for c in rest]).withColumn("stage", dominant_stage())


def in_segment() -> Window:
    return Window.partitionBy(*SEGMENT).orderBy("wid")


def targets(segs: DataFrame, horizon: int) -> DataFrame:
    """y_future, time_to_attack, exploit_now, phase."""
    w = in_segment()
    out = segs.withColumn("exploit_now", F.col("stage").isin(EXPLOIT).cast("int"))
    ahead = F.min(F.when(F.col("exploit_now") == 1, F.col("wid"))).over(w.rowsBetween(1, horizon))
    out = out.withColumn("_next", ahead).withColumn("y_future", F.col("_next").isNotNull().cast("int")).withColumn("time_to_attack", F.coalesce(F.col("_next") - F.col("wid"), F.lit(-1)))
    return out.drop("_next").withColumn("phase", F.when(F.col("exploit_now") == 1, "during_attack").when(F.col("y_future") == 1, "pre_attack").otherwise("benign"))


def ema(df: DataFrame, column: str, span: int, name: str, block: int = 256) -> DataFrame:
    """The recursive mean y0 = x0, y = (1 - a) y + a x per segment (a row for each wid), by blocks of wids."""
    return scans.decayed(df, SEGMENT, "wid", [(column, span, name)], block=block)


def multi_scale(segs: DataFrame, column: str, short: int, long: int) -> DataFrame:
    """column with its burst (deviation from the short mean one cell before) and trend (long mean)."""
    out = scans.decayed(segs, SEGMENT, "wid", [(column, short, "_short"), (column, long, "trend")], before=True)
    return out.withColumn("burst", F.col(column) - F.coalesce("__short", F.col(column))).drop("_short", "__short", "_trend")


def temporal_split(df: DataFrame, train: float, val: float, purge: int) -> DataFrame:
    """train, val, test by each capture's range of wids; the cells just before a cut are purged."""
    cut = lambda share: F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) * F.lit(share)).cast("long")
    cuts = df.groupBy("capture").agg(F.min("wid").alias("lo"), F.max("wid").alias("hi")).select("capture", cut(train).alias("_a"), cut(train + val).alias("_b"))
    out = df.join(F.broadcast(cuts), "capture")  # a row for each capture
    near = lambda c: (F.col("wid") < F.col(c)) & (F.col("wid") >= F.col(c) - purge)
    return out.withColumn("split_temporal", F.when(near("_a") | near("_b"), "purged").when(F.col("wid") < F.col("_a"), "train").when(F.col("wid") < F.col("_b"), "val").otherwise("test")).drop("_a", "_b")


def family_split(df: DataFrame, groups: dict[str, str]) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in sorted(groups.items()) for x in kv])
    return df.withColumn("split_family", F.coalesce(F.try_element_at(names, F.col("capture")), F.lit("unused")))


def stacked(df: DataFrame, column: str, steps: int) -> DataFrame:
    """The last `steps` values, oldest first; before the segment its first value."""
    w = in_segment()
    first = F.first(column).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("stack", F.array(*[F.coalesce(F.lag(column, i).over(w), first) for i in range(steps - 1, -1, -1)]))


def future_stage(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn(f"stage_{k}", F.lead("stage", k).over(in_segment()))


def merged(cells: DataFrame, tie: str, keys: list[str] | None = None) -> DataFrame:
    """One row for each cell: of rows that repeat one, each column's first value that isn't null, by tie."""
    keys = keys or KEYS
    rest = [c for c in cells.columns if c not in (*keys, tie)]
    return cells.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(tie))).alias(c) for c in rest])


def numbered(segs: DataFrame) -> DataFrame:
    """segs with `segment`, a dense number of its segment in the order of the key; only the distinct segments are sorted."""
    return segs.join(scans.ranked(segs.select(*SEGMENT).distinct(), [], SEGMENT, "segment").hint("merge"), SEGMENT)


def scaled(df: DataFrame, columns: list[str], params: DataFrame) -> DataFrame:
    """df with columns scaled by params (column, center, scale: few rows, on the driver): missing values are 0, the rest stays within 10."""
    held = {r["column"]: r for r in params.collect()}
    z = lambda c: (F.col(c) - held[c]["center"]) / held[c]["scale"]
    return df.withColumns({c: F.when(F.isnan(z(c)) | z(c).isNull(), 0.0).otherwise(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z(c)))) for c in columns})


def scaler_table(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """column, center (median), scale (IQR, else population deviation, else 1). accuracy: quantiles with relative error 1 / accuracy from one pass; else exact."""
    if accuracy:
        spread = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("x")).select("x.*")
        p = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        q = df.agg(*[F.struct(F.lit(c).alias("column"), F.percentile_approx(c, p, accuracy).alias("q")).alias(c) for c in columns]).select(F.explode(F.array(*columns)).alias("x")).select("x.*")
        q = q.select("column", *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "middle", "high"))])
    else:
        found = scans.sketched(df, columns, 4, [1, 2, 3])
        spread = df.sparkSession.createDataFrame([(r["column"], r["s"]) for r in found], "column string, s double")
        q = scans.few_quantiles(df, columns, 4, [1, 2, 3], found)
        q = q.groupBy("column").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(n) for i, n in ((1, "low"), (2, "middle"), (3, "high"))])
    iqr = F.col("high") - F.col("low")
    return q.join(spread, "column").select("column", F.col("middle").alias("center"), F.when(iqr > 1e-6, iqr).when(F.col("s") > 1e-6, F.col("s")).otherwise(1.0).alias("scale"))


def scaler(df: DataFrame, column: str) -> DataFrame:
    """The center and scale of one column: one row."""
    return scaler_table(df, [column]).drop("column")
