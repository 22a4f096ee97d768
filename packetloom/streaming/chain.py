"""From packets to alerts in one streaming query: flows, cells, host states and alert runs, each an operator with state of its own.

Each operator keeps rows, not frames: list state for packets that wait or whose flow is open, map state for cells that are open, value state for a host's last
cell and its open run. Event-time timers close what no row to come can join, so that packets in any order within `late`
give what the batch operators give, and a query restarted from its checkpoint goes on where it was. Rows pass from one
operator to the next with the time of their release, `at`; the times they are about are columns like others.

A flow is released when the watermark passes its end plus idle_s, or its age active_s at most idle_s later; so a cell is complete once the watermark
is idle_s + active_s beyond its window, and cells of a host come in order. Filled cells come with the cell that ends a silence.
State is removed with the flow, cell, segment or run that it was for. State needs the RocksDB store (see `stored_in_rocksdb`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from packetloom.functions.stages import severity
from packetloom.operators import risk
from packetloom.operators.packets import KEY, keyed
from packetloom.streaming.cells import timed

STORE = "spark.sql.streaming.stateStore.providerClass"
HOST = ["capture", "src_ip"]
PACKET = "ts double, event_id bigint, src string, dst string, dport int, proto int, flags int, seq bigint, payload bigint, length bigint, ttl int"
FLOW = "capture string, src_ip string, dst_ip string, dst_port int, proto int, ts double, duration double, fwd_pkts bigint, bwd_pkts bigint, fwd_bytes bigint, bwd_bytes bigint, syn bigint, ack bigint, rst bigint, retrans bigint, ttl_mean double, at timestamp"
FEATURES = ["n_flows", "log_bytes", "log_pkts", "syn_ratio", "retrans_rate"]
COUNTS = [f"cnt_{i}" for i in range(7)]
CELL = "capture string, src_ip string, wid bigint, n_flows bigint, log_bytes double, log_pkts double, syn_ratio double, retrans_rate double, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", at timestamp"


def stored_in_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


TYPES = {"double": DoubleType(), "bigint": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType()}


def typed(schema: str) -> StructType:
    """The schema of a state; workers have no session that could parse it."""
    return StructType([StructField(c.split()[0], TYPES[c.split()[1]]) for c in schema.split(", ")])


def released(times) -> pd.Timestamp:
    """The time that rows are handed on with: just beyond the watermark."""
    return pd.Timestamp(times.getCurrentWatermarkInMs() + 1, unit="ms")


def frame(rows: list[tuple], schema: str) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=names(schema))


def tuples(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    return [r for f in frames for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)]


def summary(capture: str, packets: list[tuple], at: pd.Timestamp) -> tuple:
    """The row of a flow (see FLOW) from its packets in order; as `packets.summarise`, seen from its first packet's source."""
    first, n = packets[0], names(PACKET)
    get = {c: [p[i] for p in packets] for i, c in enumerate(n)}
    tcp, ahead = first[n.index("proto")] == 6, [s == first[n.index("src")] for s in get["src"]]
    bits = lambda i: sum(bool(f & 1 << i) for f in get["flags"]) if tcp else 0
    length = lambda way: sum(x for x, a in zip(get["length"], ahead, strict=True) if a is way)
    loaded = [(a, s) for a, s, p in zip(ahead, get["seq"], get["payload"], strict=True) if p > 0] if tcp else []
    return (capture, first[n.index("src")], first[n.index("dst")], first[n.index("dport")], first[n.index("proto")], get["ts"][0], get["ts"][-1] - get["ts"][0], sum(ahead), len(ahead) - sum(ahead), length(True), length(False),
            bits(1), bits(4), bits(2), len(loaded) - len(set(loaded)), sum(get["ttl"]) / len(packets), at)


class Flows(StatefulProcessor):
    """Packets of a conversation to flows. List state: packets that the watermark hasn't reached, and those of the open flow."""

    def __init__(self, capture: str, idle_s: float, active_s: float):
        self.capture, self.idle, self.active = capture, idle_s, active_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.wait, self.open = handle, handle.getListState("wait", typed(PACKET)), handle.getListState("open", typed(PACKET))

    def handleInputRows(self, key, rows, timerValues):
        new = tuples(rows, names(PACKET))
        self.wait.appendList(new)
        self.handle.registerTimer(math.floor(min(p[0] for p in new) * 1000) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() / 1000
        waiting = list(self.wait.get()) if self.wait.exists() else []
        ready, flow, out = sorted(tuple(p) for p in waiting if p[0] <= now), [tuple(p) for p in self.open.get()] if self.open.exists() else [], []
        close = lambda f: out.append(summary(self.capture, f, released(timerValues)))
        for p in ready:
            if flow and (p[0] - flow[-1][0] > self.idle or p[0] - flow[0][0] > self.active):
                close(flow)
                flow = []
            flow.append(p)
        due = min(flow[-1][0] + self.idle, flow[0][0] + self.active) if flow else None
        if flow and now >= due:  # what comes is later than now
            close(flow)
            flow, due = [], None
        wait = [tuple(p) for p in waiting if p[0] > now]
        for state, held in ((self.wait, wait), (self.open, flow)):
            state.put(held) if held else state.clear()
        for t in [due] if flow else []:
            self.handle.registerTimer(math.floor(t * 1000) + 1)
        if wait:
            self.handle.registerTimer(math.floor(min(p[0] for p in wait) * 1000) + 1)
        yield from frame(out, FLOW)

    def close(self) -> None:
        pass


class Cells(StatefulProcessor):
    """Flows of a host to cells. Map state: the sums of each window that flows may still begin in."""

    SUMS = ["n", "bytes", "pkts", "syn", "retrans", *COUNTS]

    def __init__(self, seconds: int, wait_s: float):
        self.seconds, self.wait = seconds, wait_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", typed("wid bigint"), typed(", ".join(f"{c} bigint" for c in self.SUMS)))

    def handleInputRows(self, key, rows, timerValues):
        new: dict[int, list[int]] = {}
        for ts, fp, bp, fb, bb, syn, retrans, stage in tuples(rows, ["ts", "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "syn", "retrans", "stage"]):
            wid = math.floor(ts / self.seconds)
            total = new.setdefault(wid, [0] * len(self.SUMS))
            for i, v in enumerate((1, fb + bb, fp + bp, syn, retrans)):
                total[i] += int(v)
            total[5 + int(stage)] += 1
        for wid, total in new.items():
            if self.sums.containsKey((wid,)):
                total = [a + b for a, b in zip(self.sums.getValue((wid,)), total, strict=True)]
            self.sums.updateValue((wid,), tuple(total))
            self.handle.registerTimer(math.floor(((wid + 1) * self.seconds + self.wait) * 1000) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        wid = round((expiredTimerInfo.getExpiryTimeInMs() - 1) / 1000 - self.wait) // self.seconds - 1
        if self.sums.containsKey((wid,)):
            n, total, pkts, syn, retrans, *counts = self.sums.getValue((wid,))
            self.sums.removeKey((wid,))
            yield from frame([(*key, wid, n, math.log1p(total), math.log1p(pkts), syn / max(pkts, 1), retrans / max(pkts, 1), *counts, released(timerValues))], CELL)

    def close(self) -> None:
        pass


class States(StatefulProcessor):
    """Cells of a host to its segments: empty cells in silences, and each feature's burst and trend. Value state: the last cell's place and the means."""

    def __init__(self, seconds: int, gap: int, short: int, long: int, wait_s: float):
        self.seconds, self.gap, self.a, self.b, self.wait = seconds, gap, 2 / (short + 1), 2 / (long + 1), wait_s

    @staticmethod
    def schema() -> str:
        scales = ", ".join(f"{c}_{k} double" for c in FEATURES for k in ("burst", "trend"))
        return CELL.replace("wid bigint", "run bigint, wid bigint, is_filled boolean", 1).replace(", at timestamp", f", {scales}, at timestamp")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", typed("run bigint, wid bigint, " + ", ".join(f"{k}_{c} double" for k in ("short", "long") for c in FEATURES)))

    def handleInputRows(self, key, rows, timerValues):
        out, at, k = [], released(timerValues), len(FEATURES)
        last = tuple(self.last.get()) if self.last.exists() else None
        for wid, *values in sorted(tuples(rows, ["wid", *FEATURES, *COUNTS])):
            if last and wid - last[1] > self.gap:
                last = None
            silence = [(w, [0.0] * k, [0] * 7, True) for w in range(last[1] + 1, wid)] if last else []
            for w, x, counts, filled in [*silence, (wid, values[:k], values[k:], False)]:
                x = [float(v) for v in x]
                run, _, *means = last or (w, w, *x, *x)
                short, long = means[:k], means[k:]
                trend = [(1 - self.b) * m + self.b * v for m, v in zip(long, x, strict=True)]
                scales = [y for s, v, t in zip(short, x, trend, strict=True) for y in (v - s, t)]
                out.append((*key, run, w, filled, int(x[0]), *x[1:], *counts, *scales, at))
                last = (run, w, *[(1 - self.a) * s + self.a * v for s, v in zip(short, x, strict=True)], *trend)
        self.last.update(last)
        self.handle.registerTimer(math.floor(((last[1] + self.gap + 2) * self.seconds + self.wait) * 1000) + 1)
        yield from frame(out, self.schema())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists() and timerValues.getCurrentWatermarkInMs() / 1000 >= (self.last.get()[1] + self.gap + 2) * self.seconds + self.wait:
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


class Alerts(StatefulProcessor):
    """Cells of a host in order to runs at the threshold or above. Value state: the open run."""

    RUN = "run bigint, first bigint, last bigint, cells bigint, peak double, first_stage int"
    OUT = "capture string, src_ip string, run bigint, start bigint, end bigint, cells bigint, peak double, first_stage int"

    def __init__(self, threshold: float, min_run: int, seconds: int, gap: int, wait_s: float):
        self.threshold, self.min_run, self.seconds, self.gap, self.wait = threshold, min_run, seconds, gap, wait_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", typed(self.RUN))

    def row(self, key, held) -> list[tuple]:
        run, first, last, n, peak, stage = held
        return [(*key, run, first * self.seconds, (last + 1) * self.seconds, n, peak, stage)] if n >= self.min_run else []

    def handleInputRows(self, key, rows, timerValues):
        out, held = [], tuple(self.open.get()) if self.open.exists() else None
        for wid, run, score, stage in sorted(tuples(rows, ["wid", "run", "risk", "stage"])):
            on = score is not None and score >= self.threshold
            if held and not (on and run == held[0] and wid == held[2] + 1):
                out += self.row(key, held)
                held = None
            if on:
                held = (run, held[1], wid, held[3] + 1, max(held[4], score), held[5]) if held else (run, wid, wid, 1, score, int(stage))
        if held:
            self.open.update(held)
            self.handle.registerTimer(self.due(held))
        elif self.open.exists():
            self.open.clear()
        yield from frame(out, self.OUT)

    def due(self, held) -> int:
        """When a cell that follows, be it filled, would have come."""
        return math.floor(((held[2] + self.gap + 2) * self.seconds + self.wait) * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = tuple(self.open.get()) if self.open.exists() else None
        if held and timerValues.getCurrentWatermarkInMs() >= self.due(held):
            self.open.clear()
            yield from frame(self.row(key, held), self.OUT)

    def close(self) -> None:
        pass


def apply(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, at: str = "at") -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime", eventTimeColumnName=at)


def flows(packets: DataFrame, capture: str, idle_s: float, active_s: float, late: str = "10 minutes") -> DataFrame:
    """Flows (see FLOW) of a stream of packets, when they have ended."""
    used = timed(keyed(packets), late).select(*KEY[:-1], *[F.col(n).cast(t).alias(n) for n, t in (c.split() for c in PACKET.split(", "))], "event_time")
    return apply(used, KEY, Flows(capture, idle_s, active_s), FLOW)


def states(flows_: DataFrame, seconds: int, gap: int, short: int, long: int, wait_s: float, stage: str) -> DataFrame:
    """Cells in segments with bursts and trends; stage is an expression over a flow's columns. wait_s: how long after its begin a flow may be released."""
    made = apply(flows_.withColumn("stage", F.expr(stage)), HOST, Cells(seconds, wait_s), CELL)
    return apply(made, HOST, States(seconds, gap, short, long, wait_s), States.schema())


def alerts(packets: DataFrame, capture: str, idle_s: float, active_s: float, seconds: int, gap: int, stage: str, p: list[list[float]], horizon: int, threshold: float, min_run: int, late: str = "10 minutes", spans: tuple[int, int] = (3, 15)) -> DataFrame:
    """Alert runs of packets, as `risk.alerts` has them, of the Markov risk of each cell (p: the transitions between stages)."""
    from packetloom.operators.cells import dominant_stage

    wait = idle_s + active_s
    cells_ = states(flows(packets, capture, idle_s, active_s, late), seconds, gap, *spans, wait, stage)
    scored = risk.with_risk(cells_, p, horizon).select(*HOST, "run", "wid", F.col("risk_markov").alias("risk"), dominant_stage().alias("stage"), "at")
    out = scored.groupBy(*HOST).transformWithStateInPandas(Alerts(threshold, min_run, seconds, gap, wait), Alerts.OUT, "Append", "EventTime")
    return out.withColumn("severity", severity(F.col("peak")))
