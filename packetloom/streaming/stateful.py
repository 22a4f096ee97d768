"""Flows, host states and alerts of a stream, with state from one micro-batch to the next.

Rows of a key wait until the watermark passes them and are then taken in event-time order, so that any arrival order within
`late` gives what the batch operators give; later rows, and those of 1970-01-01 00:00 or before, are dropped. A key's state holds the rows that wait and what its
last flow, segment or run still needs; it goes as soon as no row to come can join that. One query has one of these
operators: write its result to a table and stream on from there.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.functions.stages import severity
from packetloom.operators.cells import HOST, SEGMENT
from packetloom.operators.packets import KEY, keyed
from packetloom.streaming.cells import timed


def in_order(rows: DataFrame, keys: list[str], order: list[str], late: str, fold: Callable, schema: str) -> DataFrame:
    """fold(memo, rows, now) gives (memo, result rows, deadline): memo (None at first) goes where it comes back as None; without rows the
    next call comes when the watermark passes the deadline. Times are seconds in column ts."""
    names = rows.columns

    def step(_, batches, state: GroupState):
        held, memo = pickle.loads(state.get[0]) if state.exists else (None, None)
        parts = [p for p in [held, *([] if state.hasTimedOut else [b[names] for b in batches])] if p is not None and len(p)]
        now = state.getCurrentWatermarkMs() / 1000
        wait, out, deadline = None, [], None
        if parts:
            every = pd.concat(parts, ignore_index=True)
            ready = every["ts"] <= now
            wait, parts = every[~ready], every[ready].sort_values(order, kind="stable")
        memo, out, deadline = fold(memo, parts.to_dict("records") if len(parts) else [], now)
        if memo is None and (wait is None or not len(wait)):
            if state.exists:
                state.remove()
        else:
            due = [t for t in (deadline if memo is not None else None, wait["ts"].min() if wait is not None and len(wait) else None) if t is not None]
            state.update((pickle.dumps((wait, memo)),))
            state.setTimeoutTimestamp(max(int(min(due) * 1000) + 1, int(now * 1000) + 1))
        yield pd.DataFrame(out, columns=columns)

    columns = [c.split()[0] for c in schema.split(", ")]
    return timed(rows, late).groupBy(*keys).applyInPandasWithState(step, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def packets_of_flows(packets: DataFrame, idle_s: float, active_s: int, late: str = "10 minutes") -> DataFrame:
    """The packets of flows that have ended, with their key and `flow`, the microsecond it begins. A flow's packets come
    in one micro-batch: `packets.summarise` in foreachBatch makes the flows. State: the packets of flows that are open."""
    p = keyed(packets)

    def fold(flow, rows, now):  # flow: its packets so far, in order
        out, ended = [], lambda f, t, more: more(t - f[-1]["ts"], idle_s) or more(t - f[0]["ts"], active_s)
        close = lambda f: out.extend({**r, "flow": round(f[0]["ts"] * 1e6)} for r in f)
        for r in rows:
            if flow and ended(flow, r["ts"], float.__gt__):
                close(flow)
                flow = None
            flow = flow or []
            flow.append(r)
        if flow and ended(flow, now, float.__ge__):  # what comes is later than now
            close(flow)
            flow = None
        return flow, out, min(flow[-1]["ts"] + idle_s, flow[0]["ts"] + active_s) if flow else None

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema.fields) + ", flow bigint"
    return in_order(p, KEY, ["ts", "event_id"], late, fold, schema)


def states(cells: DataFrame, column: str, seconds: int, gap: int, short: int, long: int, late: str = "1 hour") -> DataFrame:
    """Cells (capture, src_ip, wid, stage and the column) with empty cells in silences up to gap; `run` is a segment's first wid. Short and long
    means as in `cells.multi_scale`: burst, trend, and surprise (the squared burst). Risk follows from stage without state."""
    rows = cells.select(*HOST, "wid", "stage", F.col(column).cast("double").alias("x"), (F.col("wid") * F.lit(float(seconds))).alias("ts"))
    a, b = 2 / (short + 1), 2 / (long + 1)

    def fold(m, rows, now):  # m: run, wid, short mean, long mean
        out = []

        def add(r, wid, x, stage, filled):
            run, _, s, t = m or (wid, wid, x, x)
            burst = x - s
            out.append({"capture": r["capture"], "src_ip": r["src_ip"], "run": run, "wid": wid, "is_filled": filled, "stage": stage, "x": x, "burst": burst, "trend": (1 - b) * t + b * x, "surprise": burst * burst})
            return run, wid, (1 - a) * s + a * x, (1 - b) * t + b * x

        for r in rows:
            if m and r["wid"] - m[1] > gap:
                m = None
            for wid in range(m[1] + 1, r["wid"]) if m else ():
                m = add(r, wid, 0.0, 0, True)
            m = add(r, r["wid"], r["x"], r["stage"], False)
        end = (m[1] + gap + 1) * seconds if m else None
        return (None, out, None) if m is None or now >= end else (m, out, end)

    return in_order(rows, HOST, ["wid"], late, fold, "capture string, src_ip string, run bigint, wid bigint, is_filled boolean, stage int, x double, burst double, trend double, surprise double")


def alerts(scored: DataFrame, threshold: float, min_run: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """Runs of at least min_run cells at or above the threshold, when they end; columns as in `risk.alerts`. State: a host's open run."""
    rows = scored.select(*HOST, F.col("run").cast("long").alias("run"), "wid", "risk", "stage", (F.col("wid") * F.lit(float(seconds))).alias("ts"))

    def fold(m, rows, now):  # m: the open run
        out = []
        close = lambda m: out.append({k: v for k, v in m.items() if k != "last"} | {"start": m["start"] * seconds, "end": (m["last"] + 1) * seconds}) if m["cells"] >= min_run else None
        for r in rows:
            on = r["risk"] is not None and r["risk"] >= threshold
            if m and not (on and r["run"] == m["run"] and r["wid"] == m["last"] + 1):
                close(m)
                m = None
            if on and m:
                m |= {"last": r["wid"], "cells": m["cells"] + 1, "peak": max(m["peak"], r["risk"])}
            elif on:
                m = {"capture": r["capture"], "src_ip": r["src_ip"], "run": r["run"], "start": r["wid"], "last": r["wid"], "cells": 1, "peak": r["risk"], "first_stage": r["stage"]}
        if m and now >= (m["last"] + 1) * seconds:  # the next cell would have come
            close(m)
            m = None
        return m, out, (m["last"] + 1) * seconds if m else None

    out = in_order(rows, HOST, ["wid"], late, fold, "capture string, src_ip string, run bigint, start bigint, end bigint, cells bigint, peak double, first_stage int")
    return out.select(*SEGMENT, "start", "end", "cells", "peak", "first_stage", severity(F.col("peak")).alias("severity"))
