"""What many columns need of every row, in numpy over batches of rows: expressions of a hundred columns are too large for the JVM to compile, and interpreted they are slow.

Each function returns one for mapInArrow that holds a batch and one row, or one summary, at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def _table(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """The columns as doubles, nulls as NaN."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])


def _numbers(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x), pa.float64())


def burst_and_trend(keys: list[str], names: list[str], short: int, long: int) -> Callable:
    """Of rows sorted by key and place: all other columns, then of each name its value, its distance from the short mean one row before, and its long mean. Means are recursive, y0 = x0,
    y = (1 - a) y + a x, a = 2 / (span + 1); a null adds nothing to them."""
    rates = np.repeat([2 / (short + 1), 2 / (long + 1)], len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, y = None, np.zeros(2 * len(names))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _table(batch, names)
            new = np.zeros(n, bool)
            for k in keys:  # numbers of the batch's own, -1 for null
                code = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = first != key
            key = tuple(batch.column(k)[n - 1].as_py() for k in keys)
            null = [batch.column(c).null_count > 0 for c in names]
            whole = np.where(np.column_stack([np.asarray(batch.column(c).is_null()) for c in names]), 0.0, x) if any(null) else x
            both = np.hstack([whole, whole])
            step, before, after = both * rates, np.empty((n, len(names))), np.empty((n, len(names)))
            stay = 1 - rates
            for i, begins in enumerate(new.tolist()):
                if begins:
                    y = both[i].copy()
                    before[i] = x[i]
                else:
                    before[i] = y[: len(names)]
                    y *= stay
                    y += step[i]
                after[i] = y[len(names) :]
            burst = x - before
            told = []
            for i, c in enumerate(names):
                missing = np.asarray(batch.column(c).is_null()) if null[i] else None
                told += [pa.array(x[:, i], pa.float64(), mask=missing), pa.array(burst[:, i], pa.float64(), mask=missing), _numbers(after[:, i])]
            rest = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *told], [*rest, *[f"{c}{k}" for c in names for k in ("", "__burst", "__trend")]])

    return run


def scaled(columns: list[str], scaler: list[tuple[str, float | None, float | None]], rest: list[str]) -> Callable:
    """The columns in rest and x: the others scaled, as one array; missing values are 0, the rest stays within 10."""
    of = {c: (center, scale) for c, center, scale in scaler}
    center, scale = (np.array([np.nan if of[c][i] is None else of[c][i] for c in columns]) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(all="ignore"):
                z = (_table(batch, columns) - center) / scale
            z = np.where(np.isnan(z), 0.0, np.clip(z, -10.0, 10.0))
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, len(columns)), pa.int32()), _numbers(z.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], x], [*rest, "x"])

    return run


def _picked(values: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` of weighted values that stand for all of them: each for an equal share."""
    if len(values) <= most:
        return values, weights
    order = np.argsort(values, kind="stable")
    ends = np.cumsum(weights[order])
    at = np.searchsorted(ends, (np.arange(most) + 0.5) * ends[-1] / most)
    return values[order][np.minimum(at, len(values) - 1)], np.full(most, ends[-1] / most)


SKETCH = "column string, n double, mean double, m2 double, odd boolean, picked array<double>, weights array<double>"


def _joined(a: tuple | None, b: tuple) -> tuple:
    """n, mean and sum of squares off the mean of two sets."""
    if a is None or not a[0] or not b[0]:
        return b if a is None or not a[0] else a
    n, off = a[0] + b[0], b[1] - a[1]
    return n, a[1] + off * b[0] / n, a[2] + b[2] + off * off * a[0] * b[0] / n


def sketch(columns: list[str], most: int = 1000) -> Callable:
    """A row for each column (SKETCH): moments of the task's values, whether any is NaN, and values that stand for all of them, places off by 1 / most of all at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, odd, held = [None] * len(columns), [False] * len(columns), [(np.zeros(0), np.zeros(0))] * len(columns)
        for batch in batches:
            for i, c in enumerate(columns):
                v = np.sort(batch.column(c).drop_null().to_numpy(zero_copy_only=False).astype(float))
                if not len(v):
                    continue
                odd[i] = odd[i] or bool(np.isnan(v[-1]))
                with np.errstate(all="ignore"):
                    mean = v.mean()
                    moments[i] = _joined(moments[i], (float(len(v)), mean, ((v - mean) ** 2).sum()))
                if len(v) > most:
                    v, w = v[((np.arange(most) + 0.5) * len(v) / most).astype(int)], np.full(most, len(v) / most)
                else:
                    w = np.ones(len(v))
                v, w = np.concatenate([held[i][0], v]), np.concatenate([held[i][1], w])
                held[i] = _picked(v, w, most) if len(v) > 16 * most else (v, w)
        rows = [(c, *(m or (0.0, None, None)), o, *_picked(*h, most)) for c, m, o, h in zip(columns, moments, odd, held, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64())))],
                                         ["column", "n", "mean", "m2", "odd", "picked", "weights"])

    return run


def ends(near: list[float]) -> Callable:
    """Of a column's rows of SKETCH: one with the population deviation, whether any value is NaN, and the values about at the shares in near."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        moments = None
        for r in rows.sort_values(["n", "mean"]).itertuples():
            if r.n:
                moments = _joined(moments, (r.n, r.mean, r.m2))
        if moments is None:
            return pd.DataFrame({"column": [rows["column"].iloc[0]], "s": [None], "odd": [False], "ends": [None]})
        values, weights = np.concatenate([*rows["picked"]]), np.concatenate([*rows["weights"]])
        order = np.argsort(values, kind="stable")
        up = np.cumsum(weights[order])
        at = np.minimum(np.searchsorted(up, np.array(near) * up[-1]), len(values) - 1)
        return pd.DataFrame({"column": [rows["column"].iloc[0]], "s": [float(np.sqrt(moments[2] / moments[0]))], "odd": [bool(rows["odd"].any())], "ends": [values[order][at].tolist()]})

    return run


NEAR = "column string, _own double, _gap int, c long, low double, high double"


def near(told: dict[str, list[float]]) -> Callable:
    """Rows of NEAR: each value between an even and the next odd end of its column, with its count in the batch; of the others one row for each gap, with the least and the greatest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps: dict[tuple[str, int], list] = {}
        for batch in batches:
            out: list[tuple] = []
            for c, limits in told.items():
                v = batch.column(c).drop_null().to_numpy(zero_copy_only=False).astype(float)
                lower, upper = limits[::2], limits[1::2]
                inside = np.zeros(len(v), bool)
                for a, b in zip(lower, upper, strict=True):
                    inside |= (v >= a) & (v <= b)
                own, count = np.unique(v[inside], return_counts=True)
                out.append((np.full(len(own), c, object), own, count))
                outer = v[~inside]
                gap = sum((outer > b).astype(int) for b in upper)
                for g in np.unique(gap).tolist():
                    mine = outer[gap == g]
                    was = gaps.get((c, g), [0, np.inf, -np.inf])
                    gaps[c, g] = [was[0] + len(mine), min(was[1], mine.min()), max(was[2], mine.max())]
            name, own, count = (np.concatenate([x[k] for x in out]) for k in range(3))
            if len(own):
                yield _near(name, own, None, count, own, own)
        if gaps:
            yield _near([c for c, _ in gaps], None, [g for _, g in gaps], *zip(*gaps.values(), strict=True))

    return run


def _near(name, own, gap, count, low, high) -> pa.RecordBatch:
    size = len(name)
    return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.nulls(size, pa.float64()) if own is None else _numbers(own), pa.nulls(size, pa.int32()) if gap is None else pa.array(gap, pa.int32()),
                                       pa.array(count, pa.int64()), pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["column", "_own", "_gap", "c", "low", "high"])
