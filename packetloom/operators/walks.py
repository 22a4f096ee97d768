"""Sampled walks over stages in numpy, many cells at a time: `risk.draw` by an MD5 sum of its own, steps by table, and what a cell's particles tell."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from packetloom.functions.stages import EXPLOIT

# Fixed values of MD5: state, shifts, constants, and the word that each step reads.
STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
ADDED = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
#: No stage: a cell whose belief has a null.
NONE = 255


def _rounds(words: list[np.ndarray], state: list[np.ndarray], count: int) -> list[np.ndarray]:
    """The first `count` steps of one block, in the buffers of `state`. words: the block's sixteen, of shapes that broadcast to the state's."""
    a, b, c, d = state
    f, high = np.empty_like(a), np.empty_like(a)
    for i in range(count):
        part = i // 16
        if part == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif part == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif part == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        shift = SHIFTS[part][i % 4]
        np.add(f, a, out=f), np.add(f, words[WORD[i]] + ADDED[i], out=f)
        np.left_shift(f, np.uint32(shift), out=high), np.right_shift(f, np.uint32(32 - shift), out=f)
        np.bitwise_or(f, high, out=f), np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [a, b, c, d]


def _sums(numbers: np.ndarray, width: int, text: np.ndarray, offsets: np.ndarray, at_once: int = 32_768) -> np.ndarray:
    """The first 32 bits of MD5(number | key), a row for each number of `width` digits and a column for each key (text's bytes between offsets)."""
    lengths = np.diff(offsets)
    digits = np.zeros((len(numbers), -(-width // 4) * 4), np.uint8)
    digits[:, :width] = np.array([list(str(n).encode()) for n in numbers], np.uint8)
    digits = digits.view("<u4")
    out = np.empty((len(numbers), len(lengths)), np.uint32)
    blocks = (width + 1 + lengths + 8) // 64 + 1
    for n in np.unique(blocks):
        mine = np.flatnonzero(blocks == n)
        for cut in range(0, len(mine), max(1, at_once // len(numbers))):
            keys = mine[cut : cut + max(1, at_once // len(numbers))]
            size = lengths[keys]
            row, place = np.repeat(np.arange(len(keys)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            message = np.zeros((len(keys), 64 * n), np.uint8)
            message[:, width] = ord("|")
            message[row, width + 1 + place] = text[np.repeat(offsets[keys], size) + place]
            message[np.arange(len(keys)), width + 1 + size] = 0x80
            message.view("<u8")[:, -1] = 8 * (width + 1 + size)
            each = np.ascontiguousarray(message.view("<u4").T)
            shape = (len(numbers), len(keys))
            before = [np.full(shape, x, np.uint32) for x in STATE]
            for k in range(n):
                words = [*each[16 * k : 16 * k + 16]]
                if k == 0:
                    for j in range(digits.shape[1]):
                        words[j] = words[j] | digits[:, j : j + 1]
                if k == n - 1:  # the first word of the sum is done three steps before the last
                    out[:, keys] = _rounds(words, [x.copy() for x in before], 61)[1] + before[0]
                else:
                    before = [x + y for x, y in zip(before, _rounds(words, [x.copy() for x in before], 64), strict=True)]
    return out.byteswap()


def draws(keys: pa.Array, particles: int, steps: int, stride: int) -> np.ndarray:
    """risk.draw(particle * stride + step, key) of each particle, step from 0 to steps, and key."""
    keys = keys.cast(pa.large_binary())
    _, offsets, text = keys.buffers()
    offsets = np.frombuffer(offsets, np.int64)[keys.offset : keys.offset + len(keys) + 1]
    text = np.frombuffer(text, np.uint8) if text else np.zeros(0, np.uint8)
    numbers = (np.arange(particles)[:, None] * stride + np.arange(steps + 1)).ravel()
    widths = np.array([len(str(n)) for n in numbers])
    out = np.empty((len(numbers), len(keys)))
    for width in np.unique(widths):
        out[widths == width] = _sums(numbers[widths == width], width, text, offsets)
    return (out * 2.0**-32).reshape(particles, steps + 1, len(keys))


def sampled(keys: pa.Array, first: np.ndarray, p: list[list[float]], particles: int, steps: int, stride: int) -> np.ndarray:
    """Stages by particle, step and cell. first: a cell's six running sums of its belief; p: the transitions."""
    u = draws(keys, particles, steps, stride)
    ends = np.array([[sum(row[: j + 1]) for j in range(6)] for row in p])  # the seventh stage is what is left
    out = np.empty(u.shape, np.uint8)
    out[:, 0] = sum((first[:, j] <= u[:, 0]).view(np.uint8) for j in range(6))
    for k in range(1, steps + 1):
        out[:, k] = sum((ends[:, j].take(out[:, k - 1]) <= u[:, k]).view(np.uint8) for j in range(6))
    return out


def mapper(tell: Callable, types: list[pa.DataType], p: list[list[float]], particles: int, steps: int, stride: int, at_once: int = 1024) -> Callable:
    """A function of batches for mapInArrow: of the last two columns, key and running sums, it makes what `tell` has for the cells' walks, as arrays with a row for each cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                *kept, keys, first = part.columns
                unknown = np.asarray(first.flatten().is_null()).reshape(-1, 6).any(axis=1)
                walk = sampled(keys, np.asarray(first.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, 6), p, particles, steps, stride)
                walk[:, :, unknown] = NONE
                told = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), t, mask=nothing)) for (x, nothing), t in zip(tell(walk), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *told], [f"c{i}" for i in range(len(kept) + len(told))])

    return run


def chances(p: list[list[float]]) -> np.ndarray:
    """By stage: the chance of exploitation a step on."""
    return np.array([sum(row[j] for j in EXPLOIT) for row in p])


def stages(walk: np.ndarray) -> list:
    """All stages of a cell, particle by particle."""
    flat = np.ascontiguousarray(np.moveaxis(walk, 2, 0)).reshape(walk.shape[2], -1)
    return [(flat.astype(np.int16), (flat == NONE).ravel())]


def summed(p: list[list[float]], particles: list[int], steps: list[int]) -> Callable:
    """For each number of particles and of steps: risk, share of particles that hit, median steps to a hit (-1 without). Fewer particles are the first ones,
    fewer steps the first ones, and medians follow from counts of hits by step."""
    table = np.zeros(256)
    table[:7] = chances(p)

    def tell(walk: np.ndarray) -> list:
        none, most = walk[0, 0] == NONE, max(steps)
        soft = np.maximum.accumulate(table.take(walk[:, :most]), axis=1)
        hit = (walk[:, 1 : most + 1] >= 2) & (walk[:, 1 : most + 1] != NONE)
        done = np.logical_or.accumulate(hit, axis=1)  # by particle and step: hit by then
        risks, shares, middles = [], [], []
        for n in particles:
            ends = done[:n].sum(axis=0)
            for k in steps:
                total = ends[k - 1]
                value = lambda place, k=k, ends=ends: 1 + (ends[: k - 1] <= place).sum(axis=0)
                middle = (value((total - 1) // 2) + value(-((1 - total) // 2))) / 2
                risks.append(soft[:n, k - 1].sum(axis=0) / n), shares.append(total / n), middles.append(np.where(total > 0, middle, -1.0))
        return [(np.stack(x, axis=1), np.repeat(none, len(x)) if x is risks else None) for x in (risks, shares, middles)]

    return tell


def fans(p: list[list[float]], particles: int, steps: int) -> Callable:
    """By step: the 10, 50 and 90 % points of the particles' chance of exploitation. A particle's chance is one of seven, by its stage before, so points follow from counts by stage."""
    chance = chances(p)
    order = sorted(range(7), key=lambda i: chance[i])

    def tell(walk: np.ndarray) -> list:
        ends = np.cumsum([(walk[:, :steps] == i).sum(axis=0) for i in order[:-1]], axis=0)
        value = lambda x: chance[order].take((ends <= x).sum(axis=0))
        out = []
        for q in (0.1, 0.5, 0.9):
            place = (particles - 1) * q
            lower, upper = int(place), int(place) + (place > int(place))
            out.append(((upper - place) * value(lower) + (place - lower) * value(upper) if upper > lower else value(lower)).T)
        return [(np.ascontiguousarray(x), None) for x in out]

    return tell
