"""Quality rules: a linear-chain conditional random field labels the lines content or boilerplate.

`train` fits the field by gradient ascent on its log-likelihood (forward-backward) over the lines of a
bounded sample of labelled documents: at most `max_docs` of them, chosen by a hash of doc_id, and of each at most
`windows` windows of `lines` lines, evenly spread (documents of up to windows * lines lines are learned from whole). The weak
label of a line is content in documents of quality 1 and boilerplate in the others; that most lines of a
document agree is what the transitions learn. `judge` decodes every whole text by Viterbi and keeps a
document whose content lines hold at least `share` of its characters, unless the base rules reject it.

Null and empty texts have no words and are rejected. A row comes out for each row of docs, repeated rows and null ids
included; of rows that repeat a labelled doc_id the least text is learned from. No documents give no rows. Texts without a line of words cannot be decoded and
are rejected by the base rules as well. Columns besides doc_id and text play no part. Without labels the
field has only its prior weights (symbols, capitals and repeats speak for boilerplate).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import Memo, as_bytes, of, record, slices, table, word_hashes

SYMBOLS = b"#*$%&|<>"
U = np.uint64
N_FEATURES = 12
#: bias, words, word length, upper share, symbol share, digit share, other punctuation, repeat in line,
#: repeat of neighbouring word, symbol words, equal to an earlier line, very short
PRIOR = np.array([2.0, 0, 0, -4, -10, 0, 0, -4, -6, -4, -2, 0])


def _class_table() -> np.ndarray:
    out = np.zeros((256, 5), np.float32)  # letters, upper, symbols, digits, other punctuation
    for i in range(256):
        c = chr(i)
        out[i] = [c.isalpha() and i < 128 or i >= 0xC0, "A" <= c <= "Z", i in SYMBOLS, "0" <= c <= "9", i < 128 and c.isprintable() and not c.isalnum() and c != " " and i not in SYMBOLS]
    return out


CLASSES = _class_table()


def line_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line that has a word, and its characters (bytes of its words)."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    x, weight, seen = np.zeros((len(lines), N_FEATURES), np.float32), np.zeros(len(lines)), set()
    for i, line in enumerate(lines):
        words = line.split()
        raw = np.frombuffer(line, np.uint8)
        kinds = np.bincount(raw, minlength=256) @ CLASSES
        n, chars = len(words), sum(map(len, words))
        upper = sum(w.isupper() for w in words) if kinds[1] > n else 0
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        key = b" ".join(words)
        x[i] = [1, min(n, 50) / 50, min(chars / n, 20) / 10, max(kinds[1] / max(kinds[0], 1), upper / n), kinds[2] / chars, kinds[3] / chars, kinds[4] / chars, 1 - len(set(words)) / n if n > 3 else 0, again / n, min(1, kinds[2] / n), key in seen, n < 3]
        seen.add(key)
        weight[i] = chars
    return x, weight


def viterbi(x: np.ndarray, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The likeliest labels (1: content). emit: a weight per feature of label 1 against 0; move: 2 x 2."""
    n = len(x)
    if n == 0:
        return np.zeros(0, np.int8)
    e = (x @ emit).tolist()
    m00, m01, m10, m11 = move.ravel().tolist()
    a, b, back = 0.0, e[0], []
    for s in e[1:]:
        p0, p1 = a + m00 < b + m10, a + m01 < b + m11
        a, b = (b + m10 if p0 else a + m00), (b + m11 if p1 else a + m01) + s
        back.append((p0, p1))
    out = [int(b > a)]
    for p in reversed(back):
        out.append(int(p[out[-1]]))
    return np.array(out[::-1], np.int8)


def train(docs: list[tuple[np.ndarray, np.ndarray]], steps: int = 100, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """emit, move from (features, labels) of each document."""
    emit, move = PRIOR.astype(float).copy(), np.array([[0.5, -0.5], [-0.5, 0.5]])
    docs = [d for d in docs if len(d[0])]
    if not docs:
        return emit, move
    n, t = len(docs), max(len(x) for x, _ in docs)
    x, y, on = np.zeros((n, t, N_FEATURES)), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (f, lab) in enumerate(docs):
        x[i, : len(f)], y[i, : len(f)], on[i, : len(f)] = f, lab, True
    pair, total = on[:, 1:] & on[:, :-1], on.sum()
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    g_emit, g_move = np.full(N_FEATURES, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        e = np.stack([np.zeros((n, t)), x @ emit], 2) * on[:, :, None]
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = e[:, 0]
        for k in range(1, t):
            step = np.logaddexp.reduce(alpha[:, k - 1, :, None] + move, axis=1) + e[:, k]
            alpha[:, k] = np.where(on[:, k, None], step, alpha[:, k - 1])
        for k in range(t - 2, -1, -1):
            step = np.logaddexp.reduce(move + (e[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(on[:, k + 1, None], step, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * on[:, :, None]
        pm = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        d_emit = (((y - p[:, :, 1]) * on)[:, :, None] * x).sum((0, 1)) / total - l2 * (emit - PRIOR)
        d_move = (seen - pm.sum((0, 1))) / total - l2 * move
        g_emit += d_emit**2
        g_move += d_move**2
        emit += rate * d_emit / np.sqrt(g_emit)
        move += rate * d_move / np.sqrt(g_move)
    return emit, move


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int, usable=None) -> DataFrame:
    """doc_id, text, quality of at most max_docs labelled documents, half of either label where there are so many."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if usable is None else usable)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picks = [own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2) for q in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id")
    return found.groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 600, windows: int = 4, lines: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights from at most max_docs labelled documents, of each at most `windows` windows of `lines` lines."""

    def features(batches):
        for batch in slices(batches, 100):
            out = []
            for quality, text in zip(*(batch.column(c).to_pylist() for c in ("quality", "text")), strict=True):
                x = line_features(as_bytes(text))[0]
                n = -(-len(x) // lines)
                out += [(quality, x[k * lines : (k + 1) * lines].ravel()) for k in (range(n) if n <= windows else np.linspace(0, n - 1, windows).astype(int))]
            yield record(quality=pa.array([q for q, _ in out], pa.int32()), x=pa.array([x for _, x in out], pa.list_(pa.float32())))

    rows = labelled_sample(docs, labels, max_docs).mapInArrow(features, "quality int, x array<float>").collect()
    rows.sort(key=lambda r: (r["quality"], r["x"]))  # the sum must not depend on the order of arrival
    return train([((x := np.array(r["x"], float).reshape(-1, N_FEATURES)), np.full(len(x), r["quality"])) for r in rows])


def base_counts(data: bytes, memo: Memo) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = 0
    if n >= 6:
        h = np.fromiter(map(memo.__getitem__, words), U, n)
        with np.errstate(over="ignore"):
            w = h[:-4].copy()
            for i in range(1, 5):
                w *= U(0x9E3779B97F4A7C15)
                w ^= w >> U(29)
                w += h[i : n - 4 + i]
        order = np.argsort(w, kind="stable")
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            edge[:-5] += twice
            edge[5:] -= twice
            repeats = int((np.cumsum(edge[:-1]) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge(docs: DataFrame, labels: DataFrame, share: float = 0.5, **options) -> DataFrame:
    """The base counts, the share of characters in content lines and the verdict, for each row of docs."""
    emit, move = fit(docs, labels, **options)

    def verdicts(batches):
        memo, names = word_hashes(), [c.split()[0] for c in OUT.split(", ")]
        for batch in slices(batches, 2000):
            rows = zip(*[verdict(as_bytes(t), memo, emit, move, share) for t in batch.column("text").to_pylist()], strict=True)
            yield record(doc_id=batch.column("doc_id"), **{c: pa.array(x) for c, x in zip(names, rows, strict=True)})

    return docs.select("doc_id", "text").mapInArrow(verdicts, f"{of(docs, 'doc_id')}, {OUT}")


def verdict(data: bytes, memo: Memo, emit: np.ndarray, move: np.ndarray, share: float) -> tuple:
    base = base_counts(data, memo)
    failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
    x, weight = line_features(data)
    content = float(weight @ viterbi(x, emit, move) / weight.sum()) if len(x) else 0.0
    return *base, failed, content, not failed and content >= share


def keep(docs: DataFrame, labels: DataFrame, share: float = 0.5, **options) -> DataFrame:
    """The rows of docs that the rules keep, as they are, with all columns; rows that repeat share a verdict."""
    emit, move = fit(docs, labels, **options)

    def kept(batches):
        memo = word_hashes()
        for batch in slices(batches, 2000):
            yield batch.filter(pa.array([verdict(as_bytes(t), memo, emit, move, share)[-1] for t in batch.column("text").to_pylist()]))

    return docs.mapInArrow(kept, docs.schema)


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES, ORACLE = {"op6_line_crf": op6_line_crf}, {}
