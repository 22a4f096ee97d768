"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Words are hashed to buckets (the word itself, its shape and whether it repeats the word before), and a
text is the vector of its square-rooted shares. One pass over all documents sums bucket frequencies and
the Gram matrix, both of fixed size; with inverse document frequencies its leading eigenvectors are the
latent-semantic axes. The labelled vectors (a sample of at most `max_labelled`, by hash of doc_id, half of
either label where there are so many) are broadcast; each document's cosines with all of them are exact,
in blocks, and its `k` nearest vote with their similarities.

Neighbours that tie with the k-th share the places left. Null and empty texts have a bucket of their own, so they get neighbours and a score like any other.
Without labels the score is 0.5. Only texts are inputs of a score. Columns besides doc_id and text are
ignored; a row comes out for each row, repeated rows and null ids included. Of rows that repeat a labelled doc_id the
least text is learned from. No documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_crf import SYMBOLS, labelled_sample
from .util import Memo, as_bytes, of, record, slices, summed, table

WORDS, SHAPES = 384, 64
D = WORDS + SHAPES + 6  # the last: empty, few words, repeats the word before, repeats an earlier line, lines, bias
PARTS = 16  # of the sums, so that no group holds them whole


def shape(word: bytes) -> int:
    """A small number for how the word looks: capitals, symbols, digits, ending, length."""
    symbols = len(word) - len(word.translate(None, SYMBOLS))
    text = word.decode("utf-8", "replace")
    case = 0 if text.islower() else 1 if text[:1].isupper() and not text[1:].isupper() else 2 if text.isupper() and len(text) > 1 else 3
    end = 0 if text[-1:].isalnum() else 1 if text[-1:] in ".,;:" else 2 if text[-1:] in "!?" else 3
    return (case * 4 + end) * 4 + min(symbols, 2) + (symbols == 0 and any(c.isdigit() for c in text)) * 3


def buckets() -> Memo:
    """A word's bucket and its shape's, in one number."""
    return Memo(lambda w: (xxhash.xxh32_intdigest(w.lower()) % WORDS) << 8 | shape(w))


def vectors(texts, memo: Memo) -> np.ndarray:
    """A row of length D for each text, of length 1."""
    out = np.zeros((len(texts), D), np.float32)
    for i, t in enumerate(texts):
        data = as_bytes(t)
        words = data.split()
        n = len(words)
        if not n:
            out[i, WORDS + SHAPES] = 1
            continue
        b = np.fromiter(map(memo.__getitem__, words), np.int64, n)
        row = out[i]
        row[:WORDS] = np.sqrt(np.bincount(b >> 8, minlength=WORDS) / n)
        row[WORDS : WORDS + SHAPES] = np.sqrt(np.bincount(b & 63, minlength=SHAPES) / n)
        lines = [x for x in data.split(b"\n") if x.strip()]
        row[WORDS + SHAPES + 1 :] = n < 10, ((b[1:] == b[:-1]).mean() if n > 1 else 0) ** 0.5, (1 - len(set(lines)) / len(lines)) ** 0.5, min(1.0, len(lines) / n) ** 0.5, 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def axes(docs: DataFrame, rank: int) -> np.ndarray:
    """D x rank: inverse document frequencies times the leading eigenvectors, from all documents."""

    def sums(batches):
        memo, gram, df, n = buckets(), np.zeros((D, D)), np.zeros(D), 0
        for batch in slices(batches, 1000):
            v = vectors(batch.column("text").to_pylist(), memo)
            gram += v.T @ v
            df += (v > 0).sum(0)
            n += len(v)
        if n:
            parts = np.array_split(np.concatenate([gram.ravel(), df, [float(n)]]), PARTS)
            yield record(part=pa.array(range(PARTS), pa.int32()), x=[p.tobytes() for p in parts])

    got = summed(docs.select("text").mapInArrow(sums, "part int, x binary"), "part", "x", "<f8", "<f8")
    if not got:
        return np.eye(D, rank)
    flat = np.concatenate([got[i] for i in range(PARTS)])
    gram, df, n = flat[: D * D].reshape(D, D), flat[D * D : -1], flat[-1]
    idf = np.log1p(n / (1 + df))
    idf[WORDS:] = np.maximum(idf[WORDS:], 1)  # shapes and line features are few and all count
    idf[:WORDS] *= 0.5
    gram = gram * idf[:, None] * idf
    values, v = np.linalg.eigh(gram)
    v = v[:, np.argsort(-values)[:rank]]
    v *= np.sign(v[np.abs(v).argmax(0), range(rank)])
    return idf[:, None] * v


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def vote(latent: np.ndarray, held: np.ndarray, labels: np.ndarray, k: int, sharpness: float) -> np.ndarray:
    """The neighbours' labels, weighted by their cosines to a power, for each row of latent."""
    if not len(held):
        return np.full(len(latent), 0.5)
    cosine = np.maximum(latent @ held.T, 0)
    k = min(k, len(held))
    least = np.partition(cosine, len(held) - k, axis=1)[:, len(held) - k, None]  # the k-th largest: neighbours that tie with it share its votes
    tied = cosine == least
    share = np.where(cosine > least, 1.0, tied * ((k - (cosine > least).sum(1)) / tied.sum(1))[:, None])
    w = share * cosine**sharpness
    total = w.sum(1)
    return np.where(total > 0, w @ labels / np.maximum(total, 1e-12), labels.mean())


def score(docs: DataFrame, labels: DataFrame, usable=None, max_labelled: int = 4000, rank: int = 48, k: int = 25, sharpness: float = 8.0) -> DataFrame:
    """doc_id, score for each row of docs. usable: a condition on labels.doc_id for what may be learned from."""
    docs = docs.select("doc_id", "text")
    basis = axes(docs, rank).astype(np.float32)

    def project(batches):
        memo = buckets()
        for batch in slices(batches, 500):
            v = unit(vectors(batch.column("text").to_pylist(), memo) @ basis)
            yield record(doc_id=batch.column("doc_id"), quality=batch.column("quality").cast(pa.int32()), v=pa.array(list(v.astype(np.float32)), pa.list_(pa.float32())))

    sample = labelled_sample(docs, labels, max_labelled, usable)
    rows = sample.mapInArrow(project, f"{of(docs, 'doc_id')}, quality int, v array<float>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((np.array([r["v"] for r in rows], np.float32).reshape(-1, rank), np.array([r["quality"] for r in rows], float)))

    def scored(batches):
        memo, (held, y) = buckets(), model.value
        for batch in slices(batches, 500):
            out = vote(unit(vectors(batch.column("text").to_pylist(), memo) @ basis), held, y, k, sharpness)
            yield record(doc_id=batch.column("doc_id"), score=np.clip(out, 0, 1).astype(float))

    return docs.mapInArrow(scored, f"{of(docs, 'doc_id')}, score double")


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES, ORACLE = {"op1_quality_knn": op1_quality_knn}, {}
