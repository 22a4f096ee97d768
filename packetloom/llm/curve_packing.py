"""Packing: documents lie along a Hilbert curve, and the curve is cut into sequences.

Each text is tokenised once; the hashed vector of its ids is projected to three dimensions, and the point's
place on a Hilbert curve is its key. (key, doc_id, row) range-sorts the documents; running sums of their
lengths give each its place in one stream of ids, which is cut every `length` ids. So neighbours on the
curve share sequences, documents are cut freely, and only the last sequence needs padding (none if it
holds a power of two). The ids are written once and meet their places by row, not by text.

Null and empty texts are the end id alone. Repeated rows and null doc_ids are documents like any other.
Columns besides doc_id and text are ignored. No documents give no rows.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import as_bytes, of, ranked, record, slices, stash, table, worker_cache

END = 2
BITS, DIMS, BUCKETS = 10, 3, 256
#: Each ends a run of letters or digits whatever follows, so what stands before it is tokenised alike alone.
MARKS = b".,!;:?*#%&$|)"


class Words:
    """Ids of the words between white space, as little-endian 32-bit bytes; equal to those in the whole text."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.before, self.most = Tokenizer.from_file(path), {}, {}, most
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool) if suffix else None  # ids that end a word
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters alone end in one id that ends a word: many are encoded at once. Others go one by one."""
        texts = {w: w.decode("utf-8", "replace") for w in words}
        plain = [w for w, t in texts.items() if self.ends is not None and t.isalpha()]
        for at in range(0, len(plain), 1000):
            part = plain[at : at + 1000]
            ids = np.array(self._ids([" ".join([texts[w] for w in part])])[0], "<u4")
            stops, raw, start = 4 * (np.flatnonzero(self.ends[ids]) + 1), ids.tobytes(), 0
            if len(stops) == len(part):  # else a letter falls apart when normalised
                for w, stop in zip(part, stops.tolist(), strict=True):
                    self.known[w] = raw[start:stop]
                    start = stop
                    del texts[w]
        rest = list(texts)
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for w, ids in zip(part, self._ids([texts[w] for w in part]), strict=True):
                self.known[w] = np.array(ids, "<u4").tobytes()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raw = [as_bytes(t) for t in texts]
        docs = [(t if b"<|" in t else t.lower()).split() for t in raw]  # the case of special tokens counts
        if len(self.known) > self.most:  # words seen since the last time stay known
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = set().union(*docs).difference(known)
        known.update((w, before[w]) for w in new & before.keys())
        new.difference_update(known)
        parts = {}
        for w in new:
            x = w.rstrip(MARKS)
            if x and len(x) < len(w) and normal(x.decode("utf-8", "replace")[-1]).isalpha():
                parts[w] = x
        pieces = set(parts.values()).union([w[len(x) :] for w, x in parts.items()])
        self._learn(list(new.difference(parts).union(p for p in pieces if p not in known and p not in before)))
        for w, x in parts.items():
            known[w] = b"".join([known[p] if p in known else before[p] for p in (x, w[len(x) :])])
        return [b"".join(map(known.__getitem__, words)) for words in docs]


def normal(letter: str) -> str:
    """The letter as a tokenizer sees it; some fall into a letter and a mark, which is none."""
    return letter if letter.isascii() else unicodedata.normalize("NFC", letter).lower()


def words_of(path: str) -> Words:
    """One for each Python worker: tasks share what it has learned."""
    held = worker_cache("packing")
    if path not in held:
        held[path] = Words(path)
    return held[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The places on a Hilbert curve of integer points (n x dims) below 2**bits."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of each cube
        q, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ t)
            x[i] = np.where(on, x[i], x[i] ^ t) if i else x[0]
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= t
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> level) & 1
    return out


def keys(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document's hashed vector, projected by fixed signs."""
    v = np.zeros((len(ids), BUCKETS))
    for i, x in enumerate(ids):
        v[i] = np.bincount((x * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    v = np.sqrt(v)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    signs = np.random.default_rng(7).choice([-1.0, 1.0], (BUCKETS, DIMS))
    place = 0.5 + 0.5 * np.tanh(v @ signs / 2)
    return hilbert(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, row, key, n, ids (32-bit little-endian, with the end id)."""

    def rows(batches):
        words, end = words_of(path), np.array([END], "<u4").tobytes()
        for batch in slices(batches, 1000):
            ids = [x + end for x in words.encode(batch.column("text").to_pylist())]
            yield record(doc_id=batch.column("doc_id"), row=batch.column("row"), key=keys([np.frombuffer(x, "<u4") for x in ids]), n=pa.array([len(x) // 4 for x in ids], pa.int64()), ids=pa.array(ids, pa.binary()))

    tagged = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return stash(tagged.mapInArrow(rows, f"{of(docs, 'doc_id')}, row long, key long, n long, ids binary"), "pack-ids")


def pack(docs: DataFrame, path: str, length: int = 4096) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    made = tokenized(docs, path)
    order = ranked(made.select("row", "key", "doc_id", F.col("n").alias("size")), ["key", "doc_id", "row"], "pack-order", "size").select("row", F.col("start").alias("place"))

    def pieces(batches):
        for batch in slices(batches, 1000):
            out = []
            for i, (n, ids, place) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "place")), strict=True)):
                start = 0
                while start < n:
                    sequence, offset = divmod(place + start, length)
                    k = min(n - start, length - offset)
                    out.append((i, start, k, ids[4 * start : 4 * (start + k)], n, sequence, offset))
                    start += k
            row, start, size, ids, n, sequence, offset = zip(*out, strict=True)
            long = lambda x: pa.array(x, pa.int64())
            yield record(doc_id=batch.column("doc_id").take(long(row)), start=long(start), length=long(size), ids=pa.array(ids, pa.binary()), doc_tokens=long(n), sequence_id=long(sequence), offset=long(offset))

    both = made.join(order.hint("shuffle_hash"), "row").select("doc_id", "n", "ids", "place")
    return both.mapInArrow(pieces, f"{of(docs, 'doc_id')}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), vocabulary()))


QUERIES, ORACLE = {"op2_curve_packing": op2_curve_packing}, {}
