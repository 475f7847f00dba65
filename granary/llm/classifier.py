"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters, of digits or of other signs; features are hashes of single tokens and of pairs
in 2^`BITS` buckets, each occurrence worth 1 / sqrt(occurrences in the text). Training visits examples in a seeded
order and updates per coordinate (FTRL-Proximal with L1 and L2). It takes a bounded sample of the labelled
rows, `SAMPLE` ids and `SAMPLE_BYTES` bytes of text at most (one text in any case), chosen by seeded hash: that is the documented
bound. Of an id with several texts the one of least hash counts. Features of the sample are
made on the executors; the driver gets index and value arrays of the sample alone, and the model is one array of
2^BITS weights whatever the corpus. Scoring is a sparse dot product over each whole text, in one pass.

Only the text enters a score. Defined cases: null and empty texts score the bias alone; null ids are
never held out; repeated ids are kept, one row each; several labels of one id are averaged (1 from a half on),
null labels are left out; without any label every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Words, held_out, mix64, scratch, slices, span_hashes, text_buffers

BITS, SAMPLE, SAMPLE_BYTES, EPOCHS, SEED = 18, 6000, 64 << 20, 2, 17
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5

_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(9, 14)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


class Tokens(Words):
    """Runs of one kind of character (letters, digits, other signs) in place of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):  # noqa: D107 - the views differ, not the meaning
        self.data, self.offsets = data, offsets
        kind = _KIND[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        real = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
        self.starts, self.ends = starts[real], ends[real]
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)


def features(tokens: Tokens, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text of each feature, bucket), single tokens first, then pairs."""
    hashes = span_hashes(tokens.data, tokens.starts, tokens.ends)
    doc = tokens.doc
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    both = np.concatenate([mix64(hashes, 1), mix64(mix64(hashes[pair], 2) + hashes[pair + 1], 3)])
    return np.concatenate([doc, doc[pair]]), (both >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-Proximal for logistic loss; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def sample(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, float, bytes]]:
    """(seeded place, label, features) of at most `most` labelled documents outside the held-out fold."""
    labels = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .filter(~held_out("doc_id", modulus, remainder))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .select(F.col("doc_id").cast("long").alias("doc_id"), "label", F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long")).alias("place"))
        .orderBy("place", "doc_id")
        .limit(most)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets):
                tokens = Tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                doc, bucket = features(tokens)
                key, count = np.unique((doc << BITS) | bucket, return_counts=True)
                cut = np.searchsorted(key >> BITS, np.arange(b - a + 1))
                made = [
                    (key[i:j] & ((1 << BITS) - 1)).astype("<i4").tobytes() + count[i:j].astype("<i4").tobytes()
                    for i, j in zip(cut[:-1], cut[1:], strict=True)
                ]
                size = pa.array(np.diff(offsets[a : b + 1]))
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], batch.column(2)[a:b], size, pa.array(made, pa.binary())], names=["place", "label", "size", "features"])

    # the sample's size is bounded by the parameter, so its ids may be broadcast
    chosen = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(labels), "doc_id")
    chosen = chosen.groupBy("place", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    found = scratch(chosen.select("text", "place", "label").mapInArrow(run, "place long, label double, size long, features binary"), "sample")
    sizes = sorted((r["place"], r["size"]) for r in found.select("place", "size").collect())
    total = np.cumsum([size for _, size in sizes])
    kept = max(1, int(np.searchsorted(total, most_bytes, "right"))) if sizes else 0
    rows = found.filter(F.col("place") <= sizes[kept - 1][0]).collect() if kept else []
    return sorted((r["place"], r["label"], bytes(r["features"])) for r in rows)


def train(examples: list[tuple[int, float, bytes]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last."""
    model = Ftrl(1 << bits)
    for _ in range(epochs):
        for _, label, raw in examples:
            both = np.frombuffer(raw, "<i4")
            at, count = both[: len(both) // 2], both[len(both) // 2 :]
            x = np.append(count / np.sqrt(max(1, count.sum())), 1.0)
            model.learn(np.append(at, 1 << bits), x, label)
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns, score (0 to 1) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2^BITS + 1 numbers
    schema = docs.select(*columns).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            last = batch.num_columns - 1
            data, offsets = text_buffers(batch.column(last))
            for a, b in slices(offsets):
                tokens = Tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                doc, bucket = features(tokens)
                total = np.bincount(doc, weights=w[bucket], minlength=b - a)
                count = np.maximum(np.bincount(doc, minlength=b - a), 1)
                out = 1 / (1 + np.exp(-np.clip(total / np.sqrt(count) + float(w[-1]), -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(k)[a:b] for k in range(last)] + [pa.array(out)], names=[*columns, "score"])

    return docs.select(*columns, "text").mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """The contract's columns."""
    weights = train(sample(docs, labels, modulus, remainder))
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), weights)
    return scored.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
