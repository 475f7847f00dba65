"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Each 5-word shingle (a text of 1 to 4 words is one shingle) is hashed once; the high bits choose one of `BINS` bins,
the least of the rest stays. An empty bin takes the value of the full bin that a sequence of its own
hashes (universal over bins, the same for all documents) reaches first, so two documents agree in a bin
with a probability equal to their resemblance. Of each bin the low `BITS` bits are kept, packed; two
unlike bins agree by chance with probability 2^-BITS, which `likeness` takes out again.

The fingerprint is a hex string. Likeness is 0 to 1; of two texts without words it is 1, of one with and
one without it is 0. Defined cases: null text is the empty text; null ids come last in descending order,
repeated and null ids are ordered by a hash of the text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Words, even_labels, mix64, parts_for, shingles, slices

BINS, BITS, WIDTH = 512, 4, 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(words: Words, bins: int = BINS, width: int = WIDTH) -> np.ndarray:
    """(texts, bins) uint64: the densified minima; rows of texts without a word are all 2^64 - 1."""
    doc, hashes = shingles(words, words.hashes(), width)
    count = len(words.counts)
    out = np.full(count * bins, _EMPTY)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    cell = doc * bins + (hashes >> shift).astype(np.int64)
    np.minimum.at(out, cell, hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    out = out.reshape(count, bins)
    full = out != _EMPTY
    row, column = np.nonzero(~full & full.any(axis=1, keepdims=True))
    attempt = 0
    filled = out.copy()
    while len(row):
        attempt += 1
        pick = (mix64(column.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt), 5) % np.uint64(bins)).astype(np.int64)
        hit = full[row, pick]
        filled[row[hit], column[hit]] = out[row[hit], pick[hit]]
        row, column = row[~hit], column[~hit]
    return filled


def low_bits(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Low bits of the finalised minima, one uint8 per bin; the bin enters, so that bins filled from one another
    are no copies of the same bits."""
    place = mix64(np.arange(minima.shape[1], dtype=np.uint64), 8)
    return (mix64(minima ^ place, 9) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(low: np.ndarray, empty: np.ndarray, bits: int = BITS) -> list[str]:
    """Hex strings; a text without words has the string of a lone 'e'."""
    spread = np.unpackbits(low[:, :, None], axis=2, bitorder="little", count=bits).reshape(len(low), -1)
    return ["e" if none else bytes(x).hex() for none, x in zip(empty, np.packbits(spread, axis=1), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, no_a: np.ndarray, no_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bias-corrected share of bins that agree, 0 to 1."""
    chance = 0.5**bits
    same = ((a == b).mean(axis=1) - chance) / (1 - chance)
    out = np.clip(same, 0.0, 1.0)
    return np.where(no_a | no_b, (no_a & no_b).astype(float), out)


def _view(texts: list[bytes]) -> Words:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(texts), np.uint8), offsets)


def fingerprint(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint: the general interface, one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            for a, b in slices(offsets):
                words = _view(texts[a:b])
                made = packed(low_bits(sketch(words, bins), bits), words.counts == 0, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(made)], names=["doc_id", "fingerprint"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


DIGEST = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(ids: list, texts: list[str], follow: list[str]) -> pa.RecordBatch:
    """The digest rows of texts and the ones that follow each."""
    half = [len(t) // 2 for t in texts]
    edited = [(t[: len(t) - h] + n[:h]).encode() for t, n, h in zip(texts, follow, half, strict=True)]
    n = len(texts)
    words = _view([t.encode() for t in texts] + edited + [follow[-1].encode()])
    low, none = low_bits(sketch(words)), words.counts == 0
    own, other = slice(0, n), slice(n, 2 * n)
    after = np.append(np.arange(1, n), 2 * n)  # each text's next is the text after it, the last one's is extra
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array(packed(low[own], none[own])),
            pa.array(packed(low[other], none[other])),
            pa.array(likeness(low[own], low[other], none[own], none[other])),
            pa.array(likeness(low[own], low[after], none[own], none[after])),
        ],
        names=[c.split()[0] for c in DIGEST.split(", ")],
    )


#: Bytes of text that are compared at a time.
STEP_BYTES = 1 << 19
_LAST = (1 << 63) - 1


class Ranges:
    """Ranges of rows in the order of (id descending, nulls last; hash of the text), told by the first key of each."""

    def __init__(self, first: list[tuple[int, int]]):
        self.first = first
        self.ids = np.array([a for a, _ in first], np.int64)

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range of each row, whether it has the range's first key); ids as `falling` gives them."""
        low, high = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        at = high - 1
        for k in np.flatnonzero(low < high).tolist():  # ids at which ranges begin: the hash decides
            at[k] = bisect_right(self.first, (int(ids[k]), int(hashes[k]))) - 1
        at = np.maximum(at, 0)
        starts = np.array([h for _, h in self.first], np.int64)
        return at, (self.ids[at] == ids) & (starts[at] == hashes)


def falling(column: pa.Array) -> np.ndarray:
    """Ids so that ascending order is descending order of ids, nulls last."""
    ids = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
    return np.where(pc.is_null(column).to_numpy(zero_copy_only=False), _LAST, ~ids)


def digest(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The contract's columns.

    Spark's range partitioner deals ids and hashes of texts into ranges, whose first keys (one for each partition) come to the
    driver. Each range goes to one task in order, where every document meets the next; the first document of each
    range is sent to the range before it as well, to follow its last one. A key that many rows share is split by the hashes.
    """
    spark = docs.sparkSession
    named = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text").withColumn("hash", F.xxhash64("text"))
    count = partitions or parts_for(docs)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if batch.num_rows:
                ids, hashes = falling(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                k = np.lexsort((hashes, ids))[0]
                key = int(ids[k]), int(hashes[k])
                best = key if best is None else min(best, key)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]], pa.int64()), pa.array([best[1]], pa.int64())], names=["id", "hash"])

    order = [F.col("doc_id").desc_nulls_last(), F.col("hash").asc()]
    keys = named.select("doc_id", "hash").repartitionByRange(count, *order).mapInArrow(firsts, "id long, hash long").collect()
    if not keys:
        return spark.createDataFrame([], DIGEST)
    ranges = Ranges(sorted({(r["id"], r["hash"]) for r in keys}))
    shared = spark.sparkContext.broadcast(ranges)  # two numbers for each partition
    # the ranges' own numbers would be dealt by chance, several to some tasks
    labels = even_labels(spark, len(ranges.first), count) or list(range(len(ranges.first)))
    shared_labels = spark.sparkContext.broadcast(np.array(labels, np.int32))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, labels = shared.value, shared_labels.value
        sent: set[int] = set()  # rows of the same first key are alike: one follower from each task does
        for batch in batches:
            at, head = ranges.of(falling(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False))
            yield _placed(batch, labels[at], at, False)
            heads = []
            for k in np.flatnonzero(head).tolist():
                if int(at[k]) not in sent:
                    sent.add(int(at[k]))
                    heads.append(k)
            if heads:
                before = (at[heads] - 1) % len(ranges.first)
                yield _placed(batch.take(pa.array(heads)), labels[before], before, True)

    spread = (
        named.mapInArrow(place, "doc_id long, text string, hash long, label int, part int, extra boolean")
        .repartition(count, "label")
        .sortWithinPartitions("part", "extra", *order, "text")
        .select("doc_id", "text", "part", "extra")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, current, closed = 0, None, False

        def flush(last: str) -> pa.RecordBatch:
            return _compare(ids, texts, [*texts[1:], last])

        for batch in batches:
            for doc_id, text, part, extra in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if part != current:
                    current, closed = part, False
                if extra:
                    if not closed and ids:
                        yield flush(text)
                        ids, texts, size = [], [], 0
                    closed = True
                    continue
                if ids and size > STEP_BYTES:
                    yield flush(text)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)

    return spread.mapInArrow(run, DIGEST)


def _placed(batch: pa.RecordBatch, label: np.ndarray, part: np.ndarray, extra: bool) -> pa.RecordBatch:
    added = [pa.array(label.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(part), extra))]
    return pa.RecordBatch.from_arrays([*batch.columns, *added], names=["doc_id", "text", "hash", "label", "part", "extra"])
