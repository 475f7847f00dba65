"""Token ids in fixed-width bit packing: files, random access and reading back.

A container holds whole documents in order: a header, the offsets of its blocks, the documents' ids and ends, and
the blocks' bits. Each id takes the least bits that the vocabulary needs, low bits first; a block holds
`BLOCK_IDS` ids and starts at a byte, so one block is unpacked without the others (`unpack_range`), always with
whole numpy arrays. Containers are rows of a Parquet table (binary column `data`), which Spark's own
committed writer puts on any file system: a task that runs twice leaves one result. The table's other columns
(shard, place in the shard, counts) allow seeking without touching the bits.

Documents are range-partitioned by id (rows of one id by a hash of the text, so that an id of many rows is split); shard k holds the k-th range, in order. The offset of a shard is the sum
of the shards before it: one row for each shard is summed, never one for each document.

Defined cases: null text is the empty text (its ids are the end id alone); null ids come first, repeated
ids are ordered by a hash of the text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import bpe
from granary.llm.common import parts_for, scratch_path

MAGIC, BLOCK_IDS = b"GRP1", 4096
#: Stands for a null id in the files.
NO_ID = -(1 << 63)
_HEAD = struct.Struct("<4sBxxxIQQQ")  # magic, width, ids in a block, ids, documents, blocks


def width_of(vocabulary_size: int) -> int:
    """Bits that the ids below `vocabulary_size` need (1 at least)."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids (unsigned, below 2^width <= 2^32), low bits first."""
    ids = np.asarray(ids, np.uint32)
    if width in (8, 16, 32):  # whole bytes: the same bits
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, width: int, count: int, first: int = 0) -> np.ndarray:
    """`count` ids from the id at place `first` on."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, first * width // 8).astype(np.uint32)
    bit = np.arange(first, first + count, dtype=np.int64) * width
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    at = bit >> 3
    value = np.zeros(count, np.uint64)
    for k in range((width + 14) // 8):
        value |= raw[at + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def container(ids: np.ndarray, doc_ids: np.ndarray, doc_ends: np.ndarray, width: int, block: int = BLOCK_IDS) -> bytes:
    """The bytes of one container."""
    blocks = [pack(ids[k : k + block], width) for k in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = _HEAD.pack(MAGIC, width, block, len(ids), len(doc_ids), len(blocks))
    return b"".join([head, offsets.tobytes(), doc_ids.astype("<i8").tobytes(), doc_ends.astype("<u8").tobytes(), *blocks])


class Reader:
    """Random access into one container."""

    def __init__(self, data: bytes):
        magic, self.width, self.block, self.n_ids, docs, blocks = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a container of packed ids")
        at = _HEAD.size
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        at += 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.doc_ends = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.bits = memoryview(data)[at + 16 * docs :]

    def unpack_range(self, first: int, last: int) -> np.ndarray:
        """Ids first..last, from the blocks that hold them alone."""
        if last <= first:
            return np.zeros(0, np.uint32)
        out = []
        for b in range(first // self.block, (last - 1) // self.block + 1):
            low, high = max(first, b * self.block), min(last, (b + 1) * self.block, self.n_ids)
            bits = self.bits[self.offsets[b] : self.offsets[b + 1]]
            out.append(unpack(bits, self.width, high - low, low - b * self.block))
        return np.concatenate(out)

    def all(self) -> np.ndarray:
        """Every id; blocks of whole bytes are one array."""
        if self.block * self.width % 8 == 0:
            return unpack(self.bits, self.width, self.n_ids)
        return self.unpack_range(0, self.n_ids)

    def document(self, k: int) -> np.ndarray:
        return self.unpack_range(int(self.doc_ends[k - 1]) if k else 0, int(self.doc_ends[k]))


FILE = "shard int, place long, shard_start long, n_ids long, n_docs int, data binary"


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1) -> None:
    """Encode doc_id, text with the tokenizers library and write the packed table at `path`."""
    vocabulary = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = bpe.encoder(vocabulary, False)
        width = width_of(tool.vocabulary.size)
        shard, place, start = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a, b, texts in bpe.text_slices(batch.column(1)):
                coded = tool.encode(texts)
                ids = np.frombuffer(b"".join([x for c in coded for x in (c, end)]), "<u4")
                ends = np.cumsum([len(c) // 4 + 1 for c in coded])
                names = np.array([NO_ID if x is None else x for x in batch.column(0)[a:b].to_pylist()], np.int64)
                data = container(ids, names, ends, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in ((shard, pa.int32()), (place, pa.int64()), (start, pa.int64()), (len(ids), pa.int64()), (b - a, pa.int32()), (data, pa.binary()))],
                    names=[c.split()[0] for c in FILE.split(", ")],
                )
                place += 1
                start += len(ids)

    ordered = (
        docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) hash")
        .repartitionByRange(parts_for(docs), "doc_id", "hash")
        .sortWithinPartitions("doc_id", "hash", "text")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(run, FILE).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in the packed table, from its bits."""
    table = spark.read.schema(FILE).parquet(path)
    by_shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        table.groupBy("shard")
        .agg(F.sum("n_ids").alias("n"))
        .select(F.col("shard"), F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("base"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = Reader(data.as_py())
                raw = reader.all().astype("<u4").tobytes()
                ends = reader.doc_ends
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.doc_ids, pa.int64(), mask=reader.doc_ids == NO_ID),
                        pa.array(begins + start, pa.int64()),
                        pa.array(ends - begins, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # one row for each shard, so no more rows than partitions were written
    placed = table.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("shard_start")).alias("start"), "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the files in the shared folder and read them back: the contract's columns."""
    path = scratch_path(docs.sparkSession, "packed")
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path)
