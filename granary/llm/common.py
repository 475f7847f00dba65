"""Shared parts: tables, scratch tables in the shared folder, and a vectorised view of words in UTF-8 bytes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass takes at a time (a longer document goes alone).
SLICE_BYTES = 1 << 20


# ---------------------------------------------------------------- tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """The rows over all cores where the input comes in fewer splits than that; large inputs never do and stay as they are."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


_shipped: set[str] = set()


#: Rows and bytes of an Arrow batch: some megabytes of text, so that neither side of the pipe holds more at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors' Python workers, once for each Spark context, and keep batches small
    where the session has not chosen their size itself."""
    import granary

    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(granary.__file__).parent
    own = tempfile.mkdtemp(prefix="granary-")
    atexit.register(shutil.rmtree, own, True)
    made = Path(own) / "granary-sources.zip"
    with zipfile.ZipFile(made, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, f"granary/{file.relative_to(top)}")
    context.addPyFile(str(made))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where that is unset, a local session (as in
    tests) gets a temporary folder of this machine; on a cluster that would be no shared one, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, own, True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have ended before its scratch tables
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def scratch(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: cuts the lineage, and a
    lost executor costs a retry of the tasks that it ran, nothing more. narrow: rows are a few numbers each, so a task
    takes four partitions, one after another, and there are fewer and larger files."""
    path = scratch_path(df.sparkSession, name)
    if narrow:
        df = df.coalesce(max(1, parts(df.sparkSession) // 4))
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._scratch_path = path
    return found


def drop_scratch(*frames: DataFrame) -> None:
    """Delete tables that `scratch` made, once nothing lazy reads them any more."""
    for frame in frames:
        _delete(frame.sparkSession, frame._scratch_path)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Partitions that a shuffle has at most, whatever the input.
MOST_PARTS = 100_000


def parts_for(frame: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Partitions for a shuffle of the frame's rows: those of the session, or more if its files have more bytes than they would take."""
    known = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = parts(frame.sparkSession)
    # a plan without files has no size but a guess beyond all files
    return max(least, min(MOST_PARTS, known // bytes_each)) if known < 1 << 60 else least


#: Groups up to which `even_labels` names each.
MOST_LABELS = 10_000


def even_labels(spark: SparkSession, groups: int, partitions: int) -> list[int] | None:
    """Integer names of groups that Spark's hash deals evenly over the partitions, as many to each; None for more than
    MOST_LABELS groups, which chance spreads well enough."""
    if groups > MOST_LABELS:
        return None
    size = 16 * groups + 1000
    while True:
        at = spark.range(size).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(partitions)).alias("at")).toArrow()["at"].to_numpy()
        held = [np.flatnonzero(at == p).tolist() for p in range(min(partitions, groups))]
        if all(len(held[g % partitions]) > g // partitions for g in range(groups)):
            return [held[g % partitions][g // partitions] for g in range(groups)]
        size *= 2


# ---------------------------------------------------------------- bytes and words

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Masks of 0 to 8 bytes, and the bytes up to which `span_hashes` goes eight at a time.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG_SPAN = 64


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return _buffers(pc.fill_null(column.cast(pa.large_string()), ""))


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    return _buffers(column.cast(pa.large_binary()))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes each, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """The words of a slice of texts.

    starts, ends: byte positions; first[d]:first[d + 1] are the words of text d; doc: text of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
        self.data, self.offsets = data, offsets
        inside = ~space[data]
        begin, end = inside.copy(), inside.copy()
        if len(data) > 1:
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.inside = inside

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (of `data` in place of the text's own, if given)."""
        return span_hashes(self.data if data is None else data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: eight bytes after another enter a chain of finalisers, which starts from the length, for
    all ranges at once; longer ranges are hashed one by one (XXH3). Neither is linear, so no texts are alike by construction."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = mix64(size.astype(np.uint64), 13)
    at, k = np.flatnonzero(size <= _LONG_SPAN), 0
    while len(at := at[size[at] > k]):
        out[at] = mix64(out[at] ^ (eight[starts[at] + k] & _MASKS[np.minimum(size[at] - k, 8)]), k)
        k += 8
    for i in np.flatnonzero(size > _LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]])
    return out


def word_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of one slice of the column after another."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets, most):
        lo, hi = offsets[a], offsets[b]
        yield a, b, Words(data[lo:hi], offsets[a : b + 1] - lo)


def shingles(words: Words, hashes: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text of each shingle, its hash) for runs of `width` words; a text of 1 to width - 1 words is one shingle."""
    n = len(hashes)
    counts = words.counts
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), made)
    if not len(doc):
        return doc, np.zeros(0, np.uint64)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made)
    at = words.first[:-1][doc] + rank
    length = np.minimum(counts, width)[doc]
    out = np.zeros(len(doc), np.uint64)
    for k in range(width):
        here = np.minimum(at + k, n - 1)
        part = mix64(hashes[here], k + 1)
        out += np.where(k < length, part, np.uint64(0))
    return doc, mix64(out, width)


def crc_of_id(column: pa.Array) -> np.ndarray:
    """crc32 of each id as decimal text (null: 0)."""
    import zlib

    return np.array([0 if v is None else zlib.crc32(str(v).encode()) for v in column.to_pylist()], np.int64)


def held_out(column: str, modulus: int, remainder: int):
    """Column: crc32 of the id as text leaves `remainder` (null ids: never)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
