"""What the operators of this subpackage share: cut points and vectorised text kernels.

The kernels work on Arrow string buffers, a chunk of documents at a time, so that memory is bounded by
CHUNK bytes of text or one document, whichever is larger, and never by a batch or a partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK = 1 << 20
#: Bytes of an Arrow batch (or one row): what a task holds of its input at once, in the JVM and in Python.
BATCH_BYTES = 4 << 20
#: Documents of a chunk at most; the kernels pack a document's number into 12 bits.
CHUNK_DOCS = 4096

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: A span is hashed in stretches of this many bytes, each byte through a table of random numbers for its place.
_STRETCH = 64
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, _STRETCH << 8, dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a local one is made only in local mode (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        where = f"file://{tempfile.mkdtemp(prefix='wayfare-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what the application wrote there is deleted when it ends."""
    top = f"{shared_dir(spark)}/wayfare/{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(top)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and any executor can read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in small batches, by workers that give memory back when a task ends."""
    conf = df.sparkSession.conf
    if _bytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(tidy, schema)


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", text.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n (a null id counts as empty text)."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; equal inputs and seeds give equal outputs on every worker."""
    h = h ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offs.astype(np.int64)


def chunks(column: pa.Array, most: int = CHUNK):
    """(first, last, bytes, offsets) for runs of whole documents of at most `most` bytes, or of one longer document."""
    data, offs = buffers(column)
    at, n = 0, len(offs) - 1
    while at < n:
        to = min(int(np.searchsorted(offs, offs[at] + most, "right")) - 1, at + CHUNK_DOCS - 1, n)
        to = max(to, at + 1)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def _spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross a document's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    borders = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < n)]
    start[borders] = inside[borders]
    end[borders - 1] = inside[borders - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span (one byte or more), in a fixed number of passes over the chunk.

    A byte counts with a random number for its value and place, stretches of _STRETCH bytes are mixed with their number and
    added up, so no structure of a text makes two spans agree: n spans hold an equal pair with a chance of about n * n / 2**65.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    stretches = (lengths + _STRETCH - 1) // _STRETCH
    one = int(stretches.max()) == 1
    if not one:
        owner = np.cumsum(stretches) - stretches
        number = np.arange(int(stretches.sum())) - np.repeat(owner, stretches)
        starts = np.repeat(starts, stretches) + _STRETCH * number
        ends = np.minimum(starts + _STRETCH, np.repeat(ends, stretches))
    kind = np.int32 if len(data) < 1 << 30 else np.int64
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=kind) - np.repeat(first.astype(kind), sizes)
    at = place + np.repeat(starts.astype(kind), sizes)
    sums = np.add.reduceat(_TABLE[(place << kind(8)) | data[at]], first)
    if not one:  # a span of one stretch has the same hash whatever stands beside it
        mixed = np.add.reduceat(mix(sums + number.astype(np.uint64) * np.uint64(_BASE), 3), owner)
        sums = np.where(stretches > 1, mixed, sums[owner])
    return mix(sums + lengths.astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True):
    """(starts, ends, hashes, word offsets by document) of the words [^\\x20\\x09-\\x0D]+, A-Z in lower case."""
    starts, ends = _spans(~_SPACE[data], offs)
    hashes = span_hashes(_LOWER[data] if lower else data, starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offs)


def doc_numbers(word_offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(word_offs) - 1), np.diff(word_offs))


def grams(hashes: np.ndarray, word_offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside each document, and window offsets by document."""
    counts = np.maximum(np.diff(word_offs) - n + 1, 0)
    offs = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(word_offs[:-1] - offs[:-1], counts) + np.arange(offs[-1])
    total = np.zeros(offs[-1], np.uint64)
    for k in range(n):
        total = (total + hashes[first + k]) * np.uint64(_BASE | 1)
        total ^= total >> np.uint64(31)
    return mix(total, n), offs


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())
