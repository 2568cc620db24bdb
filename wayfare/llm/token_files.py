"""Token ids in files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file is a run of blocks, documents in ascending doc_id order across and within the files. A block holds whole documents
of about BLOCK_TOKENS tokens (more only if one document has more) and describes itself; all numbers are little-endian:

    "WFT1", u32 documents, u32 table entries, u64 tokens, u64 data bytes
    i64 doc_id (least value: null) and u64 tokens, for each document
    u32 id for each rank, the most frequent id of the block first (counts are over all its tokens, ties by id)
    control: 2 bits a token, four tokens a byte from the low bits, the number of its data bytes less one
    data: 1 to 4 bytes a token, the token's rank
    "\\n" (the record separator of the sink)

Ranks are by block, so that a file is written in one pass and read on its own. Documents get an end token each. Files go
through Spark's own text sink and binaryFile source, so any store that Spark reads will do; a file has FILE_BLOCKS blocks at
most (some 100 MB), since that source holds a file at a time. The decoder looks the control bytes up in a table of four
lengths each and gathers the data with numpy. The tokenizer's special tokens inside a text are ordinary text, as its
description asks (encode_special_tokens).

Defined results: null and empty texts hold the end token only; repeated rows follow each other; null doc_ids come first;
an empty table gives files without a block; other columns are ignored; doc_id is cast to long.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _Store
from .common import CHUNK, chunks, cut, map_batches, new_path
from .pieces import Known, numbered, split

BLOCK_TOKENS, FILE_BLOCKS, END = 1 << 20, 32, 0
#: Distinct pieces whose ids a worker remembers.
MEMORY = 2_000_000
_HEAD = struct.Struct("<4sIIQQ")
_NULL = np.iinfo(np.int64).min
#: What Spark's writers call a task's files.
_NAME = re.compile(r"/part-(\d+)-[^/]*-c(\d+)[^/]*$")
#: Lengths of the four tokens of a control byte.
_LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)


def encode_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    used, places, freq = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((used, -freq))
    rank_of = np.empty(len(used), np.uint32)
    rank_of[order] = np.arange(len(used), dtype=np.uint32)
    ranks = rank_of[places]
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    head = _HEAD.pack(b"WFT1", len(doc_ids), len(used), len(ids), len(data))
    return b"".join((head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), used[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()))


def decode_blocks(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, token counts, ids) of each block of a file."""
    at = 0
    while at < len(content):
        magic, docs, table, tokens, size = _HEAD.unpack_from(content, at)
        if magic != b"WFT1":
            raise ValueError(f"no block at byte {at}")
        at += _HEAD.size
        parts = []
        for kind, n in (("<i8", docs), ("<u8", docs), ("<u4", table), ("u1", -(-tokens // 4)), ("u1", size)):
            parts.append(np.frombuffer(content, kind, n, at))
            at += parts[-1].nbytes
        doc_ids, counts, ids, control, data = parts
        lengths = _LENGTHS[control].ravel()[:tokens]
        first = np.cumsum(lengths, dtype=np.int64) - lengths
        data = np.concatenate([data, np.zeros(4, np.uint8)])
        ranks = data[first].astype(np.uint32)
        for k in (1, 2, 3):
            if (more := np.flatnonzero(lengths > k)).size:
                ranks[more] |= data[first[more] + k].astype(np.uint32) << np.uint32(8 * k)
        yield doc_ids, counts.astype(np.int64), ids[ranks]
        at += 1


class _Encoder:
    """The library's encoder over the pattern's matches; each distinct match is encoded once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known, self.store = Known(), _Store(np.uint32)
        self._end()

    def _end(self) -> None:
        self.store.reset(0)
        self.store.append(np.array([END], np.uint32), np.array([1]))
        self.n = 1

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids with an end token after each document, counts by document)."""
        if self.n > MEMORY:
            self.known.clear()
            self._end()
        starts, ends, hashes, piece_offs = split(data, offs)

        def add(places):
            raw = data.tobytes()
            made = self.tokenizer.encode_batch_fast([raw[starts[p] : ends[p]].decode("utf-8", "surrogatepass") for p in places], add_special_tokens=False)
            ids = [m.ids for m in made]
            lengths = np.array([len(x) for x in ids])
            self.store.append(np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths)
            self.n += len(ids)
            return np.arange(self.n - len(ids), self.n)

        numbers = np.insert(numbered(hashes, self.known, add), piece_offs[1:], 0)
        flat, at = self.store.gather(numbers)
        at = at[piece_offs + np.arange(len(piece_offs))]
        return flat, np.diff(at)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def write_token_files(docs: DataFrame, tokenizer_file: str, path: str, block_tokens: int = BLOCK_TOKENS, file_blocks: int = FILE_BLOCKS) -> None:
    """Write the whole texts of docs (doc_id, text) as token files under path; the shuffle is by ranges of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        held: list[tuple] = []
        n = 0

        def block():
            return pa.record_batch([pa.array([encode_block(*(np.concatenate(x) for x in zip(*held, strict=True)))], pa.binary())], ["block"])

        for batch in batches:
            ids = batch.column(0).fill_null(_NULL).to_numpy()
            for at, to, data, offs in chunks(batch.column(1), min(CHUNK, 4 * block_tokens)):
                flat, counts = encoder.encode(data, offs)
                held.append((ids[at:to], counts, flat))
                n += len(flat)
                if n >= block_tokens:
                    yield block()
                    held, n = [], 0
        if held:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # a string column carries the bytes to the sink as they are
    rows.transform(map_batches, run, "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", file_blocks).text(path)


def read_token_files(spark, path: str) -> DataFrame:
    """(file, row, doc_id, n_tokens, ids) from token files; file (the task's number, then the file's in its task) and row give the order, ids are little-endian u32, binary."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                task, part = _NAME.search(name).groups()
                number, row = (int(task) << 32) + int(part), 0
                for doc_ids, counts, ids in decode_blocks(memoryview(content.as_buffer())):
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    for lo in range(0, len(doc_ids), 256):
                        hi = min(lo + 256, len(doc_ids))
                        yield pa.record_batch(
                            [
                                pa.array(np.full(hi - lo, number, np.int64)),
                                pa.array(np.arange(row + lo, row + hi)),
                                pa.array(doc_ids[lo:hi], pa.int64(), mask=doc_ids[lo:hi] == _NULL),
                                pa.array(counts[lo:hi]),
                                pa.array([ids[a:b].tobytes() for a, b in zip(ends[lo:hi], ends[lo + 1 : hi + 1], strict=True)], pa.binary()),
                            ],
                            ["file", "row", "doc_id", "n_tokens", "ids"],
                        )
                    row += len(doc_ids)

    return files.transform(map_batches, run, "file long, row long, doc_id long, n_tokens long, ids binary")


def digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: the starts add up the totals of the files before, then within each file."""
    rows = cut(read.select("file", "row", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32")), "tokens")
    # one row for each file meets in one task
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(before, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op5_frequency_ranked_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return digests(read_token_files(spark, path))
