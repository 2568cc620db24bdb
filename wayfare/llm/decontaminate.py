"""Benchmark decontamination with spaced seeds.

An item of the benchmark leaks into a document if, with words put side by side from some offset, a window of WINDOW words
(the whole item if it is shorter) differs in at most a fifth of its words: 3 of 16. A window of w words with at most k
substitutions has, among the k + 1 classes of positions modulo k + 1, one class without a substitution. So the masks are fixed: mask r
looks at positions r, r + k + 1, r + 2(k + 1), ... of a window and ignores the others, and no such window is missed. The
hashes that the masks give for the benchmark are joined with those of the documents (a bitmap, then a sorted table), and
each hit is verified along its diagonal, word by word, over the whole item.

Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. Defined results: null, empty or all-space texts leak nothing; items
under MIN_WORDS words (or null) are too short to say anything and match nothing; repeated benchmark rows give one row for
each item_id; repeated documents give a row each; extra columns pass through `drop_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, doc_numbers, map_batches, mix, words

WINDOW, MIN_WORDS = 16, 5
#: Bytes of benchmark text that one broadcast holds. A larger benchmark goes in blocks, each with its own pass over the documents.
BLOCK_BYTES = 16 << 20
_BITS = 22
#: Pairs of a window and a benchmark seed that are looked at together.
HITS = 1 << 20


def allowed(n: int) -> int:
    """Substitutions that a window of n words may hold."""
    return n // 5


def masks(n: int) -> list[np.ndarray]:
    k = allowed(n) + 1
    return [np.arange(r, n, k) for r in range(k)]


def seeds(hashes: np.ndarray, offs: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window starts, hash) by mask over all n-word windows inside the documents."""
    counts = np.maximum(np.diff(offs) - n + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(offs[:-1] - ends[:-1], counts) + np.arange(ends[-1])
    for r, mask in enumerate(masks(n)):
        total = np.full(len(first), n * 64 + r, np.uint64)
        for at in mask:
            total = (total ^ hashes[first + at]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        yield first, mix(total)


class Index:
    """The seeds of one block of the benchmark."""

    def __init__(self, rows: list[tuple]):
        texts = pa.array([t for _, t in rows], pa.string())
        self.ids, self.words, tables = [], [], {}
        for at, to, data, offs in chunks(texts):
            _, _, hashes, word_offs = words(data, offs)
            for k in range(to - at):
                own = hashes[word_offs[k] : word_offs[k + 1]]
                if len(own) >= MIN_WORDS:
                    n, item = min(WINDOW, len(own)), len(self.ids)
                    self.ids.append(rows[at + k][0])
                    self.words.append(own)
                    for first, keys in seeds(own, np.array([0, len(own)]), n):
                        tables.setdefault(n, []).append((keys, np.full(len(keys), item), first))
        self.tables = {}
        for n, parts in tables.items():
            keys, items, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[keys >> np.uint64(64 - _BITS)] = True
            self.tables[n] = (bitmap, keys[order], items[order], starts[order])

    def leaks(self, hashes: np.ndarray, offs: np.ndarray) -> list[tuple]:
        """(document, item, document word at which the item's word 0 lies, agreeing words, compared words): the best diagonal by document and item."""
        found = []
        docs = None
        for n, (bitmap, keys, items, starts) in self.tables.items():
            for first, got in seeds(hashes, offs, n):
                at = np.flatnonzero(bitmap[got >> np.uint64(64 - _BITS)])
                lo, hi = np.searchsorted(keys, got[at], "left"), np.searchsorted(keys, got[at], "right")
                at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
                if not len(at):
                    continue
                docs = doc_numbers(offs) if docs is None else docs
                # a seed may stand in many items: HITS at a time, so that a chunk's memory is bounded
                sizes = hi - lo
                ends = np.cumsum(sizes)
                a = 0
                while a < len(at):
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + HITS, "right")))
                    n_own = sizes[a:b]
                    slot = np.repeat(lo[a:b] - (np.cumsum(n_own) - n_own), n_own) + np.arange(int(n_own.sum()))
                    place = first[np.repeat(at[a:b], n_own)]
                    found.append(np.unique(np.stack([docs[place], items[slot], place - starts[slot]], 1), axis=0))
                    a = b
        if not found:
            return []
        best: dict[tuple, tuple] = {}
        for doc, item, shift in np.unique(np.concatenate(found), axis=0).tolist():
            own = self.words[item]
            a, b = max(shift, offs[doc]), min(shift + len(own), offs[doc + 1])
            same = hashes[a:b] == own[a - shift : b - shift]
            n = min(WINDOW, len(own))
            if len(same) < n:
                continue
            sums = np.concatenate([[0], np.cumsum(same)])
            if (sums[n:] - sums[:-n]).max() >= n - allowed(n):
                x = (int(same.sum()), len(same), int(shift - offs[doc]))
                best[doc, item] = max(best.get((doc, item), x), x)
        return [(d, i, s, agree, n) for (d, i), (agree, n, s) in best.items()]


def _blocks(benchmark: DataFrame) -> list:
    """Indexes of bounded size, broadcast one each. The benchmark's bytes are measured first."""
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col("text").isNotNull()).groupBy("item_id", "text").agg(F.lit(1).alias("one")).drop("one")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // BLOCK_BYTES + 1
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        index = Index([tuple(r) for r in own.collect()])
        if index.ids:
            yield spark.sparkContext.broadcast(index)


def _scan(index: Index, column: pa.Array) -> Iterator[tuple]:
    for at, _, data, offs in chunks(column):
        _, _, hashes, word_offs = words(data, offs)
        for d, item, shift, agree, n in index.leaks(hashes, word_offs):
            yield at + d, index.ids[item], shift, agree, n


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, n_agree, n_compared): one row for each document and item that leaks into it."""
    kind = benchmark.schema["item_id"].dataType
    id_kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {id_kind.simpleString()}, item_id {kind.simpleString()}, doc_word long, n_agree long, n_compared long"
    out = docs.sparkSession.createDataFrame([], schema)
    for k, block in enumerate(_blocks(benchmark)):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [*_scan(block.value, batch.column(1))]
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                rest = [pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4)]
                yield pa.record_batch([ids, pa.array([r[1] for r in rows], _arrow(kind)), *rest], ["doc_id", "item_id", "doc_word", "n_agree", "n_compared"])

        found = docs.select("doc_id", "text").transform(map_batches, run, schema)
        out = out.unionByName(found) if k else found
    return out


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents into which an item leaks; no shuffle."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in _scan(block.value, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.transform(map_batches, run, docs.schema)
    return docs


def op1_spaced_seed_decontamination(spark, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return find_leaks(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet"))
