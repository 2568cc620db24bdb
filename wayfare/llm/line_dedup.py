"""Reversible line dedup: exact reference counts of lines, with sharded cuckoo filters in front of them.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z in lower case; keys under `min_chars` code
points are never dropped. `line_counts` holds for each key (a 128-bit hash) in how many documents it is found and the
largest doc_id that holds it. An `Index` is such a table and, for the keys that are common, cuckoo filters by shard.
`Index.insert` and `Index.delete` merge the counts of a batch and insert or delete in the filters the keys that became
common or are so no longer, so that a batch can be taken back. The filters say cheaply "surely not common"; a hit is
confirmed in the exact table.

Defined results: null or empty text is one empty line; each row is a document of its own (repeated rows count again);
rows with a null doc_id count as documents but are never the largest, and if all holders are null the key is kept;
an empty table gives an empty table; other columns pass through. doc_id is cast to long.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches

MIN_CHARS, MIN_DOCS = 40, 5
#: Common keys that fit a broadcast: 24 bytes each in the exact table and up to 12 in the filters, so 18 MB at most.
BROADCAST_KEYS = 500_000
#: Keys of a shard when the filters are built; each filter has room for twice as many, and with more all are built anew.
SHARD_KEYS = 50_000
#: Beyond a broadcast, a shard's filter is sent to so many places, among which documents are dealt, so a common line is no hot key.
SALTS = 16
_STRIP = " \t\n\x0b\f\r"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; supports insertion and deletion. Sized for `capacity` keys at 80% load."""

    SLOTS = 4

    def __init__(self, capacity: int):
        self.size = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.8)))))
        self.table = np.zeros((self.size, self.SLOTS), np.uint16)
        self.stash: list[tuple[int, int]] = []  # keys that found no place: never lost

    @staticmethod
    def _print(hi):
        return (np.asarray(hi, np.int64).view(np.uint64) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)

    def _first(self, hi):
        return (np.asarray(hi, np.int64).view(np.uint64) & np.uint64(self.size - 1)).astype(np.int64)

    def _other(self, bucket, mark):
        return (bucket ^ (np.asarray(mark, np.int64) * 0x5BD1E995)) & (self.size - 1)

    def insert(self, hi: int) -> None:
        mark, bucket = int(self._print(hi)), int(self._first(hi))
        for step in range(500):
            for b in (bucket, int(self._other(bucket, mark))):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = mark
                    return
            bucket = int(self._other(bucket, mark))
            slot = step % self.SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = int(self._other(bucket, mark))
        self.stash.append((bucket, mark))

    def delete(self, hi: int) -> bool:
        mark, bucket = int(self._print(hi)), int(self._first(hi))
        for b in (bucket, int(self._other(bucket, mark))):
            at = np.flatnonzero(self.table[b] == mark)
            if len(at):
                self.table[b, at[0]] = 0
                return True
        for pair in ((bucket, mark), (int(self._other(bucket, mark)), mark)):
            if pair in self.stash:
                self.stash.remove(pair)
                return True
        return False

    def contains(self, hi) -> np.ndarray:
        """Whether each key may be present: never False for an inserted key."""
        mark, bucket = self._print(hi), self._first(hi)
        other = self._other(bucket, mark)
        found = (self.table[bucket] == mark[..., None]).any(-1) | (self.table[other] == mark[..., None]).any(-1)
        for b, m in self.stash:
            found |= ((bucket == b) | (other == b)) & (mark == m)
        return found

    def to_bytes(self) -> bytes:
        stash = [x for pair in self.stash for x in pair]
        return struct.pack(f"<QQ{len(stash)}q", self.size, len(stash), *stash) + self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls(1)
        out.size, n = struct.unpack_from("<QQ", raw)
        stash = struct.unpack_from(f"<{n}q", raw, 16)
        out.stash = [*zip(stash[::2], stash[1::2], strict=True)]
        out.table = np.frombuffer(raw, "<u2", offset=16 + 8 * n).reshape(out.size, cls.SLOTS).astype(np.uint16)
        return out


class ShardedFilter:
    """Cuckoo filters by the low bits of the second half of the key."""

    def __init__(self, shards: int, filters: dict[int, bytes]):
        self.shards, self.filters = shards, {k: CuckooFilter.from_bytes(f) for k, f in filters.items()}

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        which, out = lo & (self.shards - 1), np.zeros(len(hi), bool)
        for k in np.unique(which):
            if k in self.filters:
                out[which == k] = self.filters[k].contains(hi[which == k])
        return out


def _key(line: str, min_chars: int) -> tuple[int, int] | None:
    if len(line) < min_chars or len(key := line.strip(_STRIP)) < min_chars:
        return None
    return _halves(xxhash.xxh3_128_intdigest(key.encode().lower()))  # bytes.lower() touches A-Z only


def _halves(x: int) -> tuple[int, int]:
    hi, lo = x >> 64, x & 0xFFFFFFFFFFFFFFFF
    return hi - (hi >> 63 << 64), lo - (lo >> 63 << 64)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, hi, lo): each document's distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hi, lo = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = {k for line in (text.as_py() or "").split("\n") if (k := _key(line, min_chars))}
                ids += [doc] * len(keys)
                hi += [k[0] for k in keys]
                lo += [k[1] for k in keys]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["doc_id", "hi", "lo"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_batches, run, "doc_id long, hi long, lo long")


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The exact reference counts: (hi, lo, n_docs, last_doc). Map-side sums come before the shuffle, so a very common line is no hot key."""
    return line_keys(docs, min_chars).groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def insert(counts: DataFrame, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Counts after a batch of further documents."""
    return counts.unionByName(line_counts(docs, min_chars)).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def delete(counts: DataFrame, docs: DataFrame, rest: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Counts after a batch is taken out. `rest` is what remains; it is read only for keys whose largest holder goes."""
    gone = line_counts(docs, min_chars).select("hi", "lo", F.col("n_docs").alias("n_gone"), F.col("last_doc").alias("last_gone"))
    left = counts.join(gone, ["hi", "lo"], "left").withColumn("n_docs", F.col("n_docs") - F.coalesce("n_gone", F.lit(0))).where("n_docs > 0")
    open_ = left.where("last_doc = last_gone").select("hi", "lo")
    again = line_keys(rest, min_chars).join(open_, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.max("doc_id").alias("now_last"))
    return left.join(again, ["hi", "lo"], "left").select("hi", "lo", "n_docs", F.when(F.col("last_doc").eqNullSafe(F.col("last_gone")), F.col("now_last")).otherwise(F.col("last_doc")).alias("last_doc"))


def _shard(shards: int) -> Column:
    return F.col("lo").bitwiseAND(F.lit(shards - 1).cast("long"))


_FILTERS = "shard long, filter binary"


def update_filters(filters: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) after the keys of changes (hi, lo, add) are inserted or deleted; a shard's filter and its changes meet in one task."""
    rows = changes.select(_shard(shards).alias("shard"), F.lit(1).alias("kind"), "hi", "add", F.lit(None).cast("binary").alias("filter"))
    if filters is not None:
        rows = rows.unionByName(filters.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast("boolean").alias("add"), "filter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = None, None

        def done():
            return pa.record_batch([pa.array([shard], pa.int64()), pa.array([own.to_bytes()], pa.binary())], ["shard", "filter"])

        for batch in batches:
            for k, kind, hi, add, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != shard:
                    if own is not None:
                        yield done()
                    shard, own = k, CuckooFilter(2 * SHARD_KEYS) if kind else None
                if not kind:
                    own = CuckooFilter.from_bytes(raw)
                elif add:
                    own.insert(hi)
                else:
                    own.delete(hi)
        if own is not None:
            yield done()

    return rows.repartition("shard").sortWithinPartitions("shard", "kind").transform(map_batches, run, _FILTERS)


@dataclass
class Index:
    """Exact reference counts and the filters over the common keys."""

    counts: DataFrame  # hi, lo, n_docs, last_doc
    filters: DataFrame  # shard, filter
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def build(cls, counts: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> Index:
        """From counts that are a written table (they are read more than once)."""
        common = counts.where((F.col("n_docs") >= min_docs) & F.col("last_doc").isNotNull())
        shards = 1 << max(0, int(np.ceil(np.log2(max(1, common.count()) / SHARD_KEYS))))
        filters = cut(update_filters(None, common.select("hi", "lo", F.lit(True).alias("add")), shards), "line-filters")
        return cls(counts, filters, shards, min_chars, min_docs)

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> Index:
        return cls.build(cut(line_counts(docs, min_chars), "line-counts"), min_chars, min_docs)

    def common(self) -> DataFrame:
        return self.counts.where((F.col("n_docs") >= self.min_docs) & F.col("last_doc").isNotNull()).select("hi", "lo", "last_doc")

    def _after(self, counts: DataFrame, batch: DataFrame) -> Index:
        new = Index(cut(counts, "line-counts"), self.filters, self.shards, self.min_chars, self.min_docs)
        if new.common().count() > 2 * SHARD_KEYS * self.shards:
            return Index.build(new.counts, self.min_chars, self.min_docs)
        touched = line_counts(batch, self.min_chars).select("hi", "lo")
        was, now = (x.common().select("hi", "lo", F.lit(True).alias(name)) for x, name in ((self, "was"), (new, "now")))
        changes = touched.join(was, ["hi", "lo"], "left").join(now, ["hi", "lo"], "left").where("NOT (was <=> now)").select("hi", "lo", F.col("now").isNotNull().alias("add"))
        new.filters = cut(update_filters(self.filters, changes, self.shards), "line-filters")
        return new

    def insert(self, docs: DataFrame) -> Index:
        """The index after a batch of further documents."""
        return self._after(insert(self.counts, docs, self.min_chars), docs)

    def delete(self, docs: DataFrame, rest: DataFrame) -> Index:
        """The index after a batch is taken out; `rest` is what remains."""
        return self._after(delete(self.counts, docs, rest, self.min_chars), docs)

    def sieve(self, keys: DataFrame) -> DataFrame:
        """The rows (doc_id, hi, lo) of keys that the filters let through: each shard's filter meets its keys."""
        empty = {c: F.lit(None).cast("long").alias(c) for c in ("doc_id", "hi", "lo")}
        salted = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), *empty.values(), "filter")
        asked = keys.select(_shard(self.shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), "doc_id", "hi", "lo", F.lit(None).cast("binary").alias("filter"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, own = None, None
            for batch in batches:
                place = batch.column(0).to_numpy() * SALTS + batch.column(1).to_numpy()
                full = np.flatnonzero(batch.column(5).is_valid().to_numpy(zero_copy_only=False))
                cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
                filters = {int(place[k]): k for k in full}
                keep = np.zeros(batch.num_rows, bool)
                hi = batch.column(3).fill_null(0).to_numpy()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if place[a] != at:
                        at, own = int(place[a]), None
                    if at in filters:
                        own = CuckooFilter.from_bytes(batch.column(5)[filters[at]].as_py())
                    if own is not None:
                        keep[a:b] = own.contains(hi[a:b])
                keep[full] = False
                yield batch.select([2, 3, 4]).filter(pa.array(keep))

        rows = salted.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        return rows.transform(map_batches, run, "doc_id long, hi long, lo long")


def _cut_down(lines: list[str], gone: set[int]) -> list[str]:
    return [line for j, line in enumerate(lines) if j not in gone] if gone else lines


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_keys: int = BROADCAST_KEYS, index: Index | None = None, names_of_counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with `text` cut down, and two counts added at the end; columns of docs that bear their names are replaced.

    Common keys up to broadcast_keys go to the workers as cuckoo filters with the exact table behind them, and the documents
    are rewritten in place without a shuffle. Beyond that bound the filters stay where they are: the documents' keys go
    to them by shard, what they let through is joined with the exact table, and the hits are joined to the documents.
    """
    if index:
        common = cut(index.common(), "lines")
    else:  # the other keys' counts are not kept
        own = line_counts(docs, min_chars).where((F.col("n_docs") >= min_docs) & F.col("last_doc").isNotNull())
        index = Index.build(cut(own, "lines"), min_chars, min_docs)
        common = index.common()
    min_chars = index.min_chars
    docs = docs.drop(*names_of_counts)
    names, fields = docs.columns, [*docs.schema.fields]
    out = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in names_of_counts)])
    at_text, at_id = names.index("text"), names.index("doc_id")

    def made(batch: pa.RecordBatch, split: list[list[str]], gone: list[set[int]]) -> pa.RecordBatch:
        kept = [_cut_down(lines, own) for lines, own in zip(split, gone, strict=True)]
        columns = [pa.array(["\n".join(x) for x in kept], batch.column(at_text).type) if k == at_text else c for k, c in enumerate(batch.columns[: len(names)])]
        counts = [pa.array([len(x) for x in split], pa.int64()), pa.array([len(x) - len(y) for x, y in zip(split, kept, strict=True)], pa.int64())]
        return pa.record_batch([*columns, *counts], [*names, *names_of_counts])

    if common.count() <= broadcast_keys:
        rows = common.toPandas().sort_values("hi")
        hi, lo, last = (rows[c].to_numpy(np.int64) for c in ("hi", "lo", "last_doc"))
        sieve = ShardedFilter(index.shards, {r["shard"]: bytes(r["filter"]) for r in index.filters.collect()})
        table = docs.sparkSession.sparkContext.broadcast((sieve, hi, lo, last))

        def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sieve, hi, lo, last = table.value
            for batch in batches:
                split, flat, owner, seen = [], [], [], []
                for k, (text, doc) in enumerate(zip(batch.column(at_text), batch.column(at_id).to_pylist(), strict=True)):
                    lines = (text.as_py() or "").split("\n")
                    split.append(lines)
                    for j, line in enumerate(lines):
                        if key := _key(line, min_chars):
                            flat.append(key)
                            owner.append((k, j))
                            seen.append(None if doc is None else int(doc))
                gone: list[set[int]] = [set() for _ in split]
                if flat and len(hi):
                    keys = np.array(flat, np.int64)
                    for x in np.flatnonzero(sieve.contains(keys[:, 0], keys[:, 1])):
                        at = int(np.searchsorted(hi, keys[x, 0]))
                        while at < len(hi) and hi[at] == keys[x, 0]:  # the exact table decides
                            if lo[at] == keys[x, 1] and (seen[x] is None or last[at] != seen[x]):
                                gone[owner[x][0]].add(owner[x][1])
                            at += 1
                yield made(batch, split, gone)

        return docs.transform(map_batches, in_place, out)

    drops = index.sieve(line_keys(docs, min_chars)).join(common, ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    drops = drops.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("_drop"))
    joined = docs.alias("d").join(drops.withColumnRenamed("doc_id", "_drop_id").alias("x"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("_drop_id")), "left").select("d.*", F.col("x._drop"))

    def joined_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(t.as_py() or "").split("\n") for t in batch.column(at_text)]
            own = [{(x["hi"], x["lo"]) for x in keys or ()} for keys in batch.column(len(names)).to_pylist()]
            yield made(batch, split, [{j for j, line in enumerate(lines) if _key(line, min_chars) in keys} if keys else set() for lines, keys in zip(split, own, strict=True)])

    return joined.transform(map_batches, joined_in, out)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, pos, line, c.k IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed LEFT JOIN common c USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
