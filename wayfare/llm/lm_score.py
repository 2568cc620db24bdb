"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Documents are packed into containers of about CONTAINER bytes. A container's distinct words go, as sorted arrays cut by the
top bits of their hashes, to shards that add up the exact counts of the training documents and answer each container; one
row is an array, so the shuffle moves 8 bytes for a word of a container instead of a row for each word of a document, and a
word that stands in every document is one entry of each container.

Word pairs are counted in the same way, and each shard makes its block of the filter: a pair with count c goes in at the
levels 1 to 1 + floor(log_BASE(c)). A look-up probes the levels in turn until one is absent, which gives the quantised
count (never under the true level; at most the counts of the two words, which are exact). The blocks have FILTER_BYTES in all
at first and grow to at least BITS bits for each entry, so that every pair goes in at every size of the input; a block stays
in its shard's task, which answers the containers. The model: P(w | v) = (c(v, w) + MU P(w)) / (c(v) + MU), with
P(w) = (c(w) + 1) / (N + V + 1).

Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then one end; the first word follows an end. Words and pairs are
told apart by 64-bit and 46-bit hashes. Defined results: null and empty texts are an end alone; repeated rows give a
row each; without training rows N and V are 0; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_mod, cut, map_batches, mix, words

CONTAINER = 8 << 20
#: Shards are 2 to the power of some number of bits: about as many as there are containers, so that a shard's arrays stay small.
LEAST_BITS = 6
FILTER_BYTES, BITS, PROBES = 32 << 20, 9, 4
#: Pairs that a shard looks up at a time.
LOOK = 1 << 20
BASE, MU = 1.7, 60.0
END = np.uint64(0xE0D0C0B0A0908071)
_PAIR_BITS = 40


def pack(docs: DataFrame, training: Column) -> DataFrame:
    """Containers: chunk (a number of its own), doc_ids, training flags, offsets and the compressed bytes of the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), training.alias("_training"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0
        press = zstandard.ZstdCompressor(level=3)

        def row():
            offs = np.concatenate([[0], np.cumsum(np.concatenate([h[2] for h in held]))])
            body = press.compress(b"".join(h[3] for h in held))
            values = [[at], [sum((h[0] for h in held), [])], [sum((h[1] for h in held), [])], [offs.astype(np.int64).tobytes()], [body]]
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, _KINDS, strict=True)], _NAMES)

        for batch in batches:
            for a, b, data, offs in chunks(batch.column(2)):
                held.append((batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), np.diff(offs), data.tobytes()))
                size += len(data) + 64 * (b - a)
                if size >= CONTAINER:
                    yield row()
                    held, size, at = [], 0, at + 1
        if held:
            yield row()

    return rows.transform(map_batches, run, "chunk long, doc_ids array<long>, training array<boolean>, offs binary, body binary")


_NAMES = ["chunk", "doc_ids", "training", "offs", "body"]
_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]


def _tokens(offs: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, token offsets by document) of a container, an end after each document."""
    offs = np.frombuffer(offs, np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, int(offs[-1]))), np.uint8) if offs[-1] else np.zeros(0, np.uint8)
    hashes, counts, at = [], [], 0
    n = len(offs) - 1
    while at < n:
        to = max(at + 1, min(int(np.searchsorted(offs, offs[at] + (1 << 20), "right")) - 1, n))
        _, _, h, word_offs = words(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        hashes.append(np.insert(h, word_offs[1:], END))
        counts.append(np.diff(word_offs) + 1)
        at = to
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _previous(hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = np.empty_like(hashes)
    out[1:] = hashes[:-1]
    out[offs[:-1]] = END
    return out


def _pairs(before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix((before ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes, 5)


def shard_bits(containers: DataFrame) -> int:
    """Bits of a shard's number. A container has a row for each shard that its words fall into, so at most one for each of its
    words, however many shards there are; a pair's key has _PAIR_BITS bits beside these."""
    return min(64 - _PAIR_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, containers.count()))))))


def _shards(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard begins in sorted keys."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _in_training(training: list[bool], offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.array(training, bool), np.diff(offs))


def _word_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(shard, chunk, keys, counts): a container's distinct words by shard, with their counts in its training documents."""
    for batch in batches:
        for row in batch.to_pylist():
            hashes, offs = _tokens(row["offs"], row["body"])
            keys, places = np.unique(hashes, return_inverse=True)
            counts = np.bincount(places[_in_training(row["training"], offs)], minlength=len(keys)).astype(np.uint32)
            ends = _shards(keys, bits)
            own = np.flatnonzero(np.diff(ends))
            cuts = [slice(ends[s], ends[s + 1]) for s in own]
            yield pa.record_batch([pa.array(own, pa.int32()), pa.array([row["chunk"]] * len(own), pa.int64()), pa.array([keys[c].tobytes() for c in cuts], pa.binary()), pa.array([counts[c].tobytes() for c in cuts], pa.binary())], ["shard", "chunk", "keys", "counts"])


def _pair_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(shard, chunk, keys, counts): a container's distinct word pairs, with their counts in its training documents; a key's five bytes follow its shard's bits."""
    for batch in batches:
        for row in batch.to_pylist():
            hashes, offs = _tokens(row["offs"], row["body"])
            pairs = _pairs(_previous(hashes, offs), hashes)
            keys, places = np.unique(pairs >> np.uint64(64 - bits - _PAIR_BITS), return_inverse=True)
            counts = np.bincount(places[_in_training(row["training"], offs)], minlength=len(keys))
            ends = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(_PAIR_BITS))
            short = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _PAIR_BITS // 8]
            own = np.flatnonzero(np.diff(ends))
            # columns of bytes: the high ones of sorted keys compress well
            yield pa.record_batch(
                [pa.array(own, pa.int32()), pa.array([row["chunk"]] * len(own), pa.int64()), pa.array([short[ends[s] : ends[s + 1]].T.tobytes() for s in own], pa.binary()), pa.array([zstandard.compress(counts[ends[s] : ends[s + 1]].astype(np.uint32).tobytes(), 1) for s in own], pa.binary())],
                ["shard", "chunk", "keys", "counts"],
            )


class _Sum:
    """Adds up (keys, counts) arrays; memory follows the distinct keys, not the arrays that pass."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.held = self.base = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if not len(keys):
            return
        self.parts.append((keys, counts.astype(np.uint64)))
        self.held += len(keys)
        if self.held > 2 * self.base + 1_000_000:
            self.base = self.held = len(self.total()[0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(self.parts) > 1:
            keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts = [(keys[first], np.add.reduceat(counts, first))]
        return self.parts[0]


def _by_shard(batches: Iterator[pa.RecordBatch], read, done) -> Iterator[pa.RecordBatch]:
    """Feed read(sum, row) with rows that come sorted by shard; done(shard, sum) makes a batch for each."""
    shard, total = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != shard:
                if total is not None:
                    yield done(shard, total)
                shard, total = row["shard"], _Sum()
            read(total, row)
    if total is not None:
        yield done(shard, total)


def vocabulary(containers: DataFrame, bits: int) -> DataFrame:
    """(shard, keys, counts, n_tokens, n_words): the exact counts of the training words."""

    def read(total, row):
        total.add(np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.uint32))

    def done(shard, total):
        keys, counts = total.total()
        keys, counts = keys[counts > 0], counts[counts > 0]
        values = [shard, keys.tobytes(), counts.tobytes(), int(counts.sum()), len(keys)]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["shard", "keys", "counts", "n_tokens", "n_words"])

    rows = containers.transform(map_batches, lambda batches: _word_rows(batches, bits), "shard int, chunk long, keys binary, counts binary").repartition("shard").sortWithinPartitions("shard")
    return rows.transform(map_batches, lambda batches: _by_shard(batches, read, done), "shard int, keys binary, counts binary, n_tokens long, n_words long")


def levels(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9)).astype(np.int64)


class Filter:
    """A log-frequency Bloom filter: one block of bits for each shard, which grows with its entries."""

    def __init__(self, blocks: dict[int, bytes], bits: int):
        self.blocks, self.shard_bits = blocks, bits

    @staticmethod
    def place(keys: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
        h = mix(keys + np.uint64(level * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF), 21)
        return ((h & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)

    @classmethod
    def block(cls, keys: np.ndarray, counts: np.ndarray, shard_bits: int) -> bytes:
        """A shard's block with all its pairs: its part of FILTER_BYTES, or as much more as BITS bits for each entry ask for.

        The first byte is the greatest level, at most 84 for counts of 64 bits.
        """
        level = levels(counts)
        bits = 8 * FILTER_BYTES >> shard_bits
        while bits < level.sum() * BITS:
            bits *= 2
        out = np.zeros(bits, bool)
        top = int(level.max(initial=0))
        for q in range(1, top + 1):
            for k in range(PROBES):
                out[cls.place(keys[level >= q], q, k, bits)] = True
        return bytes([top]) + np.packbits(out, bitorder="little").tobytes()

    @classmethod
    def look(cls, block: bytes, keys: np.ndarray) -> np.ndarray:
        """The level of each key in its shard's block, 0 for absent ones, by repeated probes."""
        data = np.frombuffer(block, np.uint8, offset=1)
        level = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        for q in range(1, block[0] + 1):
            for k in range(PROBES):  # each probe looks only at those that the ones before found
                place = cls.place(keys[live], q, k, 8 * len(data))
                live = live[(data[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            level[live] = q
            if not len(live):
                break
        return level

    @staticmethod
    def least(level: np.ndarray) -> np.ndarray:
        """The least count of each level."""
        return np.where(level > 0, np.ceil(BASE ** (np.maximum(level, 1) - 1.0) - 1e-9), 0)

    def count(self, pairs: np.ndarray) -> np.ndarray:
        """The least count of each pair's level, 0 for absent ones."""
        keys = pairs >> np.uint64(64 - self.shard_bits - _PAIR_BITS)
        shard, keys = keys >> np.uint64(_PAIR_BITS), keys & np.uint64((1 << _PAIR_BITS) - 1)
        level = np.zeros(len(pairs), np.int64)
        for s, block in self.blocks.items():
            of = np.flatnonzero(shard == np.uint64(s))
            level[of] = self.look(block, keys[of])
        return self.least(level)


def _pair_keys(columns: bytes) -> np.ndarray:
    short = np.frombuffer(columns, np.uint8).reshape(_PAIR_BITS // 8, -1).T
    keys = np.zeros((len(short), 8), np.uint8)
    keys[:, : _PAIR_BITS // 8] = short
    return keys.view("<u8").ravel()


def _pair_answers(containers: DataFrame, bits: int) -> DataFrame:
    """(chunk, shard, counts): for each container and shard, the levels of its pairs in the filter, in the order of their keys.

    A shard sums the counts of the training documents' pairs into its block and looks up what each container asks. There are
    about as many shards as containers, so the keys that it holds meanwhile are about those of one container.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, total, held = None, _Sum(), []

        def answers():
            if not held:
                return
            block = Filter.block(*total.total(), bits)
            at = 0
            while at < len(held):
                to, size = at, 0
                while to < len(held) and (to == at or size < LOOK):
                    size += len(held[to][1]) // (_PAIR_BITS // 8)
                    to += 1
                keys = [_pair_keys(h[1]) for h in held[at:to]]
                found = np.split(Filter.look(block, np.concatenate(keys)).astype(np.uint8), np.cumsum([len(k) for k in keys])[:-1])
                yield pa.record_batch([pa.array([h[0] for h in held[at:to]], pa.int64()), pa.array([shard] * (to - at), pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in found], pa.binary())], ["chunk", "shard", "counts"])
                at = to

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    yield from answers()
                    shard, total, held = row["shard"], _Sum(), []
                counts = np.frombuffer(zstandard.decompress(row["counts"]), np.uint32)
                total.add(_pair_keys(row["keys"])[counts > 0], counts[counts > 0])
                held.append((row["chunk"], row["keys"]))
        yield from answers()

    rows = containers.transform(map_batches, lambda batches: _pair_rows(batches, bits), "shard int, chunk long, keys binary, counts binary").repartition("shard").sortWithinPartitions("shard")
    return rows.transform(map_batches, run, "chunk long, shard int, counts binary")


def _answers(containers: DataFrame, vocab: DataFrame, bits: int) -> DataFrame:
    """(chunk, shard, counts): for each container and shard, the counts of its words, in the order of their hashes."""
    asked = containers.transform(map_batches, lambda batches: _word_rows(batches, bits), "shard int, chunk long, keys binary, counts binary").select("shard", "chunk", "keys", F.lit(None).cast("binary").alias("counts"))
    known = vocab.select("shard", F.lit(-1).cast("long").alias("chunk"), "keys", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, keys, counts = row["shard"], np.zeros(0, np.uint64), np.zeros(0, np.uint64)
                asked = np.frombuffer(row["keys"], np.uint64)
                if row["chunk"] < 0:
                    keys, counts = asked, np.frombuffer(row["counts"], np.uint64)
                    continue
                at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
                found = np.where(keys[at] == asked, counts[at], 0) if len(keys) else np.zeros(len(asked))
                yield pa.record_batch([pa.array([row["chunk"]]), pa.array([shard], pa.int32()), pa.array([found.astype(np.uint64).tobytes()], pa.binary())], ["chunk", "shard", "counts"])

    rows = known.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "chunk")
    return rows.transform(map_batches, run, "chunk long, shard int, counts binary")


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    containers = cut(pack(docs, training), "containers")
    bits = shard_bits(containers)
    vocab = cut(vocabulary(containers, bits), "vocabulary")
    n, v = vocab.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    none = F.lit(None)
    # by shard: the answers about words, those about pairs, the container
    answers = _answers(containers, vocab, bits).unionByName(_pair_answers(containers, bits).withColumn("shard", F.col("shard") + F.lit(1 << bits)))
    told = answers.select("chunk", "shard", "counts", none.cast("array<long>").alias("doc_ids"), none.cast("array<boolean>").alias("training"), none.cast("binary").alias("offs"), none.cast("binary").alias("body"))
    whole = containers.select("chunk", F.lit(2 << bits).alias("shard"), none.cast("binary").alias("counts"), "doc_ids", "training", "offs", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        found: list[np.ndarray] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                if row["body"] is None:  # the shards' answers come before their container
                    if row["shard"] < 1 << bits:
                        parts.append(np.frombuffer(row["counts"], np.uint64))
                    else:
                        found.append(np.frombuffer(zstandard.decompress(row["counts"]), np.uint8))
                    continue
                hashes, offs = _tokens(row["offs"], row["body"])
                _, places = np.unique(hashes, return_inverse=True)
                counts = np.concatenate(parts)[places].astype(np.float64)
                _, places = np.unique(_pairs(_previous(hashes, offs), hashes) >> np.uint64(64 - bits - _PAIR_BITS), return_inverse=True)
                level = np.concatenate(found)[places].astype(np.int64)
                parts, found = [], []
                base = (counts + 1) / (n + v + 1)
                before = np.empty_like(counts)
                before[1:] = counts[:-1]
                # the count of what comes before a document's first word is that of the end
                before[offs[:-1]] = counts[offs[1:] - 1]
                pairs = np.minimum(Filter.least(level), np.minimum(before, counts))
                model = (pairs + MU * base) / (before + MU)
                sums = [np.add.reduceat(x, offs[:-1]) for x in (np.log10(base), np.log10(model), (counts > 0).astype(np.int64))]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["training"], pa.bool_()), pa.array(np.diff(offs), pa.int64()), pa.array(sums[2], pa.int64()), pa.array(np.full(len(offs) - 1, n), pa.int64()), pa.array(sums[0]), pa.array(sums[1])]
                yield pa.record_batch(columns, ["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = told.unionByName(whole).repartition("chunk").sortWithinPartitions("chunk", "shard")
    return rows.transform(map_batches, run, "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_log_frequency_bloom_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, crc_mod(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

