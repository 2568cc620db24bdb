"""Byte-level BPE with ranked merges as a fold of Spark's higher-order functions.

1. Each task splits its texts into the pattern's matches and hands on its distinct words; Spark counts the tasks of each. Words
   of two tasks or more, the most widespread first and SHARED at most, are folded once and broadcast (24 bytes and
   4 a token each at most).
2. The texts are split again. Words that are not in the broadcast table get numbers, and Spark folds them in their task:
   a word of one task is so folded once as well, and what lies beyond SHARED costs time, never a result.
3. The documents' numbers become ids, and ids are decoded by concatenating the tokens' binary pieces.

The fold goes over the byte array of a word, with the ranks in a literal map (hashed into MAP_SLOTS small maps, so that a
lookup is no scan). It takes a step for each possible merge: the leftmost pair of least rank is joined, and only the ranks
beside it are looked up again. Its cost is quadratic, so a match of more than LONG bytes is first cut where no token of the
vocabulary that stands in the text crosses: no merge can. Only a stretch over FOLD bytes without such a place (a run of
one letter, say) is merged with a heap, to the same result.

Defined results: null and empty texts have no tokens; repeated rows give a row each; special tokens are ordinary text; an
empty table gives an empty table. doc_id is cast to long.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, map_batches, span_hashes
from .pieces import Known, numbered, split

MAP_SLOTS, LONG, FOLD = 1 << 13, 256, 1024
#: Words that are folded once for all tasks, at most: 24 bytes and 4 a token each.
SHARED = 1_500_000
#: Words that a task remembers; then it starts to number anew.
MEMORY = 2_000_000
#: Words that one task folds of the shared ones.
_FOLDS = 16_384
#: Bytes of text in a row between the passes, so that its arrays in the JVM and in Python stay small.
_CHUNK = 1 << 17
_NONE = 2147483647
#: More than a word's places; beside a rank it makes a number of less than 64 bits.
_PLACES = 1 << 20


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank" that each worker has at `path`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """A literal array of maps from hex to rank; the slot is xxhash64 of the bytes."""
    slots: list[dict[str, int]] = [{} for _ in range(MAP_SLOTS)]
    for token, rank in ranks.items():
        slots[xxhash.xxh64_intdigest(token, seed=42) & (MAP_SLOTS - 1)][token.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def _rank(table: Column, token: Column) -> Column:
    return F.coalesce(F.element_at(F.get(table, F.xxhash64(token).bitwiseAND(MAP_SLOTS - 1).cast("int")), F.hex(token)), F.lit(_NONE))


def fold(word: Column, table: Column) -> Column:
    """The ids of one word (binary)."""
    one = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)).cast("binary"))
    first = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: _rank(table, F.substring(word, i, F.lit(2)).cast("binary")))

    def step(state: Column, _: Column) -> Column:
        # rank and place in one number (array_position is slow)
        least = F.array_min(F.transform(state["r"], lambda r, i: r.cast("long") * _PLACES + i))

        def join(k: Column) -> Column:  # k: the pair's place, from 1
            joined = F.concat(F.get(state["p"], k - 1), F.get(state["p"], k))

            def rebuilt(x: Column) -> Column:
                none = F.array().cast("array<int>")
                before = F.when(k > 1, F.concat(F.slice(state["r"], 1, F.greatest(k - 2, F.lit(0))), F.array(_rank(table, F.concat(F.get(state["p"], k - 2), x))))).otherwise(none)
                after = F.when(k + 1 < F.size(state["p"]), F.concat(F.array(_rank(table, F.concat(x, F.get(state["p"], k + 1)))), F.slice(state["r"], k + 2, F.size(state["r"])))).otherwise(none)
                pieces = F.concat(F.slice(state["p"], 1, k - 1), F.array(x), F.slice(state["p"], k + 2, F.size(state["p"])))
                return F.struct(pieces.alias("p"), F.concat(before, after).alias("r"))

            return F.get(F.transform(F.array(joined), rebuilt), F.lit(0))

        def merged(m: Column) -> Column:
            return F.when(F.coalesce(m, F.lit(_NONE * _PLACES)) >= _NONE * _PLACES, state).otherwise(join((m % _PLACES + 1).cast("int")))

        return F.get(F.transform(F.array(least), merged), F.lit(0))

    many = F.aggregate(F.sequence(F.lit(2), F.length(word)), F.struct(one.alias("p"), first.alias("r")), step, lambda s: s["p"])
    pieces = F.when((F.length(word) == 1) | (_rank(table, word) != _NONE), F.array(word)).otherwise(many)
    return F.transform(pieces, lambda x: _rank(table, x))


def merge_long(word: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """The same merges with a heap, for words of any length; `whole` looks the word itself up first."""
    if whole and word in ranks:
        return [ranks[word]]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            pair = parts[i] + parts[after[i]]
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(heap, (r, i, len(pair)))

    while heap:
        _, i, length = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j < 0 or len(parts[i]) + len(parts[j]) != length:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


@functools.lru_cache(maxsize=2)
def _starts(path: str) -> frozenset[bytes]:
    """All that a token begins with."""
    return frozenset(t[:k] for t in load_ranks(path) for k in range(1, len(t) + 1))


def cuts(word: bytes, path: str) -> list[int]:
    """Places inside a word that no merge crosses: no token that stands in the word covers them. [] if the parts would not give the word's ids."""
    ranks, starts = load_ranks(path), _starts(path)
    out, reach = [], 0
    for at in range(len(word)):
        if at and reach <= at:
            out.append(at)
        n = 1
        while at + n <= len(word) and (part := word[at : at + n]) in starts:
            if part in ranks:
                reach = max(reach, at + n)
            n += 1
    parts = [word[a:b] for a, b in zip([0, *out], [*out, len(word)], strict=True)]
    # a part that is a token of its own must also come about by merges
    return out if all(len(p) == 1 or p not in ranks or merge_long(p, ranks, False) == [ranks[p]] for p in parts) else []


def _words(data: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pieces.split, with long words cut."""
    starts, ends, hashes, piece_offs = split(data, offs)
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        raw = data.tobytes()
        more, at = [], []
        for p in long.tolist():
            if raw[starts[p] : ends[p]] in load_ranks(path):
                continue
            found = [int(starts[p]) + x for x in cuts(raw[starts[p] : ends[p]], path)]
            more += found
            at += [p + 1] * len(found)
        if more:
            starts = np.insert(starts, at, more)
            ends = np.insert(ends, np.array(at) - 1, more)
            piece_offs = piece_offs + np.searchsorted(np.array(at), piece_offs, "right")
            hashes = span_hashes(data, starts, ends)
    return starts, ends, hashes, piece_offs


def _distinct(path: str, memory: int):
    """The distinct words of a task, but those that only the heap can merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = Known(np.zeros(0, np.uint64), np.zeros(0, np.int8)), 0
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0), _CHUNK):
                starts, ends, hashes, _ = _words(data, offs, path)
                if n > memory:
                    known.clear()
                    n = 0
                new = []

                def add(places, data=data, starts=starts, ends=ends, new=new):
                    raw = data.tobytes()
                    new += [raw[starts[p] : ends[p]] for p in places if ends[p] - starts[p] <= FOLD]
                    return np.zeros(len(places), np.int64)

                numbered(hashes, known, add)
                n += len(new)
                if new:
                    yield pa.record_batch([pa.array(new, pa.binary())], ["word"])

    return run


def _bound(column, table: Column) -> Column:
    """column(map) with the literal map bound once, so that plans and workers hold one copy of it."""
    return F.get(F.transform(F.array(table), column), F.lit(0))


def shared_words(docs: DataFrame, rank_file: str, table: Column, most: int = SHARED, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, tokens by word, where they start in ids, ids) of the words of two tasks or more, in ascending order of the hashes, `most` at most."""
    seen = docs.select("text").transform(map_batches, _distinct(rank_file, memory), "word binary").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seen = cut(seen.where("n > 1").select("word", F.least("n", F.lit(4096)).alias("n")), "bpe-words")
    least, words = 1 << 30, 0
    for n, count in sorted((tuple(r) for r in seen.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True):
        if words + count > most:
            break
        least, words = n, words + count
    if not words:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.uint32) for _ in range(3))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            ends = np.cumsum(pa.compute.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
            keys = span_hashes(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1]]), ends)
            order = np.argsort(keys)
            own = batch.column(1).take(pa.array(order))
            parts = (keys[order], pa.compute.list_value_length(own).to_numpy().astype(np.uint32), own.flatten().to_numpy().astype(np.uint32))
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in parts], ["keys", "counts", "ids"])

    # few words take long to fold, so they are dealt out by their number, not by their bytes
    chosen = seen.where(F.col("n") >= least).select("word").repartition(words // _FOLDS + 1)
    rows = chosen.select("word", _bound(lambda t: fold(F.col("word"), t), table).alias("ids")).transform(map_batches, pack, "keys binary, counts binary, ids binary").collect()
    keys, counts, ids = (np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in (("keys", np.uint64), ("counts", np.uint32), ("ids", np.uint32)))
    order = np.argsort(keys)
    starts = np.cumsum(counts) - counts
    least = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return keys[order], least(counts[order]), least(starts[order]), least(ids)


def _split(path: str, shared, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        known = Known(keys, np.arange(len(keys), dtype=np.int32))
        n = len(keys)
        for batch in batches:
            for at, to, data, offs in chunks(batch.column(1), _CHUNK):
                starts, ends, hashes, piece_offs = _words(data, offs, path)
                if n > memory + len(keys):
                    known.clear()
                    n = len(keys)
                base, new = n, []

                def add(places, data=data, starts=starts, ends=ends, new=new, base=base):
                    raw = data.tobytes()
                    numbers = range(base + len(new), base + len(new) + len(places))
                    new += [raw[starts[p] : ends[p]] for p in places]
                    return numbers

                numbers = numbered(hashes, known, add)
                n += len(new)
                yield pa.record_batch(
                    [
                        pa.array([batch.column(0).slice(at, to - at).to_pylist()], pa.list_(pa.int64())),
                        pa.array([piece_offs.astype(np.int64).tobytes()], pa.binary()),
                        pa.array([numbers.astype(np.int32).tobytes()], pa.binary()),
                        pa.array([base], pa.int64()),
                        pa.array([[w if len(w) <= FOLD else None for w in new]], pa.list_(pa.binary())),
                        pa.array([[w for w in new if len(w) > FOLD]], pa.list_(pa.binary())),
                    ],
                    ["ids", "offs", "numbers", "base", "words", "long"],
                )

    return run


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """array, or a longer copy that has n places."""
    if n <= len(array):
        return array
    out = np.zeros(max(n, len(array) + len(array) // 2), array.dtype)
    out[: len(array)] = array
    return out


class _Store:
    """Flat values by number, with their starts and lengths; slices of many numbers are gathered at once.

    The first numbers may be given as (lengths, starts, values), which are read where they are and never copied."""

    def __init__(self, kind, given: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.given = given or tuple(np.zeros(0, np.int64) for _ in range(3))
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.n = self.used = 0

    def reset(self, n: int) -> None:
        """Forget all but the first n, and never what was given."""
        n -= len(self.given[0])
        if n < self.n:
            self.used = int(self.starts[n])  # numbers after the given ones lie in order
            self.n = n

    def append(self, values: np.ndarray, lengths: np.ndarray) -> None:
        """Values of the next numbers, one after the other."""
        n = self.n + len(lengths)
        self.flat, self.starts, self.lengths = _room(self.flat, self.used + len(values)), _room(self.starts, n), _room(self.lengths, n)
        self.flat[self.used : self.used + len(values)] = values
        self.lengths[self.n : n] = lengths
        self.starts[self.n : n] = self.used + (np.cumsum(lengths) - lengths)
        self.n, self.used = n, self.used + len(values)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = len(self.given[0])
        lengths, parts = np.zeros(len(numbers), np.int64), []
        for places, less, (sizes, starts, flat) in ((np.flatnonzero(numbers < first), 0, self.given), (np.flatnonzero(numbers >= first), first, (self.lengths, self.starts, self.flat))):
            own = numbers[places] - less
            lengths[places] = sizes[own]
            parts.append((places, starts[own].astype(np.int64), flat))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(ends[-1], self.flat.dtype)
        for places, starts, flat in parts:
            sizes = lengths[places]
            before = np.cumsum(sizes) - sizes
            step = np.arange(sizes.sum())
            out[np.repeat(ends[places] - before, sizes) + step] = flat[np.repeat(starts - before, sizes) + step]
        return out, ends


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> "_Store":
    """The tokens' binary pieces by id."""
    ranks = load_ranks.__wrapped__(path)  # not kept: workers live long, and few need the ranks
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    out = _Store(np.uint8)
    out.append(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64))
    return out


def _assemble(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens = _Store(np.uint32, shared.value), _tokens(path)
        for batch in batches:
            for row in range(batch.num_rows):
                ids.reset(batch.column(3)[row].as_py())
                made = batch.column(4)[row].values
                if made is not None and len(made):
                    if made.null_count:
                        long = iter(batch.column(5)[row].as_py())
                        made = pa.array([x if x is not None else merge_long(next(long), load_ranks(path)) for x in made.to_pylist()], pa.list_(pa.int32()))
                    ids.append(made.flatten().to_numpy().astype(np.uint32), pa.compute.list_value_length(made).to_numpy())
                offs = np.frombuffer(batch.column(1)[row].as_py(), np.int64)
                flat, ends = ids.gather(np.frombuffer(batch.column(2)[row].as_py(), np.int32).astype(np.int64))
                at = ends[offs]
                text, text_ends = tokens.gather(flat.astype(np.int64))
                text_at = text_ends[at]
                yield pa.record_batch(
                    [
                        batch.column(0)[row].values,
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([flat[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                        pa.array([text[a:b].tobytes() for a, b in zip(text_at[:-1], text_at[1:], strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return run


def encode_and_decode(docs: DataFrame, rank_file: str, shared: int = SHARED, memory: int = MEMORY) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, binary) and decoded (binary) of each row of docs."""
    table = rank_map(load_ranks(rank_file))
    keys, *words = shared_words(docs, rank_file, table, shared, memory)
    give = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_batches, _split(rank_file, give(keys), memory), "ids array<long>, offs binary, numbers binary, base long, words array<binary>, long array<binary>")
    folded = _bound(lambda t: F.transform("words", lambda w: F.when(w.isNotNull(), fold(w, t))), table)
    return rows.select("ids", "offs", "numbers", "base", folded.alias("words"), "long").transform(map_batches, _assemble(rank_file, give(tuple(words))), "doc_id long, n_tokens long, ids binary, decoded binary")


def op8_higher_order_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
