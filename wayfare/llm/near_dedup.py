"""Near-duplicates by HyperMinHash.

A document's set holds the hashes (52 bits) of its distinct `shingle`-word windows; with fewer words, of the whole sequence.
One hash of each shingle picks one of REGISTERS buckets, and of the least remainder in a bucket the register stores the
number of leading zeros and the MANTISSA bits after them: 16 bits in all. Empty buckets borrow, for banding only, from the
first filled bucket in a fixed random order of the bucket's own, so that the order does not depend on the document.

1. Equal sets are one class (size and a 128-bit digest); from here on one representative stands for its class.
2. BANDS bands of ROWS registers give buckets. Documents of 80 % similarity share none with probability 3e-7.
3. Within a bucket, each document is compared with a leader, the least id, and where that leaves them in two components with
   a second one, the least id in a scrambled order.
4. A pair is estimated from the registers, corrected for chance collisions of registers, and dropped only if the estimate
   lies five standard errors below the threshold; the rest is confirmed on the full sets.
5. Components of the links are found after each. Documents of buckets that still hold two components are compared across
   components: two similar sets share one of the first n - ceil(0.8 n) + 1 shingles of each in any fixed order, and in the
   order of rising frequency among these documents (a table of COUNTERS counters, whose collisions only change the order)
   those are rare; shingles that no other document has are left out, and the places of a shared one bound the overlap.
   The pairs are confirmed in the same way. So no link between documents that share a bucket and could join two
   components is lost, and a group of n near copies costs about 2n comparisons, not n squared.

Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. Defined results: documents without words have an empty set and are
linked with nothing; rows that share a doc_id are one document, whose set is
the one of least size and digest, and each states the size of its own set; rows with a null doc_id are linked with nothing and kept
with a null component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, doc_numbers, grams, map_batches, mix, words
from .components import components, joined_components

REGISTERS, MANTISSA, BANDS, ROWS = 512, 10, 64, 7
COUNTERS, COUNTER_BLOCKS = 1 << 22, 64
EMPTY = 0xFFFF
_ORDER = np.argsort(np.random.Generator(np.random.PCG64(7)).random((REGISTERS, REGISTERS)), axis=1)
_RANK = np.argsort(_ORDER, axis=1).astype(np.uint16)
_HASH = np.uint64((1 << 52) - 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets by document): each document's distinct 52-bit shingle hashes, ascending."""
    _, _, hashes, word_offs = words(data, offs)
    values, gram_offs = grams(hashes, word_offs, n)
    docs = doc_numbers(gram_offs)
    counts = np.diff(word_offs)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [grams(hashes[word_offs[k] : word_offs[k + 1]], np.array([0, counts[k]]), int(counts[k]))[0][0] for k in short]
        values, docs = np.concatenate([values, np.array(whole, np.uint64)]), np.concatenate([docs, short])
    keys = np.sort((docs.astype(np.uint64) << np.uint64(52)) | (values >> np.uint64(12)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    ends = np.searchsorted(keys, np.arange(len(offs), dtype=np.uint64) << np.uint64(52))
    return keys & _HASH, ends


def registers(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """uint16 (documents, REGISTERS): leading zeros << MANTISSA | the bits after the first one; EMPTY without a shingle."""
    n = len(offs) - 1
    h = mix(values, 1)
    bucket, rest = (h >> np.uint64(55)).astype(np.int64), h & np.uint64((1 << 52) - 1)
    least = np.full(n * REGISTERS, np.iinfo(np.int64).max, np.int64)
    np.minimum.at(least, doc_numbers(offs) * REGISTERS + bucket, rest.astype(np.int64))
    filled = least != np.iinfo(np.int64).max
    bits = (least[filled] + 1).astype(np.float64).view(np.uint64)
    zeros = np.uint64(1023 + 52) - (bits >> np.uint64(52))
    out = np.full(n * REGISTERS, EMPTY, np.uint16)
    out[filled] = (np.minimum(zeros, 62) << np.uint64(MANTISSA)).astype(np.uint16) | ((bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
    return out.reshape(n, REGISTERS)


def densify(regs: np.ndarray) -> np.ndarray:
    """Fill each empty register from the first filled one in that register's own order (all-empty rows stay)."""
    out = regs.copy()
    rows, cols = np.nonzero((regs == EMPTY) & (regs != EMPTY).any(1)[:, None])
    for t in range(40):
        if not len(rows):
            return out
        got = regs[rows, _ORDER[cols, t]]
        done = got != EMPTY
        out[rows[done], cols[done]] = got[done]
        rows, cols = rows[~done], cols[~done]
    for k in np.unique(rows):
        own, filled = cols[rows == k], np.flatnonzero(regs[k] != EMPTY)
        out[k, own] = regs[k, filled[np.argmin(_RANK[own][:, filled], axis=1)]]
    return out


def band_hashes(regs: np.ndarray) -> np.ndarray:
    dense = densify(regs)[:, : BANDS * ROWS].astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    total = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(regs), BANDS)).copy()
    for k in range(ROWS):
        total = (total ^ dense[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(30)
    return mix(total.ravel()).view(np.int64).reshape(len(regs), BANDS)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard similarity, its standard error at 0.8) for rows of registers, corrected for chance collisions."""
    filled = (a != EMPTY) | (b != EMPTY)
    used = np.maximum(filled.sum(1), 1)
    share = ((a == b) & filled).sum(1) / used
    zeros = np.arange(40)[None, :]
    at = [(1 - 0.5 ** (zeros + 1)) ** (n[:, None] / REGISTERS) - (1 - 0.5**zeros) ** (n[:, None] / REGISTERS) for n in (n_a, n_b)]
    chance = (at[0] * at[1]).sum(1) / 2**MANTISSA
    return np.clip((share - chance) / (1 - chance), 0, 1), np.sqrt(0.16 / used)


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offs in chunks(batch.column(1)):
                values, ends = shingle_sets(data, offs, shingle)
                sizes = np.diff(ends)
                for lo in range(0, to - at, 512):
                    hi = min(lo + 512, to - at)
                    own, offs_ = values[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
                    digest = _digests(own, offs_)
                    regs = registers(own, offs_)
                    bands = band_hashes(regs)
                    yield pa.record_batch(
                        [
                            batch.column(0).slice(at + lo, hi - lo),
                            pa.array(sizes[lo:hi], pa.int64()),
                            *(pa.array(d, pa.int64()) for d in digest),
                            pa.array([r.tobytes() for r in regs], pa.binary()),
                            pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * BANDS, pa.int32()), pa.array(bands.ravel(), pa.int64())),
                        ],
                        ["id", "n_shingles", "d1", "d2", "regs", "bands"],
                    )

    return run


def _digests(values: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each document's set."""
    filled = (np.diff(offs) > 0).astype(np.uint64)
    return [(np.add.reduceat(np.append(mix(values, s), np.uint64(0)), offs[:-1]) * filled).view(np.int64) for s in (11, 12)]


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, name: str, chosen: DataFrame | None) -> DataFrame:
    """(id, set): the full set of each wanted id, as a binary of its 64-bit values; `chosen` (id, n, d1, d2) are ids with several texts."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offs in chunks(batch.column(1)):
                values, ends = shingle_sets(data, offs, shingle)
                digests = [pa.array(d, pa.int64()) for d in _digests(values, ends)]
                yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array([values[ends[k] : ends[k + 1]].tobytes() for k in range(to - at)], pa.binary()), *digests], ["id", "set", "s1", "s2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")
    schema = "id long, set binary, s1 long, s2 long"
    if chosen is None:
        return cut(rows.dropDuplicates(["id"]).transform(map_batches, full, schema).select("id", "set"), name)
    rows = rows.transform(map_batches, full, schema).join(chosen, "id", "left").where("d1 IS NULL OR (d1 = s1 AND d2 = s2)")
    return cut(rows.dropDuplicates(["id"]).select("id", "set"), name)


def _possible(regs: list[pa.Array], sizes: list[pa.Array], percent: int) -> np.ndarray:
    """Whether the sizes and the estimate from the registers leave it open that two sets are similar, by row."""
    regs = [np.frombuffer(b"".join(r.to_pylist()), np.uint16).reshape(-1, REGISTERS) for r in regs]
    sizes = [n.to_numpy(zero_copy_only=False).astype(float) for n in sizes]
    guess, error = estimate(*regs, *sizes)
    return (100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)) & (guess >= percent / 100 - 5 * error)


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose registers do not rule out that their sets are similar."""
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("id").alias(side), F.col("regs").alias(f"r{side}"), F.col("n_shingles").alias(f"n{side}")), side)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                yield batch.select([0, 1]).filter(pa.array(_possible(batch.columns[2:4], batch.columns[4:6], percent)))

    return cut(pairs.select("a", "b", "ra", "rb", "na", "nb").transform(map_batches, near, "a long, b long"), name)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, sketches: DataFrame | None = None) -> DataFrame:
    """The pairs whose full sets are similar; with sketches, the registers are asked first, in the same pass."""
    columns = {"set": "s"}
    if sketches is not None:
        sets = sets.join(sketches.select("id", "regs", "n_shingles"), "id")
        columns |= {"regs": "r", "n_shingles": "n"}
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), *(F.col(c).alias(f"{k}{side}") for c, k in columns.items())), side)

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and batch.num_columns > 4:
                batch = batch.filter(pa.array(_possible(batch.columns[4:6], batch.columns[6:8], percent)))
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", *(f"{k}{side}" for k in columns.values() for side in "ab")).transform(map_batches, same, "a long, b long")


def _frequencies(sets: DataFrame) -> np.ndarray:
    """In how many sets a shingle is found, at least, by its lowest bits; up to 255. The table has COUNTERS bytes whatever the input."""
    size = COUNTERS // COUNTER_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            table += np.bincount((values & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.int32)
        if table.any():
            parts = np.minimum(table, 255).astype(np.uint8).reshape(COUNTER_BLOCKS, size)
            yield pa.record_batch([pa.array(np.arange(COUNTER_BLOCKS, dtype=np.int32)), pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zstandard.decompress(counts), np.uint8)
                sums[block] = np.minimum(sums.get(block, 0) + own.astype(np.uint16), 255)
        for block, total in sums.items():
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([total.astype(np.uint8).tobytes()], pa.binary())], ["block", "counts"])

    out = np.zeros((COUNTER_BLOCKS, size), np.uint8)
    for block, counts in sets.select("set").transform(map_batches, count, "block int, counts binary").repartition("block").transform(map_batches, add, "block int, counts binary").collect():
        out[block] = np.frombuffer(counts, np.uint8)
    return out.ravel()


def _prefix_pairs(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of ids of different components that share a shingle of their prefixes."""
    shared = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, places, found = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(v.as_buffer(), np.uint64)
                n = len(values)
                often = shared.value[(values & np.uint64(COUNTERS - 1)).astype(np.int64)]
                first = np.lexsort((values, often))[: n - -(-percent * n // 100) + 1]
                at = np.flatnonzero(often[first] > 1)
                ids += [i] * len(at)
                sizes += [n] * len(at)
                places += at.tolist()
                found.append(values[first[at]])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(places, pa.int64()), pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], ["id", "n", "place", "key"])

    rows = sets.transform(map_batches, prefixes, "id long, n long, place long, key long").join(placed, "id")
    x, y = (rows.select("key", F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("place").alias(f"p{c}"), F.col("component").alias(f"c{c}")) for c in "ab")
    # nothing before the first shared shingle is shared, so the places bound the overlap
    possible = f"{100 + percent} * least(na - pa, nb - pb) >= {percent} * (na + nb)"
    return x.join(y, "key").where(f"a < b AND ca <> cb AND {possible}").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, class_id (least id of equal sets), component_id, kept."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = cut(own.transform(map_batches, _sketch(shingle), "id long, n_shingles long, d1 long, d2 long, regs binary, bands array<long>"), "sketches")
    # ids with several texts: a set is chosen, the other rows follow it
    chosen = sk.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("n_shingles", "d1", "d2")).alias("lo"), F.max(F.struct("n_shingles", "d1", "d2")).alias("hi")).where("lo <> hi").select("id", F.col("lo.n_shingles").alias("n"), "lo.d1", "lo.d2")
    chosen = cut(chosen, "several-texts")
    others = None
    if chosen.isEmpty():
        chosen = None
    else:
        marked = sk.alias("s").join(chosen.alias("c"), "id", "left").withColumn("_own", F.expr("c.d1 IS NULL OR (c.n = s.n_shingles AND c.d1 = s.d1 AND c.d2 = s.d2)")).select("s.*", "_own")
        rows, others = marked.where("_own").drop("_own"), marked.where("NOT _own").select("id", "n_shingles")
        sk = cut(rows, "chosen-sketches")
    full = sk.where("n_shingles > 0 AND id IS NOT NULL")
    classes = cut(full.groupBy("n_shingles", "d1", "d2").agg(F.min("id").alias("class_id")), "classes")
    reps = classes.select(F.col("class_id").alias("id"))
    rows = full.select("id", "bands").join(reps, "id", "left_semi").select("id", F.explode("bands").alias("band"))
    leaders = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("l1"), F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"].alias("l2")).where("n > 1").drop("n")
    shared = cut(rows.join(leaders, "band"), "buckets")
    # from here on, only documents that share a bucket are read
    ids = cut(shared.select("id").distinct(), "candidates")
    near_sk = cut(sk.select("id", "n_shingles", "regs").join(ids, "id", "left_semi"), "near-sketches")
    near = cut(own.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), "near-texts")
    found, pairs = None, None
    for lead in ("l1", "l2"):  # the second leaders only where the first ones left a document and its leader apart
        rows = shared.select("id", F.col(lead).alias("lead")).where("id <> lead").distinct()
        if found is not None:
            name = {side: found.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}")) for side in ("id", "lead")}
            rows = rows.join(name["id"], "id", "left").join(name["lead"], "lead", "left").where("coalesce(c_id, id) <> coalesce(c_lead, lead)")
        own_pairs = rows.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
        own_pairs = cut(own_pairs if pairs is None else own_pairs.join(pairs, ["a", "b"], "left_anti"), "pairs")
        pairs = own_pairs if pairs is None else pairs.unionByName(own_pairs)
        likely = _likely(own_pairs, near_sk, percent, "likely")
        sets = _sets(near, likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), shingle, "sets", chosen)
        links = cut(_confirmed(likely, sets, percent), "links")
        found = components(links) if found is None else joined_components(found, links)
    placed = shared.select("band", "id").join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    # what is left: documents of buckets in which two components meet
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    left = cut(placed.join(mixed, "band", "left_semi").select("id", "component").distinct(), "mixed")
    sets = _sets(near, left.select("id"), shingle, "mixed-sets", chosen)
    across = _prefix_pairs(sets, left, percent).join(pairs, ["a", "b"], "left_anti")
    more = _confirmed(cut(across, "across"), sets, percent, near_sk)
    found = joined_components(found, cut(more, "links-across"))
    member = full.select("id", "n_shingles", "d1", "d2").join(classes, ["n_shingles", "d1", "d2"]).select("id", "n_shingles", "class_id")
    member = member.join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select("id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    rest = sk.where("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    member = member.unionByName(rest)
    if others is not None:
        member = member.unionByName(others.join(member.select("id", "class_id", "component_id").distinct(), "id").select(*member.columns))
    return member.select(F.col("id").alias("doc_id"), "n_shingles", "class_id", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, the least doc_id. Rows that share a kept doc_id stay together."""
    gone = near_duplicates(docs, shingle, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def op4_hyperminhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract of this query sets shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
