"""Language identification with hyperdimensional profiles.

Each letter class has a random vector of +1 and -1 (DIM of them). A trigram's vector binds the three letters' vectors,
permuted by their place, by multiplication; a document's vector bundles its trigrams' vectors by addition; a prototype
bundles the length-normalised documents of one language. A document gets the language whose prototype has the largest cosine.

Letters are those of Unicode, in lower case; each run of other characters is one border class; letters without a class of
their own share classes by code point. Texts are read in stretches of about STRETCH bytes and vectors are made BLOCK
trigrams at a time, so memory does not grow with a text or with the trigrams met. Prototypes come from at most about
TRAIN_DOCS documents of each language, chosen by a hash of the id (a documented bound; the count by language is over all
rows). Every language of the training rows has a prototype; more than MOST_LANGUAGES values raise an error, as such
a column holds no languages. Defined results: null text or a text without a letter is `und` with score 0; ties go to the
first language in alphabetical order; without training rows all is `und`; repeated rows give a row each; an empty
table gives an empty table; columns with the names of the results are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, crc_mod, map_batches

DIM, CLASSES, TRAIN_DOCS = 512, 64, 3000
STRETCH, BLOCK = 1 << 19, 8192
#: A model has DIM * 8 bytes a language, 64 MB at most.
MOST_LANGUAGES = 1 << 14
SHARPNESS = 12.0


@functools.cache
def _classes() -> np.ndarray:
    """Class by code point: 0 for no letter, 1 to 26 for a to z, the others shared by code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % (CLASSES - 27)
    return out


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors, permuted for the first, second and third place."""
    made = (np.random.Generator(np.random.PCG64(11)).integers(0, 2, (CLASSES, DIM)) * 2 - 1).astype(np.int8)
    return made, np.roll(made, 1, axis=1), np.roll(made, 2, axis=1)


def trigram_vectors(trigrams: np.ndarray) -> np.ndarray:
    a, b, c = _letters()
    return (a[trigrams // CLASSES**2] * b[trigrams // CLASSES % CLASSES] * c[trigrams % CLASSES]).astype(np.float32)


def _stretches(data: np.ndarray) -> Iterator[np.ndarray]:
    """Code points of a text, STRETCH bytes or less at a time."""
    at = 0
    while at < len(data):
        to = min(at + STRETCH, len(data))
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to -= 1
        yield np.frombuffer(data[at:to].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = to


def _trigrams(kinds: np.ndarray) -> np.ndarray:
    return kinds[:-2] * CLASSES**2 + kinds[1:-1] * CLASSES + kinds[2:]


def _counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, trigrams, counts) of a chunk, by document and trigram; a text without a letter has none."""
    if len(offs) == 2 and len(data) > STRETCH:  # one long text
        total, tail = np.zeros(CLASSES**3, np.int64), np.zeros(1, np.int64)
        for points in (*_stretches(data), np.zeros(1, np.uint32)):  # the last one is the border at the end
            kinds = np.concatenate([tail, _classes()[points]]).astype(np.int64)
            kinds = kinds[np.concatenate([[True], (kinds[1:] != 0) | (kinds[:-1] != 0)])]
            total += np.bincount(_trigrams(kinds), minlength=CLASSES**3)
            tail = kinds[-2:]
        used = np.flatnonzero(total)
        return np.zeros(len(used), np.int64), used, total[used]
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    borders = offs if len(points) == len(data) else np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offs)
    # two borders between documents, so that no trigram of letters spans two
    kinds = np.insert(_classes()[points], np.repeat(borders[1:-1], 1), 0).astype(np.int64)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(borders) + (np.arange(len(offs) - 1) < len(offs) - 2))
    kinds, owner = np.concatenate([[0], kinds, [0]]), np.concatenate([[0], owner, [len(offs) - 2]])
    keep = np.concatenate([[True], (kinds[1:] != 0) | (kinds[:-1] != 0)])
    kinds, owner = kinds[keep], owner[keep]
    if len(kinds) < 3:
        none = np.zeros(0, np.int64)
        return none, none, none
    middle = kinds[1:-1]
    tri, own = _trigrams(kinds), owner[1:-1]
    # a trigram belongs to the document of its middle; with a border in the middle, both sides must be of one document
    letters = (middle != 0) | ((owner[:-2] == owner[2:]) & (kinds[:-2] != 0) & (kinds[2:] != 0))
    keys, counts = np.unique(own[letters] * CLASSES**3 + tri[letters], return_counts=True)
    return keys // CLASSES**3, keys % CLASSES**3, counts


def document_vectors(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The bundles of the trigrams of each text of a chunk; zeros without a letter."""
    docs, trigrams, counts = _counts(data, offs)
    out = np.zeros((len(offs) - 1, DIM))
    used, rows = np.unique(trigrams, return_inverse=True)
    for at in range(0, len(used), BLOCK):
        vectors = trigram_vectors(used[at : at + BLOCK])
        own = np.flatnonzero((rows >= at) & (rows < at + BLOCK))
        cuts = np.searchsorted(docs[own], np.arange(len(offs)))
        for d in np.flatnonzero(np.diff(cuts)):
            of = own[cuts[d] : cuts[d + 1]]
            out[d] += counts[of].astype(np.float32) @ vectors[rows[of] - at]
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def train(docs: DataFrame, training: Column, most: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes of unit length) from the rows of docs for which `training` holds and lang is not null."""
    rows = docs.where(training & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    if not counts:
        return [], np.zeros((0, DIM))
    shares = docs.sparkSession.createDataFrame([(r[0], min(1.0, most / r[1])) for r in counts], "lang string, _share double")
    chosen = rows.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 20)) < F.col("_share") * (1 << 20)).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, to, data, offs in chunks(batch.column(1), STRETCH):
                for lang, v in zip(langs[at:to], _unit(document_vectors(data, offs)), strict=True):
                    sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], ["lang", "k", "v"])

    sums = chosen.transform(map_batches, bundle, "lang string, k int, v double").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for lang, k, v in sums.collect():
        found.setdefault(lang, np.zeros(DIM))[k] = round(v, 9)
    names = sorted(found)
    return names, _unit(np.stack([found[x] for x in names])) if names else np.zeros((0, DIM))


def scores(vectors: np.ndarray, names: list[str], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the language, -1 for none; score from 0 to 1; cosine) by row of vectors."""
    some = vectors.any(axis=1) if names else np.zeros(len(vectors), bool)
    best, score, cosine = np.full(len(vectors), -1), np.zeros(len(vectors)), np.zeros(len(vectors))
    if some.any():
        cosines = _unit(vectors[some]) @ prototypes.T
        best[some] = cosines.argmax(axis=1)
        cosine[some] = cosines.max(axis=1)
        score[some] = 1 / np.exp(SHARPNESS * (cosines - cosine[some][:, None])).sum(axis=1)
    return best, score, cosine


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], names_of: tuple[str, str, str] = ("lang_pred", "score", "cosine"), keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (all, if None), then the language, its score and cosine; columns of docs with these names are replaced."""

    keep = [c for c in (keep if keep is not None else docs.columns) if c not in names_of]
    sent = [*keep, *([] if "text" in keep else ["text"])]
    at_text = sent.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    out = T.StructType([*fields, *(T.StructField(n, t) for n, t in zip(names_of, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = shared.value
        words = [*names, "und"]
        for batch in batches:
            for at, to, data, offs in chunks(batch.column(at_text), STRETCH):
                best, score, cosine = scores(document_vectors(data, offs), names, prototypes)
                yield pa.record_batch([*(c.slice(at, to - at) for c in batch.columns[: len(keep)]), pa.array([words[k] for k in best], pa.string()), pa.array(score), pa.array(cosine)], [*keep, *names_of])

    return docs.select(*sent).transform(map_batches, run, out)


def op6_hyperdimensional_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, crc_mod(F.col("doc_id"), 3) != 1)
    return identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
