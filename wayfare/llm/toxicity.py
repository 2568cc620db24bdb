"""Toxicity from misspelled lexicon terms in their context.

The lexicon is learnt: words of a labelled sample that are far more frequent in toxic documents than chance allows. A trie of
the terms is intersected with Levenshtein automata (one edit from four letters on, two from nine): the states of the product
are sets of (trie node, edits), made deterministic when first met, and all words of a chunk run through the table at once. Each
hit gets a weight for its term and number of edits, and a score for its context: learnt weights of the words within
WINDOW words, and whether it stands in quotation marks, which separates quotation from abuse. A logistic regression
over the sums by document gives the score. Every hit counts, also one that speaks against toxicity.

Learning uses at most about SAMPLE labelled documents of each class, chosen by a hash of the id, of those for which `training` holds.
The lexicon has every word of that sample that passes the test, so the sample bounds it. Inputs of a score are texts only.
Defined results: null, empty and word-less texts get the score of a document without hits; a document labelled twice
counts twice; labels other than 0 and 1, and null ones, are left out; without both classes in training (an empty
table, say) every score is 0; an empty table of documents gives an empty table; repeated rows give a row each; extra
columns are ignored; doc_id is cast to long.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _spans, chunks, crc_mod, cut, map_batches, span_hashes

SAMPLE, WINDOW, BUCKETS = 8000, 4, 4096
#: Cells of a worker's automaton (4 bytes each) at which it starts anew with the next chunk.
MAX_CELLS = 1 << 23
_QUOTES = "\"'“”„«»‘’‹›`"
_BEFORE_AFTER = "[^\\p{L}\\p{N}]+"


def edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Automaton:
    """Trie and Levenshtein automata in one: deterministic states, made when first met."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        letters = sorted({c for t in terms for c in t})
        self.kind = {c: k + 1 for k, c in enumerate(letters)}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.budget: list[int] = [0]
        for k, t in enumerate(terms):
            at = 0
            for c in t:
                self.budget[at] = max(self.budget[at], edits(t))
                if self.kind[c] not in self.children[at]:
                    self.children[at][self.kind[c]] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.budget.append(0)
                at = self.children[at][self.kind[c]]
            self.ends[at] = k
            self.budget[at] = max(self.budget[at], edits(t))
        self.classes = np.zeros(0x110000, np.uint16)
        for c, k in self.kind.items():
            self.classes[ord(c)] = k
        self.longest = max((len(t) + edits(t) for t in terms), default=0)
        self.shortest = min((max(1, len(t) - edits(t)) for t in terms), default=1)
        self._start()

    def _start(self) -> None:
        self.sets: list[tuple] = [()]
        self.numbers: dict[tuple, int] = {(): 0}
        self.table = np.full((256, len(self.kind) + 1), -1, np.int32)
        self.table[0] = 0
        self.accept = np.full((256, 2), -1, np.int32)
        self.first = self._number({0: 0})

    def _number(self, states: dict[int, int]) -> int:
        """The number of a set of (node, least edits), after the deletions that it allows."""
        work = [*states.items()]
        while work:
            node, e = work.pop()
            if states.get(node, e) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and e + 1 < states.get(child, 99):
                    states[child] = e + 1
                    work.append((child, e + 1))
        key = tuple(sorted(states.items()))
        if key not in self.numbers:
            n = len(self.sets)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.accept = np.concatenate([self.accept, np.full_like(self.accept, -1)])
            self.numbers[key] = n
            self.sets.append(key)
            found = min(((e, self.ends[node]) for node, e in key if self.ends[node] >= 0 and e <= edits(self.terms[self.ends[node]])), default=None)
            self.accept[n] = (found[1], found[0]) if found else (-1, -1)
        return self.numbers[key]

    def _step(self, state: int, kind: int) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e + 1 <= self.budget[node]:
                out[node] = min(out.get(node, 99), e + 1)  # a letter too many
            for k, child in self.children[node].items():
                cost = e + (k != kind)
                if cost <= self.budget[child]:
                    out[child] = min(out.get(child, 99), cost)
        return self._number(out)

    def run(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, term, edits) of the words (spans of lower-case code points) that match."""
        if self.table.size > MAX_CELLS:
            self._start()
        lengths = ends - starts
        live = np.flatnonzero((lengths >= self.shortest) & (lengths <= self.longest))
        state = np.full(len(live), self.first, np.int32)
        kinds = self.classes[points]
        hits, found = [], []
        for k in range(self.longest + 1):
            over = lengths[live] == k
            got = self.accept[state[over]]
            own = got[:, 0] >= 0
            hits.append(live[over][own])
            found.append(got[own])
            live, state = live[~over], state[~over]
            if not len(live):
                break
            kind = kinds[starts[live] + k]
            nxt = self.table[state, kind]
            if (nxt < 0).any():
                for s, c in np.unique(np.stack([state[nxt < 0], kind[nxt < 0]], 1), axis=0).tolist():
                    to = self._step(s, c)  # may grow the table
                    self.table[s, c] = to
                nxt = self.table[state, kind]
            live, state = live[nxt > 0], nxt[nxt > 0]
        hits, found = np.concatenate(hits), np.concatenate(found)
        order = np.argsort(hits, kind="stable")
        return hits[order], found[order, 0], found[order, 1]


@functools.cache
def _points() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower case, is letter or number, is white space) by code point."""
    low, inner = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        x = chr(c)
        inner[c] = x.isalnum()
        if x != (y := x.lower()) and len(y) == 1:
            low[c] = ord(y)
    white = np.zeros(0x110000, bool)
    white[[0x20, *range(9, 14)]] = True
    return low, inner, white


@functools.lru_cache(maxsize=2)
def _automaton(terms: tuple[str, ...]) -> Automaton:
    return Automaton([*terms])


class Hits(NamedTuple):
    """All hits of a chunk of texts, in order: arrays by hit, but n_words (by text) and bucket (by word)."""

    first: int  # the chunk's first text
    n_words: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    cost: np.ndarray  # edits
    word: np.ndarray
    lo: np.ndarray  # the words of the context: [lo, hi) without the hit
    hi: np.ndarray
    quoted: np.ndarray
    bucket: np.ndarray  # 0 outside of all contexts


@functools.cache
def _quote_table() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in _QUOTES]] = True
    return out


def find_hits(column: pa.Array, terms: tuple[str, ...]) -> Iterator[Hits]:
    """The hits of all rows of a column of texts, a chunk at a time."""
    low, inner, white = _points()
    automaton = _automaton(terms)
    for at, to, data, offs in chunks(column):
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        borders = offs if len(points) == len(data) else np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offs)
        starts, ends = _spans(~white[points], borders)
        word_offs = np.searchsorted(starts, borders)
        # without what is neither letter nor number at both ends
        marks = np.flatnonzero(inner[points])
        a, b = np.searchsorted(marks, starts), np.searchsorted(marks, ends)
        full = b > a
        s = np.where(full, marks[np.minimum(a, max(len(marks) - 1, 0))] if len(marks) else starts, starts)
        e = np.where(full, marks[np.maximum(b - 1, 0)] + 1 if len(marks) else starts, starts)
        lowered = low[points]
        word, term, cost = automaton.run(lowered, s, e)
        doc = np.searchsorted(word_offs, word, "right") - 1
        lo, hi = np.maximum(word_offs[doc], word - WINDOW), np.minimum(word_offs[doc + 1], word + WINDOW + 1)
        quotes = np.concatenate([[0], np.cumsum(_quote_table()[points])])
        quoted = (quotes[s[word]] > quotes[starts[lo]]) & (quotes[ends[hi - 1]] > quotes[e[word]]) if len(word) else np.zeros(0, bool)
        # the words of contexts get a bucket by their code points
        near = np.zeros(len(starts) + 1, np.int64)
        np.add.at(near, lo, 1)
        np.add.at(near, hi, -1)
        near = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (e > s))
        bucket = np.zeros(len(starts), np.int64)
        bucket[near] = (span_hashes(lowered.view(np.uint8), 4 * s[near], 4 * e[near]) % np.uint64(BUCKETS)).astype(np.int64)
        yield Hits(at, np.diff(word_offs), doc, term.astype(np.int64), np.minimum(cost, 2).astype(np.int64), word, lo, hi, quoted, bucket)


class Model:
    """terms; a weight by term and edits; a weight by context bucket; the regression's coefficients."""

    def __init__(self, terms=(), weights=None, context=None, coefficients=None):
        self.terms, self.weights, self.context, self.coefficients = terms, weights, context, coefficients

    def features(self, hits: Hits) -> np.ndarray:
        """By text: 1, the greatest weight, the sum of the weights outside quotes, the sum of positive ones and their density, mean context, share in quotes."""
        out = np.zeros((len(hits.n_words), 7))
        out[:, 0] = 1
        if not len(hits.doc):
            return out
        weight = self.weights[hits.term, hits.cost]
        of = self.context[hits.bucket]
        sums = np.concatenate([[0], np.cumsum(of)])
        others = hits.hi - hits.lo - 1
        context = np.where(others > 0, (sums[hits.hi] - sums[hits.lo] - of[hits.word]) / np.maximum(others, 1), 0)
        first = np.flatnonzero(np.concatenate([[True], hits.doc[1:] != hits.doc[:-1]]))
        total = lambda x: np.add.reduceat(x.astype(float), first)
        docs, n, positive = hits.doc[first], np.diff([*first, len(hits.doc)]), total(np.maximum(weight, 0))
        out[docs, 1] = np.maximum.reduceat(weight, first)
        out[docs, 2] = np.minimum(total(np.where(hits.quoted, 0, weight)), 20)
        out[docs, 3] = np.log1p(positive)
        out[docs, 4] = np.log1p(100 * positive / np.maximum(hits.n_words[docs], 1))
        out[docs, 5] = total(context) / n
        out[docs, 6] = total(hits.quoted) / n
        return out

    def score(self, hits: Hits) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(hits.n_words))
        return 1 / (1 + np.exp(-np.clip(self.features(hits) @ self.coefficients, -40, 40)))


def _regression(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    w = w / w.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        gradient = x.T @ (w * (y - p)) - ridge * b
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(hessian, gradient)
        b += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> Model:
    rows = labels.where(training & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Model()
    share = {k: min(1.0, sample / n) for k, n in counts.items()}
    bound = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * (1 << 20)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < bound)  # some 2 * sample rows of 12 bytes
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "toxic-sample")
    n = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model()
    # the lexicon: the divergence of a word's share of toxic documents from the base rate, beyond what chance gives any of all words
    words = F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: F.regexp_replace(F.lower(w), f"^{_BEFORE_AFTER}|{_BEFORE_AFTER}$", "")))
    seen = texts.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).where("n >= 3 AND length(word) BETWEEN 3 AND 32")
    seen = cut(seen, "toxic-words")
    total, rate = max(seen.count(), 1), n[1] / (n[0] + n[1])
    p = F.least(F.col("t") / F.col("n"), F.lit(1 - 1e-9))
    gain = F.col("n") * (p * F.log(p / rate) + (1 - p) * F.log((1 - p) / (1 - rate)))
    best = seen.where((F.col("t") > 0) & (p > 0.5) & (p > rate)).withColumn("gain", F.round(gain, 6)).where(F.col("gain") > math.log(3 * total)).select("word")
    terms = tuple(sorted(r["word"] for r in best.collect()))  # words of the bounded sample
    if not terms:
        return Model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term, by_bucket = np.zeros((2, 3 * len(terms)), np.int64), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for hits in find_hits(batch.column(1), terms):
                of = toxic[hits.first :][hits.doc]
                once = np.unique(hits.doc * 3 * len(terms) + 3 * hits.term + hits.cost)  # once a document
                np.add.at(by_term, (toxic[hits.first :][once // (3 * len(terms))], once % (3 * len(terms))), 1)
                n = hits.hi - hits.lo
                near = np.arange(int(n.sum())) + np.repeat(hits.lo - (np.cumsum(n) - n), n)
                own = near != np.repeat(hits.word, n)
                np.add.at(by_bucket, (np.repeat(of, n)[own], hits.bucket[near[own]]), 1)
        for kind, table in enumerate((by_term, by_bucket)):
            y, k = np.nonzero(table)
            yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(table[y, k])], ["kind", "k", "toxic", "c"])

    weights, context = np.zeros((len(terms), 3, 2)), np.zeros((BUCKETS, 2))
    for kind, k, y, c in texts.transform(map_batches, count, "kind int, k int, toxic int, c long").groupBy("kind", "k", "toxic").agg(F.sum("c")).collect():
        (weights[k // 3, k % 3] if kind == 0 else context[k])[y] = c
    scale = np.array([n[0], n[1]])
    odds = np.log((weights[..., 1] + 0.5) / (scale[1] + 1)) - np.log((weights[..., 0] + 0.5) / (scale[0] + 1))
    known = weights.sum(-1) > 0
    # edits not met in the sample get what the term's exact form has, less a step for each edit
    for e in (1, 2):
        odds[:, e] = np.where(known[:, e], odds[:, e], odds[:, 0] - e)
    near = np.log((context[:, 1] + 2) / (context[:, 1].sum() + 2 * BUCKETS)) - np.log((context[:, 0] + 2) / (context[:, 0].sum() + 2 * BUCKETS))
    model = Model(terms, odds, near if context[:, 0].sum() else np.zeros(BUCKETS))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hits in find_hits(batch.column(1), model.terms):
                made = model.features(hits)
                yield pa.record_batch([batch.column(0).slice(hits.first, len(made)), pa.array(made.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    got = texts.transform(map_batches, features, "toxic int, x array<double>").collect()
    got = sorted((r["toxic"], r["x"]) for r in got)
    y, x = np.array([g[0] for g in got], float), np.array([g[1] for g in got])
    model.coefficients = _regression(x, y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and n_hits of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not model.terms:
                yield pa.record_batch([batch.column(0), pa.array(np.zeros(batch.num_rows)), pa.array(np.zeros(batch.num_rows, np.int64))], ["doc_id", "score", "n_hits"])
                continue
            for hits in find_hits(batch.column(1), model.terms):
                n = len(hits.n_words)
                yield pa.record_batch([batch.column(0).slice(hits.first, n), pa.array(model.score(hits)), pa.array(np.bincount(hits.doc, minlength=n))], ["doc_id", "score", "n_hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_batches, run, "doc_id long, score double, n_hits long")


def op9_misspelling_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    return score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")
