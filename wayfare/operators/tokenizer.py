"""Tokens of URLs: pieces split by rule, each merged by ranks over byte characters.

A vocabulary maps tokens (texts of byte characters) to ids, id 0 is the end token, and merges are pairs in the order of their rank.
A piece is merged until no pair of it has a rank: of all adjacent pairs the one of least rank, everywhere at once from the left.
Each worker remembers the pieces it met last, so a piece that many URLs share is merged once while it is remembered.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import PIECE

EOS = "<eos>"
_PIECE = re.compile(PIECE)


@functools.cache
def byte_characters() -> tuple[str, ...]:
    """The character that stands for each byte: printable Latin-1 characters for themselves, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return tuple(chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256))


class Tokenizer:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], remember: int = 1 << 16):
        if vocab.get(EOS) != 0:
            raise ValueError(f"the vocabulary has no {EOS} with id 0")
        self.vocab, self.merges, self.remember = vocab, merges, remember
        self._ready()

    def __getstate__(self):
        return self.vocab, self.merges, self.remember

    def __setstate__(self, state):
        self.vocab, self.merges, self.remember = state
        self._ready()

    def _ready(self) -> None:
        self.ranks = {pair: k for k, pair in enumerate(self.merges)}
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.bytes = {c: b for b, c in enumerate(byte_characters())}
        self.piece_ids = functools.lru_cache(self.remember)(self._piece_ids)

    def __len__(self) -> int:
        return max(self.tokens) + 1

    @classmethod
    def of_words(cls, words: list[str]) -> Tokenizer:
        """All bytes, and merges that build each of some words up from the left."""
        chars = byte_characters()
        vocab = {EOS: 0, **{c: b + 1 for b, c in enumerate(chars)}}
        merges: list[tuple[str, str]] = []
        for word in words:
            for n in range(1, len(word)):
                if (pair := (word[:n], word[n])) not in merges:
                    merges.append(pair)
                    vocab.setdefault(word[: n + 1], len(vocab))
        return cls(vocab, merges)

    @classmethod
    def of_tables(cls, vocab: DataFrame, merges: DataFrame) -> Tokenizer:
        """From the tables of a tokenizer file (vocab: token, id; merges: rank, a, b), whose size the vocabulary bounds."""
        return cls({r["token"]: r["id"] for r in vocab.collect()}, [(r["a"], r["b"]) for r in merges.orderBy("rank").collect()])

    def _piece_ids(self, piece: str) -> tuple[int, ...]:
        chars = byte_characters()
        word = [chars[b] for b in piece.encode()]
        while len(word) > 1:
            best = min(((r, k) for k in range(len(word) - 1) if (r := self.ranks.get((word[k], word[k + 1]))) is not None), default=None)
            if best is None:
                break
            a, b = word[best[1]], word[best[1] + 1]
            out, k = [], 0
            while k < len(word):
                joined = k + 1 < len(word) and word[k] == a and word[k + 1] == b
                out.append(a + b if joined else word[k])
                k += 2 if joined else 1
            word = out
        try:
            return tuple(self.vocab[t] for t in word)
        except KeyError as e:
            raise ValueError(f"the vocabulary has no token {e}") from None

    def encode(self, text: str) -> list[int]:
        return [i for piece in _PIECE.split(text) if piece for i in self.piece_ids(piece)]

    def _raw(self, tokens: list[int]) -> bytes:
        try:
            return bytes(self.bytes[c] for t in tokens for c in self.tokens[t])
        except KeyError:
            raise ValueError("an unknown token") from None

    def decode(self, tokens: list[int]) -> str:
        """The text; an error for tokens that give no UTF-8."""
        return self._raw(tokens).decode()

    def show(self, tokens: list[int]) -> str:
        """The text, with bytes that are no character replaced."""
        return self._raw(tokens).decode("utf-8", "replace")

    def piece(self, token: int) -> str:
        """A token as text to show; bytes that are no character are replaced."""
        return EOS if token == 0 else self._raw([token]).decode("utf-8", "replace")


def tokenize_udf(tokenizer: Tokenizer, spark: SparkSession):
    shared = spark.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else shared.value.encode(t) for t in texts])

    return run


def tokenize(text: Column, tokenizer: Tokenizer, spark: SparkSession) -> Column:
    """array<int>: the ids of a text, without an end; null for null. Rows stay where they are."""
    return tokenize_udf(tokenizer, spark)(text)


def detokenize(ids: Column, tokenizer: Tokenizer, spark: SparkSession) -> Column:
    """struct(text, error) of an array of ids."""
    shared = spark.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for own in rows:
                try:
                    out.append((None if own is None else shared.value.decode([int(i) for i in own]), None))
                except ValueError as e:
                    out.append((None, str(e)))
            yield pd.DataFrame(out, columns=["text", "error"])

    return run(ids)


def pieces_of(tokenizer: Tokenizer, spark: SparkSession) -> DataFrame:
    """(id, piece): the vocabulary as shown, to be joined to ids."""
    return spark.createDataFrame([(i, tokenizer.piece(i)) for i in sorted(tokenizer.tokens)], "id int, piece string")


def search(vocabulary: DataFrame, query: str, most: int = 400) -> DataFrame:
    """The first `most` pieces by id that hold a query of two characters or more, in the same case."""
    return vocabulary.where(F.col("piece").contains(query)).orderBy("id").limit(most) if len(query) >= 2 else vocabulary.limit(0)


def token_test(cases: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(ok, mismatched): how many of the cases (canonical, ids) the tokenizer gives exactly."""
    same = tokenize(F.col("canonical"), tokenizer, cases.sparkSession).eqNullSafe(F.col("ids"))
    return cases.select(same.alias("same")).agg(F.count_if("same").alias("ok"), F.count_if(~F.col("same")).alias("mismatched"))
