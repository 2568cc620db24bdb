"""Predictors of the next token, and coding of whole tables with them.

A predictor is fed one token at a time and gives the weights of all tokens for the next place. Two are built in: `CountPredictor`,
trained by Spark on a table of texts (our own stand-in, byte tokens with two bytes of context), and the transformer of
`transformer`. Texts are coded inside Arrow batches: each step needs the symbol before. A predictor with `rows` takes a step of many
texts at once, which gives the same codes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quant import TOTAL
from ..functions.urls import canonical_url
from .coding import Decoder, Encoder, SplitMix, bits_to_code, code_to_bits, digits_of

END = 0
MAX_TOKENS = 65536
NO_END = "no end within the token limit"
#: A model over more tokens than this looks back one token instead of two, so that its contexts stay bounded (TOKENS**2, or the vocabulary).
TOKENS = 1024
#: Contexts whose grid a worker remembers.
GRIDS = 8192


def grid(weights: np.ndarray) -> np.ndarray:
    """Cumulative frequencies (n + 1 values, the last TOTAL); each symbol has one slot at least, the first heaviest gets the rest."""
    return grids(weights[None])[0]


def grids(weights: np.ndarray) -> np.ndarray:
    """The grid of each row."""
    n, size = weights.shape
    share = weights / np.cumsum(weights, axis=1)[:, -1:]
    freq = (share * (TOTAL - size)).astype(np.int64) + 1
    freq[np.arange(n), share.argmax(1)] += TOTAL - freq.sum(1)
    out = np.zeros((n, size + 1), np.int64)
    np.cumsum(freq, axis=1, out=out[:, 1:])
    return out


class CountPredictor:
    """Counts of a token after two, one and no tokens, mixed: token 0 ends a text."""

    def __init__(self, two: dict, one: dict, none: np.ndarray):
        self.two, self.one, self.none = two, one, none
        self._ready()

    def __getstate__(self):
        return self.two, self.one, self.none

    def __setstate__(self, state):
        self.two, self.one, self.none = state
        self._ready()

    def _ready(self) -> None:
        self.grid_of = functools.lru_cache(GRIDS)(lambda context: grid(self._weights(context)))
        self.reset()

    def reset(self) -> None:
        self.context = (END, END)

    def _next(self, token: int) -> tuple[int, int]:
        self.context = (self.context[1], token) if self.two else (END, token)
        return self.context

    def feed(self, token: int) -> np.ndarray:
        return self._weights(self._next(token))

    def feed_grid(self, token: int) -> np.ndarray:
        """The grid after a token; contexts met before are remembered."""
        return self.grid_of(self._next(token))

    def _weights(self, context: tuple[int, int]) -> np.ndarray:
        out = (self.none + 0.01) / (self.none.sum() + 0.01 * len(self.none))
        for table, key, strength in ((self.one, context[1], 4.0), (self.two, context, 2.0)):
            if key in table:
                tokens, counts = table[key]
                out = out * (strength / (counts.sum() + strength))
                out[tokens] += counts / (counts.sum() + strength)
        return out


def feed_grid(predictor, token: int) -> np.ndarray:
    return predictor.feed_grid(token) if hasattr(predictor, "feed_grid") else grid(predictor.feed(token))


def train_counts(texts: DataFrame, column: str, ids: Column | None = None, size: int = 257) -> CountPredictor:
    """Count tokens by context over the whole table: bytes of a text, or `ids` (an array<int> column) of a vocabulary of `size`.

    What reaches the driver is a row for each context, with its counts in an array: at most TOKENS**2 contexts.
    """
    if ids is None:
        raw = F.encode(column, "UTF-8")
        ids = F.when(F.length(raw) > 0, F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int") + 1)).otherwise(F.array().cast("array<int>"))
    end = F.array(F.lit(END))
    rows = texts.where(F.col(column).isNotNull()).select(ids.alias("t"))
    before = F.concat(end, end, "t") if size <= TOKENS else F.transform(F.concat(end, end, "t"), lambda _: F.lit(END))
    steps = rows.select(F.explode(F.slice(F.arrays_zip(before.alias("a"), F.concat(end, "t", end).alias("b"), F.concat("t", end, end).alias("tok")), F.lit(1), F.size("t") + 1)).alias("s")).select("s.*")
    counts = steps.groupBy("a", "b", "tok").agg(F.count(F.lit(1)).alias("n")).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("tok", "n"))).alias("c"))
    two: dict = {}
    one: dict = {}
    none = np.zeros(size)
    for a, b, own in counts.toLocalIterator():
        tokens, n = np.array([x["tok"] for x in own], np.int32), np.array([x["n"] for x in own], float)
        if size <= TOKENS:
            two[a, b] = tokens, n
        np.add.at(none, tokens, n)
        if size <= TOKENS:
            np.add.at(one.setdefault(b, np.zeros(size)), tokens, n)
        else:
            one[b] = tokens, n
    if size <= TOKENS:
        one = {b: (np.flatnonzero(v), v[v > 0]) for b, v in one.items()}
    return CountPredictor(two, one, none)


class ByteTokens:
    """Text to byte tokens and back: byte b is token b + 1."""

    @staticmethod
    def encode(text: str) -> list[int]:
        return [b + 1 for b in text.encode()]

    @staticmethod
    def decode(tokens: list[int]) -> str:
        return bytes(t - 1 for t in tokens).decode()

    @staticmethod
    def show(tokens: list[int]) -> str:
        """The text, with bytes that are no character replaced."""
        return bytes(t - 1 for t in tokens).decode("utf-8", "replace")

    @staticmethod
    def piece(token: int) -> str:
        return "<eos>" if token == END else bytes([token - 1]).decode("latin-1")


def encode_text(predictor, tokens: list[int]) -> tuple[str, list[tuple]]:
    """(bits, [(token, lo, hi, bits written, pending)]), the end token included."""
    predictor.reset()
    encoder, out, before = Encoder(), [], END
    for token in [*tokens, END]:
        cum = feed_grid(predictor, before)
        lo, hi = int(cum[token]), int(cum[token + 1])
        encoder.encode(lo, hi)
        out.append((token, lo, hi, len(encoder.bits), encoder.pending))
        before = token
    return encoder.finish(), out


def decode_bits(predictor, bits: str, most: int = MAX_TOKENS) -> list[int]:
    predictor.reset()
    decoder, out, before = Decoder(bits), [], END
    while len(out) < most:
        cum = feed_grid(predictor, before)
        token = int(np.searchsorted(cum, decoder.target(), "right")) - 1
        if token == END:
            return out
        decoder.update(int(cum[token]), int(cum[token + 1]))
        out.append(token)
        before = token
    raise ValueError(NO_END)


def _in_blocks(run, predictor, rows: list) -> Iterator:
    most = predictor.most_rows()
    for k in range(0, len(rows), most):
        yield from run(predictor, rows[k : k + most])


def _encode_block(predictor, texts: list[list[int]]) -> list[tuple[str, list[tuple]]]:
    texts = [[*tokens, END] for tokens in texts]
    encoders, out = [Encoder() for _ in texts], [[] for _ in texts]
    rows, left, before, k = predictor.rows(len(texts)), np.arange(len(texts)), np.full(len(texts), END), 0
    while len(left):
        cum = grids(rows.feed(before))
        before, place = np.array([texts[i][k] for i in left]), np.arange(len(left))
        for i, token, lo, hi in zip(left.tolist(), before.tolist(), cum[place, before].tolist(), cum[place, before + 1].tolist(), strict=True):
            encoders[i].encode(lo, hi)
            out[i].append((token, lo, hi, len(encoders[i].bits), encoders[i].pending))
        k += 1
        on = np.array([k < len(texts[i]) for i in left])
        if not on.all():
            left, before = left[on], before[on]
            rows.keep(np.flatnonzero(on))
    return [(encoder.finish(), steps) for encoder, steps in zip(encoders, out, strict=True)]


def encode_texts(predictor, texts: list[list[int]]) -> Iterator[tuple[str, list[tuple]]]:
    """encode_text of each text."""
    if hasattr(predictor, "rows"):
        return _in_blocks(_encode_block, predictor, texts)
    return (encode_text(predictor, tokens) for tokens in texts)


def _decode_block(predictor, bits: list[str], most: int = MAX_TOKENS) -> list[list[int] | ValueError]:
    decoders, out = [Decoder(b) for b in bits], [[] for _ in bits]
    rows, left, before = predictor.rows(len(bits)), np.arange(len(bits)), np.full(len(bits), END)
    for _ in range(most):
        if not len(left):
            break
        cum = grids(rows.feed(before))
        targets = np.array([decoders[i].target() for i in left])
        before, place = (cum <= targets[:, None]).sum(1) - 1, np.arange(len(left))
        for i, token, lo, hi in zip(left.tolist(), before.tolist(), cum[place, before].tolist(), cum[place, before + 1].tolist(), strict=True):
            if token != END:
                decoders[i].update(lo, hi)
                out[i].append(token)
        if not (on := before != END).all():
            left, before = left[on], before[on]
            rows.keep(np.flatnonzero(on))
    for i in left:
        out[i] = ValueError(NO_END)
    return out


def _decode_each(predictor, bits: list[str]) -> Iterator[list[int] | ValueError]:
    for b in bits:
        try:
            yield decode_bits(predictor, b)
        except ValueError as e:
            yield e


def decode_texts(predictor, bits: list[str]) -> Iterator[list[int] | ValueError]:
    """decode_bits of each; errors are values."""
    return _in_blocks(_decode_block, predictor, bits) if hasattr(predictor, "rows") else _decode_each(predictor, bits)


ENCODED = "canonical string, code string, bits string, n_tokens long, model_bits double, url_bytes long, bits_per_char double, pieces array<struct<piece:string,bits:double,clo:double,chi:double,emit:int,pend:int>>"


def encode(df: DataFrame, column: str, predictor, alphabet: int = 1, version: int = 0, emoji: str | None = None, tokens=ByteTokens, most: int = MAX_TOKENS) -> DataFrame:
    """df with `encoded`: the code of each text with its costs; null texts, and those of more than `most` tokens, give null."""
    shared = df.sparkSession.sparkContext.broadcast(predictor)
    digits = digits_of(alphabet, emoji)

    @F.pandas_udf(ENCODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            rows = []
            ids = [None if text is None else tokens.encode(text) for text in texts]
            ids = [None if own is None or len(own) > most else own for own in ids]
            coded = encode_texts(model, [own for own in ids if own is not None])
            for text, own in zip(texts, ids, strict=True):
                if own is None:
                    rows.append((None,) * 8)
                    continue
                bits, steps = next(coded)
                cost = [24 - math.log2(hi - lo) for _, lo, hi, *_ in steps]
                pieces = [{"piece": tokens.piece(t), "bits": round(c, 2), "clo": round(lo / TOTAL, 9), "chi": round(hi / TOTAL, 9), "emit": e, "pend": p} for (t, lo, hi, e, p), c in zip(steps, cost, strict=True)]
                size = len(text.encode())
                rows.append((text, bits_to_code(bits, version, digits), bits, len(steps), sum(cost), size, len(bits) / size if size else None, pieces))
            yield pd.DataFrame(rows, columns=["canonical", "code", "bits", "n_tokens", "model_bits", "url_bytes", "bits_per_char", "pieces"]).astype({"n_tokens": "Int64", "url_bytes": "Int64"})

    return df.withColumn("encoded", run(canonical_url(column)))


def decode(df: DataFrame, column: str, predictor, alphabet: int = 1, version: int = 0, emoji: str | None = None, tokens=ByteTokens) -> DataFrame:
    """df with `decoded`: struct(text, version, error) of each code; errors are values."""
    shared = df.sparkSession.sparkContext.broadcast(predictor)
    digits = digits_of(alphabet, emoji)

    @F.pandas_udf("text string, version int, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for codes in batches:
            rows, known = [], []
            for code in codes:
                try:
                    own, bits = code_to_bits(code or "", digits)
                    if own != version:
                        raise ValueError(f"stream version {own} is not {version}")
                    known.append(bits)
                    rows.append(None)
                except ValueError as e:
                    rows.append((None, None, str(e)))
            ids = decode_texts(model, known)
            for k, row in enumerate(rows):
                if row is None:
                    own = next(ids)
                    try:
                        rows[k] = (None, None, str(own)) if isinstance(own, ValueError) else (tokens.decode(own), version, None)
                    except ValueError as e:
                        rows[k] = (None, None, str(e))
            yield pd.DataFrame(rows, columns=["text", "version", "error"]).astype({"version": "Int32"})

    raw = df.withColumn("_raw", run(F.col(column)))
    return raw.withColumn("decoded", F.struct(canonical_url(F.col("_raw.text")).alias("text"), F.col("_raw.version").alias("version"), F.col("_raw.error").alias("error"))).drop("_raw")


def evaluate(df: DataFrame, column: str, predictor, alphabet: int = 1, tokens=ByteTokens, most: int = MAX_TOKENS) -> DataFrame:
    """One row over all non-empty texts: n, skipped (more than `most` tokens), bits, bytes, code characters and bits per character (a
    ratio of sums). Each code is decoded again, and one that gives another text raises an error."""
    rows = encode(df.where(F.col(column) != ""), column, predictor, alphabet, tokens=tokens, most=most)
    back = decode(rows.select(column, "encoded", F.col("encoded.code").alias("_code")), "_code", predictor, alphabet, tokens=tokens)
    fine = F.col("encoded.code").isNull() | F.col("decoded.text").eqNullSafe(F.col(column))
    rows = back.select("encoded.*", F.when(fine, F.lit(0)).otherwise(F.raise_error(F.concat(F.lit("the code gives another text than "), F.col(column)))).alias("_differs"))
    sums = rows.agg(F.count("code").alias("n"), F.count_if(F.col("code").isNull()).alias("skipped"), F.sum(F.length("bits")).alias("coded_bits"), F.sum("model_bits").alias("model_bits"), F.sum("url_bytes").alias("url_bytes"), F.sum(F.char_length("code")).alias("code_chars"), F.sum("_differs").alias("differing"))
    return sums.withColumn("bits_per_char", F.col("coded_bits") / F.col("url_bytes"))


def distribution(predictor, tokens: list[int], k: int, n: int, names=ByteTokens) -> tuple[list[tuple], tuple | None]:
    """(rows, actual) after the end token and the first k tokens: rows are (piece, prob, bits) by falling mass, ties by id; n <= 0 is all."""
    predictor.reset()
    weights = predictor.feed(END)
    for t in tokens[:k]:
        weights = predictor.feed(t)
    width = np.diff(grid(weights))
    order = np.lexsort((np.arange(len(width)), -width))
    row = lambda i: (names.piece(int(i)), round(width[i] / TOTAL, 6), round(24 - math.log2(width[i]), 2))
    following = [*tokens, END][k] if k <= len(tokens) else None
    actual = None if following is None else (*row(following), int(np.flatnonzero(order == following)[0]) + 1)
    return [row(i) for i in (order if n <= 0 else order[:n])], actual


def pick(weights: np.ndarray, rng: SplitMix, temperature: float = 1.0, top_k: int = 0) -> int:
    """A token: the heaviest at temperature 0 or below or NaN, else by inverse distribution over the top_k heaviest in id order."""
    if math.isnan(temperature) or temperature <= 0:
        return int(np.argmax(weights))
    scaled = np.power(weights, 1 / temperature) if temperature != 1 else weights
    chosen = np.arange(len(scaled))
    if 0 < top_k < len(scaled):
        chosen = np.sort(np.lexsort((chosen, -scaled))[:top_k])
    left = rng.unit() * float(np.cumsum(scaled[chosen])[-1])
    for i in chosen:
        left -= scaled[i]
        if left <= 0:
            return int(i)
    return int(chosen[-1])


def sample_ids(predictor, seed: int, prefix: list[int], temperature: float = 1.0, top_k: int = 0, max_tokens: int = 128) -> tuple[list[int], bool]:
    """(tokens with the prefix, whether the text ended); max_tokens is held between 1 and 4096."""
    rng, out = SplitMix(seed), list(prefix)
    most = max(1, min(4096, max_tokens))
    predictor.reset()
    weights = predictor.feed(END)
    for t in prefix:
        weights = predictor.feed(t)
    while len(out) < most:
        token = pick(weights, rng, temperature, top_k)
        if token == END:
            return out, True
        out.append(token)
        weights = predictor.feed(token)
    return out, False


def sample(seeds: DataFrame, predictor, prefix: str = "", temperature: float = 1.0, top_k: int = 0, max_tokens: int = 128, tokens=ByteTokens) -> DataFrame:
    """seeds (seed) with text, n_tokens and terminated; a seed gives the same text wherever it runs."""
    shared = seeds.sparkSession.sparkContext.broadcast(predictor)

    @F.pandas_udf("text string, n_tokens long, terminated boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for own in batches:
            made = [sample_ids(shared.value, int(s), tokens.encode(prefix), temperature, top_k, max_tokens) for s in own]
            yield pd.DataFrame([(tokens.show(ids), len(ids), ended) for ids, ended in made], columns=["text", "n_tokens", "terminated"])

    return seeds.withColumn("_s", run(F.col("seed").cast("long"))).select(*seeds.columns, "_s.*")


@functools.cache
def batch_seeds(seed: int, n: int, mixed: bool = True) -> tuple[int, ...]:
    """Seeds of a batch: mixed by a multiplier, or in a row."""
    return tuple((seed ^ i * 0x9E3779B9) if mixed else seed + i for i in range(n))
