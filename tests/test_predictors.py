"""Predictors: round trips, the packed format, and the step against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import predict as P
from wayfare.operators import transformer as T


@pytest.fixture(scope="module")
def model():
    return T.unpack(T.pack(T.synthetic((2, 2, 128, 257, 32, 128))))


def test_packed_format():
    config = (2, 2, 128, 257, 32, 128)
    made = T.synthetic(config)
    for version in (2, 3):
        raw = T.pack(made, version)
        back = T.unpack(raw)
        assert len(raw) == T.packed_size(config, version) and np.array_equal(back.wte.codes, made.wte.codes) and np.array_equal(back.layers[1].down.scales, made.layers[1].down.scales)
    assert T.packed_size((12, 20, 1280, 8192, 512, 3392)) == 130_862_112
    for bad in (b"XXXX" + raw[4:], raw[:4] + b"\x09" + raw[5:], raw[:-1]):
        with pytest.raises(ValueError):
            T.unpack(bad)


def test_matrix_against_a_loop(model):
    x = np.linspace(-1, 1, 128).astype(np.float32)
    q, scale = T.quantize_activation(x)
    got = model.layers[0].qkv.times((q, scale))
    for r in (0, 7, 383):
        acc = np.float32(0)
        for g in range(2):
            dot = sum(int(a) * int(b) for a, b in zip(model.layers[0].qkv.codes[r, g], q[g], strict=True))
            acc = np.float32(acc + np.float32(np.float32(dot) * np.float32(model.layers[0].qkv.scales[r, g] * scale[g])))
        assert got[r] == acc
    assert np.array_equal(T.quantize_activation(np.zeros(64, np.float32))[1], [1])


def test_exponentials():
    x = np.linspace(-30, 3, 200)
    assert np.allclose(T.exp64(x), np.exp(x), rtol=1e-10) and np.allclose(T.exp32(x), np.exp(x), rtol=1e-5)


def test_round_trip_with_chaining(model):
    predictor = T.TransformerPredictor(model)
    tokens = P.ByteTokens.encode("https://com.example/" + "ab/" * 12)
    bits, steps = P.encode_text(predictor, tokens)
    assert len(tokens) > model.config[4] and P.decode_bits(predictor, bits) == tokens
    assert sum(24 - math.log2(hi - lo) for _, lo, hi, *_ in steps) - 1 < len(bits) < sum(24 - math.log2(hi - lo) for _, lo, hi, *_ in steps) + 2.1
    record = T.trace(model, tokens, 3)
    assert len(record) == 2 and [len(a) for a in record[0]["attn"]] == [4, 4] and abs(sum(record[1]["attn"][0]) - 1) < 1e-3


def test_counts_and_samples(spark):
    texts = spark.createDataFrame([("https://com.a/x",), ("https://com.b/y",), (None,), ("",)], "u string")
    model = P.train_counts(texts, "u")
    tokens = P.ByteTokens.encode("https://com.a/x")
    bits, _ = P.encode_text(model, tokens)
    assert P.decode_bits(model, bits) == tokens and len(bits) < 60
    rows, actual = P.distribution(model, tokens, 3, 5)
    assert len(rows) == 5 and rows[0][1] >= rows[1][1] and actual[0] == "p"
    assert P.sample_ids(model, 5, tokens[:8]) == P.sample_ids(model, 5, tokens[:8])
    assert P.pick(np.array([0.2, 0.5, 0.5]), P.SplitMix(1), temperature=float("nan")) == 1
    assert len(P.sample_ids(model, 1, [], max_tokens=0)[0]) <= 1
    cum = P.grid(np.array([0.5, 0.5, 0.0]))
    assert cum[-1] == P.TOTAL and (np.diff(cum) >= 1).all()


def test_chaining_of_a_block_of_half_the_default(spark):
    """Texts longer than the block: the last half goes on."""
    model = T.synthetic((1, 2, 128, 257, 64, 128))
    predictor = T.TransformerPredictor(model)
    for n in (63, 64, 65, 70, 200):
        tokens = [1 + k % 250 for k in range(n)]
        bits, _ = P.encode_text(predictor, tokens)
        assert P.decode_bits(predictor, bits) == tokens
    again = T.TransformerPredictor(model)
    for t in [P.END, *range(1, 33)][-32:]:
        again.logits(t)
    long = T.TransformerPredictor(model)
    for t in [*([9] * 32), *[P.END, *range(1, 33)][-32:]]:
        long.logits(t)
    assert np.array_equal(long.logits(5), again.logits(5))  # the block is full, so the first half is forgotten


def test_texts_that_step_together(spark, monkeypatch):
    """Many texts take the steps of the longest alone, with the codes that each text gets by itself."""
    times, calls = T.Matrix.times, []
    monkeypatch.setattr(T.Matrix, "times", lambda self, x: calls.append(1) or times(self, x))
    rng = np.random.default_rng(3)
    for config in ((1, 2, 64, 300, 16, 64), (2, 5, 320, 257, 8, 64)):
        predictor = T.TransformerPredictor(T.synthetic(config))
        texts = [[int(t) for t in rng.integers(1, config[3], n)] for n in (40, 0, 1, 7, 8, 9, 16, 17, 23, *range(30))]
        alone = [P.encode_text(predictor, t) for t in texts]
        calls.clear()
        P.encode_text(predictor, texts[0])
        longest = len(calls)
        calls.clear()
        assert list(P.encode_texts(predictor, texts)) == alone and len(calls) == longest
        calls.clear()
        bits = [b for b, _ in alone]
        assert list(P.decode_texts(predictor, bits)) == texts and len(calls) == longest
        monkeypatch.setattr(T, "ROWS", 4)
        assert list(P.encode_texts(predictor, texts)) == alone and list(P.decode_texts(predictor, bits)) == texts
        monkeypatch.undo()
        monkeypatch.setattr(T.Matrix, "times", lambda self, x: calls.append(1) or times(self, x))
        endless = P._decode_block(predictor, bits[:3], most=5)
        assert [str(x) if isinstance(x, ValueError) else x for x in endless] == [P.NO_END, [], texts[2]]


def test_transformer_rows_of_one_file_are_dealt_out(spark, tmp_path):
    from wayfare.plans import codec

    rows = [(k, f"https://com.a/{k}") for k in range(300)] + [(300, None), (301, "")]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    out = codec.transformer_roundtrip(spark, str(tmp_path))
    assert out.select("page_id", "text").rdd.glom().map(len).filter(lambda n: n > 0).count() > 1
    assert {tuple(r) for r in out.select("page_id", "text").collect()} == set(rows)


def test_tokenizer_against_the_library(spark):
    import json

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer as Library

    from wayfare.operators import tokenizer as K
    from wayfare.sources.files import tokenizer_tables

    path = public.path("byte_bpe_50k.json")
    model = json.load(open(path))["model"]
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab = {t: i + 1 for t, i in model["vocab"].items()} | {K.EOS: 0}
    own, library = K.Tokenizer(vocab, merges), Library.from_file(path)
    texts = ["https://news.example.org/item?id=48920000", "xxxxxxxxxxxxx", "a--b", "https://münchen.de/日本語", "tokenization", ""]
    for t in texts:
        pieces = [p for p in K._PIECE.split(t) if p]
        assert own.encode(t) == [i + 1 for p in pieces for i in library.encode(p, add_special_tokens=False).ids]
        assert own.decode(own.encode(t)) == t
    with pytest.raises(UnicodeDecodeError):
        own.decode(own.encode("é")[:1] if len(own.encode("é")) > 1 else [vocab[K.byte_characters()[0xC3]]])
    with pytest.raises(ValueError):
        K.Tokenizer({"a": 0}, [])
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [r.i for r in df.select(K.tokenize(F.col("t"), own, spark).alias("i")).collect()] == [*map(own.encode, texts), None]
    assert tokenizer_tables is not None


def test_evaluation(spark):
    texts = spark.createDataFrame([("https://com.a/x",), ("https://com.b/yyyyyyyyyyyyyyyyy",), (None,), ("",)], "u string")
    model = P.train_counts(texts, "u")
    row = P.evaluate(texts, "u", model, most=20).first()
    assert (row.n, row.skipped, row.url_bytes, row.differing) == (1, 1, 15, 0)

    class Wrong(P.ByteTokens):
        @staticmethod
        def decode(tokens):
            return P.ByteTokens.decode(tokens[:-1])

    with pytest.raises(Exception, match="another text"):
        P.evaluate(texts, "u", model, tokens=Wrong).collect()
    small, big = P.train_counts(texts, "u"), P.train_counts(texts, "u", size=2000)
    assert small.two and not big.two and big.none[:257].tolist() == small.none.tolist()


def test_command_line(capsys):
    import json

    from wayfare import cli

    assert cli.main(["encode", "https://a.b/c", "--alphabet", "3"]) == 0
    code = capsys.readouterr().out.strip()
    assert cli.main(["decode", code, "--alphabet", "3", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["text"] == "https://a.b/c"
    assert cli.main(["encode", " "]) == 1 and cli.main(["decode", "é", "--json"]) == 1
    assert json.loads(capsys.readouterr().out)["ok"] is False
    assert cli.main(["fold", "x"]) == 2


def test_recovery():
    import threading

    from wayfare.operators.recover import POISONED, Recovering

    made = []

    def build():
        made.append(len(made))
        return made[-1]

    r = Recovering(build)
    assert r.call(lambda x: {"ok": True, "on": x})["on"] == 0
    assert r.call(lambda x: {"ok": True, "on": x} if x else {"ok": False, "code": POISONED}) == {"ok": True, "on": 1} and r.builds == 2
    assert r.call(lambda x: {"ok": False, "code": "other"}) == {"ok": False, "code": "other"} and r.builds == 2
    assert r.call(lambda x: {"ok": False, "code": POISONED})["ok"] is False and r.builds == 3  # a second fault is handed on
    gate, got = threading.Barrier(4), []

    def hit(x):
        if x == 2:
            gate.wait(10)
            return {"ok": False, "code": POISONED}
        return {"ok": True, "on": x}

    threads = [threading.Thread(target=lambda: got.append(r.call(hit))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert got == [{"ok": True, "on": 3}] * 4 and r.builds == 4  # one rebuild for all that the fault hit
