"""Fixed cases of the text, figure and coding functions."""

import pytest
from pyspark.sql import functions as F

from wayfare.functions import formats as X
from wayfare.functions import geometry as G
from wayfare.functions import texts as T
from wayfare.functions import urls as U
from wayfare.operators import coding as C


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def column_of(spark, values, f, kind="string"):
    return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_sniff_and_mark(spark):
    codes = ["abc", "⌚⌛", "/AB", "AB$", "AB$x", "a~b", "A.B", "A.b", ""]
    assert column_of(spark, codes, U.sniff_alphabet) == [None, 2, 3, 3, 0, 0, 3, 0, None]
    assert column_of(spark, ["abc", "a~b", "A.B"], lambda c: U.mark_code(c, F.lit(0))) == ["~abc", "a~b", "~A.B"]
    assert column_of(spark, ["ABC", "A$B", "/AB"], lambda c: U.mark_code(c, F.lit(3))) == ["/ABC", "A$B", "/AB"]


def test_links(spark):
    links = [" https://h/#a%21b﻿", "abc", "x#a%zz", "x#%ff", "x#a+b", "x#a#b", "x#%"]
    got = column_of(spark, links, U.parse_link)
    assert [g["code"] for g in got] == ["a!b", "abc", None, None, "a+b", "a#b", None]
    assert [g["error"] is not None for g in got] == [False, False, True, True, False, False, True]


def test_pieces_and_names(spark):
    assert column_of(spark, ["https://a.b/c%20d?x=1", "", "--"], U.url_pieces) == [["https://", "a", ".", "b", "/", "c", "%20", "d", "?", "x", "=", "1"], [], ["-", "-"]]
    assert column_of(spark, ["a/b c", "///", "x" * 80], lambda c: U.export_name(F.lit(""), c, F.lit("svg"))) == ["wayfare-a_b_c.svg", "wayfare-qr.svg", "wayfare-" + "x" * 64 + ".svg"]
    assert column_of(spark, ["https://Ab.c/Xy?q"], lambda c: U.qr_text(c, scheme=False)) == ["AB.C/Xy?q"]
    assert column_of(spark, ["a@b@c", "abc"], lambda c: F.array(*U.rpartition(c, "@"))) == [["a@b", "@", "c"], ["", "", "abc"]]


@pytest.mark.parametrize(
    "f, value, wanted",
    [
        (X.fmt_bytes, 130862112.0, "124.8 MiB"),
        (X.fmt_bits, 0.04, "<0.1 b"),
        (X.fmt_bits, 1.26, "1.3 b"),
        (X.fmt_count, 246119680.0, "246M"),
        (X.fmt_count, 4919922944.0, "4.9B"),
        (X.fmt_count, 19922944000.0, "20B"),
        (X.fmt_pct, 0.5, "50.000%"),
        (X.fmt_pct, 1.2e-7, "1.2×10⁻⁵%"),
        (X.fmt_pct, 0.0, "0%"),
        (X.fmt_seconds, 64000.0, "1:04"),
        (X.fmt_seconds, 300.0, "0.3 s"),
        (X.fmt_eta, 3700.0, "~4 s left"),
        (X.retry_text, 90.0, "2 minutes"),
        (X.retry_text, 0.2, "1 second"),
    ],
)
def test_figures(spark, f, value, wanted):
    assert column_of(spark, [value], f, "double") == [wanted]


def test_framing():
    for alphabet in (0, 1, 3):
        digits = C.digits_of(alphabet)
        for version in (0, 2, 3, 65, 66, 320):
            for bits in ("", "0", "000", "1011", "01" * 50):
                assert C.code_to_bits(C.bits_to_code(bits, version, digits), digits) == (version, bits)
    with pytest.raises(ValueError):
        C.version_header(321)
    for code, text in (("", "empty"), ("é", "invalid"), ("B", "truncated")):
        with pytest.raises(ValueError, match=text):
            C.code_to_bits(code, C.BASE64URL)
    emoji = "".join(chr(0x1F300 + k) for k in range(1024))
    assert C.code_to_bits(C.bits_to_code("0101" * 9, 1, emoji), emoji) == (1, "0101" * 9)


def test_coder_round_trip():
    rng = C.SplitMix(3)
    for _ in range(20):
        cuts = [0, *sorted({rng.below(C.TOTAL - 1) + 1 for _ in range(7)}), C.TOTAL]
        symbols = [rng.below(len(cuts) - 1) for _ in range(60)]
        bits = C.code_slices_of((cuts[s], cuts[s + 1]) for s in symbols)
        decoder, got = C.Decoder(bits), []
        for _ in symbols:
            t = decoder.target()
            s = max(k for k in range(len(cuts) - 1) if cuts[k] <= t)
            decoder.update(cuts[s], cuts[s + 1])
            got.append(s)
        assert got == symbols


def test_small_generators(spark):
    assert f"{C.fnv1a(b''):016x}" == "cbf29ce484222325" and f"{C.fnv1a(b'a'):016x}" == "af63dc4c8601ec8c"
    assert C.SplitMix(0).next() == 0xE220A8397B1DCDAF
    made = [C.made_url(1, k) for k in range(800)]
    assert made == [C.made_url(1, k) for k in range(800)] and len(set(made)) > 600
    assert all(len(made[k]) >= 600 for k in range(7, 800, 8)) and all("?" in made[k] for k in range(2, 800, 8))
    rows = [(1, k, [k, 7, 2**40]) for k in range(5)] + [(2, 0, None), (None, 1, [3])]
    df = spark.createDataFrame(rows, "g int, o int, v array<long>").repartition(3)
    wanted = {g: f"{C.fnv1a(b''.join(int(x).to_bytes(8, 'little') for r in rows if r[0] == g for x in r[2] or [])):016x}" for g in (1, 2, None)}
    assert {r.g: r.digest for r in C.ordered_digest(df, ["g"], ["o"], "v").collect()} == wanted
    assert {r.digest for r in C.ordered_digest(df, ["g"], ["o"], "v", on=False).collect()} == {"off"}


def test_fixed_rounds_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [0.25, 0.35, 1.005, 2.5, 0.5, 1.45, -0.04, -2.5, 1e15 + 0.5, 8.345, 1.255, 123456.78565, 0.0, 1 / 3, 5e-324, 9.995, 99.95]
    for digits in range(4):
        wanted = [("-" if v < 0 else "") + str(Decimal(abs(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values]
        assert column_of(spark, values, lambda v: X.fixed(v, digits), "double") == wanted  # noqa: B023


def test_sql_functions(spark):
    from wayfare.operators.tokenizer import Tokenizer

    own = Tokenizer.of_words(["https://", "com"])
    U.register(spark, own)
    texts = ["https://me@www.a.com:80/x?y#z", "http://1.2.3.4/", "ftp://a.b", "", " https://h/#a%21b ", "AB$", "a~b", "x#%zz", "a\u0001b/c", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, url string")
    got = df.selectExpr("i", "canonical_url(url) AS c", "url_pieces(url) AS p", "sniff_alphabet(url) AS a", "mark_code(url, 0) AS m", "parse_link(url) AS l", "is_http(url) AS h", "url_tokens(url) AS t", "unframe_code(frame_bits('0101', 3, 1), 1) AS f").orderBy("i").collect()
    want = df.select("i", U.canonical_url("url").alias("c"), U.url_pieces("url").alias("p"), U.sniff_alphabet("url").alias("a"), U.mark_code("url", F.lit(0)).alias("m"), U.parse_link("url").alias("l"), U.is_http("url").alias("h")).orderBy("i").collect()
    assert [tuple(r)[:7] for r in got] == [tuple(r) for r in want]
    assert [r.t for r in got] == [None if t is None else own.encode(t) for t in texts] and got[0].f.bits == "0101" and got[0].f.version == 3
    assert want[8].p == ["a\u0001b", "/", "c"]


def test_captions_and_shares(spark):
    wrap = lambda t, n: [r for r in column_of(spark, [t], lambda c: T.wrap_caption(c, F.lit(0.55 * n + 0.01), F.lit(1.0)))[0]]
    assert wrap("one two three", 7) == ["one two", "three"] and wrap("abcdefgh ij", 3) == ["abc", "def", "gh", "ij"]
    assert wrap("a\n\nb", 5) == ["a", "", "b"] and wrap("\na\n", 5) == ["a"] and wrap("", 5) == [] and wrap("ab abcd", 4) == ["ab", "abcd"]
    assert column_of(spark, [0.999, 0.5, 0.0123, 0.00012345, 2.3e-9], lambda c: T.kept_share(F.lit(0.0), c), "double") == ["~100% kept", "50% kept", "1.2% kept", "0.012% kept", "2.3e-07% kept"]
    with pytest.raises(Exception, match="missing"):
        column_of(spark, ["{}"], lambda c: T.required(c, "a.b"))
    assert column_of(spark, ['{"a":{"b":3}}'], lambda c: T.required(c, "a.b", "number")) == [3.0]
    with pytest.raises(Exception, match="drifts"):
        column_of(spark, [10.0], lambda c: T.scaled(c, F.lit(100.0), 4.0), "double")


def test_cell_hash(spark):
    def brute(r, c, seed):
        h = (r * 73856093 ^ c * 19349663 ^ int(float(seed) * 83492791.0)) & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0x5BD1E995 & 0xFFFFFFFF
        return (h ^ h >> 15) / (1 << 32)

    seeds = [0, 1, -1, 123456789, -(2**31), 2**31 - 1]
    assert column_of(spark, seeds, lambda s: G.cell_hash(F.lit(17), F.lit(40), s), "long") == [brute(17, 40, s) for s in seeds]
