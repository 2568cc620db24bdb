"""Plans that code whole tables: tokens, round trips, evaluation, replays, samples, made-up URLs and packed weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import coding, predict, tokenizer, transformer
from .registry import query, table
from .urls import _PIECES

#: Words that the plans' tokenizer builds up; another vocabulary comes from a tokenizer file.
WORDS = ["https://", "http://", "www", "com", "net", "org", "example", "blog", "ther", "the", "tion", "html", "page", "ref", "top", "in", "re", "en", "an", "ha"]


def url_tokenizer() -> tokenizer.Tokenizer:
    return tokenizer.Tokenizer.of_words(WORDS)


def _token_sql() -> str:
    """Merges in the order of their ranks, as replacements: words are built from the left, so a merge makes no pair of a lower rank."""
    own = url_tokenizer()
    merged = "regexp_replace(piece, '(.)', '«\\1»', 'g')"
    for a, b in own.merges:
        merged = f"replace({merged}, '«{a}»«{b}»', '«{a + b}»')"
    longer = ", ".join(f"'{t}'" for t, i in sorted(own.vocab.items(), key=lambda x: x[1]) if i > 256)
    return (
        _PIECES
        + f""",
tl AS (SELECT page_id, pos, string_split(replace(replace({merged}, '»«', chr(1)), '«', ''), chr(1)) AS l FROM (SELECT page_id, pos, piece FROM p)),
tu AS (SELECT page_id, pos, unnest(l) AS raw, generate_subscripts(l, 1) AS k FROM tl),
tok AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos, k) - 1 AS pos, replace(raw, '»', '') AS token FROM tu),
ids AS (SELECT page_id, pos, token, CASE WHEN length(token) = 1 THEN ascii(token) + 1 ELSE 256 + list_position([{longer}], token) END AS id FROM tok)"""
    )


_TOKENS = _token_sql()
_COUNTS = f"{_TOKENS}, n AS (SELECT page_id, count(*) AS n FROM ids GROUP BY 1)"
_SIZE = len(url_tokenizer())


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


def tokens(spark, sf_dir):
    """(page_id, url, canonical, ids) of all pages."""
    rows = _pages(spark, sf_dir).withColumn("canonical", U.canonical_url("url"))
    return rows.withColumn("ids", tokenizer.tokenize(F.col("canonical"), url_tokenizer(), spark))


def _predictor(spark, sf_dir):
    """Counts over the tokens of the table's own URLs."""
    return predict.train_counts(tokens(spark, sf_dir), "canonical", F.col("ids"), _SIZE)


@query("url_tokens", f"WITH {_TOKENS} SELECT page_id, pos::INT AS pos, id::INT AS id, token FROM ids")
def url_tokens(spark, sf_dir):
    rows = tokens(spark, sf_dir).select("page_id", F.posexplode("ids").alias("pos", "id"))
    names = tokenizer.pieces_of(url_tokenizer(), spark)  # a vocabulary
    return rows.join(F.broadcast(names), "id").select("page_id", "pos", "id", F.col("piece").alias("token"))


@query("token_decode", f"WITH {_PIECES} SELECT page_id, CASE WHEN page_id % 9 <> 4 THEN canonical END AS text, CASE WHEN page_id % 9 = 4 THEN 'an unknown token' END AS error FROM canon")
def token_decode(spark, sf_dir):
    """Ids to texts; here every ninth row holds an id that the vocabulary lacks."""
    odd = F.when(F.col("page_id") % 9 == 4, F.concat("ids", F.array(F.lit(99999)))).otherwise(F.col("ids"))
    return tokens(spark, sf_dir).withColumn("back", tokenizer.detokenize(odd, url_tokenizer(), spark)).select("page_id", "back.text", "back.error")


@query("token_stats", f"WITH {_COUNTS} SELECT count(*) AS urls, sum(n)::BIGINT AS tokens, round(sum(octet_length(encode(url))) / sum(n), 6) AS chars_per_token, round(sum(n) / count(*), 6) AS tokens_per_url, max(n) AS most FROM n JOIN pages USING (page_id)")
def token_stats(spark, sf_dir):
    rows = tokens(spark, sf_dir).select(F.size("ids").cast("bigint").alias("k"), F.octet_length("url").alias("o"))
    return rows.agg(F.count(F.lit(1)).alias("urls"), F.sum("k").alias("tokens"), F.round(F.sum("o") / F.sum("k"), 6).alias("chars_per_token"), F.round(F.sum("k") / F.count(F.lit(1)), 6).alias("tokens_per_url"), F.max("k").alias("most"))


@query("token_test", "SELECT count(*) FILTER (WHERE page_id % 5 <> 2) AS ok, count(*) FILTER (WHERE page_id % 5 = 2) AS mismatched FROM pages")
def token_test(spark, sf_dir):
    """The tokenizer against cases that replacements in Spark SQL made; every fifth case is made wrong."""
    own = url_tokenizer()
    ids = F.create_map(*(F.lit(x) for t, i in own.vocab.items() for x in (t, i)))
    rows = _pages(spark, sf_dir).withColumn("canonical", U.canonical_url("url"))

    def merged(piece):
        out = F.regexp_replace(piece, "(.)", "«$1»")
        for a, b in own.merges:
            out = F.replace(out, F.lit(f"«{a}»«{b}»"), F.lit(f"«{a + b}»"))
        return F.split(F.regexp_replace(out, "^«|»$", ""), "»«")

    golden = F.transform(F.flatten(F.transform(U.url_pieces("canonical"), merged)), lambda t: F.element_at(ids, t))
    cases = rows.select("canonical", F.when(F.col("page_id") % 5 == 2, F.concat(golden, F.array(F.lit(1)))).otherwise(golden).alias("ids"))
    return tokenizer.token_test(cases, own)


_VOCABULARY = ", ".join(f"({i}, '{t}')" for t, i in sorted(url_tokenizer().vocab.items(), key=lambda x: x[1]) if i > 256)


@query("vocabulary_search", f"SELECT id, piece FROM (VALUES {_VOCABULARY}) v(id, piece) WHERE contains(piece, 'th') ORDER BY id LIMIT 400")
def vocabulary_search(spark, sf_dir):
    """The first pieces by id that hold a text, as a list shows them."""
    return tokenizer.search(tokenizer.pieces_of(url_tokenizer(), spark), "th")


@query("codec_roundtrip", f"WITH {_COUNTS} SELECT page_id, url AS text, n + 1 AS n_tokens, octet_length(encode(url))::BIGINT AS url_bytes, true AS bounded FROM pages JOIN n USING (page_id)")
def codec_roundtrip(spark, sf_dir):
    """Each URL coded by its tokens and decoded; the bits stay within two of the model's cost."""
    model, own = _predictor(spark, sf_dir), url_tokenizer()
    bounded = F.length("encoded.bits") < F.col("encoded.model_bits") + 2.1
    coded = predict.encode(_pages(spark, sf_dir), "url", model, tokens=own).select("page_id", "encoded.n_tokens", "encoded.url_bytes", F.col("encoded.code").alias("code"), bounded.alias("bounded"))
    return predict.decode(coded, "code", model, tokens=own).select("page_id", "decoded.text", "n_tokens", "url_bytes", "bounded")


@query("codec_eval", f"WITH {_COUNTS} SELECT count(*) FILTER (WHERE n <= 24) AS n, count(*) FILTER (WHERE n > 24) AS skipped, CAST(sum(CASE WHEN n <= 24 THEN octet_length(encode(url)) END) AS BIGINT) AS url_bytes, true AS below_bytes FROM n JOIN pages USING (page_id)")
def codec_eval(spark, sf_dir):
    """Corpus cost with the count predictor, texts over 24 tokens skipped: a figure of our own, not comparable with other models'."""
    out = predict.evaluate(_pages(spark, sf_dir), "url", _predictor(spark, sf_dir), tokens=url_tokenizer(), most=24)
    return out.select("n", "skipped", "url_bytes", (F.col("bits_per_char") < 8).alias("below_bytes"))


@query("codec_bits_per_char")
def codec_bits_per_char(spark, sf_dir):
    """The evaluation's figures over all pages."""
    return predict.evaluate(_pages(spark, sf_dir), "url", _predictor(spark, sf_dir), tokens=url_tokenizer())


@query("codec_replay", f"WITH {_COUNTS} SELECT page_id, (n + 1)::INT AS n_steps, page_id % 4 <> 1 AS agrees FROM n")
def codec_replay(spark, sf_dir):
    """The coder replayed from the rounded slices of each URL; in every fourth row a recorded count is made wrong, which it has to find."""
    coded = predict.encode(_pages(spark, sf_dir), "url", _predictor(spark, sf_dir), tokens=url_tokenizer()).select("page_id", "encoded.pieces", "encoded.bits")
    wrong = F.transform("pieces", lambda p, i: F.when(i == 0, p.withField("emit", p["emit"] + 1)).otherwise(p))
    rows = coded.withColumn("pieces", F.when(F.col("page_id") % 4 == 1, wrong).otherwise(F.col("pieces")))
    played = rows.withColumn("played", coding.replay(F.col("pieces")))
    return played.select("page_id", F.size("played.steps").alias("n_steps"), coding.replay_agrees(F.col("played"), F.col("bits"), F.col("pieces")).alias("agrees"))


@query("codec_decode_errors", "SELECT * FROM (VALUES ('', 'empty or invalid coded string'), ('A', 'empty or invalid coded string'), ('B', 'truncated stream header'), ('a b', 'invalid coded character '' '''), ('G', 'stream version 2 is not 0')) t(code, error)")
def codec_decode_errors(spark, sf_dir):
    """Bad codes give rows with an error."""
    rows = spark.createDataFrame([("",), ("A",), ("B",), ("a b",), ("G",)], "code string")
    codes = predict.decode(rows, "code", predict.CountPredictor({}, {}, np.ones(257)))
    return codes.select("code", F.col("decoded.error").alias("error"))


@query("sample_seeded")
def sample_seeded(spark, sf_dir):
    """Thirty-two texts from seeds; the same on every cluster."""
    seeds = spark.createDataFrame([(int(s),) for s in predict.batch_seeds(7, 32)], "seed long")
    return predict.sample(seeds, _predictor(spark, sf_dir), prefix="https://", top_k=40, max_tokens=64, tokens=url_tokenizer())


@query("fuzz_urls")
def fuzz_urls(spark, sf_dir):
    """Two thousand made-up URLs of eight shapes."""
    made = F.pandas_udf(lambda i: i.map(lambda k: coding.made_url(7, int(k))), "string")
    return spark.range(2000).select(F.col("id").alias("idx"), (F.col("id") % 8).alias("mode"), made("id").alias("url"))


#: Digits of alphabet 2, which are the caller's: here 1,024 characters in a row.
DIGITS = "".join(chr(0x4E00 + k) for k in range(1024))


@query("fuzz_roundtrip", "SELECT i::BIGINT AS idx, ((i + i // 8) % 4)::INT AS alphabet, 'ok' AS status FROM range(0, 2000) t(i)")
def fuzz_roundtrip(spark, sf_dir):
    """All made-up URLs, whole, through encoding and decoding; the alphabets take turns."""
    model = predict.train_counts(fuzz_urls(spark, sf_dir).withColumn("u", U.canonical_url("url")), "u")
    urls = fuzz_urls(spark, sf_dir).withColumn("alphabet", ((F.col("idx") + F.floor(F.col("idx") / 8)) % 4).cast("int"))
    out = None
    for alphabet in range(4):
        coded = predict.encode(urls.where(F.col("alphabet") == alphabet), "url", model, alphabet=alphabet, emoji=DIGITS).select("idx", "alphabet", "url", F.col("encoded.code").alias("code"))
        back = predict.decode(coded, "code", model, alphabet=alphabet, emoji=DIGITS)
        out = back if out is None else out.unionByName(back)
    return out.select("idx", "alphabet", F.when(F.col("decoded.text").eqNullSafe(F.col("url")), "ok").otherwise(F.coalesce("decoded.error", F.lit("differs"))).alias("status"))


@query("canonical_of_fuzz", "SELECT CAST(2000 AS BIGINT) AS n, CAST(2000 AS BIGINT) AS same")
def canonical_of_fuzz(spark, sf_dir):
    u = fuzz_urls(spark, sf_dir)
    return u.agg(F.count(F.lit(1)).alias("n"), F.count_if(U.canonical_url(U.canonical_url("url")) == F.col("url")).alias("same"))


def _transformer():
    """Small made-up weights over the plans' vocabulary; a block of 16 tokens, so that longer URLs chain."""
    return transformer.TransformerPredictor(transformer.unpack(transformer.pack(transformer.synthetic((1, 2, 64, _SIZE, 16, 64)))))


@query("transformer_roundtrip", f"WITH {_COUNTS} SELECT page_id, url AS text, n + 1 AS n_tokens FROM pages JOIN n USING (page_id)")
def transformer_roundtrip(spark, sf_dir):
    """All pages coded and decoded with a packed transformer. URLs are short and steps costly, so rows are dealt out whatever files they lie in."""
    predictor, own = _transformer(), url_tokenizer()
    rows = _pages(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    coded = predict.encode(rows, "url", predictor, tokens=own).select("page_id", "encoded.n_tokens", F.col("encoded.code").alias("code"))
    return predict.decode(coded, "code", predictor, tokens=own).select("page_id", "decoded.text", "n_tokens")


@query("codec_trace", f"WITH {_COUNTS} SELECT page_id, 0 AS layer, h::INT AS head, least(n, 5)::INT + 1 AS attended, true AS sums_to_one FROM n, (VALUES (0), (1)) b(h)")
def codec_trace(spark, sf_dir):
    """The step that predicts each URL's sixth token (or its end), a row for each layer and head: what it attends to."""
    rows = tokens(spark, sf_dir).select("page_id", F.slice("ids", 1, 5).alias("ids"))
    made = transformer.trace_rows(rows, "ids", _transformer().model)
    heads = made.select("page_id", F.col("step.layer").alias("layer"), F.posexplode("step.attn").alias("head", "weights"))
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return heads.select("page_id", "layer", "head", F.size("weights").alias("attended"), (F.abs(total - 1) < 0.01).alias("sums_to_one"))


@query("codec_info", f"SELECT true AS ok, 1 AS n_layer, 2 AS n_head, 64 AS d_model, {_SIZE} AS vocab, 16 AS block, CAST({_SIZE} * 64 + 16 * 64 + 3 * 64 + 4 * 64 * 64 + 3 * 64 * 64 AS BIGINT) AS params, CAST(32 AS BIGINT) AS wte_offset, CAST(32 + {_SIZE} * 34 AS BIGINT) AS wpe_offset, 'scalar' AS kernel, false AS poisoned, 0 AS stream_version")
def codec_info(spark, sf_dir):
    """Facts of a loaded model: sizes, layout and kernel, in one row."""
    return transformer.info(spark, _transformer().model)


@query("digest_of_rows")
def digest_of_rows(spark, sf_dir):
    """The ordered digest of each label's vectors, as bit patterns of float32."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<float>").alias("e"))
    return coding.ordered_digest(rows, ["label"], ["vec_id"], "e", "<f4")


@query("compressor_sizes")
def compressor_sizes(spark, sf_dir):
    """Bytes of each URL under general compressors; they depend on the libraries' builds."""
    import bz2
    import lzma
    import zlib

    @F.pandas_udf("deflate int, gzip int, bzip2 int, xz int")
    def run(texts):
        import pandas as pd

        rows = []
        for t in texts:
            raw = (t or "").encode()
            packer = zlib.compressobj(9, zlib.DEFLATED, -15)
            rows.append((len(packer.compress(raw) + packer.flush()), len(zlib.compress(raw, 9)) + 12, len(bz2.compress(raw, 9)), len(lzma.compress(raw, preset=9))))
        return pd.DataFrame(rows, columns=["deflate", "gzip", "bzip2", "xz"])

    return _pages(spark, sf_dir).select("page_id", F.octet_length("url").alias("raw"), run("url").alias("z")).select("page_id", "raw", "z.*")
