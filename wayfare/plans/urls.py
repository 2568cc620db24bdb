"""Plans over pages.url: canonical form, pieces, classes, links, alphabets, and the cost of each URL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quant
from ..functions import urls as U
from ..operators import coding
from .registry import query, table

_PARTS = """
a AS (SELECT page_id, url AS u, regexp_extract(url, '^(https?://)', 1) AS sch, regexp_extract(url, '^https?://([^/?#]*)', 1) AS au, regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS tail FROM pages),
b AS (SELECT *, regexp_extract(au, '^(.*@)', 1) AS ui, regexp_extract(au, '([^@]*)$', 1) AS hp FROM a),
c AS (SELECT *, regexp_extract(hp, '(:[0-9]+)$', 1) AS port, left(hp, length(hp) - length(regexp_extract(hp, '(:[0-9]+)$', 1))) AS host FROM b),
canon AS (SELECT page_id, u AS url, CASE WHEN sch = '' THEN u ELSE sch || ui || CASE WHEN host LIKE '%[%' OR host LIKE '%:%' OR (regexp_matches(host, '^[0-9]{1,3}([.][0-9]{1,3}){3}$')
  AND len(list_filter(string_split(host, '.'), lambda p: try_cast(p AS INT) >= 256)) = 0) THEN host ELSE array_to_string(list_reverse(string_split(host, '.')), '.') END || port || tail END AS canonical FROM c)"""
_PIECES = _PARTS + r""",
lists AS (SELECT page_id, url, canonical, list_filter(string_split(regexp_replace(canonical, '(https://|http://|%[0-9A-Fa-f]{2}|[!#$%&''()*+,./:;=?@\[\\\]^_`{|}~-])', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS pieces FROM canon),
p AS (SELECT page_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS pos FROM lists)"""
_GRID = _PIECES + """,
n AS (SELECT piece, count(*) AS n FROM p GROUP BY piece),
f AS (SELECT piece, n, CAST(floor(n / sum(n) OVER () * (16777216 - count(*) OVER ())) AS BIGINT) + 1 AS f, row_number() OVER (ORDER BY n DESC, piece) AS r FROM n),
g AS (SELECT piece, n, f + CASE WHEN r = 1 THEN 16777216 - sum(f) OVER () ELSE 0 END AS freq FROM f),
grid AS (SELECT piece, n, CAST(freq AS BIGINT) AS freq, CAST(sum(freq) OVER (ORDER BY piece ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_hi FROM g),
bits AS (SELECT piece, n, freq, cum_hi - freq AS cum_lo, cum_hi, 24 - log2(freq) AS bits FROM grid)"""


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


def pieces(spark, sf_dir):
    """(page_id, pos, piece) of canonical URLs."""
    return pages(spark, sf_dir).select("page_id", F.posexplode(U.url_pieces(U.canonical_url("url"))).alias("pos", "piece"))


def piece_grid(spark, sf_dir):
    """(piece, n, freq, cum_lo, cum_hi, bits): the distinct pieces are a dictionary that stays small beside the table."""
    counts = pieces(spark, sf_dir).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    out = quant.quantize(counts, [], "piece", "n")
    return out.withColumn("bits", quant.information(F.col("cum_lo"), F.col("cum_hi")))


def piece_bits(spark, sf_dir):
    return pieces(spark, sf_dir).join(piece_grid(spark, sf_dir).select("piece", "bits"), "piece")


@query("url_canonical", f"WITH {_PARTS} SELECT page_id, canonical FROM canon")
def url_canonical(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.canonical_url("url").alias("canonical"))


_ODD = "(SELECT page_id, CASE page_id % 7 WHEN 0 THEN replace(url, '://', '://me:pw@') WHEN 1 THEN replace(url, '://', '://10.' || (page_id % 300) || '.7.1:80/?') WHEN 2 THEN replace(url, '://', '://[::1]:8080/') WHEN 3 THEN replace(url, '://', '://a@b@') WHEN 4 THEN 'ftp' || url WHEN 5 THEN replace(url, '/', ':/') ELSE url || chr(10) || '#@x.y' END AS url FROM pages)"
_ODD_PARTS = _PARTS.replace("FROM pages)", f"FROM {_ODD} odd)").replace("regexp_extract(url, '^https?://[^/?#]*(.*)$', 1)", "regexp_extract(url, '^https?://[^/?#]*(.*)$', 1, 's')")


@query("url_canonical_odd", f"WITH {_ODD_PARTS} SELECT page_id, url, canonical FROM canon")
def url_canonical_odd(spark, sf_dir):
    """User names, addresses, ports, other schemes and line ends."""
    u, k = F.col("url"), F.col("page_id")
    put = lambda x: F.replace(u, F.lit("://"), x if not isinstance(x, str) else F.lit(x))
    odd = (
        F.when(k % 7 == 0, put("://me:pw@")).when(k % 7 == 1, put(F.concat(F.lit("://10."), (k % 300).cast("string"), F.lit(".7.1:80/?")))).when(k % 7 == 2, put("://[::1]:8080/"))
        .when(k % 7 == 3, put("://a@b@")).when(k % 7 == 4, F.concat(F.lit("ftp"), u)).when(k % 7 == 5, F.replace(u, F.lit("/"), F.lit(":/"))).otherwise(F.concat(u, F.lit("\n#@x.y")))
    )
    return pages(spark, sf_dir).select("page_id", odd.alias("url")).withColumn("canonical", U.canonical_url("url"))


@query("url_canonical_involution", "SELECT page_id, url AS back FROM pages")
def url_canonical_involution(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.canonical_url(U.canonical_url("url")).alias("back"))


@query("url_pieces", f"WITH {_PIECES} SELECT page_id, CAST(pos AS BIGINT) AS pos, piece FROM p")
def url_pieces(spark, sf_dir):
    return pieces(spark, sf_dir).withColumn("pos", F.col("pos").cast("bigint"))


@query("piece_counts", f"WITH {_PIECES} SELECT piece, count(*) AS n, count(DISTINCT page_id) AS urls FROM p GROUP BY piece")
def piece_counts(spark, sf_dir):
    return pieces(spark, sf_dir).groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("urls"))


@query("piece_stats", f"WITH {_PIECES}, u AS (SELECT page_id, octet_length(encode(url)) AS o, len(pieces) AS k FROM lists) SELECT count(*) AS urls, sum(k)::BIGINT AS tokens, sum(o)::BIGINT AS bytes, round(sum(o) / sum(k), 6) AS bytes_per_token, round(sum(k) / count(*), 6) AS tokens_per_url, max(k)::BIGINT AS most FROM u")
def piece_stats(spark, sf_dir):
    u = pages(spark, sf_dir).select(F.octet_length("url").cast("bigint").alias("o"), F.size(U.url_pieces(U.canonical_url("url"))).cast("bigint").alias("k"))
    return u.agg(F.count(F.lit(1)).alias("urls"), F.sum("k").alias("tokens"), F.sum("o").alias("bytes"), F.round(F.sum("o") / F.sum("k"), 6).alias("bytes_per_token"), F.round(F.sum("k") / F.count(F.lit(1)), 6).alias("tokens_per_url"), F.max("k").alias("most"))


_TLD = ", ".join(f"'{t}'" for t in U.TLDS)
_CLASS = rf"""CASE WHEN piece = '<eos>' THEN 'eos' WHEN piece IN ('https://', 'http://') THEN 'scheme' WHEN regexp_matches(piece, '^%[0-9A-Fa-f]{{2}}$') THEN 'escape'
 WHEN regexp_matches(piece, '^[!#$%&''()*+,./:;=?@\[\]^_`{{|}}~-]$') THEN 'delimiter' WHEN piece IN ({_TLD}) THEN 'tld' WHEN regexp_matches(piece, '^[0-9]+$') THEN 'digits' WHEN regexp_matches(piece, '^[A-Za-z]+$') THEN 'word' ELSE 'mixed' END"""


@query("token_class_histogram", f"WITH {_PIECES} SELECT {_CLASS} AS class, count(*) AS n, count(DISTINCT piece) AS distinct_pieces FROM p GROUP BY 1")
def token_class_histogram(spark, sf_dir):
    return pieces(spark, sf_dir).groupBy(U.piece_class("piece").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("distinct_pieces"))


@query("url_link_parts", r"SELECT page_id, regexp_extract(url, '^(https?://)', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS tail FROM pages")
def url_link_parts(spark, sf_dir):
    p = U.authority_parts("url")
    return pages(spark, sf_dir).select("page_id", p["scheme"].alias("scheme"), F.concat(p["userinfo"], p["host"], p["port"]).alias("host"), p["tail"].alias("tail"))


@query("url_is_http", "SELECT page_id, regexp_matches(url, '(?i)^https?://') AS http, regexp_matches(upper(url), '(?i)^https?://') AS upper_http FROM pages")
def url_is_http(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.is_http("url").alias("http"), U.is_http(F.upper("url")).alias("upper_http"))


@query("url_qr_text", r"SELECT page_id, upper(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || substr(url, length(regexp_extract(url, '^(https?://[^/?#]*)', 1)) + 1) AS text, upper(regexp_extract(url, '^https?://([^/?#]*)', 1)) || regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS bare FROM pages")
def url_qr_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.qr_text("url").alias("text"), U.qr_text("url", scheme=False).alias("bare"))


_CODES = "codes AS (SELECT page_id, CASE CAST(page_id % 5 AS INT) WHEN 0 THEN left(sha256(url), 12) WHEN 1 THEN upper(left(sha256(url), 11)) WHEN 2 THEN upper(left(sha256(url), 9)) || '$*' WHEN 3 THEN left(sha256(url), 10) || '!' ELSE upper(left(sha256(url), 8)) || '/A' END AS code FROM pages)"


def codes(spark, sf_dir):
    """Made-up codes of several shapes, by page."""
    h = F.sha2("url", 256)
    k = F.col("page_id") % 5
    code = F.when(k == 0, F.left(h, F.lit(12))).when(k == 1, F.upper(F.left(h, F.lit(11)))).when(k == 2, F.concat(F.upper(F.left(h, F.lit(9))), F.lit("$*"))).when(k == 3, F.concat(F.left(h, F.lit(10)), F.lit("!"))).otherwise(F.concat(F.upper(F.left(h, F.lit(8))), F.lit("/A")))
    return pages(spark, sf_dir).select("page_id", code.alias("code"))


_SNIFF = "CASE WHEN regexp_matches(code, '[^\\x00-\\x7F]') THEN 2 WHEN contains(code, '/') OR (regexp_matches(code, '^[/0-9A-Z$*+.:-]+$') AND regexp_matches(code, '[$*+.:]')) THEN 3 WHEN regexp_matches(code, '[~.!$&''()*+,;=:@]') THEN 0 END"


@query("alphabet_sniff", f"WITH {_CODES} SELECT page_id, code, CAST({_SNIFF} AS INT) AS alphabet FROM codes")
def alphabet_sniff(spark, sf_dir):
    return codes(spark, sf_dir).withColumn("alphabet", U.sniff_alphabet("code"))


@query(
    "alphabet_mark",
    f"""WITH {_CODES}, x AS (SELECT page_id, code, unnest([0, 1, 3]) AS alphabet FROM codes) SELECT page_id, CAST(alphabet AS INT) AS alphabet,
  CASE WHEN alphabet = 0 AND (NOT regexp_matches(code, '[~.!$&''()*+,;=:@]') OR regexp_matches(code, '^[/0-9A-Z$*+.:-]+$')) THEN '~' || code
  WHEN alphabet = 3 AND NOT contains(code, '/') AND NOT regexp_matches(code, '[$*+.:]') THEN '/' || code ELSE code END AS bare FROM x""",
)
def alphabet_mark(spark, sf_dir):
    rows = codes(spark, sf_dir).withColumn("alphabet", F.explode(F.array(*map(F.lit, (0, 1, 3)))))
    return rows.select("page_id", "alphabet", U.mark_code("code", "alphabet").alias("bare"))


@query("alphabet_sizes", "SELECT alphabet, name, CAST(b AS DOUBLE) AS bits_per_char FROM (VALUES (0, 'base79', 6.303781), (1, 'base64url', 6.0), (2, 'emoji-1k', 10.0), (3, 'qr-alpha', 5.426265)) t(alphabet, name, b)")
def alphabet_sizes(spark, sf_dir):
    return U.alphabet_table(spark).select("alphabet", "name", F.round(F.log2("size"), 6).alias("bits_per_char"))


@query("link_parse", f"WITH {_CODES}, l AS (SELECT page_id, '  https://host/#' || CASE WHEN contains(code, '!') THEN replace(code, '!', '%21') ELSE code END || ' ' AS link, code FROM codes) SELECT page_id, link, code, CAST({_SNIFF} AS INT) AS alphabet, CAST(NULL AS VARCHAR) AS error FROM l")
def link_parse(spark, sf_dir):
    link = F.concat(F.lit("  "), U.link_with(F.lit("https://host/#old"), F.replace(F.col("code"), F.lit("!"), F.lit("%21"))), F.lit(" "))
    return codes(spark, sf_dir).select("page_id", link.alias("link")).withColumn("p", U.parse_link("link")).select("page_id", "link", "p.code", "p.alphabet", "p.error")


@query("export_names", r"SELECT page_id, 'wayfare-' || left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 64) || '.svg' AS name FROM pages")
def export_names(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.export_name(F.lit(""), "url", F.lit("svg")).alias("name"))


@query("escaped_text", "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html_md5, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS xml_md5 FROM pages")
def escaped_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(U.escape_html("html").cast("binary")).alias("html_md5"), F.md5(U.escape_xml("html").cast("binary")).alias("xml_md5"))


@query("prob_quantize", f"WITH {_GRID} SELECT piece, n, freq, cum_lo, cum_hi FROM bits")
def prob_quantize(spark, sf_dir):
    return piece_grid(spark, sf_dir).select("piece", "n", "freq", "cum_lo", "cum_hi")


@query("token_bits", f"WITH {_GRID} SELECT piece, round(bits, 6) AS bits FROM bits")
def token_bits(spark, sf_dir):
    return piece_grid(spark, sf_dir).select("piece", F.round("bits", 6).alias("bits"))


@query("url_total_bits", f"WITH {_GRID} SELECT page_id, count(*) AS n_pieces, round(sum(bits), 6) AS bits, round(sum(bits) / any_value(octet_length(encode(url))), 6) AS bits_per_char FROM p JOIN bits USING (piece) JOIN canon USING (page_id) GROUP BY page_id")
def url_total_bits(spark, sf_dir):
    size = pages(spark, sf_dir).select("page_id", F.octet_length("url").alias("o"))
    sums = piece_bits(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("bits").alias("b"))
    return sums.join(size, "page_id").select("page_id", "n_pieces", F.round("b", 6).alias("bits"), F.round(F.col("b") / F.col("o"), 6).alias("bits_per_char"))


@query("corpus_bits_per_char", f"WITH {_GRID}, t AS (SELECT sum(bits) AS b FROM p JOIN bits USING (piece)), s AS (SELECT sum(octet_length(encode(url))) AS o, count(*) AS urls FROM pages) SELECT urls, o::BIGINT AS bytes, round(b, 4) AS bits, round(b / o, 6) AS bits_per_char FROM t, s")
def corpus_bits_per_char(spark, sf_dir):
    # two one-row aggregates side by side
    bits = piece_bits(spark, sf_dir).agg(F.sum("bits").alias("b"))
    size = pages(spark, sf_dir).agg(F.count(F.lit(1)).alias("urls"), F.sum(F.octet_length("url")).cast("bigint").alias("bytes"))
    return size.join(bits).select("urls", "bytes", F.round("b", 4).alias("bits"), F.round(F.col("b") / F.col("bytes"), 6).alias("bits_per_char"))


@query("cumulative_cost", f"WITH {_GRID} SELECT page_id, CAST(pos AS BIGINT) AS pos, round(sum(bits) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 6) AS cum_bits FROM p JOIN bits USING (piece)")
def cumulative_cost(spark, sf_dir):
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return piece_bits(spark, sf_dir).select("page_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.sum("bits").over(w), 6).alias("cum_bits"))


@query("relative_bars", f"WITH {_GRID} SELECT page_id, CAST(pos AS BIGINT) AS pos, round(bits / greatest(max(bits) OVER (PARTITION BY page_id), 1), 6) AS bar, round(bits / sum(bits) OVER (PARTITION BY page_id), 6) AS share FROM p JOIN bits USING (piece)")
def relative_bars(spark, sf_dir):
    w = Window.partitionBy("page_id")
    return piece_bits(spark, sf_dir).select("page_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("bits") / F.greatest(F.max("bits").over(w), F.lit(1.0)), 6).alias("bar"), F.round(F.col("bits") / F.sum("bits").over(w), 6).alias("share"))


@query("distinct_piece_ids", f"WITH {_PIECES}, v AS (SELECT piece, row_number() OVER (ORDER BY piece) - 1 AS id FROM (SELECT DISTINCT piece FROM p)) SELECT page_id, piece, min(id)::BIGINT AS id FROM p JOIN v USING (piece) GROUP BY page_id, piece")
def distinct_piece_ids(spark, sf_dir):
    p = pieces(spark, sf_dir)
    ids = quant.running(p.select("piece").distinct(), [], [(quant.prefix("piece"), True)], [F.asc("piece")], F.lit(1).cast("bigint"), "id")
    return p.select("page_id", "piece").distinct().join(ids.withColumn("id", F.col("id") - 1), "piece")


_BIGRAM = _PIECES + """,
s AS (SELECT page_id, pos, piece FROM p UNION ALL SELECT page_id, len(pieces), '<eos>' FROM lists),
bg AS (SELECT coalesce(lag(piece) OVER (PARTITION BY page_id ORDER BY pos), '<eos>') AS ctx, piece FROM s),
bn AS (SELECT ctx, piece, count(*) AS n FROM bg GROUP BY ctx, piece),
bf AS (SELECT ctx, piece, n, CAST(floor(n / sum(n) OVER (PARTITION BY ctx) * (16777216 - count(*) OVER (PARTITION BY ctx))) AS BIGINT) + 1 AS f, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, piece) AS r FROM bn),
bq AS (SELECT ctx, piece, n, CAST(f + CASE WHEN r = 1 THEN 16777216 - sum(f) OVER (PARTITION BY ctx) ELSE 0 END AS BIGINT) AS freq FROM bf),
bc AS (SELECT *, CAST(sum(freq) OVER (PARTITION BY ctx ORDER BY piece ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_hi FROM bq)"""


def bigrams(spark, sf_dir):
    """(ctx, piece, n, freq, cum_lo, cum_hi): next-piece distributions, with an end at both sides of a URL."""
    lists = pages(spark, sf_dir).select(U.url_pieces(U.canonical_url("url")).alias("p"))
    steps = lists.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit("<eos>")), "p").alias("ctx"), F.concat("p", F.array(F.lit("<eos>"))).alias("piece"))).alias("s")).select("s.*")
    return quant.quantize(steps.groupBy("ctx", "piece").agg(F.count(F.lit(1)).alias("n")), ["ctx"], "piece", "n")


@query("next_token_dist_topk", f"WITH {_BIGRAM} SELECT ctx, piece, rank::INT AS rank, prob, bits FROM (SELECT ctx, piece, row_number() OVER (PARTITION BY ctx ORDER BY freq DESC, piece) AS rank, round(freq / 16777216, 6) AS prob, round(24 - log2(freq), 2) AS bits FROM bc) WHERE rank <= 5")
def next_token_dist_topk(spark, sf_dir):
    """A rank under a bound: Spark keeps five rows of a context in each task before the shuffle, so a hot context stays small."""
    rank = F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("freq"), "piece"))
    return bigrams(spark, sf_dir).withColumn("rank", rank).where("rank <= 5").select("ctx", "piece", "rank", F.round(F.col("freq") / quant.TOTAL, 6).alias("prob"), F.round(24 - F.log2("freq"), 2).alias("bits"))


@query("filtered_rank", f"WITH {_BIGRAM} SELECT ctx, piece, rank::INT AS rank, row_number() OVER (PARTITION BY ctx ORDER BY rank)::INT AS place FROM (SELECT ctx, piece, row_number() OVER (PARTITION BY ctx ORDER BY freq DESC, piece) AS rank FROM bc) WHERE contains(lower(piece), 'e')")
def filtered_rank(spark, sf_dir):
    """The rank is that of the whole distribution; the filter comes after."""
    one, order = F.lit(1).cast("bigint"), [(F.col("freq"), False), (quant.prefix("piece"), True)]
    ranked = quant.running(bigrams(spark, sf_dir).select("ctx", "piece", "freq"), ["ctx"], order, [F.asc("piece")], one, "rank")
    kept = quant.running(ranked.where(F.lower("piece").contains("e")), ["ctx"], order, [F.asc("piece")], one, "place")
    return kept.select("ctx", "piece", F.col("rank").cast("int").alias("rank"), F.col("place").cast("int").alias("place"))


@query("dist_entropy", f"WITH {_BIGRAM} SELECT ctx, count(*) AS symbols, round(sum(-(freq / 16777216) * log2(freq / 16777216)), 6) AS entropy FROM bc GROUP BY ctx")
def dist_entropy(spark, sf_dir):
    p = F.col("freq") / quant.TOTAL
    return bigrams(spark, sf_dir).groupBy("ctx").agg(F.count(F.lit(1)).alias("symbols"), F.round(F.sum(-p * F.log2(p)), 6).alias("entropy"))


@query("cross_entropy", f"WITH {_BIGRAM}, q AS (SELECT page_id, coalesce(lag(piece) OVER (PARTITION BY page_id ORDER BY pos), '<eos>') AS ctx, piece FROM s), m AS (SELECT ctx, piece, n / sum(n) OVER (PARTITION BY ctx) AS pr FROM bn) SELECT page_id, count(*) AS n_tokens, round(sum(-log2(pr)), 6) AS bits FROM q JOIN m USING (ctx, piece) GROUP BY page_id")
def cross_entropy(spark, sf_dir):
    """Ideal cost of each URL, without the coder's grid, the end included."""
    lists = pages(spark, sf_dir).select("page_id", U.url_pieces(U.canonical_url("url")).alias("p"))
    steps = lists.select("page_id", F.explode(F.arrays_zip(F.concat(F.array(F.lit("<eos>")), "p").alias("ctx"), F.concat("p", F.array(F.lit("<eos>"))).alias("piece"))).alias("s")).select("page_id", "s.*")
    counts = steps.groupBy("ctx", "piece").agg(F.count(F.lit(1)).alias("n"))
    model = counts.join(counts.groupBy("ctx").agg(F.sum("n").alias("s")), "ctx").select("ctx", "piece", (F.col("n") / F.col("s")).alias("pr"))
    return steps.join(model, ["ctx", "piece"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.sum(-F.log2("pr")), 6).alias("bits"))


@query("greedy_next", f"WITH {_BIGRAM} SELECT ctx, arg_min(piece, r) AS piece FROM bf GROUP BY ctx")
def greedy_next(spark, sf_dir):
    return bigrams(spark, sf_dir).groupBy("ctx").agg(F.min(F.struct((-F.col("freq")).alias("f"), "piece"))["piece"].alias("piece"))


@query("inverse_cdf_pick", f"WITH {_BIGRAM}, u AS (SELECT ctx, CAST(('0x' || left(md5(ctx), 6)) AS BIGINT) AS t FROM (SELECT DISTINCT ctx FROM bc)) SELECT u.ctx, t, piece FROM u JOIN bc ON u.ctx = bc.ctx AND t >= cum_hi - freq AND t < cum_hi")
def inverse_cdf_pick(spark, sf_dir):
    """A symbol by a point of the grid: a range condition inside an equi-join on the context."""
    grid = bigrams(spark, sf_dir).select("ctx", "piece", "cum_lo", "cum_hi")
    t = F.conv(F.left(F.md5(F.col("ctx").cast("binary")), F.lit(6)), 16, 10).cast("bigint")
    points = grid.select("ctx").distinct().withColumn("t", t)
    return points.join(grid, "ctx").where("t >= cum_lo AND t < cum_hi").select("ctx", "t", "piece")


@query("interval_lookup", f"WITH {_GRID}, u AS (SELECT page_id, CAST(('0x' || left(md5(url), 6)) AS BIGINT) AS t FROM pages) SELECT page_id, t, piece FROM u JOIN bits ON t >= cum_lo AND t < cum_hi")
def interval_lookup(spark, sf_dir):
    """Point in interval over the whole grid: bins of 2**16 slots turn the range join into an equi-join."""
    grid = piece_grid(spark, sf_dir).select("piece", "cum_lo", "cum_hi", F.explode(F.sequence(F.shiftright("cum_lo", 16), F.shiftright(F.col("cum_hi") - 1, 16))).alias("bin"))
    t = F.conv(F.left(F.md5(F.col("url").cast("binary")), F.lit(6)), 16, 10).cast("bigint")
    points = pages(spark, sf_dir).select("page_id", t.alias("t")).withColumn("bin", F.shiftright("t", 16))
    return points.join(grid, "bin").where("t >= cum_lo AND t < cum_hi").select("page_id", "t", "piece")


_BITS = "bs AS (SELECT page_id, CAST(page_id % 321 AS INT) AS v, right('0000000' || bin(page_id * 7919 + 5), 8) || bin(page_id + 3) AS bits FROM pages), h AS (SELECT *, CASE WHEN v <= 2 THEN right('00' || bin(v), 2) WHEN v <= 65 THEN '11' || right('000000' || bin(v - 3), 6) ELSE '11111111' || right('00000000' || bin(v - 66), 8) END AS header FROM bs)"


def bit_strings(spark, sf_dir):
    bits = F.concat(F.right(F.concat(F.lit("0000000"), F.bin(F.col("page_id") * 7919 + 5)), F.lit(8)), F.bin(F.col("page_id") + 3))
    return pages(spark, sf_dir).select("page_id", (F.col("page_id") % 321).cast("int").alias("v"), bits.alias("bits"))


@query("version_header", f"WITH {_BITS} SELECT page_id, v, header FROM h")
def version_header(spark, sf_dir):
    return bit_strings(spark, sf_dir).select("page_id", "v", coding.version_header_column(F.col("v")).alias("header"))


_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


@query(
    "frame_base64url",
    f"""WITH {_BITS}, w AS (SELECT page_id, '1' || header || bits AS w FROM h), k AS (SELECT page_id, right(repeat('0', 6) || w, CAST(ceil(length(w) / 6) * 6 AS INT)) AS w FROM w)
SELECT page_id, array_to_string(list_transform(range(0, length(w) // 6), lambda i: substr('{_B64}', 1 + 32 * CAST(substr(w, 6 * i + 1, 1) AS INT) + 16 * CAST(substr(w, 6 * i + 2, 1) AS INT) + 8 * CAST(substr(w, 6 * i + 3, 1) AS INT)
 + 4 * CAST(substr(w, 6 * i + 4, 1) AS INT) + 2 * CAST(substr(w, 6 * i + 5, 1) AS INT) + CAST(substr(w, 6 * i + 6, 1) AS INT), 1)), '') AS code FROM k""",
)
def frame_base64url(spark, sf_dir):
    return bit_strings(spark, sf_dir).select("page_id", coding.frame_power_of_two(F.col("bits"), F.col("v"), U.BASE64URL).alias("code"))


@query("frame_emoji_len", f"WITH {_BITS} SELECT page_id, CAST(ceil((1 + length(header) + length(bits)) / 10) AS BIGINT) AS glyphs FROM h")
def frame_emoji_len(spark, sf_dir):
    whole = 1 + F.length(coding.version_header_column(F.col("v"))) + F.length("bits")
    return bit_strings(spark, sf_dir).select("page_id", F.ceil(whole / 10).alias("glyphs"))


@query("frame_roundtrip", f"WITH {_BITS} SELECT page_id, CAST(a AS INT) AS alphabet, bits, v AS version FROM bs, (VALUES (0), (1), (3)) t(a)")
def frame_roundtrip(spark, sf_dir):
    """Any-base framing and back, over three alphabets."""
    rows = bit_strings(spark, sf_dir).withColumn("alphabet", F.explode(F.array(*map(F.lit, (0, 1, 3)))))
    coded = rows.withColumn("code", coding.frame(F.col("bits"), F.col("v"), F.col("alphabet")))
    back = coded.withColumn("b", coding.unframe(F.col("code"), F.col("alphabet")))
    return back.select("page_id", "alphabet", "b.bits", "b.version")


@query("coder_bit_length_bound", f"WITH {_GRID} SELECT page_id, round(sum(bits), 6) AS ideal, true AS within FROM p JOIN bits USING (piece) GROUP BY page_id")
def coder_bit_length_bound(spark, sf_dir):
    """Coded with the piece grid, a URL takes at least its information and less than two bits more."""
    grid = piece_grid(spark, sf_dir).select("piece", F.col("cum_lo").alias("lo"), F.col("cum_hi").alias("hi"), "bits")
    rows = pieces(spark, sf_dir).join(grid, "piece").groupBy("page_id").agg(F.sum("bits").alias("ideal"), F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("s"))
    coded = rows.withColumn("coded", F.length(coding.code_slices(F.transform("s", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))))))
    return coded.select("page_id", F.round("ideal", 6).alias("ideal"), ((F.col("coded") > F.col("ideal") - 1) & (F.col("coded") < F.col("ideal") + 2.1)).alias("within"))


@query("cells_of_bits", f"WITH {_BITS}, w AS (SELECT page_id, '1' || header || bits AS w FROM h), k AS (SELECT page_id, right(repeat('0', 6) || w, CAST(ceil(length(w) / 6) * 6 AS INT)) AS w FROM w) SELECT page_id, i AS cell, substr(w, CAST(6 * i + 1 AS INT), 6) AS six FROM (SELECT page_id, w, unnest(range(0, length(w) // 6)) AS i FROM k)")
def cells_of_bits(spark, sf_dir):
    whole = F.concat(F.lit("1"), coding.version_header_column(F.col("v")), F.col("bits"))
    n = F.ceil(F.length(whole) / 6).cast("int")
    rows = bit_strings(spark, sf_dir).select("page_id", F.lpad(whole, n * 6, "0").alias("w"))
    return rows.select("page_id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("w") / 6).cast("int") - 1), lambda i: F.substring("w", i * 6 + 1, F.lit(6)))).alias("c", "six")).select("page_id", F.col("c").cast("bigint").alias("cell"), "six")


@query("nested_intervals", f"WITH {_GRID}, w AS (SELECT page_id, pos, freq / 16777216 AS w FROM p JOIN bits USING (piece)) SELECT page_id, CAST(pos AS BIGINT) AS pos, round(sum(log2(w)) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 6) AS log_width FROM w")
def nested_intervals(spark, sf_dir):
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return piece_bits(spark, sf_dir).select("page_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.sum(-F.col("bits")).over(w), 6).alias("log_width"))


@query("coder_floor", f"WITH {_PIECES}, t AS (SELECT count(DISTINCT piece) AS v, count(*) / count(DISTINCT page_id) AS per_url FROM p) SELECT v, round(-log2(1 - v / 16777216) * per_url, 9) AS bits24, round(-log2(1 - v / 65536) * per_url, 9) AS bits16 FROM t")
def coder_floor(spark, sf_dir):
    """What one guaranteed slot for each symbol costs a URL, on grids of 24 and 16 bits."""
    t = pieces(spark, sf_dir).agg(F.countDistinct("piece").alias("v"), (F.count(F.lit(1)) / F.countDistinct("page_id")).alias("per_url"))
    cost = lambda size: F.round(-F.log2(1 - F.col("v") / size) * F.col("per_url"), 9)
    return t.select("v", cost(1 << 24).alias("bits24"), cost(1 << 16).alias("bits16"))
