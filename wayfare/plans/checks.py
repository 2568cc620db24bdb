"""Plans that compare, scan and lay out: parity, goldens, set operations, rules, headers, chunks and digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import texts as T
from ..functions import urls as U
from .registry import query, table


@query(
    "parity_compare",
    "WITH a AS (SELECT doc_id, md5(coalesce(text, '')) AS h, lang FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, md5(coalesce(text, '')) AS h, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang FROM documents WHERE doc_id % 11 <> 5) SELECT CASE WHEN a.doc_id IS NULL THEN 'only_b' WHEN b.doc_id IS NULL THEN 'only_a' WHEN a.h IS NOT DISTINCT FROM b.h AND a.lang IS NOT DISTINCT FROM b.lang THEN 'same' ELSE 'differs' END AS verdict, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1",
)
def parity_compare(spark, sf_dir):
    """Two runs side by side: a full join with null-safe equality, counted by verdict. Digests travel, not texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), "lang")
    a = d.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("ia"), F.col("h").alias("ha"), F.col("lang").alias("la"))
    b = d.where("doc_id % 11 <> 5").select(F.col("doc_id").alias("ib"), F.col("h").alias("hb"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lb"))
    same = F.col("ha").eqNullSafe(F.col("hb")) & F.col("la").eqNullSafe(F.col("lb"))
    verdict = F.when(F.col("ia").isNull(), "only_b").when(F.col("ib").isNull(), "only_a").when(same, "same").otherwise("differs")
    return a.join(b, F.col("ia") == F.col("ib"), "full").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_SHIFT = "WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r, CAST(x AS DOUBLE) AS x FROM e), b AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY round(x, 1) DESC, i) AS r, round(CAST(x AS DOUBLE), 1) AS x FROM e)"


@query("rank_difference", f"{_SHIFT} SELECT a.vec_id, round(max(abs(a.x - b.x)), 6) AS worst, count(*) FILTER (WHERE a.i <> b.i) AS moved FROM a JOIN b ON a.vec_id = b.vec_id AND a.r = b.r GROUP BY a.vec_id")
def rank_difference(spark, sf_dir):
    """Two rankings of the same vector, rank by rank: the largest difference and how many places moved."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    ranked = lambda x, k: F.array_sort(F.transform(x, lambda y, i: F.struct((-k(y)).alias("o"), i.alias("i"), k(y).alias("x"))))
    a, b = ranked("v", lambda y: y.cast("double")), ranked("v", lambda y: F.round(y, 1).cast("double"))
    pairs = F.zip_with(a, b, lambda p, q: F.struct(F.abs(p["x"] - F.round(q["x"], 1)).alias("d"), (p["i"] != q["i"]).cast("int").alias("m")))
    rows = e.select("vec_id", pairs.alias("p"))
    return rows.select("vec_id", F.round(F.array_max("p.d"), 6).alias("worst"), F.aggregate("p.m", F.lit(0).cast("bigint"), lambda s, m: s + m).alias("moved"))


@query("set_difference", "SELECT DISTINCT lang, source FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT lang, source FROM documents WHERE doc_id % 6 = 1")
def set_difference(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where("doc_id % 2 = 0").select("lang", "source").subtract(d.where("doc_id % 6 = 1").select("lang", "source"))


@query("set_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'page' AS kind, page_id AS id FROM pages UNION ALL SELECT 'doc', doc_id FROM documents UNION ALL SELECT 'item', item_id FROM benchmark) GROUP BY kind")
def set_union_all(spark, sf_dir):
    part = lambda kind, t, key: table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return part("page", "pages", "page_id").unionByName(part("doc", "documents", "doc_id")).unionByName(part("item", "benchmark", "item_id")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# What the canonical form has to give.
PAIRS = [
    ("https://www.example.com/a", "https://com.example.www/a"),
    ("http://a.b.c", "http://c.b.a"),
    ("https://user:pw@www.x.org:8080/p?q#f", "https://user:pw@org.x.www:8080/p?q#f"),
    ("https://a@b@c.d/", "https://a@b@d.c/"),
    ("https://1.2.3.4/x", "https://1.2.3.4/x"),
    ("https://256.2.3.4/x", "https://4.3.2.256/x"),
    ("https://[::1]:80/", "https://[::1]:80/"),
    ("https://host:/x", "https://host:/x"),
    ("HTTPS://www.example.com", "HTTPS://www.example.com"),
    ("ftp://a.b", "ftp://a.b"),
    ("https://", "https://"),
    ("https://a..b/", "https://b..a/"),
    ("https://x.y?z", "https://y.x?z"),
    ("https://x.y#z", "https://y.x#z"),
    ("plain text", "plain text"),
    ("https://münchen.de/ü", "https://de.münchen/ü"),
]
_PAIRS = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in pair) + ")" for pair in PAIRS)


@query("golden_replay", f"SELECT given, wanted AS got, given AS back FROM (VALUES {_PAIRS}) t(given, wanted)")
def golden_replay(spark, sf_dir):
    """Fixed input and output pairs of the canonical form, computed both ways."""
    cases = spark.createDataFrame(PAIRS, "given string, wanted string")
    return cases.select("given", U.canonical_url("given").alias("got"), U.canonical_url("wanted").alias("back"))


#: Rules of the header plans: order, path pattern, names set and values, names cleared.
HEADER_RULES = [
    (0, "/*", "Cache-Control", "no-cache", None),
    (1, "/*", "X-Frame", "deny", None),
    (2, "/:section/*", "X-Section", "yes", None),
    (3, "/*.html", None, None, "Cache-Control"),
    (4, "/*.html", "Cache-Control", "max-age=60", None),
    (5, "/a*", "X-Frame", "sameorigin", None),
]
_RULES = "rules(ord, pattern, re, name, value, unset) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in (o, p, "^" + p.replace(".", "[.]").replace("*", ".*").replace(":section", "[^/]+") + "$", n, v, u)) + ")" for o, p, n, v, u in HEADER_RULES) + ")"
_PATHS = "paths AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) || CASE WHEN page_id % 3 = 0 THEN '.html' ELSE '' END AS path FROM pages)"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1), F.when(F.col("page_id") % 3 == 0, ".html").otherwise("")).alias("path"))


def _header_rules(spark):
    """A fixed handful of rules."""
    return spark.createDataFrame(HEADER_RULES, "ord int, pattern string, name string, value string, unset string").withColumn("re", U.path_pattern("pattern"))


@query("path_rules_theta", f"WITH {_RULES}, {_PATHS} SELECT page_id, ord FROM paths JOIN rules ON regexp_matches(path, re)")
def path_rules_theta(spark, sf_dir):
    """Every rule whose pattern fits a path: a theta join against a fixed number of rules."""
    return _paths(spark, sf_dir).join(F.broadcast(_header_rules(spark)), F.expr("path RLIKE re")).select("page_id", "ord")


@query("first_match_default", f"WITH {_RULES}, {_PATHS} SELECT page_id, coalesce(arg_min(pattern, ord), 'default') AS rule FROM paths LEFT JOIN rules ON regexp_matches(path, re) AND ord >= 2 GROUP BY page_id")
def first_match_default(spark, sf_dir):
    rules = _header_rules(spark).where("ord >= 2")
    hits = _paths(spark, sf_dir).join(F.broadcast(rules), F.expr("path RLIKE re"), "left")
    return hits.groupBy("page_id").agg(F.coalesce(F.min_by("pattern", "ord"), F.lit("default")).alias("rule"))


@query(
    "header_merge",
    f"""WITH {_RULES}, {_PATHS}, h AS (SELECT page_id, ord, name, value, unset FROM paths JOIN rules ON regexp_matches(path, re)),
s AS (SELECT a.page_id, lower(a.name) AS name, a.ord, a.value FROM h a WHERE a.name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h b WHERE b.page_id = a.page_id AND lower(b.unset) = lower(a.name) AND b.ord > a.ord))
SELECT page_id, name, string_agg(value, ', ' ORDER BY ord) AS value FROM s GROUP BY page_id, name""",
)
def header_merge(spark, sf_dir):
    """The headers of each path: rules apply in order, a later clearing takes back, and what is set twice is joined."""
    hits = _paths(spark, sf_dir).join(F.broadcast(_header_rules(spark)), F.expr("path RLIKE re"))
    rows = hits.select("page_id", F.lower(F.coalesce("name", "unset")).alias("name"), "ord", "value", F.col("unset").isNotNull().alias("clears"))
    cleared = F.max(F.when(F.col("clears"), F.col("ord"))).over(Window.partitionBy("page_id", "name"))
    kept = rows.withColumn("after", F.coalesce(cleared, F.lit(-1))).where("NOT clears AND ord > after")
    values = F.sort_array(F.collect_list(F.struct("ord", "value")))
    return kept.groupBy("page_id", "name").agg(F.array_join(F.transform(values, lambda x: x["value"]), ", ").alias("value"))


CHUNK = 1000
_CHUNKS = f"sizes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, greatest(n, 1), {CHUNK})) AS start FROM sizes)"


def _chunks(spark, sf_dir):
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n") - 1, F.lit(0).cast("bigint")), F.lit(CHUNK).cast("bigint"))).alias("start"))


@query("chunk_plan", f"WITH {_CHUNKS} SELECT doc_id, start // {CHUNK} AS idx, start, least({CHUNK}, n - start)::BIGINT AS bytes, round(least({CHUNK}, n - start) / n, 9) AS weight FROM c WHERE n > 0")
def chunk_plan(spark, sf_dir):
    size = F.least(F.lit(CHUNK).cast("bigint"), F.col("n") - F.col("start"))
    return _chunks(spark, sf_dir).where("n > 0").select("doc_id", F.floor(F.col("start") / CHUNK).alias("idx"), "start", size.alias("bytes"), F.round(size / F.col("n"), 9).alias("weight"))


@query("chunk_overlap", f"WITH {_CHUNKS}, r AS (SELECT doc_id, n // 3 AS a, n // 3 + 1500 AS b FROM sizes) SELECT c.doc_id, start, greatest(a, start) - start AS cut_from, least(b, start + {CHUNK}, n) - greatest(a, start) AS bytes FROM c JOIN r USING (doc_id) WHERE least(start + {CHUNK}, n) > a AND start < b")
def chunk_overlap(spark, sf_dir):
    """The chunks that a requested range touches, and the part of each: the interval test is local to a document, so nothing is joined."""
    a = F.floor(F.col("n") / 3)
    stop = F.least(F.col("start") + CHUNK, F.col("n"))
    rows = _chunks(spark, sf_dir).withColumn("a", a).withColumn("b", a + 1500).withColumn("stop", stop).where("stop > a AND start < b")
    first = F.greatest("a", "start")
    return rows.select("doc_id", "start", (first - F.col("start")).alias("cut_from"), (F.least("b", "stop") - first).alias("bytes"))


@query("content_digest", "SELECT doc_id, sha256(coalesce(text, '')) AS sha, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes FROM documents")
def content_digest(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("bigint").alias("bytes"))


@query("build_id", "SELECT source, left(sha256(string_agg(name, chr(10) ORDER BY name)), 8) AS build FROM (SELECT DISTINCT source, lang || '-' || left(md5(coalesce(text, '')), 4) AS name FROM documents) GROUP BY source")
def build_id(spark, sf_dir):
    """A name for a set of files: the digest of their sorted names, by source."""
    names = table(spark, sf_dir, "documents").select("source", F.concat("lang", F.lit("-"), F.left(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.lit(4))).alias("name")).distinct()
    return names.groupBy("source").agg(F.left(F.sha2(F.array_join(F.sort_array(F.collect_list("name")), "\n"), 256), F.lit(8)).alias("build"))


@query("artifact_mismatch", "SELECT doc_id, n_chars IS DISTINCT FROM length(text) AS differs FROM documents")
def artifact_mismatch(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (~F.col("n_chars").eqNullSafe(F.length("text").cast("bigint"))).alias("differs"))


#: Rules of the denylist: name, pattern.
DENY = [("email", "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[.][a-z]{2,}"), ("hex_key", "[0-9a-f]{32,}"), ("assigned", "(token|secret|key) = \"[^\"]*\""), ("phone", "[0-9]{3}-[0-9]{3,4}-[0-9]{4}")]
#: Matches of this pattern are let through; documents of these sources are not scanned.
ALLOW, SKIP = "example[.](com|org)$", ("src7",)
_DENY = "deny(rule, re) AS (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in DENY) + "), found AS (SELECT doc_id, rule, unnest(regexp_extract_all(text, re)) AS hit FROM documents, deny WHERE source NOT IN ('src7') AND text IS NOT NULL), kept AS (SELECT * FROM found WHERE NOT regexp_matches(hit, 'example[.](com|org)$'))"


def _found(spark, sf_dir):
    """(doc_id, rule, hit): all rules in one pass over the texts; the rules are a literal array, not a join."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.col("source").isin(*SKIP))

    def of(rule, pattern):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda h: F.struct(F.lit(rule).alias("rule"), h.alias("hit")))

    hits = F.flatten(F.array(*(of(*x) for x in DENY)))
    return docs.select("doc_id", F.explode(hits).alias("x")).select("doc_id", "x.*").where(~F.col("hit").rlike(ALLOW))


@query("denylist_scan", f"WITH {_DENY} SELECT doc_id, rule, md5(hit) AS hit FROM kept")
def denylist_scan(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", "rule", F.md5(F.col("hit").cast("binary")).alias("hit"))


@query("denylist_rollup", f"WITH {_DENY} SELECT coalesce(rule, 'TOTAL') AS rule, count(*) AS n, count(DISTINCT doc_id) AS docs FROM kept GROUP BY ROLLUP (rule) HAVING count(*) > 0")
def denylist_rollup(spark, sf_dir):
    """Hits are counted by document and rule before anything moves; the total is a sum of the rules' rows and a count of documents."""
    found = _found(spark, sf_dir).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))
    rules = found.groupBy("rule").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    whole = found.groupBy("doc_id").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).where("docs > 0")
    return rules.unionByName(whole.select(F.lit("TOTAL").alias("rule"), "n", "docs"))


@query("shard_completeness", "SELECT shard, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM (SELECT doc_id % 4 AS shard FROM documents) GROUP BY shard")
def shard_completeness(spark, sf_dir):
    shards = table(spark, sf_dir, "documents").groupBy(F.pmod("doc_id", F.lit(4)).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    # four shard rows
    return shards.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))


@query("segment_share", "SELECT role, sum(length(coalesce(text, '')))::BIGINT AS chars, round(sum(length(coalesce(text, ''))) / (SELECT sum(length(coalesce(text, ''))) FROM conversations), 6) AS share FROM conversations GROUP BY role")
def segment_share(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    return n.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(Window.partitionBy(F.lit(1))), 6))


_REPORT = "SELECT o_orderkey, 'fp32: ' || (o_orderkey % 5) || '.' || (1000 + o_orderkey % 9000) || ' bits/char over ' || (o_orderkey * 7) || ' URLs (' || (o_orderkey % 13) || ' skipped)' || chr(10) || 'kernel_sim(int4): ' || (o_orderkey % 3) || '.5 bits/char' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'kernel: 1.25 bits/char (checked) over ' || (o_orderkey % 500) || ' URLs' ELSE '' END AS report FROM orders"


@query(
    "eval_report",
    f"SELECT o_orderkey, CAST(regexp_extract(report, 'fp32: ([0-9.]+)', 1) AS DOUBLE) AS bits, CAST(regexp_extract(report, 'char over ([0-9]+) URLs [(]', 1) AS BIGINT) AS scored, CAST(regexp_extract(report, '[(]([0-9]+) skipped', 1) AS BIGINT) AS skipped, CAST(regexp_extract(report, 'int4[)]: ([0-9.]+)', 1) AS DOUBLE) AS kernel, CAST(nullif(regexp_extract(report, 'kernel: ([0-9.]+)', 1), '') AS DOUBLE) AS real, CAST(nullif(regexp_extract(report, 'checked[)] over ([0-9]+)', 1), '') AS BIGINT) AS real_urls FROM ({_REPORT})",
)
def eval_report(spark, sf_dir):
    """Figures out of report texts; the last line may be absent."""
    return _reports(spark, sf_dir).select("o_orderkey", "r.*")


def _reports(spark, sf_dir):
    k = F.col("o_orderkey")
    real = F.when(k % 2 == 0, F.format_string("\nkernel: 1.25 bits/char (checked) over %d URLs", k % 500)).otherwise("")
    report = F.concat(F.format_string("fp32: %d.%d bits/char over %d URLs (%d skipped)\nkernel_sim(int4): %d.5 bits/char", k % 5, 1000 + k % 9000, k * 7, k % 13, k % 3), real)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.eval_figures(report).alias("r"))


@query("manifest_checks", "SELECT o_orderkey, o_orderkey % 10 <> 3 AS size_agrees, o_orderkey % 4 <> 1 AS digest_fine FROM orders")
def manifest_checks(spark, sf_dir):
    """A manifest against a report and an artifact: the sizes add up, and the digest is one. Some manifests here are made wrong."""
    k = F.col("o_orderkey")
    wrong = F.when(k % 10 == 3, 1).otherwise(0)
    manifest = F.to_json(F.struct(F.struct((k * 7 + k % 13 + wrong).alias("urls"), F.when(k % 4 == 1, F.lit("ABC")).otherwise(F.sha2(k.cast("string"), 256)).alias("sha256")).alias("data")))
    rows = _reports(spark, sf_dir).withColumn("m", manifest)
    return rows.select("o_orderkey", (T.required("m", "data.urls", "number") == F.col("r.scored") + F.col("r.skipped")).alias("size_agrees"), T.required("m", "data.sha256").rlike("^[0-9a-f]{64}$").alias("digest_fine"))


@query("alignment_centres", "WITH s(size, coords) AS (VALUES (25, [6, 18]), (45, [6, 22, 38]), (145, [6, 34, 60, 86, 112, 138])) SELECT size, r, c FROM (SELECT size, unnest(coords) AS r, coords FROM s) JOIN (SELECT size AS s2, unnest(coords) AS c FROM s) ON size = s2 WHERE NOT ((r = 6 AND c = 6) OR (r = 6 AND c = size - 7) OR (r = size - 7 AND c = 6))")
def alignment_centres(spark, sf_dir):
    """Centres of alignment patterns of a symbol of a given size: evenly spaced places, without the three corners."""
    sizes = spark.createDataFrame([(25,), (45,), (145,)], "size int")
    places = G.alignment_coordinates("size")
    rows = sizes.withColumn("p", places)
    pairs = rows.select("size", "p", F.explode("p").alias("r")).select("size", "r", F.explode("p").alias("c"))
    last = F.col("size") - 7
    return pairs.where(~(((F.col("r") == 6) & F.col("c").isin(6)) | ((F.col("r") == 6) & (F.col("c") == last)) | ((F.col("r") == last) & (F.col("c") == 6))))


#: Symbols of 57 rows and columns, from as many embeddings each.
_SIDE = 57

def _function_sql(r: str, c: str) -> str:
    last = _SIDE - 7
    return f"""(({r} < 7 AND {c} < 7) OR ({r} < 7 AND {c} >= {last}) OR ({r} >= {last} AND {c} < 7) OR ({r} = 6 AND {c} BETWEEN 8 AND {last - 2}) OR ({c} = 6 AND {r} BETWEEN 8 AND {last - 2})
 OR ((abs({r} - 6) <= 2 OR abs({r} - 28) <= 2 OR abs({r} - 50) <= 2) AND (abs({c} - 6) <= 2 OR abs({c} - 28) <= 2 OR abs({c} - 50) <= 2)
 AND NOT ((abs({r} - 6) <= 2 AND abs({c} - 6) <= 2) OR (abs({r} - 6) <= 2 AND abs({c} - 50) <= 2) OR (abs({r} - 50) <= 2 AND abs({c} - 6) <= 2))))"""


@query(
    "module_neighbours",
    f"""WITH m AS (SELECT CAST(vec_id // {_SIDE} AS BIGINT) AS symbol, CAST(vec_id % {_SIDE} AS INT) AS r, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS c, unnest(embedding) > 0 AS dark FROM embeddings), d AS (SELECT symbol, r, c FROM m WHERE dark AND c < {_SIDE})
SELECT d.symbol, d.r, d.c, u.r IS NOT NULL AS up, w.r IS NOT NULL AS down, l.r IS NOT NULL AS lft, g.r IS NOT NULL AS rgt FROM d LEFT JOIN d u ON u.symbol = d.symbol AND u.r = d.r - 1 AND u.c = d.c LEFT JOIN d w ON w.symbol = d.symbol AND w.r = d.r + 1 AND w.c = d.c
 LEFT JOIN d l ON l.symbol = d.symbol AND l.r = d.r AND l.c = d.c - 1 LEFT JOIN d g ON g.symbol = d.symbol AND g.r = d.r AND g.c = d.c + 1 WHERE NOT {_function_sql("d.r", "d.c")}""",
)
def module_neighbours(spark, sf_dir):
    """Dark cells outside the function patterns with their four neighbours, from a row's own array and the rows beside it in its symbol."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / _SIDE).alias("symbol"), (F.col("vec_id") % _SIDE).cast("int").alias("r"), F.transform(F.slice("embedding", 1, _SIDE), lambda x: x > 0).alias("m"))
    w = Window.partitionBy("symbol").orderBy("r")
    beside = lambda f, k: F.when(f("r").over(w) == F.col("r") + k, f("m").over(w))
    rows = rows.withColumns({"above": beside(F.lag, -1), "below": beside(F.lead, 1)})
    at = lambda a, k: F.coalesce(F.get(a, k), F.lit(False))
    cells = rows.select("symbol", "r", "m", "above", "below", F.posexplode("m").alias("c", "dark")).where(F.col("dark") & ~G.is_function_pattern(_SIDE, "r", "c"))
    c = F.col("c")
    return cells.select("symbol", "r", "c", at("above", c).alias("up"), at("below", c).alias("down"), at("m", F.when(c > 0, c - 1)).alias("lft"), at("m", c + 1).alias("rgt"))
