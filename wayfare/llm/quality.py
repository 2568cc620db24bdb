"""Quality rules with host-level verdicts, by DataFrame functions alone.

`measure` counts, by document, what the rules look at. `host_rates` adds up by host (the source) how many documents fail
each rule and shrinks each rate towards the mean of all hosts with an empirical beta prior: by the method of moments over
hosts, mean m and variance v give the prior weight w = m(1 - m)/v - 1, and the shrunk rate is (failures + w m)/(n + w). A
host fails if the shrunk rate of a rule exceeds that rule's limit; `judge` joins the verdicts back to the documents. A
column of hosts or of URLs will do (`host_of`).

Words are [^\\x20\\x09-\\x0D]+. Defined results: null and empty texts have no words and fail; null hosts are one host;
repeated rows count each; with one host only, or hosts of equal rates, the prior has the weight MAX_WEIGHT; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A host fails if the shrunk rate of failures of a rule is above this.
LIMITS = {"base": 0.5, "symbols": 0.6, "lines": 0.6, "length": 0.6}
MAX_WEIGHT = 1000.0
#: Hosts up to this many (some 60 bytes each) are broadcast; more are joined with the hosts' rows salted.
BROADCAST_HOSTS, SALTS = 100_000, 16
_SPACE = " \\t\\n\\x0B\\f\\r"


def host_of(address: Column) -> Column:
    """The host of a URL, in lower case; what is no URL is a host of its own."""
    host = F.lower(F.regexp_extract(address, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host).otherwise(address)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of each row's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(*keep, text.alias("_t"), F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "").alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_SPACE}]")).alias("_l"))
    b = a.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 5, F.expr("transform(slice(_w, 1, size(_w) - 4), (w, i) -> xxhash64(w, _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4]))")).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    plain = [c for c in b.columns if c != "_h"]
    c = b.select(*plain, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    d = c.select(*plain, F.expr("array_sort(transform(filter(_s, (x, k) -> (k > 0 AND _s[k - 1].h = x.h) OR (k + 1 < size(_s) AND _s[k + 1].h = x.h)), x -> x.i))").alias("_p"))
    repeats = F.expr("CASE WHEN _p IS NULL THEN 0L ELSE aggregate(_p, named_struct('n', 0L, 'to', 0L), (a, p) -> named_struct('n', a.n + p + 5L - greatest(a.to, CAST(p AS BIGINT)), 'to', p + 5L), a -> a.n) END")
    return d.select(*plain, repeats.alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    """The rules, by name, over the columns of `measure`."""
    n = F.col("n_words")
    return {
        "base": (n < 10) | (100 * F.col("n_repeat_words") > 20 * n),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n),
    }


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """(host, n, rate_<rule>..., host_failed): shrunk failure rates; map-side sums come before the shuffle, so a hot host is no hot key."""
    rules = failures()
    by = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f.cast("long")).alias(f"f_{r}") for r, f in rules.items()))
    by = cut(by, "hosts")
    raw = {r: F.col(f"f_{r}") / F.col("n") for r in rules}
    prior = by.agg(*(F.avg(x).alias(f"m_{r}") for r, x in raw.items()), *(F.var_samp(x).alias(f"v_{r}") for r, x in raw.items())).first()
    shrunk = {}
    for r in rules:
        m, v = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        w = min(MAX_WEIGHT, max(m * (1 - m) / v - 1, 0.0)) if v > 0 else MAX_WEIGHT
        shrunk[r] = (F.col(f"f_{r}") + F.lit(w * m)) / (F.col("n") + F.lit(w))
    failed = F.lit(False)
    for r, x in shrunk.items():
        failed = failed | (x > LIMITS[r])
    return by.select("host", "n", *(x.alias(f"rate_{r}") for r, x in shrunk.items()), failed.alias("host_failed"))


def judge(docs: DataFrame, host: str = "source", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """doc_id, host, the counts, base_failed, host_failed and kept."""
    measured = cut(measure(docs.select("doc_id", host_of(F.col(host)).alias("_host"), "text"), ["doc_id", "_host"]), "measured")
    verdicts = host_rates(measured, "_host").select("host", "host_failed")
    if verdicts.count() <= broadcast_hosts:
        joined = measured.join(F.broadcast(verdicts), F.col("_host").eqNullSafe(F.col("host")), "left")
    else:
        salted = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, F.col("_host").eqNullSafe(F.col("host")) & (left["_salt"] == salted["_salt"]), "left").drop("_salt")
    base = failures()["base"]
    return joined.select("doc_id", F.col("_host").alias("host"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "host_failed", (~base & ~F.col("host_failed")).alias("kept"))


def op2_host_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge(docs).drop("host", "host_failed")


OP2_SQL = """
WITH w AS (SELECT doc_id, coalesce(nullif(lower(regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), ''), source) AS source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rr AS (SELECT doc_id, sum(least(5, coalesce(lead_i - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rr.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rr USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS f1, 10 * n_symbols > word_chars AS f2, 10 * n_dup_lines > 3 * n_lines AS f3,
  word_chars < 2 * n_words OR word_chars > 12 * n_words AS f4 FROM m),
h AS (SELECT source, count(*) AS n, sum(f1::INT) AS s1, sum(f2::INT) AS s2, sum(f3::INT) AS s3, sum(f4::INT) AS s4 FROM f GROUP BY source),
p AS (SELECT avg(s1/n) AS m1, coalesce(var_samp(s1/n), 0) AS v1, avg(s2/n) AS m2, coalesce(var_samp(s2/n), 0) AS v2, avg(s3/n) AS m3, coalesce(var_samp(s3/n), 0) AS v3, avg(s4/n) AS m4, coalesce(var_samp(s4/n), 0) AS v4 FROM h),
k AS (SELECT *, CASE WHEN v1 > 0 THEN least(1000, greatest(m1*(1-m1)/v1 - 1, 0)) ELSE 1000 END AS w1, CASE WHEN v2 > 0 THEN least(1000, greatest(m2*(1-m2)/v2 - 1, 0)) ELSE 1000 END AS w2,
  CASE WHEN v3 > 0 THEN least(1000, greatest(m3*(1-m3)/v3 - 1, 0)) ELSE 1000 END AS w3, CASE WHEN v4 > 0 THEN least(1000, greatest(m4*(1-m4)/v4 - 1, 0)) ELSE 1000 END AS w4 FROM p),
b AS (SELECT source, (s1 + w1*m1)/(n + w1) > 0.5 OR (s2 + w2*m2)/(n + w2) > 0.6 OR (s3 + w3*m3)/(n + w3) > 0.6 OR (s4 + w4*m4)/(n + w4) > 0.6 AS host_failed FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 AS base_failed, NOT f1 AND NOT host_failed AS kept
FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
"""
