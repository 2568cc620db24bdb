"""Plans that print figures of lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as X
from .registry import query, table

_NB = "chr(160)"


def _fixed(x: str, digits: int) -> str:
    """printf, which sends exact halves to the even neighbour; here they go away from zero. Exact halves are odd multiples of 2**-(digits + 1)."""
    scaled = f"abs({x}) * {2 ** (digits + 1)}"
    return f"printf('%.{digits}f', CASE WHEN {scaled} = floor({scaled}) AND floor({scaled}) % 2 = 1 THEN ({x}) + sign({x}) * 1e-{digits + 2} ELSE {x} END)"


_SIZE = _fixed("(CAST(l_extendedprice AS DOUBLE) * 1000 + 7) / 1048576", 1)


@query("fmt_sizes", f"SELECT l_orderkey, l_linenumber, {_SIZE} || {_NB} || 'MiB' AS size, {_SIZE} || {_NB} || 'MiB/s' AS rate FROM lineitem")
def fmt_sizes(spark, sf_dir):
    n = F.col("l_extendedprice").cast("double") * 1000 + 7
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.fmt_bytes(n).alias("size"), X.fmt_rate(n).alias("rate"))


@query("fmt_bits", f"SELECT event_id, CASE WHEN value / 97.3::DOUBLE < 0.05 THEN '<0.1' ELSE {_fixed('value / 97.3::DOUBLE', 1)} END || {_NB} || 'b' AS bits, CASE WHEN value / 9973 < 0.005 THEN '<0.01' ELSE {_fixed('value / 9973', 2)} END AS fine FROM events")
def fmt_bits(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", X.fmt_bits(v / 97.3).alias("bits"), X.fmt_bits(v / 9973, 2, "none").alias("fine"))


_COUNT = " ".join(f"WHEN n >= {least} THEN {_fixed(f'n / {unit}::DOUBLE', digits)} || '{name}'" for least, unit, digits, name in (("1e10", "1e9", 0, "B"), ("1e9", "1e9", 1, "B"), ("1e7", "1e6", 0, "M"), ("1e6", "1e6", 1, "M"), ("1e4", "1e3", 0, "K"), ("1e3", "1e3", 1, "K")))


@query("fmt_counts", f"SELECT o_orderkey, k::INT AS k, CASE {_COUNT} ELSE CAST(n AS BIGINT)::VARCHAR END AS count FROM (SELECT o_orderkey, k, CASE WHEN k = 0 THEN floor(p) ELSE floor(p) * floor(p) END AS n FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 100 AS p FROM orders), (VALUES (0), (1)) t(k))")
def fmt_counts(spark, sf_dir):
    """Two whole counts of each order, so that every unit and exact halves are met."""
    p = F.floor(F.col("o_totalprice").cast("double") / 100).cast("double")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(p, p * p)).alias("k", "n"))
    return rows.select("o_orderkey", "k", X.fmt_count("n").alias("count"))


@query("fmt_exact", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice * 100) AS BIGINT)) AS exact FROM orders")
def fmt_exact(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.fmt_exact(F.floor(F.col("o_totalprice") * 100)).alias("exact"))


@query("fmt_times", f"SELECT event_id, CASE WHEN t < 60 THEN {_fixed('t', 1)} || {_NB} || 's' ELSE CAST(floor(t / 60) AS BIGINT) || ':' || right('0' || CAST(floor(t - floor(t / 60) * 60 + 0.5) AS BIGINT), 2) END AS took, CASE WHEN floor(t + 0.5) < 60 THEN '~' || CAST(floor(t + 0.5) AS BIGINT) || {_NB} || 's left' ELSE '~' || CAST(floor(floor(t + 0.5) / 60) AS BIGINT) || ':' || right('0' || CAST(floor(t + 0.5) - floor(floor(t + 0.5) / 60) * 60 AS BIGINT), 2) || ' left' END AS eta FROM (SELECT event_id, (value * 1000 + 13) / 1000 AS t FROM events)")
def fmt_times(spark, sf_dir):
    ms = F.col("value") * 1000 + 13
    return table(spark, sf_dir, "events").select("event_id", X.fmt_seconds(ms).alias("took"), X.fmt_eta(ms).alias("eta"))


@query("fmt_shares", f"SELECT l_orderkey, l_linenumber, {_fixed('d * 100', 1)} || '%' AS share, {_fixed('(t + 0.0001::DOUBLE) * 100', 3)} || '%' AS pct FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t FROM lineitem)")
def fmt_shares(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.fmt_share(F.col("l_discount").cast("double")).alias("share"), X.fmt_pct(F.col("l_tax").cast("double") + 0.0001).alias("pct"))


@query("fmt_halves", f"SELECT event_id, {_fixed('x', 0)} AS d0, {_fixed('x', 1)} AS d1, {_fixed('x', 2)} AS d2, {_fixed('x', 3)} AS d3 FROM (SELECT event_id, ((event_id % 4001 - 2000) / 16)::DOUBLE AS x FROM events)")
def fmt_halves(spark, sf_dir):
    """Exact halves of every number of decimals, and both signs."""
    x = (F.col("event_id") % 4001 - 2000) / 16
    return table(spark, sf_dir, "events").select("event_id", *(X.fixed(x, d).alias(f"d{d}") for d in range(4)))


@query("fmt_pct_small", f"SELECT event_id, {_fixed('q / power(10, e)', 1)} || '×10' || translate(CAST(e AS VARCHAR), '0123456789-', '⁰¹²³⁴⁵⁶⁷⁸⁹⁻') || '%' AS pct FROM (SELECT event_id, q, CASE WHEN round(q / power(10, CAST(floor(log10(q)) AS INT)), 1) >= 10 THEN CAST(floor(log10(q)) AS INT) + 1 ELSE CAST(floor(log10(q)) AS INT) END AS e FROM (SELECT event_id, power(2, -(25 + value / 10)) * 100 AS q FROM events))")
def fmt_pct_small(spark, sf_dir):
    bits = 25 + F.col("value") / 10
    return table(spark, sf_dir, "events").select("event_id", X.fmt_pct(F.lit(0.0), bits).alias("pct"))


@query("cost_parts", f"SELECT event_id, CASE WHEN value + 0.063::DOUBLE < 0.05 THEN '<0.1' ELSE {_fixed('value + 0.063::DOUBLE', 1)} END AS model, {_fixed('ceil(value) + 2 - (value + 0.063::DOUBLE)', 1)} AS overhead, CAST(CAST(ceil(value) + 2 AS BIGINT) AS VARCHAR) AS total FROM events")
def cost_parts(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", X.cost_parts(v + 0.063, F.ceil(v) + 2).alias("c")).select("event_id", "c.*")


@query("retry_texts", "SELECT event_id, CASE WHEN s < 90 THEN greatest(1, s) || CASE WHEN greatest(1, s) = 1 THEN ' second' ELSE ' seconds' END ELSE CAST(floor(s / 60 + 0.5) AS BIGINT) || CASE WHEN floor(s / 60 + 0.5) = 1 THEN ' minute' ELSE ' minutes' END END AS retry FROM (SELECT event_id, event_id % 400 AS s FROM events)")
def retry_texts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.retry_text(F.col("event_id") % 400).alias("retry"))


@query("loaded_lines", f"SELECT event_id, {_fixed('n / 1048576', 1)} || {_NB} || 'MiB from cache in 0.5' || {_NB} || 's' AS line FROM (SELECT event_id, event_id * 1001 + 77 AS n FROM events)")
def loaded_lines(spark, sf_dir):
    n = F.col("event_id") * 1001 + 77
    return table(spark, sf_dir, "events").select("event_id", X.loaded_summary(n, F.lit(500), n).alias("line"))
