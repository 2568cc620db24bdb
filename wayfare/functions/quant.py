"""Probability grids and quantised vectors, as Catalyst expressions and window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Symbols share 2**24 slots; each has one at least.
TOTAL = 1 << 24
GROUP = 64


def running(df: DataFrame, by: list[str], coarse: list[tuple[Column, bool]], fine: list[Column], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of value over the group's rows up to this one, in the order of coarse, then fine.

    coarse is a list of (column, whether it rises). Sums by coarse key are made first; only these, one row for each key, are added
    up in order, and each row then needs its own key's rows alone. So no task holds a group unless a key does.
    """
    keys = [f"_k{i}" for i in range(len(coarse))]
    rows = df.select("*", value.alias("_v"), *(c.alias(k) for k, (c, _) in zip(keys, coarse, strict=True)))
    order = [F.asc(k) if rises else F.desc(k) for k, (_, rises) in zip(keys, coarse, strict=True)]
    sums = rows.groupBy(*by, *keys).agg(F.sum("_v").alias("_s"))
    upto = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, *keys, F.coalesce(F.sum("_s").over(upto), F.lit(0).cast("bigint")).alias("_before"))
    within = F.sum("_v").over(Window.partitionBy(*by, *keys).orderBy(*fine).rowsBetween(Window.unboundedPreceding, 0))
    rows, before = rows.withColumn("_within", within).alias("r"), before.alias("b")
    match = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*by, *keys)]
    return rows.join(before, match).select(*(F.col(f"r.{c}") for c in df.columns), (F.col("b._before") + F.col("r._within")).alias(name))


def prefix(symbol) -> Column:
    """The first three characters: texts are in the order of their prefixes, then of themselves."""
    return F.left(symbol, F.lit(3))


def quantize(dist: DataFrame, by: list[str], symbol: str, weight: str) -> DataFrame:
    """dist with freq, cum_lo and cum_hi: integer frequencies by group `by`, in the order of `symbol` (a text).

    f = trunc(w / sum * (TOTAL - n)) + 1; what is left goes to the heaviest symbol, the first of equals. A group has a slot for each of
    its symbols, so more than TOTAL of them raise an error.
    """
    base = F.floor(F.col(weight) / F.col("_sum") * (F.lit(TOTAL) - F.col("_n"))).cast("bigint") + 1
    enough = F.when(F.col("_n") > TOTAL, F.raise_error(F.lit("more symbols than slots"))).otherwise(base)
    sums = dist.groupBy(*by).agg(F.sum(weight).alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min(F.struct((-F.col(weight)).alias("w"), F.col(symbol).alias("s")))["s"].alias("_top"))
    with_sums = _beside(dist, sums, by).withColumn("_f", enough)
    left = with_sums.groupBy(*by).agg((F.lit(TOTAL) - F.sum("_f")).alias("_left"))
    freq = F.col("_f") + F.when(F.col(symbol) == F.col("_top"), F.col("_left")).otherwise(0)
    rows = _beside(with_sums, left, by).withColumn("freq", freq).drop("_sum", "_n", "_top", "_f", "_left")
    out = running(rows, by, [(prefix(symbol), True)], [F.asc(symbol)], F.col("freq"), "cum_hi")
    return out.withColumn("cum_lo", F.col("cum_hi") - F.col("freq"))


def _beside(rows: DataFrame, sums: DataFrame, by: list[str]) -> DataFrame:
    """Sums of groups beside their rows; without groups the sums are one row."""
    return rows.join(sums, by) if by else rows.crossJoin(F.broadcast(sums))


def percentile(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, n, and the exact percentile of value for each name and share, between neighbours as usual. Nulls are left out.

    Values are counted, the counts are added up within 4,096 stretches of each group's range, and only rows at the wanted places
    meet, so no task holds a group.
    """
    rows = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ends = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("_n"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 4096)).otherwise(F.lit(0).cast("bigint"))
    upto = running(_beside(rows, ends, by), by, [(place, True)], [F.asc(value)], F.col("_c"), "_upto")
    out = [F.max("_n").alias("n")]
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_n") - 1)
        of = lambda k: F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - F.col("_c") <= k), F.col(value)))  # noqa: B023, E731
        low, high, part = of(F.floor(at)), of(F.ceil(at)), F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return upto.groupBy(*by).agg(*out)


def information(lo, hi) -> Column:
    """Bits of an interval of the grid."""
    return F.lit(24.0) - F.log2(hi - lo)


def _abs_max(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))


def _round_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def int8_groups(vector: Column, size: int = GROUP) -> Column:
    """array<struct<scale, q, sum>>: by group, scale = absmax / 127 (1 if all is zero) and rounded values."""
    groups = F.transform(F.sequence(F.lit(0), (F.size(vector) / size).cast("int") - 1), lambda g: F.slice(vector, g * size + 1, size))

    def one(v: Column) -> Column:
        top = _abs_max(v)
        scale = F.when(top > 0, top / 127).otherwise(1.0)
        q = F.transform(v, lambda x: _round_away(x.cast("double") / scale).cast("int"))
        return F.struct(scale.alias("scale"), q.alias("q"), F.aggregate(q, F.lit(0), lambda a, x: a + x).alias("sum"))

    return F.transform(groups, one)


def int4_group(vector: Column) -> Column:
    """struct<scale, codes>: scale = absmax / 7, codes 0 to 14 with 7 for zero."""
    top = _abs_max(vector)
    scale = F.when(top > 0, top / 7).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.transform(vector, lambda x: (_round_away(x.cast("double") / scale) + 7).cast("int")).alias("codes"))


def dequantize(scale: Column, codes: Column) -> Column:
    return F.transform(codes, lambda c: (c - 7) * scale)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine; a norm of zero counts as one."""
    d = norm(a) * norm(b)
    return dot(a, b) / F.when(d > 0, d).otherwise(1.0)


def parameter_count(layers, width, vocab, block, hidden, with_norms: bool = True) -> Column:
    """Weights of the transformer, by its sizes."""
    d, h = width.cast("bigint"), hidden.cast("bigint")
    norms = d * 2 if with_norms else F.lit(0)
    return vocab * d + block * d + layers * (norms + 4 * d * d + 3 * h * d) + (d if with_norms else F.lit(0))


def artifact_offsets(width, vocab) -> tuple[Column, Column]:
    """Byte offsets of the token and position tables in a packed file with half-precision scales."""
    return F.lit(32).cast("bigint"), 32 + vocab.cast("bigint") * (width / GROUP).cast("bigint") * 34
