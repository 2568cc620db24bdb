"""Plans over embeddings: quantised groups, norms, neighbours, pooling and principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quant as Q
from .registry import query, table

_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), t AS (SELECT *, list_max(list_transform(e, lambda x: abs(x))) AS top FROM v)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query(
    "int4_group_quantize",
    f"WITH {_V}, s AS (SELECT vec_id, e, CASE WHEN top > 0 THEN top / 7 ELSE 1 END AS s FROM t) SELECT vec_id, round(s, 9) AS scale, array_to_string(list_transform(e, lambda y: CAST(CASE WHEN y / s < 0 THEN -floor(-y / s + 0.5) ELSE floor(y / s + 0.5) END + 7 AS INT)), ',') AS codes FROM s",
)
def int4_group_quantize(spark, sf_dir):
    g = vectors(spark, sf_dir).select("vec_id", Q.int4_group(F.col("e")).alias("g"))
    return g.select("vec_id", F.round("g.scale", 9).alias("scale"), F.array_join(F.transform("g.codes", lambda c: c.cast("string")), ",").alias("codes"))


@query(
    "int4_dequant_error",
    f"WITH {_V}, s AS (SELECT vec_id, e, CASE WHEN top > 0 THEN top / 7 ELSE 1 END AS s FROM t) SELECT vec_id, round(list_max(list_transform(e, lambda y: abs(y - s * CASE WHEN y / s < 0 THEN -floor(-y / s + 0.5) ELSE floor(y / s + 0.5) END))), 6) AS worst, round(sqrt(list_sum(list_transform(e, lambda y: power(y - s * CASE WHEN y / s < 0 THEN -floor(-y / s + 0.5) ELSE floor(y / s + 0.5) END, 2))) / len(e)), 6) AS rms FROM s",
)
def int4_dequant_error(spark, sf_dir):
    g = vectors(spark, sf_dir).withColumn("g", Q.int4_group(F.col("e")))
    error = F.zip_with("e", Q.dequantize(F.col("g.scale"), F.col("g.codes")), lambda a, b: F.abs(a - b))
    rows = g.select("vec_id", error.alias("d"))
    return rows.select("vec_id", F.round(F.array_max("d"), 6).alias("worst"), F.round(F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x) / F.size("d")), 6).alias("rms"))


@query(
    "act_quant_int8",
    f"WITH {_V}, s AS (SELECT vec_id, e, CASE WHEN top > 0 THEN top / 127 ELSE 1 END AS s FROM t), q AS (SELECT vec_id, s, list_transform(e, lambda y: CAST(CASE WHEN y / s < 0 THEN -floor(-y / s + 0.5) ELSE floor(y / s + 0.5) END AS INT)) AS q FROM s) SELECT vec_id, round(s, 9) AS scale, CAST(list_sum(q) AS BIGINT) AS sum, array_to_string(q, ',') AS q FROM q",
)
def act_quant_int8(spark, sf_dir):
    g = vectors(spark, sf_dir).select("vec_id", F.get(Q.int8_groups(F.col("e")), F.lit(0)).alias("g"))
    return g.select("vec_id", F.round("g.scale", 9).alias("scale"), F.col("g.sum").cast("bigint").alias("sum"), F.array_join(F.transform("g.q", lambda x: x.cast("string")), ",").alias("q"))


@query("int_dot_rows", f"WITH {_V}, s AS (SELECT vec_id, CASE WHEN top > 0 THEN top / 127 ELSE 1 END AS a, CASE WHEN top > 0 THEN top / 7 ELSE 1 END AS w, e FROM t) SELECT vec_id, CAST(list_sum(list_transform(e, lambda y: CAST(CASE WHEN y / a < 0 THEN -floor(-y / a + 0.5) ELSE floor(y / a + 0.5) END * CASE WHEN y / w < 0 THEN -floor(-y / w + 0.5) ELSE floor(y / w + 0.5) END AS INT))) AS BIGINT) AS dot FROM s")
def int_dot_rows(spark, sf_dir):
    """The integer dot of a vector's int4 codes with its own int8 values."""
    g = vectors(spark, sf_dir).select("vec_id", F.get(Q.int8_groups(F.col("e")), F.lit(0)).alias("a"), Q.int4_group(F.col("e")).alias("w"))
    return g.select("vec_id", F.aggregate(F.zip_with("a.q", "w.codes", lambda x, c: x * (c - 7)), F.lit(0), lambda s, x: s + x).cast("bigint").alias("dot"))


@query("vector_norms", f"WITH {_V} SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm FROM v")
def vector_norms(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(Q.norm(F.col("e")), 6).alias("norm"))


@query(
    "adjacent_cosine",
    f"WITH {_V}, n AS (SELECT vec_id, e, lead(e) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM v) SELECT vec_id, round(list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))), 6) AS cosine FROM n WHERE f IS NOT NULL",
)
def adjacent_cosine(spark, sf_dir):
    w = Window.partitionBy("label").orderBy("vec_id")
    return vectors(spark, sf_dir).withColumn("f", F.lead("e").over(w)).where("f IS NOT NULL").select("vec_id", F.round(Q.cosine(F.col("e"), F.col("f")), 6).alias("cosine"))


@query(
    "nearest_vector",
    f"WITH {_V}, q AS (SELECT * FROM v WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id, v.vec_id AS other, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(q.e[i] - v.e[i], 2)))) AS d FROM q JOIN v ON q.vec_id <> v.vec_id) SELECT vec_id, arg_min(other, (round(d, 9), other)) AS nearest, round(min(d), 6) AS distance FROM d GROUP BY vec_id",
)
def nearest_vector(spark, sf_dir):
    """Stated queries (ids divisible by 50) against all rows."""
    rows = vectors(spark, sf_dir).select("vec_id", "e")
    return nearest(rows.where("vec_id % 50 = 0"), rows).select("vec_id", "nearest", F.round("distance", 6).alias("distance"))


#: Vectors of a block: a pair of blocks takes some megabytes, whatever the tables.
BLOCK = 1024


def _blocks(rows: DataFrame, ids: str, vectors_: str) -> DataFrame:
    """Rows (vec_id, e) as blocks of BLOCK vectors, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array([batch.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([flat.astype("<f8").tobytes()], pa.binary())], [ids, vectors_])

    return rows.where("e IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("e").cast("array<double>")).mapInArrow(run, f"{ids} binary, {vectors_} binary")


def nearest(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(vec_id, nearest, distance) of queries (vec_id, e) among all rows but their own id; ties at nine decimals go to the least id.

    Blocks of queries meet blocks of rows in one plan. A matrix product finds each query's best of a block up to rounding, and the exact
    distances of what lies within that decide; the least of all blocks is a partial minimum.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, own = (np.frombuffer(batch.column(c)[k].as_buffer(), "<i8") for c in (0, 2))
                q, v = (np.frombuffer(batch.column(c)[k].as_buffer(), "<f8").reshape(len(n), -1) for c, n in ((1, ids), (3, own)))
                near = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T)
                near[ids[:, None] == own[None, :]] = np.inf
                low = near.min(1, initial=np.inf)
                scale = (q * q).sum(1) + (v * v).sum(1).max(initial=0) + 1
                a, b = np.nonzero((near <= (low + 1e-7 * scale)[:, None]) & np.isfinite(near))
                d = np.round(np.sqrt(((q[a] - v[b]) ** 2).sum(1)), 9)
                order = np.lexsort((own[b], d, a))
                first = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])] if len(order) else order
                yield pa.record_batch([pa.array(ids[a[first]]), pa.array(own[b[first]]), pa.array(d[first])], ["vec_id", "nearest", "distance"])

    pairs = _blocks(queries, "qi", "qv").crossJoin(_blocks(rows, "ri", "rv"))
    found = pairs.mapInArrow(best, "vec_id long, nearest long, distance double")
    return found.groupBy("vec_id").agg(F.min(F.struct("distance", "nearest")).alias("b")).select("vec_id", "b.nearest", "b.distance")


@query("top_dims", f"WITH {_V}, x AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM v) SELECT vec_id, CAST(dim AS INT) AS dim, round(x, 6) AS x, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, dim) AS r FROM x) WHERE r <= 6")
def top_dims(spark, sf_dir):
    """The six largest values of each vector: a sort inside the row, no shuffle."""
    marked = F.transform("e", lambda x, i: F.struct((-F.abs(x)).alias("k"), i.alias("dim"), x.alias("x")))
    top = F.slice(F.array_sort(marked), 1, 6)
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(top).alias("r", "t")).select("vec_id", "t.dim", F.round("t.x", 6).alias("x"), (F.col("r") + 1).alias("r"))


@query("bucket_pool", f"WITH {_V}, x AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM v), b AS (SELECT vec_id, CAST(dim // 8 AS INT) AS bucket, arg_max(x, (abs(x), -dim)) AS x FROM x GROUP BY 1, 2) SELECT vec_id, bucket, round(x, 6) AS x, round(sqrt(abs(x) / max(abs(x)) OVER (PARTITION BY vec_id)), 6) AS intensity FROM b")
def bucket_pool(spark, sf_dir):
    """By eight values the one of largest size, with its sign; intensity is the root of its share of the row's largest."""
    largest = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: F.when(F.abs(x) > F.abs(a), x).otherwise(a))
    pooled = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: largest(F.slice("e", b * 8 + 1, 8)))
    rows = vectors(spark, sf_dir).select("vec_id", F.array_max(F.transform("e", F.abs)).alias("top"), F.posexplode(pooled).alias("bucket", "x"))
    return rows.select("vec_id", "bucket", F.round("x", 6).alias("x"), F.round(F.sqrt(F.abs("x") / F.col("top")), 6).alias("intensity"))


@query("range_filter_box", f"WITH {_V} SELECT vec_id, label FROM v WHERE e[1] BETWEEN -0.5 AND 0.5 AND e[2] BETWEEN -1 AND 0.25 AND label IN (0, 1, 2, 3)")
def range_filter_box(spark, sf_dir):
    return vectors(spark, sf_dir).where(F.get("e", F.lit(0)).between(-0.5, 0.5) & F.get("e", F.lit(1)).between(-1, 0.25) & F.col("label").isin(0, 1, 2, 3)).select("vec_id", "label")


@query("virtual_page", "SELECT vec_id, CAST(rn AS INT) AS rn FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings) WHERE rn > 35 AND rn <= 75")
def virtual_page(spark, sf_dir):
    """Rows first to last of an ordered list: 40 rows in view, 5 before and 10 after; a top-k, not a sort of all."""
    first, last = max(0, 1200 // 30 - 5), 1200 // 30 - 5 + 30 + 10
    return vectors(spark, sf_dir).select("vec_id").orderBy("vec_id").offset(first).limit(last - first).withColumn("rn", F.row_number().over(Window.orderBy("vec_id")) + first)


@query("label_centroids", f"WITH {_V}, x AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM v) SELECT label, CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean, round(max(x) - min(x), 6) AS span FROM x GROUP BY 1, 2")
def label_centroids(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("label", F.posexplode("e").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.max("x") - F.min("x"), 6).alias("span"))


def covariance(rows: DataFrame, column: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of a vector column: each partition sends its sums, size * size numbers whatever the table."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, np.zeros(size), np.zeros((size, size))
        for pdf in batches:
            v = np.array(pdf[column].tolist(), float).reshape(-1, size)
            n, s, c = n + len(v), s + v.sum(0), c + v.T @ v
        if n:
            yield pd.DataFrame({"k": np.arange(size * size + size + 1), "v": np.concatenate([[n], s, c.ravel()])})

    got = rows.select(column).mapInPandas(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(size * size + size + 1)
    for k, v in got:
        flat[k] = v
    n, s, c = max(flat[0], 1), flat[1 : size + 1], flat[size + 1 :].reshape(size, size)
    return s / n, c / n - np.outer(s / n, s / n)


def power_components(cov: np.ndarray, count: int = 2, rounds: int = 30) -> np.ndarray:
    """Leading directions by power iteration from a constant start, each freed of those before."""
    found: list[np.ndarray] = []
    for _ in range(count):
        x = np.full(len(cov), 1 / np.sqrt(len(cov)))
        for _ in range(rounds):
            x = cov @ x
            for f in found:
                x = x - f * (f @ x)
            x = x / (np.linalg.norm(x) or 1)
        found.append(x)
    return np.array(found)


@query("pca2_power_iteration")
def pca2_power_iteration(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    mean, cov = covariance(rows, "e", 64)
    axes = power_components(cov)
    centred = F.zip_with("e", F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b)
    place = lambda k: F.round(Q.dot(centred, F.array(*map(F.lit, axes[k].tolist()))), 6)
    return rows.select("vec_id", place(0).alias("x"), place(1).alias("y"))


@query("transformer_sizes", "SELECT CAST(v * d + b * d + l * (2 * d + 4 * d * d + 3 * h * d) + d AS BIGINT) AS params, CAST(v * d + b * d + l * (4 * d * d + 3 * h * d) AS BIGINT) AS without_norms, CAST(32 AS BIGINT) AS tokens_at, CAST(32 + v * (d // 64) * 34 AS BIGINT) AS places_at FROM (SELECT 12::BIGINT AS l, 1280::BIGINT AS d, 8192::BIGINT AS v, 512::BIGINT AS b, 3392::BIGINT AS h)")
def transformer_sizes(spark, sf_dir):
    """Counts and offsets of the 12-layer configuration, by closed forms."""
    one = spark.range(1).select(*(F.lit(v).cast("bigint").alias(n) for n, v in (("l", 12), ("d", 1280), ("v", 8192), ("b", 512), ("h", 3392))))
    at = Q.artifact_offsets(F.col("d"), F.col("v"))
    return one.select(Q.parameter_count(F.col("l"), F.col("d"), F.col("v"), F.col("b"), F.col("h")).alias("params"), Q.parameter_count(F.col("l"), F.col("d"), F.col("v"), F.col("b"), F.col("h"), with_norms=False).alias("without_norms"), at[0].alias("tokens_at"), at[1].alias("places_at"))
