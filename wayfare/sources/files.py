"""Sources and sinks: text lines, JSON lines, tab-separated rows, packed weights, tokenizer files, chunks and header rules.

Everything goes through Spark's readers and writers, so that any store that Spark reads will do.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import transformer

RESULT_SCHEMA = "idx long, alphabet string, status string, coded string, rt string, fnv string, dist_hash string, logit_hash string"


def lines(spark: SparkSession, path: str, n: int | None = None, drop_empty: bool = True) -> DataFrame:
    """(value): the lines of text files; the first n, if asked for."""
    df = spark.read.text(path)
    df = df.where("value <> ''") if drop_empty else df
    return df if n is None else df.limit(n)


def id_lists(spark: SparkSession, path: str) -> DataFrame:
    """(ids): whitespace-separated integers of each line; what is no integer is null."""
    return lines(spark, path).select(F.transform(F.split(F.trim("value"), "\\s+"), lambda x: x.try_cast("int")).alias("ids"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, by a stated schema; a malformed line is a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def urls_of_json_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    return json_lines(spark, path, "url string").where("url IS NOT NULL").limit(n).select("url")


def write_results(df: DataFrame, path: str) -> None:
    """Tab-separated rows in the order of RESULT_SCHEMA."""
    df.select(*T._parse_datatype_string(RESULT_SCHEMA).names).write.option("sep", "\t").option("quote", "\u0000").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).option("sep", "\t").option("quote", "\u0000").csv(path)


def as_json(*columns) -> Column:
    return F.to_json(F.struct(*columns))


def settings(column: Column, schema: str) -> Column:
    """A stored settings object; text that cannot be read gives nulls, which defaults replace."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files against a manifest (name, bytes, sha256): a row for each name with `ok` and what is wrong, length before digest."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("_n"), F.sha2("content", 256).alias("_d"))
    error = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") != F.col("bytes"), "length").when(F.col("_d") != F.col("sha256"), "digest")
    return manifest.join(files, "name", "left").withColumn("error", error).withColumn("ok", F.col("error").isNull()).drop("_n", "_d")


def export(df: DataFrame, path: str, force: bool = False) -> None:
    """Write a table once; an existing one is replaced only by force. Spark commits a write as a whole."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def located(flag: Column, environment: Column, embedded: Column) -> Column:
    """Where a file is: as asked for, else as the environment says (if it says anything), else as built in."""
    return F.coalesce(flag, F.nullif(environment, F.lit("")), embedded)


def chunk_table(files: DataFrame, chunk: int = 8 << 20) -> DataFrame:
    """(name, idx, start, bytes, sha256, chunk_name) of binaryFile rows: names carry the file's digest and the chunk size."""
    digest = F.sha2("content", 256)
    rows = files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content", digest.alias("d"), F.explode(F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(chunk))).alias("start"))
    part = F.substring("content", F.col("start") + 1, F.lit(chunk))
    idx = (F.col("start") / chunk).cast("int")
    return rows.select("name", idx.alias("idx"), "start", F.length(part).alias("bytes"), F.sha2(part, 256).alias("sha256"), F.concat("name", F.lit("."), F.left("d", F.lit(8)), F.lit(f".{chunk}."), F.lpad(idx.cast("string"), 4, "0"), F.lit(".bin")).alias("chunk_name"))


def byte_range(chunks: DataFrame, offset: int, n: int) -> DataFrame:
    """(name, content): a range of each file out of its chunks (name, idx, start, content)."""
    stop = F.col("start") + F.length("content")
    touched = chunks.where((stop > offset) & (F.col("start") < offset + n))
    first = F.greatest(F.lit(offset), F.col("start"))
    part = F.substring("content", (first - F.col("start") + 1).cast("int"), (F.least(F.lit(offset + n), stop) - first).cast("int"))
    ordered = F.sort_array(F.collect_list(F.struct("idx", part.alias("p"))))
    return touched.groupBy("name").agg(ordered.alias("s")).select("name", F.aggregate("s", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["p"])).alias("content"))


def load_weights(spark: SparkSession, path: str) -> transformer.Model:
    """A packed transformer, read by Spark and parsed on the driver; it is one file of bounded size."""
    return transformer.unpack(bytes(spark.read.format("binaryFile").load(path).first()["content"]))


def weight_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row, grp, scale, codes) of the token table of a packed file, for analysis; the file is parsed by a task."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                table = transformer.unpack(content.as_py()).wte
                groups = table.codes.shape[1]
                for at in range(0, len(table.codes), 256):
                    codes, scales = table.codes[at : at + 256], table.scales[at : at + 256]
                    flat = codes.reshape(-1, codes.shape[2]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                    rows = np.repeat(np.arange(at, at + len(codes), dtype=np.int32), groups)
                    yield pa.record_batch([pa.array(rows), pa.array(np.tile(np.arange(groups, dtype=np.int32), len(codes))), pa.array(scales.ravel().astype(np.float32)), lists], ["row", "grp", "scale", "codes"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row int, grp int, scale float, codes array<int>")


def tokenizer_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vocab(token, id), merges(rank, a, b)) of a tokenizer file; merges may be "a b" or ["a", "b"]; it must know <eos>."""
    model = json.loads(spark.read.text(path, wholetext=True).first()[0])["model"]
    if "<eos>" not in model["vocab"]:
        raise ValueError("the vocabulary has no <eos>")
    merges = [(k, *(m.split(" ", 1) if isinstance(m, str) else m)) for k, m in enumerate(model["merges"])]
    return spark.createDataFrame(sorted(model["vocab"].items(), key=lambda x: x[1]), "token string, id int"), spark.createDataFrame(merges, "rank int, a string, b string")


def header_rules(text: str) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(order, pattern, name, value, cleared name) of a headers file: a path begins a rule, indented lines set, "! Name" clears."""
    out, pattern = [], None
    for line in text.splitlines():
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        if not line[0].isspace():
            pattern = body
        elif pattern is None:
            raise ValueError(f"a header without a path: {body}")
        elif body.startswith("!"):
            out.append((len(out), pattern, None, None, body[1:].strip()))
        else:
            name, _, value = body.partition(":")
            out.append((len(out), pattern, name.strip(), value.strip(), None))
    return out


def nginx_map(text: str) -> tuple[list[tuple[int, str, str]], str]:
    """((order, pattern, value), default) of a map block; a default is required."""
    block = re.search(r"map\s+\S+\s+\S+\s*\{(.*?)\}", text, re.S)
    entries = [x.strip() for x in (block[1] if block else "").split(";")]
    named = [(k.strip('"'), v.strip().strip('"')) for k, _, v in (x.partition(" ") for x in entries if x)]
    default = [v for k, v in named if k == "default"]
    if not default:
        raise ValueError("the map has no default")
    return [(i, k, v) for i, (k, v) in enumerate(x for x in named if x[0] != "default")], default[0]
