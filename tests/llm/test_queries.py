"""The registered queries themselves, on tables of odd rows and on empty ones: columns, types, rows, and that nothing crashes."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from wayfare.llm.queries import QUERIES  # noqa: E402

LINE = "A common line of the house that every document carries around with it"
ROWS = [
    (0, None, "en", "h1"), (1, "", None, None), (2, " \n\t ", "en", "h1"), (3, "one", "de", "h2"), (4, "ONE", "de", "h2"),
    *((10 + k, f"{LINE}\nall about number {k} and what it does with {k * 7} others of its kind in the house", "en", "h1") for k in range(8)),
    (30, "grubble you snotface go away now", "en", "h3"), (30, "grubble you snotface go away now", "en", "h3"), (31, "中文沒有空格的長句子 <|endoftext|> żółć 😀", "zh", "h3"),
    (32, "word " * 30000, "en", "h2"), (33, "x" * 5000, None, "h2"), (None, "a text without a number that is long enough to be one", "en", "h2"),
]
COLUMNS = {
    "op1": {"doc_id": "bigint", "item_id": "bigint"},
    "op2": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op3": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op4": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op6": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op8": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), True)


def tables(spark, path, empty):
    made = {
        "documents": spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")),
        "benchmark": spark.createDataFrame([(1, "all about number 3 and what it does with 21 others"), (2, None), (2, ""), (1, "all about number 3 and what it does with 21 others")], "item_id long, text string"),
        "labels": spark.createDataFrame([(30, 1, 1), (30, 0, 1), (10, 1, 0), (None, 0, None), (99, 1, 0)], "doc_id long, quality int, toxic int"),
        "conversations": spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>"), (1, 2, "assistant", "<|im_end|>"), (None, 0, None, "x")], "conv_id long, turn int, role string, text string"),
    }
    for name, df in made.items():
        # names that operators use for themselves
        df = df.withColumns({c: F.lit("mine") for c in ("score", "n_lines", "id", "ids", "window", "n", "shard", "word", "host", "training", "_text") if c not in df.columns})
        (df.limit(0) if empty else df).repartition(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd, name):
    df = QUERIES[name](spark, odd)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name.split("_")[0]]} == COLUMNS[name.split("_")[0]]
    got = df.collect()
    if name.startswith("op1_"):
        assert {(r.doc_id, r.item_id) for r in got} == {(10 + k, 1) for k in range(8)}  # two of eleven words may differ
        return
    key = "conv_id" if name.startswith("op3_") else "doc_id"
    if key == "doc_id":
        assert sorted((repr(r[key]) for r in got)) == sorted(repr(r[0]) for r in ROWS)
    else:
        probe = "<|im_end|><|im_start|>assistant ok"
        by = {r.conv_id: r for r in got}
        assert set(by) == {-1, 1, None} and by[-1].loss_sha256 == hashlib.sha256(probe.encode()).hexdigest() and by[1].n_turns == 4
    rows = {r[key]: r for r in got}
    if name.startswith("op8_"):
        assert all(rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in ROWS)
    if name.startswith("op7_"):
        assert rows[10].n_dropped == 1 and rows[17].n_dropped == 0 and rows[0].n_lines == 1
    if name.startswith("op6_"):
        assert rows[0].lang_pred == rows[2].lang_pred == "und" and rows[10].held_out == (zlib.crc32(b"10") % 3 == 1)
    if name.startswith("op4_"):
        assert rows[3].component_id == rows[4].component_id == 3 and rows[None].component_id is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    got = QUERIES[name](spark, empty).collect()
    assert [r.conv_id for r in got] == [-1] if name.startswith("op3_") else not got


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline_on(spark, which, request):
    import corpus_pipeline

    path = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, path)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = [r.doc_id for r in corpus_pipeline.run(spark, path).collect()]
    if which == "empty":
        assert not got
    else:
        # no language, no text, a leak of the benchmark, and one of each pair of copies are gone; rows that share an id stay together
        assert {0, 1, 2, 4, *range(10, 18)}.isdisjoint(got) and got.count(30) == 2 and {3, 31, 32, None} <= set(got)
