"""Sources and sinks, and streams against their batch forms."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from wayfare.operators import transformer
from wayfare.operators.tokenizer import Tokenizer
from wayfare.plans.events import throttle
from wayfare.sources import files
from wayfare.streaming import events as S


def test_files(spark, tmp_path):
    (tmp_path / "u.txt").write_text("a b\n\n1 2 x\n")
    assert [r.value for r in files.lines(spark, str(tmp_path / "u.txt")).collect()] == ["a b", "1 2 x"]
    assert [r.ids for r in files.id_lists(spark, str(tmp_path / "u.txt")).collect()] == [[None, None], [1, 2, None]]
    (tmp_path / "j.jsonl").write_text('{"url": "a"}\nbroken\n{"url": "b"}\n')
    assert [r.url for r in files.urls_of_json_lines(spark, str(tmp_path / "j.jsonl"), 5).collect()] == ["a", "b"]
    rows = [(1, "base79", "OK", "~a\"b", "1", "f", "d", "l")]
    files.write_results(spark.createDataFrame(rows, files.RESULT_SCHEMA), str(tmp_path / "t"))
    assert [tuple(r) for r in files.read_results(spark, str(tmp_path / "t")).collect()] == rows


def test_chunks_and_manifest(spark, tmp_path):
    raw = bytes(range(256)) * 10
    (tmp_path / "w.bin").write_bytes(raw)
    read = spark.read.format("binaryFile").load(str(tmp_path / "w.bin"))
    chunks = files.chunk_table(read, 1000).orderBy("idx").collect()
    assert [c.bytes for c in chunks] == [1000, 1000, 560] and chunks[1].sha256 == hashlib.sha256(raw[1000:2000]).hexdigest()
    parts = spark.createDataFrame([("w", c.idx, c.start, bytearray(raw[c.start : c.start + c.bytes])) for c in chunks], "name string, idx int, start int, content binary")
    assert bytes(files.byte_range(parts, 900, 1200).first().content) == raw[900:2100]
    manifest = spark.createDataFrame([("w.bin", len(raw), hashlib.sha256(raw).hexdigest()), ("x.bin", 1, "0")], "name string, bytes long, sha256 string")
    assert {r.name: r.error for r in files.verified(spark, str(tmp_path / "w.bin"), manifest).collect()} == {"w.bin": None, "x.bin": "missing"}
    config = (1, 2, 64, 257, 8, 64)
    (tmp_path / "m.nurl").write_bytes(transformer.pack(transformer.synthetic(config)))
    assert files.load_weights(spark, str(tmp_path / "m.nurl")).config == config
    model = files.load_weights(spark, str(tmp_path / "m.nurl"))
    got = {(r.row, r.grp): (r.scale, r.codes) for r in files.weight_rows(spark, str(tmp_path / "m.nurl")).collect()}
    assert len(got) == 257 and all(got[r, 0] == (float(model.wte.scales[r, 0]), model.wte.codes[r, 0].tolist()) for r in (0, 100, 256))


def test_export_and_locate(spark, tmp_path):
    path = str(tmp_path / "once")
    files.export(spark.range(3), path)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        files.export(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    files.export(spark.range(5), path, force=True)
    assert spark.read.parquet(path).count() == 5
    rows = spark.createDataFrame([("f", "e", "b"), (None, "e", "b"), (None, "", "b")], "f string, e string, b string")
    assert [r[0] for r in rows.select(files.located(F.col("f"), F.col("e"), F.col("b"))).collect()] == ["f", "e", "b"]


def test_tokenizer_and_rules(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"model": {"vocab": {"<eos>": 0, "a": 1, "b": 2, "ab": 3}, "merges": ["a b", ["b", "a"]]}}')
    vocab, merges = files.tokenizer_tables(spark, str(tmp_path / "t.json"))
    own = Tokenizer.of_tables(vocab, merges)
    assert own.encode("abab") == [3, 3] and own.decode([3, 1]) == "aba"
    with pytest.raises(ValueError, match="no token"):
        own.encode("c")
    assert vocab.count() == 4 and [(r.rank, r.a, r.b) for r in merges.orderBy("rank").collect()] == [(0, "a", "b"), (1, "b", "a")]
    assert files.header_rules("/*\n  A: b: c\n  ! D\n") == [(0, "/*", "A", "b: c", None), (1, "/*", None, None, "D")]
    assert files.nginx_map('map $uri $x { default "a"; ~*\\.bin$ "b"; }') == ([(0, "~*\\.bin$", "b")], "a")


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [(1, at(0), 1, "wait", 0.0), (1, at(1), 2, "open", 1.0), (1, at(2), 3, "wait", 5.0), (2, at(0), 4, "wait", 0.0), (2, at(3), 5, "discard", 2.0), (2, at(4), 6, "open", 3.0)]
    schema = "key long, ts timestamp, seq long, kind string, value double"
    src = _stream(spark, tmp_path, rows, schema)
    assert {(r.key, r.seq) for r in _run(S.latest_wins(src), "latest", "complete")} == {(1, 3), (2, 6)}
    assert sorted((r.key, r.seq) for r in _run(S.gate(src), "gate", "append")) == [(1, 1), (1, 3)]
    rates = {r.seq: r.rate for r in _run(S.trailing_rate(src, 2, 1), "rate", "append")}
    assert rates[1] is None and rates[2] == 1.0 and rates[3] == 2.5
    assert sorted(r.seq for r in _run(S.throttle(src, 2), "throttle", "append")) == [1, 3, 4, 5]
    batch = spark.createDataFrame(rows, schema)
    assert {(r.key, r.fired, r.n) for r in S.debounce(batch, "2 seconds").collect()} == {(1, 3, 3), (2, 4, 1), (2, 6, 2)}
    assert batch.select(F.count("*")).first()[0] == 6


def test_throttle_is_greedy(spark):
    rows = [(k, 1, 400 * k) for k in range(9)] + [(100 + k, 2, k * k * 70 % 5000) for k in range(40)] + [(200, None, 5), (201, None, 7), (202, 3, None), (203, 3, 1)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t long").repartition(3)
    wanted, last, before = [], {}, {}
    for e, u, t in sorted(rows, key=lambda r: (r[1] or 0, -1 if r[2] is None else r[2], r[0])):
        if t is None or u not in last or t - last[u] >= 600:
            wanted.append((e, None if t is None or u not in before else t - before[u]))
            if t is not None:
                last[u] = t
        if t is not None:
            before[u] = t
    got = throttle(df, 600).collect()
    assert sorted((r.event_id, r.gap) for r in got) == sorted(wanted)
    assert sorted(r.event_id for r in got if r.user_id == 1) == [0, 2, 4, 6, 8]
    assert throttle(df.limit(0), 600).count() == 0
