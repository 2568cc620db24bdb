"""Near-dedup, BPE, token files, toxicity, language model and the pipeline: brute force and odd rows on small tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from wayfare.llm import bpe, lm_score, near_dedup, pieces, token_files, toxicity
from wayfare.llm.common import chunks, crc_mod, span_hashes

P = pytest.importorskip("public_tokenizers")
WORDS = [f"w{k}" for k in range(400)]
LETTERS = ["a", "b", "'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "1", "²", "é", "中", "!", '?"', "'v", "😀", "d", "m", "_", "́", "İ"]


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def documents(seed=1):
    rng = np.random.default_rng(seed)
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one"), (4, "ONE"), (5, "one two three four"), (6, "one two three four five")]
    for g in range(12):
        base = list(rng.choice(WORDS, int(rng.integers(5, 160))))
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for k in rng.choice(len(w), int(rng.integers(0, 1 + len(w) // 9)), replace=False):
                w[k] = f"n{rng.integers(1000)}"
            rows.append((len(rows) + 1, " ".join(w)))
    return [*rows, rows[-1]]


def brute_components(rows, n):
    sets = {}
    for i, t in rows:
        w = lower(t).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    of = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                shared = len(sets[i] & sets[j])
                if shared and 100 * shared >= 80 * len(sets[i] | sets[j]) and of[i] != of[j]:
                    of[i] = of[j] = min(of[i], of[j])
                    changed = True
    return {i: (len(sets[i]), of[i]) for i in sets}


@pytest.mark.parametrize("n", [4, 5])
def test_near_dedup(spark, n):
    rows = documents(n)
    df = spark.createDataFrame([*rows, (None, "one two three four five")], "doc_id long, text string").withColumn("id", F.lit("mine"))
    got = near_dedup.near_duplicates(df, n).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(df, n).collect()}
    assert kept == {r.doc_id for r in got if r.kept}
    assert near_dedup.near_duplicates(df.limit(0), n).count() == 0


def test_near_dedup_repeated_id(spark):
    """Rows of one id with different texts are one document with the least set; the result does not depend on their order."""
    a, b = " ".join(WORDS[:30]), " ".join(WORDS[40:80])
    rows = [(1, a), (2, a + " x"), (3, b), (3, a + " y"), (3, a + " y"), (4, b + " z"), (5, ""), (5, b)]
    wanted = {(1, 27, 1), (2, 28, 1), (3, 28, 1), (3, 37, 1), (4, 38, 4), (5, 0, 5), (5, 37, 5)}
    for order in (rows, rows[::-1]):
        got = near_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3), 4).collect()
        assert len(got) == len(rows) and {(r.doc_id, r.n_shingles, r.component_id) for r in got} == wanted


def test_prefix_pairs_are_complete(spark):
    rng = np.random.default_rng(8)
    base = rng.choice(1 << 50, 60, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.9], rng.choice(1 << 50, int(rng.integers(0, 12))).astype(np.uint64)])) for _ in range(40)]
    df = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "id long, set binary")
    placed = spark.createDataFrame([(k, k) for k in range(40)], "id long, component long")
    wanted = {(a, b) for a in range(40) for b in range(a + 1, 40) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    got = {(r.a, r.b) for r in near_dedup._prefix_pairs(df, placed, 80).collect()}
    assert wanted and wanted <= got
    assert {(r.a, r.b) for r in near_dedup._confirmed(spark.createDataFrame(sorted(got), "a long, b long"), df, 80).collect()} == wanted


def test_estimate():
    rng = np.random.default_rng(4)
    a = rng.choice(1 << 51, 3000, replace=False).astype(np.uint64)
    b = np.concatenate([a[:2600], rng.choice(1 << 51, 400).astype(np.uint64)])
    regs = [near_dedup.registers(np.sort(x), np.array([0, len(x)])) for x in (a, b)]
    guess, error = near_dedup.estimate(*regs, np.array([3000.0]), np.array([3000.0]))
    assert abs(guess[0] - 2600 / 3400) < 5 * error[0]


def thue_morse(n):
    """Two texts whose polynomial hashes modulo 2**64 agree."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def odd_texts():
    rng = np.random.default_rng(6)
    return ["", None, "'s", "a's", " 's", "\n's", "'sfoo", "x" * 700, " ".join(rng.choice(WORDS, 3000)), *("".join(rng.choice(LETTERS, int(rng.integers(0, 40)))) for _ in range(400))]


def test_hashes_tell_structured_texts_apart():
    for n in (1024, 2048, 4096):
        data = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
        x = span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert x[0] != x[1] and x[1] == span_hashes(data[n:], np.array([0]), np.array([n]))[0]
    # a span's hash does not depend on what is hashed with it
    data = np.frombuffer(b"short" + b"x" * 500 + b"short", np.uint8)
    together = span_hashes(data, np.array([0, 5, 505]), np.array([5, 505, 510]))
    assert together[0] == together[2] == span_hashes(data, np.array([0]), np.array([5]))[0] and together[1] == span_hashes(data, np.array([5]), np.array([505]))[0]
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    a = rng.integers(0, 3800, 5000)
    b = a + rng.integers(1, 200, 5000)
    got, wanted = span_hashes(data, a, b), [data[x:y].tobytes() for x, y in zip(a, b, strict=True)]
    assert len(set(got.tolist())) == len(set(wanted)) == len({*zip(got.tolist(), wanted, strict=True)})


def test_operators_tell_structured_words_apart(spark):
    """Words whose polynomial hashes agree are different words to near-dedup, decontamination and the language model."""
    from wayfare.llm import decontaminate

    a, b = thue_morse(1024)
    df = spark.createDataFrame([(1, f"{a} x y z u"), (2, f"{b} x y z u")], "doc_id long, text string")
    assert sorted(r.component_id for r in near_dedup.near_duplicates(df, 5).collect()) == [1, 2]
    bench = spark.createDataFrame([(7, f"{a} {a} {a} x y z u")], "item_id long, text string")
    texts = spark.createDataFrame([(1, f"{a} {a} {a} x y z u"), (2, f"{b} {b} {b} x y z u")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.find_leaks(texts, bench).collect()] == [1]
    assert {r.doc_id: r.n_known for r in lm_score.score(df, F.col("doc_id") == 1).collect()} == {1: 6, 2: 5}


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from wayfare.llm import common

    session = lambda master, where: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: where, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(session("local-cluster[2,1,512]", None))
    assert common.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y" and common.shared_dir(session("local[2]", None)).startswith("file:///")


def test_known_loses_nothing():
    known, rng, wanted = pieces.Known(bits=4), np.random.default_rng(3), {}
    for _ in range(30):
        asked = rng.integers(0, 60_000, 4000).astype(np.uint64)
        got = pieces.numbered(asked, known, lambda places: range(len(wanted), len(wanted) + len(places)))
        for h, n in zip(asked.tolist(), got.tolist(), strict=True):
            assert wanted.setdefault(h, n) == n
    assert sorted(wanted.values()) == list(range(len(wanted)))


def test_pieces():
    pattern, texts = regex.compile(P.PATTERN), odd_texts()
    for at, to, data, offs in chunks(pa.array(texts, pa.string()), 2000):
        starts, ends, _, of = pieces.split(data, offs)
        raw = data.tobytes()
        for k in range(to - at):
            assert [raw[a:b].decode() for a, b in zip(starts[of[k] : of[k + 1]], ends[of[k] : of[k + 1]], strict=True)] == pattern.findall(texts[at + k] or "")


def test_bpe(spark):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    a, b = thue_morse(1024)
    texts = [*odd_texts(), "中文沒有空格的長句子可以很長很長" * 40 + "ж" * 300, f"{a} {b}", "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("mine")).repartition(3)
    for shared in (bpe.SHARED, 100, 0):  # beyond the table of shared words each task folds its own
        got = {r.doc_id: r for r in bpe.encode_and_decode(df, path, shared).collect()}
        assert len(got) == len(texts)
        for k, t in enumerate(texts):
            ids = library.encode_ordinary(t or "")
            assert np.frombuffer(bytes(got[k].ids), "<u4").tolist() == ids and bytes(got[k].decoded) == (t or "").encode() and got[k].n_tokens == len(ids)
    assert len(bpe.cuts(texts[-3].encode(), path)) > 40 and bpe.cuts(b"x" * 400, path) == []
    got = {r.doc_id: bytes(r.decoded) for r in bpe.encode_and_decode(df, path, 100, memory=50).collect()}
    assert got == {k: (t or "").encode() for k, t in enumerate(texts)}
    for w in (b"hello world" * 40, b"x" * 999):
        assert bpe.merge_long(w, ranks) == tiktoken.Encoding("one", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary(w.decode())
    assert bpe.encode_and_decode(df.limit(0), path).count() == 0


def test_bpe_reads_shared_words_in_place():
    import tracemalloc
    from types import SimpleNamespace

    path, many = P.path("byte_bpe_multi_50k.tiktoken"), 1_000_000
    shared = np.full(many, 3, np.uint8), np.arange(0, 3 * many, 3, dtype=np.uint32), (np.arange(3 * many) % 50_000).astype(np.uint16)
    numbers, words = np.array([many, 1, many - 1, many + 1], np.int32), [[7], [8, 9]]

    def row(ids, base, words):
        parts = [pa.array([ids], pa.list_(pa.int64())), pa.array([np.array([0, 3, 4]).tobytes()]), pa.array([numbers.tobytes()]), pa.array([base], pa.int64()), pa.array([words], pa.list_(pa.list_(pa.int32()))), pa.array([[]], pa.list_(pa.binary()))]
        return pa.record_batch(parts, ["ids", "offs", "numbers", "base", "words", "long"])

    rows = [row([1, 2], many, words), row([3, 4], many + 2, []), row([5, 6], many, words[::-1])]  # the last one's task numbers anew
    bpe._tokens(path)
    tracemalloc.start()
    out = [np.frombuffer(x.as_py(), "<u4").tolist() for b in bpe._assemble(path, SimpleNamespace(value=shared))(iter(rows)) for x in b.column(2)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    last = [(3 * many - k) % 50_000 for k in (3, 2, 1)]
    assert out == [[7, 3, 4, 5, *last], [8, 9]] * 2 + [[8, 9, 3, 4, 5, *last], [7]]
    assert peak < 2e6  # a copy of the shared words takes over 20 MB


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = [*odd_texts(), "a <|endoftext|> b", " ".join(thue_morse(1024))]
    df = spark.createDataFrame([(1000 - k, t) for k, t in enumerate(texts)] + [(None, "null id")], "doc_id long, text string").repartition(3).withColumns({"file": F.lit("mine"), "row": F.lit("mine")})
    path = f"file://{tmp_path}/out"
    token_files.write_token_files(df, P.path("byte_bpe_50k.json"), path, block_tokens=64, file_blocks=5)  # many blocks, and several files of a task
    got = token_files.digests(token_files.read_token_files(spark, path)).collect()
    assert len({r.file for r in token_files.read_token_files(spark, path).select("file").collect()}) > 3
    token_files.write_token_files(df.limit(0), P.path("byte_bpe_50k.json"), path + "-empty")
    assert token_files.digests(token_files.read_token_files(spark, path + "-empty")).count() == 0
    start = 0
    rows = sorted(((1000 - k, t) for k, t in enumerate(texts)), key=lambda x: x[0])
    by = {r.doc_id: r for r in got}
    assert len(got) == len(texts) + 1
    for i, t in [(None, "null id"), *rows]:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (by[i].start, by[i].n_tokens, by[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_blocks():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 70000, 70001), np.arange(70000)]).astype(np.uint32)
    block = token_files.encode_block(np.array([5, 7]), np.array([70001, 70000]), ids)
    ((docs, counts, back),) = token_files.decode_blocks(block + b"\n")
    assert docs.tolist() == [5, 7] and counts.tolist() == [70001, 70000] and np.array_equal(back, ids)
    with pytest.raises(ValueError):
        next(token_files.decode_blocks(b"x" * 64))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_automaton():
    terms = ["cat", "idiot", "moron", "worthless", "disgusting"]
    automaton = toxicity.Automaton(terms)
    rng = np.random.default_rng(1)
    words = terms + ["idot", "idiott", "xdiot", "wrthles", "worthlessss", "disgustin", "moronic", "cats"]
    words += ["".join(rng.choice(list("idotmrnwse"), int(rng.integers(1, 12)))) for _ in range(3000)]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    hits, term, cost = automaton.run(points, ends - [len(w) for w in words], ends)
    wanted = {}
    for k, w in enumerate(words):
        best = min(((edit_distance(w, t), j) for j, t in enumerate(terms) if edit_distance(w, t) <= toxicity.edits(t)), default=None)
        if best:
            wanted[k] = best
    assert {int(h): (int(c), int(t)) for h, t, c in zip(hits, term, cost, strict=True)} == wanted


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    rows, labels = [(9000, None), (9001, ""), (9002, " . ")], [(9001, None), (9002, 7)]
    for k in range(600):
        w = list(rng.choice(WORDS, 40))
        if k % 5 == 0:
            w[10], w[20] = "grubble", "snotface."
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), crc_mod(F.col("doc_id"), 5) != 0)
    assert set(model.terms) == {"grubble", "snotface"}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 5 == 0) for k in held]) > 0.97 and len(got) == 603 and got[9000] < 0.5
    odd = spark.createDataFrame([(1, "he is a grubbel snotfac here")], "doc_id long, text string")
    assert toxicity.score(odd, model).first().n_hits == 1
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))).collect()} == {0.0}


def brute_features(text, model):
    """The features of one text, word by word and term by term."""
    white, one_lower = " \t\n\x0b\f\r", lambda c: y if len(y := c.lower()) == 1 else c
    spans = [m.span() for m in regex.finditer(f"[^{white}]+", text or "")]
    words = []
    for a, b in spans:
        inner = [k for k in range(a, b) if text[k].isalnum()]
        a, b = (inner[0], inner[-1] + 1) if inner else (a, a)
        words.append((a, b, "".join(map(one_lower, text[a:b]))))

    def bucket(word):
        raw = np.frombuffer(word.encode("utf-32-le"), np.uint8)
        return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) % toxicity.BUCKETS if word else 0

    hits = []
    for k, (a, b, word) in enumerate(words):
        best = min(((d, j) for j, t in enumerate(model.terms) if abs(len(t) - len(word)) < 3 and (d := edit_distance(word, t)) <= toxicity.edits(t)), default=None)
        if best and word:
            lo, hi = max(0, k - toxicity.WINDOW), min(len(words), k + toxicity.WINDOW + 1)
            near = [model.context[bucket(words[x][2])] for x in range(lo, hi) if x != k]
            before, after = text[spans[lo][0] : a], text[b : spans[hi - 1][1]]
            quoted = any(q in before for q in toxicity._QUOTES) and any(q in after for q in toxicity._QUOTES)
            hits.append((model.weights[best[1], best[0]], np.mean(near) if near else 0.0, quoted))
    if not hits:
        return [1.0] + [0.0] * 6, 0
    positive = sum(max(w, 0) for w, _, _ in hits)
    plain = min(20, sum(w for w, _, q in hits if not q))
    return [1.0, max(w for w, _, _ in hits), plain, math.log1p(positive), math.log1p(100 * positive / len(words)), np.mean([c for _, c, _ in hits]), np.mean([q for *_, q in hits])], len(hits)


def test_toxicity_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    terms = ("cat", "grubble", "snotface", "worthless")
    model = toxicity.Model(terms, rng.normal(size=(4, 3)), rng.normal(size=toxicity.BUCKETS), rng.normal(size=7))
    pool = ["cat", "cats", "grubble", "Grubbel,", "gruble", '"snotface', "snotface\"", "SNOTFACES!", "wortless", "worthlss.", "«he", "said»", "--", "é", "中文", "İx", "the", "a", "\n", "of"]
    texts = [None, "", " . ", "cat", *(" ".join(rng.choice(pool, int(rng.integers(1, 60)))) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    for k, t in enumerate(texts):
        features, n = brute_features(t, model)
        assert got[k].n_hits == n and got[k].score == pytest.approx(1 / (1 + math.exp(-float(np.dot(features, model.coefficients)))), abs=1e-9)
    assert toxicity.score(df.limit(0), model).count() == 0
    monkeypatch.setattr(toxicity, "MAX_CELLS", 10)  # an automaton that starts anew with each chunk gives the same
    toxicity._automaton.cache_clear()
    again = [x for hits in toxicity.find_hits(pa.array(texts, pa.string()), terms) for x in model.score(hits)]
    assert again == pytest.approx([got[k].score for k in range(len(texts))])


def test_lexicon_has_no_greatest_size(spark):
    """Three hundred significant words are all in the lexicon."""
    own = [f"zq{chr(97 + k % 26)}{chr(97 + k // 26)}word" for k in range(300)]
    rows = [(k, " ".join(own) if k % 2 else "plain words only here") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    assert set(toxicity.train(docs, labels, F.lit(True)).terms) == set(own)


def test_language_model(spark):
    rows = documents(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("training", F.lit("mine"))
    got = lm_score.score(df, crc_mod(F.col("doc_id"), 7) != 2).collect()
    tokens = [(i, [*lower(t).split(), "\n"]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    wanted = sorted((i, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 8)) for i, ws in tokens)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in got) == wanted
    assert all(r.score <= 0 for r in got)
    assert lm_score.score(df.limit(0), F.lit(True)).count() == 0


def test_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 20000).astype(np.uint64))
    counts = rng.geometric(0.3, len(keys)).astype(np.uint64)
    sieve = lm_score.Filter({3: lm_score.Filter.block(keys, counts, 6)}, 6)
    pairs = (np.uint64(3) << np.uint64(58)) | (keys << np.uint64(18))
    got = sieve.count(pairs)
    least = np.ceil(lm_score.BASE ** (lm_score.levels(counts) - 1) - 1e-9)
    assert (got >= least).all() and (got == least).mean() > 0.95
    absent = (np.uint64(3) << np.uint64(58)) | (rng.integers(0, 1 << 40, 20000).astype(np.uint64) << np.uint64(18))
    assert (sieve.count(absent) > 0).mean() < 0.05


def test_filter_holds_every_pair():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 40, 30000).astype(np.uint64))
    sieve = lm_score.Filter({5: lm_score.Filter.block(keys, np.ones(len(keys), np.uint64), 14)}, 14)
    assert (sieve.count((np.uint64(5) << np.uint64(50)) | (keys << np.uint64(10))) >= 1).all()


def test_filter_levels_follow_the_counts():
    keys = np.arange(4, dtype=np.uint64)
    counts = np.array([1, 199_600, 12_000_000, 1 << 40], np.uint64)
    got = lm_score.Filter({0: lm_score.Filter.block(keys, counts, 6)}, 6).count(keys << np.uint64(18))
    assert (got <= counts).all() and (got * lm_score.BASE > counts).all()


def test_language_model_pairs(spark):
    rows = documents(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm_score.score(df, crc_mod(F.col("doc_id"), 7) != 2).collect()}
    tokens = [(i, [*lower(t).split(), "\n"]) for i, t in rows]
    training = [ws for i, ws in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for ws in training for w in ws)
    pairs = Counter(p for ws in training for p in zip(["\n", *ws], ws))
    n, v, mu = sum(counts.values()), len(counts), lm_score.MU

    def model(a, b):
        c = pairs[a, b] and lm_score.BASE ** math.floor(math.log(pairs[a, b], lm_score.BASE) + 1e-9)
        return (min(math.ceil(c - 1e-9), counts[a], counts[b]) + mu * (counts[b] + 1) / (n + v + 1)) / (counts[a] + mu)

    wanted = {i: sum(math.log10(model(a, b)) for a, b in zip(["\n", *ws], ws)) for i, ws in tokens}
    assert got == pytest.approx(wanted, abs=1e-6)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    long = "Some boilerplate line that many documents carry around with them"
    rng = np.random.default_rng(7)
    item = " ".join(rng.choice(WORDS, 30))
    say = lambda: " ".join(rng.choice(WORDS, 60))
    base = say()
    rows = [(k, f"{long}\n{say()}", "en", "s", 0) for k in range(8)]
    rows += [(20, base, "en", "s", 0), (21, base, "de", "s", 0), (22, base + " more", "de", "s", 0), (23, f"{say()} {item} {say()}", "en", "s", 0), (24, "123 !!", None, "s", 0), (25, None, "en", "s", 0), (26, long, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [*range(8), 20, 26] and got[20].text == base and long not in got[3].text and got[26].text == long
    assert hashlib.sha256(got[20].text.encode()).hexdigest() == hashlib.sha256(base.encode()).hexdigest()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("cosine", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
