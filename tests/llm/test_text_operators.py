"""Line dedup, decontamination, quality rules, language, chat windows: brute force and odd rows on small tables."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfare.llm import chat, decontaminate, language, line_dedup, quality
from wayfare.llm.common import chunks, crc_mod

LONG = "This common line is long enough to be a key of its own, surely"
ODD = [
    (1, f"a\n{LONG}\nb", "en", "h1"),
    (2, f"  {LONG.upper()}\t\nc", "en", "h1"),
    (3, f"{LONG}\n{LONG}", "en", "h1"),
    (4, LONG, "en", None),
    (5, f"x\n{LONG}", None, "h1"),
    (6, None, "en", "h2"),
    (7, "", None, "h2"),
    (8, "one two three four five six seven eight nine ten " * 3, "en", "h2"),
    (9, "żółć ü 中文   x", "de", "h2"),
    (9, "żółć ü 中文   x", "de", "h2"),
    (None, LONG, "en", "h3"),
    (10, "word " * 20000, "en", "h3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with columns whose names clash with what operators add."""
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns({"n_lines": F.lit("mine"), "score": F.lit("mine"), "host": F.lit("mine"), "n_chars": F.length("text").cast("long")})


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    count, last = Counter(), {}
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] += 1
            last[k] = max(last.get(k, -1), -1 if i is None else i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and count[key(x)] >= 5 and last[key(x)] >= 0 and last[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_line_dedup(docs, bound):
    got = line_dedup.drop_common_lines(docs, broadcast_keys=bound)
    assert got.columns.count("n_lines") == 1
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=repr) == brute_lines(ODD)
    assert line_dedup.drop_common_lines(docs.limit(0)).count() == 0


def test_line_counts_are_reversible(spark, docs):
    rows = lambda df: {tuple(r) for r in df.collect()}
    a, b = docs.where("doc_id <= 3"), docs.where("doc_id > 3 OR doc_id IS NULL")
    whole = line_dedup.insert(line_dedup.line_counts(a), b)
    assert rows(whole) == rows(line_dedup.line_counts(docs))
    assert rows(line_dedup.delete(whole, b, a)) == rows(line_dedup.line_counts(a))


def test_index_is_reversible(spark, docs, monkeypatch):
    """Inserting a batch and deleting it again leaves counts, filters and results as they were; each way agrees with brute force."""
    rows = lambda df: {tuple(r) for r in df.collect()}
    a, b = docs.where("doc_id <= 5"), docs.where("doc_id > 5 OR doc_id IS NULL")
    first = line_dedup.Index.of(a)
    whole = first.insert(b)
    back = whole.delete(b, a)
    assert rows(back.counts) == rows(first.counts)
    keys = [(r.hi, r.lo) for r in line_dedup.line_counts(docs).collect()]
    hi, lo = np.array(keys).T

    def passes(index):
        filters = {r.shard: bytes(r.filter) for r in index.filters.collect()}
        return line_dedup.ShardedFilter(index.shards, filters).contains(hi, lo)

    common = lambda index: {(r.hi, r.lo) for r in index.common().collect()}
    for index in (first, whole, back):
        assert {k for k, p in zip(keys, passes(index), strict=True) if p} >= common(index)
    assert (passes(back) == passes(first)).all()
    for bound in (0, 500_000):
        for index, df, odd in ((whole, docs, ODD), (back, a, [r for r in ODD if r[0] and r[0] <= 5])):
            got = line_dedup.drop_common_lines(df, broadcast_keys=bound, index=index)
            assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=repr) == brute_lines(odd)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    tight = line_dedup.Index.of(a, min_docs=1).insert(b)  # more keys than the filters have room for: built anew
    assert tight.shards > 1 and passes(tight)[[k in common(tight) for k in keys]].all()
    got = line_dedup.drop_common_lines(docs, min_docs=1, broadcast_keys=0, index=tight)
    assert sum(r.n_dropped for r in got.collect()) > 0


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    f = line_dedup.CuckooFilter(len(keys))
    for k in keys:
        f.insert(int(k))
    f.stash.append((3, 9))
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.stash.pop() == (3, 9)
    assert f.contains(keys).all()
    others = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 20000)
    assert f.contains(others).mean() < 0.01
    assert all(f.delete(int(k)) for k in keys) and not f.contains(keys).any()


def brute_leaks(rows, items):
    found = set()
    for i, text, *_ in rows:
        w = (text or "").split()
        for item, t in items:
            b = (t or "").split()
            n = min(16, len(b))
            if len(b) < 5:
                continue
            for shift in range(-len(b) + n, len(w) - n + 1):
                same = [0 <= shift + k < len(w) and w[shift + k].lower() == b[k].lower() for k in range(len(b))]
                inside = [0 <= shift + k < len(w) for k in range(len(b))]
                if any(all(inside[k : k + n]) and sum(same[k : k + n]) >= n - n // 5 for k in range(len(b) - n + 1)):
                    found.add((i, item))
    return found


def test_decontamination(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(40)]
    say = lambda n: [vocabulary[k] for k in rng.integers(0, 40, n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate([3, 5, 7, 9, 12, 15, 16, 20, 40, 60])] + [(90, None), (91, ""), (8, "again " + " ".join(say(20)))]
    rows = [(1, None), (2, ""), (3, " \n ")]
    for d in range(60):
        w = (items[d % 10][1]).split()
        for k in rng.choice(len(w), min(len(w), int(rng.integers(0, 2 + len(w) // 4))), replace=False):
            w[k] = "X"
        rows.append((10 + d, " ".join([*say(int(rng.integers(0, 30))), *w, *say(int(rng.integers(0, 30)))]).upper()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("item_id", F.lit(7))
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute_leaks(rows, items)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == wanted and len(wanted) > 20
    monkeypatch.setattr(decontaminate, "HITS", 3)  # a seed of many items, a few at a time
    index = decontaminate.Index(items)
    assert {(rows[r[0]][0], r[1]) for r in decontaminate._scan(index, pa.array([t for _, t in rows], pa.string()))} == wanted
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == wanted
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in wanted}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.drop_leaks(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("bound", [100_000, 0])
def test_quality(spark, docs, bound):
    rows = [r for r in ODD if r[0] is not None and r[0] != 9]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    duckdb.sql("SELECT 1")
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype(object).where(lambda x: x.notna(), None))
    wanted = sorted(con.execute(quality.OP2_SQL).fetchall())
    got = quality.judge(df, broadcast_hosts=bound).drop("host", "host_failed")
    assert sorted(tuple(r) for r in got.collect()) == wanted
    assert quality.judge(docs).count() == len(ODD) and quality.judge(docs.limit(0)).count() == 0


def brute_quality(rows):
    """(doc_id, host) to (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, kept), rule by rule."""
    import re
    import statistics

    white = "[ \\t\\n\\x0b\\f\\r]+"
    made, by = {}, {}
    for i, text, host in rows:
        host = m[1].lower() if host and (m := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", host)) else host
        w = [x for x in re.split(white, text or "") if x]
        lines = [x for x in (text or "").split("\n") if re.sub(white, "", x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
        n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or "")
        fails = (n < 10 or 100 * len(covered) > 20 * n, 10 * symbols > chars, 10 * (len(lines) - len(set(lines))) > 3 * len(lines), chars < 2 * n or chars > 12 * n)
        made[i] = (host, n, chars, symbols, len(lines) - len(set(lines)), len(covered), fails)
        by.setdefault(host, []).append(fails)
    bad = set()
    for k, limit in enumerate(quality.LIMITS.values()):
        rates = [sum(f[k] for f in fails) / len(fails) for fails in by.values()]
        m, v = statistics.mean(rates), statistics.variance(rates) if len(rates) > 1 else 0
        weight = min(1000, max(m * (1 - m) / v - 1, 0)) if v > 0 else 1000
        bad |= {h for h, fails in by.items() if (sum(f[k] for f in fails) + weight * m) / (len(fails) + weight) > limit}
    return {i: (*x[1:6], x[6][0], x[0] in bad, not x[6][0] and x[0] not in bad) for i, x in made.items()}, bad


@pytest.mark.parametrize("bound", [100_000, 0])
def test_quality_hosts(spark, bound):
    """A bad host takes its good documents with it; a host with one bad document is pulled back by the others."""
    rng = np.random.default_rng(4)
    good = lambda: " ".join(f"word{k}" for k in rng.integers(0, 10_000, 30))
    rows = [(h * 100 + k, good() if rng.random() < 0.95 else "short", f"good{h}.org") for h in range(8) for k in range(40)]
    rows += [(2000 + k, good() if k % 10 == 0 else "buy now " * 20, "HTTPS://user@Bad.example:8080/page?x#y") for k in range(50)]
    rows += [(3000 + k, good() if k == 0 else "$$$ ### " * 12 + good(), "https://symbols.example/") for k in range(60)]
    rows += [(4000, "short", "tiny.org"), (4001, good(), "tiny.org"), (4002, None, None), (4003, good(), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"host": F.lit("mine"), "_salt": F.lit("mine")})
    wanted, bad = brute_quality(rows)
    assert bad == {"bad.example", "symbols.example"} and wanted[2000][6:] == (True, False) and wanted[4001][7]
    got = {r.doc_id: tuple(r)[2:] for r in quality.judge(df, broadcast_hosts=bound).collect()}
    assert got == wanted
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype(object).where(lambda x: x.notna(), None))
    assert {r[0]: r[1:] for r in con.execute(quality.OP2_SQL).fetchall()} == {i: (*x[:6], x[7]) for i, x in wanted.items()}


def test_language(spark, docs):
    words = {"en": "the and of with that this from have".split(), "de": "und der die nicht ein mit auf für".split()}
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(words["en" if k % 2 else "de"], 30)), "en" if k % 2 else "de", "s") for k in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train(train, crc_mod(F.col("doc_id"), 3) != 1)
    got = {r.doc_id: r for r in language.identify(train, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.98
    odd = language.identify(docs, model)
    assert odd.columns.count("score") == 1
    by = {r.doc_id: r for r in odd.collect()}
    assert by[6].lang_pred == by[7].lang_pred == "und" and by[6].score == 0 and all(0 <= r.score <= 1 for r in by.values())
    assert {r.lang_pred for r in language.identify(docs, language.train(docs.limit(0), F.lit(True))).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0 and not vectors(["12 34 !?", None, ""]).any()
    assert np.allclose(*vectors(["AbC", "abc"]))


def vectors(texts):
    return np.concatenate([language.document_vectors(data, offs) for _, _, data, offs in chunks(pa.array(texts, pa.string()))])


def brute_vector(text):
    """Bind, bundle: trigram by trigram."""
    letters = language._letters()[0]
    kinds = [0]
    for c in (text or "").encode("utf-8", "surrogatepass").decode("utf-8", "surrogatepass") + " ":
        low = ord(c.lower()[0])
        kind = 0 if not c.isalpha() else low - 96 if 97 <= low <= 122 else 27 + low % (language.CLASSES - 27)
        if kind or kinds[-1]:
            kinds.append(kind)
    out = np.zeros(language.DIM)
    for a, b, c in zip(kinds, kinds[1:], kinds[2:]):
        out += letters[a].astype(float) * np.roll(letters[b], 1) * np.roll(letters[c], 2)
    return out


def test_language_vectors_and_cosines(spark, monkeypatch):
    rng = np.random.default_rng(9)
    letters = ["a", "b", "Ż", "中", "文", " ", "  ", "1", "\n", "😀", "é", "ß"]
    texts = [None, "", "a", " a", "1", "a1b", "中", *("".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(300))]
    wanted = np.stack([brute_vector(t) for t in texts])
    assert np.allclose(vectors(texts), wanted)
    monkeypatch.setattr(language, "STRETCH", 7)
    monkeypatch.setattr(language, "BLOCK", 3)
    assert np.allclose(vectors(texts), wanted)
    assert np.allclose(np.concatenate([vectors([t]) for t in texts]), wanted)  # each long text in stretches
    names, rows = ["x", "y", "z"], [(k, t, "xyz"[k % 3]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    prototypes = np.stack([unit(sum(unit(wanted[k]) for k in range(len(rows)) if k % 3 == j)) for j in range(3)])
    model = language.train(df, F.lit(True))
    assert model[0] == names and np.allclose(model[1], prototypes, atol=1e-6)
    for r in language.identify(df, model).collect():
        cosines = prototypes @ unit(wanted[r.doc_id])
        if not wanted[r.doc_id].any():
            assert (r.lang_pred, r.score, r.cosine) == ("und", 0.0, 0.0)
            continue
        weights = np.exp(language.SHARPNESS * (cosines - cosines.max()))
        assert r.cosine == pytest.approx(cosines.max(), abs=1e-6) and r.score == pytest.approx(1 / weights.sum(), abs=1e-5)
        assert cosines["xyz".index(r.lang_pred)] == pytest.approx(cosines.max(), abs=1e-6)


def test_every_language_has_a_prototype(spark, monkeypatch):
    rows = [(k, f"{'q' * (k % 90 + 1)} w", f"l{k % 90}") for k in range(900)] + [(1000, "only one of its kind", "rare")] + [(2000 + k, "the most of all", "hot") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string"))
    assert len(language.train(df, F.lit(True), most=20)[0]) == 92
    monkeypatch.setattr(language, "MOST_LANGUAGES", 50)
    with pytest.raises(ValueError):
        language.train(df, F.lit(True))


def test_chat(spark):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = [(c, t, "system" if t == 0 and c % 2 else "user" if t % 2 else "assistant", f"<|im_start|> turn {t} <\\| " + "w " * (t * 37 % 300)) for c in range(6) for t in range(25)]
    rows += [(7, 0, None, None), (7, 1, "assistant", ""), (7, 1, "assistant", ""), (None, 0, "assistant", "<|im_end|>\n"), (8, 0, "a\nb\\<|", "x" * 5000)]
    rows += [(9, t, "system" if t == 0 else "assistant", "s " * 300 if t == 0 else f"short {t}") for t in range(200)]
    rows += [(10, t, "user", "中文沒有空格的長句子可以很長很長") for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("mine"))
    windows = chat.format_windows(df, path, budget=256, history=64).cache()
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        said = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(made) > 3 and all(chat.parse(w.text)[0][0] == "system" for w in made)
    assert all(w.n_tokens <= 256 or w.last_turn == w.first_turn for w in made) and all(w.n_repeated >= 1 for w in made[1:])
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for w in made:
        parts = [p.removesuffix(chat.END).partition("\n") for p in w.text.split(chat.START)[1:]]
        assert w.n_tokens == sum(count(role) + count(text) + chat.OVERHEAD for role, _, text in parts)
    # a system turn over half the budget doesn't fill every window, and texts without spaces have their tokens
    long = windows.where("conv_id = 9").orderBy("window").collect()
    assert len(long) < 20 and sum(len(w.text) for w in long) < 20_000 and all(w.n_tokens <= 256 for w in long[1:])
    assert windows.where("conv_id = 10").count() > 3
    assert chat.format_windows(df.limit(0), path).count() == 0
