"""Plans over the text rules and the geometry of symbols: each row of a table makes a case."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import texts as T
from ..functions import urls as U
from ..operators.compare import compare
from .registry import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")


_KERNEL = "CASE event_id % 6 WHEN 0 THEN 'simd' WHEN 1 THEN 'relaxed' WHEN 2 THEN 'threads:' || event_id % 4 WHEN 3 THEN 'scalar' WHEN 4 THEN 'threads:x' ELSE 'vnni' END"


@query(
    "kernel_texts",
    f"""SELECT event_id, kernel, CASE WHEN w > 0 THEN kernel || ' — SIMD128 + relaxed SIMD + ' || w || CASE WHEN w = 1 THEN ' worker' ELSE ' workers' END || ' on shared memory' WHEN w = 0 OR kernel = 'relaxed' THEN kernel || ' — SIMD128 + relaxed SIMD'
 WHEN kernel = 'simd' THEN 'simd — SIMD128' WHEN kernel = 'scalar' THEN 'scalar — no SIMD (scalar fallback)' ELSE kernel END AS summary,
 CASE WHEN w > 0 THEN kernel || ' — relaxed SIMD, ' || w || CASE WHEN w = 1 THEN ' worker' ELSE ' workers' END WHEN w = 0 OR kernel = 'relaxed' THEN kernel || ' — relaxed SIMD' WHEN kernel = 'scalar' THEN 'scalar — no SIMD (scalar fallback)' ELSE kernel END AS short
 FROM (SELECT event_id, kernel, try_cast(regexp_extract(kernel, '^threads:([0-9]+)$', 1) AS BIGINT) AS w FROM (SELECT event_id, {_KERNEL} AS kernel FROM events))""",
)
def kernel_texts(spark, sf_dir):
    k, e = F.col("event_id"), F.col("event_id") % 6
    kernel = F.when(e == 0, "simd").when(e == 1, "relaxed").when(e == 2, F.concat(F.lit("threads:"), (k % 4).cast("string"))).when(e == 3, "scalar").when(e == 4, "threads:x").otherwise("vnni")
    rows = _events(spark, sf_dir).select("event_id", kernel.alias("kernel"))
    return rows.select("event_id", "kernel", T.kernel_summary("kernel").alias("summary"), T.kernel_short("kernel").alias("short"))


@query(
    "tier_choice",
    "SELECT event_id, w::INT AS workers, CASE WHEN w > 0 THEN 'threads' WHEN event_id % 5 < 2 THEN 'relaxed' ELSE 'simd' END AS tier, least(ceil((m + 18874368 + 4 * 1114112) / 65536), 16384)::BIGINT AS pages FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN greatest(0, least(event_id % 9 - 1, 4)) ELSE 0 END AS w, event_id * 40961 AS m FROM events)",
)
def tier_choice(spark, sf_dir):
    """Workers by cores, the build that the device can run, and the memory that a model of some size needs."""
    k = F.col("event_id")
    rows = _events(spark, sf_dir).select("event_id", T.worker_count(k % 3 == 0, (k % 9).cast("int")).cast("int").alias("workers"), (k * 40961).alias("m"))
    return rows.select("event_id", "workers", T.picked_tier(F.col("workers"), k % 5 < 2).alias("tier"), T.memory_pages("m").alias("pages"))


@query(
    "fault_actions",
    "SELECT event_id, CASE WHEN NOT ok AND poisoned THEN 'recover' WHEN NOT ok AND event_id % 4 < 2 THEN 'replay' ELSE 'return' END AS action, coalesce(value < 3, false) OR event_id % 11 = 0 AS fault FROM (SELECT event_id, value, event_type <> 'error' AND event_id % 3 <> 0 AS ok, event_id % 7 < 2 AS poisoned FROM events)",
)
def fault_actions(spark, sf_dir):
    """What to do with a reply, and whether a report shows a fault; a report may lack either field."""
    k = F.col("event_id")
    ok = (F.col("event_type") != "error") & (k % 3 != 0)
    code = F.when(k % 7 < 2, "instance_poisoned").when(k % 7 == 3, "other")
    fault = T.info_fault(F.when(F.col("value") < 3, F.lit(True)), F.lit(None).cast("boolean"), F.when(k % 11 == 0, F.lit(2)).when(k % 5 == 0, F.lit(0)))
    return _events(spark, sf_dir).select("event_id", T.fault_action(ok, code, k % 4 < 2).alias("action"), fault.alias("fault"))


@query("load_codes", "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 6 WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 3 WHEN event_id % 2 = 0 THEN 5 WHEN event_id % 9 > event_id % 4 AND event_id % 9 > 0 THEN 4 ELSE 0 END AS code FROM events")
def load_codes(spark, sf_dir):
    """The first failing check of a load."""
    k = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", T.load_code(k % 13 == 0, k % 7 != 0, k % 5 != 0, k % 3 != 0, k % 2 != 0, k % 9, k % 4).alias("code"))


_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) || CASE page_id % 5 WHEN 0 THEN '.html' WHEN 1 THEN '.bin' WHEN 2 THEN '/assets/a.js' ELSE '' END"


@query(
    "path_rules",
    f"""SELECT page_id, ends_with(path, '.bin') AS model_asset, page_id % 4 <> 0 AND path <> '/sw.js' AND NOT ends_with(path, '.bin') AND (regexp_matches(path, '[.]html$') OR regexp_matches(path, '^/assets/[^/]+[.](js|css|svg)$')) AS shell,
 'model.' || left(sha256(url), 8) || '.c' || 65536 || '.' || CASE WHEN page_id < 10 THEN '0' ELSE '' END || page_id || '.bin' AS chunk FROM (SELECT page_id, url, CASE WHEN page_id % 5 = 2 THEN '/assets/a' || page_id || '.js' WHEN page_id % 5 = 3 THEN '/sw.js' ELSE {_PATH} END AS path FROM pages)""",
)
def path_rules(spark, sf_dir):
    """Which paths are model files and which belong to the shell; names of chunks."""
    k = F.col("page_id")
    path = F.concat(F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1), F.when(k % 5 == 0, ".html").when(k % 5 == 1, ".bin").otherwise(""))
    path = F.when(k % 5 == 2, F.concat(F.lit("/assets/a"), k.cast("string"), F.lit(".js"))).when(k % 5 == 3, "/sw.js").otherwise(path)
    rows = table(spark, sf_dir, "pages").select("page_id", "url", path.alias("path"))
    return rows.select("page_id", T.is_model_asset("path").alias("model_asset"), ((k % 4 != 0) & T.is_shell_path("path")).alias("shell"), T.chunk_name(F.sha2("url", 256), F.lit(65536), "page_id").alias("chunk"))


@query("cache_names", "SELECT page_id, regexp_matches(name, '^wayfare-[0-9a-f]{8}$') AS model, regexp_matches(name, '^wayfare-shell-[0-9a-f]{8}$') AS shell, regexp_matches(name, '^wayfare-[0-9a-f]{8}$') AND page_id <> 3 AS stale FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'wayfare-' || left(md5(url), 8) WHEN 1 THEN 'wayfare-shell-' || left(md5(url), 8) ELSE 'wayfare-' || left(md5(url), 9) END AS name FROM pages)")
def cache_names(spark, sf_dir):
    """Whose caches are whose; a model's cache is stale unless it is the current one (page 3's)."""
    k, h = F.col("page_id"), F.md5(F.col("url").cast("binary"))
    name = F.when(k % 3 == 0, F.concat(F.lit("wayfare-"), F.left(h, F.lit(8)))).when(k % 3 == 1, F.concat(F.lit("wayfare-shell-"), F.left(h, F.lit(8)))).otherwise(F.concat(F.lit("wayfare-"), F.left(h, F.lit(9))))
    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    current = F.when(k == 3, F.col("name")).otherwise(F.lit("wayfare-00000000"))
    return rows.select("page_id", T.is_model_cache("name").alias("model"), T.is_shell_cache("name").alias("shell"), T.is_stale_model_cache("name", current).alias("stale"))


_FILES = "SELECT CASE event_id % 7 WHEN 0 THEN 'sw.js' WHEN 1 THEN 'p' || event_id % 40 || '.html' WHEN 2 THEN 'assets/x' || event_id % 90 || '.css' WHEN 3 THEN 'assets/deep/x.js' WHEN 4 THEN 'm' || event_id % 9 || '.bin' WHEN 5 THEN 'assets.json' ELSE 'a/b' || event_id % 30 || '.html' END AS path FROM events"


@query("shell_files", f"SELECT DISTINCT '/' || path AS path FROM ({_FILES}) WHERE path <> 'sw.js' AND NOT ends_with(path, '.bin') AND (ends_with(path, '.html') OR regexp_matches(path, '^assets/[^/]+[.](js|css|svg)$') OR path = 'assets.json')")
def shell_files(spark, sf_dir):
    k = F.col("event_id")
    n = lambda m: (k % m).cast("string")
    path = (
        F.when(k % 7 == 0, "sw.js").when(k % 7 == 1, F.concat(F.lit("p"), n(40), F.lit(".html"))).when(k % 7 == 2, F.concat(F.lit("assets/x"), n(90), F.lit(".css"))).when(k % 7 == 3, "assets/deep/x.js")
        .when(k % 7 == 4, F.concat(F.lit("m"), n(9), F.lit(".bin"))).when(k % 7 == 5, "assets.json").otherwise(F.concat(F.lit("a/b"), n(30), F.lit(".html")))
    )
    return T.shell_files(_events(spark, sf_dir).select(path.alias("path")))


#: A site's pages: id, path, menu text, name, tagline, whether unlisted, order.
PAGES = [("home", "/", "home", "short links", None, False, 0), ("inside", "/inside.html", "inside", "a look inside", "weights and predictions", False, 1), ("test", "/test.html", "test", None, None, True, 2), ("speed", "/speed.html", "speed", "speed", "timings of this device", False, 3)]
_PAGES = "site(id, href, nav, suffix, tagline, unlisted, ord) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, (bool, int)) else f"'{x}'" for x in p) + ")" for p in PAGES) + ")"


def _site(spark):
    return spark.createDataFrame(PAGES, "id string, href string, nav string, suffix string, tagline string, unlisted boolean, ord int")


@query("page_titles", f"WITH {_PAGES} SELECT id, 'wayfare' || coalesce(' · ' || suffix, '') || coalesce(' — ' || tagline, '') AS title, coalesce(tagline, suffix, 'wayfare') AS description FROM site")
def page_titles(spark, sf_dir):
    return _site(spark).select("id", T.page_title(F.lit("wayfare"), "suffix", "tagline").alias("title"), T.page_description(F.lit("wayfare"), "suffix", "tagline").alias("description"))


@query("page_menus", f"WITH {_PAGES} SELECT a.id AS here, b.href, b.nav AS label, a.id = b.id AS current, b.ord FROM site a, site b WHERE NOT a.unlisted AND NOT b.unlisted")
def page_menus(spark, sf_dir):
    return T.page_menu(_site(spark))


_SAYS = "CASE event_id % 4 WHEN 0 THEN '{\"type\":\"GO\"}' WHEN 1 THEN '{\"type\":1}' WHEN 2 THEN 'null' ELSE '{\"kind\":\"GO\"}' END"


@query("messages", f"SELECT event_id, coalesce(json_extract_string({_SAYS}, '$.type') = 'GO', false) AS go, CASE WHEN event_id % 2 = 0 THEN 'file ' || event_id ELSE 'kept' END AS source FROM events")
def messages(spark, sf_dir):
    """Messages of one shape, and sources without the owner before them."""
    k = F.col("event_id")
    text = F.when(k % 4 == 0, '{"type":"GO"}').when(k % 4 == 1, '{"type":1}').when(k % 4 == 2, "null").otherwise('{"kind":"GO"}')
    source = F.when(k % 2 == 0, F.concat(F.lit("file "), k.cast("string"))).otherwise(F.concat(F.lit("a-b/c."), k.cast("string"), F.lit("  kept")))
    return _events(spark, sf_dir).select("event_id", T.is_message(text, "GO").alias("go"), T.eval_source(source).alias("source"))


@query("status_lines", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'it broke' ELSE 'failed to load: it broke' END WHEN event_id % 5 = 1 THEN 'ready · ' || event_type WHEN event_id % 5 = 2 THEN 'a · b' WHEN event_id % 5 = 3 THEN 'waiting' ELSE 'loading model…' END AS line FROM events")
def status_lines(spark, sf_dir):
    k = F.col("event_id")
    case = lambda n, x: F.when(k % 5 == n, x)
    line = T.status_line(case(0, F.lit("it broke")), k % 2 == 0, case(1, F.array(F.lit("ready"), F.col("event_type"))), case(2, F.array(F.lit("a"), F.lit("b"))), case(3, F.lit("waiting")))
    return _events(spark, sf_dir).select("event_id", line.alias("line"))


@query("short_links", "SELECT event_id, st < 300 AND good AS ok, CASE WHEN st < 300 AND good THEN 'ab' || event_id END AS slug, CASE WHEN st = 429 THEN 'too many short links from your address; try again in ' || CASE WHEN event_id % 8 = 2 THEN '10 minutes' ELSE '30 seconds' END WHEN st >= 300 THEN 'the service answered ' || st WHEN NOT good THEN 'unexpected answer' END AS error FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 429 ELSE 500 END AS st, event_id % 3 <> 0 AS good FROM events)")
def short_links(spark, sf_dir):
    """Answers of a short-link service as records."""
    k = F.col("event_id")
    status = F.when(k % 4 == 0, 200).when(k % 4 == 1, 201).when(k % 4 == 2, 429).otherwise(500)
    answer = T.short_link(status, F.when(k % 8 == 2, "soon").otherwise("30"), k % 3 != 0, F.concat(F.lit("AB"), k.cast("string")), F.lit("https://s.example/x"), F.lit(""), "https://s.example/")
    return _events(spark, sf_dir).select("event_id", answer.alias("a")).select("event_id", "a.ok", "a.slug", "a.error")


@query("bounded_fields", "SELECT event_id, CASE WHEN v BETWEEN 1 AND 20 AND v = floor(v) THEN v END AS whole, CASE WHEN v BETWEEN 1 AND 20 THEN v END AS any FROM (SELECT event_id, try_cast(CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN '' || event_id % 30 WHEN 3 THEN (event_id % 30) || '.5' ELSE '-3' END AS DOUBLE) AS v FROM events)")
def bounded_fields(spark, sf_dir):
    k = F.col("event_id")
    n = (k % 30).cast("string")
    text = F.when(k % 5 == 0, "").when(k % 5 == 1, "x").when(k % 5 == 2, n).when(k % 5 == 3, F.concat(n, F.lit(".5"))).otherwise("-3")
    return _events(spark, sf_dir).select("event_id", T.bounded_value(text, 1, 20).alias("whole"), T.bounded_value(text, 1, 20, integer=False).alias("any"))


@query("required_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def required_fields(spark, sf_dir):
    """A field that must be there; a row without it would raise an error that names its path."""
    return table(spark, sf_dir, "events").select("event_id", T.required("props", "k").alias("k"))


@query("caption_lines", "SELECT event_id, left(w, 11) || '|' || substr(w, 12, 11) || '|' || substr(w, 23) || CASE WHEN length(substr(w, 23)) + 4 <= 11 THEN ' end' ELSE '|end' END AS lines FROM (SELECT event_id, 'a' || repeat('b', 24 + CAST(event_id % 8 AS INT)) AS w FROM events)")
def caption_lines(spark, sf_dir):
    """A long word broken over lines of eleven characters, and a short one after it."""
    text = F.concat(F.lit("a"), F.repeat(F.lit("b"), (24 + F.col("event_id") % 8).cast("int")), F.lit("  end"))
    return _events(spark, sf_dir).select("event_id", F.array_join(T.wrap_caption(text, F.lit(12.2), F.lit(2.0)), "|").alias("lines"))


@query("kept_shares", "SELECT event_id, CASE WHEN p >= 99.5 THEN '~100%' WHEN p >= 10 THEN printf('%.0f%%', p) ELSE printf('%.1f%%', p) END || ' kept' AS kept FROM (SELECT event_id, (event_id % 997 + 1) / 997 * 100 AS p FROM events)")
def kept_shares(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", T.kept_share(F.lit(0.0), (F.col("event_id") % 997 + 1) / 997).alias("kept"))


@query("pieces_up_to", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'host' || event_id END AS host, CASE WHEN event_id % 4 <> 0 THEN '/p' END AS path, CASE WHEN event_id % 4 <> 0 THEN 'q' END AS next FROM events")
def pieces_up_to(spark, sf_dir):
    k = F.col("event_id")
    lits = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    pieces = F.when(k % 4 == 0, lits("https://", "a", "b")).otherwise(lits("https://", "host", k.cast("string"), "/", "p", "q", "000"))
    return _events(spark, sf_dir).select("event_id", T.pieces_up_to(pieces, F.lit("000")).alias("x")).select("event_id", "x.host", "x.path", "x.next")


@query("scaled_totals", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN t ELSE t / 4 * 4.0 END AS total FROM (SELECT event_id, (event_id + 1) * 1000.0::DOUBLE AS t FROM events)")
def scaled_totals(spark, sf_dir):
    """Totals of a quarter brought to the whole, and such as are whole already."""
    whole = (F.col("event_id") + 1) * 1000.0
    return _events(spark, sf_dir).select("event_id", T.scaled(F.when(F.col("event_id") % 2 == 0, whole).otherwise(whole / 4), whole, 4.0).alias("total"))


@query("function_patterns", "SELECT count(*) FILTER (WHERE finder) AS finders, count(*) FILTER (WHERE timing AND NOT finder) AS timing, count(*) AS cells FROM (SELECT (r < 7 AND c < 7) OR (r < 7 AND c >= 38) OR (r >= 38 AND c < 7) AS finder, (r = 6 AND c BETWEEN 8 AND 36) OR (c = 6 AND r BETWEEN 8 AND 36) AS timing FROM range(45) a(r), range(45) b(c))")
def function_patterns(spark, sf_dir):
    cells = spark.range(45 * 45).select((F.col("id") / 45).cast("int").alias("r"), (F.col("id") % 45).cast("int").alias("c"))
    finder, timing = G.in_finder(45, "r", "c"), G.in_timing(45, "r", "c")
    return cells.agg(F.count_if(finder).alias("finders"), F.count_if(timing & ~finder).alias("timing"), F.count(F.lit(1)).alias("cells"))


@query("colour_mixes", "SELECT event_id, '#' || printf('%02x%02x%02x', CAST(floor(18 * (1 - t) + 254 * t + 0.5) AS INT), CAST(floor(52 * (1 - t) + 220 * t + 0.5) AS INT), CAST(floor(86 * (1 - t) + 0.5) AS INT)) AS colour FROM (SELECT event_id, (event_id % 101) / 100 AS t FROM events)")
def colour_mixes(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", G.mix(F.lit("#123456"), F.lit("#fedc00"), (F.col("event_id") % 101) / 100).alias("colour"))


@query("gradient_lines", "SELECT event_id, round(cx - cos(a) * h, 6) AS x1, round(cy - sin(a) * h, 6) AS y1, round(cx + cos(a) * h, 6) AS x2, round(cy + sin(a) * h, 6) AS y2 FROM (SELECT event_id, radians(event_id % 360) AS a, 2 + 30 / 2 AS cx, 3 + 20 / 2 AS cy, (abs(30 * cos(radians(event_id % 360))) + abs(20 * sin(radians(event_id % 360)))) / 2 AS h FROM events)")
def gradient_lines(spark, sf_dir):
    line = G.gradient_line(F.col("event_id") % 360, F.lit(2), F.lit(3), F.lit(30), F.lit(20))
    rows = _events(spark, sf_dir).select("event_id", line.alias("l"))
    return rows.select("event_id", *(F.round(F.get("l", F.lit(k)), 6).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))


@query(
    "plate_boxes",
    "SELECT event_id, CASE WHEN w * (f * 1.3 + 0.6) <= 0.05 * s * s THEN round((s - w) / 2, 6) END AS label_x, CAST(greatest(3, g - CASE WHEN g % 2 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS logo, round(greatest(1, least(0.3::DOUBLE, sqrt(0.07::DOUBLE)) * s + 4), 6) AS image, CAST(ceil(((s + 8) * sqrt(2) - (s + 8)) / 2) AS BIGINT) AS padding FROM (SELECT event_id, s, greatest(1.8, s / 14) AS f, (event_id % 12) * greatest(1.8, s / 14) * 0.62 + 1 AS w, CAST(floor(sqrt(0.05::DOUBLE) * s) AS BIGINT) AS g FROM (SELECT event_id, CAST(21 + 4 * (event_id % 40) AS DOUBLE) AS s FROM events))",
)
def plate_boxes(spark, sf_dir):
    k, s = F.col("event_id"), (21 + 4 * (F.col("event_id") % 40)).cast("double")
    image = G.image_plate(s, G.image_size(F.lit(0.3), F.lit(0.07)), F.lit(2))
    return _events(spark, sf_dir).select("event_id", F.round(G.label_plate(s, k % 12)["x"], 6).alias("label_x"), G.logo_plate(s)["w"].alias("logo"), F.round(image["w"], 6).alias("image"), G.circle_padding(s, F.lit(4)).alias("padding"))


@query("cell_hashes", "SELECT event_id, (xor(h, h >> 15)) / 4294967296 AS x FROM (SELECT event_id, (xor(g, g >> 13) * 1540483477) % 4294967296 AS h FROM (SELECT event_id, xor(xor((event_id % 177) * 73856093, (event_id % 91) * 19349663), (event_id % 50) * 83492791) % 4294967296 AS g FROM events))")
def cell_hashes(spark, sf_dir):
    k = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", G.cell_hash(k % 177, k % 91, k % 50).alias("x"))


@query("dark_seeds", "SELECT vec_id, seed FROM (SELECT vec_id, list_reduce(list_prepend(0::HUGEINT, list_transform(list_filter(list_zip(embedding, range(0, 64)), lambda z: z[1] > 0), lambda z: z[2]::HUGEINT)), lambda k, i: ((k * 31 + i + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::BIGINT AS seed FROM embeddings)")
def dark_seeds(spark, sf_dir):
    """A seed of 32 bits from the dark cells of a symbol, here the positive places of a vector."""
    cells = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return table(spark, sf_dir, "embeddings").select("vec_id", G.dark_seed(cells).alias("seed"))


@query("gradient_stops", "SELECT event_id, round(1 - t, 3) AS first, round((0.5 + 1.0) / 2, 3)::DOUBLE AS added, 4 AS n FROM (SELECT event_id, (event_id % 100) / 100 AS t FROM events)")
def gradient_stops(spark, sf_dir):
    """Stops run the other way, and one more between the last two."""
    stops = lambda last: F.array(*(F.struct(o.alias("offset"), F.lit("#000000").alias("color")) for o in (F.lit(0.0), F.lit(0.5), last)))
    rows = _events(spark, sf_dir).select("event_id", G.reversed_stops(stops((F.col("event_id") % 100) / 100)).alias("r"), G.with_stop(stops(F.lit(1.0))).alias("w"))
    return rows.select("event_id", F.get("r", F.lit(0))["offset"].alias("first"), F.get("w", F.lit(2))["offset"].alias("added"), F.size("w").alias("n"))


@query("merged_shards", "SELECT event_id, shard FROM (SELECT event_id, event_id % 7 AS shard FROM events)")
def merged_shards(spark, sf_dir):
    """Sorted shards as one sorted table: Spark merges ranges, not files."""
    rows = _events(spark, sf_dir).select("event_id", (F.col("event_id") % 7).alias("shard"))
    parts = [rows.where(F.col("shard") == k) for k in range(7)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("event_id")


@query("alphabet_offers", "SELECT page_id, ceil(n * 5.5 / 40) < ceil(n * 8 / 40) AS gain FROM (SELECT page_id, length(url) AS n FROM pages)")
def alphabet_offers(spark, sf_dir):
    """Whether another spelling of a link needs a smaller symbol; versions here grow by forty bits."""
    n = F.length("url")
    return table(spark, sf_dir, "pages").select("page_id", T.smaller_version(F.ceil(n * 8 / 40), F.ceil(n * 5.5 / 40)).alias("gain"))


#: Settings of a symbol's look and some presets of them.
DEFAULTS = {"shape": "square", "level": "M", "margin": "4"}
PRESETS = {"plain": {}, "round": {"shape": "dots"}, "sturdy": {"level": "H", "margin": "2"}, "both": {"shape": "dots", "level": "H"}}


@query("preset_lookup", "SELECT event_id, CASE WHEN shape = 'square' AND level = 'M' AND margin = '4' THEN 'plain' WHEN shape = 'dots' AND level = 'M' AND margin = '4' THEN 'round' WHEN shape = 'square' AND level = 'H' AND margin = '2' THEN 'sturdy' WHEN shape = 'dots' AND level = 'H' AND margin = '4' THEN 'both' END AS preset FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'square' ELSE 'dots' END AS shape, CASE WHEN event_id % 3 = 0 THEN 'M' ELSE 'H' END AS level, CASE WHEN event_id % 5 < 3 THEN '4' ELSE '2' END AS margin FROM events)")
def preset_lookup(spark, sf_dir):
    k = F.col("event_id")
    rows = _events(spark, sf_dir).select("event_id", F.when(k % 2 == 0, "square").otherwise("dots").alias("shape"), F.when(k % 3 == 0, "M").otherwise("H").alias("level"), F.when(k % 5 < 3, "4").otherwise("2").alias("margin"))
    return rows.select("event_id", T.preset_of(DEFAULTS, PRESETS).alias("preset"))


@query("run_compare", "WITH a AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'ERR' ELSE 'OK' END AS status, left(md5(coalesce(text, '')), 16) AS digest FROM documents), b AS (SELECT doc_id, status, CASE WHEN doc_id % 50 = 7 THEN 'off' ELSE digest END AS digest FROM a WHERE doc_id % 13 <> 2) SELECT (SELECT count(*) FROM a) AS cases_a, (SELECT count(*) FROM b) AS cases_b, (SELECT count(*) FROM a FULL JOIN b USING (doc_id) WHERE a.status IS DISTINCT FROM b.status OR a.digest IS DISTINCT FROM b.digest) AS mismatches, CASE WHEN (SELECT count(*) FROM b WHERE status = 'OK' AND digest = 'off') > 0 THEN 'b: no digest' ELSE '' END AS problems")
def run_compare(spark, sf_dir):
    """Two runs with their digests: what differs, and what the comparison is worth."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    a = d.select("doc_id", F.when(k % 9 == 0, "ERR").otherwise("OK").alias("status"), F.left(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.lit(16)).alias("digest"))
    b = a.where(k % 13 != 2).withColumn("digest", F.when(k % 50 == 7, "off").otherwise(F.col("digest")))
    return compare(a, b, "doc_id", ["status", "digest"], ["digest"])


@query("alphabet_keys", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 2 END AS alphabet, CASE WHEN event_id % 9 IN (1, 2, 3) THEN event_id % 9 ELSE 0 END::INT AS from_number FROM events")
def alphabet_keys(spark, sf_dir):
    """Alphabets by key or alias, and by number, where an unknown one is the first."""
    k = F.col("event_id")
    key = F.element_at(F.array(*(F.lit(x) for x in ("base79", "base64url", "emoji-1k", "qr-alpha", "emoji", "other"))), (k % 6 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", U.alphabet_of_key(key).alias("alphabet"), U.alphabet_of_number(k % 9).alias("from_number"))
