"""Texts and rules of pages, caches, settings, kernels and replies, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import fixed

#: Byte sizes of the memory estimate: a page, what a worker's stack and thread data take, margins for tokenizer and scratch; pages and workers at most.
PAGE_BYTES, WORKER_BYTES, MARGIN_BYTES, MAX_PAGES, MAX_WORKERS = 65536, (1 << 20) + (1 << 16), (2 << 20) + (16 << 20), 16384, 4


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# --- files and caches


def is_model_asset(path) -> Column:
    return _col(path).endswith(".bin")


def is_shell_path(path, same_origin=True) -> Column:
    """A page or a hashed asset of this origin; the worker's own script and model files are not."""
    path = _col(path)
    return F.lit(same_origin) & (path != "/sw.js") & ~is_model_asset(path) & (path.rlike("[.]html$") | path.rlike("^/assets/[^/]+[.](js|css|svg)$"))


def shell_files(paths):
    """(path): the files of a shell among a table's `path`, each once, with a slash before; sort them where order is asked for."""
    p = F.col("path")
    keep = (p != "sw.js") & ~is_model_asset(p) & (p.endswith(".html") | p.rlike("^assets/[^/]+[.](js|css|svg)$") | (p == "assets.json"))
    return paths.where(keep).select(F.concat(F.lit("/"), p).alias("path")).distinct()


def is_model_cache(name, prefix: str = "wayfare-") -> Column:
    return _col(name).rlike(f"^{prefix}[0-9a-f]{{8}}$")


def is_shell_cache(name, prefix: str = "wayfare-") -> Column:
    return _col(name).rlike(f"^{prefix}shell-[0-9a-f]{{8}}$")


def is_stale_model_cache(name, current, prefix: str = "wayfare-") -> Column:
    return is_model_cache(name, prefix) & (_col(name) != _col(current))


def hashed_name(base, sha256, extension) -> Column:
    return F.concat_ws(".", _col(base), F.left(_col(sha256), F.lit(8)), _col(extension))


def chunk_name(sha256, chunk_bytes, index) -> Column:
    """A chunk's name tells the whole file's digest, the chunk size and the place."""
    n = _col(index).cast("string")
    return hashed_name(F.lit("model"), sha256, F.concat(F.lit("c"), _col(chunk_bytes).cast("string"), F.lit("."), F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0")), F.lit(".bin")))


# --- pages


def page_title(site, suffix, tagline) -> Column:
    """Site, page name and tagline, where there are such."""
    return F.concat_ws(" — ", F.concat_ws(" · ", _col(site), _col(suffix)), _col(tagline))


def page_description(site, suffix, tagline) -> Column:
    return F.coalesce(_col(tagline), _col(suffix), _col(site))


def page_menu(pages):
    """(here, href, label, current, ord): the menu of each listed page of a table (id, href, nav, unlisted, ord); unlisted pages have none."""
    listed = pages.where("NOT coalesce(unlisted, false)")
    # a site has a handful of pages
    return listed.select(F.col("id").alias("here")).crossJoin(listed).select("here", "href", F.col("nav").alias("label"), (F.col("id") == F.col("here")).alias("current"), "ord")


def eval_source(text) -> Column:
    """Without a leading "owner/repository "."""
    return F.regexp_replace(_col(text), "^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\\s+", "")


# --- kernels and tiers


def _workers(kernel: Column) -> Column:
    n = F.regexp_extract(kernel, "^threads:([0-9]+)$", 1)
    return F.when(n != "", n.cast("bigint"))


def kernel_workers(kernel) -> Column:
    """Workers of a threads tier; null elsewhere, and for none."""
    n = _workers(_col(kernel))
    return F.when(n > 0, n)


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def kernel_features(kernel) -> Column:
    """What a build of this label contains, in the order in which builds nest."""
    kernel = _col(kernel)
    n, workers = _workers(kernel), kernel_workers(kernel)
    both = F.array(F.lit("SIMD128"), F.lit("relaxed SIMD"))
    return (
        F.when(workers.isNotNull(), F.concat(both, F.array(F.concat(_plural(workers, "worker"), F.lit(" on shared memory")))))
        .when(n.isNotNull() | (kernel == "relaxed"), both)
        .when(kernel == "simd", F.array(F.lit("SIMD128")))
        .when(kernel == "scalar", F.array(F.lit("no SIMD (scalar fallback)")))
        .otherwise(F.array().cast("array<string>"))
    )


def _labelled(kernel: Column, parts: Column, separator: str) -> Column:
    return F.when(F.size(parts) > 0, F.concat(kernel, F.lit(" — "), F.array_join(parts, separator))).otherwise(kernel)


def kernel_summary(kernel) -> Column:
    return _labelled(_col(kernel), kernel_features(kernel), " + ")


def kernel_short(kernel) -> Column:
    """One line: without what every build has."""
    kernel = _col(kernel)
    features, workers = kernel_features(kernel), kernel_workers(kernel)
    rest = F.array_compact(F.array(F.when(F.array_contains(features, "relaxed SIMD"), "relaxed SIMD"), F.when(workers.isNotNull(), _plural(workers, "worker"))))
    rest = F.when((F.size(rest) == 0) & ~F.array_contains(features, "SIMD128"), features).otherwise(rest)
    return _labelled(kernel, rest, ", ")


def kernel_label(workers, kernel) -> Column:
    """The label of what runs: the threads that live, else the build's kernel."""
    return F.when(_col(workers) > 0, F.concat(F.lit("threads:"), _col(workers).cast("string"))).otherwise(_col(kernel))


def worker_count(isolated, cores) -> Column:
    return F.when(_col(isolated), F.greatest(F.lit(0), F.least(_col(cores) - 1, F.lit(MAX_WORKERS)))).otherwise(0)


def picked_tier(threads, relaxed, has_threads=True, has_relaxed=True) -> Column:
    """threads, relaxed or simd: the first that the device and the build have."""
    return F.when((_col(threads) > 0) & F.lit(has_threads), "threads").when(_col(relaxed) & F.lit(has_relaxed), "relaxed").otherwise("simd")


def memory_pages(model_bytes) -> Column:
    """Pages that hold a model with its margins and workers, MAX_PAGES at most."""
    return F.least(F.ceil((_col(model_bytes) + MARGIN_BYTES + MAX_WORKERS * WORKER_BYTES) / PAGE_BYTES), F.lit(MAX_PAGES).cast("bigint"))


def smaller_version(here, other) -> Column:
    """Whether another alphabet's symbol is of a lower version."""
    return _col(other) < _col(here)


# --- replies and faults


def is_poison_reply(ok, code) -> Column:
    return F.coalesce((_col(ok) == F.lit(False)) & (_col(code) == "instance_poisoned"), F.lit(False))


def info_fault(poisoned, degraded, error) -> Column:
    yes = lambda x: F.coalesce(_col(x), F.lit(False))
    return yes(poisoned) | yes(degraded) | F.coalesce(_col(error) != 0, F.lit(False))


def fault_action(ok, code, recovering) -> Column:
    """recover: rebuild and try once more; replay: wait for the rebuild that runs, then try; return: hand it on."""
    failed = F.coalesce(_col(ok) == F.lit(False), F.lit(False))
    return F.when(is_poison_reply(ok, code), "recover").when(_col(recovering) & failed, "replay").otherwise("return")


def load_code(poisoned, tokenizer_utf8, model_ok, tokenizer_ok, vocabularies_agree, workers, registered) -> Column:
    """The first check of a load that fails: 6 poisoned, 1 text, 2 model, 3 tokenizer, 5 vocabularies, 4 workers; 0 if none does."""
    return (
        F.when(_col(poisoned), 6).when(~_col(tokenizer_utf8), 1).when(~_col(model_ok), 2).when(~_col(tokenizer_ok), 3).when(~_col(vocabularies_agree), 5)
        .when((_col(workers) > 0) & (_col(workers) > _col(registered)), 4).otherwise(0)
    )


def is_message(text, kind: str) -> Column:
    """Whether a JSON text is an object whose `type` is `kind`."""
    return F.coalesce(F.get_json_object(_col(text), "$.type") == kind, F.lit(False))


def short_link(status, retry_after, ok, slug, link, error, site: str, retry: Column | None = None) -> Column:
    """struct(ok, slug, link, created, error, retry_after) of a short-link service's answer."""
    from .formats import retry_text

    status, slug, link = _col(status), _col(slug), _col(link)
    header = _col(retry_after).try_cast("double")
    seconds = F.when(header > 0, header).otherwise(600.0)
    good = F.coalesce(_col(ok), F.lit(False)) & (F.coalesce(slug, F.lit("")) != "") & F.coalesce(link.startswith(site), F.lit(False))
    done = status.between(200, 299) & good
    problem = (
        F.when(status == 429, F.concat(F.lit("too many short links from your address; try again in "), retry_text(seconds)))
        .when(~status.between(200, 299), F.coalesce(F.nullif(_col(error), F.lit("")), F.concat(F.lit("the service answered "), status.cast("string"))))
        .when(~good, F.lit("unexpected answer"))
    )
    return F.struct(done.alias("ok"), F.when(done, F.lower(slug)).alias("slug"), F.when(done, F.lower(link)).alias("link"), F.when(done, status == 201).alias("created"), problem.alias("error"), F.when(status == 429, seconds).alias("retry_after"))


# --- status lines


def error_text(error, faulted) -> Column:
    return F.when(_col(error).isNull(), "").when(_col(faulted), _col(error)).otherwise(F.concat(F.lit("failed to load: "), _col(error)))


def status_line(error, faulted, ready: Column, parts: Column, text) -> Column:
    """The error, else what a ready model says (an array, null while loading), else the progress parts, else its text."""
    loading = F.coalesce(F.when(F.size(parts) >= 0, F.array_join(parts, " · ")), _col(text), F.lit("loading model…"))
    return F.when(F.coalesce(_col(error), F.lit("")) != "", error_text(error, faulted)).when(ready.isNotNull(), F.array_join(ready, " · ")).otherwise(loading)


def kept_share(lo, hi) -> Column:
    """How much of a line a slice keeps: "~100% kept", whole percents from 10, tenths from 0.1, else two figures."""
    p = (_col(hi) - _col(lo)) * 100
    digits = F.floor(F.log10(p)).cast("int")
    power = F.pow(F.lit(10.0), 1 - digits)
    two = F.round(p * power) / power  # two significant figures
    small = F.when(digits < -6, F.format_string("%.1e", two)).otherwise(F.regexp_replace(F.format_string("%.20f", two), "^(0[.]0*[0-9]{2}).*$", "$1"))
    text = F.when(p >= 99.5, "~100%").when(p >= 10, F.concat(fixed(p, 0), F.lit("%"))).when(p >= 0.1, F.concat(fixed(p, 1), F.lit("%"))).otherwise(F.concat(small, F.lit("%")))
    return F.concat(text, F.lit(" kept"))


def pieces_up_to(pieces, target) -> Column:
    """struct(host, path, next): the pieces after the first up to the first slash, from there to the piece before `target`, and that piece."""
    pieces = _col(pieces)
    slash = F.array_position(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), F.lit("/")).cast("int")  # from the second piece, 0 if none
    at = F.array_position(pieces, _col(target)).cast("int")
    ok = (slash > 0) & (at > 2) & (at > slash + 1)
    host = F.array_join(F.slice(pieces, F.lit(2), F.greatest(slash - 1, F.lit(0))), "")
    path = F.array_join(F.slice(pieces, F.greatest(slash + 1, F.lit(1)), F.greatest(at - slash - 2, F.lit(0))), "")
    return F.when(ok, F.struct(host.alias("host"), path.alias("path"), F.get(pieces, at - 2).alias("next")))


# --- fields and captions


def bounded_value(text, lo: float, hi: float, integer: bool = True) -> Column:
    """The number that a field's text holds if it is finite, within its bounds and whole where asked for; else null."""
    n = F.trim(_col(text)).try_cast("double")
    fine = ~F.isnan(n) & n.between(lo, hi)
    return F.when(fine & (n == F.floor(n)) if integer else fine, n)


def wrap_caption(text, width, font) -> Column:
    """array<string>: lines of at most width / (0.55 * font) characters, word by word; longer words are broken; empty lines stay inside only."""
    most = F.greatest(F.lit(1), F.floor(_col(width) / (_col(font) * 0.55)).cast("int"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("lines"), F.lit("").alias("line"))

    def put(state: Column, word: Column) -> Column:
        lines, line = state["lines"], state["line"]
        whole = F.floor((F.length(word) - 1) / most).cast("int")  # full lines of a long word
        flushed = F.when(line != "", F.concat(lines, F.array(line))).otherwise(lines)
        cut = F.transform(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda k: F.substring(word, k * most + 1, most))
        long = F.struct(F.concat(flushed, cut).alias("lines"), F.substring(word, whole * most + 1, most).alias("line"))
        fits = F.length(line) + 1 + F.length(word) <= most
        short = F.struct(F.when((line == "") | fits, lines).otherwise(flushed).alias("lines"), F.when(line == "", word).when(fits, F.concat(line, F.lit(" "), word)).otherwise(word).alias("line"))
        return F.when(F.length(word) > most, long).otherwise(short)

    paragraph = lambda p: F.aggregate(F.filter(F.split(p, "\\s+"), lambda w: w != ""), start, put, lambda s: F.concat(s["lines"], F.array(s["line"])))
    lines = F.flatten(F.transform(F.split(_col(text), "\\r?\\n"), paragraph))
    last = F.size(lines) - 1
    return F.filter(lines, lambda x, i: (x != "") | ((i > 0) & (i < last)))


# --- presets


def applied(defaults: dict[str, str], overrides: dict[str, str]) -> dict[str, str]:
    """A preset's settings: the defaults, then its own; what it does not set is reset."""
    return {**defaults, **{k: v for k, v in overrides.items() if k in defaults}}


def preset_of(defaults: dict[str, str], presets: dict[str, dict[str, str]]) -> Column:
    """The first preset that a row's settings are exactly, or null; the columns bear the settings' names."""
    out = F.lit(None).cast("string")
    for name, own in reversed(presets.items()):
        same = F.lit(True)
        for k, v in applied(defaults, own).items():
            same = same & F.col(k).eqNullSafe(F.lit(v))
        out = F.when(same, name).otherwise(out)
    return out


# --- consistency


def scaled(value, expected, factor: float, tolerance: float = 0.01) -> Column:
    """A part's total as the whole's: as it is if it agrees with what is expected, else times factor; an error if that drifts."""
    value, expected = _col(value), _col(expected)
    agrees = lambda x: F.abs(x / expected - 1) <= tolerance
    return F.when(agrees(value), value).when(agrees(value * factor), value * factor).otherwise(F.raise_error(F.concat(F.lit("the total drifts from "), expected.cast("string"))))


def required(json, path: str, kind: str = "string") -> Column:
    """A field by its dotted path; an error that names the path if it is missing, null or of another kind (string, number)."""
    value = F.get_json_object(_col(json), "$." + path)
    checked = F.when(value.isNull(), F.raise_error(F.lit(f'required field "{path}" is missing or null')))
    if kind == "number":
        return checked.when(value.try_cast("double").isNull(), F.raise_error(F.lit(f'field "{path}" is not a number'))).otherwise(value.try_cast("double"))
    return checked.when(value == "", F.raise_error(F.lit(f'field "{path}" is empty'))).otherwise(value)


def eval_figures(text) -> Column:
    """struct(bits, scored, skipped, kernel, real, real_urls) of a report's lines; an error if one of the first two lines is missing, nulls for the last."""
    text = _col(text)
    num = lambda p, k=1: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    full = r"fp32:\s*([0-9.]+)\s*bits/char over ([0-9]+) URLs \(([0-9]+) skipped\)"
    simulated, real = r"kernel_sim\(int4\):\s*([0-9.]+)\s*bits/char", r"(?m)^\s*kernel:\s*([0-9.]+)\s*bits/char \([^)]*\) over ([0-9]+) URLs"
    need = lambda x, what: F.when(x.isNull(), F.raise_error(F.lit(f"the report has no {what} line"))).otherwise(x)
    return F.struct(
        need(num(full), "full-precision").cast("double").alias("bits"), num(full, 2).cast("bigint").alias("scored"), num(full, 3).cast("bigint").alias("skipped"),
        need(num(simulated), "simulated-kernel").cast("double").alias("kernel"), num(real).cast("double").alias("real"), num(real, 2).cast("bigint").alias("real_urls"),
    )
