"""URL text as Catalyst expressions: canonical form, pieces, links and alphabets.

Every function takes and returns a Column and stays in JVM code. `REGISTERED` names those that `register` puts
into SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The characters that end a word, and the digit tables of the alphabets.
DELIMITERS = "!#$%&'()*+,-./:;=?@[\\]^_`{|}~"
BASE79 = "~ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._!$&'()*+,;=:@"
BASE64URL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
QR_ALPHA = "/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ$*+-.:"
#: Alphabet ids: 0 base79, 1 base64url, 2 emoji-1k, 3 qr-alpha.
ALPHABETS = ((0, "base79", 79), (1, "base64url", 64), (2, "emoji-1k", 1024), (3, "qr-alpha", 43))

_IPV4 = "^[0-9]{1,3}([.][0-9]{1,3}){3}$"
#: What is a piece of its own.
PIECE = "(https://|http://|%[0-9A-Fa-f]{2}|[!#$%&'()*+,./:;=?@\\[\\\\\\]^_`{|}~-])"
# Top-level domains of the token classes.
TLDS = (
    "com org net io de uk jp edu gov ru fr co us info cn br au nl it es ca ch se pl cz in kr tw nz ie at be dk fi no pt gr hu ro mx ar za tr il ua sk "
    "si hr lt lv ee bg rs by kz vn th id my sg hk ph pk bd lk ae sa eg ma ng ke mil biz name mobi xyz app dev online site store tech top club live news blog"
).split()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_ipv4(host) -> Column:
    host = _col(host)
    return host.rlike(_IPV4) & F.forall(F.split(host, "[.]"), lambda p: p.try_cast("int") < 256)


def rpartition(text, separator: str) -> tuple[Column, Column, Column]:
    """(before, separator, after) at the last separator; ('', '', text) without one."""
    text = _col(text)
    found = F.instr(text, separator) > 0
    after = F.substring_index(text, separator, -1)
    before = F.substring(text, F.lit(1), F.length(text) - F.length(after) - len(separator))
    return F.when(found, before).otherwise(""), F.when(found, F.lit(separator)).otherwise(""), F.when(found, after).otherwise(text)


def authority_parts(url) -> dict[str, Column]:
    """scheme, userinfo (with @), host, port (with :) and tail of an http(s) URL; empty strings otherwise."""
    url = _col(url)
    authority = F.regexp_extract(url, "(?s)^https?://([^/?#]*)", 1)
    rest = F.regexp_extract(authority, "(?s)([^@]*)$", 1)
    port = F.regexp_extract(rest, "(:[0-9]+)$", 1)
    return {
        "scheme": F.regexp_extract(url, "^(https?://)", 1),
        "userinfo": F.regexp_extract(authority, "(?s)^(.*@)", 1),
        "host": F.substring(rest, F.lit(1), F.length(rest) - F.length(port)),
        "port": port,
        "tail": F.regexp_extract(url, "(?s)^https?://[^/?#]*(.*)$", 1),
    }


def canonical_url(url) -> Column:
    """The URL with its host labels reversed, so that equal suffixes come first; an involution. IP literals stay."""
    url = _col(url)
    p = authority_parts(url)
    literal = p["host"].contains("[") | p["host"].contains(":") | is_ipv4(p["host"])
    host = F.when(literal, p["host"]).otherwise(F.array_join(F.reverse(F.split(p["host"], "[.]", -1)), "."))
    return F.when(p["scheme"] == "", url).otherwise(F.concat(p["scheme"], p["userinfo"], host, p["port"], p["tail"]))


def url_pieces(url) -> Column:
    """array<string>: scheme, percent escapes and delimiters alone, words between them."""
    # a piece is what the rule names, or the longest run in which it begins nowhere
    rule = PIECE.strip("()")
    return F.regexp_extract_all(_col(url), F.lit(f"(?s)({rule}|(?:(?!{rule}).)+)"), F.lit(1))


def piece_class(piece) -> Column:
    """The first class that fits a piece: eos, scheme, escape, delimiter, tld, digits, word or mixed."""
    piece = _col(piece)
    return (
        F.when(piece == "<eos>", "eos")
        .when(piece.isin("https://", "http://"), "scheme")
        .when(piece.rlike("^%[0-9A-Fa-f]{2}$"), "escape")
        .when(piece.rlike("^[!#$%&'()*+,./:;=?@\\[\\]^_`{|}~-]$"), "delimiter")
        .when(piece.isin(*TLDS), "tld")
        .when(piece.rlike("^[0-9]+$"), "digits")
        .when(piece.rlike("^[A-Za-z]+$"), "word")
        .otherwise("mixed")
    )


def _qr_shape(code: Column) -> Column:
    return code.rlike("^[/0-9A-Z$*+.:-]+$")


def sniff_alphabet(code) -> Column:
    """The alphabet id that a code shows by its characters, or null."""
    code = _col(code)
    return (
        F.when(code.rlike("[^\\x00-\\x7F]"), F.lit(2))
        .when(code.contains("/") | (_qr_shape(code) & code.rlike("[$*+.:]")), F.lit(3))
        .when(code.rlike("[~.!$&'()*+,;=:@]"), F.lit(0))
    )


def mark_code(code, alphabet) -> Column:
    """The code behind its alphabet's zero digit, where nothing in it tells the alphabet."""
    code, alphabet = _col(code), _col(alphabet)
    return (
        F.when((alphabet == 0) & (~code.rlike("[~.!$&'()*+,;=:@]") | _qr_shape(code)), F.concat(F.lit("~"), code))
        .when((alphabet == 3) & ~code.contains("/") & ~code.rlike("[$*+.:]"), F.concat(F.lit("/"), code))
        .otherwise(code)
    )


def percent_decode(text) -> Column:
    """Strict decoding of %HH; null on a bad escape or bytes that are no UTF-8; "+" stays."""
    text = _col(text)
    bad = text.rlike("%(?![0-9A-Fa-f]{2})")
    parts = F.regexp_extract_all(text, F.lit("(?s)(%[0-9A-Fa-f]{2}|[^%]+)"), F.lit(1))
    raw = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, F.when(x.startswith("%"), F.unhex(F.substring(x, 2, 2))).otherwise(x.cast("binary"))))
    return F.when(~bad, F.try_validate_utf8(raw.cast("string")))


def parse_link(text) -> Column:
    """struct(code, alphabet, error) of a link with a fragment, or of a bare code."""
    trimmed = F.regexp_replace(_col(text), "(?U)^[\\s\\uFEFF]+|[\\s\\uFEFF]+$", "")
    at = F.instr(trimmed, "#")
    code = F.when(at > 0, percent_decode(F.substring(trimmed, at + 1, F.length(trimmed)))).otherwise(trimmed)
    return F.struct(code.alias("code"), sniff_alphabet(code).alias("alphabet"), F.when(code.isNull() & trimmed.isNotNull(), F.lit("malformed link: bad percent-encoding")).alias("error"))


def link_with(base, fragment) -> Column:
    return F.concat(F.substring_index(_col(base), "#", 1), F.lit("#"), _col(fragment))


def qr_text(link, scheme: bool = True) -> Column:
    """The link with scheme and authority in upper case; without the scheme if asked for."""
    text = _col(link) if scheme else F.regexp_replace(_col(link), "^(?i)[a-z][a-z0-9+.-]*://", "")
    base = F.regexp_extract(text, "^(?i)((?:[a-z][a-z0-9+.-]*://)?[^/?#]*)", 1)
    return F.concat(F.upper(base), F.substring(text, F.length(base) + 1, F.length(text)))


def is_http(text) -> Column:
    return _col(text).rlike("^(?i)https?://")


def export_name(stem, code, extension) -> Column:
    """A file name: unsafe runs become one underscore, 64 characters at most."""
    stem, code = F.coalesce(_col(stem), F.lit("")), _col(code)
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(stem, F.lit("")), code), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.concat(F.when(stem == "", "wayfare-").otherwise(""), F.coalesce(F.nullif(F.left(safe, F.lit(64)), F.lit("")), F.lit("qr")), F.lit("."), _col(extension))


def escape_xml(text) -> Column:
    out = _col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_html(text) -> Column:
    out = _col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def path_pattern(pattern) -> Column:
    """A regular expression for a header rule's path: * is anything, :name one segment."""
    literal = F.regexp_replace(_col(pattern), "([.+?^${}()|\\[\\]\\\\])", "\\\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(literal, "\\*", ".*"), ":[A-Za-z_][A-Za-z0-9_]*", "[^/]+"), F.lit("$"))


def alphabet_table(spark: SparkSession):
    """(alphabet, name, size): four rows."""
    return spark.createDataFrame(list(ALPHABETS), "alphabet int, name string, size int")


def alphabet_of_key(key) -> Column:
    """An alphabet's id by its key, or by the alias emoji; null for others."""
    key = _col(key)
    out = F.when(key == "emoji", F.lit(2))
    for number, name, _ in ALPHABETS:
        out = out.when(key == name, F.lit(number))
    return out


def alphabet_of_number(number) -> Column:
    """The id itself, or the first alphabet's if there is no such."""
    return F.when(_col(number).isin(*(n for n, _, _ in ALPHABETS)), _col(number).cast("int")).otherwise(0)


#: Text functions in SQL: name, parameters, type, body; later ones use those before.
SQL_FUNCTIONS = (
    ("is_http", "url STRING", "BOOLEAN", "url RLIKE '^(?i)https?://'"),
    ("link_with", "base STRING, fragment STRING", "STRING", "concat(substring_index(base, '#', 1), '#', fragment)"),
    ("octets", "url STRING", "INT", "octet_length(url)"),
    ("is_ipv4", "host STRING", "BOOLEAN", f"host RLIKE '{_IPV4}' AND forall(split(host, '[.]'), p -> try_cast(p AS INT) < 256)"),
    ("url_authority", "url STRING", "STRING", "regexp_extract(url, '(?s)^https?://([^/?#]*)', 1)"),
    ("url_host_port", "url STRING", "STRING", "regexp_extract(url_authority(url), '(?s)([^@]*)$', 1)"),
    ("url_port", "url STRING", "STRING", "regexp_extract(url_host_port(url), '(:[0-9]+)$', 1)"),
    ("url_host", "url STRING", "STRING", "substring(url_host_port(url), 1, length(url_host_port(url)) - length(url_port(url)))"),
    ("reversed_host", "host STRING", "STRING", "CASE WHEN host LIKE '%[%' OR host LIKE '%:%' OR is_ipv4(host) THEN host ELSE array_join(reverse(split(host, '[.]')), '.') END"),
    (
        "canonical_url", "url STRING", "STRING",
        "CASE WHEN NOT url RLIKE '^https?://' THEN url ELSE concat(regexp_extract(url, '^(https?://)', 1), regexp_extract(url_authority(url), '(?s)^(.*@)', 1), reversed_host(url_host(url)), url_port(url), regexp_extract(url, '(?s)^https?://[^/?#]*(.*)$', 1)) END",
    ),
    ("url_pieces", "url STRING", "ARRAY<STRING>", f'regexp_extract_all(url, r"(?s)({PIECE[1:-1]}|(?:(?!{PIECE[1:-1]}).)+)", 1)'),
    (
        "sniff_alphabet", "code STRING", "INT",
        "CASE WHEN code RLIKE r'[^\x00-\x7F]' THEN 2 WHEN contains(code, '/') OR (code RLIKE '^[/0-9A-Z$*+.:-]+$' AND code RLIKE '[$*+.:]') THEN 3 WHEN code RLIKE \"[~.!$&'()*+,;=:@]\" THEN 0 END",
    ),
    (
        "mark_code", "code STRING, alphabet INT", "STRING",
        "CASE WHEN alphabet = 0 AND (NOT code RLIKE \"[~.!$&'()*+,;=:@]\" OR code RLIKE '^[/0-9A-Z$*+.:-]+$') THEN concat('~', code) WHEN alphabet = 3 AND NOT contains(code, '/') AND NOT code RLIKE '[$*+.:]' THEN concat('/', code) ELSE code END",
    ),
    (
        "percent_decode", "text STRING", "STRING",
        "CASE WHEN NOT text RLIKE '%(?![0-9A-Fa-f]{2})' THEN try_validate_utf8(cast(aggregate(regexp_extract_all(text, '(?s)(%[0-9A-Fa-f]{2}|[^%]+)', 1), X'', (a, x) -> concat(a, CASE WHEN startswith(x, '%') THEN unhex(substring(x, 2, 2)) ELSE cast(x AS BINARY) END)) AS STRING)) END",
    ),
    ("link_code", "link STRING", "STRING", r"CASE WHEN contains(link, '#') THEN percent_decode(substring(regexp_replace(link, r'(?U)^[\s\uFEFF]+|[\s\uFEFF]+$', ''), instr(regexp_replace(link, r'(?U)^[\s\uFEFF]+|[\s\uFEFF]+$', ''), '#') + 1)) ELSE regexp_replace(link, r'(?U)^[\s\uFEFF]+|[\s\uFEFF]+$', '') END"),
    ("parse_link", "link STRING", "STRUCT<code: STRING, alphabet: INT, error: STRING>", "named_struct('code', link_code(link), 'alphabet', sniff_alphabet(link_code(link)), 'error', CASE WHEN link_code(link) IS NULL AND link IS NOT NULL THEN 'malformed link: bad percent-encoding' END)"),
)


def register(spark: SparkSession, tokenizer=None) -> None:
    """Put the text functions into SQL: expressions as SQL functions, framing and tokens (if a tokenizer is given) as Arrow UDFs."""
    from ..operators import coding
    from ..operators import tokenizer as tokens

    for name, params, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    spark.udf.register("frame_bits", coding.frame_udf())
    spark.udf.register("unframe_code", coding.unframe_udf())
    if tokenizer is not None:
        spark.udf.register("url_tokens", tokens.tokenize_udf(tokenizer, spark))
