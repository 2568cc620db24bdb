"""Figures as text, as Catalyst expressions. NBSP stands between a figure and its unit.

`fixed` rounds the exact binary value, halves away from zero: 0.25 gives 0.3 and 1.005, which is a little less, gives 1.00.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "
MIB = 1048576


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def _halves(x: float) -> tuple[float, float]:
    """x as a sum of two numbers of 26 bits."""
    c = 134217729.0 * x
    high = c - (c - x)
    return high, x - high


def fixed(x, digits: int) -> Column:
    """x with so many decimals. What the product with the power of ten loses to rounding is found by splitting both factors, and decides."""
    v = _col(x).cast("double")
    a, scale = F.abs(v), float(10**digits)
    p = a * scale
    c = a * 134217729.0
    high = c - (c - a)
    low, (sh, sl) = a - high, _halves(scale)
    lost = ((high * sh - p) + high * sl + low * sh) + low * sl if digits else F.lit(0.0)
    whole = F.floor(p)
    n = whole + F.when((p - whole) - 0.5 + lost >= 0, 1).otherwise(0)
    text = F.concat(((n - n % 10**digits) / 10**digits).cast("bigint").cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0")) if digits else n.cast("string")
    text = F.concat(F.when(v < 0, "-").otherwise(""), text)
    return F.when(p < float(1 << 52), text).otherwise(F.format_string(f"%.{digits}f", v))


def fmt_mib(mib, digits: int = 1) -> Column:
    return F.concat(fixed(mib, digits), F.lit(f"{NBSP}MiB"))


def fmt_bytes(n, digits: int = 1) -> Column:
    return fmt_mib(_col(n) / MIB, digits)


def fmt_rate(n) -> Column:
    return F.concat(fmt_bytes(n), F.lit("/s"))


def fmt_bits(bits, digits: int = 1, unit: str = "b") -> Column:
    """Below half the last place, a bound instead of zero."""
    floor = 0.05 if digits == 1 else 0.005
    text = F.when(_col(bits) < floor, F.lit(f"<{floor * 2:.{digits}f}")).otherwise(fixed(bits, digits))
    return text if unit == "none" else F.concat(text, F.lit(f"{NBSP}{unit}"))


def superscript(n) -> Column:
    return F.translate(_col(n).cast("string"), "0123456789-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁻")


def fmt_pct(prob, bits=None) -> Column:
    """A probability in percent: three decimals, or below 0.001 % one digit and a power of ten (from bits, if given)."""
    p = _col(prob) * 100
    q = p if bits is None else F.pow(F.lit(2.0), -_col(bits)) * 100
    e = F.floor(F.log10(q))
    e = F.when(F.round(q / F.pow(F.lit(10.0), e), 1) >= 10, e + 1).otherwise(e)
    scientific = F.concat(fixed(q / F.pow(F.lit(10.0), e), 1), F.lit("×10"), superscript(e.cast("int")), F.lit("%"))
    return F.when(p >= 1e-3, F.concat(fixed(p, 3), F.lit("%"))).when(~(q > 0), "0%").otherwise(scientific)


def prob_pct(bits) -> Column:
    return F.concat(fixed(F.pow(F.lit(2.0), -_col(bits)) * 100, 1), F.lit("%"))


def fmt_share(fraction, digits: int = 1) -> Column:
    return F.concat(fixed(_col(fraction) * 100, digits), F.lit("%"))


def fmt_ms(ms, digits: int = 0) -> Column:
    return F.concat(fixed(ms, digits), F.lit(f"{NBSP}ms"))


def fmt_seconds(ms) -> Column:
    s = _col(ms) / 1000
    m = F.floor(s / 60)
    return F.when(s < 60, F.concat(fixed(s, 1), F.lit(f"{NBSP}s"))).otherwise(F.concat(m.cast("string"), F.lit(":"), F.lpad(F.floor(s - m * 60 + 0.5).cast("string"), 2, "0")))


def fmt_eta(ms) -> Column:
    s = F.greatest(F.lit(0).cast("bigint"), F.floor(_col(ms) / 1000 + 0.5))
    m = F.floor(s / 60)
    return F.when(s < 60, F.concat(F.lit("~"), s.cast("string"), F.lit(f"{NBSP}s left"))).otherwise(F.concat(F.lit("~"), m.cast("string"), F.lit(":"), F.lpad((s - m * 60).cast("string"), 2, "0"), F.lit(" left")))


def fmt_count(n) -> Column:
    """K, M or B; one decimal below ten of a unit."""
    n = _col(n).cast("double")
    out = F.when(n >= 1e10, F.concat(fixed(n / 1e9, 0), F.lit("B")))
    for least, unit, digits, name in ((1e9, 1e9, 1, "B"), (1e7, 1e6, 0, "M"), (1e6, 1e6, 1, "M"), (1e4, 1e3, 0, "K"), (1e3, 1e3, 1, "K")):
        out = out.when(n >= least, F.concat(fixed(n / unit, digits), F.lit(name)))
    return out.otherwise(F.when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise(n.cast("string")))


def fmt_exact(n) -> Column:
    return F.format_number(_col(n), 0)


def cost_parts(model_bits, coded_bits) -> Column:
    """struct(model, overhead, total) of a coded text's cost."""
    return F.struct(fmt_bits(model_bits, 1, "none").alias("model"), fmt_bits(_col(coded_bits) - _col(model_bits), 1, "none").alias("overhead"), _col(coded_bits).cast("string").alias("total"))


def download_text(got, total, elapsed_ms, rate, eta_ms, from_cache) -> Column:
    """The loading line: parts joined by " · "; unknown rates and times are left out."""
    net = F.concat_ws(" · ", fmt_bytes(total), F.concat(fmt_bytes(got), F.lit(" downloaded")), fmt_rate(rate), F.concat(fmt_seconds(elapsed_ms), F.lit(" elapsed")), fmt_eta(eta_ms))
    return F.when(_col(from_cache), F.concat_ws(" · ", F.lit("restoring"), F.concat(fmt_bytes(got), F.lit(" of "), fmt_bytes(total)), F.lit("from cache…"))).otherwise(net)


def loaded_summary(n, elapsed_ms, cached) -> Column:
    n, cached, elapsed = _col(n), _col(cached), _col(elapsed_ms)
    net = F.greatest(F.lit(0).cast("bigint"), n - cached)
    rate = F.when(elapsed > 0, net / elapsed * 1000).otherwise(0.0)
    line = F.concat(fmt_bytes(net), F.lit(" in "), fmt_seconds(elapsed), F.lit(" ("), fmt_rate(rate), F.lit(")"))
    return F.when(net == 0, F.concat(fmt_bytes(n), F.lit(" from cache in "), fmt_seconds(elapsed))).when(cached == 0, line).otherwise(F.concat(fmt_bytes(cached), F.lit(" from cache + "), line))


def retry_text(seconds) -> Column:
    s = F.greatest(F.lit(1).cast("bigint"), F.floor(_col(seconds) + 0.5))
    m = F.floor(_col(seconds) / 60 + 0.5)
    return F.when(_col(seconds) < 90, F.concat(s.cast("string"), F.when(s == 1, " second").otherwise(" seconds"))).otherwise(F.concat(m.cast("string"), F.when(m == 1, " minute").otherwise(" minutes")))
