"""Geometry, colours and cell hashes of square symbols, as Catalyst expressions. Lengths are in modules of the symbol."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The side of a finder, the row and column of the timing patterns, the share of a symbol that a plate may cover, and
# the share of its side that an image may take, by error level.
FINDER, TIMING, PLATE_SHARE = 7, 6, 0.05
_MASK = 0xFFFFFFFF


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def alignment_coordinates(size) -> Column:
    """Rows (and columns) of the centres of alignment patterns: from 6 to size - 7 in even steps; none below version 2."""
    size = _col(size)
    version = F.floor((size - 17) / 4).cast("int")
    count = F.floor(version / 7).cast("int") + 2
    step = F.when(size == 145, 26).otherwise(F.ceil((size - 13) / (2 * count - 2)).cast("int") * 2)
    places = F.concat(F.array(F.lit(TIMING)), F.reverse(F.transform(F.sequence(F.lit(0), count - 2), lambda k: size - 7 - k * step)))
    return F.when(version >= 2, places).otherwise(F.array().cast("array<int>"))


def in_finder(size, r, c) -> Column:
    size, r, c = _col(size), _col(r), _col(c)
    top, left, bottom, right = r < FINDER, c < FINDER, r >= size - FINDER, c >= size - FINDER
    return (top & left) | (top & right) | (bottom & left)


def in_timing(size, r, c) -> Column:
    size, r, c = _col(size), _col(r), _col(c)
    between = lambda x: (x >= FINDER + 1) & (x <= size - FINDER - 2)
    return ((r == TIMING) & between(c)) | ((c == TIMING) & between(r))


def in_alignment(size, r, c) -> Column:
    """Within two of a centre; the three corners that finders take have none."""
    size, r, c = _col(size), _col(r), _col(c)
    near = lambda x: F.filter(alignment_coordinates(size), lambda a: F.abs(x - a) <= 2)
    a, b, last = F.get(near(r), F.lit(0)), F.get(near(c), F.lit(0)), size - 7
    corner = ((a == TIMING) & (b == TIMING)) | ((a == TIMING) & (b == last)) | ((a == last) & (b == TIMING))
    return a.isNotNull() & b.isNotNull() & ~corner


def is_function_pattern(size, r, c) -> Column:
    """Whether a cell belongs to a finder, an alignment pattern or a timing pattern."""
    return in_finder(size, r, c) | in_alignment(size, r, c) | in_timing(size, r, c)


def _centred(size: Column, w: Column, h: Column, font: Column) -> Column:
    return F.struct(((size - w) / 2).alias("x"), ((size - h) / 2).alias("y"), w.alias("w"), h.alias("h"), font.alias("font"))


def label_plate(size, characters, share: float = PLATE_SHARE) -> Column:
    """struct(x, y, w, h, font) of a label's plate in the middle; null if it would cover more than `share` of the symbol."""
    size = _col(size).cast("double")
    font = F.greatest(F.lit(1.8), size / 14)
    w, h = _col(characters) * font * 0.62 + 1, font * 1.3 + 0.6
    return F.when(w * h <= size * size * share, _centred(size, w, h, font))


def logo_plate(size, share: float = PLATE_SHARE) -> Column:
    """A square plate of an odd side, three at least."""
    size = _col(size).cast("double")
    side = F.floor(F.lit(math.sqrt(share)) * size)
    side = F.greatest(F.lit(3.0), (side - F.when(side % 2 == 0, 1).otherwise(0)).cast("double"))
    return _centred(size, side, side, F.lit(0.0))


def image_plate(size, image, margin) -> Column:
    """The plate of an image that takes `image` of the side, with a margin around it."""
    size = _col(size).cast("double")
    side = F.greatest(F.lit(1.0), _col(image) * size + 2 * _col(margin))
    return _centred(size, side, side, F.lit(0.0))


def image_size(wanted, cover) -> Column:
    """The image's share of the side: as wanted, but no more than error correction covers."""
    return F.least(_col(wanted), F.sqrt(_col(cover)))


def circle_padding(size, margin) -> Column:
    """Modules that a disc around the symbol and its quiet zone adds on each side."""
    side = _col(size) + 2 * _col(margin)
    return F.ceil((side * math.sqrt(2) - side) / 2)


def gradient_line(rotation, x, y, w, h) -> Column:
    """array(x1, y1, x2, y2): where a linear gradient of an angle in degrees begins and ends across a box."""
    a, w, h = _col(rotation) * math.pi / 180, _col(w), _col(h)
    cx, cy = _col(x) + w / 2, _col(y) + h / 2
    half = (F.abs(w * F.cos(a)) + F.abs(h * F.sin(a))) / 2
    dx, dy = F.cos(a) * half, F.sin(a) * half
    return F.array(cx - dx, cy - dy, cx + dx, cy + dy)


def mix(a, b, t) -> Column:
    """Colour a (#rrggbb) blended t of the way to b."""
    a, b, t = _col(a), _col(b), _col(t)

    def channel(at: int) -> Column:
        of = lambda c: F.conv(F.substring(c, at, 2), 16, 10).cast("double")
        return F.lpad(F.lower(F.hex(F.floor(of(a) * (1 - t) + of(b) * t + 0.5))), 2, "0")

    return F.concat(F.lit("#"), channel(2), channel(4), channel(6))


def reversed_stops(stops) -> Column:
    """Gradient stops (offset, color) run the other way."""
    return F.reverse(F.transform(_col(stops), lambda s: F.struct(F.round(1 - s["offset"], 3).alias("offset"), s["color"].alias("color"))))


def with_stop(stops, most: int = 5) -> Column:
    """The stops with one more half-way between the last two, in the last one's colour; `most` at most."""
    stops = _col(stops)
    n = F.size(stops)
    a, b = F.get(stops, n - 2), F.get(stops, n - 1)
    new = F.struct(F.round((a["offset"] + b["offset"]) / 2, 3).alias("offset"), b["color"].alias("color"))
    return F.when(n >= most, stops).otherwise(F.concat(F.slice(stops, F.lit(1), n - 1), F.array(new, b)))


def cell_hash(r, c, seed) -> Column:
    """A fixed number in [0, 1) for a cell, by 32-bit integer mixing; products are of doubles, as the seed's may exceed 53 bits."""
    part = lambda x, k: (_col(x).cast("double") * float(k)).cast("bigint")
    h = part(r, 73856093).bitwiseXOR(part(c, 19349663)).bitwiseXOR(part(seed, 83492791)).bitwiseAND(_MASK)
    h = (h.bitwiseXOR(F.shiftright(h, 13)) * 0x5BD1E995).bitwiseAND(_MASK)
    return h.bitwiseXOR(F.shiftright(h, 15)) / float(1 << 32)


def dark_seed(cells) -> Column:
    """A seed of 32 bits from the numbers of the dark cells (row * size + column) in order."""
    wrap = lambda x: (x + (1 << 31)).bitwiseAND(_MASK) - (1 << 31)
    return F.aggregate(_col(cells), F.lit(0).cast("bigint"), lambda k, i: wrap(k * 31 + i.cast("bigint")))
