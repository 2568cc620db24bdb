"""The pre-tokeniser of byte-level BPE, vectorised: the matches of public_tokenizers.PATTERN over a chunk of documents.

The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?letters+| ?numbers+| ?others+|\\s+(?!\\S)|\\s+. Its matches follow from the class of
each character: a run of one class is a match, but of a run of white space before something else, the last character is on
its own, joins what follows if it is a space, and the rest is a match of its own; and a contraction after a letter, number,
line end or the start of the text is a match that ends inside the letters.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from .common import span_hashes

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_APOSTROPHE = 39
_WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def _table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[[*_WHITE]] = SPACE
    return out


def split(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, piece offsets by document) over the bytes of a chunk."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), np.zeros(len(offs), np.int64)
    if data.max() < 0x80:
        points, place, borders = data, None, offs
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        borders = np.searchsorted(place, offs)
    n = len(points)
    kind = _table()[points]
    first = np.zeros(n + 1, bool)
    first[borders] = True  # also the end of the last document
    cut = np.empty(n, bool)
    cut[0] = True
    cut[1:] = kind[1:] != kind[:-1]
    cut |= first[:n]
    # the last white space before something else
    white = kind == SPACE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])
    joins = last[points[last] == 32]
    cut[last] = True
    cut[joins + 1] = False
    # contractions
    marks = np.flatnonzero((points == _APOSTROPHE) & cut)
    if len(marks):
        end = borders[np.searchsorted(borders, marks, "right")]
        at = [np.where(marks + k < end, points[np.minimum(marks + k, n - 1)], 0) for k in (1, 2)]
        one = np.isin(at[0], [ord(c) for c in "stmd"])
        two = np.zeros(len(marks), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (at[0] == ord(a)) & (at[1] == ord(b))
        length = np.where(one, 2, np.where(two, 3, 0))
        own = length > 0
        cut[marks[own] + 1] = False
        after = marks[own] + length[own]
        inside = after < end[own]
        after = after[inside]
        cut[after[kind[after] == LETTER]] = True
    starts = np.flatnonzero(cut)
    offs_of = np.searchsorted(starts, borders)
    if place is not None:
        starts = place[starts]
    ends = np.append(starts[1:], len(data))
    return starts, ends, span_hashes(data, starts, ends), offs_of


class Known:
    """Numbers by 64-bit piece hash. Nothing is lost: a sorted table, and one of late comers that is merged into it when it
    has grown; a direct-mapped cache of a fixed size before them spares most searches."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None, bits: int = 18):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start = (keys, values) if keys is not None else none
        self.mask = np.uint64((1 << bits) - 1)
        self.clear()

    def clear(self) -> None:
        """Forget all but the table given at the start (its keys ascend)."""
        self.tables = [self.start, (np.zeros(0, np.uint64), np.zeros(0, self.start[1].dtype))]
        self.cache = np.zeros(int(self.mask) + 1, np.uint64), np.full(int(self.mask) + 1, -1, np.int64)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])

    def _keep(self, hashes: np.ndarray, values: np.ndarray) -> None:
        slot = (hashes & self.mask).astype(np.int64)
        self.cache[0][slot], self.cache[1][slot] = hashes, -1  # of two that share a slot, the last one's key stays
        own = self.cache[0][slot] == hashes
        self.cache[1][slot[own]] = values[own]

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Number by hash, -1 if unknown."""
        slot = (hashes & self.mask).astype(np.int64)
        out = np.where(self.cache[0][slot] == hashes, self.cache[1][slot], -1)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            asked, back = np.unique(hashes[miss], return_inverse=True)
            found = np.full(len(asked), -1, np.int64)
            for keys, values in self.tables:
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    found = np.where(keys[at] == asked, values[at], found)
            out[miss] = found[back]
            self._keep(asked[found >= 0], found[found >= 0])
        return out

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Add numbers of unknown, ascending hashes."""
        self.tables[1] = self._merged(self.tables[1], (hashes, values))
        if len(self.tables[1][0]) > (1 << 14) + len(self.tables[0][0]) // 8:
            self.tables = [self._merged(*self.tables), (np.zeros(0, np.uint64), np.zeros(0, self.start[1].dtype))]
        self._keep(hashes, values)


def numbered(hashes: np.ndarray, known: Known, add) -> np.ndarray:
    """A number for each hash; add(places of the first of each unknown) gives the new numbers, in that order."""
    got = known.get(hashes)
    miss = np.flatnonzero(got < 0)
    if len(miss):
        fresh, at, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
        numbers = np.asarray(add(miss[at]), np.int64)
        known.put(fresh, numbers)
        got[miss] = numbers[back]
    return got
