"""Vectorised work on the bytes of many texts at once: words, lines, hashes and equality of byte ranges.

A range's hash is a polynomial over the prime 2**61 - 1, taken from running sums, so it costs the same for any length
and depends on the bytes alone. Where equality decides a result, ranges with equal hashes are compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
PRIME = (1 << 61) - 1
#: Base where hashes only prepare a comparison of bytes.
BASE = 0x0D6E8FEB86659FD9
#: Ranges beyond this many bytes are hashed whole, as their running sums could wrap.
LONG = 1 << 22
_P, _S61, _S32, _S29, _LOW32, _LOW29 = U64(PRIME), U64(61), U64(32), U64(29), U64((1 << 32) - 1), U64((1 << 29) - 1)

#: Word separators: space and the control characters 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for factors below it."""
    ah, al, bh, bl = a >> _S32, a & _LOW32, b >> _S32, b & _LOW32
    middle = ah * bl + al * bh
    low = al * bl
    # 2**64 is 8 and 2**61 is 1 modulo the prime
    return folded(((ah * bh) << U64(3)) + (middle >> _S29) + ((middle & _LOW29) << _S32) + (low & _P) + (low >> _S61))


def powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n of a base modulo the prime."""
    p = _powers.get(base, np.ones(1, np.uint64))
    if len(p) <= n:
        while len(p) <= n:
            p = np.concatenate([p, times(p, U64(pow(base, len(p), PRIME)))])
        if len(_powers) > 8:
            _powers.clear()
        _powers[base] = p
    return p[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread over all 64 bits."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(32)
    return x


class RangeHash:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray, base: int = BASE):
        self._buf = buf
        up, self._down = powers(base, len(buf))[:-1], powers(pow(base, -1, PRIME), len(buf))
        one = buf.astype(np.uint64) + U64(1)
        self._high, self._low = np.zeros(len(buf) + 1, np.uint64), np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(one * (up >> _S32), out=self._high[1:])
        np.cumsum(one * (up & _LOW32), out=self._low[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high = folded(self._high[ends] - self._high[starts])
        low = self._low[ends] - self._low[starts]
        total = folded((high >> _S29) + ((high & _LOW29) << _S32) + (low & _P) + (low >> _S61))
        out = times(total, self._down[starts])
        for k in np.flatnonzero(ends - starts > LONG).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self._buf[starts[k] : ends[k]], digest_size=8).digest(), "little") & PRIME
        return mixed(out)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros beyond the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether ranges of n bytes are equal; a and b are eights() of their buffers."""
    parts = np.maximum(-(-n // 8), 1)
    owner = np.repeat(np.arange(len(n)), parts)
    off = 8 * gather(np.zeros(len(n), np.int64), parts)
    rest = np.clip(n[owner] - off, 0, 8).astype(np.uint64)
    mask = np.where(rest < U64(8), (U64(1) << (rest * U64(8)) % U64(64)) - U64(1), ~U64(0))
    out = np.ones(len(n), bool)
    out[owner[((a[a_at[owner] + off] ^ b[b_at[owner] + off]) & mask) != 0]] = False
    return out


def distinct_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A member of each class of equal ranges (of one row, if rows are given), and each range's class.

    Hashes find the classes and bytes decide: ranges unlike their class's first form classes of their own.
    """
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    words8 = eights(buf)
    todo = np.flatnonzero(first[which] != np.arange(len(which)))
    while len(todo):
        lead = first[which[todo]]
        fine = ends[todo] - starts[todo] == ends[lead] - starts[lead]
        if rows is not None:
            fine &= rows[todo] == rows[lead]
        at = np.flatnonzero(fine)
        fine[at] = same_bytes(words8, starts[todo[at]], words8, starts[lead[at]], (ends - starts)[todo[at]])
        todo = todo[~fine]
        if len(todo):
            _, again, sub = np.unique(hashes[todo], return_index=True, return_inverse=True)
            which[todo] = len(first) + sub
            first = np.concatenate([first, todo[again]])
            todo = todo[first[which[todo]] != todo]
    return first, which


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross a row: starts and ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first[1:] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of every row."""
    return spans(~SEPARATOR[buf], offs)


def row_bounds(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index of the first range of each row, and their number at the end."""
    return np.searchsorted(starts, offs)


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines split at line feeds of every row: starts, ends and the row each belongs to; empty ones included."""
    breaks = np.flatnonzero(buf == 10)
    row_of_break = np.searchsorted(offs, breaks, side="right") - 1
    starts = np.concatenate([offs[:-1], breaks + 1])
    rows = np.concatenate([np.arange(len(offs) - 1), row_of_break])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, bool)
    ends[last] = offs[1:][rows[last]]
    return starts, ends, rows


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between one bound and the next; 0 for none."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i], starts[i] + 1, ... for lengths[i] places, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
