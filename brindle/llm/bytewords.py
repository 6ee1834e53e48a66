"""Words of whole Arrow text columns as flat numpy arrays, without a Python object per word.

A word is a run of letters and digits: ASCII ones, or any byte of a non-ASCII character other than Latin-1 signs,
general punctuation and CJK punctuation. Every character of three or more bytes from U+3000 on is a word of its own, so
that scripts without spaces yield words too. Case is folded for ASCII, Latin-1, basic Greek and basic Cyrillic, which
keeps byte lengths. Null texts count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words; wraps around."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        m = max(n, CHUNK) + 1
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(m, base, U64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=U64))
        _powers[:] = tables
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    power, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each in them; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(texts) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(data: np.ndarray, off: np.ndarray, most: int = CHUNK):
    """Cut the rows into runs of about ``most`` bytes: (first byte, last byte, offsets within, row of each piece).

    A row above ``most`` bytes is cut where a space stands, so that no word is cut; a run without any space stays whole.
    """
    bounds, rows = [0], []
    sizes = np.diff(off)
    start = 0
    for row in [*np.flatnonzero(sizes > most), len(sizes)]:
        if row > start:  # whole rows, grouped by bytes
            group = ((off[start:row] - off[start]) // most).astype(np.int64)
            cuts = [start, *(np.flatnonzero(np.diff(group)) + start + 1), row]
            for a, b in zip(cuts, cuts[1:]):
                yield off[a], off[b], off[a : b + 1] - off[a], np.arange(a, b)
        if row < len(sizes):
            at, end = off[row], off[row + 1]
            while at < end:
                cut = min(at + most, end)
                if cut < end:
                    back = np.flatnonzero(SPACE[data[at + 1 : cut]])
                    if len(back):
                        cut = at + 1 + back[-1]
                    else:
                        ahead = np.flatnonzero(SPACE[data[cut:end]])
                        cut = cut + ahead[0] if len(ahead) else end
                yield at, cut, np.array([0, cut - at]), np.array([row])
                at = cut
        start = row + 1


def _shift(mask: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(mask)
    out[by:] = mask[:-by]
    return out


def fold(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Folded bytes, the mask of word bytes, the mask of bytes at which a new word must begin, and of capitals."""
    low, word, new = LOWER[raw], WORD[raw], None
    capital = (raw >= 65) & (raw <= 90)
    if not len(raw) or raw.max() < 128:
        return low, word, new, capital
    before = np.zeros_like(raw)
    before[1:] = raw[:-1]
    for lead, first, last, lead2, by in ((0xC3, 0x80, 0x9E, 0xC3, 32), (0xCE, 0x91, 0x9F, 0xCE, 32), (0xCE, 0xA0, 0xA9, 0xCF, -32), (0xD0, 0x90, 0x9F, 0xD0, 32), (0xD0, 0xA0, 0xAF, 0xD1, -32)):
        at = np.flatnonzero((before == lead) & (raw >= first) & (raw <= last))
        if len(at):
            low[at] = (raw[at].astype(np.int16) + by).astype(np.uint8)
            low[at - 1] = lead2
            capital[at - 1] = True
    sign = raw == 0xC2
    if sign.any():
        word &= ~(sign | _shift(sign, 1))
    if raw.max() >= 0xE2:
        nxt = np.zeros_like(raw)
        nxt[:-1] = raw[1:]
        mark = ((raw == 0xE2) & (nxt <= 0x81)) | ((raw == 0xE3) & (nxt == 0x80))
        if mark.any():
            word &= ~(mark | _shift(mark, 1) | _shift(mark, 2))
        wide = (raw >= 0xE3) & (raw <= 0xEF)
        if wide.any():
            new = wide | _shift(wide, 3)
    return low, word, new, capital


def spans(word: np.ndarray, off: np.ndarray, new: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words each row has."""
    n = len(word)
    head = off[:-1][off[:-1] < n]
    fresh = np.ones(n, bool)
    fresh[1:] = ~word[:-1]
    fresh[head] = True
    if new is not None:
        fresh |= new
    stop = np.ones(n, bool)
    stop[:-1] = fresh[1:] | ~word[1:]
    starts, ends = np.flatnonzero(word & fresh), np.flatnonzero(word & stop) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


@dataclass
class Words:
    """Word hashes of all rows in order; ``ptr[i]:ptr[i + 1]`` are those of row i."""

    hashes: np.ndarray
    ptr: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def words(texts: pa.Array) -> Words:
    """The folded words of every text as hashes."""
    data, off = utf8(texts)
    hashes, counts = [np.zeros(0, U64)], np.zeros(len(off) - 1, np.int64)
    for a, b, inner, rows in pieces(data, off):
        low, word, new, _ = fold(data[a:b])
        s, e, n = spans(word, inner, new)
        hashes.append(span_hashes(low, s, e))
        np.add.at(counts, rows, n)
    return Words(np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)]))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words; a row of fewer words, but some, has one run of all its words."""
    n = np.diff(w.ptr)
    h = w.hashes.copy()
    room = len(h) - size + 1
    if room > 0:
        total = np.zeros(room, U64)
        for k in range(size):
            total = total * U64(0x100000001B3) + h[k : k + room]
        total = mix(total)
    rows = w.rows
    inside = np.zeros(len(h), bool)
    if room > 0:
        inside[:room] = rows[:room] == rows[size - 1 :]
    at = np.flatnonzero(inside)
    out, owner = (total[at] if room > 0 else np.zeros(0, U64)), rows[at]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        extra = np.array([_fold_few(h[w.ptr[r] : w.ptr[r + 1]]) for r in few], U64)
        out, owner = np.concatenate([out, mix(extra)]), np.concatenate([owner, few])
    return out, owner


def _fold_few(h: np.ndarray) -> int:
    total = len(h)
    for x in h.tolist():
        total = (total * 0x100000001B3 + x) & 0xFFFFFFFFFFFFFFFF
    return total


def row_slices(texts: pa.Array, most: int = 1 << 21, rows: int = 1 << 13):
    """Consecutive slices of the column with about ``most`` bytes and at most ``rows`` rows each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, off = utf8(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(off, off[start] + most, side="right")) - 1
        stop = max(start + 1, min(stop, start + rows, len(texts)))
        yield texts.slice(start, stop - start)
        start = stop
