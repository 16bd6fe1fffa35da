"""Vectorised work on Arrow string buffers: blocks, words and their hashes.

All functions take whole texts. A batch is cut between rows into blocks of about `BLOCK` bytes so
that the scratch arrays stay small; a longer text is a block of its own.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte; in the folded ones capital ASCII letters share those of the small ones.
_EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)

#: Bytes of words: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.type in (pa.large_string(), pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs


def blocks(offs: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `size` bytes, at least one row each."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + size, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n + 1:
        size = max(n + 1, BLOCK + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if size > 8 * BLOCK:
            return up, down
        _POWERS, _INVERSES = up, down
    return _POWERS, _INVERSES


#: Bytes from which a span is hashed by BLAKE2b: sums modulo 2**64 collide, whatever their base, on long spans
#: of a known kind (the Thue-Morse word of 2,048 letters and its complement).
LONG_SPAN = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (with `fold`, whatever the case of ASCII letters): differences
    of one running polynomial sum, and BLAKE2b of long spans."""
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_FOLDED if fold else _EXACT)[data] * up[: len(data)], out=total[1:])
    out = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        raw = data[starts[i] : ends[i]]
        out[i] = int.from_bytes(hashlib.blake2b((LOWER[raw] if fold else raw).tobytes(), digest_size=8).digest(), "little")
    return out


def word_flags(data: np.ndarray, unicode_marks: bool = False) -> np.ndarray:
    """Which bytes belong to words. With `unicode_marks`, punctuation and spaces of Latin-1, General
    Punctuation and the CJK symbols block separate words too; else only ASCII does."""
    flags = WORD[data]
    if unicode_marks and len(data) and data.max() >= 0xC2:
        lead = np.flatnonzero((data == 0xC2) | (data == 0xE2) | (data == 0xE3))
        lead = lead[lead + 2 < len(data)]
        first, second = data[lead], data[lead + 1]
        two = lead[(first == 0xC2) & ~np.isin(second, (0xAA, 0xB5, 0xBA))]
        three = lead[((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80))]
        for at, n in ((two, 2), (three, 3)):
            for k in range(n):
                flags[at + k] = False
    return flags


#: First and last code points of scripts that are written without spaces: Thai and Lao, Tibetan, Myanmar,
#: Khmer, Tai and Balinese, CJK and kana, Javanese, Myanmar Extended, Tai Viet, compatibility and half-width forms.
UNSPACED = (
    (0xE00, 0xEFF), (0xF00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x312F), (0x31A0, 0x31BF),
    (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9DF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 1 for punctuation, spaces and full-width symbols, 2 for a letter, mark or number of
    the scripts of UNSPACED, else 0."""
    kinds = np.zeros(0x110000, np.uint8)
    for a, b in UNSPACED:
        kinds[a : b + 1] = 2
    for c in range(0x80, 0x10000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "PZ" or (kind == "S" and (0xFF00 <= c < 0xFFF0 or kinds[c] == 2)) or c == 0xFEFF:
            kinds[c] = 1
    return kinds


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `words` with `unicode_marks`, but punctuation of every script separates, and each character of a
    script without spaces is a word of its own."""
    flags = word_flags(data, unicode_marks=True)
    own: list[np.ndarray] = []
    if len(data) and data.max() >= 0xC2:
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        for n, low, high in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
            lead = np.flatnonzero((data >= low) & (data <= high))
            code = padded[lead] & (0x7F >> n)
            for k in range(1, n):
                code = code << 6 | padded[lead + k] & 0x3F
            kind = _kinds()[np.minimum(code, 0x10FFFF)]
            for k in range(n):
                flags[lead[kind == 1] + k] = False
                flags[lead[kind == 2] + k] = True
            own += [lead[kind == 2], lead[kind == 2] + n]
    return _spans(flags, offs, np.concatenate([offs, *own]))


def words(data: np.ndarray, offs: np.ndarray, unicode_marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of consecutive texts, and each text's first word's number.

    data: the texts' bytes; offs: their bounds in it, from 0 to len(data)."""
    return _spans(word_flags(data, unicode_marks), offs, offs)


def runs_of(flags: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `words`, of the flagged bytes."""
    return _spans(flags, offs, offs)


def _spans(flags: np.ndarray, offs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the flagged runs, which end at `bounds`, and each text's first run's number."""
    before, after = np.empty(len(flags), bool), np.empty(len(flags), bool)
    if len(flags):
        before[0] = after[-1] = False
        before[1:], after[:-1] = flags[:-1], flags[1:]
        inner = bounds[(bounds > 0) & (bounds < len(flags))]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(flags & ~before)
    ends = np.flatnonzero(flags & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1, one span after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)
