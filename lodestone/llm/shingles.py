"""Sets of word shingles and their MinHash values."""

from __future__ import annotations

import numpy as np

from lodestone.llm.textbytes import mix, span_hashes, words

SIZE = 5
HASHES = 256
_rng = np.random.Generator(np.random.PCG64(11))
_PLACE = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of 1 to size - 1 words is one shingle.

    Words are told apart as in `words` with Unicode marks; ASCII case does not count."""
    start, end, cut = words(data, offs, unicode_marks=True)
    h = span_hashes(data, start, end)
    n = len(h)
    total = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        total += h[k : n - size + 1 + k] * _PLACE[k] if len(total) else np.uint64(0)
    total = mix(total)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(total[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix((h[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """HASHES values: the least of each multiplicative hash of the set's high halves."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(out, (x[i : i + 512, None] * _FACTORS).min(0), out=out)
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """16 bytes that tell sets apart: two independent sums over their members."""
    a = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    b = mix(shingles * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return a.tobytes() + b.tobytes()
