"""Byte-pair encoding and decoding with a pair occurrence index.

A batch of texts is cut into pre-tokens by vectorised character classes. Its distinct pre-tokens
become one symbol array; an index maps each adjacent pair to all its positions there, and the
active ranks are applied in ascending order, each merge updating the lists of the pairs beside it.
Ids, their decimal digests and the decoded bytes are gathered with numpy.

The vocabulary file's path is a parameter; executors open it themselves, so it must be installed
on every node, as the tokenizers package is.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_in_arrow
from lodestone.llm.textbytes import blocks, expand, mix, span_hashes, text_buffer

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SPACE, LETTER, NUMBER, OTHER = range(4)
_CACHE_WORDS = 400_000


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point: white space, letter, number or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


def pretokens(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted byte positions at which a pre-token of the byte-level pattern begins in consecutive texts.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)  # of texts, by character
    first[np.searchsorted(lead, offs)] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    ends_run = np.ones(n, bool)
    ends_run[:-1] = start[1:]
    # The last character of white space before something else stands alone or, a blank, joins what follows.
    last_space = space & ends_run & ~first[1:]
    blank = last_space & (points == 32)
    after = np.flatnonzero(blank) + 1
    start[after] = False
    start[last_space] = True
    # Contractions: a lone apostrophe that no blank precedes, at the start of its own run.
    mark = np.flatnonzero((points == 39) & start & ends_run & ~first[1:])
    if len(mark):
        one = points[np.minimum(mark + 1, n - 1)]
        two = points[np.minimum(mark + 2, n - 1)]
        room = ~first[np.minimum(mark + 2, n)] & (mark + 2 < n)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = room & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        for hit, size in ((mark[short], 2), (mark[long & ~short], 3)):
            start[hit + 1] = False
            rest = hit + size
            rest = rest[rest < n]
            start[rest] = True
    return lead[start]


class Vocabulary:
    """The tables of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        back = {c: b for b, c in shown.items()}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = size
        self.byte_id = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        left, right = np.array([vocab[a] for a, _ in merges], np.int64), np.array([vocab[b] for _, b in merges], np.int64)
        self.left, self.right, self.made = left, right, np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left * size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.piece_size = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.concatenate(([0], np.cumsum(self.piece_size)))[:-1]
        self.pieces = np.frombuffer(b"".join(pieces), np.uint8)
        digits = [b"%d," % i for i in range(size)]
        self.digit_size = np.array([len(d) for d in digits], np.int64)
        self.digit_at = np.concatenate(([0], np.cumsum(self.digit_size)))[:-1]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)

    def merge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive distinct words and each word's bounds in them.

        data: the words' bytes; bounds: their limits, from 0 to len(data)."""
        n = len(data)
        sym = np.empty(n + 1, np.int32)
        sym[:n], sym[n] = self.byte_id[data], -1
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[bounds[1:] - 1] = n  # n is the wall on either side of a word
        prv[bounds[:-1]] = n
        nxt[n] = prv[n] = n
        rank = self.ranks(sym[:n], sym[nxt[:n]])
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        active, cut = np.unique(rank[at], return_index=True)
        index = {int(r): [p] for r, p in zip(active, np.split(at, cut[1:]), strict=len(at) > 0)}
        heap = [int(r) for r in active]
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, made = self.left[r], self.right[r], self.made[r]
            right = nxt[pos]
            ok = (sym[pos] == a) & (sym[right] == b)
            pos, right = pos[ok], right[ok]
            if a == b and len(pos) > 1:
                pos = np.sort(pos)
                right = nxt[pos]
                touch = pos[1:] == right[:-1]
                if touch.any():  # in a run of the same symbol every other pair merges, from its left
                    run = np.arange(len(pos)) - np.maximum.accumulate(np.where(np.concatenate(([True], ~touch)), np.arange(len(pos)), 0))
                    pos, right = pos[run % 2 == 0], right[run % 2 == 0]
            if not len(pos):
                continue
            after, before = nxt[right], prv[pos]
            sym[pos] = made
            sym[right] = -1
            nxt[pos] = after
            prv[after] = pos
            nxt[n] = prv[n] = n
            left_rank = self.ranks(sym[before], sym[pos])
            right_rank = self.ranks(sym[pos], sym[nxt[pos]])
            where = np.concatenate((before[left_rank >= 0], pos[right_rank >= 0]))
            new = np.concatenate((left_rank[left_rank >= 0], right_rank[right_rank >= 0]))
            if len(new):
                by = np.argsort(new, kind="stable")
                new, where = new[by], where[by]
                kinds, cut = np.unique(new, return_index=True)
                for k, p in zip(kinds.tolist(), np.split(where, cut[1:]), strict=True):
                    if k in index:
                        index[k].append(p)
                    else:
                        index[k] = [np.unique(p)]
                        heapq.heappush(heap, k)
        keep = np.flatnonzero(sym[:n] >= 0)
        return sym[keep], np.searchsorted(keep, bounds)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids' pieces, one after another."""
        return self.pieces[expand(self.piece_at[ids], self.piece_size[ids])]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches; remembers the ids of distinct pre-tokens between batches, up to a bound."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.at, self.n = [np.zeros(0, np.int32)], np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pooled = 0

    def _learn(self, hashes: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> None:
        ids, cut = self.vocab.merge(data, bounds)
        slots = np.arange(len(self.at), len(self.at) + len(hashes))
        self.at, self.n = np.concatenate((self.at, self.pooled + cut[:-1])), np.concatenate((self.n, np.diff(cut)))
        self.pool.append(ids)
        self.pooled += len(ids)
        known, slot = np.concatenate((self.known, hashes)), np.concatenate((self.slot, slots))
        order = np.argsort(known)
        self.known, self.slot = known[order], slot[order]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, ids, bounds, decoded) for consecutive row ranges: the ids of texts a..b-1, their
        bounds, and the bytes they decode to. Each pre-token's ids are held against its bytes."""
        if len(self.known) > _CACHE_WORDS:
            self._forget()
        parts, fresh = [], {"h": [], "size": [], "data": []}
        seen = self.known
        for a, b in blocks(offs):
            data = buf[offs[a] : offs[b]]
            own = offs[a : b + 1] - offs[a]
            special = self._special(data, own)
            limits = own if special is None else np.union1d(own, np.concatenate((special[0], special[1])))
            start = pretokens(data, limits)
            if special is not None:  # a control token is one pre-token, whatever is in it
                inside = np.searchsorted(special[0], start, "right") - 1
                start = start[(inside < 0) | (start >= special[1][inside]) | (start == special[0][inside])]
            end = np.append(start[1:], len(data)) if len(start) else start
            h = span_hashes(data, start, end, fold=False)
            if special is not None:
                where = np.searchsorted(start, special[0])
                h[where] = mix(np.array(special[2], np.uint64))
            u, pick, code = np.unique(h, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(seen, u), max(len(seen) - 1, 0))
            new = np.flatnonzero(seen[at] != u) if len(seen) else np.arange(len(u))
            if len(new):
                s, size = start[pick[new]], end[pick[new]] - start[pick[new]]
                fresh["h"].append(u[new])
                fresh["size"].append(size)
                fresh["data"].append(data[expand(s, size)])
                seen = np.sort(np.concatenate((seen, u[new])))
            parts.append((a, b, u, code.astype(np.int32), (end - start).astype(np.int32), np.searchsorted(start, own), special))
        if fresh["h"]:
            h, size = np.concatenate(fresh["h"]), np.concatenate(fresh["size"])
            self._learn(h, np.concatenate(fresh["data"]), np.concatenate(([0], np.cumsum(size))))
        pool = self.pool = [np.concatenate(self.pool)]
        for a, b, u, code, length, cut, special in parts:
            data, own = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            slot = self.slot[np.searchsorted(self.known, u)][code]
            size = self.n[slot]
            ids = pool[0][expand(self.at[slot], size)]
            bounds = np.concatenate(([0], np.cumsum(size)))
            if not self._spells(ids, bounds, length, data):
                ids, bounds = self._by_bytes(data, length)
            if special is not None:
                ids, bounds, cut = self._put(ids, bounds, cut, data, own, special)
            yield a, b, ids, bounds[cut], self.vocab.decode_bytes(ids)

    def _spells(self, ids: np.ndarray, bounds: np.ndarray, length: np.ndarray, data: np.ndarray) -> bool:
        """Whether each pre-token's ids decode to its own bytes, so that no hash stood for two pre-tokens."""
        ends = np.concatenate(([0], np.cumsum(self.vocab.piece_size[ids])))[bounds]
        return np.array_equal(np.diff(ends), length) and np.array_equal(self.vocab.decode_bytes(ids), data)

    def _by_bytes(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bounds of consecutive pre-tokens, told apart by their bytes instead of hashes."""
        raw, end, kinds = data.tobytes(), np.cumsum(length), {}
        code = np.array([kinds.setdefault(raw[i:j], len(kinds)) for i, j in zip((end - length).tolist(), end.tolist(), strict=True)], np.int64)
        ids, cut = self.vocab.merge(np.frombuffer(b"".join(kinds), np.uint8), np.concatenate(([0], np.cumsum([len(k) for k in kinds]))))
        size = np.diff(cut)[code]
        return ids[expand(cut[:-1][code], size)], np.concatenate(([0], np.cumsum(size)))

    def _special(self, data: np.ndarray, own: np.ndarray):
        """Starts, ends and ids of control tokens in the texts, or None."""
        if self.vocab.split is None or not any(bytes(s, "utf-8") in data.tobytes() for s in self.vocab.special):
            return None
        found = []
        for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
            text = data[a:b].tobytes()
            if any(bytes(s, "utf-8") in text for s in self.vocab.special):
                plain = text.decode()
                for m in self.vocab.split.finditer(plain):
                    at = a + len(plain[: m.start()].encode())
                    found.append((at, at + len(m[0].encode()), self.vocab.special[m[0]]))
        if not found:
            return None
        return tuple(np.array(x, np.int64) for x in zip(*found, strict=True))

    def _put(self, ids, bounds, cut, data, own, special):
        """Replace the pieces that stand for control tokens by their ids."""
        start = pretokens(data, np.union1d(own, np.concatenate((special[0], special[1]))))
        inside = np.searchsorted(special[0], start, "right") - 1
        start = start[(inside < 0) | (start >= special[1][inside]) | (start == special[0][inside])]
        where = np.searchsorted(start, special[0])
        pieces, sizes = [], np.diff(bounds)
        last = 0
        for w, i in zip(where.tolist(), special[2].tolist(), strict=True):
            pieces += [ids[bounds[last] : bounds[w]], np.array([i], np.int32)]
            sizes[w], last = 1, w + 1
        pieces.append(ids[bounds[last] :])
        return np.concatenate(pieces), np.concatenate(([0], np.cumsum(sizes))), cut


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for a, b, ids, bounds, decoded in encoder.encode(buf, offs):
                n = np.diff(bounds)
                v = encoder.vocab
                digits = v.digits[expand(v.digit_at[ids], v.digit_size[ids])].tobytes()
                text = decoded.tobytes()
                d = np.concatenate(([0], np.cumsum(v.digit_size[ids])))[bounds].tolist()
                t = np.concatenate(([0], np.cumsum(v.piece_size[ids])))[bounds].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array([hashlib.sha256(digits[i : max(i, j - 1)]).hexdigest() for i, j in zip(d[:-1], d[1:], strict=True)]),
                        pa.array([hashlib.sha256(text[i:j].decode(errors="replace").encode()).hexdigest() for i, j in zip(t[:-1], t[1:], strict=True)]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def encode_digests(documents: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`ENCODED`: per row its number of tokens and the SHA-256 of its decimal ids joined by commas and
    of its decoded text. Null text is empty (no tokens); rows that repeat are each encoded; ids may
    be null; other columns are ignored; an empty table gives no rows."""
    return map_in_arrow(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), _encoded(vocabulary_path), ENCODED)


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for a, b, ids, bounds, _ in encoder.encode(buf, offs):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return run


def encode(documents: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id long, ids array<int>: the token ids of every text; nulls as in `encode_digests`."""
    return map_in_arrow(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), _ids(vocabulary_path), "doc_id long, ids array<int>")


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            out = [None if ids is None else vocab.decode_bytes(np.array(ids, np.int64)).tobytes().decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id long, text string of rows of ids; control tokens are written out, null ids stay null."""
    return map_in_arrow(encoded.select("doc_id", "ids"), _texts(vocabulary_path), "doc_id long, text string")
