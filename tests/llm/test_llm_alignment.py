"""Token alignment against brute force over the two libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import alignment, queries


def brute(rows):
    """The contract's rows from the libraries, byte by byte."""
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    found, held = [], Counter()
    for doc_id, text in rows:
        groups, links = [], Counter()
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False)
            a_ids, b = a.ids, b_model.encode(text)
            a_bytes = [bytes(byte[c] for c in t) for t in a.tokens]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_model.id_to_piece(i)]]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                i = j = x = y = 0
                own = ([], [])
                while i < len(a_ids) or j < len(b):
                    if x <= y and i < len(a_ids) and (x < y or not own[0]):
                        own[0].append(a_ids[i])
                        x += len(a_bytes[i])
                        i += 1
                    else:
                        own[1].append(b[j])
                        y += len(b_bytes[j])
                        j += 1
                    if x == y:
                        groups.append(own)
                        own = ([], [])
                links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        held.update(links.keys())
        found.append((doc_id, groups, links))
    top: dict[int, int] = {}
    for (p, _), n in held.items():
        top[p] = max(top.get(p, 0), n)
    out = []
    for doc_id, groups, links in found:
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        n_best = sum(k for pair, k in links.items() if held[pair] == top[pair[0]])
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), n_best, sum(k * held[p] for p, k in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " ", "a", "<|endoftext|> is text here", "uses ▁ itself", "<0x41><s></s><unk>", "日本語の文章です。" * 20, "emoji 👩‍👩‍👧 and é́", "x\x00y", "\n\n  \t tabs", "aaaa" * 700, "zq" * 1500, "9" * 500]
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(200_000))] + ["the same words"] * 5
    rows = [(None if i % 50 == 7 else i % 290, t) for i, t in enumerate(texts)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block long, pairs string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_token_alignment(spark, str(tmp_path))
    assert got.columns == [f.split()[0] for f in alignment.ALIGNED.split(", ")]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_wide_groups_are_counted_before_they_are_paired(monkeypatch):
    rng = np.random.default_rng(2)
    in_a, in_b = np.array([0, 3, 40, 41]), np.array([0, 2, 50, 51])
    a, b, row = rng.integers(0, 9, 41), rng.integers(0, 7, 51), np.array([0, 0, 2])
    plain = alignment.linked(a, b, in_a, in_b, row, 63, 7)
    monkeypatch.setattr(alignment, "WIDE", 10)
    for x, y in zip(plain, alignment.linked(a, b, in_a, in_b, row, 63, 7), strict=True):
        assert x.tolist() == y.tolist()
    assert plain[2].sum() == 3 * 2 + 37 * 48 + 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
