"""The registered queries themselves, over tables with nulls, ties, repeats, long rows and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from lodestone.llm import licenses, toxicity  # noqa: E402
from lodestone.llm.queries import ORACLE_SQL, QUERIES, VOCABULARY, vocabulary_path  # noqa: E402

LONG = "long words that go on " * 60_000


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables of every kind of odd row; the rows that were written, by table."""
    at, rnd = tmp_path_factory.mktemp("tables"), random.Random(17)
    clean = ["table", "window", "garden", "river", "music", "yellow", "people", "market", "winter", "pencil", "coffee", "bridge", "street", "summer", "letter"]
    other = ["tisch", "fenster", "garten", "fluss", "musik", "gelb", "leute", "markt", "winterzeit", "stift", "kaffee", "bruecke"]
    docs = []
    for i in range(400):
        lang, words = ("en", clean) if i % 2 else ("de", other)
        w = rnd.choices(words, k=rnd.randint(8, 90))
        toxic = i % 5 == 0
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(["dunderhead", "numbskull"])
        docs.append((i, " ".join(w), lang, toxic))
    item = " ".join(f"item{k}" for k in range(15))
    docs += [(1000 + i, t, lang, False) for i, (t, lang) in enumerate([
        (None, None), ("", "en"), ("...", None), ("x", "en"), (LONG, "en"), (f"so {item} it is", "en"), ("The MIT License and the mit-license, GENERAL public License", "en"), ("<|endoftext|> a <|endoftext|>", "en"), ("\u00e9t\u00e9 \u4f60\u597d \U0001f600 \u200b", None)])]
    docs += [(7, docs[7][1], "en", False), (7, "coffee bridge street summer letter pencil winter", "en", False), (None, docs[9][1], "en", False), (None, "yellow window garden river music people market", "en", False), (-5, "below nought", "en", False)]
    rows = {
        "documents": [(i, t, lang, "s", len(t or ""), 3, "k") for i, t, lang, _ in docs],
        "labels": [(i, 1, int(tox)) for i, _, _, tox in docs[:400]] + [(None, 1, 1), (3, None, None), (99_999, 0, 1)],
        "benchmark": [(1, item), (2, None), (None, "nothing"), (3, "")],
        "conversations": [(c, t, rnd.choice(["user", "assistant", None, "sys\ntem"]), rnd.choice(["hi", None, "", "<|im_end|>", "a\n<\\|im_start|>b", "y" * 3000])) for c in (1, 2, None, 5) for t in (0, 1, 1, None, 2)],
        "pages": [(i, f"u{i}", h) for i, h in enumerate(["<p>a</p>", None, "", "<p>a</p>", "\u00e9" * 400_000, "WARC/1.1\r\n"])] + [(0, "u", "<p>a</p>"), (None, None, "<p>a</p>"), (-3, "u", "<p>only</p>")],
        "embeddings": [(i, [float(x) for x in np.random.default_rng(i).normal(0, 0.4, 6)]) for i in range(120)] + [(150, None), (200, [float("nan")] * 6), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [0.1] * 6), (121, [0.2] * 6), (122, [0.2] * 6), (123, [])],
    }
    schema = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long, score long, labels string", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string",
        "conversations": "conv_id long, turn long, role string, text string", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<double>",
    }
    for name, own in rows.items():
        spark.createDataFrame(own, schema[name]).repartition(3).write.parquet(f"file://{at}/full/{name}.parquet")
        spark.createDataFrame([], schema[name]).write.parquet(f"file://{at}/none/{name}.parquet")
    return f"file://{at}", rows


@pytest.fixture(scope="module")
def run(spark, tables):
    return lambda name: QUERIES[name](spark, f"{tables[0]}/full").collect()


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def texts(tables):
    return [(r[0], r[1]) for r in tables[1]["documents"]]


def test_empty_tables_give_no_rows(spark, tables):
    for name, query in QUERIES.items():
        n = query(spark, f"{tables[0]}/none").count()
        assert n == (1 if name.startswith("op1_") else 0), name  # conversation -1 is always there
    assert corpus_pipeline.run(spark, f"{tables[0]}/none").count() == 0


def test_op1(tables, run):
    rows = tables[1]["conversations"] + [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    want = []
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=key)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        want.append((c, len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    same([(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in run("op1_chat_format")], want)


def test_op2(tables, run):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    want = []
    for i, t in texts(tables):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    rows = run("op2_license_scan")
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows], want)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def test_op4_and_op5(tables, run):
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in texts(tables)]
    same([(r.doc_id, r.n_tokens) for r in run("op4_token_counts")], [(i, len(x)) for i, x in ids])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run("op5_bpe")], [(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids])


def test_op6_flags_held_out_toxic_rows_and_no_others(tables, run):
    label = {i: y for i, _, y in tables[1]["labels"] if y is not None}
    rows = run("op6_toxicity")
    same([(r.doc_id, r.held_out) for r in rows], [(i, i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in texts(tables)])
    asked = [r for r in rows if r.held_out and r.doc_id in label]
    assert len(asked) > 50 and sum(r.predicted == label[r.doc_id] for r in asked) >= 0.97 * len(asked)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == 0 for r in rows if r.doc_id is None or r.doc_id >= 1000)


def test_op6_scores_equal_the_kernel_expansion(spark, tables):
    """Each text's score against sum(beta k(x, landmark)) over its units, by the kernel's plain values."""
    docs, labels = (spark.read.parquet(f"{tables[0]}/full/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    marks, mark = [bytes(m) for m in model.landmarks], bytes([toxicity.MARK])
    for r in toxicity.score(docs.filter("doc_id between 10 and 40"), model).join(docs.select("doc_id", "text"), "doc_id").collect():
        units = [mark + w.encode() for w in r.text.split()]
        assert all(len(u) <= toxicity.WIDTH for u in units)
        margin = toxicity.gram(units, marks) @ np.asarray(model.beta) + model.bias
        rate = (margin >= model.cut).sum() / max(len(units), toxicity.FLOOR)
        assert r.score == pytest.approx(float(model.score(np.array([margin.max()]), np.array([rate]))[0]), abs=1e-3)


def test_op7(tables, run):
    same([(r.doc_id, r.item_id, r.first_word, r.distance) for r in run("op7_decontaminate")], [(1005, 1, 1, 0)])


def test_op8_against_all_pairs(tables, run):
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, x in tables[1]["embeddings"] if i is not None and x and None not in x and np.isfinite(x).all()}
    want = [(q, n + 1, j, -s) for q in v if q % 50 == 0 for n, (s, j) in enumerate(sorted((-int(v[q] @ v[j]), j) for j in v if j != q)[:5])]
    same([(r.query_id, r["rank"], r.vec_id, r.score) for r in run("op8_top_k")], want)
    assert "op8_top_k" in ORACLE_SQL


def test_op9(tables, run):
    lang = {r[0]: r[2] for r in tables[1]["documents"]}
    rows = run("op9_language_id")
    same([(r.doc_id, r.held_out) for r in rows], [(i, i is None or zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in texts(tables)])
    asked = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 400 and r.doc_id != 7]
    assert len(asked) > 60 and all(r.lang_pred == lang[r.doc_id] for r in asked)
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (1000, 1001, 1002)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in rows)


def test_op10(tables, run):
    first, want = {}, []
    for i, _, h in tables[1]["pages"]:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in tables[1]["pages"]:
        raw, original = (h or "").encode(), first.get(h or "")
        kind = ("response", None) if original is None or original == i else ("revisit", original)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *kind))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run("op10_warc")], want)


def test_op3_and_the_whole_pipeline(spark, tables, run):
    rows = run("op3_ngram_jaccard")
    assert len(rows) == len(tables[1]["documents"])
    assert {r.class_size for r in rows if r.doc_id == 9} == {2} and {r.group_id for r in rows if r.doc_id == 9} == {9}
    out = corpus_pipeline.run(spark, f"{tables[0]}/full").collect()
    gone = {1000, 1001, 1002, 1005} | {i for i, _, y in tables[1]["labels"] if y == 1 and i is not None}
    kept = [r.doc_id for r in out]
    assert not gone & set(kept) and kept.count(7) == 2 and kept.count(None) == 1 and len(out) > 310
    library = Tokenizer.from_file(vocabulary_path())
    sizes = {}
    for i, t in texts(tables):
        sizes.setdefault(i, set()).add(len(library.encode(t or "", add_special_tokens=False).ids))
    assert all(r.n_tokens in sizes[r.doc_id] for r in out)
