"""Near-duplicates, decontamination, toxicity, language ID and the pipeline on small fixtures."""

import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from lodestone.llm import components, decontaminate, jaccard, langid, shingles, toxicity  # noqa: E402
from lodestone.llm.textbytes import text_buffer, words  # noqa: E402


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, bucket string")


def sets_of(texts):
    buf, offs = text_buffer(pa.array(texts, pa.string()))
    return [set(s.tolist()) for s in shingles.shingle_sets(buf[offs[0] : offs[-1]], offs - offs[0])]


def varied(rnd, base, n, rate):
    out = []
    for _ in range(n):
        w = list(base)
        for i in range(len(w)):
            if rnd.random() < rate:
                w[i] = f"w{rnd.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


# ---- near-duplicates ---------------------------------------------------------------------------


def expected(texts):
    s = sets_of(texts)
    key = [frozenset(x) if x else ("empty", i) for i, x in enumerate(s)]
    cls = {}
    for i, k in enumerate(key):
        cls.setdefault(k, i)
    size = {v: sum(1 for k in key if cls[k] == v) for v in cls.values()}
    reps = [v for k, v in cls.items() if not isinstance(k, tuple)]
    links = {v: [] for v in cls.values()}
    for a, b in combinations(reps, 2):
        n = len(s[a] & s[b])
        if n * 5 >= 4 * (len(s[a]) + len(s[b]) - n):
            links[a].append(b)
            links[b].append(a)
    group = {v: v for v in links}
    for _ in links:
        for a in links:
            for b in links[a]:
                group[a] = group[b] = min(group[a], group[b])
    return {i: (cls[k], size[cls[k]], len(links[cls[k]]), sum(size[b] for b in links[cls[k]]), group[cls[k]]) for i, k in enumerate(key)}


def fixture(seed=2):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    texts = [None, "", "...", "one", "one two three", "One, two three!", "a b c d e"]
    for _ in range(12):
        base = rnd.choices(vocab, k=rnd.randint(20, 300))
        texts += varied(rnd, base, 6, 0.01) + varied(rnd, base, 4, 0.04) + [" ".join(base)] * 3
    texts += [" ".join(rnd.choices(vocab, k=60)) for _ in range(30)]
    shared = rnd.choices(vocab, k=55)
    texts += [" ".join(rnd.choices(vocab, k=120) + shared) for _ in range(10)]
    return texts


@pytest.mark.parametrize("blocks", [{}, {"block_texts": 3, "block_shingles": 400}])
def test_join_matches_brute_force(spark, blocks):
    texts = fixture()
    want = expected(texts)
    got = {r.doc_id: (r.class_id, r.class_size, r.n_links, r.n_linked_docs, r.group_id) for r in jaccard.join(docs(spark, texts), **blocks).collect()}
    assert got == want
    assert sum(v[2] for v in want.values()) > 100


def test_join_on_odd_tables(spark):
    assert jaccard.join(docs(spark, ["a"]).limit(0)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.class_size, r.group_id) for r in jaccard.join(df).collect()}
    assert got == {(1, 1, 3, 1), (None, 1, 3, 1), (None, None, 1, None), (2, 2, 1, 2)}


def test_join_finds_links_of_repeated_and_null_ids(spark):
    rnd = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    rows, texts = [], fixture(6)
    for i, t in enumerate(texts):
        rows += [((None, i, i % 20, 5)[rnd.randrange(4)], t) for _ in range(rnd.choice((1, 1, 2)))]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    sets = sets_of([t for _, t in rows])
    key = [frozenset(x) if x else ("empty", n) for n, x in enumerate(sets)]
    of = {}
    for n, k in enumerate(key):
        of.setdefault(k, []).append(n)
    least = lambda ns: min((rows[n][0] for n in ns if rows[n][0] is not None), default=None)
    real = [k for k in of if not isinstance(k, tuple)]
    links = {k: [] for k in of}
    for a, b in combinations(real, 2):
        if len(a & b) * 5 >= 4 * len(a | b):
            links[a].append(b)
            links[b].append(a)
    group = {}
    for k in of:
        if k not in group:
            stack, seen = [k], {k}
            while stack:
                for x in links[stack.pop()]:
                    if x not in seen:
                        seen.add(x)
                        stack.append(x)
            for x in seen:
                group[x] = seen
    want = sorted((str(rows[n][0]), str(least(of[k])), len(of[k]), len(links[k]), sum(len(of[x]) for x in links[k]), str(least([m for x in group[k] for m in of[x]]))) for n, k in enumerate(key))
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.n_links, r.n_linked_docs, str(r.group_id)) for r in jaccard.join(df).collect())
    assert got == want
    kept = sorted(r.n for r in jaccard.keep_one(df).collect())
    groups = {id(g): g for g in group.values()}.values()
    assert len(kept) == len(groups)
    for g in groups:
        mine = [n for k in g for n in of[k] if n in kept]
        assert len(mine) == 1 and rows[mine[0]][0] == least([n for k in g for n in of[k]])


def test_texts_that_polynomial_hashes_confuse_are_no_copies(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    got = jaccard.join(docs(spark, [f"{a} one two three four", f"{b} one two three four"])).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(0, 1), (1, 1)}


def test_keep_one_keeps_the_least_of_each_group(spark):
    texts = fixture(4)
    want = {i for i, v in expected(texts).items() if v[4] == i}
    rows = docs(spark, texts)
    assert {r.doc_id for r in jaccard.keep_one(rows.unionByName(rows.filter("doc_id < 30"))).collect()} == want


def test_clashing_column_names_pass_through(spark):
    rows = docs(spark, fixture(5)).withColumns({c: F.lit(7) for c in ("row", "copies", "kept_id", "group_id", "leaked_id", "score", "predicted", "rejected", "letters")})
    bench = spark.createDataFrame([(1, "never to be found in any text")], "item_id long, text string")
    for out in (jaccard.keep_one(rows), decontaminate.clean(rows, bench), langid.decide(rows, {}).select("row.*"), toxicity.decide(rows, toxicity.Model()).select("row.*")):
        assert out.columns == rows.columns and out.count() > 0 and {r.row for r in out.collect()} == {7}


def test_pruning_bounds_are_posterior_tails():
    least = jaccard.least_matches(0.8, 1e-6)
    assert len(least) == shingles.HASHES // jaccard.STEP and least == sorted(least) and 0 < least[0] < 32


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- decontamination ---------------------------------------------------------------------------


def edit(item, text):
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        cur = [i]
        for j, b in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev)


def tokens(text):
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = words(data, np.array([0, len(data)]), unicode_marks=True)
    return [data[a:b].tobytes().lower() for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def test_nearest_is_the_edit_distance():
    rnd = random.Random(0)
    for _ in range(300):
        item, text = rnd.choices("abc", k=rnd.randint(1, 9)), rnd.choices("abc", k=rnd.randint(0, 15))
        d, _ = decontaminate.nearest([ord(c) for c in item], [ord(c) for c in text])
        assert d == edit(item, text)


def test_planted_passages_are_found_and_others_left_alone(spark):
    rnd = random.Random(8)
    vocab = [f"x{i}" for i in range(150)]
    items = [" ".join(rnd.choices(vocab, k=rnd.randint(5, 60))) for _ in range(40)]
    texts, planted = [], {}
    for i in range(200):
        w = rnd.choices(vocab, k=rnd.randint(0, 150))
        if i % 2:
            k = rnd.randrange(40)
            p = items[k].split()
            for _ in range(rnd.randint(0, len(p) // 5)):
                at = rnd.randrange(len(p))
                p[at : at + 1] = rnd.choice([[], ["zz"], [p[at], "zz"]])
            at = rnd.randint(0, len(w))
            w[at:at] = p
        texts.append(" ".join(w))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "too short"), (None, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs(spark, texts), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            n = edit(tokens(item), tokens(t))
            if n <= decontaminate.edit_bound(len(tokens(item)), 0.8):
                want[d, k] = n
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and len(want) >= 90
    assert all(got[k].distance == want[k] for k in got)
    passes = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(spark, texts), bench, pass_bytes=2000).collect()}
    assert passes == set(got)
    kept = {r.doc_id for r in decontaminate.clean(docs(spark, texts), bench).collect()}
    assert kept == set(range(200)) - {d for d, _ in got}


@pytest.mark.parametrize("kind", ["delete", "insert", "mixed"])
def test_passages_edited_up_to_the_bound_are_all_found(spark, kind):
    rnd = random.Random(kind)
    vocab = [f"y{i}" for i in range(20_000)]
    items = [" ".join(rnd.choices(vocab, k=n)) for n in (5, 10, 30, 50, 100, 200) for _ in range(20)]
    texts = []
    for item in items:
        p = item.split()
        for at in sorted(rnd.sample(range(len(p)), decontaminate.edit_bound(len(p), 0.8)), reverse=True):
            p[at : at + 1] = {"delete": [], "insert": [p[at], "zz"], "mixed": rnd.choice([[], ["zz"], [p[at], "zz"]])}[kind]
        texts.append(" ".join(rnd.choices(vocab, k=30) + p + rnd.choices(vocab, k=30)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(spark, texts), bench).collect()}
    assert got == {(i, i) for i in range(len(items))}


def test_short_items_and_items_in_unspaced_scripts_are_found(spark):
    chinese = "请问中国历史上第一个统一的封建王朝是哪一个，它的都城位于今天的什么地方？"
    items = [chinese, "東京の天気は今日とても良いので、散歩に行きましょうか。", "ประเทศไทยมีเมืองหลวงชื่อว่ากรุงเทพมหานคร", "Too short", "x=2", "𠀀𠀁𠀂", "？！", "?;?", " "]
    edited = list(chinese)
    del edited[3], edited[12], edited[20]
    texts = ["前文" + x.strip() + "后文" for x in items[:3]] + ["this is too, short!", "too very short", "so x = 2", "字𠀀𠀁𠀂字", "是吗？！", "why?;?", "", "前文" + "".join(edited) + "后文", "没有任何关系的句子，今天天气不错。"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs(spark, texts), bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 4), (6, 5), (7, 6), (8, 7), (10, 0)}
    assert got[10, 0].distance == 3 and {got[k].distance for k in got if k != (10, 0)} == {0}
    assert (got[6, 5].first_word, got[6, 5].last_word) == (1, 3) and (got[8, 7].first_word, got[8, 7].last_word) == (1, 0)


def test_windows_of_one_repeated_word_are_joined():
    items = decontaminate.Items([(1, "a " * 60)], 0.8)
    h = np.repeat(items.words[0][:1], 50_000)
    assert decontaminate._windows(h, np.array([0, 20_000, 50_000]), items) == [(0, 0, 0, 20_000), (1, 0, 20_000, 50_000)]


def test_planted_edits_up_to_the_bound_reach_the_target_recall():
    """1,800 plants against the exact edit distance, beside the kinds of `calibrate`: common words too."""
    rnd = random.Random(21)
    vocab = [f"y{i}" for i in range(300)]
    found = wanted = 0
    for n in (5, 7, 10, 15, 24, 40, 60, 90, 150):
        rows, texts = [], []
        for k in range(200):
            item = rnd.choices(vocab, k=n)
            p = list(item)
            for at in sorted(rnd.sample(range(n), decontaminate.edit_bound(n, 0.8)), reverse=True):
                p[at : at + 1] = rnd.choice([[], [rnd.choice(vocab)], [p[at], rnd.choice(vocab)]])
            rows.append((k, " ".join(item)))
            texts.append(" ".join(rnd.choices(vocab, k=30) + p + rnd.choices(vocab, k=30)))
        items = decontaminate.Items(rows, 0.8)
        best = decontaminate._best(pa.array(texts, pa.string()), items)
        found += sum((k, k) in best for k in range(200))
        wanted += 200
    assert found >= 0.998 * wanted


def test_rows_with_null_or_shared_ids_are_decided_by_their_texts(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = spark.createDataFrame([(None, f"before {item} after", 1), (None, "something else", 2), (3, item, 3), (3, "no part of it", 4), (4, None, 5)], "doc_id long, text string, n int")
    bench = spark.createDataFrame([(1, item), (2, "another item that is not there at all")], "item_id long, text string")
    for pass_bytes in (8_000_000, 40):
        assert sorted(r.n for r in decontaminate.clean(rows, bench, pass_bytes=pass_bytes).collect()) == [2, 4, 5]


def test_no_items_or_documents(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs(spark, ["a b c d e f", None]), bench).count() == 0
    assert decontaminate.clean(docs(spark, ["a b c d e f", None]), bench).count() == 2


# ---- toxicity ----------------------------------------------------------------------------------


def brute_kernel(a, b):
    out = 0.0
    for i in combinations(range(len(a)), toxicity.P):
        for j in combinations(range(len(b)), toxicity.P):
            if [a[x] for x in i] == [b[x] for x in j]:
                out += toxicity.LAMBDA ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return out


def test_kernel_matches_brute_force():
    rnd = random.Random(2)
    xs = ["".join(rnd.choices("abcd", k=rnd.randint(3, 9))).encode() for _ in range(12)]
    got = toxicity.gram(xs, xs)
    for i, a in enumerate(xs):
        for j, b in enumerate(xs):
            assert got[i, j] == pytest.approx(brute_kernel(a, b) / (brute_kernel(a, a) * brute_kernel(b, b)) ** 0.5, rel=1e-4)


def toy(rnd, n):
    clean = ["table", "window", "garden", "river", "music", "yellow", "people", "market", "winter", "pencil", "coffee", "bridge"]
    bad = ["dunderhead", "numbskull", "blockhead"]
    out = []
    for i in range(n):
        w = rnd.choices(clean, k=rnd.randint(5, 40))
        if i % 4 == 0:
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        out.append((" ".join(w), int(i % 4 == 0)))
    return out


def test_toxicity_on_held_out_and_spoiled_insults(spark):
    rnd = random.Random(1)
    train = toy(rnd, 400)
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    test = toy(rnd, 200)
    hard = ["the dunder-head came", "a numbxskull here", "d u n d e r h e a d", "block5head!"]
    texts = [t for t, _ in test] + hard + ["", None, "...", "x" * 100_000]
    got = {r.doc_id: r for r in toxicity.score(docs(spark, texts), model).collect()}
    right = sum(got[i].predicted == y for i, (_, y) in enumerate(test))
    assert right >= 198
    assert sum(got[len(test) + i].predicted for i in range(len(hard))) >= 3
    for i in range(len(test) + len(hard), len(texts)):
        assert got[i].predicted == 0 and 0 <= got[i].score <= 1


def test_model_learnt_by_a_task_equals_a_local_fit(spark):
    rows = toy(random.Random(6), 300)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.learn(docs(spark, [t for t, _ in rows]), labels)
    kept = [(t, y) for i, (t, y) in enumerate(rows) if not toxicity.is_held_out(i)]
    assert model.landmarks == toxicity.fit([t for t, _ in kept], [y for _, y in kept]).landmarks


def test_toxicity_without_two_classes(spark):
    model = toxicity.fit(["a b c"], [0])
    assert [r.predicted for r in toxicity.score(docs(spark, ["idiot", None]), model).collect()] == [0, 0]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(docs(spark, ["a"]), labels).landmarks == []


def test_held_out_rules(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    for r in df.select("doc_id", toxicity.held_out().alias("t"), langid.held_out().alias("l")).collect():
        c = zlib.crc32(str(r.doc_id).encode())
        assert r.t == (c % 5 == 0) and r.l == (c % 4 == 2)


# ---- language ID -------------------------------------------------------------------------------


def test_language_id_on_held_out_rows(spark, data):
    df = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    model = langid.learn(df)
    rows = langid.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").filter(langid.held_out()).collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.93 * len(rows)


def test_every_language_is_learnt(spark):
    rnd = random.Random(12)
    own = {f"l{k:03}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(4, 9))) for _ in range(30)] for k in range(300)}
    rows = [(i, " ".join(rnd.choices(w, k=40)), lang) for i, (lang, w) in enumerate([x for x in own.items() for _ in range(1 if x[0] == "l299" else 6)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = {r.lang for r in df.filter(~langid.held_out()).select("lang").distinct().collect()}
    for bound in (100_000, 10):
        model = langid.learn(df, max_texts=bound)
        assert set(model) == learnt and len(learnt) > 290
    asked = spark.createDataFrame([(k, " ".join(rnd.choices(own[lang], k=40)), lang) for k, lang in enumerate(sorted(learnt))], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(asked, langid.learn(df)).collect()}
    assert sum(got[r.doc_id] == r.lang for r in asked.collect()) >= 0.97 * len(learnt)


def test_predictions_equal_one_shot_compression(spark):
    """Against the plain definition: the smallest whole-buffer encoding of the repeated text."""
    rnd = random.Random(2)
    words_of = {x: ["".join(rnd.choices(letters, k=rnd.randint(2, 8))) for _ in range(200)] for x, letters in (("aa", "aeiklmnost"), ("bb", "bdfgrupvwy"), ("cc", "aeioubdfgr"))}
    model = langid.dictionaries({x: [" ".join(rnd.choices(w, k=60)) for _ in range(60)] for x, w in words_of.items()}, 98304)
    texts = [" ".join(rnd.choices(words_of[rnd.choice("aa bb cc".split())], k=k)) for k in (1, 2, 3, 10, 40, 41, 42, 60, 500, 40_000) for _ in range(3)]
    press = {x: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=langid.LEVEL, write_content_size=False, write_dict_id=False) for x, d in model.items()}
    for r in langid.identify(docs(spark, texts), model).collect():
        size = {x: len(p.compress((texts[r.doc_id].lower().encode() + b" ") * langid.COPIES)) for x, p in press.items()}
        assert size[r.lang_pred] <= min(size.values()) + 2 and 0 <= r.score <= 1


def test_long_and_repetitive_texts_are_not_rejected_for_their_length(spark):
    rnd = random.Random(5)
    words = {x: ["".join(rnd.choices(letters, k=rnd.randint(2, 8))) for _ in range(600)] for x, letters in (("aa", "aeiklmnost"), ("bb", "bdfgrupvwy"))}
    model = langid.dictionaries({x: [" ".join(rnd.choices(w, k=60)) for _ in range(200)] for x, w in words.items()}, 98304)
    texts = [(" ".join(rnd.choices(words[x], k=k)) + ". ") * (n // (6 * k)) for x in ("aa", "bb") for k, n in ((13, 700_000), (90, 1_600_000), (400, 7_000_000))]
    got = [(r.lang_pred, r.rejected) for r in langid.identify(docs(spark, [*texts, "7 " * 400_000 + "\u00e9"]), model).orderBy("doc_id").collect()]
    assert got[:-1] == [("aa", False)] * 3 + [("bb", False)] * 3 and got[-1][1]


def test_language_id_of_odd_texts(spark):
    rnd = random.Random(3)
    model = langid.dictionaries({"aa": [" ".join(rnd.choices(["kala", "mato", "sina"], k=40)) for _ in range(30)], "bb": [" ".join(rnd.choices(["strub", "grond", "plerk"], k=40)) for _ in range(30)]}, 20_000)
    texts = [None, "", "123 !?", "kala sina mato", "STRUB GROND", "é"]
    got = [(r.lang_pred, r.rejected) for r in langid.identify(docs(spark, texts), model).orderBy("doc_id").collect()]
    assert got[:3] == [("und", True)] * 3 and got[3] == ("aa", False) and got[4] == ("bb", False) and got[5][0] in ("aa", "bb")
    assert {r.lang_pred for r in langid.identify(docs(spark, texts), {}).collect()} == {"und"}
    assert langid.learn(docs(spark, ["x"]).limit(0)) == {}


# ---- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark, data):
    sf = f"{data}/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123", "en", "s", 3)], rows.schema)
    now = rows.unionByName(extra)
    columns = rows.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == columns, name
        kept = {tuple(r) for r in out.collect()}
        assert kept <= {tuple(r) for r in now.collect()}
        counts.append(len(kept))
        now = spark.createDataFrame(sorted(kept), rows.schema)
    assert not {10**6, 10**6 + 1} & {r.doc_id for r in now.collect()}
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    texts = {r.doc_id: r.text for r in now.collect()}
    brute = expected([texts[k] for k in sorted(texts)])
    assert all(v[2] == 0 and v[1] == 1 for v in brute.values())
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r.doc_id for r in last} == set(texts)
    whole = {r.doc_id: r.text for r in rows.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in last:
        assert r.n_tokens == len(library.encode(whole[r.doc_id], add_special_tokens=False).ids)
