"""Scores and choice of parse views on texts that show single signals."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import parseviews
from lodestone.plans import registry


def views(spark, *rows):
    return spark.createDataFrame([(1, 1, i, k, "p", t, 4) for i, (k, t) in enumerate(rows)], "doc_id long, page_no int, ordinal int, view_type string, parser string, text string, block_count int")


def test_signals(spark):
    text = "# Title\n1 Scope\n1.1 Parts of it\n1.2 More\n3 End\n| a | b | c |\n- item here\nPage 3\nPage 3\nword é ok (continued)"
    r = parseviews.scored(views(spark, ("html", text))).first()
    assert (r["heading_count"], r["list_signal_count"], r["table_signal_count"], r["clause_number_count"]) == (5, 1, 4, 4)
    assert r["clause_continuity_score"] == 1.0 and r["continuation_signal_count"] == 2
    assert r["header_footer_noise_ratio"] == pytest.approx(0.2) and r["duplicate_line_ratio"] == pytest.approx(0.1)
    assert r["row_column_signal_count"] == 1 and r["unreadable_ratio"] > 0 and "low_text_density" not in r["flags"]


def test_empty_and_missing_texts(spark):
    rows = parseviews.scored(views(spark, ("html", None), ("native_text", ""))).collect()
    assert all(r["total_chars"] == 0 and r["singleton_token_ratio"] == 1.0 and r["flags"].startswith("no_text,low_text_density") for r in rows)


def test_choice_prefers_score_then_text_then_order(spark):
    good = "1 Scope\n1.1 Readable words of a normal page\n1.2 More readable words of it\n" * 3
    out = parseviews.selected(parseviews.scored(views(spark, ("native_text", "!!! ### $$$"), ("html", good), ("ocr_html", None), ("native_text", "?")))).first()
    assert out["view_type"] == "html" and out["reason"].startswith("highest_score:") and out["reason"].endswith("view_type=html; parser=p")
    assert out["chain"].count(" > ") == 3 and "ocr_html:unavailable" in out["chain"]


def test_case_is_changed_letter_by_letter_as_in_the_sql(spark):
    letters = [(i, chr(i)) for i in (*range(1, 0x590), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB18))] + [(0x20000, "ΟΔΟΣ")]  # scripts whose pairs are as old as the JVM's Unicode
    df = spark.createDataFrame(letters, "i int, c string")
    got = {r[0]: (r[1], r[2]) for r in df.select("i", T.simple_upper("c"), T.simple_lower("c")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE x AS SELECT unnest(?) AS i, unnest(?) AS c", [[i for i, _ in letters], [c for _, c in letters]])
    assert got == {i: (u, w) for i, u, w in con.execute("SELECT i, upper(c), lower(c) FROM x").fetchall()}


def test_scores_are_rounded_by_their_binary_value(spark):
    values = [0.2580625, 0.2584625, 0.2565125, 0.0000005, 0.1234565, 1.0, 0.0]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    con = duckdb.connect()
    assert [r[0] for r in df.select(parseviews._six(F.col("x"))).collect()] == [con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in values]


def test_views_of_texts_whose_upper_form_is_longer_equal_the_sql(spark, tmp_path):
    text = "Straße und Fuß, groß. Öl *** in ß### heiß "
    docs = spark.createDataFrame([(i, text * (1 + i)) for i in range(12)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "k06_parse_view_selection"
    want = con.execute(f"SELECT doc_id, view_type, score, flags, chain FROM ({registry.oracle_sql()[name]})").fetchall()
    got = registry.queries()[name](spark, str(tmp_path)).select("doc_id", "view_type", "score", "flags", "chain").collect()
    assert sorted(map(tuple, got)) == sorted(want)


ODD = [
    "", "a", "ab", "  x  ", "a b c de fgh", "rhythm xyz strength", "a1 b22 汉字 字 汉a", "汉汉汉", "été naïve", "x|y|z | w", "tab\there  and   there\twords here\tare", "no-break space　wide", "emoji \U0001f600 \U0001d7d9", "\x01\x02 control \x7f",
    "Vithkuqi \U00010570\U00010571, Toto \U0001e290\U0001e291, Kawi \U00011f04",  # letters younger than the JVM's Unicode
    "a\x0bb\x0cc\x1cd\x1de\x1ef", "copyright Page 3\nPage 3\nDOI: 10.1234/x", "all  rights\treserved by us", "published\tonline 1 May", "To be (Continued)\n续表\ncont.", "<TR><Td>a</tD></tr> < table >", "1. One\n2) Two\n- three\na. four", "# T\n1 A\n1.1 B\n1.2 C\n2 D", "iso 9001\nGB/T 12-3 part", "ΟΔΟΣ İstanbul ΟΔΟΣ\nΟΔΟΣ",
]


def test_characters_are_counted_as_the_patterns_of_the_sql_match():
    got = dict(zip(parseviews._COUNTED, parseviews._counted(ODD).tolist(), strict=False))
    con = duckdb.connect()
    count = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
    solid = f"regexp_replace(regexp_replace(t, '{parseviews.SPACE}', '', 'g'), '{parseviews.WORD}', '', 'g')"
    want = {
        "chars": "len(t)", "spaces": count("t", parseviews.SPACE), "words": count("t", parseviews.WORD), "unread": count(solid, parseviews.UNREADABLE), "tokens": count("t", parseviews.WORD + "+"), "bars": count("t", r"\|"),
        "single": f"len(list_filter(regexp_extract_all(t, '{parseviews.WORD}+'), lambda x: len(x) = 1))",
        "runs": count("t", r"[\x{4e00}-\x{9fff}]{2,}") + " + len(list_filter(regexp_extract_all(t, '[A-Za-z]{3,}'), lambda x: regexp_matches(x, '[aeiouAEIOU]')))",
    }
    rows = con.execute(f"SELECT {', '.join(f'{x} AS {k}' for k, x in want.items())} FROM (SELECT unnest(?) AS t)", [ODD]).fetchall()
    assert {k: got[k] for k in want} == {k: list(x) for k, x in zip(want, zip(*rows, strict=True), strict=True)}


def test_views_of_odd_texts_equal_the_sql(spark, tmp_path):
    texts = [t * k for t in [x + ". " for x in ODD] for k in (1, 9)]
    docs = spark.createDataFrame([(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)] + [(9999, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "k06_parse_view_selection"
    want = con.execute(f"SELECT doc_id, view_type, score, flags, chain FROM ({registry.oracle_sql()[name]})").fetchall()
    got = registry.queries()[name](spark, str(tmp_path)).select("doc_id", "view_type", "score", "flags", "chain").collect()
    assert sorted(map(tuple, got)) == sorted(want)
