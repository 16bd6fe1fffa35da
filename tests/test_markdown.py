"""Markdown repair on texts that show each rule."""

from lodestone.operators import markdown


def repaired(spark, *texts, page=None):
    rows = [(i, t, page) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, page int")
    return [r["text"] for r in markdown.repair(df, page="page" if page is not None else None).orderBy("doc_id").collect()]


def test_tables(spark):
    ragged, lone, wide, no_rule, empty = repaired(
        spark,
        "| a | b |\n|---|:-:|\n| 1 |\n2 | 3 | 4 |\ntext",
        "x | y &amp; z",
        "|n|a|b|c|d|e|f|\n|-|-|-|-|-|-|-|\n|1||2|3|4|5|6|7|",
        "a|b|c\nd|e",
        None,
    )
    assert ragged == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 4 |\ntext"
    assert lone == "x | y & z" and empty == ""
    assert wide == "- n: n; a: a; b: b; c: c; d: d; e: e; f: f\n- n: 1; b: 2; c: 3; d: 4; e: 5; f: 6 7"
    assert no_rule == "| a | b | c |\n| d | e |  |"


def test_headings_images_symbols_and_noise(spark):
    image = "![pic](data:image/png;base64,AA==)"
    (out,) = repaired(spark, f"## 3.1.4.2\n{image} and {image.replace('pic', '')}\n……..\n12\n### \nx ≤ 5 ℃\n{image}")
    assert out == "##### 3.1.4.2\n[pic - ] and [Image - ]\nx <= 5 摄氏度\n[pic - ]"  # references to figures go with the section's filter


def test_images_are_numbered_through_a_text(spark):
    image = "![pic](data:image/png;base64,AA==)"
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate([image + "a" + image, "b", image.replace("pic", "")])], "doc long, n int, line string")
    assert [r["line"] for r in markdown.without_images(lines).orderBy("n").collect()] == ["[pic - 见图1]a[pic - 见图2]", "b", "[Image - 见图3]"]


def test_sections_blanks_and_parts(spark):
    (out,) = repaired(spark, "\n# 1 范围\n\n\n$x$\n\nb\n## 前言\nold\n### deeper\nold\n## 2 规范性引用文件\nold\n# 3 术语\nkept 见表C.14，and ICS 1.2.3\n---\n")
    assert out == "# 1 范围\n\n\nb\n# 3 术语\nkept .14，and "


def test_skipped_pages(spark):
    assert repaired(spark, "text", page=0) == [""] and repaired(spark, "text", page=2) == ["text"]
