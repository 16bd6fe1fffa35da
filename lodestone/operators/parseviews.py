"""Candidate views of a page: fifteen signals of a text, a damped score, and the choice of one view a page with its reasons."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Patterns of the signals.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[A-Za-z0-9\x{4e00}-\x{9fff}]"
UNREADABLE = r"[\x{00}-\x{08}\x{0e}-\x{1b}\x{7f}-\x{84}\x{86}-\x{9f}\x{fffd}\x{1d7ce}-\x{1d7ff}\p{Co}]|[\p{L}\p{M}\p{S}]"
LINE_ENDS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
HEADING = r"(?m)^(#{1,6}\s|\d+(?:\.\d+){0,5}\s+\S+)"
LIST = r"(?m)^\s*(?:[-*]|\d+[.)]|[a-zA-Z][.)])\s+"
CLAUSE = r"(?m)^\s*(\d+(?:\.\d+){0,5})(?:\s+|[.)、])"
NOISE = [
    r"^(?:page|第)?\s*\d+\s*(?:页|/\s*\d+)?$", r"\bdoi\s*:\s*10\.\d{4,9}/", r"\b(?:copyright|all rights reserved|published online|received:|accepted:)(?:\b|$)", r"^\s*\d+\s*(?:智能电网|smart grid|road vehicles)\s*$",
]
STANDARD = r"^\s*(?:iso|iec|gb/t|qc/t)\s*[\d-]+"
CONTINUED = [r"（续）", r"(?i)\(continued\)", r"(?i)\bcontinued\b", r"续表", r"表\s*\S+\s*续", r"(?im)^\s*(?:continued|cont\.)\s*$"]
VIEW_BONUS = {"html": 0.03, "ocr_html": 0.02}
# The same sets for texts taken apart by characters.
_SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACE, _WORD, _LETTER, _VOWEL, _CJK, _UNREAD, _BAR, _ODD = [1 << i for i in range(8)]
_NOISE_WORDS = "doi", "copyright", "rights", "published", "received:", "accepted:"  # one of them is in a line of the second or third pattern of noise
_COUNTED = "chars", "spaces", "words", "unread", "tokens", "single", "runs", "bars", "odd"
_SEEN = "wide", "noise", "continued", "tag", "cased"
_COUNTS = f"struct<{', '.join(f'{k}: int' for k in _COUNTED + _SEEN)}>"
_CHARS = 1 << 18  # texts of so many characters are counted at a time


@cache
def _kinds() -> np.ndarray:
    """The sets that each code point belongs to, as bits."""
    unread = {*range(0x09), *range(0x0E, 0x1C), *range(0x7F, 0x85), *range(0x86, 0xA0), 0xFFFD, *range(0x1D7CE, 0x1D800)}
    out = np.fromiter((_UNREAD * (i in unread or (k := unicodedata.category(chr(i)))[0] in "LMS" or k == "Co") for i in range(0x110000)), np.uint8, 0x110000)
    letters = [*range(0x41, 0x5B), *range(0x61, 0x7B)]
    for kind, chars in ((_SPACE, map(ord, _SPACES)), (_WORD | _LETTER, letters), (_VOWEL, map(ord, "aeiouAEIOU")), (_WORD, range(0x30, 0x3A)), (_WORD | _CJK, range(0x4E00, 0xA000)), (_BAR, [0x7C]), (_ODD, {*map(ord, _SPACES)} - {0x20, 0x0A})):
        out[list(chars)] |= kind
    out[(out & (_SPACE | _WORD)) > 0] &= ~_UNREAD & 0xFF  # of what is neither blank nor a word
    return out


def _counted(texts: list[str]) -> np.ndarray:
    """A column a text of _COUNTED: characters, blanks, word characters, unreadable ones, tokens, those of one character, runs of letters or CJK
    characters that read, bars, and blanks that are neither a space nor a line end; and of _SEEN, whether it can hold what patterns look for."""
    kinds = _kinds()[np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le"), np.uint32)]  # no run goes on past a text
    ends = np.cumsum([len(t) + 1 for t in texts])
    at = lambda kind: (kinds & kind) > 0
    per_text = lambda places: np.diff(np.searchsorted(places, ends), prepend=0)

    def runs(kind: int) -> tuple[np.ndarray, np.ndarray]:
        edges = np.flatnonzero(np.diff(at(kind).view(np.int8), prepend=0))
        return edges[::2], edges[1::2]

    start, end = runs(_WORD)
    first, last = runs(_LETTER)
    vowels = np.flatnonzero(at(_VOWEL))
    read = first[(last - first >= 3) & (np.searchsorted(vowels, last) > np.searchsorted(vowels, first))]
    cjk, over = runs(_CJK)
    places = lambda kind: per_text(np.flatnonzero(at(kind)))
    counts = ends - np.insert(ends, 0, 0)[:-1] - 1, places(_SPACE) - 1, places(_WORD), places(_UNREAD), per_text(start), per_text(start[end - start == 1]), per_text(read) + per_text(cjk[over - cjk >= 2]), places(_BAR), places(_ODD)
    return np.stack([*counts, *np.array([_seen(t) for t in texts], np.int64).reshape(-1, len(_SEEN)).T])


def _seen(t: str) -> list[bool]:
    low = t.replace("İ", "i").lower()
    return ["  " in t, any(w in low for w in _NOISE_WORDS), "continued" in low or "cont." in low or "续" in t, "<" in t, "İ" in t or "Σ" in t]


def _characters(texts: pa.Array) -> pa.Array:
    """`_counted` of UTF-8, a bounded part at a time."""
    found, part, size = [], [], 0
    for t in texts:
        part.append(t.as_py().decode(errors="replace"))
        size += len(part[-1])
        if size > _CHARS:
            found.append(_counted(part))
            part, size = [], 0
    if part or not found:
        found.append(_counted(part))
    return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in np.concatenate(found, axis=1)], _COUNTED + _SEEN)


def _trimmed(c: Column) -> Column:
    """Without blanks at its ends; looked through only if it has one."""
    blank = lambda at: F.contains(F.lit(_SPACES), F.substring(c, at, 1))
    return F.when(blank(1) | blank(-1), F.btrim(c, F.lit(_SPACES))).otherwise(c)


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _within(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def _six(c: Column) -> Column:
    """Six digits of a score of 0 to 1 by its binary value, as SQL engines round; Spark's own rounds the shortest decimal that prints it."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def _continues(prev: Column, now: Column) -> Column:
    """Whether a clause number (an array) follows another: the same, a later sibling, its first child level, or back up to no earlier a part."""
    a, b = F.size(prev), F.size(now)
    front = lambda x, n: F.slice(x, 1, n)
    last = lambda x: F.element_at(x, -1)
    return (prev == now) | ((a == b) & (front(prev, a - 1) == front(now, b - 1)) & (last(now) >= last(prev))) | ((b == a + 1) & (front(now, b - 1) == prev)) | ((b < a) & (now[0] >= prev[0]))


def scored(views: DataFrame) -> DataFrame:
    """`views` (text, block_count, view_type, ...) with `score`, its signals and `flags`. A null text counts as empty.

    Counts are columns below the ratios and those below the scores, so that each is taken once a row. Characters are counted by table,
    and patterns whose sign texts seldom hold are tried on those texts or lines alone that hold it."""
    c, text, none = F.col, F.col("v_text"), F.array().cast("array<string>")
    rows = views.withColumn("v_text", F.coalesce("text", F.lit(""))).withColumn("v_text", _trimmed(text))
    rows = rows.withColumn("v_chars", F.arrow_udf(_characters, _COUNTS)(text.cast("binary")))
    n, seen = lambda k: c(f"v_chars.{k}"), lambda k: c(f"v_chars.{k}") > 0
    parts = F.when(seen("odd"), F.split(text, LINE_ENDS)).otherwise(F.split(text, "\n"))
    rows = rows.withColumn("v_lines", F.filter(F.transform(parts, _trimmed), lambda x: x != ""))
    begins = lambda x, chars: F.contains(F.lit(chars), F.substring(x, 1, 1))
    numbered = F.exists("v_lines", lambda x: begins(x, "#0123456789"))
    listed = F.exists("v_lines", lambda x: begins(x, "-*0123456789") | F.substring(x, 2, 1).isin(".", ")"))
    pipes = F.filter("v_lines", lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    aligned = F.filter("v_lines", lambda x: x.rlike(r"(?s)\s\s\S.*?\s\s") & x.rlike(f"(?:{WORD}[^{WORD[1:]}*+){{6}}"))
    wide, lines = seen("wide") | seen("odd"), c("v_lines")
    spaced = F.when(wide, F.transform(lines, lambda x: F.regexp_replace(x, r"\s+", " "))).otherwise(lines)
    plain = F.when(seen("cased"), F.transform(spaced, T.simple_lower)).otherwise(F.transform(spaced, F.lower))
    clauses = F.when(numbered, F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(1))).otherwise(none)
    tagged = lambda t, pattern: F.when(seen("tag"), _count(t, pattern)).otherwise(0)
    rows = rows.withColumns({
        "total_chars": n("chars"), "v_solid": n("chars") - n("spaces"), "v_symbols": n("chars") - n("spaces") - n("words"), "v_unread": n("unread"), "v_single": n("single"), "v_n_tokens": n("tokens"), "language_run_count": n("runs"),
        "heading_count": F.when(numbered, _count(text, HEADING)).otherwise(0), "table_signal_count": tagged(F.lower(text), "<table") + n("bars"), "list_signal_count": F.when(listed, _count(text, LIST)).otherwise(0),
        "v_pipes": F.when(n("bars") > 1, pipes).otherwise(none), "v_aligned": F.when(wide, aligned).otherwise(none), "v_plain": plain, "v_n_lines": F.size("v_lines"), "v_noisy": seen("noise"),
        "v_numbers": F.transform(clauses, lambda x: F.transform(F.split(x, r"\."), lambda p: p.try_cast("decimal(38,0)"))),
        "continuation_signal_count": F.when(seen("continued"), sum((_count(text, p) for p in CONTINUED), F.lit(0))).otherwise(0),
        "v_tr": tagged(text, r"(?i)<\s*tr\b"), "v_td": tagged(text, r"(?i)<\s*t[dh]\b"), "v_table": tagged(text, r"(?i)<\s*table\b"),
    }).drop("v_text", "v_lines", "v_chars")
    chars = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x))
    number = lambda x: begins(x, "0123456789p第") & (x.rlike(NOISE[0]) | x.rlike(NOISE[3]))
    shorter = lambda x, k: (F.octet_length(x) < 4 * k) & (F.length(x) < k)
    noisy = lambda x: shorter(x, 4) | number(x) | (c("v_noisy") & (x.rlike(NOISE[1]) | x.rlike(NOISE[2]))) | (shorter(x, 40) & x.rlike(STANDARD))
    n = F.size("v_numbers")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: _continues(F.get("v_numbers", i - 1), F.get("v_numbers", i)).cast("int"))
    rows = rows.withColumns({
        "row_column_signal_count": c("v_tr") + F.size("v_pipes") + F.size("v_aligned"),
        "v_table_chars": chars("v_pipes") + chars("v_aligned") + c("v_td") * 8 + c("v_table") * 24,
        "clause_number_count": n, "clause_continuity_score": F.when(n >= 2, F.aggregate(pairs, F.lit(0), lambda a, x: a + x) / (n - 1)).when(n == 1, 1.0).otherwise(0.0),
        "header_footer_noise_ratio": _over(F.size(F.filter("v_plain", noisy)), F.col("v_n_lines")), "duplicate_line_ratio": _over(F.col("v_n_lines") - F.size(F.array_distinct("v_plain")), F.col("v_n_lines")),
        "semantic_ratio": _over(F.col("v_solid") - F.col("v_symbols"), F.col("v_solid")), "symbol_ratio": _over(F.col("v_symbols"), F.col("v_solid")), "unreadable_ratio": _over(F.col("v_unread"), F.col("v_solid")),
        "singleton_token_ratio": F.when(F.col("v_n_tokens") > 0, F.col("v_single") / F.col("v_n_tokens")).otherwise(1.0),
    })
    density = F.when(c("total_chars") > 0, F.least(F.lit(1.0), c("language_run_count") / F.greatest(c("total_chars") / 120.0, F.lit(1.0)))).otherwise(0.0)
    penalty = F.least(F.lit(0.9), c("symbol_ratio") * 0.55 + c("unreadable_ratio") * 3.0 + c("singleton_token_ratio") * 0.22)
    rows = rows.withColumns({"readability_score": _within(c("semantic_ratio") * 0.55 + density * 0.45 - penalty), "table_density": F.least(F.lit(1.0), c("v_table_chars") / F.greatest(c("total_chars"), F.lit(1)))})
    noise = F.least(F.lit(0.85), c("symbol_ratio") * 0.55 + c("unreadable_ratio") * 0.8 + c("header_footer_noise_ratio") * 0.18 + c("duplicate_line_ratio") * 0.14 + c("singleton_token_ratio") * 0.18)
    structure = _within(
        c("heading_count") * 0.08 + c("table_signal_count") * 0.025 + c("list_signal_count") * 0.035 + c("table_density") * 0.22 + F.least(F.lit(1.0), c("row_column_signal_count") / 12.0) * 0.14
        + c("clause_continuity_score") * 0.18 + F.least(F.lit(1.0), c("continuation_signal_count") / 3.0) * 0.08 - c("header_footer_noise_ratio") * 0.12 - c("duplicate_line_ratio") * 0.14
    )
    damping = F.greatest(F.lit(0.1), 1.0 - c("header_footer_noise_ratio") * 0.75 - c("duplicate_line_ratio") * 0.55)
    rows = rows.withColumns({"structure_quality_score": structure * F.greatest(F.lit(0.25), c("readability_score")) * damping, "v_noise": noise})
    bonus = F.when(c("view_type") == "html", VIEW_BONUS["html"]).when(c("view_type") == "ocr_html", VIEW_BONUS["ocr_html"]).otherwise(0.0)
    score = _within(F.least(F.lit(1.0), c("total_chars") / 800.0) * 0.15 + c("readability_score") * 0.22 + c("structure_quality_score") * 0.5 + F.least(F.lit(1.0), c("block_count") / 8.0) * 0.07 + bonus - c("v_noise"))
    flags = {
        "no_text": c("total_chars") == 0, "low_text_density": c("total_chars") < 80, "symbol_noise": c("symbol_ratio") > 0.38, "unreadable_text": c("unreadable_ratio") > 0.08,
        "low_readability": (c("readability_score") < 0.35) & (c("total_chars") > 200), "header_footer_noise": c("header_footer_noise_ratio") > 0.35, "duplicate_lines": c("duplicate_line_ratio") > 0.35,
        "weak_table_structure": (c("table_density") > 0.18) & (c("row_column_signal_count") < 2),
    }
    rows = rows.withColumns({"score": _six(score), "structure_quality_score": _six(F.col("structure_quality_score")), "flags": F.array_join(F.array_compact(F.array(*(F.when(f, F.lit(k)) for k, f in flags.items()))), ",")})
    return rows.drop(*(x for x in rows.columns if x.startswith("v_")))


def selected(views: DataFrame) -> DataFrame:
    """(doc_id, page_no, view_type, score, reason, chain, flags) of the best of each page's `scored` views.

    Candidates with text go before those without at equal scores, and then the first of the input's `ordinal`; `chain` lists all views from best to worst."""
    status = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", "candidate").otherwise("unavailable")
    three = lambda x: F.format_string("%.3f", F.round(x, 3))
    row = F.struct((-F.col("score")).alias("worse"), (status == "unavailable").alias("missing"), "ordinal", "view_type", "parser", "score", "structure_quality_score", "flags", status.alias("status"))
    pages = views.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(row)).alias("views"))  # a page has a view a parser
    best = F.col("views")[0]
    reason = F.concat(F.lit("highest_score:"), three(best["score"]), F.lit("; structure:"), three(best["structure_quality_score"]), F.lit("; view_type="), best["view_type"], F.lit("; parser="), best["parser"])
    chain = F.array_join(F.transform("views", lambda v: F.concat(v["view_type"], F.lit(":"), v["status"], F.lit(":score="), three(v["score"]))), " > ")
    return pages.select("doc_id", "page_no", best["view_type"].alias("view_type"), best["score"].alias("score"), reason.alias("reason"), chain.alias("chain"), best["flags"].alias("flags"))
