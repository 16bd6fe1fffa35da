"""Text normalisers, tokenisers, extractors and classifiers as Column expressions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reference's token pattern and CJK range.
TOKEN = r"[a-z0-9./-]+"
CJK = "一-鿿"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Whitespace runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def normalise(c: Column | str) -> Column:
    return F.lower(collapse(c))


#: Letters by their upper-case letter, each one letter: the title form where the upper form has several, none for ligatures.
_UPPER = {c: u for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if (u := c.upper() if len(c.upper()) == 1 else c.title()) != c and len(u) == 1} | {"ß": "ẞ"}


def simple_upper(c: Column | str) -> Column:
    """Upper case letter by letter, as in SQL engines: the number of characters stays (Spark's own makes SS of ß)."""
    ascii_, s = "abcdefghijklmnopqrstuvwxyz", col(c)
    return F.when(F.octet_length(s) == F.length(s), F.upper(s)).otherwise(F.translate(s, ascii_ + "".join(_UPPER), ascii_.upper() + "".join(_UPPER.values())))


def simple_lower(c: Column | str) -> Column:
    """Lower case letter by letter: no dot of its own for the dotted I, one sigma wherever it stands."""
    s = col(c)
    return F.lower(F.when(F.contains(s, F.lit("İ")) | F.contains(s, F.lit("Σ")), F.translate(s, "İΣ", "iσ")).otherwise(s))


def tokens(c: Column | str) -> Column:
    """Lower-case tokens and CJK runs, in order."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"{TOKEN}|[{CJK}]+"), F.lit(0))


def latin_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) postings; partial counts are made before the shuffle."""
    return df.select(key, F.explode(latin_tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def cjk_characters(c: Column | str) -> Column:
    """The CJK characters of a string, each an item."""
    return F.regexp_extract_all(col(c), F.lit(f"[{CJK}]"), F.lit(0))


def array_grams(characters: str, n: int) -> Column:
    """All n-grams of an array column of characters; none if it is shorter."""
    many = F.transform(F.sequence(F.lit(1), F.size(characters) - (n - 1)), lambda i: F.array_join(F.slice(characters, i, n), ""))
    return F.when(F.size(characters) >= n, many).otherwise(F.array().cast("array<string>"))


def grams(c: Column | str, n: int) -> Column:
    """All character n-grams of a string; none if it is shorter."""
    s = col(c)
    many = F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))
    return F.when(F.length(s) >= n, many).otherwise(F.array().cast("array<string>"))


def cjk(c: Column | str) -> Column:
    """The CJK characters of a string, gaps removed."""
    return F.regexp_replace(col(c), f"[^{CJK}]", "")


def index_terms(c: Column | str) -> Column:
    """Normalised text, tokens and CJK 2- and 3-grams, as an array."""
    return F.concat(F.array(normalise(c)), tokens(c), grams(cjk(c), 2), grams(cjk(c), 3))


def compact(c: Column | str) -> Column:
    """Comparison key: lower case, without blanks, `_`, `/`; long dashes become hyphens."""
    return F.regexp_replace(F.translate(F.lower(col(c)), "—–", "--"), r"[\s_/]+", "")


def strip_marks(c: Column | str) -> Column:
    """Upper case letters and digits alone (ASCII)."""
    return F.upper(F.regexp_replace(col(c), "[^A-Za-z0-9]+", ""))


def standard_code(c: Column | str) -> Column:
    """GBT to GB/T, dash forms to hyphens, blanks dropped, upper case."""
    return F.regexp_replace(F.upper(F.regexp_replace(F.translate(col(c), "—–", "--"), r"\s+", "")), "GBT", "GB/T")


def canonical_name(c: Column | str) -> Column:
    """Collapsed, without "(E)" and a trailing year from 1950 to 2099, dashes folded."""
    s = F.translate(collapse(c), "—–", "--")
    s = F.regexp_replace(s, r"\s*\(E\)\s*$", "")
    return F.regexp_replace(s, r"\s*[-:]\s*(19[5-9][0-9]|20[0-9][0-9])\s*$", "")


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_with_hash(c: Column | str) -> Column:
    return F.concat(slug(c), F.lit("-"), F.substring(F.md5(col(c)), 1, 8))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """Prefix and the first twelve upper-case hex digits of SHA-1 over the parts joined by `|`."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha1(F.concat_ws("|", *(col(p).cast("string") for p in parts))), 1, 12)))


def strip_tags(c: Column | str) -> Column:
    """HTML to text: scripts, styles and tags dropped, five entities decoded, blanks collapsed."""
    s = F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(s, "(?s)<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(plain))
    return collapse(s)


def first_sentence(c: Column | str) -> Column:
    return F.trim(F.element_at(F.split(col(c), "[。；.!?]"), 1))


def truncate(c: Column | str, n: int) -> Column:
    s = col(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def classify(c: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that occurs."""
    out = F.when(F.lit(False), F.lit(default))
    for pattern, label in rules:
        out = out.when(col(c).rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(default))


def contains_any(c: Column | str, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(col(c), F.lit(w)) for w in words))


def contains_all(c: Column | str, words: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.contains(col(c), F.lit(w)) for w in words))


def match_count(c: Column | str, words: list[str]) -> Column:
    """How many of the words occur."""
    return reduce(lambda a, b: a + b, (F.contains(col(c), F.lit(w)).cast("int") for w in words))


def share_of(c: Column | str, chars: str) -> Column:
    """The share of characters in a class like `A-Za-z`; 0 for an empty string."""
    s = col(c)
    n = F.length(s)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(s, f"[{chars}]", ""))) / n)


def range_value(c: Column | str) -> Column:
    """Struct nominal, low, high, unit of "50 ± 10 ms", "50+/-10 ms", "10..20 Hz", "12.5 V" or "100"."""
    s = F.trim(col(c))
    number, unit = r"(-?[0-9]+(?:\.[0-9]+)?)", r"\s*([A-Za-z%Ωµ°]*)"
    tol, span, one = f"^{number}\\s*(?:±|\\+/-)\\s*{number}{unit}$", f"^{number}\\s*(?:\\.\\.|~)\\s*{number}{unit}$", f"^{number}{unit}$"
    part = lambda p, k: F.regexp_extract(s, p, k)
    num = lambda p, k: part(p, k).cast("double")
    named = lambda p, k: F.nullif(part(p, k), F.lit(""))
    build = lambda a, b, d, u: F.struct(a.alias("nominal"), b.alias("low"), d.alias("high"), u.alias("unit"))
    return (
        F.when(s.rlike(tol), build(num(tol, 1), num(tol, 1) - num(tol, 2), num(tol, 1) + num(tol, 2), named(tol, 3)))
        .when(s.rlike(span), build((num(span, 1) + num(span, 2)) / 2, num(span, 1), num(span, 2), named(span, 3)))
        .when(s.rlike(one), build(num(one, 1), num(one, 1), num(one, 1), named(one, 2)))
    )


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sorted_json(*columns: str) -> Column:
    """A JSON object whose keys are in order, for signatures."""
    return F.to_json(F.struct(*sorted(columns)))


def rank_of(c: Column | str, order: list[str]) -> Column:
    """The place of a value in a fixed order, from 1; behind all for others."""
    place = F.array_position(F.array(*map(F.lit, order)), col(c))
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1)).cast("int")


def literal_map(values: dict[str, object]) -> Column:
    """A map column of fixed values."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def json_array(values: list[str]) -> str:
    return json.dumps(values)
