"""H: scalar functions over strings, dates, numbers, arrays, maps and JSON."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans.registry import query
from lodestone.plans.views import Tables


@query("h01_normalise", "SELECT doc_id, line_no, lower(trim(regexp_replace(normalized_text, '\\s+', ' ', 'g'))) AS s FROM v_evidence")
def h01(t: Tables) -> DataFrame:
    return t.v_evidence.select("doc_id", "line_no", T.normalise("normalized_text").alias("s"))


@query("h03_char_grams", "SELECT DISTINCT p_type, substr(p_type, CAST(i AS INTEGER), 3) AS gram FROM (SELECT p_type, unnest(generate_series(1, length(p_type) - 2)) AS i FROM part)")
def h03(t: Tables) -> DataFrame:
    return t.part.select("p_type", F.explode(T.grams("p_type", 3)).alias("gram")).distinct()


@query("h04_index_terms", "SELECT p_partkey, len(regexp_extract_all(lower(p_name), '[a-z0-9./-]+')) + 1 AS n FROM part")
def h04(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.size(T.index_terms("p_name")).cast("long").alias("n"))


@query("h05_cjk_share", "SELECT doc_id, length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) AS cjk FROM documents")
def h05(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(F.regexp_replace("text", f"[^{T.CJK}]", "")).cast("long").alias("cjk"))


@query("h07_term_cap", "SELECT doc_id, least(count(*), 20) AS n FROM v_terms GROUP BY 1")
def h07(t: Tables) -> DataFrame:
    capped = F.slice(F.array_distinct(T.latin_tokens("text")), 1, 20)
    return t.documents.select("doc_id", F.size(capped).cast("long").alias("n")).filter("n > 0")


@query("h10_compact", "SELECT p_partkey, regexp_replace(translate(lower(p_name || ' — ' || p_brand), '—–', '--'), '[\\s_/]+', '', 'g') AS s FROM part")
def h10(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.compact(F.concat("p_name", F.lit(" — "), "p_brand")).alias("s"))


@query("h13_topic_compaction", "SELECT p_partkey, upper(regexp_replace(p_brand || p_type, '[^A-Za-z0-9]+', '', 'g')) AS s FROM part")
def h13(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.strip_marks(F.concat("p_brand", "p_type")).alias("s"))


@query("h16_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(md5(p_name || ' / ' || p_brand), 1, 8) AS s FROM part")
def h16(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.slug_with_hash(F.concat("p_name", F.lit(" / "), "p_brand")).alias("s"))


@query("h17_stable_ids", "SELECT event_id, 'FACT-' || upper(substr(sha1(concat_ws('|', event_type, CAST(user_id AS VARCHAR))), 1, 12)) AS id FROM events")
def h17(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.stable_id("FACT-", "event_type", "user_id").alias("id"))


@query("h20_first_sentence", "SELECT doc_id, trim(regexp_split_to_array(text, '[.!?]')[1]) AS s FROM documents")
def h20(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.first_sentence("text").alias("s"))


_RULES = [("(?i)license", "license"), ("(?i)password", "secret"), ("@", "contact"), (r"\d{3}", "number")]


@query("h22_rule_classifier", "SELECT doc_id, line_no, CASE WHEN regexp_matches(normalized_text, '(?i)license') THEN 'license' WHEN regexp_matches(normalized_text, '(?i)password') THEN 'secret' WHEN contains(normalized_text, '@') THEN 'contact' WHEN regexp_matches(normalized_text, '\\d{3}') THEN 'number' ELSE 'text' END AS kind FROM v_evidence")
def h22(t: Tables) -> DataFrame:
    return t.v_evidence.select("doc_id", "line_no", T.classify("normalized_text", _RULES, "text").alias("kind"))


@query("h36_clamped_ratio", "SELECT s_suppkey, round(greatest(0, least(1, s_acctbal / 10000)), 4) AS share FROM supplier")
def h36(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.round(T.clamp(F.col("s_acctbal") / 10000), 4).alias("share"))


@query("h37_readability", "SELECT doc_id, round((length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))) / length(text), 6) AS letters, round((length(text) - length(regexp_replace(text, '[^A-Za-z0-9\\s]', '', 'g'))) / length(text), 6) AS symbols FROM documents WHERE text <> ''")
def h37(t: Tables) -> DataFrame:
    rows = t.documents.filter("text <> ''")
    return rows.select("doc_id", F.round(T.share_of("text", "A-Za-z"), 6).alias("letters"), F.round(T.share_of("text", r"^A-Za-z0-9\s"), 6).alias("symbols"))


@query("h39_confidence_merge", "SELECT l_orderkey, l_linenumber, round(greatest(0.1, least(1, (l_discount + l_tax * 10) / 2)), 3) AS c FROM lineitem")
def h39(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(T.clamp((F.col("l_discount") + F.col("l_tax") * 10) / 2, 0.1, 1.0), 3).alias("c"))


@query("h43_json_build", "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS doc FROM nation")
def h43(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", T.sorted_json("n_regionkey", "n_name").alias("doc"))
