"""B: projections, filters and predicates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import filters
from lodestone.plans.registry import query
from lodestone.plans.views import Tables


@query("b01_in_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def b01(t: Tables) -> DataFrame:
    ids = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("b02_null_tolerant_status", "SELECT count(*) AS n FROM (SELECT nullif(o_orderstatus, 'F') AS s FROM orders) WHERE s IS NULL OR s <> 'O'")
def b02(t: Tables) -> DataFrame:
    rows = t.orders.select(F.nullif("o_orderstatus", F.lit("F")).alias("s"))
    return rows.filter(filters.not_equal_or_null("s", "O")).agg(F.count("*").alias("n"))


@query(
    "b03_visibility_guard",
    """SELECT o.o_orderkey FROM orders o LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey
    WHERE coalesce(c.c_mktsegment, '') NOT IN ('BUILDING', 'MACHINERY')""",
)
def b03(t: Tables) -> DataFrame:
    ready = t.customer.filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    joined = t.orders.join(ready, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.filter(filters.visible("c_mktsegment", ["BUILDING", "MACHINERY"])).select("o_orderkey")


@query("b04_substring_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%3%' AND p_type ILIKE '%a%'")
def b04(t: Tables) -> DataFrame:
    return t.part.filter(filters.like_folded("p_name", "3") & filters.like_folded("p_type", "A")).select("p_partkey", "p_name")


@query("b05_all_and_any_terms", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of') AND (contains(lower(text), 'license') OR contains(lower(text), 'password'))")
def b05(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.documents.filter(T.contains_all(low, ["the", "of"]) & T.contains_any(low, ["license", "password"])).select("doc_id")


_FRAGMENTS = ["license", "password", "mail", "rights", "the ", "der "]


@query(
    "b06_fragment_score",
    "SELECT doc_id, CAST(n AS INTEGER) AS n FROM (SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{f}') AS INTEGER)" for f in _FRAGMENTS) + " AS n FROM documents) WHERE n > 0",
)
def b06(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.match_count(F.lower("text"), _FRAGMENTS).alias("n")).filter("n > 0")


@query(
    "b07_selectivity_probe",
    "SELECT f AS fragment, count(*) AS n FROM (SELECT unnest(['license', 'password', 'copyright', 'apache', 'the ']) AS f) x JOIN documents d ON contains(lower(d.text), x.f) GROUP BY f HAVING count(*) <= 200",
)
def b07(t: Tables) -> DataFrame:
    return filters.selective_fragments(t.documents, "text", ["license", "password", "copyright", "apache", "the "], 200)


@query("b08_reverse_like", "SELECT c_custkey FROM customer WHERE contains('order of Customer#000000012 and Customer#000000345', c_name)")
def b08(t: Tables) -> DataFrame:
    return t.customer.filter(filters.contained_in("c_name", "order of Customer#000000012 and Customer#000000345")).select("c_custkey")


@query("b09_optional_filters", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 10")
def b09(t: Tables) -> DataFrame:
    return filters.where_given(t.lineitem, l_returnflag="R", l_linestatus=None).filter("l_quantity >= 10").agg(F.count("*").alias("n"))


@query("b10_typed_range", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' AND p_retailprice BETWEEN 950 AND 1400 AND p_size <= 30")
def b10(t: Tables) -> DataFrame:
    return filters.in_range(t.part.filter("p_brand = 'Brand#13'"), "p_retailprice", 950, 1400).filter("p_size <= 30").select("p_partkey")


@query("b11_window_filter", "SELECT event_id, k FROM v_props WHERE k BETWEEN 10 AND 20")
def b11(t: Tables) -> DataFrame:
    return t.v_props.filter(F.col("k").between(10, 20))


@query("b12_length_filter", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 500")
def b12(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length("text").cast("long").alias("n")).filter("n > 500")


@query(
    "b13_exact_or_all",
    """WITH x AS (SELECT doc_id, lang, contains(text, 'Apache License') AS hit FROM documents)
    SELECT doc_id, lang FROM (SELECT *, bool_or(hit) OVER (PARTITION BY lang) AS any_hit FROM x) WHERE hit OR NOT any_hit""",
)
def b13(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", F.contains("text", F.lit("Apache License")).alias("hit"))
    return filters.matching_or_all(rows, ["lang"], "hit").select("doc_id", "lang")


@query(
    "b14_preferred_scope",
    """WITH x AS (SELECT doc_id, source, lang = 'fr' AS hit FROM documents)
    SELECT doc_id, source FROM (SELECT *, bool_or(hit) OVER (PARTITION BY source) AS any_hit FROM x) WHERE hit OR NOT any_hit""",
)
def b14(t: Tables) -> DataFrame:
    return filters.matching_or_all(t.documents.select("doc_id", "source", (F.col("lang") == "fr").alias("hit")), ["source"], "hit").select("doc_id", "source")


@query("b15_intent_types", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def b15(t: Tables) -> DataFrame:
    return filters.allowed_by_intent(t.events, "event_type", {"buy": ["click", "purchase"], "look": ["view"]}, "buy").select("event_id", "event_type")


_NOISE = ["rights reserved", "http", "lorem ipsum"]


@query("b16_noise_lines", "SELECT doc_id, line_no FROM v_evidence WHERE regexp_matches(lower(normalized_text), 'rights reserved|http|lorem ipsum') OR length(normalized_text) < 12")
def b16(t: Tables) -> DataFrame:
    return t.v_evidence.filter(filters.noise("normalized_text", _NOISE, 12)).select("doc_id", "line_no")


@query("b17_navigation_noise", "SELECT count(*) AS n FROM v_evidence WHERE NOT regexp_matches(lower(normalized_text), '^(table of contents|contents|index|[0-9. ]+)$')")
def b17(t: Tables) -> DataFrame:
    return t.v_evidence.filter(~F.lower("normalized_text").rlike("^(table of contents|contents|index|[0-9. ]+)$")).agg(F.count("*").alias("n"))


@query("b18_publishable_terms", "SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM v_terms WHERE length(term) BETWEEN 2 AND 50 AND NOT regexp_matches(term, '^[0-9]') AND NOT contains(term, ':') AND term NOT IN ('the', 'of') GROUP BY term")
def b18(t: Tables) -> DataFrame:
    return t.v_terms.filter(filters.publishable("term", ["the", "of"])).groupBy("term").agg(F.sum("tf").alias("n"))


@query("b19_valid_topics", "SELECT DISTINCT p_type FROM part WHERE length(p_type) BETWEEN 4 AND 30 AND regexp_matches(p_type, '^[A-Z ]+$') AND array_length(string_split(p_type, ' ')) <= 3")
def b19(t: Tables) -> DataFrame:
    return t.part.filter(filters.valid_topic("p_type")).select("p_type").distinct()


@query("b20_code_candidates", "SELECT DISTINCT url_code FROM (SELECT unnest(regexp_extract_all(url, '[0-9]{3,6}')) AS url_code FROM pages) WHERE length(url_code) >= 4")
def b20(t: Tables) -> DataFrame:
    codes = F.filter(F.regexp_extract_all("url", F.lit("[0-9]{3,6}"), F.lit(0)), lambda x: F.length(x) >= 4)
    return t.pages.select(F.explode(codes).alias("url_code")).distinct()


@query("b21_json_predicate", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def b21(t: Tables) -> DataFrame:
    return t.events.filter(F.get_json_object("props", "$.k") == "7").select("event_id")


@query("b22_clamped_listing", "SELECT run_id, started_at FROM v_runs WHERE suite_id = 'click' ORDER BY started_at DESC, run_id DESC LIMIT 200")
def b22(t: Tables) -> DataFrame:
    rows = filters.where_given(t.v_runs, suite_id="click", code_version=None)
    return filters.listing(rows, 5000, F.desc("started_at"), F.desc("run_id")).select("run_id", "started_at")


@query("b23_case_to_null", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance FROM customer")
def b23(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("balance"))


@query("b24_calculated_text", "SELECT p_partkey, p_name || ' ' || p_brand AS title, concat_ws(' / ', p_type, nullif(p_brand, 'Brand#11')) AS path FROM part")
def b24(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("title"), F.concat_ws(" / ", "p_type", F.nullif("p_brand", F.lit("Brand#11"))).alias("path"))
