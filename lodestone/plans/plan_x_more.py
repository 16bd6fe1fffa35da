"""Further operators of the inventory, by the letter of their section."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import aggregates as A
from lodestone.operators import filters, graph, ranking
from lodestone.operators import joins as J
from lodestone.plans.registry import query
from lodestone.plans.views import Tables


@query("a09_format_dispatch", "SELECT 'html' AS source_type, page_id AS id, length(html) AS n FROM pages UNION ALL SELECT 'text', doc_id, length(text) FROM documents UNION ALL SELECT 'chat', conv_id, sum(length(text))::BIGINT FROM conversations GROUP BY conv_id")
def a09(t: Tables) -> DataFrame:
    n = lambda c: F.length(c).cast("long").alias("n")
    html = t.pages.select(F.lit("html").alias("source_type"), F.col("page_id").alias("id"), n("html"))
    text = t.documents.select(F.lit("text").alias("source_type"), F.col("doc_id").alias("id"), n("text"))
    chat = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.sum(F.length("text")).alias("n")).select(F.lit("chat").alias("source_type"), "id", "n")
    return html.unionByName(text, allowMissingColumns=True).unionByName(chat)


@query("a12_json_lines", "SELECT n_nationkey, n_name FROM nation")
def a12(t: Tables) -> DataFrame:
    from lodestone.scratch import scratch_path

    path = scratch_path(t.spark, "units")
    t.nation.write.json(path)
    return t.spark.read.schema(t.nation.schema).json(path).select("n_nationkey", "n_name")


@query("a14_embedding_input", "SELECT doc_id, length(text) AS n, CAST(ntile(16) OVER (ORDER BY doc_id) AS INTEGER) AS shard FROM documents WHERE length(text) > 50")
def a14(t: Tables) -> DataFrame:
    rows = t.documents.filter("length(text) > 50").select("doc_id", F.length("text").cast("long").alias("n"))
    return ranking.shards(rows, 16, "doc_id")


@query("a16_report_lines", "SELECT '| ' || lang || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY lang")
def a16(t: Tables) -> DataFrame:
    return A.histogram(t.documents, "lang").select(F.concat(F.lit("| "), "lang", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))


@query("d08_min_depth", "WITH RECURSIVE c AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM v_tree UNION SELECT c.node, v_tree.parent, c.depth + 1 FROM c JOIN v_tree ON v_tree.child = c.ancestor) SELECT ancestor, CAST(min(depth) AS INTEGER) AS least, CAST(max(depth) AS INTEGER) AS most, count(*) AS n FROM (SELECT node, ancestor, min(depth) AS depth FROM c GROUP BY 1, 2) GROUP BY 1")
def d08(t: Tables) -> DataFrame:
    return graph.ancestors(t.v_tree).groupBy("ancestor").agg(F.min("depth").alias("least"), F.max("depth").alias("most"), F.count("*").alias("n"))


@query("d21_tristate_match", "SELECT lang, count(*) FILTER (quality = 1) AS matched, count(*) FILTER (quality = 0) AS missed, count(*) FILTER (quality IS NULL) AS open FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def d21(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("matched"), F.count_if(F.col("quality") == 0).alias("missed"), F.count_if(F.col("quality").isNull()).alias("open"))


@query("d29_dominant_conflict", "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'error' WHEN bool_or(event_type = 'signup') THEN 'signup' WHEN bool_or(event_type = 'click') THEN 'click' ELSE min(event_type) END AS conflict FROM events WHERE event_type IN ('error', 'signup', 'click') GROUP BY 1")
def d29(t: Tables) -> DataFrame:
    order = ["error", "signup", "click"]
    return t.events.filter(F.col("event_type").isin(order)).groupBy("user_id").agg(A.dominant("event_type", order).alias("conflict"))


@query("d32_impact_counts", "SELECT CASE WHEN l_discount > 0.07 THEN 'strong' WHEN l_discount > 0.03 THEN 'weak' ELSE 'none' END AS impact_type, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS blocked FROM lineitem GROUP BY 1")
def d32(t: Tables) -> DataFrame:
    kind = A.gate(F.col("l_discount"), [(0.0700001, "strong"), (0.0300001, "weak")], "none")
    return t.lineitem.groupBy(kind.alias("impact_type")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("blocked"))


@query("e20_input_order", "SELECT p_partkey, p_name, pos FROM part JOIN (VALUES (7, 1), (3, 2), (12, 3), (1, 4)) v(id, pos) ON p_partkey = id")
def e20(t: Tables) -> DataFrame:
    ids = t.spark.createDataFrame([(7, 1), (3, 2), (12, 3), (1, 4)], "p_partkey long, pos int")
    return t.part.join(F.broadcast(ids), "p_partkey").select("p_partkey", "p_name", "pos").orderBy("pos")  # four rows


@query(
    "f09_paths_by_length",
    """WITH RECURSIVE p AS (SELECT src AS start, dst AS node, 1 AS hops, [src, dst] AS path FROM v_edges WHERE src = 'C5'
    UNION ALL SELECT p.start, e.dst, p.hops + 1, list_append(p.path, e.dst) FROM p JOIN v_edges e ON e.src = p.node WHERE p.hops < 3 AND NOT list_contains(p.path, e.dst))
    SELECT CAST(hops AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM p ORDER BY hops, path""",
)
def f09(t: Tables) -> DataFrame:
    return graph.simple_paths(t.v_edges, t.spark.createDataFrame([("C5",)], "node string"), 3).select("hops", "path").orderBy("hops", "path")


@query("g02_distinct_recursion", "WITH RECURSIVE c AS (SELECT child, parent FROM v_tree UNION SELECT c.child, v_tree.parent FROM c JOIN v_tree ON v_tree.child = c.parent) SELECT child, parent FROM c")
def g02(t: Tables) -> DataFrame:
    return graph.ancestors(t.v_tree).select(F.col("node").alias("child"), F.col("ancestor").alias("parent"))


@query("g06_symmetric_classes", "SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'kept' END AS change, count(*) AS n FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') b ON a.k = b.k GROUP BY 1")
def g06(t: Tables) -> DataFrame:
    part = lambda f: t.lineitem.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")).distinct().withColumn("v", F.lit(1))
    change = F.when(F.col("change") == "unchanged", "kept").otherwise(F.col("change"))
    return J.compared(part("R"), part("A"), "k", "v").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query("h06_bigram_tokens", "SELECT DISTINCT p_type, substr(p_type, CAST(i AS INTEGER), 2) AS g FROM (SELECT p_type, unnest(generate_series(1, length(p_type) - 1)) AS i FROM part)")
def h06(t: Tables) -> DataFrame:
    return t.part.select("p_type").distinct().select("p_type", F.explode(F.array_distinct(T.grams("p_type", 2))).alias("g"))


@query("h23_term_roles", "SELECT doc_id, CASE WHEN contains(text, '\"') THEN 'must' WHEN contains(text, ' not ') THEN 'negative' ELSE 'should' END AS role FROM documents")
def h23(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.classify("text", [('"', "must"), (" not ", "negative")], "should").alias("role"))


@query("h38_view_score", "SELECT doc_id, round(0.5 * least(n_chars / 1000, 1) + 0.3 * CASE WHEN lang = 'en' THEN 1 ELSE 0 END - 0.2 * CASE WHEN contains(text, '!!') THEN 1 ELSE 0 END, 6) AS score FROM documents")
def h38(t: Tables) -> DataFrame:
    parts = t.documents.select("doc_id", F.least(F.col("n_chars") / 1000, F.lit(1.0)).alias("a"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("b"), F.contains("text", F.lit("!!")).cast("double").alias("c"))
    return parts.select("doc_id", F.round(A.weighted({"a": 0.5, "b": 0.3, "c": -0.2}), 6).alias("score"))


@query("h41_weight_maps", "SELECT term, CAST(sum(tf * CASE term WHEN 'the' THEN 1 WHEN 'license' THEN 5 ELSE 0 END) AS BIGINT) AS w FROM v_terms WHERE term IN ('the', 'license', 'of') GROUP BY 1")
def h41(t: Tables) -> DataFrame:
    w = F.coalesce(T.literal_map({"the": 1, "license": 5})[F.col("term")], F.lit(0))
    return t.v_terms.filter(F.col("term").isin("the", "license", "of")).groupBy("term").agg(F.sum(F.col("tf") * w).alias("w"))


@query("i08_staleness_guard", "SELECT count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id)")
def i08(t: Tables) -> DataFrame:
    rows = J.with_flag(t.documents.select("doc_id"), t.labels, "doc_id", "doc_id", "indexed")
    return rows.agg(F.count_if(~F.col("indexed")).alias("missing"), F.count("*").alias("n"))


@query("i10_seeded_search", "SELECT s AS seed, count(*) AS n FROM (SELECT unnest(['license', 'password', 'mail1']) AS s) x JOIN documents ON contains(lower(text), s) GROUP BY 1")
def i10(t: Tables) -> DataFrame:
    return filters.selective_fragments(t.documents, "text", ["license", "password", "mail1"], 1 << 60).withColumnRenamed("fragment", "seed")


@query("i13_structured_score", "SELECT p_partkey, (CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0.0 END + CASE WHEN p_brand = 'Brand#2' THEN 0.8 ELSE 0.0 END + CASE WHEN contains(p_name, 'ring') THEN 0.6 ELSE 0.0 END)::DOUBLE AS score FROM part WHERE p_type = 'ECONOMY' OR p_brand = 'Brand#2' OR contains(p_name, 'ring')")
def i13(t: Tables) -> DataFrame:
    a, b, c = F.col("p_type") == "ECONOMY", F.col("p_brand") == "Brand#2", F.contains("p_name", F.lit("ring"))
    score = a.cast("double") + b.cast("double") * 0.8 + c.cast("double") * 0.6
    return t.part.filter(J.either(a, b, c)).select("p_partkey", F.round(score, 6).alias("score"))


@query("i41_answer_confidence", "SELECT user_id, round(greatest(0, least(1, 0.3 + 0.05 * count(*) FILTER (event_type = 'purchase') - 0.04 * count(*) FILTER (event_type = 'error'))), 4)::DOUBLE AS confidence FROM events GROUP BY 1")
def i41(t: Tables) -> DataFrame:
    n = lambda k: F.count_if(F.col("event_type") == k)
    return t.events.groupBy("user_id").agg(F.round(T.clamp(0.3 + 0.05 * n("purchase") - 0.04 * n("error")), 4).alias("confidence"))


@query("i44_multi_query_merge", "SELECT doc_id, max(s) AS score FROM (SELECT doc_id, 3 AS s FROM documents WHERE contains(text, 'MIT') UNION ALL SELECT doc_id, 2 FROM documents WHERE contains(text, 'Apache') UNION ALL SELECT doc_id, 1 FROM documents WHERE contains(text, 'License')) GROUP BY 1")
def i44(t: Tables) -> DataFrame:
    hit = lambda w, s: t.documents.filter(F.contains("text", F.lit(w))).select("doc_id", F.lit(s).alias("score"))
    return ranking.keep_best(hit("MIT", 3).unionByName(hit("Apache", 2)).unionByName(hit("License", 1)), ["doc_id"], F.desc("score"))


@query("j02_scope_rebuild", "SELECT relation, count(*) AS n FROM v_edges WHERE relation <> 'supplies' GROUP BY 1 UNION ALL SELECT 'supplies', count(*) FROM v_edges WHERE relation = 'supplies' AND src < 'S5'")
def j02(t: Tables) -> DataFrame:
    from lodestone.operators.maintenance import replace_groups

    e = t.v_edges
    return A.histogram(replace_groups(e, e.filter("relation = 'supplies' and src < 'S5'"), "relation"), "relation")


@query("j07_depth_capped_walk", "WITH RECURSIVE c AS (SELECT child AS node, parent AS up, 1 AS depth FROM v_tree WHERE child LIKE 'C1%' UNION ALL SELECT c.node, v_tree.parent, c.depth + 1 FROM c JOIN v_tree ON v_tree.child = c.up WHERE c.depth < 2) SELECT node, up, CAST(depth AS INTEGER) AS depth FROM c")
def j07(t: Tables) -> DataFrame:
    return graph.ancestors(t.v_tree, 2).filter("node like 'C1%'").select("node", F.col("ancestor").alias("up"), "depth")


@query("j20_type_filter", "SELECT e.src, e.dst FROM v_edges e JOIN v_entities a ON a.entity_id = e.src JOIN v_entities b ON b.entity_id = e.dst WHERE a.entity_type = 'supplier' AND b.entity_type = 'nation'")
def j20(t: Tables) -> DataFrame:
    n = t.v_entities
    a, b = n.filter("entity_type = 'supplier'").select(F.col("entity_id").alias("src")), n.filter("entity_type = 'nation'").select(F.col("entity_id").alias("dst"))
    return t.v_edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


@query("k06_view_selection", "SELECT source, arg_max(doc_id, n_chars * 1000000 - doc_id) AS best, count(*) AS candidates FROM documents GROUP BY 1")
def k06(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.max_by("doc_id", F.col("n_chars") * 1000000 - F.col("doc_id")).alias("best"), F.count("*").alias("candidates"))


@query("k17_gap_candidates", "SELECT p_type, p_partkey FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)) WHERE n <= 5")
def k17(t: Tables) -> DataFrame:
    used = t.lineitem.filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")).distinct()
    open_ = t.part.join(used, "p_partkey", "left_anti")
    return ranking.top_per_group(open_, ["p_type"], 5, F.desc("p_retailprice"), "p_partkey").select("p_type", "p_partkey")


@query("k20_diagnostics", "SELECT source, count(*) AS docs, round(avg(n_chars), 4) AS mean_chars, CASE WHEN avg(n_chars) < 1500 THEN 'thin' ELSE 'fine' END AS attribution FROM documents GROUP BY 1")
def k20(t: Tables) -> DataFrame:
    per = t.documents.groupBy("source").agg(F.count("*").alias("docs"), F.avg("n_chars").alias("m"))
    return per.select("source", "docs", F.round("m", 4).alias("mean_chars"), F.when(F.col("m") < 1500, "thin").otherwise("fine").alias("attribution"))


@query("k22_term_sync", "SELECT DISTINCT term FROM v_terms WHERE length(term) >= 12 AND term NOT IN (SELECT term FROM v_terms WHERE doc_id % 2 = 0)")
def k22(t: Tables) -> DataFrame:
    terms = t.v_terms
    return terms.filter("length(term) >= 12").select("term").distinct().join(terms.filter("doc_id % 2 = 0").select("term").distinct(), "term", "left_anti")


@query("k23_risk_actions", "SELECT CASE WHEN n_chars < 100 THEN 'reparse' WHEN contains(text, '!!') THEN 'clean' ELSE 'none' END AS action, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def k23(t: Tables) -> DataFrame:
    action = F.when(F.col("n_chars") < 100, "reparse").when(F.contains("text", F.lit("!!")), "clean").otherwise("none")
    return t.documents.groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("k27_text_repair", "SELECT doc_id, line_no, regexp_replace(regexp_replace(normalized_text, '!!+', '', 'g'), '\\s{2,}', ' ', 'g') AS s FROM v_evidence WHERE contains(normalized_text, '!!')")
def k27(t: Tables) -> DataFrame:
    s = F.regexp_replace(F.regexp_replace("normalized_text", "!!+", ""), r"\s{2,}", " ")
    return t.v_evidence.filter(F.contains("normalized_text", F.lit("!!"))).select("doc_id", "line_no", s.alias("s"))


@query("l14_intents", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'license') THEN 'license' WHEN regexp_matches(lower(text), 'password|secret') THEN 'security' ELSE 'general' END AS intent FROM documents")
def l14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.classify(F.lower("text"), [("license", "license"), ("password|secret", "security")], "general").alias("intent"))


@query("m05_question_quota", "SELECT lang, doc_id, 'What does document ' || doc_id || ' say?' AS question FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE n_chars > 300) WHERE n <= 7")
def m05(t: Tables) -> DataFrame:
    top = ranking.top_per_group(t.documents.filter("n_chars > 300").select("lang", "doc_id"), ["lang"], 7, "doc_id")
    return top.withColumn("question", F.concat(F.lit("What does document "), F.col("doc_id").cast("string"), F.lit(" say?")))


@query("m07_run_diagnostics", "SELECT suite_id, count(*) FILTER (score < 5) AS weak, concat_ws(',', CASE WHEN count(*) FILTER (score < 5) > 30 THEN 'many_weak' END, CASE WHEN max(score) > 200 THEN 'outlier' END) AS flags FROM v_runs GROUP BY 1")
def m07(t: Tables) -> DataFrame:
    per = t.v_runs.groupBy("suite_id").agg(F.count_if(F.col("score") < 5).alias("weak"), F.max("score").alias("top"))
    return per.select("suite_id", "weak", A.issues(many_weak=F.col("weak") > 30, outlier=F.col("top") > 200).alias("flags"))


@query("m10_task_sync", "SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'resolved' WHEN a.user_id IS NULL THEN 'open' ELSE 'reopened' END AS status FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND event_id < 300) a FULL JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND event_id >= 300) b ON a.user_id = b.user_id")
def m10(t: Tables) -> DataFrame:
    e = t.events.filter("event_type = 'error'")
    old, new = (e.filter(c).select("user_id").distinct().withColumn("v", F.lit(1)) for c in ("event_id < 300", "event_id >= 300"))
    status = T.literal_map({"removed": "resolved", "added": "open", "unchanged": "reopened"})[F.col("change")]
    return J.compared(old, new, "user_id", "v").select("user_id", status.alias("status"))


@query("m16_source_trace", "SELECT b.item_id, count(d.doc_id) AS sources FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def m16(t: Tables) -> DataFrame:
    # Passages meet documents on word runs, and whole containment is verified after.
    items = t.benchmark.withColumnRenamed("text", "passage")
    near = J.containing(t.documents, "doc_id", "text", items, "passage")
    found = near.join(items, "passage").join(t.documents.select("doc_id", "text"), "doc_id").filter(F.contains("text", F.col("passage")))
    n = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("sources"))
    return items.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("sources", F.lit(0)).alias("sources"))
