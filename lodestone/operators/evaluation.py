"""Evaluation and closed-loop operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import rules as R


# Answers that say that there is no answer, stop words, and the share of a point that counts as covered.
REFUSALS = ("当前候选证据不足以给出确定性答案", "知识库中未找到与该查询相关的信息", "知识库中未找到", "未找到", "无法回答", "无法给出", "insufficient evidence", "not found")
COVERED = 0.3


def _key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(R.fold_width(c)), r"\s+", "")


def retrieval_quality(hits: DataFrame, anchors: DataFrame, min_recall: float = 0.8) -> DataFrame:
    """case_id, must, found, best_rank, recall_at_5, recall_at_10, mrr, negatives, attribution.

    `hits` (case_id, rank, text) meet the case's `anchors` (case_id, anchor, kind must or negative): a text has
    an anchor if it contains it, or, for one that must be there, all of its tokens (two or more); codes and
    negative anchors count only as they are. Anchors without letters or digits do not count."""
    code = F.col("anchor").rlike(r"(?i)^(?:[a-z]{2,6}\.\d+(?:\.bp\d+)?|[a-z]{2,6}\d+bp\d+)$")
    parts = F.regexp_extract_all(F.lower("anchor"), F.lit(r"[a-z]{2,}|\d+(?:\.\d+)?|[一-鿿]+"), F.lit(0))
    parts = F.array_distinct(F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit("且和及与的是了"))), lambda x: (F.length(x) >= 2) | x.rlike(r"^\d+$")))
    asked = anchors.select("case_id", "anchor", "kind", _key("anchor").alias("__key"), F.when((F.col("kind") == "must") & ~code, parts).alias("__parts")).filter("__key <> ''").distinct()
    said = hits.select("case_id", "rank", _key("text").alias("__text"))
    whole = F.contains("__text", F.col("__key"))
    pieces = F.coalesce((F.size("__parts") >= 2) & F.forall("__parts", lambda x: F.contains("__text", x)), F.lit(False))
    first = said.join(asked, "case_id").groupBy("case_id", "anchor", "kind").agg(F.min(F.when(whole | pieces, F.col("rank"))).alias("rank"))
    ranks = asked.select("case_id", "anchor", "kind").join(first, ["case_id", "anchor", "kind"], "left")
    must, bad = F.col("kind") == "must", F.col("kind") == "negative"
    out = ranks.groupBy("case_id").agg(
        F.count_if(must).alias("must"), F.count_if(must & F.col("rank").isNotNull()).alias("found"), F.min(F.when(must, F.col("rank"))).alias("best_rank"),
        F.count_if(must & (F.col("rank") <= 5)).alias("__5"), F.count_if(must & (F.col("rank") <= 10)).alias("__10"), F.count_if(bad & F.col("rank").isNotNull()).alias("negatives"),
    )
    recall = lambda c: F.round(F.col(c) / F.greatest("must", F.lit(1)), 6)
    why = (
        F.when(F.col("negatives") > 0, "negative_hit").when((F.col("must") > 0) & (F.col("found") == 0), "retrieval_miss")
        .when(F.col("best_rank") > 5, "rank_too_low").when((F.col("must") > 0) & (recall("__5") < min_recall), "recall_at_5_below_threshold").otherwise("ok")
    )
    return out.select("case_id", "must", "found", "best_rank", recall("__5").alias("recall_at_5"), recall("__10").alias("recall_at_10"), F.round(F.coalesce(1 / F.col("best_rank"), F.lit(0.0)), 6).alias("mrr"), "negatives", why.alias("attribution"))


def retrieval_run(hits: DataFrame, texts: DataFrame, anchors: DataFrame, item: str = "doc_id", text: str = "text") -> DataFrame:
    """`retrieval_quality` of the hits (query_id, item, score) of all cases at once, ranked by score, over their texts."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), item)
    ranked = hits.withColumn("rank", F.row_number().over(w)).join(texts.select(item, F.col(text).alias("text")), item)
    return retrieval_quality(ranked.select(F.col("query_id").alias("case_id"), "rank", "text"), anchors)


def tokens(c: Column | str) -> Column:
    """The distinct tokens that coverage counts: Chinese terms of 2 to 8 characters, numbers with units, codes of
    standards, and every single letter or digit."""
    s = F.col(c) if isinstance(c, str) else c
    found = lambda p: F.regexp_extract_all(s, F.lit(p), F.lit(0))
    codes = F.transform(found(r"GB[/T]?\s*\d+[\.\d]*[-—]\d+"), lambda x: F.replace(x, F.lit(" "), F.lit("")))
    single = F.filter(F.split(F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}]", "")), ""), lambda x: x != "")
    return F.array_distinct(F.concat(found("[一-鿿]{2,8}"), found(r"\d+\.?\d*\s*[A-Za-zΩμ°℃％%]+"), codes, single))


def coverage(answer: Column | str, points: Column) -> Column:
    """The mean share of the points' tokens that an answer has, rounded to six digits; 0 for refusals, blank answers and no points."""
    s = F.col(answer) if isinstance(answer, str) else answer
    refused = reduce(lambda a, b: a | b, (F.contains(s, F.lit(m)) for m in REFUSALS), F.trim(s) == "")
    said = tokens(s)
    share = F.transform(points, lambda p: F.coalesce(F.size(F.array_intersect(said, tokens(p))) / F.nullif(F.size(tokens(p)), F.lit(0)), F.lit(0.0)))
    mean = F.aggregate(share, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(points), F.lit(0))
    return F.round(F.when(F.coalesce(refused, F.lit(True)), 0.0).otherwise(F.coalesce(mean, F.lit(0.0))), 6)


def token_overlap(answer: Column, point: Column) -> Column:
    """The share of the point's distinct tokens that the answer has."""
    return F.round(F.coalesce(F.size(F.array_intersect(answer, point)) / F.nullif(F.size(F.array_distinct(point)), F.lit(0)), F.lit(0.0)), 6)


def run_deltas(runs: DataFrame, suite: str, at: str, metrics: list[str]) -> DataFrame:
    """Each run with its metrics' changes against the suite's run before."""
    w = Window.partitionBy(suite).orderBy(at)
    return runs.select("*", *(F.round(F.col(m) - F.lag(m).over(w), 6).alias(f"{m}_delta") for m in metrics))


def merge_golden(stored: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, status): incoming cases are active, those that are no longer there deprecated."""
    a = stored.select(F.col(key), F.col(value).alias("__old"), F.lit(True).alias("__s"))
    b = incoming.select(F.col(key), F.col(value).alias("__new"), F.lit(True).alias("__i"))
    status = F.when(F.col("__i").isNull(), "deprecated").when(F.col("__s").isNull(), "added").when(F.col("__old").eqNullSafe(F.col("__new")), "active").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, F.coalesce("__new", "__old").alias(value), status.alias("status"))


def readiness(penalties: dict[str, tuple[Column, int]], reject: Column) -> tuple[Column, Column]:
    """(score, status): 100 less the penalties that apply, held to 0..100, and what follows from it."""
    points = F.lit(100)
    for condition, n in penalties.values():
        points = points - F.when(condition, n).otherwise(0)
    score = F.greatest(F.lit(0), points)
    return score, F.when(reject, "reject").when(score >= 85, "promotable").when(score >= 60, "ready_for_validation").otherwise("needs_review")


# ---- feedback and packages -----------------------------------------------------------------------

# What an answer can lack, and words of requirements.
LACKS = ("incomplete_answer", "inaccurate_answer", "retrieval_miss", "irrelevant_answer", "missing_evidence", "unclear_term")
REQUIRING = "应|必须|不得|不应|需|需要|要求|shall|must|should|require"


def accepted_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback whose satisfaction and category are known; the rest is refused."""
    return feedback.filter(F.col("satisfaction").isin("satisfied", "unsatisfied") & F.col("category").isin(*LACKS))


def reflected(feedback: DataFrame) -> DataFrame:
    """Unsatisfied feedback (category, hits, confidence, doc_id) with root_cause and action: what the search found and how sure
    the answer was tell apart causes of one category."""
    c, none = F.col("category"), F.coalesce(F.col("hits"), F.lit(0)) == 0
    cause = (
        F.when(c == "retrieval_miss", F.when(none, "fact_extraction_gap").otherwise("retrieval_quality_low")).when(c == "incomplete_answer", "knowledge_extraction_incomplete")
        .when(c == "inaccurate_answer", F.when(F.col("confidence") < 0.5, "low_confidence_answer").otherwise("fact_quality_low")).when(c == "irrelevant_answer", "intent_mismatch")
        .when(c == "missing_evidence", "evidence_link_missing").otherwise("term_definition_missing")
    )
    action = F.when(c == "retrieval_miss", F.when(none, "rebuild_coverage").otherwise("auto_activate_golden")).when(c == "incomplete_answer", F.when(F.col("doc_id").isNotNull(), "rebuild_coverage")).otherwise("review")
    return feedback.filter("satisfaction = 'unsatisfied'").withColumn("root_cause", cause).withColumn("action", action)


def imported(sources: DataFrame, package: str, text: str) -> DataFrame:
    """package, candidates, promoted: the distinct sentences of a package's sources that state a requirement or a number are
    candidates, and those with a number, which can be held against measurements, are promoted at once."""
    parts = sources.select(package, F.explode(F.split(text, r"[\n。；;.!?]+")).alias("part")).withColumn("part", F.trim("part")).filter("part <> ''")
    found = parts.filter(F.lower("part").rlike(f"{REQUIRING}|[0-9]")).distinct()
    return found.groupBy(package).agg(F.count("*").alias("candidates"), F.count_if(F.col("part").rlike("[0-9]")).alias("promoted"))


# ---- failures, golden cases and comparisons --------------------------------------------------------

# What a failed answer's attribution means, and words of a failure's reason, first match first.
FAILED_ANSWERS = {
    "answer_render_artifact": "answer_render_artifact", "forbidden_content": "llm_generation_wrong", "answer_mode_wrong": "answer_policy_wrong", "evidence_shape_wrong": "evidence_shape_wrong",
    "evidence_not_sufficient": "evidence_judge_wrong", "fallback_answer": "answer_policy_wrong", "citation_missing": "citation_missing",
}
REASONS = (
    ("parse", "parse_missing"), ("evidence", "evidence_missing"), ("unit", "source_unit_missing"), ("graph", "graph_path_missing"), ("judge", "evidence_judge_wrong"), ("policy|answer_mode", "answer_policy_wrong"),
    ("llm|generation", "llm_generation_wrong"), ("rerank", "rerank_wrong"), ("retrieval|miss", "retrieval_miss"),
)
BLOCKING = ("missing_query", "missing_assertion_signal", "candidate_tier_blocked", "eval_failure_missing_stable_expected_contract", "ontology_gap_generation_not_implemented")


def failure_types(cases: DataFrame) -> DataFrame:
    """Failed cases (reason, attribution, entities noisy, graph_candidates, expects_graph, topic_confidence, assert_mode, retrieved,
    answer) with `failure`: what the answer's check said, else noise, graph and topic, else the words of the reason."""
    table = F.create_map(*(F.lit(x) for pair in FAILED_ANSWERS.items() for x in pair))
    reason, answer = F.lower(F.coalesce("reason", F.lit(""))), F.coalesce("answer", F.lit(""))
    chain = F.when(reason.rlike("shape"), "evidence_shape_wrong").when(F.col("noisy"), "entity_quality_pollution").when((F.col("graph_candidates") == 0) & F.col("expects_graph"), "graph_not_engaged").when(F.col("topic_confidence") <= 0, "topic_resolution_wrong")
    for pattern, kind in REASONS:
        chain = chain.when(reason.rlike(pattern), kind)
    context = F.col("assert_mode") == "context_contains"
    last = chain.when(context & (F.col("retrieved") == 0), "retrieval_miss").when(~context & (answer != ""), "answer_policy_wrong").otherwise("unknown")
    return cases.withColumn("failure", F.coalesce(table[F.col("attribution")], last))


def activation(candidates: DataFrame) -> DataFrame:
    """Golden candidates (query, signals, tier, origin, expects) with `reasons` and `readiness`: blocked, review_required, active or ready."""
    reasons = {
        "missing_query": F.trim(F.coalesce("query", F.lit(""))) == "", "missing_assertion_signal": F.coalesce("signals", F.lit(0)) == 0, "candidate_tier_blocked": F.col("tier") == "blocked", "corpus_eval_requires_review": F.col("tier") == "corpus_eval",
        "eval_failure_missing_stable_expected_contract": (F.col("origin") == "eval_failure") & ~F.coalesce("expects", F.lit(False)), "ontology_gap_generation_not_implemented": F.col("origin") == "ontology_gap",
    }
    names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items())))
    rows = candidates.withColumn("reasons", names)
    state = F.when(F.arrays_overlap("reasons", F.array(*map(F.lit, BLOCKING))), "blocked").when(F.size("reasons") > 0, "review_required").when(F.col("tier") == "golden_active", "active").otherwise("ready")
    return rows.withColumn("readiness", state)


def stale_cases(cases: DataFrame, documents: DataFrame, doc: str, made: str, updated: str) -> DataFrame:
    """(doc, total, stale): cases older than their document's last update; those of unknown documents are fresh."""
    both = cases.join(documents.select(doc, F.col(updated).alias("__updated")), doc, "left")
    return both.groupBy(doc).agg(F.count("*").alias("total"), F.count_if(F.col(made) < F.col("__updated")).alias("stale"))


def quality_summary(quality: DataFrame, by: list[str]) -> DataFrame:
    """by, cases, recall_at_5, recall_at_10, mrr, negative_rate, failures of `retrieval_quality` rows."""
    mean = lambda c: F.round(F.avg(c), 6)
    negative = F.round(F.avg((F.col("negatives") > 0).cast("int")), 6)
    return quality.groupBy(*by).agg(F.count("*").alias("cases"), mean("recall_at_5").alias("recall_at_5"), mean("recall_at_10").alias("recall_at_10"), mean("mrr").alias("mrr"), negative.alias("negative_rate"), F.count_if(F.col("attribution") != "ok").alias("failures"))


def compared_answers(old: DataFrame, new: DataFrame, key: str, category: str, ok: str) -> DataFrame:
    """category, questions, old_passed, new_passed, gained, lost of two runs over the same questions; a question that
    a run lacks failed there."""
    a, b = old.select(key, F.col(category).alias("__c1"), F.col(ok).alias("__old")), new.select(key, F.col(category).alias("__c2"), F.col(ok).alias("__new"))
    both = a.join(b, key, "full_outer").select(F.coalesce("__c1", "__c2").alias(category), F.coalesce("__old", F.lit(False)).alias("o"), F.coalesce("__new", F.lit(False)).alias("n"))
    return both.groupBy(category).agg(F.count("*").alias("questions"), F.count_if("o").alias("old_passed"), F.count_if("n").alias("new_passed"), F.count_if(~F.col("o") & F.col("n")).alias("gained"), F.count_if(F.col("o") & ~F.col("n")).alias("lost"))


def hotspots(queries: DataFrame, doc: str, confidence: str, least: int, below: float) -> DataFrame:
    """(doc, n, mean): documents with at least `least` answers under confidence `below`, which are to be looked at."""
    return queries.filter(F.col(confidence) < below).groupBy(doc).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("mean")).filter(F.col("n") >= least)

