"""Scores are summed in tasks of so many texts."""

from lodestone.operators import retrieval


def test_scores_are_dealt_by_text(spark):
    hits = spark.range(40).selectExpr("id AS doc_id", "1L AS dl", "1D AS norm", "'b' AS term", "1L AS tf")
    asked = spark.createDataFrame([(1, "b", 1)], "query_id int, term string, tf long")
    for scored in (retrieval.bm25(hits, (40000, 1.0), asked.select("query_id", "term")), retrieval.tf_cosine(hits, 40000, asked)):
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert scored.count() == 40 and plan.count("REPARTITION_BY_NUM") == 1 and "hashpartitioning(doc_id" in plan
