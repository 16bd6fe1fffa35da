"""I: full-text, semantic and vector retrieval; reranking."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import retrieval as R
from lodestone.operators import vectors
from lodestone.operators.joins import with_flag
from lodestone.operators.textindex import TextIndex
from lodestone.plans.registry import query
from lodestone.plans.views import Tables
from lodestone.scratch import scratch_path

#: Questions over the test documents.
QUESTIONS = [(1, "the license of the password"), (2, "general public license version"), (3, "all rights reserved"), (4, "erre der und schein"), (5, "mail address of the order")]
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS)
_Q = f"""asked AS (SELECT query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9./-]+')) AS term FROM (VALUES {_VALUES}) v(query_id, question)),
q AS (SELECT query_id, term, count(*) AS tf FROM asked GROUP BY 1, 2)"""
_BM25 = f"""{_Q}, dl AS (SELECT doc_id, sum(tf) AS dl FROM v_terms GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl), df AS (SELECT term, count(*) AS df FROM v_terms GROUP BY 1),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * v_terms.tf * 2.2 / (v_terms.tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
  FROM v_terms JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2)"""
_COS = """, qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS n FROM q GROUP BY 1), dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS n FROM v_terms GROUP BY 1),
cs AS (SELECT query_id, doc_id, sum(v_terms.tf * q.tf) / (any_value(qn.n) * any_value(dn.n)) AS score FROM v_terms JOIN q USING (term) JOIN qn USING (query_id) JOIN dn USING (doc_id) GROUP BY 1, 2)"""
_TOP = "SELECT query_id, doc_id, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM (SELECT query_id, doc_id, round(score, 9) AS score FROM {0})) WHERE n <= {1}"


def asked(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(QUESTIONS, "query_id int, question string")
    return T.term_counts(rows, "query_id", "question")


def searchable(t: Tables) -> TextIndex:
    """The stored index of the documents, refreshed if they are not those it was made of."""
    return TextIndex.of(t.documents, f"{t.sf_dir}/documents")


_OLD = """older AS (SELECT doc_id, CASE WHEN toxic = 1 THEN concat('edited ', text) ELSE text END AS text FROM documents JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)
  UNION ALL SELECT -1 - item_id, text FROM benchmark)"""


@query(
    "i08_incremental_refresh",
    f"""WITH {_Q}, {_OLD}, c AS (SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN d.doc_id IS NULL THEN 'removed' WHEN d.text = o.text THEN 'kept' ELSE 'changed' END AS what
      FROM documents d FULL JOIN older o ON d.doc_id = o.doc_id)
    SELECT w AS what, (SELECT count(*) FROM c WHERE what = w) AS n, CAST(NULL AS BIGINT) AS tf FROM (VALUES ('added'), ('changed'), ('removed'), ('kept')) x(w)
    UNION ALL SELECT term, count(*), CAST(sum(tf) AS BIGINT) FROM v_terms WHERE term IN (SELECT term FROM q) GROUP BY 1""",
)
def i08(t: Tables) -> DataFrame:
    """An index of an older state of the documents (the labelled ones, toxic ones with another text, and benchmark
    passages that are gone since) is refreshed; what that did, and each asked term's texts and places afterwards."""
    toxic = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    edited = F.when(F.col("toxic") == 1, F.concat(F.lit("edited "), "text")).otherwise(F.col("text"))
    older = t.documents.join(toxic, "doc_id").select("doc_id", edited.alias("text")).unionByName(t.benchmark.select((-1 - F.col("item_id")).alias("doc_id"), "text"))
    index = TextIndex(t.spark, scratch_path(t.spark, "index"))
    index.refresh(older)
    done = t.spark.createDataFrame(list(index.refresh(t.documents).items()), "what string, n long").withColumn("tf", F.lit(None).cast("long"))
    return done.unionByName(index.hits(asked(t)).groupBy(F.col("term").alias("what")).agg(F.count("*").alias("n"), F.sum("tf").alias("tf")))


@query("i02_bm25_top_k", f"WITH {_BM25} {_TOP.format('bm', 20)}")
def i02(t: Tables) -> DataFrame:
    q = asked(t)
    index = searchable(t)
    return R.best_k(R.bm25(index.hits(q), index.size, q.select("query_id", "term")), 20)


@query("i04_tf_cosine", f"WITH {_Q}{_COS} {_TOP.format('cs', 20)}")
def i04(t: Tables) -> DataFrame:
    q = asked(t)
    index = searchable(t)
    return R.best_k(R.tf_cosine(index.hits(q), index.size[0], q), 20)


_NORM = "sqrt(list_dot_product(CAST({0}.embedding AS DOUBLE[]), CAST({0}.embedding AS DOUBLE[])))"


@query(
    "i05_dense_cosine",
    f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / ({_NORM.format('q')} * {_NORM.format('c')}), 9) AS score
    FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)
    SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 10""",
)
def i05(t: Tables) -> DataFrame:
    q = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.nearest(t.embeddings, q, 10)


_SYN = {"license": ["copyright", "apache"], "password": ["secret"]}


_HYBRID = f"""WITH {_BM25}{_COS}, u AS (SELECT query_id, doc_id, round(score * 1.0, 9) AS score, 'bm25' AS channel FROM bm UNION ALL SELECT query_id, doc_id, round(score * 0.6, 9), 'cosine' FROM cs),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, channel) AS m FROM u) WHERE m = 1)
SELECT query_id, doc_id, score, channel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM b) WHERE n <= 15"""


def hybrid_hits(t: Tables, k: int) -> DataFrame:
    q = asked(t)
    index = searchable(t)
    hits = index.hits(q)
    return R.hybrid({"bm25": (R.bm25(hits, index.size, q.select("query_id", "term")), 1.0), "cosine": (R.tf_cosine(hits, index.size[0], q), 0.6)}, k)


@query("i07_hybrid_merge", _HYBRID)
def i07(t: Tables) -> DataFrame:
    return hybrid_hits(t, 15)


@query("i09_channel_routing", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'fact' WHEN lang = 'de' THEN 'evidence' ELSE 'wiki' END AS channel, CAST(CASE WHEN lang = 'en' THEN 1.0 WHEN lang = 'de' THEN 0.96 ELSE 0.98 END AS DOUBLE) AS boost FROM documents")
def i09(t: Tables) -> DataFrame:
    route = T.literal_map({"en": "fact", "de": "evidence"})
    boost = T.literal_map({"fact": 1.0, "evidence": 0.96, "wiki": 0.98})
    rows = t.documents.select("doc_id", F.coalesce(route[F.col("lang")], F.lit("wiki")).alias("channel"))
    return rows.withColumn("boost", boost[F.col("channel")])


@query("i11_seed_hit_ratio", "SELECT doc_id, round((CAST(contains(lower(text), 'license') AS INTEGER) + CAST(contains(lower(text), 'version') AS INTEGER) + CAST(contains(lower(text), 'password') AS INTEGER)) / 3, 6) AS ratio FROM documents")
def i11(t: Tables) -> DataFrame:
    seeds = ["license", "version", "password"]
    return t.documents.select("doc_id", F.round(T.match_count(F.lower("text"), seeds) / len(seeds), 6).alias("ratio"))


@query("i15_weighted_terms", "SELECT doc_id, CAST(least(0.28 * CAST(contains(lower(text), 'license') AS INTEGER) + 0.12 * CAST(contains(lower(text), 'the') AS INTEGER) + 0.12 * CAST(contains(lower(text), 'version') AS INTEGER), 0.4) AS DOUBLE) AS score FROM documents")
def i15(t: Tables) -> DataFrame:
    low = F.lower("text")
    score = 0.28 * T.match_count(low, ["license"]) + 0.12 * T.match_count(low, ["the"]) + 0.12 * T.match_count(low, ["version"])
    return t.documents.select("doc_id", F.round(F.least(score, F.lit(0.4)), 6).alias("score"))


@query("i23_linked_evidence", "SELECT DISTINCT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND d.n_chars > 1000")
def i23(t: Tables) -> DataFrame:
    return t.documents.filter("n_chars > 1000").select("doc_id").join(t.labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi").distinct()


_RERANK = f"""WITH {_BM25}{_COS}, u AS (SELECT query_id, doc_id, round(score * 1.0, 9) AS score, 'bm25' AS channel FROM bm UNION ALL SELECT query_id, doc_id, round(score * 0.6, 9), 'cosine' FROM cs),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, channel) AS m FROM u) WHERE m = 1),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM b) WHERE n <= 40),
p AS (SELECT query_id, doc_id, score, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS quality_bonus,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END AS risk_penalty, CASE WHEN channel = 'cosine' THEN 0.04::DOUBLE ELSE 0.08::DOUBLE END AS channel_bonus FROM h),
f AS (SELECT *, round(score + quality_bonus + risk_penalty + channel_bonus, 6) AS final FROM p)
SELECT query_id, doc_id, score, quality_bonus, risk_penalty, channel_bonus, final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, doc_id) AS n FROM f) WHERE n <= 10"""


@query("i24_explained_rerank", _RERANK)
def i24(t: Tables) -> DataFrame:
    hits = with_flag(hybrid_hits(t, 40), t.labels.filter("quality = 1"), "doc_id", "doc_id", "good")
    hits = with_flag(hits, t.labels.filter("toxic = 1"), "doc_id", "doc_id", "bad")
    parts = {
        "quality_bonus": F.when(F.col("good"), 0.05).otherwise(0.0),
        "risk_penalty": F.when(F.col("bad"), -0.2).otherwise(0.0),
        "channel_bonus": F.when(F.col("channel") == "cosine", 0.04).otherwise(0.08),
    }
    return R.rerank(hits, parts, 10).select("query_id", "doc_id", "score", *parts, "final")
