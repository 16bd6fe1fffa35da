"""Samples that models are fitted on stay within their bounds, however often an id or a row repeats."""

from pyspark.sql import functions as F

from lodestone.llm import langid, toxicity


def learnable(spark, rule, n):
    """The first `n` ids that may be learnt from."""
    return [r[0] for r in spark.range(200).withColumnRenamed("id", "doc_id").filter(~rule()).limit(n).collect()]


def test_language_samples_of_a_repeated_id(spark, monkeypatch):
    a, b, c = learnable(spark, langid.held_out, 3)
    same = spark.range(20_000).select(F.lit(a).alias("doc_id"), F.lit("the same words").alias("text"), F.lit("en").alias("lang"))
    other = spark.range(20_000).select(F.lit(b).alias("doc_id"), F.concat(F.lit("die Worte "), "id").alias("text"), F.lit("de").alias("lang"))
    docs = same.unionByName(other).unionByName(spark.createDataFrame([(c, "un seul texte", "fr"), (c, None, "fr"), (None, "rien", "es")], "doc_id long, text string, lang string"))
    seen = {}
    monkeypatch.setattr(langid, "dictionaries", lambda excerpts, size: seen.update(excerpts) or {})
    langid.learn(docs, texts_per_language=50)
    assert {k: len(v) for k, v in seen.items()} == {"en": 1, "de": len(seen["de"]), "fr": 1} and 20 < len(seen["de"]) <= 50


def test_toxicity_sample_of_a_repeated_id_and_of_long_texts(spark):
    bad, good = learnable(spark, toxicity.held_out, 2)
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), (F.col("id") * 7 + i * i) % 100)))
    docs = spark.range(10_000).select(F.lit(bad).alias("doc_id"), F.concat(words, F.lit(" zzzidiotzzz")).alias("text"))
    docs = docs.unionByName(spark.range(10_000).select(F.lit(good).alias("doc_id"), words.alias("text"))).unionByName(docs.limit(1).select("doc_id", F.repeat("text", 5000).alias("text")))
    labels = spark.createDataFrame([(bad, 1), (good, 0)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, max_texts=60, max_bytes=200_000)
    assert model.landmarks and model.cut in toxicity.CUTS
    asked = spark.createDataFrame([(1, "w1 w2 w3 zzzidiotzzz w5"), (2, "w1 w2 w3 w4 w5")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert found[1] > found[2]
