"""What the stages keep: mixed languages and tables without labels."""

from pyspark.sql import functions as F

from driftline.llm import language, stages


def test_mixed_languages_stay_and_texts_without_letters_go(spark, documents):
    parts = [r.text for r in documents.where("length(text) > 600").groupBy("lang").agg(
        F.min("text").alias("text")).where("lang is not null").orderBy("lang").collect()]
    assert len(parts) == 4
    mixed = " ".join(t[:600] for t in parts)
    more = spark.createDataFrame([(10**6, mixed), (10**6 + 1, "12 34 !"), (10**6 + 2, None)],
                                 "doc_id long, text string")
    docs = documents.unionByName(more, allowMissingColumns=True)
    score = language.predict(more, language.fit(docs)).where(f"doc_id = {10**6}").first()["score"]
    assert score < 0.4
    kept = {r.doc_id for r in stages.language_id(spark, docs, "").select("doc_id").collect()}
    assert 10**6 in kept and not kept & {10**6 + 1, 10**6 + 2}


def test_all_documents_stay_without_labels(spark, documents):
    docs = documents.withColumn("lang", F.lit(None).cast("string"))
    assert stages.language_id(spark, docs, "").count() == documents.count()
