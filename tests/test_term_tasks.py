"""The tasks that sum terms grow in number with the text, whatever the session's number of shuffle partitions is."""

from pyspark.sql import functions as F

from tidelog.operators import terms as T


def test_terms_are_summed_in_as_many_tasks_as_the_text_asks_for(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("every one "), F.repeat(F.concat(F.lit("word"), F.col("id") % 20, F.lit(" ")), 30)).alias("text"))
    monkeypatch.setattr(T, "TASK_BYTES", 1_000)
    wanted = T.tasks(docs)
    assert wanted > 10 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = T.fit_vocabulary(docs, keep=False)
    assert found.rdd.getNumPartitions() == wanted
    moved = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "SinglePartition" not in line]
    assert all(f", {wanted})" in line for line in moved) and len(moved) == 4  # the executed and the initial plan of two shuffles


def test_the_sums_are_those_of_the_counts(spark):
    texts = [(1, "a bb cc bb"), (2, "bb cc"), (3, None), (4, ""), (5, "bb bb bb"), (None, "cc dd"), (2, "bb cc")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    plain = T.vocabulary_of(T.doc_terms(docs), 7, min_df=1)
    assert sorted(T.fit_vocabulary(docs, min_df=1, keep=False).collect()) == sorted(plain.collect())
    assert T.fit_vocabulary(docs, keep=False).schema == plain.schema
