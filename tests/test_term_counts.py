"""Terms are counted within the row of their document; weights come from the same pass as document frequencies."""

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import functions as F

from tidelog.operators import complement_bayes as CB
from tidelog.operators import terms

ROWS = [(1, "a bb cc bb cc"), (2, "Bb cc, dd"), (2, "dd cc"), (3, None), (4, ""), (None, "cc dd"), (5, "x y"), (6, "dd dd dd dd")]


def counted(rows):
    want = Counter()
    for key, text in rows:
        words = [w for w in re.findall(r"\w{2,}", (text or "").lower())]
        want.update((key, t) for t in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])
    return want


def test_terms_of_repeated_empty_and_null_documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id int, text string").repartition(3)
    for partitions in (None, 2):
        got = {(r["doc_id"], r["term"]): r["tf"] for r in terms.doc_terms(docs, partitions).collect()}
        assert got == counted(ROWS)


def test_no_task_holds_a_table_of_the_terms_of_its_documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id int, text string")
    plan = terms.doc_terms(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys=\[doc_id#\d+, term", plan)


def test_tasks_grow_with_the_text(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.createDataFrame(ROWS, "doc_id int, text string")
    assert terms.tasks(docs) == terms.tasks(docs.limit(0)) == least
    long = spark.range(9).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), terms.TASK_BYTES // 5).alias("text"))
    assert terms.tasks(long) == max(least, 9)


def test_weights_need_no_vocabulary_table(spark):
    """Weights equal those under a fitted vocabulary; counts are sent to their terms once and back once."""
    docs = spark.createDataFrame([r for r in ROWS if r[0] != 2], "doc_id int, text string")
    vocabulary = terms.fit_vocabulary(docs)
    for sublinear in (False, True):
        want = {(r["doc_id"], r["term"]): r["w"] for r in terms.tfidf(docs, vocabulary, sublinear).collect()}
        made = terms.own_tfidf(docs, sublinear)
        got = {(r["doc_id"], r["term"]): r["w"] for r in made.collect()}
        assert want and got.keys() == want.keys() and all(abs(got[k] - w) < 1e-12 for k, w in want.items())
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and len(re.findall(r"RepartitionByExpression \[term", plan)) == 1


def test_bayes_scores_without_a_table_of_weighted_terms(spark):
    """Model and scores equal those of ``fit``; terms are sent by term once; one document has two labels, some have none."""
    texts = ["bb cc bb cc dd", "cc dd ee", None, "", "ee ff ee", "dd ff gg", "gg bb unknown", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    labels = spark.createDataFrame([(0, "p"), (1, "q"), (2, "q"), (4, "p"), (5, "q"), (5, "p")], "doc_id int, label string")
    train = docs.join(labels, "doc_id", "left_semi")
    vocabulary = terms.fit_vocabulary(train)
    fitted = CB.fit(terms.tfidf(train, vocabulary), labels, vocabulary, ["p", "q"])
    want = {r["term"]: r["scores"] for r in fitted.collect()}
    got = {r["term"]: r["scores"] for r in CB.own_model(docs, labels, ["p", "q"]).collect()}
    assert want and got.keys() == want.keys() and all(abs(a - b) < 1e-12 for t in want for a, b in zip(got[t], want[t]))
    want = {r["doc_id"]: r["scores"] for r in CB.decision_scores(terms.tfidf(docs, vocabulary), fitted, 2).collect()}
    made = CB.own_scores(docs, labels, ["p", "q"]).collect()
    assert {r["doc_id"] for r in made} == want.keys() and all(abs(a - b) < 1e-12 for r in made for a, b in zip(r["scores"], want[r["doc_id"]]))
    placed = CB.own_terms(docs, labels, ["p", "q"])
    placed.collect()
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join .*term", plan)
