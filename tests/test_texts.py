"""HTML, chunks, links, retrieval, replies, model calls."""

import numpy as np
from pyspark.sql import functions as F

from tidelog.functions import replies
from tidelog.functions.html import page_links, page_text
from tidelog.operators import documents, inference, retrieval


def test_page_text_roots():
    assert page_text("<body>x<main>a<b>b</b> c</main></body>") == "a\nb\nc"
    assert page_text("<body><article>one</article><article>two</article></body>") == "one"
    assert page_text('<body>y<div class="big content">in <p>deep</div>out</body>') == "in\ndeep"
    assert page_text("<body>a<nav>n<div>m</div></nav><!-- c -->b<script>var t='</p>';</script></body>") == "a\nb"
    assert page_text("<p>no body</p>") == ""
    assert page_text("<body>a &amp; b<form><main>f</main></form></body>") == "a & b"
    assert page_text(None) == "" and page_text("") == ""
    assert page_text("<body><p>a<br>b<p>c</body>") == "a\nb\nc"


def test_page_links():
    html = '<a href="/x">1</a><a href="y.pdf">2</a><a href="http://other/z">3</a><a>4</a><a href="z#f">5</a><a href="/x">6</a>'
    assert page_links("http://h/d/p", html) == ["http://h/x", "http://h/d/z#f", "http://h/x"]


def test_reachable(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("a", "a")], "url string, link string")
    seeds = spark.createDataFrame([("a",)], "url string")
    got = {r["url"]: r["depth"] for r in documents.reachable(links, seeds).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_document_key(spark):
    urls = ["http://h", "http://h/", "https://h/a/b/", "http://h/x.html?q=1", "http://h/y#t"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(documents.document_key(F.col("u"))).collect()] == [
        "index.html", "index.html", "a/b.html", "x.html", "y.html",
    ]


def brute_chunks(text, size=400, overlap=80):
    out, start = [], 0
    while start < len(text):
        piece = text[start : start + size].strip()
        if len(piece) > 100:
            out.append(piece)
        start += size - overlap
    return out


def test_chunks_cover_whole_texts(spark):
    rng = np.random.default_rng(1)
    texts = ["", "short", "x" * 100, "x" * 101, "é😀\n" * 700]
    texts += ["".join(rng.choice(list("ab c\n\té"), n)) for n in (399, 400, 401, 720, 1999, 20000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = documents.chunk(df).orderBy("id", "chunk_id").collect()
    for i, text in enumerate(texts):
        assert [r["text"] for r in got if r["id"] == i] == brute_chunks(text), i
        assert [r["chunk_id"] for r in got if r["id"] == i] == list(range(len(brute_chunks(text))))


def test_top_passages_is_exact_in_blocks(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 8))
    vectors[7] = vectors[3]
    queries = rng.normal(size=(23, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "query_id long, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(queries) @ unit(vectors).T
    for block in (4096, 4):
        got = retrieval.top_passages(q, v, 3, block=block).orderBy("query_id", "rank").collect()
        for i in range(23):
            order = sorted(range(60), key=lambda j: (-scores[i, j], j))[:3]
            assert [r["id"] for r in got if r["query_id"] == i] == order
    assert retrieval.top_passages(q.filter("false"), v, 3).count() == 0


def test_embed_calls_in_batches(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id int, text string").coalesce(1)
    rows = documents.embed(df, lambda texts: [[len(texts), 1.0] for _ in texts], batch=4).orderBy("id").collect()
    assert [r["vector"][0] for r in rows] == [4.0] * 8 + [2.0] * 2


def test_replies(spark):
    raws = [
        '{"label": "error", "confidence": 0}', 'so {"label": "noise"} ok', '{"important": "x"}', "junk", "", None,
        '{"label": "warning"}', '{"label": "warning", "error": 1}', '{"label": "noise"} tail', "[1]",
    ]
    df = spark.createDataFrame([(r,) for r in raws], "raw string").withColumn("m", replies.reply_object(F.col("raw")))
    rows = df.select(replies.reply_label(F.col("m")), replies.reply_confidence(F.col("m"))).collect()
    assert [r[0] for r in rows] == [
        "error", "noise", "important", "unknown", "unknown", "unknown", "warning", "error", "noise", "unknown",
    ]
    assert all(r[1] == 0.5 for r in rows)


def test_failed_calls_keep_their_row(spark):
    def call(text):
        if text == "bad":
            raise RuntimeError("no model")
        return "noise"

    df = spark.createDataFrame([("good",), ("bad",)], "prompt string")
    rows = {r["prompt"]: r for r in inference.call_model(df, call).collect()}
    assert rows["good"]["raw"] == "noise" and rows["bad"]["raw"] is None and rows["bad"]["seconds"] >= 0
    assert inference.call_model(df, call, limit=1).count() == 1


def test_registered_vectors_have_the_default_size(spark, sf_dir):
    from tidelog.plans.catalog import QUERIES

    row = QUERIES["chunk_vectors"](spark, sf_dir).first()
    assert row["dim"] == 384 and len(row["vector"]) == 384 and abs(sum(x * x for x in row["vector"]) - 1) < 1e-4
    rows = QUERIES["explain_top_incidents"](spark, sf_dir).collect()
    assert rows and all(len(set(r["chunk_ids"])) == r["n_chunks"] > 0 for r in rows)
