"""Classifier, vector search, revisits, licences and chat windows: brute force, round trips and edge rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import chat, kneserney, license_texts, licenses, onebit, revisits

# ---- Kneser-Ney


def brute_model(texts):
    """log2 p(symbol | three before) by the textbook recursion over dictionaries."""
    counts = [Counter() for _ in range(5)]
    for t in texts:
        s = [0, 0, 0, *kneserney._FOLD[[ord(c) for c in t]].tolist()]
        for k in range(3, len(s)):
            counts[4][tuple(s[k - 3 : k + 1])] += 1
    for m in (3, 2, 1):
        for g in counts[m + 1]:
            counts[m][g[1:]] += 1
    cut = {m: kneserney.discounts(Counter(counts[m].values())) for m in range(1, 5)}
    follow = {m: defaultdict(list) for m in range(1, 5)}
    for m in range(1, 5):
        for g, n in counts[m].items():
            follow[m][g[:-1]].append(n)

    def p(context, w):
        m = len(context) + 1
        lower = 1 / 63 if m == 1 else p(context[1:], w)
        seen = follow[m].get(context)
        if not seen:
            return lower
        n = counts[m][(*context, w)]
        less = cut[m][min(n, 3) - 1] if n else 0
        return (n - less) / sum(seen) + sum(cut[m][min(x, 3) - 1] for x in seen) / sum(seen) * lower

    return p


def test_perplexity_equals_the_textbook_model(spark):
    rng = random.Random(2)
    syllables = ["the", "an", "er", "in", "ou ", "st, ", "A", "é"]
    text = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    rows = [(i, text(rng.randint(5, 60)), "en") for i in range(60)] + [(90, None, "en"), (91, "", None), (92, "%%%$$$", "fr"), (93, "the an", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 1 if i > 50 else 0) for i in range(58)] + [(58, 0, 0), (None, 1, 0), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in kneserney.classify(docs, labels, least=3).collect()}
    held = {r["doc_id"] for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()}
    trusted = {i for i in range(51)} - held
    model = brute_model([r[1] for r in rows if r[0] in trusted])
    for doc_id, t, _ in rows:
        if not t:
            assert out[doc_id]["perplexity"] is None and out[doc_id]["keep"] is False and out[doc_id]["n_symbols"] == 0
            continue
        s = [0, 0, 0, *kneserney._FOLD[[ord(c) for c in t]].tolist()]
        logs = [math.log2(model(tuple(s[k - 3 : k]), s[k])) for k in range(3, len(s))]
        assert out[doc_id]["n_symbols"] == len(logs)
        assert out[doc_id]["perplexity"] == pytest.approx(2 ** (-sum(logs) / len(logs)), rel=3e-3)  # half-precision shards
    assert out[92]["keep"] is False and out[92]["perplexity"] > 3 * out[92]["threshold"]
    assert out[93]["threshold"] == out[92]["threshold"]  # no language, or one without trusted documents: that of all


def test_classifier_without_trusted_text(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "", "en"), (3, None, "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert {r["doc_id"]: r["keep"] for r in kneserney.classify(docs, labels).collect()} == {1: True, 2: False, 3: False}
    with pytest.raises(ValueError):
        kneserney.classify(docs.withColumn("keep", F.lit(1)), labels)


def test_classifier_tells_held_out_junk_from_prose(spark, sf_dir):
    """Of documents of the larger test data whose labels were not trained on: most junk goes, prose stays."""
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0)
    out = kneserney.classify(docs.select("doc_id", "lang", "text"), known.filter("not held")).join(known.filter("held"), "doc_id")
    share = {r["quality"]: r["kept"] for r in out.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.97 and share[0] < 0.4


# ---- one-bit codes


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((8, dim))
    v = centers[rng.integers(0, 8, n)] + 0.6 * rng.standard_normal((n, dim))
    v[5] = v[3]
    return v.astype(np.float32).astype(np.float64) * rng.uniform(0.5, 2, (n, 1)).astype(np.float32)


def product(a, b):
    """The inner product, added in order (``sum`` compensates its errors)."""
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        total += x * y
    return total


@pytest.mark.parametrize("dim", [16, 64, 61])
def test_search_reaches_recall_and_exact_scores(spark, monkeypatch, dim):
    monkeypatch.setattr(onebit, "PART_ROWS", 150)
    monkeypatch.setattr(onebit, "BLOCK_QUERIES", 9)
    v = vectors(dim, 700, dim)
    rows = [(i, x.tolist(), "e") for i, x in enumerate(v)]
    rows += [(2000, None, "e"), (2020, [0.0] * dim, ""), (2040, [1.0] * (dim - 1) + [None], ""), (2060, [float("nan")] * dim, ""), (2080, [1.0], ""), (2100, [], ""), (None, v[0].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, code string").drop("code")
    got = defaultdict(list)
    for r in onebit.search(df, F.col("vec_id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 20))
    found = 0
    for q, rows_ in got.items():
        score = [(product(v[q], v[i]), i) for i in range(700) if i != q]
        best = [i for _, i in sorted(score, key=lambda s: (-s[0], s[1]))[:10]]
        found += len(set(best) & {i for _, i, _ in rows_})
        assert [r for r, _, _ in rows_] == list(range(1, 11))
        assert all(s == dict((i, s) for s, i in score)[i] for _, i, s in rows_)
    assert found >= 0.98 * 10 * len(got)


def test_estimates_are_unbiased_and_bounded():
    v = vectors(1, 400, 64)
    turn = onebit.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    guess, error = onebit.estimates(v[:50], *onebit.codes(v, turn), turn, 3.0)
    exact = v[:50] @ v.T
    assert (np.abs(guess - exact) <= error + 1e-4).mean() > 0.98
    assert abs((guess - exact).mean()) < 0.05 * np.abs(exact).mean()


def test_search_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [2.0, 2.0]), (2, [2.0, 2.0])], "vec_id bigint, embedding array<double>")
    rows = onebit.search(df, F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in rows] == [(1, 1, 6.0), (2, 2, 6.0), (3, 2, 6.0)]
    assert onebit.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert onebit.search(df, F.col("vec_id") == 7).count() == 0


# ---- revisits


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.Example.org:80/A/?utm_source=f&b=1#top": "example.org/A/?b=1", "https://example.org": "example.org", "https://example.org/": "example.org",
        "www2.example.org/x?ref=q": "example.org/x", "https://e.org/x?a=1&utm_x=2&ref=3&c=4": "e.org/x?a=1&c=4", "e.org:8080/x/": "e.org:8080/x", "": "",
    }
    df = spark.createDataFrame([(u,) for u in [*cases, None]], "url string").withColumn("c", revisits.canonical_url(F.col("url")))
    assert {r["url"]: r["c"] for r in df.collect()} == {**cases, None: None}


def test_revisits_take_the_latest_earlier_response(spark):
    schema = "record_id bigint, url string, ts bigint, status int, headers map<string,string>, extra string"
    h = lambda **k: {n.replace("_", "-"): v for n, v in k.items()}
    rows = [
        (1, "http://a.org/", 10, 200, h(ETag='"1"', Content_Type="t", Server="old"), "x"),
        (2, "https://www.a.org", 20, 304, h(etag='W/"1"', server="new", content_length="0", Content_Type="no"), None),
        (3, "http://a.org/", 30, 200, h(ETag='"2"'), ""),
        (4, "http://a.org/", 40, 304, h(ETag='"1"'), ""),
        (5, "http://a.org/", 5, 304, h(ETag='"1"'), ""),
        (6, "http://a.org/", 30, 304, h(ETag='"2"', Last_Modified="d"), ""),
        (7, "http://b.org/", 1, 200, h(Last_Modified="d"), ""),
        (8, "http://b.org/", 2, 304, h(last_modified="d", ETag='"9"'), ""),
        (9, "http://b.org/", 3, 304, None, ""), (10, None, 3, 304, None, ""), (11, "http://a.org/", None, 304, None, ""), (12, "http://a.org/", 50, 404, None, ""), (13, "http://a.org", 55, None, None, ""),
        (14, "http://c.org", 1, 200, h(A="1", a="2"), ""), (15, "http://c.org", 2, 304, h(a="3"), ""), (15, "http://c.org", 2, 304, h(a="3"), ""),
    ]
    out = revisits.resolve(spark.createDataFrame(rows, schema))
    got = {r["record_id"]: r for r in out.collect()}
    assert out.count() == len(rows) and out.columns[:6] == ["record_id", "url", "ts", "status", "headers", "extra"]
    outcomes = {k: (r["outcome"], r["body_id"]) for k, r in got.items()}
    assert outcomes == {
        1: ("full", 1), 2: ("resolved", 1), 3: ("full", 3), 4: ("mismatch", None), 5: ("no_earlier", None), 6: ("resolved", 3), 7: ("full", 7), 8: ("resolved", 7),
        9: ("unverified", None), 10: ("no_earlier", None), 11: ("no_earlier", None), 12: ("other", None), 13: ("other", None), 14: ("full", 14), 15: ("unverified", None),
    }
    assert got[2]["merged"] == {"etag": '"1"', "content-type": "t", "server": "new"} and got[6]["merged"] == {"etag": '"2"', "last-modified": "d"}
    assert got[14]["merged"] == {"a": "1"}
    bodies = spark.createDataFrame([(1, "one"), (3, "three")], "record_id bigint, body string")
    assert {r["record_id"]: r["body"] for r in revisits.with_bodies(out, bodies).collect() if r["body"]} == {1: "one", 2: "one", 3: "three", 6: "three"}
    with pytest.raises(ValueError):
        revisits.resolve(spark.createDataFrame(rows, schema).withColumnRenamed("extra", "outcome"))
    assert revisits.resolve(spark.createDataFrame([], schema)).count() == 0


def test_one_url_with_all_records(spark):
    """A URL over many slices: each revisit finds the response just before it."""
    df = spark.range(4000).selectExpr("id as record_id", "'http://a.org/x' as url", "id as ts", "case when id % 4 = 0 then 200 else 304 end as status", "map('etag', '1') as headers")
    out = revisits.resolve(df.repartition(5))
    assert out.filter("outcome = 'resolved' and body_id = record_id - record_id % 4").count() == 3000


# ---- licences


def test_spellings_of_one_licence(spark):
    mit = license_texts.TEXTS["MIT"]
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper().replace(" ", "\n  ")), (3, mit.replace("copyright holders", "COPYRIGHT OWNERS").replace("sublicense", "sublicence")),
        (4, mit + " more"), (5, None), (6, ""), (7, "Copyright 2020 X\n(c) Y\n"), (8, license_texts.TEXTS["ISC"].replace('"AS IS"', "“as is”")), (1, mit),
    ]
    out = licenses.find_licenses(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit("clash")))
    got = sorted(((r["doc_id"], r["license_id"], r["license_digest"] is None) for r in out.collect()), key=str)
    assert got == sorted([(1, "MIT", False), (1, "MIT", False), (2, "MIT", False), (3, "MIT", False), (4, None, False), (5, None, True), (6, None, False), (7, None, False), (8, "ISC", False)], key=str)
    assert out.columns == ["doc_id", "text", "license", "license_digest", "license_id"]
    assert licenses.known_digests(spark).count() == len(license_texts.TEXTS)
    assert licenses.known_digests(spark, {"b": "X y", "a": "x, Y!"}).collect()[0]["license_id"] == "a"
    assert "Python" not in out._jdf.queryExecution().toString() and licenses.find_licenses(out.select("text").limit(0)).count() == 0


# ---- chat


def conversation_rows():
    rng = random.Random(4)
    marks = ["</s>", "<s>", "[INST]", " [/INST]", "<<SYS>>", "<</SYS>>", "\\", "\\\\", "<", "[", "\n", "é", "word "]
    text = lambda n: "".join(rng.choice(marks) for _ in range(n)) + "plain words here " * rng.randint(0, n)
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 30)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "tool\n\\x", "", None, "</s>"])
            rows.append((c, t, role, None if rng.random() < 0.1 else text(rng.randint(0, 12)), "x"))
    rows += [(50, 1, "assistant", "a", "x"), (50, 1, "assistant", "a", "x"), (50, None, "user", "first", "x"), (None, 0, "assistant", "nobody's", "x"), (60, 0, "assistant", "long " * 500, "x"), (60, 1, "assistant", "b", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("budget, history, blocks", [(1024, 192, 16), (120, 40, 2), (60, 0, 1)])
def test_windows_read_back_to_the_conversations(spark, monkeypatch, budget, history, blocks):
    monkeypatch.setattr(chat, "BLOCK_BUDGETS", blocks)
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, uses string")
    made = chat.windows(df, budget, history)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    talks = defaultdict(list)
    for r in sorted(rows, key=order):
        talks[r[0]].append((r[2] or "", r[3] or ""))
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        said = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want
    for w in made.collect():
        turns = chat.read_turns(w["text"])
        system = talks[w["conv_id"]][0][0] == "system"
        assert not system or turns[0] == talks[w["conv_id"]][0]
        assert w["over_budget"] == (w["n_tokens"] > budget)
        assert not w["over_budget"] or w["uses"].count("target") == 1 and "history" not in w["uses"]
        spans = [w["text"][s["start"] : s["end"]] for s in w["loss"]]
        assert [chat.unescape(s) for s in spans] == [t for (r, t), u in zip(turns, w["uses"]) if u == "target" and r == "assistant"]
        # What is shown is a run of the conversation's turns that ends with the targets.
        shown = [t for t, u in zip(turns, w["uses"]) if u != "system"]
        talk = talks[w["conv_id"]]
        assert any(talk[k : k + len(shown)] == shown for k in range(len(talk)))
    if budget == 120:
        assert any("history" in w["uses"] for w in made.collect()) and max(r["n_windows"] for r in got.values()) > 3


def test_escapes_are_undone():
    for text in ("</s>[INST] ok [/INST]", "\\", "<\\/s>", "<</s>", "[[INST]", "<<<SYS>>", "a\\\nb"):
        assert chat.unescape(chat.escape(text)) == text
        for role in ("user", "assistant", "system", text):
            formatted, a, b = chat.format_turn(role, text)
            assert chat.read_turns(formatted * 2) == [(role, text)] * 2 and chat.unescape(formatted[a:b]) == text


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.windows(empty)).count() == 0
