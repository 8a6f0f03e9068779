"""Texts built to collide under polynomial hashes, columns named like those inside, groups of near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import debruijn, fmindex, jaccard, words
from tidelog.llm.tokens import Encoder, tokenizer_path


def mirrored(letters, doublings=11):
    """Two words of 2**doublings letters with one hash under any polynomial modulo 2**64: a Thue-Morse word and its mirror."""
    a, b = letters
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_mix_up_differ():
    for doublings in (8, 10, 11, 12):
        for letters in ("ab", "AB", ("é", "è")):
            x, y = mirrored(letters, doublings)
            for lower in (False, True):
                found = words.cut([f"{x} {y} {x}"], lower=lower).hashes
                assert found[0] == found[2] != found[1]
    upper, low = "AB" * 200, "ab" * 200
    assert words.cut([upper], lower=True).hashes[0] == words.cut([low]).hashes[0] != words.cut([upper]).hashes[0]


def test_tokens_of_pieces_that_polynomials_mix_up():
    from tokenizers import Tokenizer

    texts = [t for letters in ("ab", "xy", "  \n"[::2], "12") for d in (6, 10, 11) for t in mirrored(letters, d)]
    fresh = Tokenizer.from_file(tokenizer_path())
    assert [x.tolist() for x in Encoder(tokenizer_path()).encode_batch(texts)] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture
def pair():
    x, y = mirrored("ab")
    tail = " ".join(f"w{i}" for i in range(60))
    return f"{x} {tail}", f"{y} {tail}"


def test_operators_tell_them_apart(spark, pair):
    x, y = (p.split(" ")[0] for p in pair)
    docs = spark.createDataFrame([(1, f"{x} one two three four"), (2, f"{y} one two three four")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.groups(docs).collect()} == {1: 1, 2: 2}
    items = spark.createDataFrame([("i", f"{x} one two")], "item_id string, text string")
    found = fmindex.find_phrases(docs, items)
    hit = {r["doc_id"]: r["n_hit"] for r in found.select("doc_id", *fmindex.hit_counts(found)).collect()}
    assert hit == {1: 3, 2: 0}
    long = spark.createDataFrame([(1, " ".join([x] * 50)), (2, " ".join([y] * 50)), (3, " ".join([x] * 50))], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_removed"] for r in debruijn.removal_digests(long).collect()} == {1: 0, 2: 0, 3: 50}


INSIDE = ["_id", "_hash", "_hash_of", "_row", "_doc", "_text", "row", "spans", "edge", "text_hash", "component_id", "cls", "n"]


def test_columns_named_like_those_inside_keep_their_values(spark):
    rng = random.Random(1)
    body = " ".join(rng.choice("abcdefgh") * 3 + str(i) for i in range(80))
    rows = [(1, body, *["v"] * len(INSIDE)), (2, body, *["u"] * len(INSIDE)), (3, "other words", *["t"] * len(INSIDE))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in INSIDE)).select("text", *INSIDE, "doc_id")
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns and {(r["doc_id"], *(r[c] for c in INSIDE)) for r in kept.collect()} == {(1, *rows[0][2:]), (3, *rows[2][2:])}
    cut = debruijn.remove_repeats(docs)
    assert cut.columns == docs.columns
    got = {r["doc_id"]: r for r in cut.collect()}
    assert got[2]["text"] == "" and got[1]["text"] == body and all(got[d][c] == v for d, v in ((1, "v"), (2, "u"), (3, "t")) for c in INSIDE)


def test_comparisons_inside_a_group_of_near_copies_are_linear(spark, monkeypatch):
    """400 near copies of one text, three words changed in each: many pairs miss the threshold by a little."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    texts = []
    for i in range(400):
        t = list(base)
        for k in rng.sample(range(200), 3):
            t[k] = f"x{i}_{k}"
        texts.append(" ".join(t))
    compared, plain = [], jaccard._linked

    def counting(pairs, nodes, percent):
        compared.append(pairs.count())
        return plain(pairs, nodes, percent)

    monkeypatch.setattr(jaccard, "_linked", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.groups(docs, rounds=4).collect()}
    sets = [frozenset(zip(*(t.split(" ")[k:] for k in range(5)))) for t in texts]
    label = list(range(400))
    for i in range(400):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                x, y = max(label[i], label[j]), min(label[i], label[j])
                label = [y if v == x else v for v in label]
    assert [got[i] for i in range(400)] == label
    assert sum(compared) < 400 * 14


def test_search_first_compares_the_best_estimates():
    from tidelog.llm import onebit

    values = np.array([3.0, -np.inf, 5.0, 4.0])
    assert sorted(onebit._top(values, 2).tolist()) == [2, 3] and sorted(onebit._top(values, 9).tolist()) == [0, 2, 3]
    assert onebit._kth(values, 2) == 4.0 and onebit._kth(values, 5) == -np.inf


def test_cutting_stays_in_arrow(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    items = spark.createDataFrame([("i", "a")], "item_id string, text string")
    for out in (debruijn.remove_repeats(docs), fmindex.remove_phrases(docs, items)):
        assert "BatchEvalPython" not in out._jdf.queryExecution().toString() and out.select(F.col("text")).count() == 1
