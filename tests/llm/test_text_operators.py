"""Near copies, repeated passages and benchmark passages against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidelog.llm import debruijn, fmindex, jaccard
from tidelog.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus(seed=5, n=60):
    """Near copies, exact copies, shared passages, and the odd rows: (doc_id, text, sequence_id)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage, line = [word() for _ in range(90)], [word() for _ in range(14)]
    base = [word() for _ in range(120)]
    rows = []
    for i in range(n):
        kind = i % 6
        w = [word() for _ in range(rng.randint(30, 200))]
        if kind == 0:
            w = base.copy()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
        elif kind == 1:
            w[10:10] = passage[rng.randint(0, 20) : rng.randint(60, 90)]
        elif kind == 2:
            w = line * rng.randint(1, 6) + w[:10]
        elif kind == 3:
            w = passage[:70] + w[:40] + passage[:70]
        text = "".join(x + rng.choice([" ", " ", "\n", ", ", "  ", " ", "! "]) for x in w)
        rows.append((i, text.upper() if i % 11 == 0 else text, "s"))
    rows += [(100, rows[1][1], "s"), (101, rows[1][1], "s"), (102, None, "s"), (103, "", None), (104, " \n\t", "s"), (105, "one two", "s"), (106, "One TWO ", "s"), (107, "a b c d e", "s")]
    rows += [(1, rows[1][1], "again"), (None, rows[3][1], "n")]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id bigint, text string, sequence_id string"


def shingles(text):
    w = SPACED.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    label = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = label[i], label[j]
                label = [y if v == x else v for v in label]
    least = {}
    for (doc, _), v in zip(sets, label):
        if doc is not None:
            least[v] = min(least.get(v, doc), doc)
    return sorted((doc if doc is not None else -1, len(s), least.get(v, -1)) for (doc, s), v in zip(sets, label))


@pytest.mark.parametrize("seed, few, cell", [(5, 64, 1024), (6, 1, 4)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, few, cell):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "CELL", cell)
    rows = corpus(seed)
    found = jaccard.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in found)
    assert got == brute_groups(rows)


def test_one_of_each_group(spark):
    rows = corpus()
    kept = jaccard.one_of_each_group(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "sequence_id"]
    want = {d for d, _, c in brute_groups(rows) if d == c}
    assert {-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()} == want
    assert kept.filter("doc_id = 1").count() == 1


def test_groups_of_nothing(spark):
    assert jaccard.groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = jaccard.groups(spark.createDataFrame([(3, None, ""), (4, "", "")], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == [(3, 0, 3), (4, 0, 4)]


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = base.copy()
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w), ""))
    found = jaccard.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component_id"] for r in found} == {0}


@pytest.mark.parametrize("few", [2, 64])
def test_near_misses_and_links_of_one_family(spark, monkeypatch, few):
    """Copies of one text with ever more words changed: some link, many just miss."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "CELL", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        w = base.copy()
        for at in rng.sample(range(100), rng.randint(1, 6)):
            w[at] = f"x{i}-{at}"
        rows.append((i, " ".join(w[: rng.randint(90, 100)]), ""))
    found = jaccard.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found)
    assert got == brute_groups(rows) and 3 < len({c for _, _, c in got}) < 100


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(99, i) for i in range(50, 60)] + [(7, 7)]
    nodes = spark.createDataFrame([(i,) for i in [*range(5, 61), 99]], "node bigint")
    got = {r["node"]: r["component"] for r in components(nodes, spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 10 for i in range(10, 41)) and all(got[i] == 50 for i in [*range(50, 60), 99])
    assert got[7] == 7 and got[45] == 45 and len(got) == 57


def brute_removed(rows, window=50):
    docs = [(float("inf") if r[0] is None else r[0], SPACED.findall(r[1] or "")) for r in rows]
    least = {}
    for doc, w in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < doc:
                gone[k : k + window] = [True] * window
        out.append((doc, w, gone))
    return out


@pytest.mark.parametrize("seed", [5, 8])
def test_repeated_passages_equal_brute_force(spark, seed):
    rows = corpus(seed)
    found = debruijn.removal_digests(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((float("inf") if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found)
    want = [(d, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g) if not y).encode()).hexdigest()) for d, w, g in brute_removed(rows)]
    assert got == sorted(want) and sum(w[2] for w in want) > 300


def test_repeats_are_cut_from_texts(spark):
    rows = corpus()
    out = debruijn.remove_repeats(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "sequence_id"] and out.count() == len(rows)
    words = sorted((SPACED.findall(r["text"] or "") for r in out.collect()))
    assert words == sorted([x for x, y in zip(w, g) if not y] for _, w, g in brute_removed(rows))
    assert debruijn.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cut_text_keeps_what_stands_between():
    assert debruijn.cut_text("a  b\nc é d ", [{"start": 1, "end": 3}]) == "a  é d "
    assert debruijn.cut_text("a b", [{"start": 0, "end": 2}]) == "" and debruijn.cut_text(None, []) is None


ITEMS = "item_id bigint, text string"


def items_of(rows):
    whole = [ALNUM.findall(r[1]) for r in rows if r[1] and len(ALNUM.findall(r[1])) > 30]
    return [
        (1, " ".join(whole[0][3:25])), (2, "-".join(whole[1][0:10]).upper()), (3, " ".join(whole[2][5:9])), (4, None), (5, " ;; "), (1, " ".join(whole[3][0:12])),
        (6, "nowhere to be found in any text at all, really"), (None, " ".join(whole[4][2:14])), (7, " ".join(whole[5][-10:])),
    ]


def brute_hits(rows, items, window=10):
    windows = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(FOLD))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for r in rows:
        w = ALNUM.findall((r[1] or "").translate(FOLD))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [True] * n
                    found |= x
        out.append((r[0] if r[0] is not None else -1, w, hit, sorted(str(i) for i in found if i is not None)))
    return out


@pytest.mark.parametrize("block", [500_000, 20])
def test_benchmark_passages_equal_brute_force(spark, block):
    rows = corpus()
    items = items_of(rows)
    found = fmindex.find_phrases(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS), block_words=block)
    got = found.select("doc_id", "n_words", "item_ids", *fmindex.hit_counts(found)).collect()
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got)
    want = [(d, len(w), sum(h), i, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), any(h)) for d, w, h, i in brute_hits(rows, items)]
    assert have == sorted(want) and sum(w[2] for w in want) > 50


@pytest.mark.parametrize("block, sent", [(500_000, 500_000), (400, 9)])
def test_items_that_repeat_a_text_and_long_items(spark, monkeypatch, block, sent):
    """One text under many ids, an item longer than a block, equal texts in other cases, null and repeated ids: in blocks as whole."""
    monkeypatch.setattr(fmindex, "SENT_IDS", sent)
    monkeypatch.setattr(fmindex, "PASSES", 3)
    rows = [(r[0], " ".join(r[1].split()[:400]), *r[2:]) if r[1] else r for r in corpus()]
    whole = [ALNUM.findall(r[1]) for r in rows if r[1] and len(ALNUM.findall(r[1])) > 30]
    long = ([w for x in whole for w in x] * 3)[:1500]
    items = [(100 + i, " ".join(whole[0][2:20])) for i in range(40)] + [(1, " - ".join(long)), (2, " ".join(long[:400]).upper()), (None, " ".join(whole[0][2:20])), (3, " ".join(whole[1][:21])), (3, " ".join(whole[2][:10])), (4, "")]
    found = fmindex.find_phrases(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS), block_words=block)
    got = found.select("doc_id", "n_words", "item_ids", *fmindex.hit_counts(found)).collect()
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got)
    assert have == sorted((d, len(w), sum(h), i) for d, w, h, i in brute_hits(rows, items))


def test_blocks_of_phrases_are_bounded(spark):
    """A text repeated by every item and an item of many words: no block holds much more than asked for."""
    items = [(i, "one text that all the items have in common here") for i in range(3000)] + [(9000, " ".join(f"w{i}" for i in range(20_000)))]
    pieces = fmindex._pieces(spark.createDataFrame(items, ITEMS), 10, 1000).collect()
    assert max(r["n"] for r in pieces) == 125 and sum(r["n"] for r in pieces) < 23_000
    assert sum(len(r["ids"]) for r in pieces if 9000 not in map(int, r["ids"])) == 3000


def test_benchmark_passages_are_cut(spark):
    rows = corpus()
    items = items_of(rows)
    out = fmindex.remove_phrases(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS))
    assert out.columns == ["doc_id", "text", "sequence_id"]
    words = sorted(ALNUM.findall((r["text"] or "").translate(FOLD)) for r in out.collect())
    assert words == sorted([x for x, y in zip(w, h) if not y] for _, w, h, _ in brute_hits(rows, items))


def test_no_documents_or_items(spark):
    docs, items = spark.createDataFrame(corpus(n=12), SCHEMA), spark.createDataFrame([], ITEMS)
    assert fmindex.find_phrases(docs, items).filter("size(spans) > 0").count() == 0
    assert fmindex.find_phrases(docs.limit(0), spark.createDataFrame(items_of(corpus()), ITEMS)).count() == 0
    with pytest.raises(ValueError):
        fmindex.find_phrases(docs.withColumnRenamed("sequence_id", "spans"), items)


@pytest.mark.parametrize("seed", range(5))
def test_index_finds_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    symbols = np.concatenate([[0], rng.integers(0, 4 if seed % 2 else 9, 400)])
    symbols = symbols[(symbols != 0) | np.concatenate([[True], symbols[:-1] != 0])]
    index = fmindex.FMIndex(symbols, 9)
    text = symbols.tolist()
    order = fmindex.suffix_array(symbols, text.count(0))
    tags, n = [], 0
    for s in text:  # separators differ, the earlier is the smaller
        tags.append((0, n) if s == 0 else (1, s))
        n += s == 0
    assert order.tolist() == sorted(range(len(text)), key=lambda i: tags[i:])
    for size in (1, 2, 3, 5):
        phrases = np.array([text[k : k + size] for k in range(0, len(text) - size, 3) if 0 not in text[k : k + size]] + [[9] * size])
        if len(phrases) < 2:
            continue
        low, high = index.search(phrases)
        for p, a, b in zip(phrases.tolist(), low, high):
            want = [k for k in range(len(text) - size + 1) if text[k : k + size] == p]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want
