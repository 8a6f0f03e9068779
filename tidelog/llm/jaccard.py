"""Links and groups of documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Exact, in four steps, none of which writes a row per pair of a group:

1. Documents with the same set are one class, found by a 128-bit digest of the set; classes, not copies, are compared.
2. A linked document has at most ``n // 4`` (at 0.75) n-grams that the other lacks, so a document with more n-grams that
   occur nowhere else has no link. Repeats are counted on half of all n-grams, chosen by hash (the bound holds for any
   part): a task takes the n-grams of a chunk of documents, sends each once to the bucket of its hash, and the bucket
   returns to the chunk how many of each document's n-grams other chunks have too. Few documents remain.
3. Multiple-global-order filter on those that remain: under each of several total orders of the n-grams (rarest first, ties
   and near ties ordered by different hashes) two linked documents share one of their first ``n // 4 + 1``.
   First every document is compared with one leader per order: the document that comes first under most of its prefix
   n-grams. That joins groups of near copies, whatever their size, with one comparison per member. Where n-grams of more than
   ``FEW`` documents still lie in several components, up to ``rounds`` rounds may go on with leaders of ``DRAWS`` random orders,
   one comparison per member and order, until one brings no link: members that miss one leader by a little meet another. They
   spare comparisons of pairs in very large groups and cost passes over all prefixes elsewhere, so none is made by default.
   In the same way, up to ``SIFTS`` passes over n-grams of many documents compare ``PICKS`` partners, drawn by hash, of each document
   among those of other components that may be similar enough, until a pass brings no link: a large group of near copies is joined
   by a number of comparisons in proportion to its members.
   Then all pairs of documents that are still in different components and share a prefix n-gram under every order are
   compared: the filters of the orders are intersected before the sets are read. N-grams of many documents go through
   cells of two blocks of them, which let only pairs out whose overlap can reach the threshold.
4. Components of the links found so far are those of all links, as pairs left out lie inside one component already. New links are
   taken between components, so that no step walks the links of earlier ones again.

N-gram hashes have 64 bits. The bucket's fingerprints are shorter: equal ones can only let a document through step 2.

Edge cases: null or empty text, or no words: no n-grams, no link, a component of its own; fewer words than ``k``: the whole
sequence is one n-gram; a null ``doc_id`` takes part and is never a component's name unless all its members are null; rows
that repeat a ``doc_id`` are linked each by its own text; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import words
from tidelog.llm.components import components
from tidelog.llm.memory import released
from tidelog.session import materialize

K, PERCENT = 5, 75
ORDERS = 3
# Leaders drawn anew in a round for n-grams of many documents; pairs that rounds leave are compared all the same.
DRAWS = 4
# Passes that compare drawn partners before all pairs, and partners drawn for a document in a pass.
SIFTS, PICKS = 4, 4
# Nodes of one n-gram up to which pairs are joined, and nodes in a block of a cell beyond.
FEW, CELL, SHARES = 64, 1024, 256
# Documents whose sets are held at once when only their digests are wanted.
CLASS_ROWS = 500
# Characters of a chunk of documents, and n-grams (of the half that is counted) that one bucket holds.
CHUNK_CHARS = 4_000_000
BUCKET_NGRAMS = 1_000_000
_NULL = -(1 << 63)


def sets(texts: list[str], k: int = K) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, in order."""
    out: list[np.ndarray] = []
    for a, b in words.chunks(texts):
        cut = words.cut(texts[a:b], lower=True)
        runs = words.runs(cut.hashes, k)
        for x, y in zip(cut.first[:-1].tolist(), cut.first[1:].tolist()):
            if 0 < y - x < k:
                out.append(words.runs(cut.hashes[x:y], y - x))
            else:
                out.append(np.unique(runs[x : max(x, y - k + 1)]))
    return out


def _class(s: np.ndarray) -> bytes:
    """A digest of a set: 128 bits from two mixes of its members."""
    a, b = words.mix(s ^ np.uint64(0x5851F42D4C957F2D)), words.mix(s + np.uint64(0x14057B7EF767814F))
    return np.array([len(s), a.sum(), b.sum()], "<u8").tobytes()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))


def classes(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text_hash, n, cls) per document: the size and the digest of its set; a null doc_id is the least number."""
    kinds = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("cls", pa.binary())])

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CLASS_ROWS):
                some = batch.slice(at, CLASS_ROWS)
                found = sets(some.column(1).to_pylist(), k)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([len(s) for s in found], pa.int64()), pa.array(map(_class, found), pa.binary())], schema=kinds)
                del found

    return _keyed(docs).mapInArrow(released(sized), "doc_id bigint, text_hash bigint, n bigint, cls binary")


def repeated_documents(docs: DataFrame, n_ngrams: int, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, cls) of documents with few enough n-grams of their own to have a link (step 2)."""
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_ngrams // 2 // BUCKET_NGRAMS + 1)
    sent = "bucket int, chunk bigint, doc_id array<bigint>, cls array<binary>, spare array<bigint>, seen binary, marks binary, repeated binary"
    kinds = pa.schema([
        ("bucket", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("cls", pa.list_(pa.binary())),
        ("spare", pa.list_(pa.int64())), ("seen", pa.binary()), ("marks", pa.binary()), ("repeated", pa.binary()),
    ])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in words.chunks(texts, CHUNK_CHARS):
                found = sets(texts[a:b], k)
                half = [s[s & np.uint64(1) == 0] for s in found]
                n_half = np.array([len(s) for s in half], np.int64)
                # How many n-grams of the half may be the document's own.
                allowed = np.array([len(s) * (100 - percent) // 100 for s in found], np.int64)
                grams = np.concatenate(half) if half else np.zeros(0, np.uint64)
                owner = np.repeat(np.arange(len(half)), n_half)
                by = np.argsort(grams, kind="stable")
                grams, owner = grams[by], owner[by]
                new = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, bool)
                size = np.diff(np.append(np.flatnonzero(new), len(grams)))
                single = np.repeat(size == 1, size)
                own = np.bincount(owner[single], minlength=len(half))  # of the others, this chunk itself shows a repeat
                twice = grams[new][size > 1]
                grams, owner = grams[single], owner[single]
                bucket = ((grams >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                by = np.lexsort((owner, bucket))
                grams, owner, bucket = (grams[by] >> np.uint64(1)).astype("<u4"), owner[by], bucket[by]
                twice_bucket = ((twice >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                by = np.argsort(twice_bucket, kind="stable")
                twice, twice_bucket = (twice[by] >> np.uint64(1)).astype("<u4"), twice_bucket[by]
                rows = [{"bucket": int(chunk % buckets), "chunk": chunk, "doc_id": ids[a:b], "cls": [_class(s) for s in found], "spare": (allowed - own).tolist()}]
                edges, twice_edges = (np.searchsorted(x, np.arange(buckets + 1)) for x in (bucket, twice_bucket))
                for k_ in np.flatnonzero((np.diff(edges) > 0) | (np.diff(twice_edges) > 0)).tolist():
                    x, y = edges[k_], edges[k_ + 1]
                    rows.append({
                        "bucket": k_, "chunk": chunk, "seen": grams[x:y].tobytes(),
                        "repeated": twice[twice_edges[k_] : twice_edges[k_ + 1]].tobytes(),
                    })
                    rows[-1]["marks"] = _packed(owner[x:y], len(found))
                chunk += 1
                yield pa.RecordBatch.from_pylist(rows, kinds)

    back = "chunk bigint, doc_id array<bigint>, cls array<binary>, spare array<bigint>"
    back_kinds = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("cls", pa.list_(pa.binary())), ("spare", pa.list_(pa.int64()))])

    def count(rows: pa.Table) -> pa.Table:
        out, seen, marks, chunk_of, many = [], [], [], [], []
        for r in rows.to_pylist():
            if r["cls"] is not None:
                out.append({n: r[n] for n in ("chunk", "doc_id", "cls", "spare")})
            else:
                seen.append(np.frombuffer(r["seen"], "<u4"))
                marks.append(_unpacked(r["marks"]))
                chunk_of.append(r["chunk"])
                many.append(np.frombuffer(r["repeated"], "<u4"))
        # A print is repeated if two chunks have it, or one chunk has it twice.
        every = np.sort(np.concatenate([*seen, *[np.concatenate([m, m]) for m in many], np.zeros(0, "<u4")]))
        repeated = np.unique(every[1:][every[1:] == every[:-1]])
        for chunk, prints, owner in zip(chunk_of, seen, marks):
            if len(prints) and len(repeated):
                at = np.minimum(np.searchsorted(repeated, prints), len(repeated) - 1)
                counts = np.bincount(owner[repeated[at] == prints])
                if len(counts):
                    out.append({"chunk": chunk, "spare": counts.tolist()})
        return pa.Table.from_pylist(out, back_kinds)

    def judge(rows: pa.Table) -> pa.Table:
        head, found = None, []
        for r in rows.to_pylist():
            if r["cls"] is not None:
                head = r
            else:
                found.append(np.array(r["spare"], np.int64))
        spare = np.array(head["spare"], np.int64)
        for f in found:
            spare[: len(f)] += f
        keep = np.flatnonzero(spare >= 0).tolist()
        return pa.table({"doc_id": pa.array([head["doc_id"][i] for i in keep], pa.int64()), "cls": pa.array([head["cls"][i] for i in keep], pa.binary())})

    dealt = _keyed(docs).mapInArrow(released(deal), sent)
    counted = dealt.groupBy("bucket").applyInArrow(count, back)
    return counted.groupBy("chunk").applyInArrow(judge, "doc_id bigint, cls binary")


def _packed(owner: np.ndarray, n: int) -> bytes:
    """Owners in ascending order: as they are if they are few, else as a count for each."""
    if 4 * len(owner) <= n:
        return b"\0" + owner.astype("<u4").tobytes()
    counts = np.bincount(owner, minlength=n)
    return (b"\1" + counts.astype("u1").tobytes()) if counts.max(initial=0) < 256 else (b"\4" + counts.astype("<u4").tobytes())


def _unpacked(marks: bytes) -> np.ndarray:
    if marks[0] == 0:
        return np.frombuffer(marks, "<u4", offset=1).astype(np.int64)
    counts = np.frombuffer(marks, "u1" if marks[0] == 1 else "<u4", offset=1)
    return np.repeat(np.arange(len(counts)), counts)


def _prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, n, own, p0, p1, ..., q0, shares): the repeated n-grams in the prefix of each node under each order, those of
    the shorter prefix under the first order that serves against nodes of at least its size, how many of its n-grams are
    its own, and how many repeated ones fall in each of 256 shares of all n-grams."""
    grams = nodes.select("node", F.explode("grams").alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    lists = grams.join(common, "gram").groupBy("node").agg(F.collect_list(F.struct("df", "gram")).alias("found"))
    own = F.col("n") - F.size("found")  # n-grams met only once come first in every order
    wanted = F.floor(F.col("n") * (100 - percent) / 100) + 1 - own
    fewer = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1 - own
    made = []
    for k in range(ORDERS):
        if k == 0:
            keyed = F.col("found")
        else:
            keyed = F.transform("found", lambda e, k=k: F.struct(F.floor(F.log2(e["df"])).alias("r"), F.xxhash64(e["gram"], F.lit(k)).alias("h"), e["gram"].alias("gram")))
        made.append(F.transform(F.slice(F.array_sort(keyed), F.lit(1), F.col("wanted").cast("int")), lambda e: e["gram"]).alias(f"p{k}"))

    def counted(column: pd.Series) -> pd.Series:
        counts = [np.bincount(np.asarray(g, np.int64) & (SHARES - 1), minlength=SHARES) for g in column]
        return pd.Series([c.astype("u1" if c.max() < 256 else "<u4").tobytes() for c in counts])

    shares = F.pandas_udf(counted, "binary")(F.transform("found", lambda e: e["gram"]))
    rows = nodes.select("node", "n").join(lists, "node").withColumns({"own": own, "wanted": wanted, "fewer": fewer}).filter("wanted > 0")
    rows = rows.select("node", "n", "own", "fewer", *made, shares.alias("shares"))
    return rows.withColumn("q0", F.slice("p0", F.lit(1), F.greatest("fewer", F.lit(0)).cast("int"))).drop("fewer")


def _linked(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""
    a = nodes.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    b = nodes.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    similar = 100 * both >= percent * (F.size("ga") + F.size("gb") - both)
    return pairs.join(a, "a").join(b, "b").filter(similar).select("a", "b")


def _can_link(a: str, b: str, percent: int):
    return (100 * F.least(a, b)) >= percent * F.greatest(a, b)


def _across(prefixes: DataFrame, known: DataFrame, percent: int, picks: int | None = None) -> DataFrame:
    """(a, b): pairs of different components that share a prefix n-gram under the first order and may be similar enough.

    The smaller of a pair is looked up by its short prefix. N-grams with few nodes are joined. Those with many would give
    pairs by the square, most of which miss the threshold by a little: they are taken together by the first node they have,
    as texts of one family share many of them, and the nodes of such a cluster are dealt to cells of two blocks. A cell gives
    only pairs whose overlap, bounded by what each has in 256 shares of all n-grams, can reach the threshold.

    With ``picks``, only cells are made, and each smaller document gets that many pairs at most, drawn by hash.
    """
    plain = prefixes.join(known, "node")
    rows = plain.select("node", "n", "own", "component", F.explode("p0").alias("gram"))
    sizes = rows.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.min("node").alias("first"))
    sizes = materialize(sizes.filter("lo < hi").select("gram", "size", "first"), "mixed")
    index = plain.select("node", "n", "own", "component", F.explode("q0").alias("gram"))
    few = sizes.filter(F.col("size") <= FEW).select("gram")
    a, b = (x.join(few, "gram").select(*[F.col(c).alias(f"{c}_{s}") for c in ("gram", "node", "n", "own", "component")]) for x, s in ((index, "a"), (rows, "b")))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    most = F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b"))
    able = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    joined = a.join(b, (F.col("gram_a") == F.col("gram_b")) & smaller & (F.col("component_a") != F.col("component_b")) & able)
    joined = joined.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    many = sizes.filter(F.col("size") > FEW).select("gram", "first")
    members = [materialize(x.select("node", "gram").join(many, "gram").select("first", "node").distinct(), "members") for x in (index, rows)]
    blocks = members[1].groupBy("first").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    blocks = materialize(blocks, "clusters")
    wide = plain.select("node", "n", "component", "shares")

    def dealt(of: DataFrame, mine: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(other)
        named = [F.col(c).alias(c) for c in ("first", "node", "n", "component", "shares")]  # columns of this side alone
        return of.join(blocks, "first").join(wide, "node").select(*named, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias(mine), every)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros((0, 2), np.int64)
        if left.num_rows and right.num_rows:
            x, y = (np.stack([_counts(v) for v in t["shares"].to_pylist()]) for t in (left, right))
            most = np.zeros((len(x), len(y)), np.float32)
            for k in range(1, int(min(x.max(), y.max())) + 1):
                most += (x >= k).astype(np.float32) @ (y >= k).astype(np.float32).T
            (i, m, c), (j, n, d) = ([t[name].to_numpy() for name in ("node", "n", "component")] for t in (left, right))
            able = 100.0 * most >= percent * (m[:, None] + n[None] - most.astype(np.float64))
            able &= (c[:, None] != d[None]) & ((m[:, None] < n[None]) | ((m[:, None] == n[None]) & (i[:, None] < j[None])))
            if picks is not None and picks < able.shape[1]:
                drawn = words.mix(i.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) ^ j.astype(np.uint64)[None])
                drawn[~able] = np.iinfo(np.uint64).max
                kept = np.zeros_like(able)
                np.put_along_axis(kept, np.argpartition(drawn, picks - 1, axis=1)[:, :picks], True, axis=1)
                able &= kept
            u, v = np.nonzero(able)
            found = np.stack([i[u], j[v]], 1)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    keys = ("first", "_a", "_b")
    cells = dealt(members[0], "_a", "_b").groupBy(*keys).cogroup(dealt(members[1], "_b", "_a").groupBy(*keys)).applyInArrow(cell, "a bigint, b bigint")
    if picks is None:
        return joined.union(cells).distinct()
    # A document lies in a cell for each block and cluster: of what they gave, as many are drawn again.
    drawn = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b")))
    return cells.distinct().withColumn("drawn", drawn).filter(F.col("drawn") <= picks).drop("drawn")


def _counts(shares: bytes) -> np.ndarray:
    return np.frombuffer(shares, "u1" if len(shares) == SHARES else "<u4").astype(np.uint32)


def linked_groups(nodes: DataFrame, percent: int = PERCENT, rounds: int = 0) -> DataFrame:
    """(node, component) for ``nodes`` (node bigint, n, grams array<bigint>), stored and with distinct sets."""
    prefixes = materialize(_prefixes(nodes, percent), "prefixes")

    def joined(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Components with those of ``pairs`` that are similar enough: only links from one component to another are followed,
        each pair of components once, so links found before are not walked again."""
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            return known
        more = materialize(_linked(pairs, nodes, percent), "links")
        for side in "ab":
            more = more.join(known.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side)
        more = more.filter("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        more = materialize(more, "crossing")
        if more.isEmpty():
            return known
        met = components(more.select(F.col("a").alias("node")).union(more.select("b")).distinct(), more)
        met = materialize(met.select(F.col("node").alias("component"), F.col("component").alias("least")), "met")
        return materialize(known.join(met, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "components")

    known = prefixes.select("node", F.col("node").alias("component"))
    for k in range(ORDERS):
        rows = prefixes.select("node", "n", F.explode(f"p{k}").alias("gram")).join(known, "node")
        first = rows.groupBy("gram").agg(F.min(F.struct("node", "n", "component")).alias("lead"))
        near = rows.join(first, "gram").filter((F.col("component") != F.col("lead.component")) & _can_link("n", "lead.n", percent))
        leaders = near.groupBy("node", F.col("lead.node").alias("leader")).agg(F.count("*").alias("shared"))
        pairs = leaders.groupBy("node").agg(F.max_by("leader", F.struct("shared", -F.col("leader"))).alias("leader"))
        known = joined(pairs.select(F.col("leader").alias("a"), F.col("node").alias("b")), known)
    for r in range(rounds):
        rows = prefixes.select("node", "n", F.explode(f"p{r % ORDERS}").alias("gram")).join(known, "node")
        drawn = [F.min(F.struct(F.xxhash64("node", F.lit(r * DRAWS + d)).alias("draw"), "node", "n", "component")).alias(f"d{d}") for d in range(DRAWS)]
        first = rows.groupBy("gram").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), *drawn)
        first = first.filter((F.col("size") > FEW) & (F.col("lo") < F.col("hi")))
        leads = F.posexplode(F.array(*[f"d{d}" for d in range(DRAWS)])).alias("d", "lead")
        near = rows.join(first, "gram").select("node", "n", "component", leads)
        near = near.filter((F.col("component") != F.col("lead.component")) & _can_link("n", "lead.n", percent))
        leaders = near.groupBy("node", "d", F.col("lead.node").alias("leader")).agg(F.count("*").alias("shared"))
        pairs = leaders.groupBy("node", "d").agg(F.max_by("leader", F.struct("shared", -F.col("leader"))).alias("leader"))
        before = known
        known = joined(pairs.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), known)
        if known is before:
            break
    for _ in range(SIFTS):
        before = known
        known = joined(_across(prefixes, known, percent, PICKS), known)
        if known is before:
            break
    pairs = materialize(_across(prefixes, known, percent), "across")
    if pairs.isEmpty():
        return nodes.select("node").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    others = [f"p{k}" for k in range(1, ORDERS)]
    for side in "ab":
        pairs = pairs.join(prefixes.select(F.col("node").alias(side), *[F.col(p).alias(f"{p}{side}") for p in others]), side)
    for p in others:
        pairs = pairs.filter(F.arrays_overlap(f"{p}a", f"{p}b"))
    known = joined(pairs.select("a", "b"), known)
    return nodes.select("node").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def groups(docs: DataFrame, k: int = K, percent: int = PERCENT, rounds: int = 0) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the least doc_id reachable by links) and
    text_hash, which with doc_id names the row."""
    rows = materialize(classes(docs, k), "classes")
    firsts = rows.filter("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("doc_id") != _NULL, F.col("doc_id"))).alias("least"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    able = repeated_documents(docs, total, k, percent).select("cls").distinct()
    wanted = materialize(firsts.join(able, "cls", "left_semi"), "candidates")
    kinds = pa.schema([("cls", pa.binary()), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in words.chunks(texts):
                found = sets(texts[a:b], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(_class, found), pa.binary()), pa.array([len(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], schema=kinds
                )

    chosen = _keyed(docs).join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    found = chosen.mapInArrow(released(gather), "cls binary, n bigint, grams array<bigint>")
    # A document id that repeats brings other texts along: they are kept if wanted, once for each class.
    found = found.join(wanted.select("cls", "rep", "least"), "cls").dropDuplicates(["cls"])
    nodes = materialize(found.withColumn("node", F.monotonically_increasing_id()), "nodes")
    grouped = linked_groups(nodes.select("node", "n", "grams"), percent, rounds)
    named = nodes.select("node", "cls", "least").join(grouped, "node")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.join(names, "component").select("cls", "component_id")
    labelled = firsts.join(linked, "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id"))
    real = F.when(F.col("doc_id") != _NULL, F.col("doc_id"))
    # Stored first, so that Spark can split the rows of a class with very many copies.
    joined = rows.join(materialize(labelled, "labelled").hint("merge"), "cls", "left")
    return joined.select(real.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(real).alias("component_id"), "text_hash")


def one_of_each_group(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` without those that have a group with a smaller doc_id in it; rows with equal id and text stay once.

    Whole rows are carried as one value, so other columns may have any names."""
    found = groups(docs, k, percent).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").distinct()
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    kept = rows.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["_doc", "_text"]).select("_row.*")
