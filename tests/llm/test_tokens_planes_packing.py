"""Ids on disk and packing: exact round trips, and sequences against their bounds."""

import zlib

import numpy as np
import pytest

from tidelog.llm import packing, planes
from tidelog.llm.tokens import Encoder, tokenizer_path

SCHEMA = "doc_id bigint, text string, part string"
LONG = "Thandre edou, inhaea 12 the. " * 900
ROWS = [
    (5, "The words.\nOf them", "x"), (1, None, None), (2, "", "y"), (None, "no id", "z"), (3, LONG, "q"), (3, LONG, "q"),
    (3, "other text, same id", "q"), (9, "it's  two  spaces\t\n\nand é ü 中文 \U0001F600 <|endoftext|>", "w"), (7, "Ünï ²½ a_b", ""),
]


def plain(text):
    return Encoder.of(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_tokenizer():
    rng = np.random.default_rng(3)
    signs = ["a", "B", "é", " ", "  ", "\n", "\t", "\r\n", "1", "²", "!", "...", "_", "x\x1c", "\xa0", "'", "'s", "'re", "中", "\U0001F600", "￿", "ſ", "<|endoftext|>"]
    for size in (12, len(signs)):
        texts = ["".join(rng.choice(signs[:size], rng.integers(0, 15))) for _ in range(300)]
        for text, ids in zip(texts, Encoder.of(tokenizer_path()).encode_batch(texts), strict=True):
            assert ids.tolist() == plain(text)


def test_ids_are_those_of_a_fresh_tokenizer():
    """Also of texts with an added token; the encoder's own tokenizer is not asked."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path())
    end = fresh.token_to_id("<|endoftext|>")
    texts = ["a <|endoftext|> b", "plain words", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n it's", "<|endoftext |>", "", "a \uffff<|endoftext|>", "中 <|endoftext|>"]
    found = Encoder(tokenizer_path()).encode_batch(texts)
    assert [ids.tolist() for ids in found] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert end in found[0].tolist() and found[3].tolist().count(end) == 2
    assert end not in Encoder(tokenizer_path(), literal=True).encode_batch(texts[:1])[0].tolist()


def test_pieces_of_different_texts_make_no_added_token(tmp_path):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path())
    made.add_tokens(["one two"])
    made.save(str(tmp_path / "more.json"))
    texts = [" one", " two", " three one two", " two one"]
    found = Encoder(str(tmp_path / "more.json")).encode_batch(texts)
    assert [ids.tolist() for ids in found] == [made.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_store_may_be_emptied(monkeypatch):
    monkeypatch.setattr("tidelog.llm.tokens.CACHED_PIECES", 3)
    encoder = Encoder(tokenizer_path())
    for text in ("one two three four", "five six seven", "one two three four"):
        assert encoder.encode_batch([text])[0].tolist() == plain(text)


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [1, 7, 64, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    made = planes.to_planes(ids, bits)
    assert len(made) == 32 // bits and (planes.from_planes(made, n) == ids).all()


def test_crc_of_joined_parts():
    a, b = b"abc" * 50, b"xyz" * 333
    assert planes.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert planes.crc32_join(zlib.crc32(a), 0, 0) == zlib.crc32(a)


@pytest.mark.parametrize("bits, block", [(8, 1 << 16), (1, 100)])
def test_files_give_back_every_document(spark, tmp_path, bits, block):
    path = str(tmp_path / "ids")
    planes.write_planes(spark.createDataFrame(ROWS, SCHEMA), path, end_id=2, bits=bits, block_ids=block)
    rows = planes.read_digests(spark, path).orderBy("start").collect()
    start = 0
    for row, (doc_id, text) in zip(rows, sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), strict=True):
        ids = np.array([*plain(text), 2], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    pieces = planes.read_pieces(spark, path).filter("doc_id = 9").orderBy("skip").collect()
    assert [i for p in pieces for i in p["ids"]] == [*plain(ROWS[7][1]), 2]
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert [r["start"] for r in index] == np.cumsum([0] + [r["n_ids"] for r in index]).tolist()[:-1] and sum(r["n_ids"] for r in index) == start
    assert {r["n_ids"] <= block for r in index} == {True}


def test_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    planes.write_planes(empty, str(tmp_path / "ids"))
    assert planes.read_digests(spark, str(tmp_path / "ids")).count() == 0
    assert packing.pack_documents(empty).count() == 0


def checked(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_documents(spark):
    rows = packing.pack_documents(spark.createDataFrame(ROWS, SCHEMA), capacity=512, with_ids=True).collect()
    assert checked(rows, 512) == -(-sum(r["length"] for r in rows) // 512)
    want = sorted((r[0] or -1, np.array([*plain(r[1]), 0], "<u4").tobytes()) for r in ROWS)
    assert sum(r["length"] for r in rows) == sum(len(w[1]) // 4 for w in want)
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 3 and r["ids_crc32"] is not None and r["length"] > 10)
    assert long[-1][2] == 512 and long[0][2] <= 512 and long[0][0] == 0
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    mine = sorted((r["piece"], tuple(r["ids"])) for r in rows if r["doc_id"] == 9)
    assert [i for _, ids in mine for i in ids] == [*plain(ROWS[7][1]), 0]


def first_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        for k, free in enumerate(bins):
            if n <= free:
                bins[k] -= n
                break
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 100 if seed % 2 else 60, 400)
    counts = np.bincount(lengths, minlength=101)
    used = np.zeros(101, np.int64)
    for chosen, times in packing.plan(counts, 100):
        assert sum(chosen) <= 100 and times > 0
        for n in chosen:
            used[n] += times
    assert (used == counts).all()
    assert sum(t for _, t in packing.plan(counts, 100)) <= first_fit_decreasing(lengths.tolist(), 100)


def test_two_pieces_take_the_place_of_the_smallest():
    # Greedy takes 60 and 30 (90 of 100); 60 with 21 and 19 fills the sequence.
    counts = np.bincount([60, 30, 21, 19], minlength=101)
    assert packing.plan(counts, 100)[0] == ([60, 21, 19], 1)


def test_one_length_may_have_most_pieces(spark):
    parts = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "case when id % 3 = 0 then 70L else id % 50 + 1 end as length", "id as ids_crc32")
    rows = packing.pack(parts, 100).collect()
    assert len(rows) == 3000 and checked(rows, 100) <= first_fit_decreasing([r["length"] for r in rows], 100)
    with pytest.raises(ValueError):
        packing.pack(parts.withColumn("offset", parts["length"]))
