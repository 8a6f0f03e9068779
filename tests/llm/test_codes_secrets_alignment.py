"""Equal-average codes, structural secrets and token alignment: brute force, built examples and edge rows."""

import base64
import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import alignment, equal_average, secret_scan

# ---- Equal-average search


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """(rows of vec_id, code, error, label_error; digest) by looking at every entry."""
    import math

    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = max(Counter(len(v) for _, v, _ in kept).items(), key=lambda x: (x[1], x[0]))[0]
    kept = sorted((r for r in kept if len(r[1]) == size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-size // parts)
    cut = []
    for _, v, _ in kept:
        whole = [math.floor(256 * x) for x in v] + [0] * (width * parts - size)
        cut.append([whole[p * width : (p + 1) * width] for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(c[p], books[p])[1]].append(c[p])
            new.append([[sum(col) // len(members[k]) for col in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])])
        books = new
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[label]) for (i, _, label), f, e in zip(kept, found, errors)], digest


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error int"


def test_codes_equal_a_full_search(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 32).astype(np.float32).tolist(), int(i % 3) if i % 5 else None) for i in range(150)]
    # Coarse vectors make ties; some repeat an id or a row; some take no part.
    rows += [(200 + i, (rng.integers(-2, 3, 32) / 4).tolist(), 0) for i in range(60)]
    rows += [(3, [0.25] * 32, 1), (3, [0.25] * 32, 1), (None, [0.5] * 32, 2), (None, [-0.5] * 32, None)]
    rows += [(900, None, 0), (901, [], 0), (902, [None] * 32, 0), (903, [float("nan")] * 32, 0), (904, [float("inf")] * 32, 0), (905, [1.0] * 8, 0)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], VECTORS).repartition(5)
    got = equal_average.compress(df).collect()
    want, digest = brute_codes(rows)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    assert sorted((r["vec_id"] or -1, r["code"], r["error"], r["label_error"]) for r in got) == sorted((w[0] or -1, *w[1:]) for w in want)


def test_search_ends_only_strictly_beyond_the_best_distance():
    rng = np.random.default_rng(5)
    for width in (1, 2, 4, 7):
        for scale in (2, 30, 1 << 20, 1 << 39):
            entries, values = rng.integers(-scale, scale, (64, width)), rng.integers(-scale, scale, (200, width))
            entries[5] = entries[40]
            index, best = equal_average.nearest(values, entries)
            gaps = values[:, None].astype(object) - entries[None].astype(object)
            exact = (gaps * gaps).sum(2)
            assert [int(b) for b in best] == [min(r) for r in exact.tolist()]
            assert index.tolist() == [r.index(min(r)) for r in exact.tolist()]


def test_a_part_length_that_does_not_divide_and_few_vectors(spark):
    rows = [(i, [float(i), 0.1, -0.7, 1e30, -3.4e38], None) for i in range(3)]
    got = equal_average.compress(spark.createDataFrame([(*r, "", 0) for r in rows], VECTORS), parts=2).collect()
    assert [r["code"] for r in sorted(got, key=lambda r: r["vec_id"])] == ["0000", "0100", "0200"]
    assert {(r["error"], r["label_error"]) for r in got} == {(0, 0)}


def test_codes_of_an_empty_table(spark):
    assert equal_average.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert equal_average.compress(spark.createDataFrame([(1, None, 2, "", 0)], VECTORS)).count() == 0


# ---- Secrets


def tlv(tag, content):
    n = len(content)
    head = bytes([n]) if n < 128 else bytes([0x80 | len(b := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + b
    return bytes([tag]) + head + content


def number(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def rsa_key(seed=1, bits=512):
    rng = random.Random(seed)
    half = [rng.getrandbits(bits // 2) | 1 << (bits // 2 - 1) for _ in range(5)]
    n, d = half[0] * half[1] | 1 << (bits - 1), rng.getrandbits(bits - 1) | 1 << (bits - 2)
    return tlv(0x30, b"".join(map(number, [0, n, 65537, d, *half])))


def pkcs8(inner):
    return tlv(0x30, number(0) + tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")) + tlv(5, b"")) + tlv(4, inner))


def sec1():
    return tlv(0x30, number(1) + tlv(4, bytes(range(32))) + tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))))


def openssh(cipher=b"none"):
    def field(b):
        return len(b).to_bytes(4, "big") + b

    private = b"\1\2\3\4" * 2 + bytes(range(56))
    return b"openssh-key-v1\0" + field(cipher) + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"public part") + field(private)


def b64(data):
    return base64.b64encode(data).decode()


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def jwt(alg="HS256", signature=b"s" * 32, claims=None, header=None):
    head = json.dumps(header or {"alg": alg, "typ": "JWT"}).encode()
    return ".".join([url64(head), url64(json.dumps(claims or {"sub": "1"}).encode()), url64(signature)])


def pem(data, name="RSA PRIVATE KEY", head="", line="\n"):
    body = b64(data)
    return line.join([f"-----BEGIN {name}-----", *([head] if head else []), *[body[i : i + 64] for i in range(0, len(body), 64)], f"-----END {name}-----"])


def own_kinds(text):
    return [(k, text[a:b]) for k, a, b in secret_scan.spans_of(text) if k in secret_scan.CONFIRMED]


@pytest.mark.parametrize("data", [rsa_key(), pkcs8(rsa_key()), sec1(), rsa_key(4, 1024)])
def test_keys_are_found_in_base64_and_hex(data):
    for run in (b64(data), url64(data), data.hex(), data.hex().upper()):
        assert own_kinds(f"é key is {run}, as said") == [("key", run)]
    assert own_kinds(pem(data)) == [("pem", pem(data))]
    assert own_kinds("x = '" + pem(data, line="\\n") + "'")[0][0] == "pem"


def test_structure_must_hold():
    for bad in (rsa_key()[:-1], rsa_key() + b"\0", b"\x30\x82\xff\xff" + rsa_key()[4:], tlv(0x30, number(0) + number(5)), bytes(range(200)), pkcs8(b"\x04\x09abc")):
        assert own_kinds(f"key {b64(bad)} {bad.hex()} {pem(bad)}") == []
    public = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")) + tlv(5, b"")) + tlv(3, b"\0" + rsa_key()))
    assert own_kinds(b64(public)) == []


def test_openssh_and_encrypted_armour():
    data = openssh()
    assert own_kinds(b64(data)) == [("openssh", b64(data))]
    assert own_kinds(pem(data, "OPENSSH PRIVATE KEY"))[0][0] == "pem"
    assert own_kinds(b64(data[:-3])) == [] and own_kinds(b64(data + b"\0")) == []
    sealed = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011"
    assert own_kinds(pem(bytes(64), head=sealed))[0][0] == "pem" and own_kinds(pem(bytes(63), head=sealed)) == []


def test_tokens():
    whole = jwt()
    assert own_kinds(f"see example-host.{whole}.") == [("jwt", whole)]
    assert own_kinds(jwt("RS256", b"s" * 256))[0][0] == "jwt" and own_kinds(jwt("none", b""))[0][0] == "jwt"
    for bad in (jwt("HS256", b"s" * 31), jwt("none", b"s"), jwt("XX", b"s" * 32), jwt(header={"typ": "JWT"}), jwt(header={"alg": 5}), "eyJhbGciOi.eyJhbGciOi.aaaa"):
        assert own_kinds(bad) == []
    parts = [json.dumps({"alg": "dir", "enc": "A128GCM"}).encode(), b"", b"i" * 12, b"cipher", b"t" * 16]
    assert own_kinds(".".join(map(url64, parts)))[0][0] == "jwe"
    assert own_kinds("[" * 100_000 + "." + url64(b'{"a":' + b"[" * 100_000) + ".a.b") == []


def test_layers():
    inside = b64(f"the key\n{pem(rsa_key())}\n".encode())
    assert own_kinds(f"data: {inside}") == [("nested", inside)]
    assert own_kinds(b64(inside.encode()))[0][0] == "nested"
    assert own_kinds(b64(jwt().encode()))[0][0] == "nested"


def brute_base(text):
    """The base spans straight from their definition."""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                out.append((m.start(), k, f"{secret_scan.BASE[k]}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def secret_texts():
    rng = random.Random(9)
    bits = ["password", "PassWD", "secret", "toKen", "api_key", "apikey", "aſecret", "toKen", "=", " = ", ":", '"', "'", " ", "abc", "0123456789abcdef", "AKIA", "ABCDEF0123", "é", "𝒳", "\n", "-_./+=", "x"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_base_spans_equal_their_definition(spark):
    texts = [*secret_texts(), None, "", jwt(), "\x00token=abcdef", "secret: " + "0" * 30, "Zahl " * 60_000 + " token=abcdefg " + "ab" * 50_000]
    rows = [(i if i % 7 else 3, t, "x") for i, t in enumerate(texts)] + [(None, "token=abcdef", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = secret_scan.digests(secret_scan.find_secrets(docs)).collect()
    shown = lambda d, s, all_: (d if d is not None else -1, *[sum(x.startswith(k + ":") for x in s) for k in secret_scan.BASE], hashlib.sha256(",".join(s).encode()).hexdigest(), all_)
    want = []
    for i, t, _ in rows:
        base = brute_base(t or "")
        want.append(shown(i, base, ",".join(f"{k}:{a}:{b}" for k, a, b in secret_scan.spans_of(t or ""))))
        assert [s for s in want[-1][-1].split(",") if s.split(":")[0] in secret_scan.BASE] == base
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *r[1:]) for r in got) == sorted(want)


def test_secrets_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert secret_scan.digests(secret_scan.find_secrets(docs)).count() == 0


def test_registered_secrets_equal_the_definition(spark, sf_dir):
    from tidelog.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op12_structural_secrets"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in secret_scan.BASE] == base


# ---- Alignment


def brute_alignment(texts):
    """Rows of the contract from fresh tokenizers, by sets of byte ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.tokenizer_path(alignment.TOKENIZER_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.tokenizer_path(alignment.TOKENIZER_B))
    byte = alignment.byte_of_sign()
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        groups = [
            ",".join(str(i) for i, e in zip(ids_a, ends_a) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(ids_b, ends_b) if lo < e <= hi)
            for lo, hi in zip([0, *both], both)
        ]
        links = [
            (x, y)
            for x, ea, sa in zip(ids_a, ends_a, [0, *ends_a])
            for y, eb, sb in zip(ids_b, ends_b, [0, *ends_b])
            if max(sa, sb) < min(ea, eb)
        ]
        docs.append((ids_a, ids_b, groups, links))
    counts = Counter(p for d in docs if d for p in set(d[3]))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids_a, ids_b, groups, links = d
        best = sum(counts[p] == most[p[0]] for p in links)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def alignment_texts():
    rng = random.Random(4)
    bits = ["the", "house", "straße", "日本語", "\n", "\n\n", "\t", " ", "  ", "   ", "'s", "12345", "!?", "\xa0", "　", "\x1c", "𝒳", "<|endoftext|>", "</s>", "<0x41>", "é", "é", "ﬁ", "\r\n", "​", " ", "antidisestablishmentarianism", "x"]
    made = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    return [*made, None, "", " ", "  ", "a▁b", "▁", "\x00", "￿ a", "a " * 400, "\n \n", "word " * 3 + "  ", "同じ" * 200]


def test_alignment_equals_sets_of_ends(spark):
    texts = alignment_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, pairs string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_alignment(texts)


def test_registered_alignment_equals_sets_of_ends(spark, sf_dir):
    from tidelog.llm.queries import QUERIES

    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if r["text"] and len(r["text"]) < 1500]
    got = {r["doc_id"]: r for r in QUERIES["op13_diagonal_alignment"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r, want in zip(short, brute_alignment([r["text"] for r in short])):
        # Counts are those of the whole table; the rest is the document's own.
        assert tuple(got[r["doc_id"]][c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == (*want[:4], want[6])


def test_chunks_and_caches_do_not_change_the_result(spark, monkeypatch):
    texts = alignment_texts()
    rows = [(i, t) for i, t in enumerate(texts)]
    pair = alignment.Pair(*(alignment.tokenizer_path(f) for f in (alignment.TOKENIZER_A, alignment.TOKENIZER_B)))
    whole = alignment.Pair(*(alignment.tokenizer_path(f) for f in (alignment.TOKENIZER_A, alignment.TOKENIZER_B)))
    whole.by_segment = False
    shown = lambda rows: [r and (r.n_a, r.n_b, r.n_groups, r.codes.tolist(), r.groups) for r in rows]
    first, again = shown(pair.align_texts(texts)), shown(pair.align_texts(texts))
    assert pair.by_segment and first == again == shown(whole.align_texts(texts))
    monkeypatch.setattr(alignment, "CACHED_SEGMENTS", 10)
    assert [shown(pair.align_texts([t]))[0] for t in texts] == first
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = sorted(map(tuple, alignment.align_documents(docs.coalesce(1)).collect()))
    assert one == sorted(map(tuple, alignment.align_documents(docs.repartition(40)).collect()))


def test_diagonal_runs_cover_both_sides():
    rng = np.random.default_rng(8)
    for share in (0.0, 0.02, 0.5, 0.95):
        for _ in range(30):
            last = int(rng.integers(1, 3000))
            base = np.flatnonzero(rng.random(last) < 0.5)
            ends = [np.unique(np.append(np.append(base[rng.random(len(base)) >= share], np.flatnonzero(rng.random(last) < share / 3)), last)) for _ in range(2)]
            runs = alignment.align(*ends)
            edges = []
            for (i, j, n), (ni, nj, _) in zip(runs, [*runs[1:], (len(ends[0]), len(ends[1]), 0)]):
                if n > 0:
                    assert (ni, nj) == (i + n, j + n) and (ends[0][i:ni] == ends[1][j:nj]).all()
                    edges += ends[0][i:ni].tolist()
                else:
                    assert ends[0][ni - 1] == ends[1][nj - 1]
                    edges.append(int(ends[0][ni - 1]))
            assert edges == sorted(set(ends[0].tolist()) & set(ends[1].tolist()))


def test_alignment_of_nothing_and_of_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align_documents(empty).count() == 0
    none = spark.createDataFrame([(1, None), (None, "")], "doc_id bigint, text string")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(none).collect()) == [(0, 0, 0, 0, 0, 0, "")] * 2
    twice = spark.createDataFrame([(1, "same text")] * 3 + [(None, "same text")], "doc_id bigint, text string")
    got = alignment.align_documents(twice).collect()
    assert len(got) == 4 and len({tuple(r[c] for c in COLUMNS) for r in got}) == 1 and got[0]["count_sum"] == 4 * got[0]["n_links"]
    assert alignment.align_documents(twice.select(F.col("doc_id").alias("pairs"), F.col("text").alias("chunk")), "pairs", "chunk").count() == 4
