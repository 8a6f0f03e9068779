"""Secrets in whole texts: plain patterns, and encoded keys and signed tokens confirmed by their structure.

Base kinds are found by pattern: ``assign`` (a name such as password or token, a sign, a value of six characters or more),
``access`` (access key ids) and ``hex`` (24 hex digits or more).

The other kinds are reported only once their structure has been parsed:

* ``pem``: an armoured private key whose body decodes to a key below, or to whole cipher blocks under an encryption header;
* ``key``: a run of base64 (either alphabet) or hex that decodes to a private key in DER (PKCS#1, PKCS#8, encrypted PKCS#8,
  SEC 1, DSA): every nested length fits its parent and the fields are those of the format;
* ``openssh``: a run that decodes to an openssh-key-v1 file whose nested lengths end with the file;
* ``jwt``, ``jwe``: three (five) dotted parts, a JSON header that names a known algorithm (and the encryption), JSON claims,
  and a signature of the length that the algorithm gives (an integrity tag for ``jwe``);
* ``nested``: a run that decodes to text in which one of these stands; looked into three layers deep.

Public keys, certificates and plain digests have structure too, but are no secrets and are not reported.

Texts go through Arrow batches without a shuffle. The linear-time patterns of the Arrow library tell which texts can hold a
match at all; only those are searched in Python, each whole, in code points.

Edge cases: null and empty texts have no spans; every row has its own result, also rows that repeat an id and rows without
one; other columns are left out, so their names do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.memory import released

BASE = ["assign", "access", "hex"]
CONFIRMED = ["pem", "key", "openssh", "jwt", "jwe", "nested"]
KINDS = BASE + CONFIRMED
LAYERS = 3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
_BASE64_RUNS = [re.compile(r"[A-Za-z0-9+/]{40,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{40,}={0,2}")]
_HEX_RUN = re.compile(r"(?:[0-9a-fA-F]{2}){24,}")
# The first part of a token: a JSON object begins with a brace, so its base64 with e and one of sixteen signs.
_TOKEN_HEAD = re.compile(r"(?<![A-Za-z0-9_-])e[w-z0-9_-][A-Za-z0-9_-]{8,}(?=\.)")
_TOKEN_TAIL = re.compile(r"\.[A-Za-z0-9_-]*")

# What a text must have for a kind to be searched in it.
_MAY_ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
_MAY_ENCODE = r"[A-Za-z0-9+/]{40}|[A-Za-z0-9_-]{40}|-----BEGIN |e[w-z0-9_-][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*\."

# Bytes of a signature by algorithm (RSA: at least).
_SIGNED = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
_RSA = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}

Span = tuple[str, int, int]


# ---- DER

_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that fill ``data`` to its last byte; None where a length does not fit."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if tag & 0x1F == 0x1F:
            return None
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            length = int.from_bytes(data[at : at + n], "big")
            if length < 0x80 or data[at] == 0:
                return None
            at += n
        if at + length > len(data):
            return None
        items.append((tag, data[at : at + length]))
        at += length
    return items


def _tags(items: list[tuple[int, bytes]] | None) -> list[int]:
    return [t for t, _ in items] if items else []


def _algorithm(item: tuple[int, bytes]) -> bool:
    inner = der_items(item[1]) if item[0] == _SEQUENCE else None
    return bool(inner) and inner[0][0] == _OID and 3 <= len(inner[0][1]) <= 32


def der_key(data: bytes) -> str | None:
    """The format of a private key in DER, or None."""
    outer = der_items(data)
    if _tags(outer) != [_SEQUENCE]:
        return None
    fields = der_items(outer[0][1])
    tags = _tags(fields)
    if not tags:
        return None
    sizes = [len(c) for _, c in fields]
    version = fields[0][1] if tags[0] == _INTEGER else None
    if tags[:9] == [_INTEGER] * 9 and version in (b"\0", b"\1") and tags[9:] in ([], [_SEQUENCE]):
        # Modulus and both exponents are of one size, primes and their exponents of half of it.
        return "pkcs1" if sizes[1] >= 32 and sizes[3] <= sizes[1] + 1 and abs(sizes[4] + sizes[5] - sizes[1]) <= 2 else None
    if tags == [_INTEGER] * 6 and version == b"\0":
        return "dsa" if sizes[1] >= 32 and sizes[1] + 1 >= sizes[4] and sizes[2] + 1 >= sizes[5] else None
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS] and version in (b"\0", b"\1") and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        inner = der_items(fields[2][1])
        return "pkcs8" if _algorithm(fields[1]) and inner and len(inner) == 1 else None
    if tags[:2] == [_INTEGER, _OCTETS] and version == b"\1" and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]):
        return "sec1" if 14 <= sizes[1] <= 72 and all(der_items(c) for _, c in fields[2:]) else None
    if tags == [_SEQUENCE, _OCTETS] and _algorithm(fields[0]) and len(der_items(fields[0][1]) or []) == 2:
        return "pkcs8-encrypted" if sizes[1] >= 16 and sizes[1] % 8 == 0 else None
    return None


def openssh_key(data: bytes) -> bool:
    """Whether ``data`` is an openssh-key-v1 file from its first to its last byte."""
    magic = b"openssh-key-v1\0"
    at = len(magic)
    if not data.startswith(magic):
        return False

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    cipher, kdf, options = field(), field(), field()
    if not cipher or not kdf or options is None or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= len(data) or any(not field() for _ in range(keys)):
        return False
    private = field()
    if not private or at != len(data) or len(private) % 8:
        return False
    return cipher != b"none" or private[:4] == private[4:8]


# ---- Candidates


def unbase64(text: str) -> bytes | None:
    """The bytes of a run in either alphabet, with or without padding; None if it is none."""
    body = text.rstrip("=")
    if len(body) % 4 == 1 or (("+" in body or "/" in body) and ("-" in body or "_" in body)):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    data = unbase64(part)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def token_at(text: str, start: int, end: int) -> tuple[str, int] | None:
    """The kind and end of a signed (three parts) or encrypted (five parts) token whose first part is ``text[start:end]``,
    if its header, claims and signature hold together."""
    header = _object(text[start:end])
    algorithm = header.get("alg") if header else None
    if not isinstance(algorithm, str):
        return None
    encrypted = isinstance(header.get("enc"), str)
    parts = []
    for _ in range(4 if encrypted else 2):
        m = _TOKEN_TAIL.match(text, end)
        if not m:
            return None
        parts.append(m.group()[1:])
        end = m.end()
    if encrypted:
        tag = unbase64(parts[3])
        return ("jwe", end) if parts[1] and parts[2] and tag and 12 <= len(tag) <= 32 else None
    if _object(parts[0]) is None:
        return None
    signature = unbase64(parts[1])
    if algorithm == "none":
        return ("jwt", end) if parts[1] == "" else None
    if not signature:
        return None
    fits = len(signature) == _SIGNED[algorithm] if algorithm in _SIGNED else algorithm in _RSA and len(signature) >= 128
    return ("jwt", end) if fits else None


def _of_bytes(data: bytes, layers: int) -> str | None:
    """What decoded bytes are: ``key``, ``openssh``, ``nested`` or nothing."""
    if data[:1] == b"\x30" and der_key(data):
        return "key"
    if openssh_key(data):
        return "openssh"
    if layers > 0:
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return None
        if next(confirmed(text, layers - 1), None):
            return "nested"
    return None


def _pem_body(body: str) -> bool:
    """Whether an armoured body is a private key. Line breaks may be written as backslash and n."""
    body = body.replace("\\r", "").replace("\\n", "\n")
    encrypted = "Proc-Type: 4,ENCRYPTED" in body
    lines = [x.strip() for x in body.splitlines()]
    data = unbase64("".join(x for x in lines if x and ":" not in x))
    if not data:
        return False
    if encrypted and "DEK-Info:" in body:
        return len(data) >= 16 and len(data) % 8 == 0
    return der_key(data) is not None or openssh_key(data)


def confirmed(text: str, layers: int = LAYERS) -> Iterator[Span]:
    """Spans of encoded keys and tokens in ``text``, in no order; spans of different kinds may overlap."""
    armours = []
    for m in _PEM.finditer(text) if "-----BEGIN " in text else ():
        if _pem_body(m.group(2)):
            armours.append(m.span())
            yield "pem", m.start(), m.end()
    for m in _TOKEN_HEAD.finditer(text):
        if token := token_at(text, *m.span()):
            yield token[0], m.start(), token[1]
    for start, end in sorted({m.span() for run in _BASE64_RUNS for m in run.finditer(text)}):
        # A body in one line is part of its armour.
        inside = bisect_right(armours, (start, len(text))) - 1
        if inside >= 0 and end <= armours[inside][1]:
            continue
        data = unbase64(text[start:end])
        if data and (kind := _of_bytes(data, layers)):
            yield kind, start, end
    for m in _HEX_RUN.finditer(text):
        if kind := _of_bytes(bytes.fromhex(m.group()), layers):
            yield kind, m.start(), m.end()


def base_spans(text: str, assign: bool = True) -> list[Span]:
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6] if assign else []
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def spans_of(text: str, assign: bool = True, encoded: bool = True) -> list[Span]:
    """All spans of a text, in order of start, then of kind."""
    found = base_spans(text, assign) + sorted(set(confirmed(text)) if encoded else ())
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _any(texts: pa.Array, pattern: str) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_pylist()


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans): spans as structs of kind, start and end (code points, end exclusive), in order."""
    kind = docs.schema[id_column].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @released
    def scan(batches):
        for batch in batches:
            texts = batch.column(1)
            assign, encoded, hexes = _any(texts, _MAY_ASSIGN), _any(texts, _MAY_ENCODE), _any(texts, "[0-9a-f]{24}|AKIA")
            found = []
            for i in range(batch.num_rows):
                some = assign[i] or encoded[i] or hexes[i]
                found.append([dict(zip(("kind", "start", "end"), s)) for s in spans_of(texts[i].as_py(), assign[i], encoded[i] or hexes[i])] if some else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
