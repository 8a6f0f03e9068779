"""Pages to text, text to overlapping chunks, chunks to vectors, links between pages."""

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.html import page_links, page_text
from tidelog.functions.text import strip
from tidelog.operators.terms import tokens

PAGES = 64
_LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def extract_text(pages: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., text) from a column ``html``.

    A page at a time becomes a Python string, and texts are handed on every ``PAGES`` pages, not once for a whole batch."""
    fields = [f for f in pages.schema if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                texts = pa.array([page_text(h.as_py()) for h in part.column(len(fields))], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(fields)], texts], names=[*[f.name for f in fields], "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return pages.select(*[f"`{f.name}`" for f in fields], "html").mapInArrow(run, f"{schema}, text string")


def long_lines(text: Column, min_chars: int = V.MIN_LINE_CHARS) -> Column:
    """Stripped lines longer than ``min_chars``, joined again."""
    lines = F.transform(F.split(text, _LINE_BREAK), strip)
    return F.array_join(F.filter(lines, lambda x: F.length(x) > min_chars), "\n")


def long_documents(docs: DataFrame, min_chars: int = V.MIN_DOCUMENT_CHARS) -> DataFrame:
    return docs.filter(F.length("text") >= min_chars)


def chunk(
    docs: DataFrame,
    size: int = V.CHUNK_CHARS,
    overlap: int = V.CHUNK_OVERLAP,
    min_chars: int = V.MIN_CHUNK_CHARS,
) -> DataFrame:
    """Overlapping pieces of ``text`` with a dense ``chunk_id`` over the kept ones.

    All in the row, without a shuffle: the text is cut into pieces of size - overlap, and each chunk
    is a piece and the head of the next one, so long texts take linear time.
    """
    if overlap > size - overlap:
        raise ValueError("overlap must not exceed half of the chunk size")
    others = [c for c in docs.columns if c != "text"]
    step = size - overlap
    pieces = docs.select(*others, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_p"))

    def with_head(piece: Column, i: Column) -> Column:
        head = F.substring(F.coalesce(F.get("_p", i + 1), F.lit("")), 1, overlap)
        return strip(F.concat(piece, head))

    kept = F.filter(F.transform("_p", with_head), lambda c: F.length(c) > min_chars)
    return pieces.select(*others, F.posexplode(kept).alias("chunk_id", "text"))


def hashed_vectors(rows: DataFrame, text: str = "text", dim: int = 384) -> DataFrame:
    """Add ``vector``: hashed token counts of length one. An offline stand-in for a sentence model."""
    words = rows.withColumn("_w", tokens(F.col(text)))
    counted = HashingTF(inputCol="_w", outputCol="_c", numFeatures=dim).transform(words)
    unit = Normalizer(inputCol="_c", outputCol="_u", p=2.0).transform(counted)
    return unit.withColumn("vector", vector_to_array("_u", dtype="float32")).drop("_w", "_c", "_u")


def embed(rows: DataFrame, encode: Callable[[list[str]], list], text: str = "text", batch: int = 64) -> DataFrame:
    """Add ``vector`` by a caller's batch encoder (list of texts to list of vectors)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = part[text].tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
            yield part.assign(vector=[[float(x) for x in v] for v in vectors])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, vector array<float>")


def extract_links(pages: DataFrame) -> DataFrame:
    """(url, link) for every kept link of every page, duplicates included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = [page_links(u, h) for u, h in zip(batch["url"], batch["html"])]
            yield pd.DataFrame({"url": batch["url"], "link": links}).explode("link").dropna()

    return pages.select("url", "html").mapInPandas(run, "url string, link string")


def reachable(links: DataFrame, seeds: DataFrame, max_depth: int = 2, salts: int = 16) -> DataFrame:
    """(url, depth): pages reached from the seeds over at most ``max_depth`` links, at their least depth.

    ``links`` is (url, link), ``seeds`` is (url). One join per level; a page with very many links is
    spread over salts by its targets, and each level holds a page once.
    """
    salted = links.select("url", "link").distinct().withColumn("_salt", F.pmod(F.hash("link"), F.lit(salts)))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    level = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    seen = level
    for depth in range(1, max_depth + 1):
        found = level.select("url", every_salt).join(salted, ["url", "_salt"]).select(F.col("link").alias("url")).distinct()
        level = found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(level)
    return seen


def document_key(url: Column) -> Column:
    """Path without outer slashes, "index" when empty, ".html" appended unless there."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    bare = F.regexp_replace(path, "^/+|/+$", "")
    named = F.when(bare == "", "index").otherwise(bare)
    return F.when(named.endswith(".html"), named).otherwise(F.concat(named, F.lit(".html")))
