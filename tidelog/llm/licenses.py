"""Whole texts that are a known licence: both sides are brought to one form and compared by digest.

The form: ASCII letters in lower case, lines that are copyright notices away, everything between words (line breaks and comment
marks too) a single space, and equivalent spellings made one. All of it is built from SQL functions, so no text leaves the JVM.
The known digests are a small table of literals or a table of the caller; a join on the digest finds the licence.

A notice is a line that begins with "copyright" and does not go on as a sentence does ("copyright holder", "copyright law"), with
a copyright sign, or with "(c)" and a year, and a line of nothing but "all rights reserved". A text may also be wrapped anew, which
puts its own notices into other lines; so a text is looked up with its notices too, and the known table has both digests of each
licence. A notice without "copyright", sign or year is not known as one, and one that runs over two lines loses the first; a
licence with notices of its own that is wrapped anew and given one more is not found.

Edge cases: a null text has a null digest and no licence; an empty text (or one of nothing but notices) has the digest of the
empty text and no licence; known texts with one form give the first id; a text whose digest without notices is known takes that
licence before the one of its digest with them; extra columns are kept; an input column named like a result raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words after "copyright" in a sentence, the lines that are notices, and what stands between words.
IN_SENTENCES = (
    "act also and are be claim disclaimer disclaimers doctrine doctrines for from holder holders if in interest interests is "
    "law laws license licenses licence licences like line lines notice notices of on or owner owners ownership patent patents "
    "permission permissions protection resulting right rights statement statements term terms that the those to treaty treaties under"
).split()
NOTICE = (
    r"(?md)^[ \t*#/;!%|>-]*(?:copyright[ \t]*:?[ \t]+(?!(?:" + "|".join(IN_SENTENCES) + r")(?![a-z0-9]))[^\s]|©|\(c\)[ \t]*(?:copyright|(?:19|20)[0-9][0-9])"
    r"|all rights reserved[ \t\r.]*$)[^\n]*"
)
BETWEEN_WORDS = r"(?:[^a-z0-9\x{80}-\x{10FFFF}]|[\x{A0}\x{AB}\x{BB}\x{2000}-\x{206F}\x{3000}-\x{3003}])+"
# Spellings that count as one (pattern, replacement).
SPELLINGS = [
    ("(licen|offen|defen)ce", "$1se"),
    ("(authori|capitali|categori|customi|emphasi|initiali|maximi|minimi|optimi|organi|reali|recogni|summari|utili)s", "$1z"),
    ("(behavi|col|fav|hon|lab)our", "$1or"),
    ("(anal|catal|dial)ogue", "$1og"),
    ("(cancel|label|model|signal)l(ed|ing)", "$1$2"),
    ("(acknowledg|judg)ement", "$1ment"),
    ("cent(re)( |$)", "center$2"),
    ("sub (license)", "sub$1"),
    ("(non) (commercial|exclusive|infringement)", "$1$2"),
]
WHOLE_WORDS = [("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http")]


def form(lower: Column) -> Column:
    """The form of a text in lower case, its notices included."""
    plain = F.trim(F.regexp_replace(lower, BETWEEN_WORDS, " "))
    for pattern, put in SPELLINGS:
        plain = F.regexp_replace(plain, pattern, put)
    for word, put in WHOLE_WORDS:
        plain = F.replace(plain, F.lit(word), F.lit(put))
    return plain


def _digests(rows: DataFrame) -> DataFrame:
    """``rows`` (_row, text) with _without and _with: the digests without and with notices; a text without any is formed once."""
    lower = rows.select("_row", F.translate("text", UPPER, LOWER).alias("_lower"))
    cut = lower.withColumn("_cut", F.regexp_replace("_lower", NOTICE, ""))
    found = cut.withColumn("_without", F.sha2(form(F.col("_cut")), 256))
    return found.withColumn("_with", F.when(F.col("_cut") != F.col("_lower"), F.sha2(form(F.col("_lower")), 256)).otherwise(F.col("_without")))


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None, notices: bool = False) -> DataFrame:
    """(license_digest, license_id) of known texts without their notices, or also with them; the first id of each form."""
    from tidelog.llm.license_texts import TEXTS

    rows = spark.createDataFrame(list((TEXTS if texts is None else texts).items()), "_row string, text string")
    found = _digests(rows)
    both = found.select("_row", F.explode(F.array("_without", *(["_with"] if notices else []))).alias("license_digest"))
    return both.groupBy("license_digest").agg(F.min("_row").alias("license_id"))


def find_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``license_digest`` (without notices) and ``license_id`` (null where the text is none of the known)."""
    if clash := [c for c in ("license_digest", "license_id") if c in docs.columns]:
        raise ValueError(f"columns {clash} are made here")
    known = known_digests(docs.sparkSession, notices=True) if known is None else known
    lookup = known.filter(F.col("license_digest") != F.sha2(F.lit(""), 256))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    joined = _digests(packed).select("_row", "_without", "_with")
    for side in ("_without", "_with"):
        joined = joined.join(lookup.select(F.col("license_digest").alias(f"{side}_key"), F.col("license_id").alias(f"{side}_id")), F.col(side) == F.col(f"{side}_key"), "left")
    return joined.select("_row.*", F.col("_without").alias("license_digest"), F.coalesce("_without_id", "_with_id").alias("license_id"))
