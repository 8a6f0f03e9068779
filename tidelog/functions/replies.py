"""Model replies to label, confidence and severity. Bad replies never fail a row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.text import cut, round_even

_MAP = "map<string,string>"


def _object(text: Column) -> Column:
    """Null unless all of ``text`` is one JSON object.

    Read as an array of one, since from_json would skip what follows a complete object.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{_MAP}>", {"allowSingleQuotes": "false"})
    return F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))


def reply_object(raw: Column, greedy: bool = False) -> Column:
    """The reply as a map: the whole text as JSON, else its first {...} part, else null."""
    pattern = r"(?s)\{.*\}" if greedy else r"(?s)\{.*?\}"
    return F.coalesce(_object(raw), _object(F.regexp_extract(raw, pattern, 0)))


def reply_label(reply: Column) -> Column:
    """"label" of the map; a label outside the domain gives way to a key that is a label."""
    label = F.try_element_at(reply, F.lit("label"))
    known = label.isin(*V.LABELS, V.UNKNOWN)
    key = F.get(F.filter(F.map_keys(reply), lambda k: k.isin(V.LABELS)), F.lit(0))
    return F.when(known, label).otherwise(F.coalesce(key, label, F.lit(V.UNKNOWN)))


def reply_confidence(reply: Column) -> Column:
    """0.5 where missing, zero or not a number."""
    return or_half(F.try_element_at(reply, F.lit("confidence")).try_cast("double"))


def or_half(confidence: Column) -> Column:
    return F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(0.5))


def one_word_label(raw: Column) -> Column:
    """First label, in search order, that occurs as a whole word; its "_" also matches a space."""
    text = F.lower(raw)
    chain = F
    for label in V.REPLY_SEARCH_ORDER:
        chain = chain.when(text.rlike(r"(?U)\b" + label.replace("_", r"[_\s]") + r"\b"), label)
    return chain.otherwise(V.UNKNOWN)


def head_label(label: Column) -> Column:
    """Label of a classifier head: lower-cased, "unknown" outside the domain."""
    lowered = F.lower(label)
    return F.when(lowered.isin(V.LABELS), lowered).otherwise(V.UNKNOWN)


def head_score(score: Column) -> Column:
    return round_even(score, 3)


def salvaged(raw: Column) -> Column:
    """Struct (label, confidence, explanation, severity) from a reply, by the widest {...} part.

    Without JSON: unknown, 0, the first 100 characters, severity 0.
    """
    found = reply_object(raw, greedy=True)

    def field(name: str) -> Column:
        return F.try_element_at(found, F.lit(name))

    return F.struct(
        F.when(found.isNull(), V.UNKNOWN).otherwise(field("label")).alias("label"),
        F.when(found.isNull(), 0.0).otherwise(field("confidence").try_cast("double")).alias("confidence"),
        F.when(found.isNull(), cut(raw, 100)).otherwise(field("explanation")).alias("explanation"),
        F.when(found.isNull(), 0).otherwise(field("severity").try_cast("int")).alias("severity"),
    )
