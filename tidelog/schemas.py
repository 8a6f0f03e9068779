"""Declared schemas. Sources read with these, never with inference."""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RAW_MESSAGE = _struct(
    ("gl2_message_id", _S),
    ("_id", _S),
    ("timestamp", _S),
    ("source", _S),
    ("message", _S),
    ("level", _I),
    ("facility", _S),
    ("facility_num", _I),
    ("gl2_remote_ip", _S),
    ("streams", T.ArrayType(_S)),
)

RAW_ENVELOPE = _struct(("messages", T.ArrayType(_struct(("_id", _S), ("message", RAW_MESSAGE)))))

EVENT = _struct(
    ("id", _S),
    ("timestamp", T.TimestampType()),
    ("platform", _S),
    ("host", _S),
    ("cluster", _S),
    ("source", _S),
    ("service", _S),
    ("severity", _I),
    ("facility", _S),
    ("message", _S),
    ("template", _S),
    ("event_type", _S),
    ("label", _S),
)

EVENT_COLUMNS = EVENT.fieldNames()

PREDICTION = T.StructType(
    EVENT.fields
    + _struct(("predicted_label", _S), ("confidence", _D), ("risk_score", _I)).fields
)

LABELED_TEMPLATE = _struct(
    ("template", _S),
    ("label", _S),
    ("event_type", _S),
    ("service", _S),
    ("platform", _S),
    ("count", _L),
    ("label_confidence", _D),
    ("label_candidates", _S),
)

REVIEW_CANDIDATE = _struct(
    ("template", _S),
    ("suggested_label", _S),
    ("reason", _S),
    ("event_type", _S),
    ("service", _S),
    ("platform", _S),
    ("count", _L),
    ("label_confidence", _D),
    ("label_candidates", _S),
)

SESSION_TRACE = _struct(("Label", _S), ("Features", _S))
SESSION_TEMPLATE = _struct(("EventId", _S), ("EventTemplate", _S))

DOC_CHUNK = _struct(
    ("source", _S), ("platform", _S), ("chunk_id", _I), ("text", _S), ("vector", T.ArrayType(T.FloatType()))
)

MODEL_REPLY = _struct(("label", _S), ("confidence", _D), ("explanation", _S), ("severity", _I))

EVAL_PAIR = _struct(
    ("example_id", _L), ("y_true", _S), ("y_pred", _S), ("confidence", _D), ("seconds", _D)
)
