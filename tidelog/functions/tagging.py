"""Service and event-type tags: ordered rules, first match wins."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.text import contains_any, strip


def service_of(message: Column) -> Column:
    """Captured Windows service name, else the first known name found, else "unknown"."""
    message = F.coalesce(message, F.lit(""))
    lowered = F.lower(message)
    chain = F
    for pattern in V.SERVICE_CAPTURES:
        pattern = "(?d)" + pattern  # a dot stops at line feeds only
        chain = chain.when(message.rlike(pattern), strip(F.regexp_extract(message, pattern, 1)))
    for name in V.SERVICE_NAMES:
        chain = chain.when(lowered.contains(name.lower()), name)
    for text, name in V.SERVICE_FALLBACKS:
        chain = chain.when(lowered.contains(text), name)
    return chain.otherwise(V.UNKNOWN)


def event_type_of(message: Column) -> Column:
    lowered = F.lower(F.coalesce(message, F.lit("")))
    chain = F
    for event_type, words in V.EVENT_TYPE_RULES:
        chain = chain.when(contains_any(lowered, words), event_type)
    return chain.otherwise(V.DEFAULT_EVENT_TYPE)
