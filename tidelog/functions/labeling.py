"""Weak labels and review reasons by ordered rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.text import contains_any


def _lowered(*columns: Column) -> list[Column]:
    return [F.lower(F.coalesce(c, F.lit(""))) for c in columns]


def weak_label(
    template: Column,
    event_type: Column,
    service: Column,
    error_types: list[str] = V.ERROR_EVENT_TYPES,
    important_types: list[str] = V.IMPORTANT_EVENT_TYPES,
) -> Column:
    """Label of one event; the order of the branches is the priority."""
    t, e, s = _lowered(template, event_type, service)
    is_error = e.isin(error_types) | contains_any(t, V.ERROR_WORDS)
    is_security = (
        t.contains(V.SCANNER_WORD) | s.contains(V.SCANNER_WORD) | contains_any(t, V.SECURITY_WORDS)
    )
    is_known_noise = (
        contains_any(
            t,
            V.WARN_NOISE_WORDS
            + [V.STORAGE_NOISE_SERVICE]
            + V.STORAGE_NOISE_WORDS
            + V.INFRA_NOISE_WORDS
            + [V.API_METHOD_TAG],
        )
        | s.contains(V.STORAGE_NOISE_SERVICE)
        | ((e == V.DEFAULT_EVENT_TYPE) & t.contains(V.DATASTORE_TAG))
    )
    is_important = e.isin(important_types) | contains_any(t, V.IMPORTANT_WORDS)
    return (
        F.when(is_error, "error")
        .when(is_security, "security_noise")
        .when(is_known_noise, "noise")
        .when(is_important, "important")
        .otherwise("noise")
    )


def review_reason(template: Column, event_type: Column, service: Column) -> Column:
    """Comma-joined reasons for a human look; empty where there is none."""
    t, e, s = _lowered(template, event_type, service)
    return F.concat_ws(
        ",",
        F.when(e == V.REVIEW_EVENT_TYPE, V.REVIEW_REASONS[0]),
        F.when(contains_any(t, V.REVIEW_WORDS) | contains_any(s, V.REVIEW_WORDS), V.REVIEW_REASONS[1]),
    )


def label_id(label: Column) -> Column:
    chain = F
    for name, number in V.LABEL_IDS.items():
        chain = chain.when(label == name, number)
    return chain


def label_of_id(number: Column) -> Column:
    chain = F
    for name, value in V.LABEL_IDS.items():
        chain = chain.when(number == value, name)
    return chain
