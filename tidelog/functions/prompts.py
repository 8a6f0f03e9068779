"""Prompt texts as columns. The wording is ours and may be replaced; cuts and answer formats matter."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.text import cut

_NAMES = ", ".join(V.LABELS)

CLASSIFY_SYSTEM = (
    "You label log templates. Answer with one JSON object and nothing else, with the keys "
    f'"label" (one of {_NAMES}), "confidence" (0 to 1), "explanation" and "severity" (0 to 10).'
)

FEW_SHOT_SYSTEM = (
    f"You label log templates of virtualization hosts. Answer with one word out of: {_NAMES}.\n"
    "noise is routine traffic, important is a change in the life of a machine, error is a failure, "
    "security_noise is sign-in and session traffic.\n\n"
    + "\n\n".join(f"- {t}\n  label = {label}" for t, label in V.FEW_SHOT_PAIRS)
)

SEVERITY_SYSTEM = (
    "You are on call. Judge whether these log anomalies need action now. Answer with one JSON object "
    'with the keys "urgent" (true or false), "severity" (P1 service down, P2 degraded, P3 watch, '
    'P4 for information), "reason" (one sentence) and "affected_hosts" (list).'
)


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def classify_prompt(template: Column) -> Column:
    return _joined("Which label fits this template?\n", cut(template, 300))


def few_shot_prompt(template: Column) -> Column:
    return _joined("- ", cut(template, 300), "\n  label =")


def window_prompt(template: Column, context: Column) -> Column:
    """``context`` is an array of earlier templates, oldest first; empty leaves the section out."""
    lines = F.array_join(F.transform(context, lambda t: F.concat(F.lit("* "), t)), "\n")
    section = F.when(F.size(context) > 0, F.concat(F.lit("What the same source logged before, oldest first:\n"), lines, F.lit("\n"))).otherwise("")
    return _joined(section, "Which label fits the next template?\n", template)


def severity_prompt(lines: Column) -> Column:
    return _joined(SEVERITY_SYSTEM, "\n\nAnomalies:\n", lines)


def report_prompt(period: Column, total: Column, labels: Column, platforms: Column, errors: Column) -> Column:
    return _joined(
        "Write a short operations report in Markdown with an overall sentence, critical events, patterns "
        "and recommendations.\nPeriod: ", period, "\nEvents: ", total.cast("string"), "\nBy label: ", labels,
        "\nBy platform: ", platforms, "\nErrors: ", errors,
    )


def explain_prompt(anomaly: Column, context: Column) -> Column:
    return _joined(
        "Explain this log anomaly in three to five sentences: likely cause, and how to check or fix it.\nAnomaly: ",
        anomaly, "\nDocumentation: ", context,
    )
