"""Decision scores to label, confidence, out-of-distribution flag and risk."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.text import round_even


def best_class(scores: Column, classes: list[str]) -> Column:
    """Class with the highest score; the first one on ties. ``classes`` follows the score order."""
    position = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in classes]), position)


def softmax_confidence(scores: Column) -> Column:
    """Softmax share of the winner, shifted by the maximum so that exp never overflows."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.lit(1.0) / total


def label_or_anomaly(label: Column, confidence: Column, threshold: float = V.OOD_THRESHOLD) -> Column:
    """``confidence`` must not be rounded: the threshold is strict."""
    return F.when(confidence < threshold, V.ANOMALY).otherwise(label)


def risk_score(label: Column) -> Column:
    chain = F
    for name, score in V.RISK_SCORES.items():
        chain = chain.when(label == name, score)
    return chain.otherwise(0)


def displayed_confidence(confidence: Column) -> Column:
    return round_even(confidence, 3)
