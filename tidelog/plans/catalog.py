"""All registered queries, in the order of the inventory."""

from tidelog.plans import classifier_queries, collect_queries, document_queries, label_queries, model_queries, quality_queries, incident_queries, stream_queries  # noqa: F401
from tidelog.plans.registry import ORACLES, QUERIES  # noqa: F401
