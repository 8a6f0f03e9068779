"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query is run to its last row into a sink that discards them; the figure is the median of
$BENCH_RUNS runs (default 3).
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidelog.plans.catalog import QUERIES  # noqa: E402
from tidelog.session import local_session  # noqa: E402

HEADLINE = [
    "rewrite_template", "tag_service", "normalize_events", "template_counts", "label_templates", "review_candidates",
    "dedupe_across_runs", "source_search", "top_incidents_by_risk", "alerts", "window_stats", "sliding_summary_windows",
    "markdown_reports", "stratified_split", "per_class_report", "latency", "session_segments", "session_text",
    "window_context", "vocabulary", "tfidf", "complement_bayes_scores", "chunks", "html_text", "passage_search_many",
    "reply_labels", "stream_summary_windows", "stream_scored_events", "score_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total median seconds of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
