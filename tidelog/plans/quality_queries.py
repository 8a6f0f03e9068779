"""Registered queries: samples, model quality, sessions."""

from pyspark.sql import functions as F

from tidelog.operators import metrics as M
from tidelog.operators import sampling as S
from tidelog.operators import segments as SG
from tidelog.operators import sessions as SE
from tidelog.operators import terms as T
from tidelog.plans import views
from tidelog.plans.registry import register
from tidelog.session import materialize

# Labels by event type; three "models" err on different rows.
_TRUE = """case event_type when 'error' then 'error' when 'signup' then 'security_noise'
 when 'purchase' then 'important' else 'noise' end"""
_NEXT = """case y_true when 'error' then 'important' when 'important' then 'noise'
 when 'noise' then 'security_noise' else 'error' end"""
_MODELS = [(0, "first", 17), (1, "second", 13), (2, "third", 29)]


def _pairs_text(model, modulus):
    return f"""select example_id, '{model}' as model, y_true,
      case when example_id % {modulus} = 0 then {_NEXT} else y_true end as y_pred, confidence, seconds
      from labeled"""


_LABELED = f"""labeled as (select event_id as example_id, {_TRUE} as y_true,
  1.0 / (1 + event_id % 7) + (event_id % 1000) / 10000.0 as confidence, value as seconds from events)"""
PAIRS = f"with {_LABELED}, pairs as (" + " union all ".join(_pairs_text(m, k) for _, m, k in _MODELS) + ")"
_DUCK_LABELED = _LABELED.replace("1.0 /", "1.0::double /").replace("/ 10000.0", "/ 10000.0::double")
DPAIRS = PAIRS.replace(_LABELED, _DUCK_LABELED)


def labeled(spark, sf_dir):
    return views.table(spark, sf_dir, "events").selectExpr(
        "event_id as example_id",
        f"{_TRUE} as y_true",
        "1.0D / (1 + event_id % 7) + (event_id % 1000) / 10000.0D as confidence",
        "value as seconds",
    )


def pairs(spark, sf_dir):
    rows = labeled(spark, sf_dir)
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for _, m, k in _MODELS]))
    return rows.select("*", models.alias("m")).select(
        "example_id",
        F.col("m.model").alias("model"),
        "y_true",
        F.when(F.col("example_id") % F.col("m.k") == 0, F.expr(_NEXT)).otherwise(F.col("y_true")).alias("y_pred"),
        "confidence",
        "seconds",
    )


# ------------------------------------------------------------ splits and samples

_RANKED = f"""with {_DUCK_LABELED}, ranked as (select example_id, y_true as label,
  row_number() over (partition by y_true order by md5('42-' || example_id), example_id) as r,
  count(*) over (partition by y_true) as n from labeled)"""


@register("stratified_split", f"{_RANKED} select example_id, label, case when r <= ceil(n * 0.2) then 'test' else 'train' end as part from ranked")
def _split(spark, sf_dir):
    rows = labeled(spark, sf_dir).select("example_id", F.col("y_true").alias("label"))
    return S.stratified_split(rows, "example_id")


@register("stratified_folds", f"{_RANKED} select example_id, label, (r - 1) % 5 as fold from ranked")
def _folds(spark, sf_dir):
    rows = labeled(spark, sf_dir).select("example_id", F.col("y_true").alias("label"))
    return S.stratified_folds(rows, "example_id")


@register("per_class_sample", f"{_RANKED} select example_id, label from ranked where r <= greatest(1, 30 // 4)")
def _per_class(spark, sf_dir):
    rows = labeled(spark, sf_dir).select("example_id", F.col("y_true").alias("label"))
    return S.per_class_sample(rows, "example_id", limit=30, classes=4)


@register(
    "uniform_sample",
    "select event_id, event_type from events order by md5('42-' || event_id), event_id limit 500",
)
def _uniform(spark, sf_dir):
    return S.uniform_sample(views.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 500)


@register("head_rows", "select event_id, event_type from events order by event_id limit 30")
def _head(spark, sf_dir):
    return S.head(views.table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], 30)


# ------------------------------------------------------------ metrics

_CLASSES = """, labels_of as (select model, y_true as label from pairs union select model, y_pred from pairs),
 pc as (select l.model, l.label,
   (select count(*) from pairs p where p.model = l.model and p.y_true = l.label and p.y_pred = l.label) as tp,
   (select count(*) from pairs p where p.model = l.model and p.y_true = l.label) as support,
   (select count(*) from pairs p where p.model = l.model and p.y_pred = l.label) as called from labels_of l),
 classes as (select *, coalesce(tp / nullif(called, 0), 0) as "precision", coalesce(tp / nullif(support, 0), 0) as recall,
   coalesce(2 * tp / nullif(called + support, 0), 0) as f1 from pc)"""
_ROWS = f"""{DPAIRS}{_CLASSES}, rows as (select model, sum(tp) / sum(support) as accuracy, avg(f1) as macro_f1,
   sum(f1 * support) / sum(support) as weighted_f1, max(f1) filter (where label = 'error') as f1_error,
   max(f1) filter (where label = 'security_noise') as f1_security_noise from classes group by model)"""


def _one(name, column):
    @register(name, f"{_ROWS} select model, round_even({column}, 4) as {column} from rows")
    def _query(spark, sf_dir):
        return M.metrics_rows(pairs(spark, sf_dir), ["model"]).select("model", column)


for _name in ["accuracy", "macro_f1", "weighted_f1", "f1_error", "f1_security_noise"]:
    _one(_name, _name)


@register(
    "per_class_report",
    f"""{DPAIRS}{_CLASSES} select model, label, round_even("precision", 4) as "precision", round_even(recall, 4) as recall,
     round_even(f1, 4) as f1, support from classes""",
)
def _report(spark, sf_dir):
    rows = M.per_class(M.confusion_counts(pairs(spark, sf_dir), ["model"]), ["model"])
    return rows.select(
        "model", "label", *[F.bround(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


_LABELS = ["noise", "important", "error", "security_noise"]


@register(
    "confusion_matrix",
    f"{DPAIRS} select model, y_true, "
    + ", ".join(f"count(*) filter (where y_pred = '{x}') as {x}" for x in _LABELS)
    + " from pairs group by all",
)
def _matrix(spark, sf_dir):
    return M.confusion_matrix(pairs(spark, sf_dir), _LABELS, ["model"])


_BINARY = """, b as (select model, count(*) filter (where y_true = 'error' and y_pred = 'error') as tp,
  count(*) filter (where y_pred = 'error') as called, count(*) filter (where y_true = 'error') as support
  from pairs group by model), br as (select model, round_even(tp / called, 4) as p, round_even(tp / support, 4) as r,
  round_even(2 * tp / (called + support), 4) as f1 from b)"""


def binary(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(
        "model",
        (F.col("y_true") == "error").cast("int").alias("y_true"),
        (F.col("y_pred") == "error").cast("int").alias("y_pred"),
    )
    return M.binary_rows(rows, ["model"])


@register("binary_metrics", f"{DPAIRS}{_BINARY} select * from br")
def _binary(spark, sf_dir):
    return binary(spark, sf_dir)


_PUBLISHED = """select 'DeepLog [Du et al., 2017]' as model, 0.9615::double as p, 0.9375::double as r, 0.9493::double as f1
  union all select 'LogBERT [Guo et al., 2021]', 0.9827, 0.9790, 0.9808"""


@register("results_with_published", f"{DPAIRS}{_BINARY} select * from br union all {_PUBLISHED}")
def _published(spark, sf_dir):
    return M.with_published(binary(spark, sf_dir))


@register("best_own_model", f"{DPAIRS}{_BINARY} select * from br order by f1 desc, model limit 1")
def _best_own(spark, sf_dir):
    return M.best_own(M.with_published(binary(spark, sf_dir)))


@register(
    "model_comparison",
    f"""{_ROWS} select model, round_even(macro_f1, 4) as macro_f1,
      row_number() over (order by round_even(macro_f1, 4) desc, model) = 1 as best from rows""",
)
def _comparison(spark, sf_dir):
    rows = M.metrics_rows(pairs(spark, sf_dir), ["model"])
    return M.mark_best(rows, seq="model").select("model", "macro_f1", "best")


_REPLIES = f"""{DPAIRS}, replies as (select example_id, y_true,
  case when example_id % 19 = 0 then 'unknown' when example_id % 23 = 0 then null else y_pred end as y_pred
  from pairs where model = 'first')"""


def replies(spark, sf_dir):
    n = F.col("example_id")
    holed = F.when(n % 19 == 0, "unknown").when(n % 23 == 0, F.lit(None)).otherwise(F.col("y_pred"))
    return pairs(spark, sf_dir).filter("model = 'first'").select("example_id", "y_true", holed.alias("y_pred"))


@register("valid_reply_pairs", f"{_REPLIES} select * from replies where y_pred in ('noise', 'important', 'error', 'security_noise')")
def _valid(spark, sf_dir):
    return M.valid_pairs(replies(spark, sf_dir))


@register(
    "excluded_replies",
    f"""{_REPLIES} select count(*) as replies, count(*) filter (where y_pred is null or y_pred = 'unknown') as excluded
     from replies""",
)
def _excluded(spark, sf_dir):
    return M.excluded_count(replies(spark, sf_dir))


@register(
    "latency",
    "select round_even(avg(value), 4) as mean_seconds, round_even(quantile_cont(value, 0.95), 4) as p95_seconds from events",
)
def _latency(spark, sf_dir):
    return M.latency_row(labeled(spark, sf_dir))


@register(
    "crossval_summary",
    f"""{DPAIRS.replace('from labeled', 'from labeled2').replace('pairs as', '''labeled2 as (select * from labeled), pairs as''')},
     f as (select model, (example_id % 5) as fold, y_true, y_pred from pairs),
     lab as (select model, fold, y_true as label from f union select model, fold, y_pred from f),
     c as (select model, fold, label, coalesce(2 * (select count(*) from f where f.model = lab.model and f.fold = lab.fold
        and y_true = label and y_pred = label) / nullif(
        (select count(*) from f where f.model = lab.model and f.fold = lab.fold and y_true = label)
        + (select count(*) from f where f.model = lab.model and f.fold = lab.fold and y_pred = label), 0), 0) as f1 from lab),
     m as (select model, fold, avg(f1) as macro_f1 from c group by all)
     select model, round_even(avg(macro_f1), 4) as mean, round_even(stddev_pop(macro_f1), 4) as std,
      round_even(avg(macro_f1) - 1.96 * stddev_pop(macro_f1), 4) as ci_low,
      round_even(avg(macro_f1) + 1.96 * stddev_pop(macro_f1), 4) as ci_high,
      string_agg(round_even(macro_f1, 4)::varchar, ',' order by fold) as folds from m group by model""",
)
def _crossval(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("fold", F.col("example_id") % 5)
    folds = M.metrics_rows(rows, ["model", "fold"], digits=None).select("model", "fold", "macro_f1")
    return M.crossval_summary(folds).withColumn("folds", F.array_join("folds", ","))


@register(
    "evaluation_details",
    f"""{DPAIRS} select 'example ' || example_id as template, y_true as true_label, y_pred as pred_label,
     round_even(confidence, 6) as confidence, seconds as inference_sec from pairs where model = 'first'""",
)
def _details(spark, sf_dir):
    rows = pairs(spark, sf_dir).filter("model = 'first'").select(
        F.concat(F.lit("example "), F.col("example_id")).alias("template"),
        "y_true", "y_pred", F.bround("confidence", 6).alias("confidence"), "seconds",
    )
    return M.detail_rows(rows)


@register(
    "confidence_stats",
    f"""with {_DUCK_LABELED} select round_even(100 * avg((confidence < 0.45)::int), 4) as ood_pct,
     round_even(avg(confidence), 4) as mean, round_even(stddev_pop(confidence), 4) as std from labeled""",
)
def _confidence(spark, sf_dir):
    return M.confidence_stats(labeled(spark, sf_dir))


@register(
    "confidence_histogram",
    f"""with {_DUCK_LABELED}, e as (select min(confidence) as lo, max(confidence) as hi from labeled)
     , b as (select least(floor((confidence - lo) * 40 / (hi - lo))::integer, 39) as bin, count(*) as n from labeled, e group by all)
     select range::integer as bin, coalesce(n, 0) as n from range(40) left join b on bin = range""",
)
def _histogram(spark, sf_dir):
    return M.confidence_histogram(labeled(spark, sf_dir))


# ------------------------------------------------------------ sessions

_TRACES = """traces as (select user_id, '[' || string_agg(event_type, ',' order by ts, event_id) || ']' as features,
  case when count(*) filter (where event_type = 'error') > 15 then ' Fail' else 'Success' end as outcome
  from events group by user_id)"""


SEGMENT = 10  # events: sessions of the test data then have several segments


def outcomes(spark, sf_dir):
    """One row per user session: its outcome."""
    failed = F.count_if(F.col("event_type") == "error") > 15
    return views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(failed, " Fail").otherwise("Success").alias("outcome"))


def segments(spark, sf_dir, size=SEGMENT):
    """The user sessions in rows of at most ``size`` events: user_id, segment, features."""
    events = views.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return SE.trace_segments(SE.positions(events, ["user_id"], tie="event_id"), ["user_id"], "event_type", size)


_SEGMENTS = """seg as (select user_id, cast((pos // 20) as integer) as segment,
   '[' || string_agg(event_type, ',' order by pos) || ']' as features from (
   select *, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events) group by all)"""


@register("session_segments", f"with {_SEGMENTS} select user_id, segment, features from seg")
def _segments(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    placed = SE.positions(events, ["user_id"], tie="event_id")
    return SE.trace_segments(placed, ["user_id"], "event_type", 20)


@register(
    "session_event_positions",
    "select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events",
)
def _positions(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return SE.positions(events, ["user_id"], tie="event_id").select("event_id", "user_id", "pos")


@register(
    "session_trace_events",
    f"""with {_TRACES} select user_id, len(string_split(trim(features, '[]'), ',')) as n,
     array_to_string(string_split(trim(features, '[]'), ','), '|') as events from traces""",
)
def _parsed(spark, sf_dir):
    parsed = segments(spark, sf_dir).withColumn("e", SE.parse_trace(F.col("features")))
    parts = parsed.select("user_id", "segment", F.size("e").cast("long").alias("n"), F.array_join("e", "|").alias("events"))
    return SG.whole_sessions(parts, ["user_id"], "events", "|", n=F.nullif(F.sum("n"), F.lit(0)))


_DICTIONARY = """dictionary as (select event_type as event_id, 'type ' || event_type || ' seen ' || count(*) as template
  from events where event_type <> 'view' group by event_type)"""


def dictionary(spark, sf_dir):
    counted = views.table(spark, sf_dir, "events").filter("event_type <> 'view'").groupBy("event_type").count()
    return counted.select(
        F.col("event_type").alias("event_id"),
        F.concat(F.lit("type "), F.col("event_type"), F.lit(" seen "), F.col("count")).alias("template"),
    )


_TEXTS = f"""with {_TRACES}, {_DICTIONARY} select user_id as trace_id,
   string_agg(coalesce(d.template, e.event_type), ' ' order by ts, e.event_id) as document
   from events e left join dictionary d on d.event_id = e.event_type group by user_id"""


def _segment_text(spark, sf_dir, **options):
    found = SG.segment_text(segments(spark, sf_dir), ["user_id"], dictionary(spark, sf_dir), **options)
    return found.select(F.col("user_id").alias("trace_id"), "segment", "document")


def _session_text(spark, sf_dir, **options):
    return SG.whole_sessions(_segment_text(spark, sf_dir, **options), ["trace_id"], "document", " ")


@register("session_text", _TEXTS)
def _text(spark, sf_dir):
    return _session_text(spark, sf_dir)


@register("session_text_joined", _TEXTS)
def _text_joined(spark, sf_dir):
    """The same through the salted join, as for a dictionary too large for a literal."""
    return _session_text(spark, sf_dir, max_literal=0)


# Whole sessions on the side of DuckDB: what the segments give must equal them.
_SESSION_TERMS = f"""{_DICTIONARY}, texts as (select user_id as trace_id,
   string_agg(coalesce(d.template, e.event_type), ' ' order by ts, e.event_id) as document
   from events e left join dictionary d on d.event_id = e.event_type group by user_id),
  words as (select trace_id, regexp_extract_all(lower(document), '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from texts),
  terms as (select trace_id, term, count(*) as tf from (
   select trace_id, unnest(w) as term from words
   union all select trace_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as term from words)
   group by all)"""


def session_terms(spark, sf_dir):
    return SG.session_terms(_segment_text(spark, sf_dir), ["trace_id"])


@register("session_terms", f"with {_SESSION_TERMS} select trace_id, term, tf from terms")
def _terms(spark, sf_dir):
    """Words and pairs of words of sessions, counted from segments of ten events."""
    return session_terms(spark, sf_dir)


@register(
    "session_tfidf",
    f"""with {_SESSION_TERMS}, n as (select count(*) as n from texts),
     vocab as (select term, ln((1 + any_value(n)) / (1 + count(*))) + 1 as idf from terms, n group by term having count(*) >= 2),
     raw as (select trace_id, term, (1 + ln(tf)) * idf as x from terms join vocab using (term))
     select trace_id, term, round_even(x / sqrt(sum(x * x) over (partition by trace_id)), 6) as w from raw""",
)
def _session_tfidf(spark, sf_dir):
    terms = materialize(session_terms(spark, sf_dir).withColumnRenamed("trace_id", "doc_id"), "session-terms")
    vocabulary = materialize(T.vocabulary_of(terms, terms.select("doc_id").distinct().count()), "vocabulary")
    rows = T.weigh(terms, vocabulary, sublinear=True)
    return rows.select(F.col("doc_id").alias("trace_id"), "term", F.bround("w", 6).alias("w"))


@register(
    "session_labels",
    f"""with {_TRACES} select user_id, case when user_id % 10 = 0 then 0 when trim(outcome) = 'Fail' then 1 else 0 end as label
     from traces""",
)
def _labels(spark, sf_dir):
    holed = F.when(F.col("user_id") % 10 != 0, F.col("outcome"))
    return outcomes(spark, sf_dir).select("user_id", SE.fail_label(holed).alias("label"))


@register(
    "session_class_share",
    f"""with {_TRACES}, l as (select case when trim(outcome) = 'Fail' then 1 else 0 end as label from traces)
     select label, count(*) as n, round_even(count(*) / sum(count(*)) over (), 4) as share from l group by label""",
)
def _share(spark, sf_dir):
    return M.class_share(outcomes(spark, sf_dir).select(SE.fail_label(F.col("outcome")).alias("label")))
