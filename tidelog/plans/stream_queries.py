"""Registered queries: sources, sinks and streams driven to the end of the given tables."""

from pyspark.sql import functions as F

from tidelog.functions.rewrites import second_pass, template_of
from tidelog.functions.scoring import risk_score
from tidelog.functions.tagging import service_of
from tidelog.operators import complement_bayes as CB
from tidelog.operators import terms as T
from tidelog.plans import oracle_text as Q
from tidelog.plans import views
from tidelog.plans.label_queries import TEMPLATES, templates
from tidelog.plans.registry import register
from tidelog.session import fresh_path, materialize
from tidelog.sources import events as E
from tidelog.sources import labels as LA
from tidelog.sources import sinks
from tidelog.streaming import ingest, panes, windows
from tidelog.streaming.context import context_stream, lists_in_state, start_context

_NAMES = """names as (select event_id, case event_id % 5
   when 0 then 'events_' || strftime(ts, '%Y%m%dT%H%M%SZ') || '.jsonl' when 1 then 'events_latest.jsonl'
   when 2 then 'events_' || strftime(ts, '%Y%m%d') || '.jsonl' when 3 then 'predictions_' || strftime(ts, '%Y%m%dT%H%M%SZ') || '.jsonl'
   else 'events_20249999T000000Z.jsonl' end as name from events)"""


@register(
    "run_time_from_file_name",
    f"""with {_NAMES} select event_id, strftime(strptime(regexp_extract(name, '([0-9]{{8}}T[0-9]{{6}}Z)', 1), '%Y%m%dT%H%M%SZ'),
      '%Y-%m-%d %H:%M:%S') as run_ts from names where event_id % 5 = 0""",
)
def _run_time(spark, sf_dir):
    """Names that do not parse drop out, as do files of another kind."""
    stamp = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    n = F.col("event_id") % 5
    name = (
        F.when(n == 0, F.concat(F.lit("events_"), stamp, F.lit(".jsonl")))
        .when(n == 1, "events_latest.jsonl")
        .when(n == 2, F.concat(F.lit("events_"), F.date_format("ts", "yyyyMMdd"), F.lit(".jsonl")))
        .when(n == 3, F.concat(F.lit("predictions_"), stamp, F.lit(".jsonl")))
        .otherwise("events_20249999T000000Z.jsonl")
    )
    named = views.table(spark, sf_dir, "events").select("event_id", E.run_time(name, "events").alias("r"))
    return named.filter("r is not null").select("event_id", F.date_format("r", "yyyy-MM-dd HH:mm:ss").alias("run_ts"))


@register(
    "pending_runs",
    f"""with {Q.LOGS}, e as (select id, {Q.RUN_TS} as run_ts from logs) select id from e
     where run_ts not in (select run_ts from e where id % 3 = 0)""",
)
def _pending(spark, sf_dir):
    rows = views.logs(spark, sf_dir).select("id", F.expr(views.RUN_TS).alias("run_ts"))
    return sinks.pending_runs(rows, rows.filter("id % 3 = 0")).select("id")


_DIRTY = """with d as (select event_id, case event_id % 4 when 0 then '  ' || props || ' ' when 1 then null
    when 2 then '   ' else props end as template, case event_id % 3 when 0 then ' error ' when 1 then event_type
    else null end as label from events)"""


@register(
    "clean_labels",
    f"""{_DIRTY} select event_id, trim(template) as template, trim(label) as label from d
     where coalesce(trim(template), '') <> '' and trim(label) in ('noise', 'important', 'error', 'security_noise')""",
)
def _clean(spark, sf_dir):
    n = F.col("event_id")
    template = (
        F.when(n % 4 == 0, F.concat(F.lit("  "), "props", F.lit(" "))).when(n % 4 == 1, F.lit(None))
        .when(n % 4 == 2, "   ").otherwise(F.col("props"))
    )
    label = F.when(n % 3 == 0, " error ").when(n % 3 == 1, F.col("event_type"))
    rows = views.table(spark, sf_dir, "events").select("event_id", template.alias("template"), label.alias("label"))
    return LA.clean_labels(rows)


@register("labels_csv_round_trip", f"with {TEMPLATES} select * from templates")
def _csv(spark, sf_dir):
    """The labeled template table written as CSV and read back."""
    path = fresh_path(spark, "labels-csv")
    sinks.write_labels(templates(spark, sf_dir), path)
    return LA.read_labels(spark, path)


@register(
    "event_files_round_trip",
    f"""with {Q.LOGS} select cast(id as varchar) as id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts_text, platform, message,
     strftime({Q.RUN_TS}, '%Y-%m-%d') as day from logs""",
)
def _files(spark, sf_dir):
    """Events written by day and read back with a declared schema."""
    rows = views.logs(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), "platform", "message",
        F.date_format(F.expr(views.RUN_TS), "yyyy-MM-dd").alias("run_ts"),
    )
    path = fresh_path(spark, "events")
    sinks.write_runs(rows, path)
    back = spark.read.parquet(path)
    return back.select(
        "id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), "platform", "message",
        F.col("run_ts").cast("string").alias("day"),
    )


# ------------------------------------------------------------ streams


def _event_stream(spark, sf_dir):
    """The events file as a stream of predictions; time is a TIMESTAMP, as watermarks need."""
    schema = views.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    columns = views._text(views.LOG_COLUMNS, "string")
    label = F.expr(views.PREDICTED_LABEL.format(type="event_type_raw", id="id"))
    return raw.selectExpr(*columns).select(
        "id", F.col("ts").cast("timestamp").alias("ts"), "platform", "source", "message",
        service_of(F.col("message")).alias("service"), label.alias("predicted_label"),
    )


def _closed(spark, rows, name):
    path = fresh_path(spark, name)
    query = windows.start_table(rows, f"{path}/table", f"{path}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{path}/table")


_CLOSED = "ts_end <= (select max(ts) from logs) - interval '3 hours'"


@register(
    "stream_summary_windows",
    f"""with {Q.LOGS}, p as (select *, time_bucket(interval '12 hours', ts) as w, time_bucket(interval '12 hours', ts) + interval '12 hours' as ts_end,
      {views.PREDICTED_LABEL.format(type='event_type_raw', id='id')} as predicted_label from logs)
     select strftime(w, '%Y-%m-%d %H:%M:%S') as w, dimension, key, count(*) as n from (
      select w, unnest(['total', 'label', 'platform']) as dimension, unnest(['', predicted_label, platform]) as key
      from p where {_CLOSED}) group by all""",
)
def _summary(spark, sf_dir):
    """12-hour windows of the stream that the watermark has closed."""
    rows = _closed(spark, windows.summary_windows(_event_stream(spark, sf_dir)), "stream-summary")
    return rows.withColumn("w", F.date_format("w", "yyyy-MM-dd HH:mm:ss"))


@register(
    "stream_severity_windows",
    f"""with {Q.LOGS}, p as (select *, time_bucket(interval '15 minutes', ts) as w, time_bucket(interval '15 minutes', ts) + interval '15 minutes' as ts_end,
      {views.PREDICTED_LABEL.format(type='event_type_raw', id='id')} as predicted_label from logs)
     select strftime(w, '%Y-%m-%d %H:%M:%S') as w, count(*) as n,
      count(*) filter (where predicted_label = 'anomaly') > 0 as urgent,
      case when count(*) filter (where predicted_label = 'anomaly') > 0 then 'P1' else 'P3' end as severity,
      'rule-based: ' || count(*) || ' anomalies' as reason
     from p where predicted_label in ('error', 'anomaly') and {_CLOSED} group by w""",
)
def _severity(spark, sf_dir):
    rows = _closed(spark, windows.severity_windows(_event_stream(spark, sf_dir)), "stream-severity")
    return rows.withColumn("w", F.date_format("w", "yyyy-MM-dd HH:mm:ss"))


@register("stream_dedupe", f"with {Q.LOGS} select id, platform from logs")
def _dedupe(spark, sf_dir):
    """Every event delivered twice; the state operator keeps one row per id."""
    stream = _event_stream(spark, sf_dir).select("id", F.col("ts").alias("timestamp"), "platform")
    doubled = stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    once = ingest.dedupe_stream(doubled.withColumn("id", F.col("id").cast("string")))
    return _closed(spark, once, "stream-dedupe").select(F.col("id").cast("long").alias("id"), "platform")


def _score(batch):
    templated = batch.withColumn("template", template_of(F.col("message"), views.HOST_PATTERN))
    return templated.withColumn("risk_score", risk_score(F.col("predicted_label")))


@register(
    "stream_scored_events",
    f"""with {Q.LOGS} select id, template, predicted_label, {Q.risk('predicted_label')} as risk_score from (
      select id, {Q.template('message')} as template,
       {views.PREDICTED_LABEL.format(type='event_type_raw', id='id')} as predicted_label from logs)""",
)
def _scored(spark, sf_dir):
    """Collect, score and alert per micro-batch; the label rule of the view stands in for a model."""
    stream = _event_stream(spark, sf_dir).withColumnRenamed("ts", "timestamp")
    doubled = stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = fresh_path(spark, "stream-scored")
    ingest.start_scoring(doubled, _score, out, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/predictions").select("id", "template", "predicted_label", "risk_score")


@register(
    "stream_alerts",
    f"""with {Q.LOGS}, p as (select id, {views.PREDICTED_LABEL.format(type='event_type_raw', id='id')} as predicted_label from logs)
     select count(*) as n_scored, count(distinct id) as n_ids,
      count(*) filter (where predicted_label in ('error', 'anomaly')) as n_alerted from p""",
)
def _alerts(spark, sf_dir):
    """Four overlapping pulls, some rows without a time: each id is scored once and each incident is in one alert."""
    rows = _event_table(spark, sf_dir).withColumn("timestamp", F.when(F.col("id") % 7 != 0, F.col("timestamp")))
    pulls = rows.withColumn("pull", F.explode(F.array((F.col("id") % 4).cast("int"), ((F.col("id") + 1) % 4).cast("int"))))
    out = fresh_path(spark, "stream-alerts")
    pulls.repartition("pull").write.partitionBy("pull").parquet(f"{out}/pulls")
    schema = spark.read.parquet(f"{out}/pulls").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/pulls").drop("pull")
    ingest.start_scoring(stream, _score, out, f"{out}/checkpoint").awaitTermination()
    scored = spark.read.parquet(f"{out}/predictions").agg(F.count("*").alias("n_scored"), F.countDistinct("id").alias("n_ids"))
    alerted = spark.read.parquet(f"{out}/alerts").agg(F.sum("n").alias("n_alerted"))
    return scored.crossJoin(alerted)  # one row each


_MODEL_CLASSES = ["error", "important", "noise", "security_noise"]
_IN_CLASSES = ", ".join(f"'{c}'" for c in _MODEL_CLASSES)


def _terms_sql(name, rows):
    return f"""{name}_words as (select template, regexp_extract_all(lower(template), '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from {rows}),
 {name} as (select template, term, count(*) as tf from (
  select template, unnest(w) as term from {name}_words
  union all select template, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as term from {name}_words)
  group by all)"""


def _per_class(form, between=", "):
    return between.join(form.format(i=i, c=c) for i, c in enumerate(_MODEL_CLASSES))


@register(
    "stream_model_scores",
    f"""with {TEMPLATES}, trained as (select template, label from templates where label in ({_IN_CLASSES})),
 {_terms_sql('seen', 'trained')},
 vocab as (select term, ln((1 + (select count(*) from trained)) / (1 + count(*))) + 1 as idf from seen group by term having count(*) >= 2),
 seen_raw as (select template, seen.term, tf * idf as x from seen join vocab using (term)),
 seen_w as (select template, term, x / sqrt(sum(x * x) over (partition by template)) as w from seen_raw),
 fc as (select v.term, coalesce(sum(w), 0) as a, {_per_class("coalesce(sum(w) filter (where label = '{c}'), 0) as c{i}")}
  from vocab v left join (seen_w join trained using (template)) x on x.term = v.term group by v.term),
 model as (select term, {_per_class("-ln((a - c{i} + 1) / sum(a - c{i} + 1) over ()) as w{i}")} from fc),
 plain as (select {Q._view(views.LOG_COLUMNS)} from events),
 asked as (select id, {Q.second(Q.template('message'))} as template from plain),
 kinds as (select distinct template from asked where template is not null),
 {_terms_sql('found', 'kinds')},
 found_raw as (select template, found.term, tf * idf as x from found join vocab using (term)),
 found_w as (select template, term, x / sqrt(sum(x * x) over (partition by template)) as w from found_raw),
 sums as (select template, {_per_class("sum(w * w{i}) as s{i}")} from found_w join model using (term) group by template),
 filled as (select k.template, {_per_class("coalesce(s{i}, 0) as s{i}")} from kinds k left join sums using (template)),
 topped as (select *, greatest({_per_class("s{i}")}) as top from filled),
 called as (select template, case {_per_class("when s{i} = top then '{c}'", " ")} end as best, 1 / ({_per_class("exp(s{i} - top)", " + ")}) as conf from topped),
 final as (select template, case when conf < 0.8 then 'anomaly' else best end as predicted_label, round_even(conf, 3) as confidence from called)
 select id, predicted_label, confidence, {Q.risk('predicted_label')} as risk_score from asked left join final using (template)""",
)
def _model_scores(spark, sf_dir):
    """Overlapping pulls scored by a Bayes model fitted on the labeled templates before the stream starts."""
    trained = templates(spark, sf_dir).filter(F.col("label").isin(_MODEL_CLASSES)).select(F.col("template").alias("doc_id"), F.col("template").alias("text"), "label")
    trained = materialize(trained, "trained")  # the fit reads it seven times
    vocabulary = T.fit_vocabulary(trained.select("doc_id", "text"))
    model = CB.fit(T.tfidf(trained.select("doc_id", "text"), vocabulary), trained, vocabulary, _MODEL_CLASSES)

    def score(batch):
        templated = batch.withColumn("template", second_pass(template_of(F.col("message"), views.HOST_PATTERN)))
        # Stored: scoring counts the templates, asks which are null and joins them back, and would rewrite each message anew.
        templated = materialize(templated, "templated")
        return CB.score_events(templated, vocabulary, model, _MODEL_CLASSES, threshold=0.8)

    rows = _event_table(spark, sf_dir).drop("predicted_label")
    pulls = rows.withColumn("pull", F.explode(F.array((F.col("id") % 3).cast("int"), ((F.col("id") + 1) % 3).cast("int"))))
    out = fresh_path(spark, "stream-model")
    pulls.repartition("pull").write.partitionBy("pull").parquet(f"{out}/pulls")
    schema = spark.read.parquet(f"{out}/pulls").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/pulls").drop("pull")
    ingest.start_scoring(stream, score, out, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/predictions").select("id", "predicted_label", "confidence", "risk_score")


def _event_table(spark, sf_dir):
    """What ``_event_stream`` streams, as a table."""
    label = F.expr(views.PREDICTED_LABEL.format(type="event_type_raw", id="id"))
    rows = views.table(spark, sf_dir, "events").selectExpr(*views._text(views.LOG_COLUMNS, "string"))
    return rows.select(
        "id", F.col("ts").cast("timestamp").alias("timestamp"), "platform", "source", "message",
        service_of(F.col("message")).alias("service"), label.alias("predicted_label"),
    )


@register(
    "stream_context",
    f"""with {Q.LOGS}, c as (select id, list(message) over (
       partition by source order by ts, id rows between 5 preceding and 1 preceding) as ctx from logs)
     select id, coalesce(array_to_string(ctx, chr(10)), '') as context from c""",
)
def _context(spark, sf_dir):
    """The five messages that the same source logged before, kept as state of the stream."""
    stream = _event_stream(spark, sf_dir).select("id", "ts", "source", "message")
    with lists_in_state(spark):
        rows = _closed(spark, context_stream(stream, "source", "message"), "stream-context")
    return rows.select("id", F.array_join("context", "\n").alias("context"))


_HOT = "case when {id} % 3 = 0 then 'node-hot' else source end"


@register(
    "stream_context_batches",
    f"""with {Q.LOGS}, c as (select id, ts, list(message) over (
       partition by {_HOT.format(id='id')} order by ts, id rows between 5 preceding and 1 preceding) as ctx from logs)
     select id, (day(ts) - 1) // 5 as batch_id, coalesce(array_to_string(ctx, chr(10)), '') as context from c""",
)
def _context_batches(spark, sf_dir):
    """The same over pulls of five days each; one source holds a third of all rows."""
    rows = _event_table(spark, sf_dir).select("id", F.col("timestamp").alias("ts"), F.expr(_HOT.format(id="id")).alias("source"), "message")
    rows = rows.withColumn("pull", F.expr("(day(ts) - 1) div 5"))
    out = fresh_path(spark, "stream-context")
    schema = rows.drop("pull").schema
    for pull in range(7):  # a month has at most 31 days
        rows.filter(F.col("pull") == pull).drop("pull").write.mode("append").parquet(f"{out}/landed")
        stream = spark.readStream.schema(schema).parquet(f"{out}/landed")
        start_context(stream, out, f"{out}/checkpoint", ["source"], "message", keep_hours=24 * 40).awaitTermination()
    found = spark.read.parquet(f"{out}/rows")
    return found.select("id", F.col("batch_id").cast("long").alias("batch_id"), F.array_join("context", "\n").alias("context"))


# ------------------------------------------------------------ pulls that deliver late rows

PULLS = 6
# The pull that delivers a row: five days each; a tenth of the rows comes one to three pulls late.
_PULL = "least(case when id % 10 = 0 then (day(ts) - 1) {div} 5 + 1 + id % 3 else (day(ts) - 1) {div} 5 end, 5)"
_SPLIT = f"""{Q.LOGS}, pulled as (select id, case when id % 97 <> 0 then ts end as t, platform, {_PULL.format(div='//')} as pull,
   {views.PREDICTED_LABEL.format(type='event_type_raw', id='id')} as predicted_label from logs),
  marks as (select pull, max(max(t)) over (order by pull) - interval '3 hours' as mark from pulled group by pull),
  split as (select p.*, time_bucket(interval '15 minutes', t) as pane, case when t is null then 'untimed'
    when time_bucket(interval '15 minutes', t) + interval '15 minutes' <= m.mark then 'late' end as reason
   from pulled p left join marks m on m.pull = p.pull - 1)"""


def _pulled(spark, sf_dir):
    """The events in six pulls, each a run of the stream over what has landed by then; where its tables lie."""
    rows = _event_table(spark, sf_dir).withColumnRenamed("timestamp", "ts").withColumn("pull", F.expr(_PULL.format(div="div")))
    rows = rows.withColumn("ts", F.when(F.col("id") % 97 != 0, F.col("ts")))
    out = fresh_path(spark, "stream-panes")
    schema = rows.drop("pull").schema
    for pull in range(PULLS):
        rows.filter(F.col("pull") == pull).drop("pull").write.mode("append").parquet(f"{out}/landed")
        stream = spark.readStream.schema(schema).parquet(f"{out}/landed")
        panes.start_panes(stream, out, f"{out}/checkpoint").awaitTermination()
    return out


@register("stream_late_rows", f"with {_SPLIT} select id, pull as batch_id, reason from split where reason is not null")
def _late(spark, sf_dir):
    """Rows that came after their pane was closed, or without a time, with the batch that brought them."""
    rows = spark.read.parquet(f"{_pulled(spark, sf_dir)}/late")
    return rows.select("id", F.col("batch_id").cast("long").alias("batch_id"), "reason")


@register(
    "stream_sliding_windows",
    f"""with {_SPLIT}, slots as (select predicted_label, platform, pane - to_minutes(15 * unnest(range(0, 48))::bigint) as w0
       from split where reason is null)
     select strftime(w0, '%Y-%m-%d %H:%M:%S') as w, dimension, key, count(*) as n from (
      select w0, unnest(['total', 'label', 'platform']) as dimension, unnest(['', predicted_label, platform]) as key
      from slots where w0 + interval '12 hours' <= (select max(mark) from marks)) group by all""",
)
def _sliding(spark, sf_dir):
    """12-hour windows every 15 minutes, each written once, when it closes."""
    rows = spark.read.parquet(f"{_pulled(spark, sf_dir)}/windows")
    return rows.select(F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("w"), "dimension", "key", "n")
