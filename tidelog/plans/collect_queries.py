"""Registered queries: sources, projections, filters, rewrites, tags."""

from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions import rewrites
from tidelog.functions.labeling import review_reason
from tidelog.functions.tagging import event_type_of, service_of
from tidelog.functions.text import cut, first_filled
from tidelog.operators import collect, selection, sketches
from tidelog.operators.label_templates import label_events
from tidelog.plans import oracle_text as Q
from tidelog.plans import views
from tidelog.plans.registry import register
from tidelog.session import materialize

# ------------------------------------------------------------ one query per rewrite rule


def _M():
    return F.col("message")


def _low():
    return F.lower("message")


def _register_rewrite(name, column, sql):
    @register(
        f"rewrite_{name}",
        f"with {Q.VARIED} select id, {sql} as text from logs",
    )
    def _query(spark, sf_dir):
        return views.varied_logs(spark, sf_dir).select("id", column().alias("text"))


_register_rewrite("hosts", lambda: rewrites.mask_hosts(_M(), views.HOST_PATTERN), Q.hosts("message"))
for _rule in V.DATASTORE_RULES:
    _register_rewrite(_rule[0], lambda r=_rule: rewrites.apply_rule(_M(), r), Q.rule_sub("message", _rule))
_register_rewrite("lower_case", _low, "lower(message)")
for _rule in V.FIELD_RULES:
    _register_rewrite(_rule[0], lambda r=_rule: rewrites.apply_rule(_low(), r), Q.rule_sub("lower(message)", _rule))
_register_rewrite("collapse_spaces", lambda: rewrites.collapse_spaces(_M()), Q.spaces("message"))
_register_rewrite(
    "placeholder_case",
    lambda: rewrites.repair_placeholders(rewrites.mask_fields(_low())),
    Q.placeholders(Q.fold("lower(message)", V.FIELD_RULES)),
)
_register_rewrite("template", lambda: rewrites.template_of(_M(), views.HOST_PATTERN), Q.template("message"))
for _rule in V.SECOND_PASS_RULES:
    _register_rewrite(_rule[0], lambda r=_rule: rewrites.apply_rule(_M(), r), Q.rule_sub("message", _rule))
_register_rewrite(
    "second_pass",
    lambda: rewrites.second_pass(rewrites.template_of(_M(), views.HOST_PATTERN)),
    Q.second(Q.template("message")),
)


@register(
    "rewrite_blank_template_to_null",
    f"with {Q.VARIED} select id, nullif(trim(case when id % 5 = 0 then '  ' else message end), '') as text from logs",
)
def _blank(spark, sf_dir):
    blanked = F.when(F.col("id") % 5 == 0, "  ").otherwise(_M())
    return views.varied_logs(spark, sf_dir).select(
        "id", rewrites.blank_to_null(rewrites.strip(blanked)).alias("text")
    )


@register("tag_service", f"with {Q.VARIED} select id, {Q.service('message')} as service from logs")
def _service(spark, sf_dir):
    return views.varied_logs(spark, sf_dir).select("id", service_of(_M()).alias("service"))


@register("tag_event_type", f"with {Q.VARIED} select id, {Q.event_type('message')} as event_type from logs")
def _event_type(spark, sf_dir):
    return views.varied_logs(spark, sf_dir).select("id", event_type_of(_M()).alias("event_type"))


# ------------------------------------------------------------ projection and filters

_TS_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def ts_text(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


@register(
    "normalize_events",
    f"""with {Q.VARIED} select cast(id as varchar) as id, {_TS_TEXT.format('ts')} as ts_text, platform,
     {Q.hosts('source')} as host, source, {Q.service('message')} as service,
     cast(id % 8 as integer) as severity, 'local' || (id % 4) as facility, message,
     {Q.template('message')} as template, {Q.event_type('message')} as event_type from logs""",
)
def _normalize(spark, sf_dir):
    """The 13-column event projection over envelopes built from every log row."""
    events = collect.normalize_events(envelopes(spark, sf_dir), views.HOST_PATTERN)
    return events.select(
        "id", ts_text(F.to_utc_timestamp("timestamp", F.current_timezone())).alias("ts_text"),
        "platform", "host", "source", "service",
        "severity", "facility", "message", "template", "event_type",
    )


def envelopes(spark, sf_dir):
    """Log rows in the vendor's nesting; two rows in three carry their id further out."""
    text_id = F.col("id").cast("string")
    inner = F.struct(
        F.when(F.col("id") % 3 == 0, text_id).otherwise("").alias("gl2_message_id"),
        F.when(F.col("id") % 3 == 1, text_id).alias("_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col("source"),
        F.col("message"),
        (F.col("id") % 8).cast("int").alias("level"),
        F.concat(F.lit("local"), F.col("id") % 4).alias("facility"),
    )
    return views.varied_logs(spark, sf_dir).select(
        text_id.alias("_id"), inner.alias("message"), "platform"
    )


@register(
    "message_id_fallback",
    """select event_id, coalesce(nullif(case when event_id % 3 = 0 then 'g' || event_id else '' end, ''),
       nullif(case when event_id % 2 = 0 then 'i' || event_id else '' end, ''),
       case when event_id % 5 <> 0 then 'o' || event_id end) as id from events""",
)
def _id_fallback(spark, sf_dir):
    e = F.col("event_id")
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        first_filled(
            F.when(e % 3 == 0, F.concat(F.lit("g"), e)).otherwise(""),
            F.when(e % 2 == 0, F.concat(F.lit("i"), e)).otherwise(""),
            F.when(e % 5 != 0, F.concat(F.lit("o"), e)),
        ).alias("id"),
    )


_P = f"with {Q.PREDICTIONS}, n as (select max(ts) as now from predictions) "
_SHOWN = "id, predicted_label, risk_score"


@register(
    "incident_filter",
    f"{_P} select {_SHOWN} from predictions where predicted_label in ('error', 'anomaly')",
)
def _incidents(spark, sf_dir):
    return selection.incidents(views.predictions(spark, sf_dir)).select("id", "predicted_label", "risk_score")


def _over_predictions(name, where, operator):
    @register(name, f"{_P} select {_SHOWN} from predictions, n where {where}")
    def _query(spark, sf_dir):
        p = views.predictions(spark, sf_dir)
        return operator(p, views.now_of(p)).select("id", "predicted_label", "risk_score")


_over_predictions(
    "ingested_last_15_minutes",
    "run_ts >= now - interval '15 minutes'",
    lambda p, now: selection.ingested_since(p, now, 15),
)
_over_predictions(
    "ingested_last_12_hours",
    "run_ts >= now - interval '12 hours'",
    lambda p, now: selection.ingested_since(p, now, 12 * 60),
)
_over_predictions(
    "occurred_last_12_hours",
    "ts >= date_trunc('second', now - interval '12 hours')",
    lambda p, now: selection.occurred_since(p, now, 12),
)
_over_predictions(
    "latest_batch",
    "run_ts = (select max(run_ts) from predictions)",
    lambda p, now: selection.latest_batch(p),
)
_over_predictions(
    "recent_else_latest_batch",
    """run_ts >= (now + interval '2 days') - interval '15 minutes' or (not exists (
       select 1 from predictions x where x.run_ts >= (now + interval '2 days') - interval '15 minutes')
       and run_ts = (select max(run_ts) from predictions))""",
    lambda p, now: selection.recent_or_latest(p, now + F.make_dt_interval(days=F.lit(2))),
)
_over_predictions(
    "recent_batches",
    "run_ts >= now - interval '90 minutes'",
    lambda p, now: selection.recent_or_latest(p, now, 90),
)
_over_predictions(
    "anomalies_lookback",
    "predicted_label in ('error', 'anomaly') and run_ts >= now - interval '48 hours'",
    lambda p, now: selection.anomalies(p, now, 48),
)

_CUTS = [60, 80, 100, 120, 150, 200, 300, 512]


@register(
    "display_cuts",
    "select doc_id, " + ", ".join(f"substring(text, 1, {n}) as first_{n}" for n in _CUTS) + " from documents",
)
def _cuts(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", *[cut(F.col("text"), n).alias(f"first_{n}") for n in _CUTS]
    )


@register(
    "missing_value_defaults",
    f"""with {Q.PREDICTIONS} select id,
     coalesce(case when id % 4 <> 0 then source end, case when id % 8 <> 0 then platform end, 'unknown') as shown_source,
     coalesce(case when id % 3 <> 0 then risk_score end, 0) as shown_risk,
     coalesce(nullif(case id % 3 when 0 then predicted_label when 1 then '' end, ''),
       nullif(case id % 5 when 0 then 'noise' when 1 then '' end, ''), 'unknown') as shown_label
     from predictions""",
)
def _defaults(spark, sf_dir):
    n = F.col("id")
    holed = views.predictions(spark, sf_dir).select(
        "id",
        F.when(n % 4 != 0, F.col("source")).alias("source"),
        F.when(n % 8 != 0, F.col("platform")).alias("host"),
        F.when(n % 3 != 0, F.col("risk_score")).alias("risk_score"),
        F.when(n % 3 == 0, F.col("predicted_label")).when(n % 3 == 1, "").alias("predicted_label"),
        F.when(n % 5 == 0, "noise").when(n % 5 == 1, "").alias("label"),
    )
    return selection.with_defaults(holed)


# ------------------------------------------------------------ search and duplicates


@register(
    "source_search",
    f"""with {Q.LOGS}, n as (select max(ts) as now from logs)
     select id, {_TS_TEXT.format('ts')} as ts_text, source, message from logs, n
     where platform = 'esxi' and ts >= now - interval '10800 seconds' and ts <= now
     order by ts desc, id limit 10000""",
)
def _search(spark, sf_dir):
    logs = views.logs(spark, sf_dir)
    hits = collect.search(
        logs, F.col("platform") == "esxi", views.now_of(logs), 10_800, 10_000, ["id", "ts", "source", "message"]
    )
    return hits.select("id", ts_text("ts").alias("ts_text"), "source", "message")


_REDELIVERED = f"""{Q.LOGS}, n as (select max(ts) as now from logs), pulled as (
  select id, ts, platform, {Q.RUN_TS} as run_ts from logs
  union all select id, ts, platform, {Q.RUN_TS} + interval '15 minutes' from logs, n
   where ts >= now - interval '12 hours'
  union all select id, ts, platform, {Q.RUN_TS} from logs, n where ts >= now - interval '12 hours')"""


def redelivered(spark, sf_dir):
    """Every log row, and those of the last 12 hours again in their own and in the next run."""
    logs = views.logs(spark, sf_dir).select(
        "id", "ts", "platform", F.expr(views.RUN_TS).alias("run_ts")
    )
    tail = selection.ingested_since(logs, views.now_of(logs), 12 * 60, run_ts="ts")
    later = tail.withColumn("run_ts", F.col("run_ts") + F.make_dt_interval(mins=F.lit(15)))
    return logs.unionByName(later).unionByName(tail)


def _first_seen():
    return [F.asc("run_ts"), F.asc("platform"), F.desc("ts")]



@register(
    "dedupe_across_runs",
    f"""with {_REDELIVERED} select id, platform, {_TS_TEXT.format('run_ts')} as run_ts from pulled
     qualify row_number() over (partition by id order by run_ts, platform, ts desc) = 1""",
)
def _dedupe(spark, sf_dir):
    kept = collect.first_by_id(redelivered(spark, sf_dir), ["id"], _first_seen())
    return kept.select("id", "platform", ts_text("run_ts").alias("run_ts"))


@register(
    "dedupe_within_run",
    f"""with {_REDELIVERED} select id, platform, {_TS_TEXT.format('run_ts')} as run_ts from pulled
     qualify row_number() over (partition by run_ts, id order by platform, ts desc) = 1""",
)
def _dedupe_run(spark, sf_dir):
    kept = collect.first_by_id(redelivered(spark, sf_dir), ["run_ts", "id"], _first_seen())
    return kept.select("id", "platform", ts_text("run_ts").alias("run_ts"))


_NULL_IDS = "select case when event_id % 7 <> 0 then event_id end as id, event_id % 3 as platform, ts, event_id from events"


@register(
    "dedupe_null_ids_as_one",
    f"""select id, platform, event_id from ({_NULL_IDS})
     qualify row_number() over (partition by id order by platform, ts desc, event_id) = 1""",
)
def _dedupe_null(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").selectExpr(
        "case when event_id % 7 <> 0 then event_id end as id", "event_id % 3 as platform", "ts", "event_id"
    )
    order = [F.asc("platform"), F.desc("ts"), F.asc("event_id")]
    return collect.first_by_id(rows, ["id"], order, keep_null_ids=False).select("id", "platform", "event_id")


@register(
    "collection_stats",
    f"""with {_REDELIVERED}, kept as (select * from pulled
      qualify row_number() over (partition by id order by run_ts, platform, ts desc) = 1)
     select platform, count(*) as collected,
      (select count(*) from kept k where k.platform = p.platform) as "unique" from pulled p group by platform""",
)
def _stats(spark, sf_dir):
    pulled = redelivered(spark, sf_dir)
    return collect.collection_stats(pulled, collect.first_by_id(pulled, ["id"], _first_seen()))


_RANGES = f"""with {Q.LOGS}, n as (select max(ts) as now from logs), pulled as (
  select id, ts, platform, value, {Q.RUN_TS} as run_ts from logs
  union all select id, ts, platform, value, {Q.RUN_TS} + interval '15 minutes' from logs, n where ts >= now - interval '12 hours'),
 hours as (select i, date_trunc('day', now) - to_days(i::integer) as start, date_trunc('day', now) + to_days((2 - i)::integer) as "end"
  from n, range(8) t(i)),
 asked as (select h.start, platform, id, value from pulled join hours h on run_ts >= h.start and run_ts < h."end")"""


def stored_sketches(spark, sf_dir):
    """Sketches of every run and platform of pulls that overlap, written once and read again."""
    logs = views.logs(spark, sf_dir).select("id", "ts", "platform", "value", F.expr(views.RUN_TS).alias("run_ts"))
    tail = selection.ingested_since(logs, views.now_of(logs), 12 * 60, run_ts="ts")
    pulled = logs.unionByName(tail.withColumn("run_ts", F.col("run_ts") + F.make_dt_interval(mins=F.lit(15))))
    return pulled, materialize(sketches.run_sketches(pulled, ["run_ts", "platform"], "id", "value"), "run-sketches")


def two_days(pulled):
    """Eight spans of two days, each a day before the other, so that a run is in two of them."""
    now = pulled.sparkSession.range(8).withColumn("now", F.lit(views.now_of(pulled, "ts")))
    day = F.date_trunc("day", "now")
    return now.select((day - F.make_dt_interval(F.col("id"))).alias("start"), (day + F.make_dt_interval(2 - F.col("id"))).alias("end"))


@register(
    "unique_ids_over_runs",
    f"""{_RANGES} select start, platform, count(*) as collected, count(distinct id) as "unique", true as close from asked group by all""",
)
def _unique_over_runs(spark, sf_dir):
    """Unique ids of overlapping spans of runs by stored sketches, held against exact counts: within 4 % (five standard errors)."""
    pulled, kept = stored_sketches(spark, sf_dir)
    spans = two_days(pulled)
    found = sketches.over_ranges(kept, spans, ["platform"]).select("start", "platform", F.col("n").alias("collected"), sketches.distinct_ids().alias("about"))
    inside = (F.col("run_ts") >= F.col("start")) & (F.col("run_ts") < F.col("end"))
    exact = pulled.join(F.broadcast(spans), inside).groupBy("start", "platform").agg(F.count_distinct("id").alias("unique"))
    close = F.abs(F.col("about") - F.col("unique")) <= 0.04 * F.col("unique")
    return found.join(exact, ["start", "platform"]).select("start", "platform", "collected", "unique", close.alias("close"))


@register(
    "value_quantiles_over_runs",
    f"""{_RANGES}, s as (select distinct start, platform from asked) select start, platform, q, true as close
     from s, (select unnest([0.5, 0.95]::double[]) as q)""",
)
def _quantiles_over_runs(spark, sf_dir):
    """Median and 95th percentile of spans by stored sketches: the share of values below them is within one per cent."""
    pulled, kept = stored_sketches(spark, sf_dir)
    spans = two_days(pulled)
    found = sketches.over_ranges(kept, spans, ["platform"]).select(
        "start", "end", "platform", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), sketches.quantile(q).alias("v")) for q in (0.5, 0.95)])).alias("f")
    )
    inside = (F.col("run_ts") >= F.col("start")) & (F.col("run_ts") < F.col("end"))
    held = pulled.withColumnRenamed("platform", "of").join(F.broadcast(found), inside & (F.col("of") == F.col("platform")))
    # Of values that are equal to the quantile, the rank may lie anywhere among them.
    sums = held.groupBy("start", "platform", "f.q").agg(
        F.count("value").alias("n"), F.count_if(F.col("value") < F.col("f.v")).alias("less"), F.count_if(F.col("value") <= F.col("f.v")).alias("upto")
    )
    error = F.greatest(F.col("less") / F.col("n") - F.col("q"), F.col("q") - F.col("upto") / F.col("n"))
    # A sketch holds whole values: of n of them, a rank is met to 1 / n at best.
    return sums.select("start", "platform", "q", (error <= 0.01 + 1 / F.col("n")).alias("close"))


# ------------------------------------------------------------ rule labels per event


@register(
    "weak_labels",
    f"with {Q.TAGGED} select id, template, label from tagged",
)
def _labels(spark, sf_dir):
    return tagged(spark, sf_dir).select("id", "template", "label")


@register(
    "review_reasons",
    f"with {Q.TAGGED} select id, {Q.reason('template', 'event_type', 'service')} as reason from tagged",
)
def _reasons(spark, sf_dir):
    return tagged(spark, sf_dir).select(
        "id", review_reason(F.col("template"), F.col("event_type"), F.col("service")).alias("reason")
    )


def tagged_events(spark, sf_dir):
    """Varied log rows with collected template, service and event type."""
    return views.varied_logs(spark, sf_dir).select(
        "id", "ts", "platform",
        rewrites.template_of(_M(), views.HOST_PATTERN).alias("template"),
        service_of(_M()).alias("service"),
        event_type_of(_M()).alias("event_type"),
    )


def tagged(spark, sf_dir):
    """tagged_events with the second pass and the rule label."""
    return label_events(tagged_events(spark, sf_dir))
