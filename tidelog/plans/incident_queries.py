"""Registered queries: incidents, alerts, reports, windows."""

from pyspark.sql import functions as F

from tidelog.operators import incidents as I
from tidelog.operators import reports as R
from tidelog.operators import selection
from tidelog.plans import oracle_text as Q
from tidelog.plans import views
from tidelog.plans.registry import register
from tidelog.session import fresh_path
from tidelog.sources import sinks

_INC = f"""with {Q.PREDICTIONS}, n as (select max(ts) as now from predictions),
 inc as (select * from predictions where predicted_label in ('error', 'anomaly'))"""
_LAST = """last as (select * from inc qualify row_number() over (partition by template order by run_ts desc, ts desc, id desc) = 1)"""


def _incidents(spark, sf_dir):
    return selection.incidents(views.predictions(spark, sf_dir))


@register("last_incident_per_template", f"{_INC}, {_LAST} select template, id, source, risk_score from last")
def _last(spark, sf_dir):
    return I.last_per_template(_incidents(spark, sf_dir)).select("template", "id", "source", "risk_score")


@register(
    "top_incidents_by_risk",
    f"{_INC}, {_LAST} select template, source, risk_score from last order by risk_score desc, template limit 3",
)
def _top3(spark, sf_dir):
    unique = I.last_per_template(_incidents(spark, sf_dir))
    return I.top_by_risk(unique, 3).select("template", "source", "risk_score")


@register(
    "top_incident_of_latest_batch",
    f"""{_INC} select id, template, risk_score from inc where run_ts = (select max(run_ts) from inc)
     order by risk_score desc, ts, id limit 1""",
)
def _top1(spark, sf_dir):
    latest = selection.latest_batch(_incidents(spark, sf_dir))
    return I.top_by_risk(latest, 1, ["ts", "id"]).select("id", "template", "risk_score")


_WIN = """win as (select *, time_bucket(interval '15 minutes', ts) as w from inc)"""
_W_TEXT = "strftime(w, '%Y-%m-%d %H:%M:%S')"


def windowed(df, width):
    return df.withColumn("w", F.date_format(F.window("ts", width)["start"], "yyyy-MM-dd HH:mm:ss"))


def _lines(n, line):
    return f"""select {_W_TEXT} as w, string_agg({line}, chr(10) order by rk) as lines from (
      select *, row_number() over (partition by w order by risk_score desc, ts, id) as rk from win)
      where rk <= {n} group by w"""


@register(
    "severity_prompt_lines",
    f"{_INC}, {_WIN} " + _lines(5, "'- [' || source || '] ' || substring(template, 1, 120)"),
)
def _prompt_lines(spark, sf_dir):
    return I.prompt_lines(windowed(_incidents(spark, sf_dir), "15 minutes"), ["w"])


_TOP_LINES = _lines(3, "'• `' || source || '` ' || substring(template, 1, 80)")


@register("alert_lines", f"{_INC}, {_WIN} select w, lines as top_lines from ({_TOP_LINES})")
def _alert_lines(spark, sf_dir):
    return I.alert_lines(windowed(_incidents(spark, sf_dir), "15 minutes"), ["w"])


_ASSESS = f"""assessed as (select {_W_TEXT} as w, count(*) as n, max(risk_score) >= 15 as urgent,
  array_to_string(list_sort(list(distinct source))[1:3], ', ') as hosts from win group by w)"""
_SEVERITY = "case when urgent then 'P1' else 'P3' end as severity, 'rule-based: ' || n || ' anomalies' as reason"


@register(
    "severity_windows",
    f"{_INC}, {_WIN}, {_ASSESS} select w, n, urgent, {_SEVERITY}, hosts from assessed",
)
def _assess(spark, sf_dir):
    rows = I.assess(windowed(_incidents(spark, sf_dir), "15 minutes"), ["w"])
    return rows.select("w", "n", "urgent", "severity", "reason", F.array_join("affected_hosts", ", ").alias("hosts"))


@register(
    "severity_now",
    f"""{_INC}, recent as (select inc.* from inc, n where run_ts >= now - interval '15 minutes')
     select count(*) as n, coalesce(max(risk_score) >= 15, false) as urgent,
      case when count(*) = 0 then 'P4' when max(risk_score) >= 15 then 'P1' else 'P3' end as severity,
      case when count(*) = 0 then 'No anomalies detected' else 'rule-based: ' || count(*) || ' anomalies' end as reason,
      coalesce(array_to_string(list_sort(list(distinct source))[1:3], ', '), '') as hosts from recent""",
)
def _assess_now(spark, sf_dir):
    p = views.predictions(spark, sf_dir)
    recent = selection.ingested_since(selection.incidents(p), views.now_of(p), 15)
    return I.assess_all(recent).withColumn("hosts", F.array_join("affected_hosts", ", ")).drop("affected_hosts")


@register(
    "severity_of_empty_window",
    f"""{_INC}, recent as (select inc.* from inc, n where run_ts >= now + interval '1 day')
     select count(*) as n, false as urgent, 'P4' as severity, 'No anomalies detected' as reason, '' as hosts
     from recent""",
)
def _assess_empty(spark, sf_dir):
    p = views.predictions(spark, sf_dir)
    later = views.now_of(p) + F.make_dt_interval(days=F.lit(1), mins=F.lit(15))
    recent = selection.ingested_since(selection.incidents(p), later, 15)
    return I.assess_all(recent).withColumn("hosts", F.array_join("affected_hosts", ", ")).drop("affected_hosts")


@register(
    "alert_routing",
    f"{_INC}, {_WIN}, {_ASSESS} select w, case when urgent then 'urgent' else 'daily' end as channel from assessed",
)
def _route(spark, sf_dir):
    return I.route(I.assess(windowed(_incidents(spark, sf_dir), "15 minutes"), ["w"])).select("w", "channel")


@register(
    "alerts",
    f"""{_INC}, {_WIN}, {_ASSESS}, lined as ({_TOP_LINES})
     select w, channel, severity, n, hosts, reason, case when channel = 'urgent' then
       concat_ws(chr(10), severity || ': ' || n || ' anomalous events', 'Hosts: ' || hosts,
        'Why: ' || reason, 'Highest risk first:', lines)
       else n || ' errors or anomalies, none urgent: ' || reason end as text
     from (select *, case when urgent then 'urgent' else 'daily' end as channel, {_SEVERITY} from assessed)
     join lined using (w)""",
)
def _alerts(spark, sf_dir):
    return I.alerts(windowed(_incidents(spark, sf_dir), "15 minutes"), ["w"])


# ------------------------------------------------------------ reports


_STATS = """select 'total' as dimension, '' as key, count(*) as n from {t}
  union all select 'label', predicted_label, count(*) from {t} group by 2
  union all select 'platform', platform, count(*) from {t} group by 2"""


@register("window_stats", f"{_INC} " + _STATS.format(t="predictions"))
def _stats(spark, sf_dir):
    return R.window_stats(views.predictions(spark, sf_dir))


_P12 = f"{_INC}, recent as (select predictions.* from predictions, n where ts >= date_trunc('second', now - interval '12 hours'))"


@register("window_stats_last_12_hours", f"{_P12} " + _STATS.format(t="recent"))
def _stats12(spark, sf_dir):
    p = views.predictions(spark, sf_dir)
    return R.window_stats(selection.occurred_since(p, views.now_of(p), 12))


@register(
    "top_services",
    f"{_INC} select service, count(*) as n from predictions group by service order by n desc, service limit 5",
)
def _services(spark, sf_dir):
    return R.top_services(views.predictions(spark, sf_dir))


_ERRORS = """select * from (select template, min((run_ts, ts, id)) as seen,
   arg_max(source, (run_ts, ts, id)) as host, arg_max(message, (run_ts, ts, id)) as message from inc group by template)
   order by seen, template limit 5"""


@register(
    "top_errors",
    f"""{_INC}, e as ({_ERRORS}) select host, substring(template, 1, 150) as template,
      substring(message, 1, 100) as message from e""",
)
def _errors(spark, sf_dir):
    return R.top_errors(views.predictions(spark, sf_dir)).select("host", "template", "message")


_DAY = "select *, strftime(ts, '%Y-%m-%d') as period from"


_REPORTS = (
    f"""{_INC}, p as ({_DAY} predictions), i as ({_DAY} inc),
     lab as (select period, string_agg('- ' || predicted_label || ': ' || n, chr(10) order by n desc, predicted_label) as labels
       from (select period, predicted_label, count(*) as n from p group by all) group by period),
     pla as (select period, string_agg('- ' || platform || ': ' || n, chr(10) order by n desc, platform) as platforms
       from (select period, platform, count(*) as n from p group by all) group by period),
     err as (select period, string_agg('- ' || substring(template, 1, 100), chr(10) order by seen) as errors from (
       select *, row_number() over (partition by period order by seen, template) as rk from (
        select period, template, min((run_ts, ts, id)) as seen from i group by all)) where rk <= 5 group by period),
     tot as (select period, count(*) as total_events from p group by period)
     select period, total_events, concat_ws(chr(10), '# Log report ' || period,
       chr(10) || '## Volume', 'Events: ' || total_events,
       chr(10) || '## Labels', labels, chr(10) || '## First errors', coalesce(errors, ''),
       chr(10) || '## By platform', platforms) as content
     from tot join lab using (period) join pla using (period) left join err using (period)"""
)


@register("markdown_reports", _REPORTS)
def _markdown(spark, sf_dir):
    return R.markdown_report(daily(spark, sf_dir), "period")


def daily(spark, sf_dir):
    return views.predictions(spark, sf_dir).withColumn("period", F.date_format("ts", "yyyy-MM-dd"))


@register("latest_report", f"select period, content from ({_REPORTS}) order by period desc limit 1")
def _latest(spark, sf_dir):
    """The latest of the reports that a run has written."""
    path = fresh_path(spark, "reports")
    sinks.write_reports(R.markdown_report(daily(spark, sf_dir), "period"), path)
    return R.latest_report(sinks.read_reports(spark, path))


# ------------------------------------------------------------ event-time windows


def _window_oracle(bucket, step=None):
    start = f"time_bucket(interval '{bucket}', ts)"
    return f"""select strftime({start}, '%Y-%m-%d %H:%M:%S') as w, dimension, key, count(*) as n from (
      select ts, unnest(['total', 'label', 'platform']) as dimension,
       unnest(['', predicted_label, platform]) as key from predictions) group by all"""


@register("summary_windows_12_hours", f"{_INC} " + _window_oracle("12 hours"))
def _windows12(spark, sf_dir):
    return R.window_stats(windowed(views.predictions(spark, sf_dir), "12 hours"), ["w"])


@register(
    "sliding_summary_windows",
    f"""{_INC}, slots as (select id, predicted_label, platform,
       time_bucket(interval '15 minutes', ts) - to_minutes(15 * unnest(range(0, 48))::bigint) as w0 from predictions)
     select strftime(w0, '%Y-%m-%d %H:%M:%S') as w, dimension, key, count(*) as n from (
      select w0, unnest(['total', 'label', 'platform']) as dimension,
       unnest(['', predicted_label, platform]) as key from slots) group by all""",
)
def _sliding(spark, sf_dir):
    rolled = R.rolling_stats(views.predictions(spark, sf_dir), width_minutes=12 * 60, slide_minutes=15)
    return rolled.select(F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("w"), "dimension", "key", "n")
