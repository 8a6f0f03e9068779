"""Registered queries: the labeled template table and what is read from it."""

from pyspark.sql import functions as F

from tidelog.operators import label_templates as L
from tidelog.plans import oracle_text as Q
from tidelog.plans.collect_queries import tagged_events
from tidelog.plans.registry import register

_CLASSES = ["error", "important", "noise", "security_noise"]
_JSON = " , ".join(
    f"""case when count(*) filter (where label = '{x}') > 0
      then '"{x}": ' || count(*) filter (where label = '{x}') end"""
    for x in _CLASSES
)


def _mode(column):
    return f"""(select {column} from tagged x where x.template = t.template group by {column}
      order by count(*) desc, {column} limit 1)"""


TEMPLATES = f"""{Q.TAGGED}, lc as (
  select template, label, count(*) as n, sum(count(*)) over (partition by template) as total,
   count(*) over (partition by template) as kinds,
   row_number() over (partition by template order by count(*) desc, label) as rk
  from tagged group by template, label),
 ranked as (
  select template, 'event_type' as dim, event_type as value, count(*) as n from tagged group by all
  union all select template, 'service', service, count(*) from tagged group by all
  union all select template, 'platform', platform, count(*) from tagged group by all),
 modes as (select template, dim, value from ranked
  qualify row_number() over (partition by template, dim order by n desc, value) = 1),
 hist as (select template, count(*) as "count", '{{' || concat_ws(', ', {_JSON}) || '}}' as label_candidates
  from tagged group by template),
 templates as (
  select h.template, case when lc.kinds > 1 and lc.n / lc.total < 0.8 then 'unknown' else lc.label end as label,
   e.value as event_type, s.value as service, p.value as platform, h."count",
   round_even(lc.n / lc.total, 3) as label_confidence, h.label_candidates
  from hist h join lc on lc.template = h.template and lc.rk = 1
  join modes e on e.template = h.template and e.dim = 'event_type'
  join modes s on s.template = h.template and s.dim = 'service'
  join modes p on p.template = h.template and p.dim = 'platform')"""


def templates(spark, sf_dir):
    return L.label_templates(counts(spark, sf_dir))


def counts(spark, sf_dir):
    return L.template_counts(tagged_events(spark, sf_dir))


@register("label_templates", f"with {TEMPLATES} select * from templates")
def _templates(spark, sf_dir):
    return templates(spark, sf_dir)


@register(
    "template_counts",
    f"""with {Q.TAGGED} select template, label, event_type, service, platform, count(*) as n
     from tagged group by all""",
)
def _counts(spark, sf_dir):
    return counts(spark, sf_dir)


@register(
    "label_conflicts",
    f"""with {Q.TAGGED}, lc as (select service as template, label, count(*) as n,
      sum(count(*)) over (partition by service) as total, count(*) over (partition by service) as kinds
      from tagged group by service, label)
     select template, case when kinds > 1 and n / total < 0.8 then 'unknown' else label end as label,
      cast(total as bigint) as "count", round_even(n / total, 3) as label_confidence from lc
     qualify row_number() over (partition by template order by n desc, label) = 1""",
)
def _conflicts(spark, sf_dir):
    """Conflict resolution where labels do disagree: service names stand in for templates."""
    by_service = counts(spark, sf_dir).withColumn("template", F.col("service"))
    return L.label_templates(by_service).select("template", "label", "count", "label_confidence")


@register(
    "most_common_tags",
    f"""with {TEMPLATES} select template, event_type, service, platform from templates""",
)
def _most_common(spark, sf_dir):
    return templates(spark, sf_dir).select("template", "event_type", "service", "platform")


@register("label_confidence", f"with {TEMPLATES} select template, label_confidence from templates")
def _confidence(spark, sf_dir):
    return templates(spark, sf_dir).select("template", "label_confidence")


@register("label_histogram_json", f"with {TEMPLATES} select template, label_candidates from templates")
def _histogram(spark, sf_dir):
    return templates(spark, sf_dir).select("template", "label_candidates")


@register(
    "review_candidates",
    f"""with {TEMPLATES} select * from (select template, label as suggested_label,
      {Q.reason('template', 'event_type', 'service')} as reason, event_type, service, platform, "count",
      label_confidence, label_candidates from templates) where reason <> ''""",
)
def _candidates(spark, sf_dir):
    return L.review_candidates(templates(spark, sf_dir))


@register(
    "label_distribution",
    f"""with {TEMPLATES} select label, count(*) as n,
      round_even(100 * count(*) / sum(count(*)) over (), 1) as pct from templates group by label""",
)
def _distribution(spark, sf_dir):
    return L.label_distribution(templates(spark, sf_dir))


@register(
    "first_templates_per_label",
    f"""with {TEMPLATES} select label, template, "count", cast(rank as integer) as rank from (
      select *, row_number() over (partition by label order by "count" desc, template) as rank from templates)
      where rank <= 3""",
)
def _first(spark, sf_dir):
    rows = L.first_per_label(templates(spark, sf_dir), [F.desc("count"), F.asc("template")])
    return rows.select("label", "template", "count", "rank")


@register(
    "template_dictionary",
    f"with {Q.TAGGED} select template, count(*) as support from tagged group by template",
)
def _dictionary(spark, sf_dir):
    return L.template_dictionary(counts(spark, sf_dir))
