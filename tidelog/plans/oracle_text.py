"""DuckDB spelling of the expressions, for the side-by-side checks. Written apart from the Spark code;
only the word lists and patterns are shared."""

from functools import reduce

from tidelog import fixed_values as V
from tidelog.plans import views


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re_sub(text: str, pattern: str, replacement: str) -> str:
    replacement = replacement.replace("$1", "\\1")
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(replacement)}, 'g')"


def rule_sub(text: str, rule: tuple[str, str, str]) -> str:
    return re_sub(text, rule[1], rule[2])


def hosts(text: str) -> str:
    return re_sub(f"lower({text})", "(?i)" + views.HOST_PATTERN, "<HOST>")


def fold(text: str, rules) -> str:
    return reduce(rule_sub, rules, text)


def spaces(text: str) -> str:
    return f"trim({re_sub(text, chr(92) + 's+', ' ')})"


def placeholders(text: str) -> str:
    return reduce(lambda t, p: f"replace({t}, '{p[0]}', '{p[1]}')", V.PLACEHOLDER_CASE, text)


def template(text: str) -> str:
    masked = fold(hosts(text), V.DATASTORE_RULES)
    return placeholders(spaces(fold(f"lower({masked})", V.FIELD_RULES)))


def second(text: str) -> str:
    return spaces(fold(f"nullif(trim({text}), '')", V.SECOND_PASS_RULES))


def any_word(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def in_list(text: str, words) -> str:
    return f"{text} in ({', '.join(quoted(w) for w in words)})"


def service(text: str) -> str:
    branches = [
        f"when regexp_matches({text}, {quoted(p)}) then trim(regexp_extract({text}, {quoted(p)}, 1))"
        for p in V.SERVICE_CAPTURES
    ]
    names = [(n.lower(), n) for n in V.SERVICE_NAMES] + V.SERVICE_FALLBACKS
    branches += [f"when contains(lower({text}), {quoted(t)}) then {quoted(n)}" for t, n in names]
    return f"case {' '.join(branches)} else 'unknown' end"


def event_type(text: str) -> str:
    branches = [f"when {any_word(f'lower({text})', words)} then '{kind}'" for kind, words in V.EVENT_TYPE_RULES]
    return f"case {' '.join(branches)} else 'other' end"


def label(t: str, e: str, s: str) -> str:
    t, e, s = f"lower({t})", f"lower({e})", f"lower({s})"
    return f"""case
 when {in_list(e, V.ERROR_EVENT_TYPES)} then 'error'
 when {any_word(t, V.ERROR_WORDS)} then 'error'
 when contains({t}, 'qualys') or contains({s}, 'qualys') then 'security_noise'
 when {any_word(t, V.SECURITY_WORDS)} then 'security_noise'
 when {any_word(t, V.WARN_NOISE_WORDS)} then 'noise'
 when contains({t}, 'sdrsinjector') or contains({s}, 'sdrsinjector') then 'noise'
 when {any_word(t, V.STORAGE_NOISE_WORDS)} then 'noise'
 when {e} = 'other' and contains({t}, '<datastore>') then 'noise'
 when {any_word(t, V.INFRA_NOISE_WORDS)} then 'noise'
 when contains({t}, '<api_method>') then 'noise'
 when {in_list(e, V.IMPORTANT_EVENT_TYPES)} then 'important'
 when {any_word(t, V.IMPORTANT_WORDS)} then 'important'
 else 'noise' end"""


def reason(t: str, e: str, s: str) -> str:
    return f"""concat_ws(',', case when lower({e}) = 'permission_error' then 'event_type_permission_error' end,
 case when {any_word(f'lower({t})', V.REVIEW_WORDS)} or {any_word(f'lower({s})', V.REVIEW_WORDS)}
 then 'security_keyword' end)"""


def risk(text: str) -> str:
    return (
        f"case {text} when 'noise' then 0 when 'security_noise' then 1 when 'important' then 7 "
        "when 'error' then 10 when 'anomaly' then 15 else 0 end"
    )


def _view(columns: dict[str, str]) -> str:
    return ", ".join(f"{e.replace('{string}', 'varchar')} as {n}" for n, e in columns.items())


LOGS = f"logs as (select {_view(views.LOG_COLUMNS)} from events)"
VARIED = f"logs as (select {_view(views.VARIED_COLUMNS)} from events)"

RUN_TS = "time_bucket(interval '15 minutes', ts)"

PREDICTIONS = f"""{LOGS}, predictions as (
 select *, {risk('predicted_label')} as risk_score from (
  select *, {template('message')} as template, {service('message')} as service,
   {views.PREDICTED_LABEL.format(type='event_type_raw', id='id')} as predicted_label,
   {RUN_TS} as run_ts from logs))"""

# Tagged, labeled events: the input of the template table.
TAGGED = f"""{VARIED}, tagged0 as (
 select *, {template('message')} as template, {service('message')} as service,
  {event_type('message')} as event_type from logs),
 tagged1 as (select * replace ({second('template')} as template) from tagged0),
 tagged as (select *, {label('template', 'event_type', 'service')} as label from tagged1
  where coalesce(template, '') <> '')"""
