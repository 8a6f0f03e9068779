"""Registered queries: documents, retrieval, prompts and replies."""

from pyspark.sql import functions as F

from tidelog.functions import prompts as PR
from tidelog.functions import replies as RE
from tidelog.operators import documents as D
from tidelog.operators import incidents as I
from tidelog.operators import inference as N
from tidelog.operators import replies_store as RS
from tidelog.operators import reports as RP
from tidelog.operators import retrieval as R
from tidelog.operators import selection
from tidelog.plans import oracle_text as Q
from tidelog.plans import views
from tidelog.plans.incident_queries import windowed
from tidelog.plans.registry import ORACLES, register
from tidelog.session import fresh_path, materialize


def pages(spark, sf_dir):
    return views.table(spark, sf_dir, "pages")


@register("html_text")
def _html_text(spark, sf_dir):
    return D.extract_text(pages(spark, sf_dir), ["page_id", "url"])


_LINES = """array_to_string(list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]'),
  lambda x: trim(x, ' ' || chr(9))), lambda x: len(x) > 40), chr(10))"""


@register("long_lines", f"select doc_id, {_LINES} as text from documents")
def _long_lines(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", D.long_lines(F.col("text")).alias("text"))


@register("long_documents", "select doc_id, n_chars from documents where len(text) >= 100")
def _long_docs(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return D.long_documents(docs).select("doc_id", "n_chars")


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_CHUNKS = f"""chunks as (select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as chunk_id, text
  from (select doc_id, i, {_STRIP.format('substring(text, i * 320 + 1, 400)')} as text from (
   select doc_id, text, unnest(range(0, (len(text) - 1) // 320 + 1)) as i from documents where len(text) >= 100))
  where len(text) > 100)"""


def chunks(spark, sf_dir):
    docs = views.documents(spark, sf_dir).withColumnRenamed("lang", "platform")
    return D.chunk(D.long_documents(docs))


@register("chunks", f"with {_CHUNKS} select doc_id, chunk_id, text from chunks")
def _chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", "chunk_id", "text")


@register("page_chunks")
def _page_chunks(spark, sf_dir):
    """Pages all the way to chunks: HTML, long lines, long documents, pieces."""
    texts = D.extract_text(pages(spark, sf_dir), ["url"]).withColumn("text", D.long_lines(F.col("text")))
    return D.chunk(D.long_documents(texts))


@register("chunk_vectors")
def _vectors(spark, sf_dir):
    rows = D.hashed_vectors(chunks(spark, sf_dir))
    return rows.select("doc_id", "chunk_id", F.size("vector").alias("dim"), F.bround(F.array_max("vector"), 4).alias("top"), "vector")


_COSINE = "list_cosine_similarity(q.v, e.v)"
_EMB = "emb as (select vec_id as id, embedding::double[] as v, label from embeddings)"


def embeddings(spark, sf_dir):
    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_CENTROIDS = """q as (select label as query_id, list(m order by i) as v from (
   select label, i, avg(x) as m from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from emb)
   group by all) group by label)"""
_TOP = """hits as (select * from (select query_id, e.id, list_cosine_similarity(q.v, e.v) as score,
   cast(row_number() over (partition by query_id order by list_cosine_similarity(q.v, e.v) desc, e.id) as integer) as rank
   from q, emb e) where rank <= {k})"""


def centroids(spark, sf_dir):
    """One query per embedding label: the mean vector."""
    cells = embeddings(spark, sf_dir).select("label", F.posexplode("vector").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"])  # one entry per dimension
    return means.groupBy(F.col("label").alias("query_id")).agg(listed.alias("vector"))


@register("passage_search", f"with {_EMB}, {_CENTROIDS}, {_TOP.format(k=3)} select query_id, id, rank, round_even(score, 3) as score from hits")
def _search(spark, sf_dir):
    hits = R.top_passages(centroids(spark, sf_dir), embeddings(spark, sf_dir))
    return hits.select("query_id", "id", "rank", F.bround("score", 3).alias("score"))


@register(
    "passage_search_many",
    f"with {_EMB}, q as (select id as query_id, v from emb), {_TOP.format(k=3)} select query_id, id, rank, round_even(score, 3) as score from hits",
)
def _search_many(spark, sf_dir):
    """Every vector is a query."""
    rows = embeddings(spark, sf_dir)
    hits = R.top_passages(rows.select(F.col("id").alias("query_id"), "vector"), rows)
    return hits.select("query_id", "id", "rank", F.bround("score", 3).alias("score"))


@register("passage_search_by_pivots", ORACLES["passage_search_many"])
def _search_by_pivots(spark, sf_dir):
    """The same hits; parts that cannot hold one of a query's best are left out."""
    rows = embeddings(spark, sf_dir)
    hits = R.search_by_pivots(rows.select(F.col("id").alias("query_id"), "vector"), rows, part=512).hits
    return hits.select("query_id", "id", "rank", F.bround("score", 3).alias("score"))


_PAYLOAD = "payload as (select doc_id as id, text, source, lang as platform from documents)"
_HITS = f"""with {_EMB}, {_CENTROIDS}, {_TOP.format(k=3)}, {_PAYLOAD},
  full_hits as (select query_id, rank, round_even(score, 3) as score, text, source, platform
  from hits join payload using (id))"""


def full_hits(spark, sf_dir):
    payload = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("platform")
    )
    return R.with_payload(R.top_passages(centroids(spark, sf_dir), embeddings(spark, sf_dir)), payload)


@register("passage_context", f"{_HITS} select query_id, substring(arg_min(text, rank), 1, 300) as context from full_hits group by query_id")
def _context(spark, sf_dir):
    return R.top_context(full_hits(spark, sf_dir))


_EXPLAIN = (
    "Explain this log anomaly in three to five sentences: likely cause, and how to check or fix it.\nAnomaly: ",
    "\nDocumentation: ",
)


@register(
    "explanation_records",
    f"""{_HITS}, anomalies as (select distinct label as query_id, 'anomaly ' || label as anomaly from emb
       union all select 1000 + max(label), 'anomaly without a match' from emb)
     select a.query_id, any_value(anomaly) as anomaly,
      case when count(rank) = 0 then 'No relevant documentation found.' end as explanation,
      coalesce(string_agg(source, ',' order by rank), '') as sources,
      coalesce(string_agg(platform || ':' || score, ',' order by rank), '') as chunks,
      {Q.quoted(_EXPLAIN[0])} || any_value(anomaly) || {Q.quoted(_EXPLAIN[1])}
       || substring(arg_min(text, rank), 1, 300) as prompt
     from anomalies a left join full_hits using (query_id) group by a.query_id""",
)
def _explanations(spark, sf_dir):
    labels = embeddings(spark, sf_dir).select(F.col("label").alias("query_id")).distinct()
    extra = labels.agg((F.max("query_id") + 1000).alias("query_id"))
    anomalies = labels.select("query_id", F.concat(F.lit("anomaly "), "query_id").alias("anomaly")).unionByName(
        extra.withColumn("anomaly", F.lit("anomaly without a match"))
    )
    rows = R.explanations(anomalies, full_hits(spark, sf_dir))
    shown = F.transform("chunks", lambda c: F.concat(c["platform"], F.lit(":"), c["score"]))
    return rows.select(
        "query_id", "anomaly", "explanation", "prompt",
        F.array_join("sources", ",").alias("sources"), F.array_join(shown, ",").alias("chunks"),
    )


@register("explain_top_incidents")
def _explain_incidents(spark, sf_dir):
    """Top three incidents by risk against chunks of all documents, with hashed vectors."""
    unique = I.last_per_template(selection.incidents(views.predictions(spark, sf_dir)))
    top = I.top_by_risk(unique, 3).select(F.col("id").alias("query_id"), F.col("template").alias("text"))
    passages = D.hashed_vectors(chunks(spark, sf_dir).withColumn("id", F.xxhash64("doc_id", "chunk_id")))
    hits = R.top_passages(D.hashed_vectors(top).select("query_id", "vector"), passages)
    hits = materialize(hits, "hits")
    rows = R.explanations(top.withColumnRenamed("text", "anomaly"), R.with_payload(hits, passages))
    found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda h: h["id"]).alias("chunk_ids"))  # k per query
    return rows.join(found, "query_id", "left").select("query_id", "anomaly", "prompt", F.size("chunks").alias("n_chunks"), "chunk_ids")


_HREFS = """unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href"""


@register(
    "page_links",
    f"""select url, link from (select url, case when starts_with(href, '/') then regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || href
       else href end as link from (select url, replace(href, '&amp;', '&') as href from (select url, {_HREFS} from pages)))
     where regexp_extract(link, '^[a-z]+://([^/?#]*)', 1) = regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)
      and not (ends_with(link, '.jpg') or ends_with(link, '.png') or ends_with(link, '.pdf')
       or ends_with(link, '.zip') or ends_with(link, '.exe'))""",
)
def _links(spark, sf_dir):
    return D.extract_links(pages(spark, sf_dir))


@register(
    "document_keys",
    """select page_id, case when ends_with(k, '.html') then k else k || '.html' end as key from (
      select page_id, coalesce(nullif(trim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), ''), 'index') as k
      from pages)""",
)
def _keys(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", D.document_key(F.col("url")).alias("key"))


_GRAPH = """edges as (select distinct 'u' || user_id as url, 'u' || (event_id * 7 % 1009) as link from events),
 seeds as (select 'u' || min(user_id) as url from events)"""


@register(
    "reachable_pages",
    f"""with {_GRAPH}, l1 as (select distinct link as url from edges join seeds using (url)
       where link not in (select url from seeds)),
      l2 as (select distinct link as url from edges join l1 using (url)
       where link not in (select url from seeds union all select url from l1))
     select url, 0 as depth from seeds union all select url, 1 from l1 union all select url, 2 from l2""",
)
def _reachable(spark, sf_dir):
    """Stored pages do not link to each other, so a link graph over users stands in."""
    events = views.table(spark, sf_dir, "events")
    links = events.select(
        F.concat(F.lit("u"), "user_id").alias("url"),
        F.concat(F.lit("u"), (F.col("event_id") * 7) % 1009).alias("link"),
    )
    seeds = events.agg(F.concat(F.lit("u"), F.min("user_id")).alias("url"))
    return D.reachable(links, seeds)


# ------------------------------------------------------------ prompts and replies


@register(
    "classify_prompts",
    f"""with {Q.VARIED} select id, 'Which label fits this template?' || chr(10) || substring(message, 1, 300) as classify,
     '- ' || substring(message, 1, 300) || chr(10) || '  label =' as few_shot from logs""",
)
def _prompts(spark, sf_dir):
    text = F.col("message")
    return views.varied_logs(spark, sf_dir).select(
        "id", PR.classify_prompt(text).alias("classify"), PR.few_shot_prompt(text).alias("few_shot")
    )


_CONTEXT = f"""with {Q.LOGS}, c as (select id, message, list(message) over (
   partition by time_bucket(interval '15 minutes', ts) order by ts, id rows between 5 preceding and 1 preceding) as ctx from logs)"""


def with_context(spark, sf_dir):
    rows = windowed(views.logs(spark, sf_dir).select("id", "ts", "message"), "15 minutes")
    return N.with_context(rows, ["w"], "message")


@register("window_context", f"{_CONTEXT} select id, coalesce(array_to_string(ctx, chr(10)), '') as context from c")
def _window_context(spark, sf_dir):
    return with_context(spark, sf_dir).select("id", F.array_join("context", "\n").alias("context"))


@register(
    "window_prompts",
    f"""{_CONTEXT} select id, case when len(ctx) > 0 then 'What the same source logged before, oldest first:' || chr(10)
      || array_to_string(list_transform(ctx, lambda t: '* ' || t), chr(10)) || chr(10)
      else '' end || 'Which label fits the next template?' || chr(10) || message as prompt from c""",
)
def _window_prompts(spark, sf_dir):
    return with_context(spark, sf_dir).select(
        "id", PR.window_prompt(F.col("message"), F.col("context")).alias("prompt")
    )


@register(
    "severity_prompts",
    f"""with {Q.PREDICTIONS}, inc as (select *, time_bucket(interval '15 minutes', ts) as w from predictions
      where predicted_label in ('error', 'anomaly')),
     r as (select *, row_number() over (partition by w order by risk_score desc, ts, id) as rk from inc)
     select strftime(w, '%Y-%m-%d %H:%M:%S') as w, {Q.quoted(PR.SEVERITY_SYSTEM + chr(10) * 2 + 'Anomalies:' + chr(10))}
      || string_agg('- [' || source || '] ' || substring(template, 1, 120), chr(10) order by rk) as prompt
     from r where rk <= 5 group by w""",
)
def _severity_prompts(spark, sf_dir):
    lines = I.prompt_lines(windowed(selection.incidents(views.predictions(spark, sf_dir)), "15 minutes"), ["w"])
    return lines.select("w", PR.severity_prompt(F.col("lines")).alias("prompt"))


@register(
    "report_prompts",
    f"""with {Q.PREDICTIONS}, d as (select strftime(ts, '%Y-%m-%d') as period, * from predictions),
     lab as (select period, string_agg('- ' || predicted_label || ': ' || n, chr(10) order by n desc, predicted_label) as labels,
       cast(sum(n) as bigint) as total from (select period, predicted_label, count(*) as n from d group by all) group by period),
     pla as (select period, string_agg('- ' || platform || ': ' || n, chr(10) order by n desc, platform) as platforms
       from (select period, platform, count(*) as n from d group by all) group by period)
     select period, 'Write a short operations report in Markdown with an overall sentence, critical events, patterns '
      || 'and recommendations.' || chr(10) || 'Period: ' || period || chr(10) || 'Events: ' || total || chr(10) || 'By label: '
      || labels || chr(10) || 'By platform: ' || platforms || chr(10) || 'Errors: none' as prompt from lab join pla using (period)""",
)
def _report_prompts(spark, sf_dir):
    days = views.predictions(spark, sf_dir).withColumn("period", F.date_format("ts", "yyyy-MM-dd"))
    rows = RP.report_parts(days, "period")
    text = PR.report_prompt(F.col("period"), F.col("total_events"), F.col("labels"), F.col("platforms"), F.lit("none"))
    return rows.select("period", text.alias("prompt"))


# Replies in every shape a model gives them, one per event.
_REPLY = """case event_id % 9
  when 0 then concat('{"label": "error", "confidence": 0.', event_id % 10, ', "explanation": "e', event_id, '", "severity": ', event_id % 11, '}')
  when 1 then concat('Sure: {"label": "noise", "confidence": 0.7} as asked, id ', event_id)
  when 2 then concat('{"important": "vm ', user_id, ' moved"}')
  when 3 then concat('no json at all, maybe Security Noise ', event_id)
  when 4 then ''
  when 5 then concat('{"label": "warning", "security_noise": "yes", "confidence": "high', user_id, '"}')
  when 6 then '{"label": "unknown", "noise": "x"}'
  when 7 then 'An ERROR, not noise'
  else concat('text {"label": "important", "severity": ', event_id % 11, '} more {"x": 1}') end"""
_R = f"r as (select event_id, {_REPLY} as raw from events)"
_FIRST = """j as (select event_id, raw, case when json_valid(raw) and raw <> '' then raw
   when json_valid(nullif(regexp_extract(raw, '\\{.*?\\}', 0, 's'), '')) then regexp_extract(raw, '\\{.*?\\}', 0, 's') end as obj from r)"""
_IN = "('noise', 'important', 'error', 'security_noise')"


def replies(spark, sf_dir):
    return views.table(spark, sf_dir, "events").selectExpr("event_id", f"{_REPLY} as raw")


@register(
    "reply_labels",
    f"""with {_R}, {_FIRST}, k as (select *, json_extract_string(obj, '$.label') as label,
       list_filter(json_keys(obj), lambda x: x in {_IN})[1] as key from j)
     select event_id, case when label in {_IN} or label = 'unknown' then label else coalesce(key, label, 'unknown') end as label,
      coalesce(nullif(try_cast(json_extract_string(obj, '$.confidence') as double), 0), 0.5) as confidence from k""",
)
def _reply_labels(spark, sf_dir):
    parsed = replies(spark, sf_dir).withColumn("reply", RE.reply_object(F.col("raw")))
    return parsed.select(
        "event_id", RE.reply_label(F.col("reply")).alias("label"), RE.reply_confidence(F.col("reply")).alias("confidence")
    )


@register(
    "reply_confidence_defaults",
    "select event_id, coalesce(nullif(case when event_id % 4 <> 0 then (event_id % 5) / 5.0::double end, 0), 0.5) as confidence from events",
)
def _half(spark, sf_dir):
    e = F.col("event_id")
    return views.table(spark, sf_dir, "events").select(
        "event_id", RE.or_half(F.when(e % 4 != 0, (e % 5) / 5.0)).alias("confidence")
    )


@register(
    "one_word_replies",
    f"""with {_R} select event_id, case when regexp_matches(lower(raw), '\\bsecurity[_\\s]noise\\b') then 'security_noise'
      when regexp_matches(lower(raw), '\\berror\\b') then 'error' when regexp_matches(lower(raw), '\\bimportant\\b') then 'important'
      when regexp_matches(lower(raw), '\\bnoise\\b') then 'noise' else 'unknown' end as label from r""",
)
def _one_word(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", RE.one_word_label(F.col("raw")).alias("label"))


@register(
    "classifier_head_labels",
    f"""select event_id, case when lower(upper(event_type)) in {_IN} then lower(upper(event_type)) else 'unknown' end as label,
     round_even(value / 1000, 3) as score from events""",
)
def _head(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        RE.head_label(F.upper("event_type")).alias("label"),
        RE.head_score(F.col("value") / 1000).alias("score"),
    )


@register(
    "salvaged_replies",
    f"""with {_R}, j as (select event_id, raw, case when json_valid(raw) and raw <> '' then raw
      when json_valid(nullif(regexp_extract(raw, '\\{{.*\\}}', 0, 's'), '')) then regexp_extract(raw, '\\{{.*\\}}', 0, 's') end as obj from r)
     select event_id, case when obj is null then 'unknown' else json_extract_string(obj, '$.label') end as label,
      case when obj is null then 0 else try_cast(json_extract_string(obj, '$.confidence') as double) end as confidence,
      case when obj is null then substring(raw, 1, 100) else json_extract_string(obj, '$.explanation') end as explanation,
      case when obj is null then 0 else try_cast(json_extract_string(obj, '$.severity') as integer) end as severity from j""",
)
def _salvaged(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", RE.salvaged(F.col("raw")).alias("s")).select("event_id", "s.*")


@register("model_calls")
def _calls(spark, sf_dir):
    """A stand-in model answers one word per template; the reply comes back as a label."""
    rows = views.logs(spark, sf_dir).select("id", PR.few_shot_prompt(F.col("message")).alias("prompt"))
    answered = N.call_model(rows, lambda text: "Error" if "refused" in text else "noise")
    return answered.select("id", RE.one_word_label(F.col("raw")).alias("label"))


def _stand_in(text: str) -> str:
    """Answers with the length of the prompt in words."""
    return str(len(text.split(" ")))


@register(
    "stored_model_calls",
    f"""with {Q.LOGS}, asked as (select distinct message as prompt from logs)
     select sha256(prompt) as digest, cast(len(string_split(prompt, ' ')) as varchar) as raw from asked""",
)
def _stored_calls(spark, sf_dir):
    """Replies kept for distinct log messages after two runs, of which the second repeats the first half's prompts."""
    rows = views.logs(spark, sf_dir).select("id", F.col("message").alias("prompt"))
    store = fresh_path(spark, "replies")
    RS.ask(rows.filter("id % 2 = 0"), _stand_in, store, "words")
    RS.ask(rows, _stand_in, store, "words")
    return RS.stored(spark, store, "words").select("digest", "raw")
