"""Registered queries of this package: name -> (spark, sf_dir) -> DataFrame, and their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import alignment, chat, debruijn, equal_average, fmindex, jaccard, kneserney, license_texts, licenses, onebit, packing, planes, revisits, secret_scan
from tidelog.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_bit_planes")
def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "planes")
    planes.write_planes(table(spark, sf_dir, "documents"), path)
    return planes.read_digests(spark, path)


@register("op3_best_two_fit")
def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


_CANONICAL = r"""
  regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*', ''), '^[^/?]*')), '^www[0-9]*\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*', ''), '^[^/?]*(.*)', 1),
    '([?&])(utm_[^=&#]*|ref|fbclid|gclid|phpsessid|jsessionid|sid)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', ''), '/+$', '')"""


@register(
    "op2_revisits",
    f"""
    with records as (
      select page_id, {_CANONICAL} as canonical_url, page_id % 3 = 2 as revisit,
        concat('"', page_id // 4 % 5, '"') as etag, concat('s', page_id % 7) as server, html
      from pages),
    near as (
      select r.*, max(case when not revisit then page_id end) over (
        partition by canonical_url order by page_id rows between unbounded preceding and 1 preceding) as earlier
      from records r)
    select n.page_id, n.canonical_url,
      case when not n.revisit then 'full' when f.page_id is null then 'no_earlier' when n.etag = f.etag then 'resolved' else 'mismatch' end as outcome,
      case when not n.revisit then n.page_id when n.etag = f.etag then f.page_id end as body_id,
      concat('content-length=', case when n.revisit and n.etag = f.etag then octet_length(encode(f.html)) else case when n.revisit then 0 else octet_length(encode(n.html)) end end,
        ';etag=', n.etag, ';server=', n.server) as headers,
      case when not n.revisit then sha256(n.html) when n.etag = f.etag then sha256(f.html) end as body_sha256
    from near n left join records f on n.revisit and f.page_id = n.earlier""",
)
def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a crawl in order of their ids, every third of them a not-modified answer without a body."""
    revisit, length = F.col("page_id") % 3 == 2, F.octet_length("html").cast("string")
    tag = F.concat(F.lit('"'), F.floor(F.col("page_id") / 4) % 5, F.lit('"'))
    pages = table(spark, sf_dir, "pages")
    records = pages.select(
        F.col("page_id").alias("record_id"), "url", F.col("page_id").alias("ts"), F.when(revisit, 304).otherwise(200).alias("status"),
        F.create_map(
            F.lit("ETag"), tag, F.lit("Server"), F.concat(F.lit("s"), F.col("page_id") % 7), F.lit("Content-Length"), F.when(revisit, "0").otherwise(length)
        ).alias("headers"),
    )
    bodies = pages.select(F.col("page_id").alias("record_id"), F.sha2("html", 256).alias("body_sha256"))
    found = revisits.with_bodies(revisits.resolve(records), bodies)
    shown = F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select(F.col("record_id").alias("page_id"), "canonical_url", "outcome", "body_id", F.array_join(shown, ";").alias("headers"), "body_sha256")


@register("op9_chat_windows")
def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.windows(rows.unionByName(more)))


# The form of a licence, written from its rule line by line and not from the library's patterns.
_LICENSE_FORM = """
  trim(regexp_replace(regexp_replace({0}, '[\\x00-\\x1F\\x21-\\x2F\\x3A-\\x60\\x7B-\\x7F\\x{{A0}}\\x{{AB}}\\x{{BB}}\\x{{2000}}-\\x{{206F}}\\x{{3000}}-\\x{{3003}}]', ' ', 'g'), ' +', ' ', 'g'))"""
_LICENSE_SPELLINGS = [
    ("licence", "license"), ("offence", "offense"), ("defence", "defense"),
    *[(f"{x}s", f"{x}z") for x in "authori capitali categori customi emphasi initiali maximi minimi optimi organi reali recogni summari utili".split()],
    *[(f"{x}our", f"{x}or") for x in "behavi col fav hon lab".split()], *[(f"{x}ogue", f"{x}og") for x in "anal catal dial".split()],
    *[(f"{x}l{y}", f"{x}{y}") for x in "cancel label model signal".split() for y in ("ed", "ing")], ("acknowledgement", "acknowledgment"), ("judgement", "judgment"),
    ("centre ", "center "), ("sub license", "sublicense"), *[(f"non {x}", f"non{x}") for x in ("commercial", "exclusive", "infringement")],
    ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http"),
]


def _license_form(text: str) -> str:
    made = f"({_LICENSE_FORM.format(text)} || ' ')"
    for old, new in _LICENSE_SPELLINGS:
        made = f"replace({made}, '{old}', '{new}')"
    return f"sha256(trim({made}))"


_KNOWN_TEXTS = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in license_texts.TEXTS.items())


@register(
    "op10_licenses",
    rf"""
    with texts as (
      select null::bigint as doc_id, name, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from (values {_KNOWN_TEXTS}) t(name, text)
      union all
      select doc_id, null, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from documents),
    lines as (
      select doc_id, name, low, [l for l in string_split(low, chr(10)) if not (
        (regexp_matches(l, '^[ \t*#/;!%|>-]*copyright[ \t]*:?[ \t]+[^ \t\r\f\x0B]') and not regexp_matches(l, '^[ \t*#/;!%|>-]*copyright[ \t]*:?[ \t]+({"|".join(licenses.IN_SENTENCES)})([^a-z0-9]|$)'))
        or regexp_matches(l, '^[ \t*#/;!%|>-]*(©|\(c\)[ \t]*(copyright|19[0-9][0-9]|20[0-9][0-9])|all rights reserved[ \t\r.]*$)'))] as kept
      from texts),
    forms as (
      select doc_id, name, {_license_form("array_to_string(kept, chr(10))")} as cut, {_license_form("low")} as whole from lines),
    known as (select digest, min(name) as license_id from (select cut as digest, name from forms where name is not null union all select whole, name from forms where name is not null)
      where digest <> sha256('') group by 1)
    select f.doc_id, f.cut as license_digest, coalesce(a.license_id, b.license_id) as license_id
    from forms f left join known a on a.digest = f.cut left join known b on b.digest = f.whole where f.name is null""",
)
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@register("op8_ngram_jaccard")
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


@register("op5_debruijn_dedup")
def op5_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.removal_digests(table(spark, sf_dir, "documents"))


@register("op4_fm_index")
def op4_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fmindex.find_phrases(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", *fmindex.hit_counts(found))


@register(
    "op7_one_bit_codes",
    """
    with valid as (
      select vec_id, cast(embedding as double[]) as v from embeddings
      where embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    scored as (
      select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as score
      from valid q join valid c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
    from scored qualify rank <= 20""",
)
def op7_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op6_kneser_ney")
def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return kneserney.classify(docs, table(spark, sf_dir, "labels"), with_text=False)


def _rounds_sql(rounds: int) -> str:
    """Assignment and update of the codebooks, ``rounds`` times, then the last assignment."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
    near{k} as (
      select vec_id, label, p, x, e, d from (
        select s.*, c.e, list_sum(list_transform(list_zip(s.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
        from pieces s join books{k} c using (p))
      qualify row_number() over (partition by vec_id, p order by d, e) = 1)""")
        if k < rounds:
            steps.append(f"""
    sums{k} as (
      select p, e, i, sum(x[i]) as s, count(*) as n from (select p, e, x, unnest(range(1, len(x) + 1)) as i from near{k}) group by all),
    means{k} as (select p, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from sums{k} group by all),
    books{k + 1} as (select p, e, coalesce(m.c, b.c) as c from books{k} b left join means{k} m using (p, e))""")
    return ",".join(steps)


@register(
    "op11_equal_average",
    f"""
    with kept as (
      select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    pieces as (select vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as x from kept, range(16) r(p)),
    books0 as (
      select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from pieces
      where vec_id in (select vec_id from kept order by vec_id limit 64)),{_rounds_sql(2)},
    coded as (
      select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from near2 group by vec_id, label)
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
      (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from books2) as codebooks_sha256
    from coded""",
)
def op11_equal_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_average.compress(table(spark, sf_dir, "embeddings"))


@register("op12_structural_secrets")
def op12_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@register("op13_diagonal_alignment")
def op13_diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))
