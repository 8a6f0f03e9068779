"""Not-modified revisits of a crawl: each takes its body from the latest earlier full response of its URL.

Records have ``record_id`` (bigint), ``url``, ``ts`` (any ordered type), ``status`` (int), ``headers``
(map<string,string>, names in any case) and whatever else (bodies stay out of the join). ``resolve`` adds

* ``canonical_url``: scheme, ``www.``, default port, fragment, tracking parameters and trailing slash removed,
  host in lower case;
* ``outcome``: ``full`` for status 200, ``resolved``, ``mismatch`` (a validator differs), ``unverified`` (no validator on
  both sides) or ``no_earlier`` for status 304, ``other`` for any other status;
* ``body_id``: the record whose body it has: its own for ``full``, the earlier one's for ``resolved``, else null;
* ``merged``: of a resolved revisit, the headers of the full response with those of the revisit in their place, but for
  headers that describe the body or the connection; otherwise its own. Names are in lower case.

Validators: entity tags are compared weakly (without ``W/``) if both sides have one, else dates of last modification.

The as-of join sorts narrow rows by (URL, time) into slices, so a URL may have any share of the rows.

Edge cases: a record without URL or time is never an earlier response, and as a revisit has ``no_earlier``; of records
at one time the order is that of ``record_id`` and a full response counts as earlier for a revisit of a higher id; null
headers are empty; a header given twice in different case keeps the value of the name first in order; an input column
named like a result raises an error; extra columns are kept; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.slices import carried, in_slices

# Headers of a 304 response that never replace those of the stored response.
KEPT_HEADERS = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]
# Query parameters that do not change the page.
TRACKING = "utm_[^=&#]*|ref|fbclid|gclid|phpsessid|jsessionid|sid"
ADDED = ["canonical_url", "outcome", "body_id", "merged"]


def canonical_url(url: Column) -> Column:
    """The key of a URL (see above); ASCII letters of the host only are folded."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, "#.*", "")
    host = F.translate(F.regexp_extract(bare, "^[^/?]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*(.*)", 1), f"([?&])({TRACKING})=[^&]*", r"$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), r"\?&+", "?")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "/+$", ""))


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with canonical_url, outcome, body_id and merged."""
    if clash := [c for c in ADDED if c in records.columns]:
        raise ValueError(f"columns {clash} are made here")
    entries = F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))
    lowered = F.array_sort(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("was"), e["value"].alias("value"))))
    names = F.array_distinct(F.transform(lowered, lambda e: e["key"]))
    plain = F.map_from_arrays(names, F.transform(names, lambda n: F.filter(lowered, lambda e: e["key"] == n)[0]["value"]))
    rows = records.withColumns({"canonical_url": canonical_url(F.col("url")), "_own": plain})
    narrow = rows.select("record_id", "ts", "status", F.col("canonical_url").alias("_url"), "_own").filter("_url is not null and ts is not null and status in (200, 304)")
    sliced = in_slices(narrow, ["_url"], ["ts", "record_id"], "revisits")
    full = F.when(F.col("status") == 200, F.struct("ts", "record_id", F.col("_own").alias("headers")))
    inside = Window.partitionBy("_url", "_slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max_by(F.struct("record_id", F.col("_own").alias("headers")), F.when(F.col("status") == 200, F.struct("ts", "record_id")))
    before = carried(sliced, ["_url"], {"full": latest}, lambda k, w: F.last(k, ignorenulls=True).over(w))
    near = sliced.withColumn("_full", F.last(full, ignorenulls=True).over(inside)).filter("status = 304")
    found = near.join(before, ["_url", "_slice"], "left").select(
        "record_id", "ts", "_url",
        F.coalesce(F.col("_full.record_id"), F.col("_before_full.record_id")).alias("_id"),
        F.coalesce(F.col("_full.headers"), F.col("_before_full.headers")).alias("_stored"),
    )
    # Rows that repeat record, time and URL find the same response: one match each.
    found = found.groupBy("record_id", "ts", "_url").agg(F.max_by(F.struct("_id", "_stored"), "_id").alias("_found"))
    joined = rows.join(
        found.select(F.col("record_id").alias("_r"), F.col("ts").alias("_t"), "_url", "_found"),
        (F.col("status") == 304) & F.col("record_id").eqNullSafe(F.col("_r")) & (F.col("ts") == F.col("_t")) & (F.col("canonical_url") == F.col("_url")),
        "left",
    )
    own, stored = F.col("_own"), F.col("_found._stored")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    same_tag, same_date = tag(own) == tag(stored), own["last-modified"] == stored["last-modified"]
    outcome = (
        F.when(F.col("status") == 200, "full")
        .when(~F.coalesce(F.col("status") == 304, F.lit(False)), "other")
        .when(F.col("_found._id").isNull(), "no_earlier")
        .when(F.coalesce(same_tag, same_date).isNull(), "unverified")
        .when(F.coalesce(same_tag, same_date), "resolved")
        .otherwise("mismatch")
    )
    allowed = F.map_filter(own, lambda k, _: ~k.isin(KEPT_HEADERS))
    kept = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return joined.withColumn("outcome", outcome).select(
        *records.columns, "canonical_url", "outcome",
        F.when(F.col("outcome") == "full", F.col("record_id")).when(F.col("outcome") == "resolved", F.col("_found._id")).alias("body_id"),
        F.when(F.col("outcome") == "resolved", F.map_concat(kept, allowed)).otherwise(own).alias("merged"),
    )


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """``resolved`` with the columns of ``bodies`` (one row per ``record_id``) of the record named by ``body_id``."""
    named = bodies.withColumnRenamed("record_id", "_body")
    return resolved.join(named, F.col("body_id") == F.col("_body"), "left").drop("_body")
