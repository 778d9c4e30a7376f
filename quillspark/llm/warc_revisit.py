"""Not-modified revisits of web captures, resolved to full responses.

An as-of join by canonical url: each revisit is tied to the latest strictly earlier full
response of its url (of several at one time, that of the largest record id), its validators are checked and
the header fields that a not-modified answer may update are merged over the response's.

The as-of join is a carried-forward value over time, in two levels so that a url with a third of all
captures isn't one task's work.  Captures of one url and time are one moment, so that many at one time are one row.  Time is cut into ``slices`` at the quantiles of
all captures, whatever times they have; within a (url, slice) a window over moments carries the
response along, and between slices only each slice's last response is carried, one row per (url, slice).  Revisits then join their moment.
No payload takes part in any of this; ``attach_payload`` joins it by record id afterwards.

Validators: with an entity tag on both sides the tags decide (weak comparison), else with Last-Modified on both sides these, else
with a payload digest on both sides these; with nothing to compare the revisit counts as unchecked and resolves.

Defined cases
    Revisits without an earlier response have status "no earlier response", with contradicting validators "validators differ"; both keep
    their own headers and refer to nothing, the latter names the response that it was checked against.  A null time is earlier than nothing and later than nothing: "no earlier response".
    Null urls form the url "" together with empty ones.  Header names are compared in lower case; of names that differ only in
    case the first counts; null headers are empty.  Repeated records resolve each.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ladder import quantiles, rung
from .storage import Shelf

# The fields that the HTTP standard lets a 304 answer carry for the stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = "^(utm_[^=]*|fbclid|gclid|ref)(=|$)"


def canonical(url: Column) -> Column:
    """Host and path, without scheme, user, default port, leading "www.", fragment, trailing slash and
    tracking parameters; the other parameters sorted.  A text without "://" stays but for its fragment."""
    plain = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    authority = F.regexp_extract(plain, "://([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(authority), "^.*@", ""), ":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, "://[^/?]*([^?]*)", 1), "/+$", "")
    parameters = F.array_sort(F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.array_join(parameters, "&")
    return F.when(F.instr(plain, "://") == 0, plain).otherwise(F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def lower_headers(headers: Column) -> Column:
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda name: F.filter(entries, lambda e: F.lower(e["key"]) == name)[0]["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def merged(stored: Column, update: Column, permitted: list[str]) -> Column:
    """``stored`` with the permitted fields of ``update`` in place of its own."""
    fresh = F.map_filter(update, lambda k, v: k.isin(permitted))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)


def as_of(records: DataFrame, payload: Column, is_source: Column, keys: list[str], time: str, order: list[str], slices: int) -> DataFrame:
    """The rows that aren't sources, with ``earlier``: ``payload`` of the latest source row with the same keys and a strictly smaller time."""
    edges = sorted(set(quantiles(records, time, slices, 10 * slices)))  # at most ``slices`` numbers
    # of several sources at one time the last by ``order`` answers
    moments = records.groupBy(*keys, time).agg(F.max_by(F.when(is_source, payload), F.when(is_source, F.struct(*order))).alias("__here"))
    moments = moments.withColumn("__slice", rung(F.col(time), edges))
    within = Window.partitionBy(*keys, "__slice").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    near = moments.withColumn("__near", F.last("__here", ignorenulls=True).over(within))
    ends = moments.groupBy(*keys, "__slice").agg(F.max_by("__here", F.when(F.col("__here").isNotNull(), F.col(time))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # at most ``slices`` rows
    marks = ends.select(*keys, "__slice", F.last("__end", ignorenulls=True).over(before).alias("__far"))
    answers = near.join(marks, [*keys, "__slice"]).select(*keys, time, F.coalesce("__near", "__far").alias("earlier"))
    return records.where(~is_source).join(answers, [*keys, time])


def resolve_revisits(records: DataFrame, permitted: list[str] | None = None, slices: int = 1024) -> DataFrame:
    """Resolved revisits of ``records`` (record_id, url, captured long, kind "response" or "revisit", headers map, digest, length).

    Returns (record_id, url_key, captured, status, checked_by, refers_to, earlier_captured, headers, digest, length) for each revisit;
    ``headers`` are the merged ones, ``digest`` and ``length`` those of the response's payload."""
    rows = records.select("record_id", canonical(F.col("url")).alias("url_key"), "captured", "kind", lower_headers(F.col("headers")).alias("headers"), "digest", "length")
    rows = rows.where("kind in ('response', 'revisit')")
    timed = rows.where("captured is not null")
    timed = Shelf(records.sparkSession, "revisits").saved(timed)
    payload = F.struct("record_id", "captured", "headers", "digest", "length")
    found = as_of(timed, payload, F.col("kind") == "response", ["url_key"], "captured", ["record_id"], slices).select(*timed.columns, "earlier")
    untimed = rows.where("captured is null and kind = 'revisit'").withColumn("earlier", F.lit(None).cast(found.schema["earlier"].dataType))
    found = found.unionByName(untimed)

    mine, theirs = F.col("headers"), F.col("earlier.headers")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    pairs = [("etag", tag(mine), tag(theirs)), ("last-modified", mine["last-modified"], theirs["last-modified"]), ("digest", F.col("digest"), F.col("earlier.digest"))]
    checked, agrees = F.lit("nothing"), F.lit(True)
    for name, a, b in reversed(pairs):
        both = a.isNotNull() & b.isNotNull()
        checked, agrees = F.when(both, F.lit(name)).otherwise(checked), F.when(both, a == b).otherwise(agrees)
    lost = F.col("earlier").isNull()
    status = F.when(lost, "no earlier response").when(~agrees, "validators differ").otherwise("resolved")
    good = status == "resolved"
    return found.select(
        "record_id", "url_key", "captured", status.alias("status"), F.when(~lost, checked).alias("checked_by"), F.when(good, F.col("earlier.record_id")).alias("refers_to"),
        F.col("earlier.captured").alias("earlier_captured"), F.when(good, merged(theirs, mine, permitted or PERMITTED)).otherwise(mine).alias("headers"),
        F.when(good, F.col("earlier.digest")).otherwise(F.col("digest")).alias("digest"), F.when(good, F.col("earlier.length")).alias("length"),
    )


def attach_payload(resolved: DataFrame, responses: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """``resolved`` with the payload of the response that each revisit refers to."""
    bodies = responses.select(F.col(id_col).alias("refers_to"), F.col(payload_col).alias("payload"))
    return resolved.join(bodies, "refers_to", "left")


def header_text(headers: Column) -> Column:
    """One "name: value" line per field, sorted by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
