"""WARC revisits: not-modified records resolved to the response they refer to.

A ``revisit`` record says that a URL had not changed. It is resolved by an as-of
join: of the full responses with the same canonical URL, the latest that is
earlier. Their validators are then checked (entity tags by weak comparison, else
the modification date), and the headers that a 304 may carry replace the
response's.

Which response a revisit refers to depends on its URL and time alone, so records are
first reduced to one event for each URL and second; that bounds what any window
sees, whatever share of the records a URL has. Inside blocks of ``BLOCK`` seconds
per URL a window finds the last response, and over the blocks, one row each,
another window carries the last response of all earlier blocks. Payloads take no
part; headers are joined to the result by URL and time.

Defined results: null URLs are one URL of their own; null times sort first and
have no earlier response; of responses of one URL at one time that with the larger
record id counts (null ids are the least), of those with equal ids the one with the
greater headers, then payload; a response at the very time of the revisit is not
earlier. Records of other kinds, and responses whose status is not 200, are ignored.
Every revisit row gives one result row, repeated rows and repeated or null ids too.
Extra columns are left out. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 86_400
#: Headers that a 304 response may replace (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a resource (a pattern).
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, tracking parameters and final slash; host in
    lower case, parameters in order."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    path = F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def headers_map(block: Column) -> Column:
    """A header block's lines as a map of lower-case names; a repeated name keeps its last value."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """records: (record_id, kind, url, at, status, headers[, payload_sha256]); at in seconds, headers a map of lower-case names.

    Result, one row per revisit: record_id, url (canonical), at, response_id,
    outcome (resolved, unchecked, changed, unseen), headers (merged), payload_sha256.
    """
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url"), F.col("at").cast("long").alias("at"), "status", "headers", "payload_sha256")
    responses = rows.where("kind = 'response' and status = 200 and at is not null")
    revisits = rows.where("kind = 'revisit'")
    told = F.struct("record_id", F.array_sort(F.map_entries("headers")).alias("entries"), "payload_sha256")
    answers = responses.groupBy("url", "at").agg(F.max(told).alias("best"))
    events = (
        responses.select("url", "at", F.lit(True).alias("full"), F.lit(False).alias("asks"))
        .unionByName(revisits.select("url", "at", F.lit(False).alias("full"), F.lit(True).alias("asks")))
        .groupBy("url", "at", F.floor(F.col("at") / block).alias("block"))
        .agg(F.max("full").alias("full"), F.max("asks").alias("asks"))
    )
    seen = F.when(F.col("full"), F.col("at"))
    inside = Window.partitionBy("url", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = events.groupBy("url", "block").agg(F.max(seen).alias("most"))
    over = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("carried", F.last("most", ignorenulls=True).over(over)).select(F.col("url").alias("u"), F.col("block").alias("b"), "carried")
    asked = events.withColumn("near", F.last(seen, ignorenulls=True).over(inside)).where("asks")
    matched = asked.join(carried, asked["url"].eqNullSafe(carried["u"]) & asked["block"].eqNullSafe(carried["b"]), "left").select(
        F.col("url").alias("u"), F.col("at").alias("t"), F.coalesce("near", "carried").alias("answered")
    )
    found = revisits.join(matched, revisits["url"].eqNullSafe(matched["u"]) & revisits["at"].eqNullSafe(matched["t"]), "left").select(
        "record_id", "url", "at", "answered", F.col("headers").alias("own")
    )
    theirs = answers.select(
        F.col("url").alias("u"), F.col("at").alias("t"), F.col("best.record_id").alias("response_id"), F.map_from_entries("best.entries").alias("theirs"), F.col("best.payload_sha256").alias("payload_sha256")
    )
    joined = found.join(theirs, found["url"].eqNullSafe(theirs["u"]) & (found["answered"] == theirs["t"]), "left")
    own, other = F.col("own"), F.col("theirs")
    tags = own["etag"].isNotNull() & other["etag"].isNotNull()
    dates = own["last-modified"].isNotNull() & other["last-modified"].isNotNull()
    outcome = (
        F.when(F.col("answered").isNull(), "unseen")
        .when(tags, F.when(_weak(own["etag"]) == _weak(other["etag"]), "resolved").otherwise("changed"))
        .when(dates, F.when(own["last-modified"] == other["last-modified"], "resolved").otherwise("changed"))
        .otherwise("unchecked")
    )
    fresh = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*PERMITTED))
    stale = F.map_filter(F.coalesce(other, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(fresh, k))
    holds = F.col("outcome").isin("resolved", "unchecked")
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url", "at", "response_id", "outcome",
        F.when(holds, F.map_concat(stale, fresh)).alias("headers"), F.when(holds, F.col("payload_sha256")).alias("payload_sha256"),
    )


def headers_text(headers: Column) -> Column:
    """Headers in order of their names, one per line."""
    entries = F.array_sort(F.map_entries(headers))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
