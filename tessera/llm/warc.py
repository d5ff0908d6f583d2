"""Resolve not-modified revisits of a web archive against earlier full responses.

An as-of join by canonical URL finds the latest full response before each revisit
(by time, then record id). Validators decide whether it may stand in: strong or
weak entity tags compare without their weakness mark; where either side has none,
the modification dates decide; where neither pair is there, nothing is proven.
The merged headers are the stored ones, updated by those that a 304 may change.

The join runs in two steps, so that a URL with any number of captures is spread:
windows within (URL, bucket of time), then windows over the buckets' last full
responses alone.

Nulls: a null URL equals no other; a null time sorts before all times; null
header maps count as empty. Equal times are ordered by record id; records that
repeat are each resolved. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 may not change in the stored response: they describe the stored body.
BODY_HEADERS = ("content-length", "content-encoding", "content-type", "content-range", "content-md5", "transfer-encoding", "trailer", "connection")
#: Query parameters that only track visitors.
TRACKING = "utm_[a-z]+|fbclid|gclid|ref"


def canonical_url(url: Column) -> Column:
    """Scheme, www, default port, fragment, tracking parameters, their order and a last slash do not count; hosts have no case."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)")))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def resolve(records: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """One row for each revisit (status 304) of records (record_id, url, ts, status, headers).

    headers: map of lower-case names. Adds canonical, target_id, target_ts, verdict
    (resolved, mismatch, unproven, missing) and merged (headers, if resolved). Bodies
    stay where they are: target_id says which one to read.
    """
    r = records.select("record_id", "url", "ts", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    r = r.withColumn("canonical", canonical_url(F.col("url")))
    r = r.withColumn("bucket", F.floor(F.unix_seconds("ts") / bucket_seconds))
    full = F.when(F.col("status") == 200, F.struct(F.col("record_id").alias("id"), F.col("ts"), F.col("headers")))
    # Null URLs are dealt out by record, so that they neither match nor meet in one task.
    key = F.coalesce("canonical", F.concat(F.lit("\n"), F.col("record_id").cast("string")))
    r = r.withColumn("key", key)
    inside = Window.partitionBy("key", "bucket").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("near", F.last(full, ignorenulls=True).over(inside))
    ends = r.where("status = 200").groupBy("key", "bucket").agg(F.max_by(F.struct(F.col("record_id").alias("id"), "ts", "headers"), F.struct("ts", "record_id")).alias("end"))
    asked = r.where("status = 304 and near is null and canonical is not null").select("key", "bucket").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType)).withColumn("ask", F.lit(True))
    summary = ends.withColumn("ask", F.lit(False)).unionByName(asked).groupBy("key", "bucket").agg(F.first("end", ignorenulls=True).alias("end"), F.max("ask").alias("ask"))
    carried = summary.withColumn("far", F.last("end", ignorenulls=True).over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.where("ask").select(F.col("key").alias("k"), F.col("bucket").alias("b"), "far")
    visits = r.where("status = 304").join(carried, (F.col("key") == F.col("k")) & F.col("bucket").eqNullSafe(F.col("b")), "left")
    found = F.when(F.col("canonical").isNotNull(), F.coalesce("near", "far"))
    visits = visits.withColumn("found", found)
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    mine, theirs = F.col("headers"), F.col("found.headers")
    dates = F.element_at(mine, "last-modified") == F.element_at(theirs, "last-modified")
    same = F.coalesce(tag(mine) == tag(theirs), dates)
    verdict = F.when(F.col("found").isNull(), "missing").when(same.isNull(), "unproven").when(same, "resolved").otherwise("mismatch")
    permitted = F.map_filter(mine, lambda k, v: ~k.isin(*BODY_HEADERS))
    stored = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(permitted, k))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(stored, permitted))))
    out = visits.withColumn("verdict", verdict)
    return out.select("record_id", "url", "canonical", "ts", F.col("found.id").alias("target_id"), F.col("found.ts").alias("target_ts"), "verdict", F.when(F.col("verdict") == "resolved", merged).alias("merged"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of pages: a full response each, and a revisit of its URL 90 minutes later.

    Page p is fetched p minutes after the start of 2024; its entity tag is the body's
    digest. Some revisits give no tag but a date, some another page's tag, some nothing.
    """
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("n"))
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    day = F.concat(F.lit("day "), (F.col("page_id") % 5).cast("string"))
    text = lambda c: F.coalesce(c, F.lit(""))
    response = F.struct(
        (F.col("page_id") * 2).alias("record_id"), F.col("url"), ts.alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.col("n")), F.lit("etag"), F.col("digest"), F.lit("last-modified"), text(day), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    etag = F.when(F.col("page_id") % 7 == 0, F.lit("other")).otherwise(F.concat(F.lit("W/"), F.col("digest")))
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.col("url"), (ts + F.expr("interval 90 minutes")).alias("ts"), F.lit(304).alias("status"),
        F.map_filter(
            F.create_map(F.lit("etag"), F.when(F.col("page_id") % 3 != 0, etag), F.lit("last-modified"), F.when(F.col("page_id") % 2 == 0, day), F.lit("content-length"), F.lit("0"), F.lit("expires"), text(F.concat(F.lit("hour "), F.col("page_id").cast("string")))),
            lambda k, v: v.isNotNull(),
        ).alias("headers"),
    )
    return p.select(F.inline(F.array(response, revisit)))


def revisits(pages: DataFrame) -> DataFrame:
    """The resolved revisits of captures(pages), the merged headers as one line each."""
    out = resolve(captures(pages))
    lines = F.array_join(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "canonical", "target_id", "verdict", lines.alias("merged"))


_CANON = r"""
  select page_id, url, md5(coalesce(html, '')) digest, length(coalesce(html, '')) n,
    regexp_replace(trim(url), '#.*$', '') bare
  from pages"""
ORACLE = rf"""
with b as ({_CANON}), c as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)', 1), '/+$', '') stem,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(?:{TRACKING})(?:=|$)'))) params
  from b), k as (
  select page_id, digest, n, stem || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end canonical from c),
e as (
  select page_id * 60 t, page_id * 2 record_id, canonical, page_id, digest, n, true is_full from k
  union all select page_id * 60 + 5400, page_id * 2 + 1, canonical, page_id, digest, n, false from k),
f as (
  select *, last_value(case when is_full then page_id end ignore nulls) over w target,
    last_value(case when is_full then digest end ignore nulls) over w target_digest,
    last_value(case when is_full then n end ignore nulls) over w target_n
  from e window w as (partition by canonical order by t, record_id rows between unbounded preceding and 1 preceding)),
g as (
  select *, case when page_id % 3 <> 0 then case when page_id % 7 = 0 then 'other' else digest end end tag,
    case when page_id % 2 = 0 then 'day ' || (page_id % 5) end stamp from f where not is_full),
v as (
  select *, case when target is null then 'missing' when tag is null and stamp is null then 'unproven'
    when coalesce(tag = target_digest, stamp = 'day ' || (target % 5)) then 'resolved' else 'mismatch' end verdict from g)
select record_id, canonical, target * 2 target_id, verdict,
  case when verdict = 'resolved' then 'cache-control: max-age=60' || chr(10) || 'content-length: ' || target_n || chr(10) || 'content-type: text/html' || chr(10)
    || 'etag: ' || case when tag is null then target_digest when tag = 'other' then 'other' else 'W/' || tag end || chr(10)
    || 'expires: hour ' || page_id || chr(10) || 'last-modified: ' || coalesce(stamp, 'day ' || (target % 5)) end merged
from v"""
