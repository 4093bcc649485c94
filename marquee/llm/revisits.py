"""WARC not-modified revisits: as-of join to the latest earlier full response.

Records: ``record_id``, ``ts`` (any ordered integer), ``url``, ``kind``
(``response`` or ``revisit``), ``etag``, ``last_modified`` and ``headers`` (map
with lower-case names). A revisit takes the latest response of its canonical
URL with an earlier ``ts`` (of equal ones the largest id). Validators: the
entity tag decides where both have one, else the modification date; a revisit
without a usable validator is not trusted. Of a resolved revisit's own headers
only those a 304 may update replace the response's.

The as-of step never gathers a URL's records in one task: records are cut into
``BUCKETS`` time ranges, each range's last response is summed up per URL,
carried forward over at most ``BUCKETS`` rows, and the exact step runs within
(URL, range). Wide columns are joined afterwards by record id.

Null URLs, times or ids: such responses are never found, such revisits get the
status ``invalid``. Records repeated with one id count once (the largest in
column order). Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm.common import stored

BUCKETS = 64
#: Header fields a 304 may replace in the stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not change a page.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without final
    slashes, sorted query without tracking parameters; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)", 1), "&"),
                                   lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.concat_ws("&", params))).otherwise(""))


def _header_list(headers: Column) -> Column:
    return F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))


def time_cuts(records: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Cut points of the time ranges (approximate quantiles)."""
    cuts = records.agg(F.percentile_approx("ts", [i / buckets for i in range(1, buckets)], 1000)).first()[0]
    return sorted(set(cuts or []))


def resolve(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per revisit: record_id, ts, canonical url, response_id, status
    (``resolved``, ``validator_mismatch``, ``no_response``, ``invalid``) and the
    merged ``headers`` (sorted entries; empty unless resolved)."""
    named = records.select(F.col("record_id").cast("bigint").alias("id"), F.col("ts").cast("bigint").alias("ts"),
                           canonical_url(F.col("url")).alias("url"), "kind", "etag", "last_modified",
                           _header_list(F.col("headers")).alias("headers"))
    fields = ["ts", "url", "kind", "etag", "last_modified", "headers"]
    usable = stored(named.where("id IS NOT NULL AND kind IN ('response', 'revisit')").groupBy("id").agg(
        F.max(F.struct(*fields)).alias("r")).select("id", "r.*"), "warc-records")
    valid = usable.where("ts IS NOT NULL AND url IS NOT NULL")
    cuts = time_cuts(valid, buckets)
    # the number of cut points at or below the time
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)
    full = F.when(F.col("kind") == "response", F.struct("ts", "id", "etag", "last_modified"))
    light = valid.select("id", "ts", "url", "kind", "etag", "last_modified", bucket.alias("bucket"), full.alias("full"))
    per_range = light.groupBy("url", "bucket").agg(F.max("full").alias("last"), F.count_if(F.col("kind") == "revisit").alias("asked"))
    before = W.partitionBy("url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = per_range.select("url", "bucket", "asked", F.max("last").over(before).alias("carried")).where("asked > 0")
    # revisits stand before responses of the same time, so they see earlier ones only
    so_far = W.partitionBy("url", "bucket").orderBy("ts", F.col("kind") == "response", "id").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    seen = light.select("id", "ts", "url", "kind", "etag", "last_modified", "bucket", F.max("full").over(so_far).alias("inside"))
    met = seen.where("kind = 'revisit'").join(carried.drop("asked"), ["url", "bucket"], "left").withColumn(
        "hit", F.coalesce("inside", "carried"))
    agree = F.when(F.col("etag").isNotNull() & F.col("hit.etag").isNotNull(), F.col("etag") == F.col("hit.etag")).otherwise(
        F.coalesce(F.col("last_modified") == F.col("hit.last_modified"), F.lit(False)))
    status = F.when(F.col("hit").isNull(), "no_response").when(agree, "resolved").otherwise("validator_mismatch")
    answered = met.select("id", "ts", "url", F.col("hit.id").alias("response_id"), status.alias("status"))
    invalid = usable.where("kind = 'revisit' AND (ts IS NULL OR url IS NULL)").select(
        "id", "ts", "url", F.lit(None).cast("bigint").alias("response_id"), F.lit("invalid").alias("status"))
    all_answers = stored(answered.union(invalid), "warc-answers")
    own = usable.where("kind = 'revisit'").select("id", F.col("headers").alias("own"))
    theirs = usable.where("kind = 'response'").select(F.col("id").alias("response_id"), F.col("headers").alias("stored"))
    permitted = F.filter("own", lambda e: e["key"].isin(PERMITTED))
    kept = F.filter("stored", lambda e: ~F.exists(permitted, lambda o: o["key"] == e["key"]))
    merged = F.when(F.col("status") == "resolved", F.array_sort(F.concat(kept, permitted))).otherwise(F.filter("own", lambda e: F.lit(False)))
    return all_answers.join(own, "id").join(theirs, "response_id", "left").select(
        F.col("id").alias("record_id"), "ts", "url", "response_id", "status", merged.alias("headers"))


def page_records(pages: DataFrame, later: int = 2000) -> DataFrame:
    """WARC records derived from a pages table: each page is one full response
    (record 2 * page_id, at time page_id) and is asked for again ``later`` on
    (record 2 * page_id + 1) under a decorated URL, with the page's own digest as
    entity tag, or, for every fourth page, none but a modification date."""
    page = F.col("page_id")
    etag = F.md5(F.col("html"))
    responses = pages.where("html IS NOT NULL").select(
        (page * 2).alias("record_id"), page.alias("ts"), "url", F.lit("response").alias("kind"), etag.alias("etag"),
        (page % 50).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length("html").cast("string"),
                     F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), page.cast("string")).alias("headers"))
    asked = pages.select(
        (page * 2 + 1).alias("record_id"), (page + later).alias("ts"), F.concat("url", F.lit("#again")).alias("url"),
        F.lit("revisit").alias("kind"), F.when(page % 4 != 0, etag).alias("etag"), (page % 50).cast("string").alias("last_modified"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=120"), F.lit("content-length"), F.lit("0"),
                     F.lit("date"), (page + later).cast("string")).alias("headers"))
    return responses.union(asked)


def report(pages: DataFrame) -> DataFrame:
    """Every derived revisit with its answer; merged headers as one text."""
    r = resolve(page_records(pages))
    text = F.concat_ws(";", F.transform("headers", lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return r.select("record_id", "ts", "url", "response_id", "status", text.alias("merged_headers"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, html, trim(url) AS u, regexp_replace(trim(url), '#.*', '') AS bare FROM pages),
q AS (SELECT *, regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p),
c AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)='))) AS params
  FROM q),
k AS (
  SELECT page_id, html, base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url,
    md5(html) AS digest FROM c),
m AS (
  SELECT v.page_id, v.url, v.digest,
    (SELECT max(r.page_id) FROM k r WHERE r.url = v.url AND r.html IS NOT NULL AND r.page_id < v.page_id + 2000) AS rid
  FROM k v),
j AS (SELECT m.*, r.digest AS rdigest, length(r.html) AS n FROM m LEFT JOIN k r ON r.page_id = m.rid),
s AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no_response'
    WHEN page_id % 4 <> 0 THEN CASE WHEN digest = rdigest THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN page_id % 50 = rid % 50 THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM j)
SELECT page_id * 2 + 1 AS record_id, page_id + 2000 AS ts, url, rid * 2 AS response_id, status,
  CASE WHEN status = 'resolved' THEN 'cache-control=max-age=120;content-length=' || n || ';content-type=text/html;date=' || (page_id + 2000)
       ELSE '' END AS merged_headers
FROM s"""
