"""Not-modified revisits in web archives: resolved to the response they stand for.

A revisit record has headers but no body. It is joined, as of its date, to the latest earlier full
response under the same canonical URL; where validators do not contradict, it gets that
response's payload and the stored headers, updated by those that a 304 may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let

# Fields that a 304 must not change: of one connection only, or bound to the stored body.
NOT_UPDATED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """One form of equal addresses: no scheme, ``www.``, default port, fragment, tracking or end slash.

    Scheme and host are in lower case. NULL stays NULL.
    """
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z]+://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])utm_[a-z]+=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "[?]&", "?")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, "[?&]$", ""), "/$", ""))


def lowered(headers: Column) -> Column:
    """Header names in lower case, the last of equal names; NULL counts as no headers."""
    entries = F.transform(
        F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    last = let(
        entries,
        lambda all_: F.filter(
            all_,
            lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"]),
        ),
    )
    return F.map_from_entries(last)


def weak(tag: Column) -> Column:
    """An entity tag without its mark of weakness."""
    return F.regexp_replace(F.trim(tag), "^[Ww]/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: what it stands for.

    ``records``: ``record_id, url, date`` (long seconds), ``type`` (response or revisit), ``status``
    (int), ``headers`` (map), ``digest`` (of the payload); other columns are ignored. A full response
    has status 200. A response of the same second is not earlier; of several in one second the
    greatest ``record_id`` counts. Result: ``record_id, canonical_url, date, outcome, response_id,
    headers, digest``, the last three only if the outcome is ``resolved``. Other outcomes:
    ``no earlier response`` (also for NULL url or date), ``changed`` (entity tag, last-modified
    or digest contradict), ``unverified`` (no validator on both sides). Repeated records are
    records; an empty table gives no rows.

    Records of one URL are cut by date into ranges that hold about equally many of all records,
    so a URL with a third of them is no single task. Inside a range the join is a window; what
    a range inherits comes from the last responses of the ranges before, one row each.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    ends = records.agg(F.percentile_approx("date", shares, 10_000)).first()[0]
    ends = F.lit(sorted(set(ends or []))).cast("array<long>")
    full = (F.col("type") == "response") & (F.col("status") == 200)
    rows = (
        records.where(full | (F.col("type") == "revisit"))
        .select(
            "record_id",
            canonical_url(F.col("url")).alias("canonical_url"),
            "date",
            full.alias("full"),
            lowered(F.col("headers")).alias("headers"),
            "digest",
        )
        .withColumn("range", F.size(F.filter(ends, lambda e: e < F.col("date"))))
    )
    usable = F.col("full") & F.col("canonical_url").isNotNull() & F.col("date").isNotNull()
    response = F.when(usable, F.struct("record_id", "headers", "digest"))
    key = ["canonical_url", "range"]
    # A revisit sorts before the responses of its second: these are not earlier.
    inside = Window.partitionBy(*key).orderBy("date", "full", "record_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inherited = (
        rows.where(F.col("canonical_url").isNotNull())
        .groupBy(*key)
        .agg(F.max_by(response, F.when(usable, F.struct("date", "record_id"))).alias("last"))
        .select(*key, F.last("last", ignorenulls=True).over(before).alias("inherited"))
    )
    asked = (
        rows.withColumn("near", F.last(response, ignorenulls=True).over(inside))
        .where(~F.col("full"))
        .join(inherited, key, "left")
        .withColumn("response", F.when(F.col("date").isNotNull(), F.coalesce("near", "inherited")))
    )

    def both(name: str) -> tuple[Column, Column]:
        return F.try_element_at("headers", F.lit(name)), F.try_element_at("response.headers", F.lit(name))

    checks = [
        let(F.struct(*(weak(c).alias(n) for c, n in zip(both("etag"), "ab"))), lambda s: s["a"] == s["b"]),
        let(F.struct(*(F.trim(c).alias(n) for c, n in zip(both("last-modified"), "ab"))), lambda s: s["a"] == s["b"]),
        F.col("digest") == F.col("response.digest"),
    ]
    outcome = (
        F.when(F.col("response").isNull(), "no earlier response")
        .when(~F.coalesce(F.least(*checks), F.lit(True)), "changed")
        .when(F.coalesce(*checks).isNull(), "unverified")
        .otherwise("resolved")
    )
    update = F.map_filter("headers", lambda k, v: ~k.isin(NOT_UPDATED) & v.isNotNull())
    kept = F.map_filter("response.headers", lambda k, v: ~F.map_contains_key(F.col("update"), k))
    resolved = F.col("outcome") == "resolved"
    return (
        asked.withColumn("outcome", outcome)
        .withColumn("update", update)
        .select(
            "record_id",
            "canonical_url",
            "date",
            "outcome",
            F.when(resolved, F.col("response.record_id")).alias("response_id"),
            F.when(resolved, F.map_concat("update", kept)).alias("headers"),
            F.when(resolved, F.col("response.digest")).alias("digest"),
        )
    )


# Archive records from the given pages; Spark and DuckDB run the same text over (page, k). Every page is stored
# once and revisited under other spellings of its URL: with its tag (weak for some), with a tag
# that no longer fits, before it was stored, and after a partial response.
RECORDS = """
select page_id * 10 + k as record_id,
       case k when 0 then url
              when 1 then concat(replace(replace(url, 'https://', 'HTTP://'), 'http://', 'https://'), '#again')
              when 2 then concat(split_part(url, '#', 1), case when url like '%?%' then '&' else '?' end, 'utm_campaign=x')
              else url end as url,
       1700000000 + page_id * 60 + case k when 0 then 0 when 1 then 86400 when 2 then 172800 when 3 then -3600 else 90000 end as date,
       case when k in (0, 4) then 'response' else 'revisit' end as type,
       case k when 0 then 200 when 4 then 206 else 304 end as status,
       case k when 1 then case when page_id % 5 = 0 then concat('W/', tag) else tag end
              when 2 then case when page_id % 7 = 0 then '"gone"' when page_id % 7 = 1 then null else tag end
              else tag end as etag,
       case when k = 0 then length(html) when k = 4 then 10 when page_id % 2 = 0 then 0 else null end as bytes,
       case when k = 0 then 'max-age=60' else concat('max-age=', page_id % 9) end as cache,
       case when k in (0, 4) then tag when k = 2 and page_id % 7 = 1 and page_id % 2 = 0 then tag else null end as digest
from (select page_id, url, html, concat('"', md5(coalesce(html, '')), '"') as tag, {spread} as k from {pages}) p
"""


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records above with their headers as maps."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = spark.sql(RECORDS.format(spread="explode(sequence(0, 4))", pages="{pages}"), pages=pages)
    headers = F.create_map(
        F.lit("ETag"), F.col("etag"),
        F.lit("Content-Length"), F.col("bytes").cast("string"),
        F.lit("Cache-Control"), F.col("cache"),
    )
    return rows.select(
        "record_id", "url", F.col("date").cast("long").alias("date"), "type", "status", headers.alias("headers"), "digest"
    )


def revisited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All revisits of the given pages, merged headers as text in order of their names."""
    entries = F.array_sort(F.map_entries(F.map_filter("headers", lambda k, v: v.isNotNull())))
    lines = F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return resolve(page_records(spark, sf_dir)).withColumn("headers", F.when(F.col("headers").isNotNull(), lines))


SQL = (
    """
with records as ("""
    + RECORDS.format(spread="unnest(range(5))", pages="pages")
    + """),
cut as (
  select *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', '') as bare from records
  where type = 'revisit' or status = 200),
split as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '') as host,
         regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '([?&])utm_[a-z]+=[^&]*', '\\1', 'g') as rest
  from cut),
keyed as (
  select *, concat(host, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           rest, '&&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]$', ''), '/$', '')) as canonical_url,
         type = 'response' as is_full
  from split),
asked as (
  select *, last_value(case when is_full then record_id end ignore nulls) over earlier as near
  from keyed
  window earlier as (partition by canonical_url order by date, is_full, record_id
                     rows between unbounded preceding and 1 preceding)),
checked as (
  select a.record_id, a.canonical_url, a.date,
         case when r.record_id is null then 'no earlier response'
              when regexp_replace(a.etag, '^[Ww]/', '') <> regexp_replace(r.etag, '^[Ww]/', '')
                   or a.digest <> r.digest then 'changed'
              when (a.etag is null or r.etag is null) and (a.digest is null or r.digest is null) then 'unverified'
              else 'resolved' end as outcome,
         a.cache, r.bytes, coalesce(a.etag, r.etag) as etag, r.record_id as response_id, r.digest
  from asked a left join keyed r on r.record_id = a.near
  where a.type = 'revisit')
select record_id, canonical_url, date, outcome,
       case when outcome = 'resolved' then response_id end as response_id,
       case when outcome = 'resolved' then concat('cache-control: ', cache, chr(10), 'content-length: ', bytes, chr(10), 'etag: ', etag) end as headers,
       case when outcome = 'resolved' then digest end as digest
from checked
"""
)
