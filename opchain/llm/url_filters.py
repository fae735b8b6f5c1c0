"""Captures judged by the list entries that were active when they were fetched, in DataFrame operations only.

Dated additions to and removals from lists become validity intervals.  A capture's host, the domains
above it and its path prefixes are the patterns that could name it; they are joined with the entries of the
same pattern whose interval holds the fetch time.  The most specific active pattern decides.

Nulls, empty and odd input: a null or unparsable url, or a null fetch time, matches nothing and gets the verdict
none; entries with a null field, or an unknown kind, change or verdict, are ignored.  An addition to an active entry and a removal from an
inactive one change nothing; of both at one time the removal counts.  Every capture row gives one row,
repeated rows too; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # intervals (each some 200 bytes) up to which they are sent to every executor
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, kind, pattern, since, until) from dated changes (list, verdict, kind, pattern, change, at); until is null while active.

    Changes of one time are merged before the entry's history is put in order, so a history has one row a time at most.
    """
    name = ["list", "verdict", "kind", "pattern"]
    known = entries.where("change in ('add', 'remove') and kind in ('domain', 'host', 'prefix') and verdict in ('block', 'allow')").dropna(subset=[*name, "change", "at"])
    state = known.groupBy(*name, "at").agg(F.max((F.col("change") == "remove").cast("int")).alias("gone"))
    w = Window.partitionBy(*name).orderBy("at")
    turns = state.withColumn("was", F.lag("gone", 1, 1).over(w)).where("gone <> was")
    return turns.withColumn("until", F.lead("at").over(w)).where("gone = 0").select(*name, F.col("at").alias("since"), "until")


def patterns(url: Column) -> Column:
    """The (kind, pattern) that could name a url, each once."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    parts = F.array_remove(F.split(F.regexp_extract(url, PATH, 1), "/"), "")
    deep = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("pattern")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host != "", F.array_distinct(F.concat(domains, own, deep)))


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, fetched, n_entries, lists, verdict) of every row of captures (key, url, fetched)."""
    active = intervals(entries)
    if active.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        active = F.broadcast(active)
    rows = captures.select(F.col(key).alias("id"), "url", "fetched")
    asked = rows.where("url is not null and fetched is not null").distinct().select("id", "url", "fetched", F.explode(patterns(F.col("url"))).alias("p")).select("id", "url", "fetched", "p.*")
    hits = asked.join(active, ["kind", "pattern"]).where("since <= fetched and (until is null or fetched < until)")
    # longest pattern first; of equal ones an allowing entry
    rank = F.struct(F.length("pattern"), (F.col("verdict") == "allow").cast("int").alias("allow"), F.col("verdict").alias("verdict"))
    by_row = hits.groupBy("id", "url", "fetched").agg(F.count("*").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max(rank)["verdict"].alias("verdict"))
    r, h = rows.alias("r"), by_row.alias("h")
    same = F.col("r.id").eqNullSafe(F.col("h.id")) & (F.col("r.url") == F.col("h.url")) & (F.col("r.fetched") == F.col("h.fetched"))
    return r.join(h, same, "left").select(
        F.col("r.id").alias(key), "r.url", "r.fetched", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("verdict", F.lit("none")).alias("verdict"),
    )


def demo_inputs(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and list changes made from pages by fixed rules, for the query.

    A page is fetched page_id * 7919 mod 730 days after 2023-01-01.  By h, the first six hex digits of its host's md5: every fifth host is
    on the list spam from day h mod 600 on, off it again 90 days later if h mod 3 = 0, and back 120 days after that if h mod 7 = 0;
    every eleventh is on the list trusted (allowing) from day h mod 400; each host's path /es is on the list lang, days 100 to 500.
    Two domains are on the list farms from day 30, and all of example.net on the list net, days 200 to 260.
    """
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int"))
    captures = pages.select("page_id", "url", day(F.pmod(F.col("page_id") * 7919, F.lit(730))).alias("fetched"))
    hosts = pages.select(F.lower(F.regexp_extract("url", HOST, 1)).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int"))
    h, host = F.col("h"), F.col("host")

    def entry(where: Column, name: str, verdict: str, kind: str, pattern: Column, change: str, at: Column) -> DataFrame:
        return hosts.where(where).select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(change).alias("change"), day(at).alias("at"))

    spam = h % 5 == 0
    parts = [
        entry(spam, "spam", "block", "host", host, "add", h % 600),
        entry(spam & (h % 3 == 0), "spam", "block", "host", host, "remove", h % 600 + 90),
        entry(spam & (h % 3 == 0) & (h % 7 == 0), "spam", "block", "host", host, "add", h % 600 + 210),
        entry(h % 11 == 0, "trusted", "allow", "host", host, "add", h % 400),
        entry(h >= 0, "lang", "block", "prefix", F.concat(host, F.lit("/es")), "add", F.lit(100)),
        entry(h >= 0, "lang", "block", "prefix", F.concat(host, F.lit("/es")), "remove", F.lit(500)),
    ]
    fixed = [("farms", "spam-farm.example.org", "add", 30), ("farms", "cheap-pills.example.com", "add", 30), ("net", "example.net", "add", 200), ("net", "example.net", "remove", 260)]
    given = pages.sparkSession.createDataFrame(fixed, "list string, pattern string, change string, n int")
    out = given.select("list", F.lit("block").alias("verdict"), F.lit("domain").alias("kind"), "pattern", "change", day(F.col("n")).alias("at"))
    for p in parts:
        out = out.unionByName(p)
    return captures, out


SQL = r"""
with c as (select page_id, url, date '2023-01-01' + cast(page_id * 7919 % 730 as int) as fetched, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts from pages),
hosts as (select host, cast('0x' || md5(host)[1:6] as int) as h from (select distinct host from c where host <> '')),
spans as (
  select 'spam' as list, 'block' as verdict, 'host' as kind, host as pattern, date '2023-01-01' + h % 600 as since, case when h % 3 = 0 then date '2023-01-01' + h % 600 + 90 end as until from hosts where h % 5 = 0
  union all select 'spam', 'block', 'host', host, date '2023-01-01' + h % 600 + 210, null from hosts where h % 5 = 0 and h % 3 = 0 and h % 7 = 0
  union all select 'trusted', 'allow', 'host', host, date '2023-01-01' + h % 400, null from hosts where h % 11 = 0
  union all select 'lang', 'block', 'prefix', host || '/es', date '2023-01-01' + 100, date '2023-01-01' + 500 from hosts
  union all select 'farms', 'block', 'domain', 'spam-farm.example.org', date '2023-01-01' + 30, null
  union all select 'farms', 'block', 'domain', 'cheap-pills.example.com', date '2023-01-01' + 30, null
  union all select 'net', 'block', 'domain', 'example.net', date '2023-01-01' + 200, date '2023-01-01' + 260),
hit as (select c.page_id, c.url, s.* from c join spans s on s.since <= c.fetched and (s.until is null or c.fetched < s.until)
  and case s.kind when 'host' then c.host = s.pattern when 'domain' then c.host = s.pattern or ends_with(c.host, '.' || s.pattern)
    else exists (select 1 from (select unnest(range(0, len(c.parts) + 1)) as k) where c.host || '/' || array_to_string(c.parts[1:k], '/') = s.pattern) end),
best as (select page_id, url, count(*) as n_entries, (select string_agg(x, ',' order by x) from (select unnest(list_distinct(list(list))) as x)) as lists,
  arg_max(verdict, length(pattern) * 2 + case verdict when 'allow' then 1 else 0 end) as verdict from hit group by page_id, url)
select c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') as fetched, coalesce(n_entries, 0) as n_entries, coalesce(lists, '') as lists, coalesce(b.verdict, 'none') as verdict
from c left join best b on b.page_id = c.page_id and b.url = c.url
"""
