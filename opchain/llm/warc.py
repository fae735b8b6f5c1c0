"""WARC records, and the resolution of revisit records that say "not modified".

A revisit is joined, as of its time, with the latest earlier full response of the same canonical
URL.  Records are sorted by URL and time over all partitions and each partition is scanned once, the last
response carried forward; ranges split even a single URL's records.  Only a partition's first URL can
need a response from before the partition, so one row a partition settles the rest.

A revisit counts as validated if it and the response share one validator at least (payload digest,
ETag, Last-Modified) and every shared one is equal; as conflict if one differs, as unchecked if none
is shared, as orphan if there is no earlier response.  A revisit of the profile "identical payload digest" that is no 304 answer names its record itself and says nothing of the URL's
latest response, so it is left out; without a profile a revisit counts as "not modified".  A validated revisit has the response's payload and its headers, in which
the permitted fields of the revisit's own headers take the place of the old ones.

Nulls, empty and odd input: records without an id, URL or time, and of other types, are left out; null headers are empty.
Of records of one URL and time the one of lesser id comes first, and a response at a revisit's own time counts only if its id is less.
Repeated rows give repeated rows; an empty table gives none.  Extra columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opchain.llm.passages import partitions
from opchain.plans.arrow import map_arrow
from opchain.plans.scratch import Scratch

#: Fixed value: how the profile ends of revisits that were recognised by their payload (WARC 1.1, 6.7).
IDENTICAL = "identical-payload-digest"
#: The fields that a 304 answer sends anew (RFC 9110, 15.4.5), in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
RECORDS = "record_id string, url string, fetched timestamp, type string, profile string, digest string, refers_to string, status int, headers map<string,string>, payload binary"


def canonical(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a last slash, sorted query without utm_ fields; no scheme or fragment."""
    plain = F.regexp_replace(url, r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^www\.|:80$|:443$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    fields = F.array_sort(F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_")))
    query = F.array_join(fields, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields (names in lower case, repeated ones joined, folded lines unfolded)."""
    first, _, rest = block.partition(b"\n")
    out: dict[str, str] = {}
    name = ""
    for line in rest.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = (x.strip() for x in line.split(":", 1))
            name = name.lower()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return first.decode("utf-8", "replace").strip(), out


def _members(raw: bytes) -> Iterator[bytes]:
    """Decompressed pieces of a gzip file of several members, as far as they are whole."""
    at = 0
    while at < len(raw):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(raw):
            part = raw[at : at + (1 << 16)]
            try:
                out = member.decompress(part)
            except zlib.error:
                return
            at += len(part) - len(member.unused_data)
            yield out


class _Stream(io.RawIOBase):
    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.rest = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = piece
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def parse(raw: bytes) -> Iterator[tuple]:
    """Records of a WARC file's bytes, plain or gzipped, as tuples of RECORDS; a cut off last record is left out."""
    stream = io.BufferedReader(_Stream(_members(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    while True:
        lines = []
        try:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            while line not in (b"", b"\r\n", b"\n"):
                lines.append(line)
                line = stream.readline()
            version, fields = _headers(b"".join(lines))
            if not version.startswith("WARC/"):
                return
            size = int(fields.get("content-length", "0"))
            body = stream.read(size)
        except (EOFError, OSError, ValueError):
            return
        if len(body) < size:
            return
        status, http, payload = None, {}, body
        if fields.get("content-type", "").startswith("application/http"):
            head, gap, payload = body.partition(b"\r\n\r\n")
            first, http = _headers(head)
            word = first.split()
            status = int(word[1]) if len(word) > 1 and word[1].isdigit() else None
        digest = fields.get("warc-payload-digest")
        yield (fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-type"), fields.get("warc-profile"), digest, fields.get("warc-refers-to"), status, http, payload)


def read(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of all WARC files below a path that Spark can read.  A file is one task's memory, so files should be of the usual 1 GB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = [list(c) for c in zip(*rows, strict=True)]
            cols[8] = [list(x.items()) for x in cols[8]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            for raw in batch.column(0):
                rows: list[tuple] = []
                for record in parse(raw.as_py()):
                    rows.append(record)
                    if len(rows) == 64:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    text = RECORDS.replace("fetched timestamp", "fetched string")
    return map_arrow(files, run, text).withColumn("fetched", F.to_timestamp("fetched"))


def latest_response(records: DataFrame, scratch: Scratch) -> DataFrame:
    """(record_id, base) of every revisit (url_key, fetched, record_id, full): the id of the latest earlier full response of its URL, or null."""
    kind = dict(records.dtypes)["record_id"]
    order = ["url_key", "fetched", "record_id"]
    ranged = records.select(*order, "full").repartitionByRange(partitions(records), *order).sortWithinPartitions(*order)
    schema = f"part int, url_key string, record_id {kind}, base {kind}, state int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, url, base, first, id_type = TaskContext.get().partitionId(), None, None, True, None
        for batch in batches:
            out = []
            id_type = batch.column(2).type
            for key, rid, full in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if key != url:
                    first = url is None
                    url, base = key, None
                if full:
                    base = rid
                else:
                    out.append((part, key, rid, base, 1 if first and base is None else 0))  # 1: may have one before this partition
            if out:
                yield _batch(out, id_type)
        if base is not None:
            yield _batch([(part, url, None, base, 2)], id_type)  # the last URL's last response, for the partitions that follow

    def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.string(), id_type, id_type, pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "url_key", "record_id", "base", "state"])

    scanned = scratch.keep(map_arrow(ranged, run, schema), "scanned")
    ends = scanned.where("state = 2").select("part", "url_key", "base").union(scanned.where("state = 1").select("part", "url_key", F.lit(None).cast(kind)).distinct())
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    filled = ends.groupBy("part", "url_key").agg(F.max("base").alias("base")).withColumn("earlier", F.last("base", ignorenulls=True).over(before))  # two rows a partition at most
    open_ = scanned.where("state = 1").select("part", "url_key", "record_id").join(F.broadcast(filled), ["part", "url_key"], "left")
    return scanned.where("state = 0").select("record_id", "base").unionByName(open_.select("record_id", F.col("earlier").alias("base")))


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, url, fetched, base, outcome, headers, digest) of every not-modified revisit among records (record_id, url, fetched, type, status, digest, headers, and profile if there is one).

    headers and digest are the merged ones if the outcome is validated, else the revisit's own.
    """
    scratch = Scratch(records.sparkSession, "revisits")
    known = records.where("record_id is not null and url is not null and fetched is not null and type in ('response', 'revisit')")
    known = known.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>"))).withColumn("url_key", canonical(F.col("url"))).withColumn("full", F.col("type") == "response")
    by_payload = F.coalesce(F.rtrim(F.col("profile"), F.lit("/")).endswith(IDENTICAL), F.lit(False)) if "profile" in records.columns else F.lit(False)
    known = known.where(F.when(F.col("full"), F.coalesce("status", F.lit(200)) == 200).otherwise(~by_payload | (F.coalesce("status", F.lit(0)) == 304)))
    light = scratch.keep(known.select("record_id", "url", "url_key", "fetched", "full", "digest", "headers"), "light")
    base = latest_response(light, scratch).distinct()
    own = light.where("not full").join(base, "record_id", "left")
    old = light.where("full").select(F.col("record_id").alias("base"), F.col("digest").alias("old_digest"), F.col("headers").alias("old")).dropDuplicates(["base"])
    both = own.join(old, "base", "left")

    def agrees(new: Column, was: Column) -> Column:  # null where one of them has none
        return F.when(new.isNotNull() & was.isNotNull(), new == was)

    checks = F.array(agrees(F.col("digest"), F.col("old_digest")), *(agrees(F.col("headers")[h], F.col("old")[h]) for h in ("etag", "last-modified")))
    outcome = F.when(F.col("base").isNull(), "orphan").when(F.exists(checks, lambda x: x.isNotNull() & ~x), "conflict").when(F.exists(checks, lambda x: x.isNotNull()), "validated").otherwise("unchecked")
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    good = F.col("outcome") == "validated"
    return both.withColumn("outcome", outcome).select("record_id", "url", "fetched", "base", "outcome", F.when(good, merged).otherwise(F.col("headers")).alias("headers"), F.when(good, F.coalesce("old_digest", "digest")).otherwise(F.col("digest")).alias("digest"))


def expand(records: DataFrame) -> DataFrame:
    """The validated revisits as full records: those of resolve with the payload of their response."""
    payload = records.where("type = 'response' and record_id is not null").select(F.col("record_id").alias("base"), "payload").dropDuplicates(["base"])
    return resolve(records).where("outcome = 'validated'").join(payload, "base")


def demo_records(pages: DataFrame) -> DataFrame:
    """Records made from pages by fixed rules, for the query.  i is the page_id, times are hours.

    A response 2 * i at hour 37 * i mod 1000, with digest, ETag, Last-Modified, Date and Cache-Control; and a revisit 2 * i + 1 of its URL
    1 + i mod 400 hours later if i is not 0 mod 5, with a new Date and Cache-Control, the ETag if i is not 6 mod 7 (a wrong one if i mod 9 = 4), and the digest if i mod 3 = 0.
    """
    i, at = F.col("page_id"), F.pmod(F.col("page_id") * 37, F.lit(1000))
    later = at + 1 + F.pmod(i, F.lit(400))
    digest, text = F.md5(F.coalesce("html", F.lit(""))), lambda *x: F.concat(*(y.cast("string") if isinstance(y, Column) else F.lit(y) for y in x))
    pair = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    made = lambda *pairs: F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()))
    light = pages.where("page_id is not null").select("page_id", "url", digest.alias("digest"))
    first = light.select(
        (i * 2).alias("record_id"), "url", at.alias("fetched"), F.lit("response").alias("type"), F.lit(200).alias("status"), "digest",
        made(pair("content-type", F.lit("text/html")), pair("etag", text("e", i)), pair("last-modified", text("h", at)), pair("date", text("h", at)), pair("cache-control", F.lit("max-age=60"))).alias("headers"),
    )
    etag = F.when(F.pmod(i, F.lit(9)) == 4, F.lit("stale")).otherwise(text("e", i))
    second = light.where("pmod(page_id, 5) <> 0").select(
        (i * 2 + 1).alias("record_id"), "url", later.alias("fetched"), F.lit("revisit").alias("type"), F.lit(304).alias("status"), F.when(F.pmod(i, F.lit(3)) == 0, F.col("digest")).alias("digest"),
        made(pair("etag", F.when(F.pmod(i, F.lit(7)) != 6, etag)), pair("date", text("h", later)), pair("cache-control", F.lit("max-age=90")), pair("content-type", F.lit("ignored"))).alias("headers"),
    )
    return first.unionByName(second)


SQL = r"""
with p as (select page_id as i, url, md5(coalesce(html, '')) as digest, page_id * 37 % 1000 as hour,
    regexp_replace(url, '#.*$', '') as plain from pages where page_id is not null),
k as (select i, url, digest, hour,
    regexp_replace(lower(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\.|:80$|:443$', '', 'g')
    || regexp_replace(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') as page,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'), lambda x: x <> '' and not starts_with(x, 'utm_'))), '&') as q from p),
f as (select i * 2 as id, hour, page || case when q <> '' then '?' || q else '' end as key, digest, 'e' || i as etag, 'h' || hour as modified from k where url is not null),
v as (select i * 2 + 1 as id, i, url, hour + 1 + i % 400 as hour, page || case when q <> '' then '?' || q else '' end as key, case when i % 3 = 0 then digest end as digest,
    case when i % 7 <> 6 then case when i % 9 = 4 then 'stale' else 'e' || i end end as etag from k where i % 5 <> 0 and url is not null),
b as (select v.id, arg_max(f.id, f.hour * 1e10 + f.id) as base from v join f on f.key = v.key and (f.hour < v.hour or f.hour = v.hour and f.id < v.id) group by v.id),
j as (select v.*, b.base, f.digest as old_digest, f.etag as old_etag, f.modified,
    case when b.base is null then 'orphan' when v.digest <> f.digest or v.etag <> f.etag then 'conflict' when v.digest = f.digest or v.etag = f.etag then 'validated' else 'unchecked' end as outcome
  from v left join b on v.id = b.id left join f on f.id = b.base)
select id as record_id, url, hour as fetched, base, outcome,
  case when outcome = 'validated' then 'cache-control: max-age=90; content-type: text/html; date: h' || hour || '; etag: ' || coalesce(etag, old_etag) || '; last-modified: ' || modified
    else 'cache-control: max-age=90; content-type: ignored; date: h' || hour || coalesce('; etag: ' || etag, '') end as headers,
  case when outcome = 'validated' then old_digest else digest end as digest
from j
"""
