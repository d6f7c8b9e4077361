"""WARC: not-modified revisit resolution by an as-of join on the canonical URL.

Input: a capture log, one row per record::

    record_id long, kind string ('response' | 'revisit'), url string,
    captured timestamp, etag string, last_modified string,
    headers map<string,string>, payload_ref long, payload_digest string

Each revisit is joined with the latest *earlier* full response of the same
canonical URL (same instant: the smaller record_id is earlier). Validators
decide what the join is worth:

* ``resolved``: at least one validator that both sides carry agrees and none disagrees;
* ``unvalidated``: neither an etag nor a date is on both sides;
* ``mismatch``: a validator that both sides carry differs, so the stored
  response is not what the server compared against; nothing is merged;
* ``orphan``: no earlier response, or no usable URL.

Records may have a ``profile`` (``WARC-Profile``): a revisit for an identical
payload digest is resolved where its digest equals the stored one, and keeps its
own headers. Others count as not modified.

Header merging follows RFC 9111 section 3.2: a revisit's headers replace the
stored ones, except those that describe the stored payload or the connection.

A hot URL does not meet in one task: the latest response of each (URL, time
slice) is aggregated first, carried across the slices (one row each), and only
rows of one slice share a window. Null urls, validators and headers are
allowed; a null time is earlier than every other. Extra columns are ignored;
repeated rows are resolved each. Full responses pass through as ``full``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of RFC 9111 section 3.2 and RFC 9110 section 7.6.1.
KEPT_STORED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]

RECORD_COLUMNS = ["record_id", "kind", "url", "captured", "etag", "last_modified", "headers", "payload_ref", "payload_digest"]


def canonical_url(url: Column) -> Column:
    """Scheme and ``www.`` dropped, host in lower case, no fragment, tracking parameters or last slash."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    pairs = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(pairs, lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)="))), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host != "", whole)


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then clash, the one first in name order."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.aggregate(named, F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))))


def merged_headers(stored: Column, update: Column) -> Column:
    permitted = F.map_filter(_lowered(update), lambda k, _: ~k.isin(KEPT_STORED))
    rest = F.map_filter(_lowered(stored), lambda k, _: ~F.map_contains_key(permitted, k))
    return F.map_concat(rest, permitted)


def resolve_revisits(records: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """One row per record with ``status``, ``resolved_id`` and the effective payload and headers."""
    at = F.coalesce(F.col("captured").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    seconds = F.floor(F.unix_seconds(at.cast("timestamp"))).cast("long")
    if "profile" not in records.columns:
        records = records.withColumn("profile", F.lit(None).cast("string"))
    log = (
        records.select(*RECORD_COLUMNS, "profile")
        .withColumn("surt", canonical_url(F.col("url")))
        .withColumn("moment", at)
        .withColumn("slice", F.floor(seconds / slice_seconds).cast("long"))
    )
    is_full = F.col("kind") == "response"
    stored = F.struct("moment", "record_id", "etag", "last_modified", "headers", "payload_ref", "payload_digest")
    # Records without a usable URL take part alone: their own id spreads them.
    alone = log.where(F.col("surt").isNull())
    known = log.where(F.col("surt").isNotNull()).withColumn("full", F.when(is_full, stored))

    per_slice = known.where(is_full).groupBy("surt", "slice").agg(F.max_by("full", F.struct("moment", "record_id")).alias("newest"))
    marks = per_slice.unionByName(known.where(~is_full).select("surt", "slice").distinct(), allowMissingColumns=True).groupBy("surt", "slice").agg(F.first("newest", ignorenulls=True).alias("newest"))
    before = Window.partitionBy("surt").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("surt", "slice", F.last("newest", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("surt", "slice").orderBy("moment", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("near", F.last("full", ignorenulls=True).over(within)).join(carried, ["surt", "slice"], "left")
    placed = placed.withColumn("base", F.when(~is_full, F.coalesce("near", "carried"))).drop("full", "near", "carried")
    both = placed.unionByName(alone, allowMissingColumns=True)

    agree = lambda c: F.col(c) == F.col(f"base.{c}")  # noqa: E731  null where either side lacks it
    differs = F.coalesce(~agree("etag"), F.lit(False)) | F.coalesce(~agree("last_modified"), F.lit(False))
    # A revisit of the other profile vouches for its payload, whose digest is compared, and has its headers whole.
    identical = F.coalesce(F.col("profile").contains("identical-payload-digest"), F.lit(False))
    status = (
        F.when(is_full, "full").when(F.col("base").isNull(), "orphan")
        .when(identical, F.when(F.col("payload_digest").isNull(), "unvalidated").when(agree("payload_digest"), "resolved").otherwise("mismatch"))
        .when(differs, "mismatch")
        .when(agree("etag").isNull() & agree("last_modified").isNull(), "unvalidated").otherwise("resolved")
    )
    ok = F.col("status") == "resolved"
    return both.withColumn("status", status).select(
        "record_id", "kind", F.col("surt").alias("canonical_url"), "status",
        F.when(F.col("status").isin("resolved", "mismatch", "unvalidated"), F.col("base.record_id")).alias("base_id"),
        F.when(is_full, F.col("record_id")).when(ok, F.col("base.record_id")).alias("resolved_id"),
        F.when(is_full, F.col("payload_ref")).when(ok, F.col("base.payload_ref")).alias("payload_ref"),
        F.when(is_full, F.col("payload_digest")).when(ok, F.col("base.payload_digest")).alias("payload_digest"),
        F.when(is_full, _lowered(F.col("headers"))).when(ok & ~identical, merged_headers(F.col("base.headers"), F.col("headers"))).otherwise(_lowered(F.col("headers"))).alias("headers"),
    )


# --- reading and writing WARC files --------------------------------------------------------------


def write_record(kind: str, url: str, date: str, headers: dict[str, str], payload: bytes, status: str = "200 OK", profile: str | None = None) -> bytes:
    """One WARC/1.1 record with an HTTP response block."""
    http = f"HTTP/1.1 {status}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + payload
    head = [f"WARC-Type: {kind}", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    head += [f"WARC-Profile: {profile}"] if profile else []
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + http + b"\r\n\r\n"


def unpacked(data: bytes) -> bytes:
    """A file's bytes, plain or gzip, whole or by record; a broken member loses itself only."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while 0 <= at < len(data):
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(data[at:]))
            at = len(data) - len(member.unused_data) if member.eof else len(data)
        except zlib.error:
            at += 1
        at = data.find(b"\x1f\x8b", at)
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of a WARC file. A torn record is told (kind ``torn``, what is left of it as payload) and reading goes on behind it."""
    data, at = unpacked(data), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        following = data.find(b"\r\nWARC/", at + 5)
        end = data.find(b"\r\n\r\n", at)
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")[1:])}
        size = head.get("content-length") or "0"
        whole = end >= 0 and size.isdigit() and end + 4 + int(size) <= len(data) and (following < 0 or end < following)
        if not whole:
            to = following if following >= 0 else len(data)
            yield {"kind": "torn", "url": head.get("warc-target-uri"), "captured": head.get("warc-date"), "etag": None, "last_modified": None, "headers": {}, "profile": None, "payload": data[at:to]}
            at = to
            continue
        block = data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
        http, _, payload = block.partition(b"\r\n\r\n")
        lines = http.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} if lines[0].startswith("HTTP/") else {}
        yield {"kind": head.get("warc-type"), "url": head.get("warc-target-uri"), "captured": head.get("warc-date"), "etag": fields.get("etag"), "last_modified": fields.get("last-modified"), "headers": fields, "profile": head.get("warc-profile"), "payload": payload if fields else block}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files at ``path``, through Spark's binary reader, so any store works.

    A file is one value, of 2 GB at most; archives are written in files of about 1 GB.
    Dates that are none are null.
    """
    import pandas as pd

    columns = ["file", "place", "kind", "url", "captured", "etag", "last_modified", "headers", "profile", "payload"]

    def rows(parts):
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                held: list[dict] = []
                for i, r in enumerate(parse_records(bytes(data))):
                    held.append(r | {"file": name, "place": i})
                    if len(held) == 256:
                        yield pd.DataFrame(held)[columns]
                        held = []
                if held:
                    yield pd.DataFrame(held)[columns]

    schema = "file string, place int, kind string, url string, captured string, etag string, last_modified string, headers map<string,string>, profile string, payload binary"
    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)
    stamp = F.regexp_replace(F.trim("captured"), "[zZ]$", "").try_cast("timestamp_ntz")
    return found.withColumn("captured", stamp).withColumn("record_id", F.xxhash64("file", "place")).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_ref", F.col("record_id"))


def capture_log(pages: DataFrame) -> DataFrame:
    """A capture log for a table of raw pages (page_id, url, html), which has no revisits of its own.

    Every page is a full response at ``2024-01-01 + page_id mod 100000`` minutes.
    Pages with ``page_id mod 3 = 0`` were asked for again 90 minutes later under
    the same URL with a fragment. Of those, ids that 5 divides answered with a
    new etag, ids that 7 divides without any validator, and ids that 11 divides
    under a path never captured in full.
    """
    pid = F.col("page_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    minutes = F.pmod(pid, F.lit(100000))
    moment = start + F.make_dt_interval(mins=minutes.cast("int"))
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    base = pages.select("page_id", "url", digest.alias("digest"), moment.alias("moment"))
    stamp = F.date_format(F.col("moment"), "yyyy-MM-dd HH:mm:ss")
    full = base.select(
        (pid * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("moment").alias("captured"),
        F.col("digest").alias("etag"), stamp.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("ETag"), F.col("digest")).alias("headers"),
        pid.alias("payload_ref"), F.col("digest").alias("payload_digest"),
    )
    later = F.col("moment") + F.expr("INTERVAL '90' MINUTE")
    bare = (pid % 7 == 0) & (pid % 5 != 0)
    again = base.where(pid % 3 == 0).select(
        (pid * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"),
        F.concat(F.regexp_replace("url", "#.*$", ""), F.when(pid % 11 == 0, "/gone").otherwise(""), F.lit("#again")).alias("url"),
        later.alias("captured"),
        F.when(pid % 5 == 0, F.concat(F.lit("new-"), F.col("digest"))).when(~bare, F.col("digest")).alias("etag"),
        F.when(~bare & (pid % 5 != 0), stamp).alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/plain"), F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Date"), stamp).alias("headers"),
        F.lit(None).cast("long").alias("payload_ref"), F.lit(None).cast("string").alias("payload_digest"),
    )
    return full.unionByName(again)
