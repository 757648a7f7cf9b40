"""Resolving revisit records of web archives that say "not modified".

A revisit has headers but no payload. It stands for the latest earlier full response of its
canonical URL, provided its validators agree with it: entity tags by weak comparison,
else the last-modified date, else the payload digest. The stored headers are then
brought up to date with those a not-modified answer may change.

The as-of join doesn't gather a URL in one place. Records are range-partitioned by URL and
time, so a frequent URL spreads over many partitions. Each partition finds the last
response before every record inside it, and hands its last response of a URL to the next
ones: a running value over partitions, not over records. Only keys and validators move;
payloads are joined at the end by record id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.session import cut_lineage

#: Headers a not-modified answer may update, and parameters that don't identify a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|msclkid)(=|$)"


def canonical_url(url: Column) -> Column:
    """The URL by which captures are matched.

    Scheme, user info, ``www.``, default port, fragment and tracking parameters go, the host is lower-cased,
    parameters are sorted, a closing slash is dropped. Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _header(name: str) -> Column:
    return F.try_element_at(F.col("headers"), F.lit(name))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^[Ww]/", "")


def latest_responses(keyed: DataFrame) -> DataFrame:
    """For each revisit with a URL: ``record_id`` and ``found``, the latest earlier response (null if none).

    ``keyed`` has record_id, site (canonical URL), captured_at, revisit and the validators. Of records of one time
    responses come first, then smaller ids.
    """
    order = ["captured_at", "revisit", "record_id"]
    placed = keyed.filter("site is not null").repartitionByRange("site", *order).withColumn("part", F.spark_partition_id())
    placed = cut_lineage(placed)
    response = F.when(~F.col("revisit"), F.struct(F.col("record_id").alias("response_id"), "etag", "modified", "digest"))
    inside = Window.partitionBy("site", "part").orderBy(*order)
    seen = placed.withColumn("own", F.last(response, ignorenulls=True).over(inside))
    # One row for each URL and partition it lies in.
    latest = F.max_by(response, F.when(~F.col("revisit"), F.struct(*[c for c in order if c != "revisit"])))
    ends = placed.groupBy("site", "part").agg(latest.alias("end"))
    before = Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.last("end", ignorenulls=True).over(before)).filter("carried is not null").select("site", "part", "carried")
    return (
        seen.filter("revisit")
        .join(ends, ["site", "part"], "left")
        .select("record_id", F.col("etag").alias("own_etag"), F.col("modified").alias("own_modified"), F.col("digest").alias("own_digest"), F.coalesce("own", "carried").alias("found"))
    )


def resolve(records: DataFrame) -> DataFrame:
    """Every record with its payload, resolved if it is a revisit.

    ``records``: record_id (long; rows of one id are one record, each is returned), url, captured_at, kind (``response`` or ``revisit``), headers (map, names in
    lower case), digest, payload. The result adds ``canonical_url``, ``response_id`` and ``resolution``:
    ``full`` (a response), ``etag``, ``last-modified`` or ``digest`` (what agreed), ``mismatch`` (the latest earlier
    response has other validators), ``unproven`` (the revisit has none to check, or the response none to check by),
    ``missing`` (no earlier response, or no URL). Payload and headers of unresolved revisits stay as
    they are. Null headers count as none, a null kind as a revisit, a null time as the earliest. Further columns are left out.
    """
    base = records.select("record_id", "url", "captured_at", (F.coalesce("kind", F.lit("")) != "response").alias("revisit"), "headers", "digest", "payload")
    keyed = base.select(
        "record_id",
        canonical_url(F.col("url")).alias("site"),
        "captured_at",
        "revisit",
        _weak(_header("etag")).alias("etag"),
        F.trim(_header("last-modified")).alias("modified"),
        "digest",
    )
    found = latest_responses(keyed)
    # The first kind of validator that both sides have decides.
    checks = [(name, F.col(f"own_{c}"), F.col(f"found.{c}")) for name, c in (("etag", "etag"), ("last-modified", "modified"), ("digest", "digest"))]
    verdict = F.lit("unproven")
    for name, own, theirs in reversed(checks):
        verdict = F.when(own.isNotNull() & theirs.isNotNull(), F.when(own == theirs, F.lit(name)).otherwise(F.lit("mismatch"))).otherwise(verdict)
    verdict = F.when(F.col("found.response_id").isNull(), F.lit("missing")).otherwise(verdict)
    decided = found.select("record_id", verdict.alias("resolution"), F.col("found.response_id").alias("response_id"))
    decided = decided.groupBy("record_id").agg(F.max_by(F.struct("resolution", "response_id"), "response_id").alias("d")).select("record_id", "d.*")
    agreed = F.col("resolution").isin("etag", "last-modified", "digest")

    # Revisits with their headers, without payloads; then the payloads of the responses they stand for.
    revisits = base.filter("revisit").join(decided, "record_id", "left").withColumn("resolution", F.coalesce("resolution", F.lit("missing")))
    stored = base.filter("not revisit").select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"), F.col("payload").alias("stored_payload"), F.col("digest").alias("stored_digest"))
    stored = stored.groupBy("response_id").agg(*[F.first(c).alias(c) for c in stored.columns if c != "response_id"])
    none = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce("headers", none), lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.coalesce("stored", none), lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    columns = ["record_id", "url", canonical_url(F.col("url")).alias("canonical_url"), "captured_at", "resolution", "response_id", "headers", "digest", "payload"]
    # Only what agreed is joined: all others would meet under one key.
    resolved = (
        revisits.filter(agreed)
        .join(stored, "response_id")
        .withColumns({"headers": merged, "payload": F.col("stored_payload"), "digest": F.coalesce("stored_digest", "digest")})
        .select(*columns)
    )
    left = revisits.filter(~agreed).select(*columns)
    full = base.filter("not revisit").withColumns({"resolution": F.lit("full"), "response_id": F.col("record_id")}).select(*columns)
    return full.unionByName(resolved).unionByName(left)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records of a table of pages: the capture of each, and revisits of it under other spellings of its URL.

    Of every page one revisit checks the entity tag (a stale one on some pages) and one, a day later, the date (none on
    some). On some pages one more comes before the capture.
    """
    n, start = F.col("page_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    tag = F.md5(F.coalesce("html", F.lit("")))
    date = F.concat(F.lit("day "), n.cast("string"))
    text = lambda **pairs: F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in pairs]), F.array(*pairs.values()))
    quoted = F.concat(F.lit('"'), tag, F.lit('"'))
    stale = F.when(n % 7 == 3, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), quoted))
    noted = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), F.lit("&utm_source=rss")).otherwise(F.lit("?utm_source=rss")))
    hour = F.expr("make_dt_interval(0, 1)")

    def record(place: int, url: Column, at: Column, kind: str, headers: Column, payload: Column) -> Column:
        return F.struct(
            (n * 4 + place).alias("record_id"), url.alias("url"), at.alias("captured_at"), F.lit(kind).alias("kind"), headers.alias("headers"), F.lit(None).cast("string").alias("digest"), payload.alias("payload")
        )

    none = F.lit(None).cast("string")
    of_capture = text(etag=quoted, last_modified=date, content_type=F.lit("text/html"), cache_control=F.lit("max-age=60"))
    of_tag = text(etag=stale, cache_control=F.lit("max-age=600"), content_length=F.lit("0"))
    of_date = F.when(n % 3 == 1, text(expires=F.lit("never"))).otherwise(text(last_modified=date, expires=F.lit("never")))
    rows = [
        record(0, F.col("url"), start, "response", of_capture, F.col("html")),
        record(1, F.concat(F.col("url"), F.lit("#again")), start + hour * (n % 5 + 1), "revisit", of_tag, none),
        record(2, noted, start + hour * 24, "revisit", of_date, none),
    ]
    early = record(3, F.col("url"), start - hour, "revisit", of_tag, none)
    every = F.array(*rows)
    return pages.filter("page_id is not null").select(F.inline(F.when(n % 4 == 0, F.array(*rows, early)).otherwise(every)))
