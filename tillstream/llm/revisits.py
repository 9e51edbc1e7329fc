"""Not-modified revisits of web captures, resolved to the response they stand for.

A revisit record says that a page had not changed. It stands for the latest earlier full response of
the same canonical URL, if its validators agree with that response's; its permitted headers then
replace the response's, as a cache updates a stored response.

The as-of join runs over (URL, time bucket): windows inside a bucket find the latest response there,
and one row per URL and bucket carries the latest of the buckets before. A URL with a third of all
records thus spreads over its buckets, and headers travel with the rows, so no response that very many
revisits need is joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds of a time bucket.
BUCKET = 6 * 3600
FULL = 200

# Header fields that a 304 response may update (fixed values).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that do not select content.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"

HEADERS = "array<struct<name: string, value: string>>"


def canonical_url(url: Column) -> Column:
    """Host, path and sorted query without scheme, ``www.``, default port, fragment, tracking
    parameters and last slash; null where the URL has no host."""
    pattern = r"^(?i:https?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, pattern, 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, pattern, 2), "/+$", "")
    parts = F.split(F.regexp_replace(F.regexp_extract(url, pattern, 3), r"^\?", ""), "&")
    wanted = F.array_join(F.array_sort(F.filter(parts, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(wanted != "", F.concat(F.lit("?"), wanted)).otherwise("")))


def header_pairs(block: Column) -> Column:
    """Header lines ``Name: value`` as pairs; lines without a colon are left out."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda line: line.contains(":"))
    return F.transform(
        lines,
        lambda line: F.struct(
            F.trim(F.split(line, ":", 2)[0]).alias("name"), F.trim(F.split(line, ":", 2)[1]).alias("value")
        ),
    )


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields with the permitted ones of the revisit in place of theirs, by name."""
    none = F.array().cast(HEADERS)
    allowed = F.filter(F.coalesce(fresh, none), lambda h: F.lower(h["name"]).isin(PERMITTED))
    kept = F.filter(
        F.coalesce(stored, none), lambda h: ~F.exists(allowed, lambda n: F.lower(n["name"]) == F.lower(h["name"]))
    )
    by_name = F.transform(
        F.concat(kept, allowed),
        lambda h: F.struct(F.lower(h["name"]).alias("field"), h["name"].alias("name"), h["value"].alias("value")),
    )
    return F.transform(F.array_sort(by_name), lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value")))


def _strong(tag: Column) -> Column:
    """An entity tag without its mark of weakness: validators of a revisit are compared weakly."""
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(record_id, url_key, response_id, outcome, headers), one row per revisit record.

    ``records`` has record_id, url, at (seconds), kind (``response`` or ``revisit``), status, etag,
    last_modified and headers (pairs). Only a response of status 200 strictly earlier counts; of
    several at one time the largest id. The outcome is ``resolved``, ``changed`` (the entity tag, or
    without one the date, differs), ``unvalidated`` (no validator to compare), ``no_response`` or
    ``no_url``; only resolved ones have a response and headers. A null time is never earlier or
    later. Null headers are none; repeated rows count alike; extra columns are not read.
    """
    slim = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("at").cast("long").alias("at"),
        (F.col("kind") == "revisit").alias("revisit"), "status", "etag", "last_modified", "headers",
    )
    usable = slim.where(F.col("url_key").isNotNull() & F.col("at").isNotNull()).where(
        F.col("revisit") | (F.col("status") == FULL)
    ).withColumn("bucket", F.floor(F.col("at") / bucket))
    response = F.struct(
        "at", "record_id", "etag", "last_modified", F.col("headers").cast(HEADERS).alias("headers")
    )
    usable = usable.withColumn("response", F.when(~F.col("revisit"), response))

    inside = Window.partitionBy("url_key", "bucket").orderBy("at", F.desc("revisit"), "record_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = usable.groupBy("url_key", "bucket").agg(F.max("response").alias("latest")).select(
        "url_key", "bucket", F.last("latest", ignorenulls=True).over(earlier).alias("carried")
    ).where(F.col("carried").isNotNull())
    found = usable.withColumn("near", F.last("response", ignorenulls=True).over(inside)).where("revisit")
    found = found.join(carried, ["url_key", "bucket"], "left").withColumn("found", F.coalesce("near", "carried"))

    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    outcome = (
        F.when(F.col("found").isNull(), "no_response")
        .when(tags, F.when(_strong(F.col("etag")) == _strong(F.col("found.etag")), "resolved").otherwise("changed"))
        .when(dates, F.when(F.col("last_modified") == F.col("found.last_modified"), "resolved").otherwise("changed"))
        .otherwise("unvalidated")
    )
    found = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    decided = found.select(
        "record_id", "url_key",
        F.when(resolved, F.col("found.record_id")).alias("response_id"),
        "outcome",
        F.when(resolved, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
    )
    left_out = slim.where(F.col("revisit") & (F.col("url_key").isNull() | F.col("at").isNull())).select(
        "record_id", "url_key", F.lit(None).cast(slim.schema["record_id"].dataType).alias("response_id"),
        F.when(F.col("url_key").isNull(), "no_url").otherwise("no_response").alias("outcome"),
        F.lit(None).cast(HEADERS).alias("headers"),
    )
    return decided.unionByName(left_out)


def capture_records(pages: DataFrame) -> DataFrame:
    """Capture records of raw pages: for each page a response, and later a revisit of its URL.

    Times, status and validators follow from the page's id, so that some revisits find an error page,
    another page of the same URL, a changed tag, only a date or no validator at all.
    """
    page, tag = F.col("page_id"), F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day-"), F.floor(page / 100).cast("string"))

    def pairs(*named: tuple[str, Column]) -> Column:
        every = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in named])
        return F.filter(every, lambda h: h["value"].isNotNull())

    sent, asked = page * 60, page * 60 + 30 + 3600 * (page % 48)
    fresh_tag = (
        F.when(page % 7 == 3, F.lit('"stale"')).when(page % 7 >= 5, F.lit(None))
        .when(page % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    )
    fresh_day = F.when(page % 7 == 5, day)
    responses = pages.select(
        (page * 2).alias("record_id"), "url", sent.alias("at"), F.lit("response").alias("kind"),
        F.when(page % 11 == 10, 404).otherwise(200).alias("status"), tag.alias("etag"), day.alias("last_modified"),
        pairs(
            ("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length("html")), ("Date", sent),
            ("ETag", tag), ("Last-Modified", day),
        ).alias("headers"),
    )
    revisits = pages.select(
        (page * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), asked.alias("at"),
        F.lit("revisit").alias("kind"), F.lit(304).alias("status"), fresh_tag.alias("etag"),
        fresh_day.alias("last_modified"),
        pairs(
            ("Date", asked), ("ETag", fresh_tag), ("Expires", asked + 600), ("Content-Length", F.lit(0)),
        ).alias("headers"),
    )
    return responses.unionByName(revisits)
