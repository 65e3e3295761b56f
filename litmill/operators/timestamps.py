"""Mixed timestamp formats and zones to one UTC moment.

Method: texts are parsed to a local clock reading by Column expressions; readings
without a zone are matched, as of their time, with the offset intervals of the
publisher's zone. The intervals are exploded to one bucket per (zone, local year),
so the as-of match is an equi-join and the few intervals of a bucket are compared
inside the row. Two matching intervals mean an ambiguous reading (the earlier
moment counts), none a nonexistent one (read with the offset before the change),
one gives the offset directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions.moments import calendar_day, date_parts, epoch_us, local_us, time_parts, zone_minutes, zone_text

#: Local years for which intervals are listed; other years use Spark's zone rules, which agree.
FIRST_YEAR, LAST_YEAR = 1900, 2100
#: More interval rows than this are not broadcast by hint. All IANA zones together stay below.
BROADCAST_ROWS = 400_000
_US = 1_000_000


def zone_intervals(spark: SparkSession, zones: list[str]) -> DataFrame:
    """(zone, local_year, spans) with spans = sorted array of (start, stop, until, offset) in local seconds.

    An interval is valid for local readings in [start, until); ``stop`` extends it over a
    gap that follows, so that a skipped reading finds the offset before the change.
    Unknown zone names get no rows.
    """
    jvm = spark.sparkContext._jvm
    lo = jvm.java.time.Instant.parse(f"{FIRST_YEAR - 1}-01-01T00:00:00Z")
    last = jvm.java.time.Instant.parse(f"{LAST_YEAR + 2}-01-01T00:00:00Z").getEpochSecond()
    known = set(jvm.java.time.ZoneId.getAvailableZoneIds())
    rows: list[tuple] = []
    for zone in sorted(set(zones) & known):
        rules = jvm.java.time.ZoneId.of(zone).getRules()
        at, offset, t = lo.getEpochSecond(), rules.getOffset(lo).getTotalSeconds(), rules.nextTransition(lo)
        while True:
            end = t.getInstant().getEpochSecond() if t is not None else last
            after = t.getOffsetAfter().getTotalSeconds() if t is not None else offset
            rows.append((zone, at + offset, max(end + offset, end + after), end + offset, offset))
            if end >= last:
                break
            at, offset, t = end, after, rules.nextTransition(t.getInstant())
    spans = spark.createDataFrame(rows, "zone string, start long, stop long, until long, offset long")
    year = lambda c: F.year(F.timestamp_seconds(c))
    exploded = spans.withColumn(
        "local_year",
        F.explode(F.sequence(F.greatest(year(F.col("start")), F.lit(FIRST_YEAR)), F.least(year(F.col("stop")), F.lit(LAST_YEAR)))),
    )
    out = exploded.groupBy("zone", "local_year").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "until", "offset"))).alias("spans"))
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def normalise_moments(values: DataFrame, publishers: DataFrame, value: str = "value", publisher: str = "publisher") -> DataFrame:
    """Add ``utc_us`` and ``reading`` to rows that hold a delivered text and a publisher's name.

    ``reading`` is 'epoch', 'zoned', 'exact', 'ambiguous', 'skipped' or 'none'; ``utc_us`` is
    null exactly for 'none' (null, blank, unreadable, partial or nonexistent dates and unknown
    zone names). A missing or unlisted publisher, and one with an unknown zone, counts as UTC;
    repeated publisher names keep one zone (the smallest). Other columns pass through; helper
    columns are prefixed with ``_lm_`` and removed.
    """
    spark = values.sparkSession
    key = lambda c: F.lower(F.trim(c))
    zones = publishers.groupBy(key(F.col("publisher")).alias("_lm_key")).agg(F.min("time_zone").alias("_lm_zone"))
    # Bounded: there are about 600 IANA zones, however many publishers there are.
    names = [r[0] for r in zones.select("_lm_zone").distinct().collect() if r[0]]
    v = F.lower(F.regexp_replace(F.col(value), r"^[\s 　]+|[\s 　]+$", ""))
    df = values.withColumns({"_lm_v": v, "_lm_key": key(F.col(publisher))})
    df = df.withColumns({"_lm_epoch": epoch_us(F.col("_lm_v")), "_lm_parts": date_parts(F.col("_lm_v"))})
    df = df.withColumns({"_lm_day": calendar_day(F.col("_lm_parts")), "_lm_time": time_parts(F.col("_lm_parts"))})
    df = df.withColumns({"_lm_local": local_us(F.col("_lm_day"), F.col("_lm_time")), "_lm_named": zone_text(F.col("_lm_time"))})
    df = df.withColumn("_lm_minutes", zone_minutes(F.col("_lm_named")))
    df = df.join(zones, "_lm_key", "left").withColumn("_lm_sec", F.floor(F.col("_lm_local") / _US))
    spans = zone_intervals(spark, names).withColumnsRenamed({"zone": "_lm_zone", "local_year": "_lm_year", "spans": "_lm_spans"})
    df = df.withColumn("_lm_year", F.year(F.timestamp_seconds("_lm_sec"))).join(spans, ["_lm_zone", "_lm_year"], "left")
    sec = F.col("_lm_sec")
    near = F.filter("_lm_spans", lambda s: (s["start"] <= sec) & (sec < s["stop"]))
    df = df.withColumn("_lm_near", near)
    valid = F.filter("_lm_near", lambda s: sec < s["until"])
    first = F.element_at(F.transform("_lm_near", lambda s: s["offset"]), 1) * _US
    wide = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_lm_local"), F.coalesce("_lm_zone", F.lit("UTC"))))
    given, minutes = F.col("_lm_named").isNotNull(), F.col("_lm_minutes")
    local = F.col("_lm_local")
    listed = F.size("_lm_near") >= 1
    known = F.col("_lm_zone").isin(names) if names else F.lit(False)
    utc: Column = (
        F.when(F.col("_lm_epoch").isNotNull(), F.col("_lm_epoch"))
        .when(local.isNull() | (given & minutes.isNull()), F.lit(None))
        .when(given, local - minutes.cast("long") * 60 * _US)
        .when(listed, local - first)
        .when(known & F.col("_lm_spans").isNull() & ~F.col("_lm_year").between(FIRST_YEAR, LAST_YEAR), wide)
        .otherwise(local)
    )
    reading = (
        F.when(F.col("_lm_epoch").isNotNull(), "epoch")
        .when(utc.isNull(), "none")
        .when(given, "zoned")
        .when(listed & (F.size(valid) == 0), "skipped")
        .when(listed & (F.size(valid) > 1), "ambiguous")
        .otherwise("exact")
    )
    df = df.withColumns({"utc_us": utc, "reading": reading})
    return df.drop(*[c for c in df.columns if c.startswith("_lm_")])


def delivered_moments(papers: DataFrame, preprints: DataFrame, citations: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, value, publisher): the dated texts of the three tables, nulls left out."""

    def part(df: DataFrame, name: str, row_id: str, field: str, value: Column, publisher: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), F.lit(field).alias("field_name"),
            value.alias("value"), publisher.alias("publisher"),
        )

    dated = F.explode(
        F.array(
            F.struct(F.lit("submitted_at").alias("field_name"), F.col("submitted_at").alias("value")),
            F.struct(F.lit("published_at").alias("field_name"), F.col("published_at").alias("value")),
        )
    )
    from_papers = papers.select("paper_id", "canonical_publisher", dated.alias("x"))
    first = lambda key: F.get(F.col("meta").getItem(key), 0)
    return (
        from_papers.select(
            F.lit("papers").alias("table_name"), F.col("paper_id").cast("long").alias("row_id"),
            F.col("x.field_name"), F.col("x.value"), F.col("canonical_publisher").alias("publisher"),
        )
        .unionByName(part(preprints, "preprint_records", "record_id", "date", F.col("date"), F.col("server")))
        .unionByName(part(citations, "citation_records", "record_id", "citation_publication_date", first("citation_publication_date"), first("citation_publisher")))
        .where("value is not null")
    )
