"""Incremental ingest with Structured Streaming: raw files arrive in a folder, tables follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.sources.adapters import from_preprints
from litmill.sources.store import SnapshotTable


def stream_preprints(spark: SparkSession, folder: str, schema, store: SnapshotTable, checkpoint: str, quarantine: str | None = None, files_a_batch: int = 100):
    """A query that merges every batch of new raw files into a snapshot table keyed by DOI and version.

    Of the deliveries of a key the one with the largest record id stays, whichever batch brings it. A batch that is
    repeated after a failure merges the same rows again, so a record counts once. Records
    with an error go to the quarantine folder, if there is one. Runs until all present files are read.
    """
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        rows = from_preprints(batch).withColumn("key", F.concat_ws("|", "doi", F.coalesce("version", F.lit("0"))))
        if quarantine:
            rows.where("error is not null").write.mode("overwrite").json(f"{quarantine}/batch={number}")
        newest = rows.where("error is null and doi is not null").groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), "record_id").alias("r"))
        store.merge(newest.select("key", "r.*").drop("error"), order=["record_id"])

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their value per window and type; events later than ``late`` are left out of a stream. Works on batches too."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    per = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("w.start").alias("start"), "event_type", "n", "total")
