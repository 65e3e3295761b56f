"""File sources and sinks: JSON, JSON lines, shards with a manifest, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litmill.sources.store import SnapshotTable

def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One object a file, in all files below a path; broken ones keep their text in ``_corrupt_record``."""
    r = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return (r.schema(schema) if schema else r).json(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, value): the lines that are not blank, in all .jsonl files below a path, numbered from one within their file.

    A line's number is that of the lines in the file's splits before its own, and its place in that: only one row per split
    is ever sorted by file, so a file of any size is numbered by many tasks.
    """
    from pyspark.sql import Window

    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("o"), "value")
    splits = lines.groupBy("file", "at").agg(F.min("o").alias("start"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at")) - F.col("n")
    placed = lines.join(splits.withColumn("before", before).drop("n"), ["file", "at"])
    # Blank lines count, so they are left out last.
    numbered = placed.withColumn("line_number", (F.col("before") + F.col("o") - F.col("start") + 1).cast("int"))
    return numbered.where(F.trim("value") != "").select("file", "line_number", "value")


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """``record`` and ``error`` of each line; a broken line is an error of its own row."""
    parsed = lines.withColumn("record", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    broken = F.try_parse_json("value").isNull()
    return parsed.withColumn("error", F.when(broken, "line is no JSON"))


def line(lines: DataFrame, number: int | None = None) -> DataFrame:
    """The line with a number, counted from nought over all lines of its file, or each file's first that is not blank."""
    if number is not None:
        return lines.where(F.col("line_number") == number + 1)
    first = lines.groupBy("file").agg(F.min("line_number").alias("line_number"))
    return lines.join(first, ["file", "line_number"], "left_semi")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line_number, record, error) of .json and .jsonl files by their ending; other files are errors of their own."""
    ending = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ending == "jsonl" or not ending:
        lines = parse_lines(read_json_lines(spark, path), schema)
        if ending:
            return lines.select("file", "line_number", "record", "error")
        objects = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.lit(1).alias("line_number"), "value")
        return lines.unionByName(parse_lines(objects, schema)).select("file", "line_number", "record", "error")
    if ending == "json":
        objects = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(1).alias("line_number"), "value")
        return parse_lines(objects, schema).select("file", "line_number", "record", "error")
    raise ValueError(f"no reader for .{ending}: {path}")


def write_shards(df: DataFrame, path: str, id_col: str, shard_rows: int, batch_rows: int) -> DataFrame:
    """Write rows by contiguous id range, ``shard=`` a folder each, with at most ``batch_rows`` rows a file; returns the manifest.

    The smallest id is one small aggregate; the ranges need no further shuffle but by shard.
    """
    low = df.agg(F.min(id_col)).first()[0] or 0
    shard = F.floor((F.col(id_col) - low) / shard_rows).cast("int")
    df.withColumn("shard", shard).repartition("shard").write.mode("overwrite").option("maxRecordsPerFile", batch_rows).partitionBy("shard").parquet(path)
    written = df.sparkSession.read.parquet(path)
    return written.groupBy("shard").agg(F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id"), F.count("*").alias("n_rows"))


def write_vector_shards(vectors: DataFrame, path: str, shard_rows: int, manifest: Manifest | None = None) -> DataFrame:
    """Vectors (id, embedding) scaled to length one and written by id range, so that an inner product is a cosine; (shard, min_id, max_id, n_rows, dims, path), noted in the manifest.

    Null and empty vectors are left out; one without length stays as it is.
    """
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.where("size(embedding) > 0").withColumn("_n", size).withColumn("embedding", F.transform("embedding", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x).cast("float"))).drop("_n")
    written = write_shards(unit, path, "id", shard_rows, shard_rows)
    dims = vectors.sparkSession.read.parquet(path).groupBy("shard").agg(F.max(F.size("embedding")).alias("dims"))
    out = written.join(dims, "shard").withColumn("path", F.concat(F.lit(f"{path.rstrip('/')}/shard="), F.col("shard").cast("string")))
    if manifest is not None:
        manifest.add(out)
    return out


MANIFEST = "shard int, path string, min_id bigint, max_id bigint, n_rows bigint, dims int, writable boolean"


class Manifest:
    """What is known of the shards of an index, kept as a snapshot table."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.table = spark, SnapshotTable(spark, root, "manifest", ["shard"], buckets=1)

    def shards(self) -> DataFrame:
        return self.table.read() if self.table.exists() else self.spark.createDataFrame([], MANIFEST)

    def add(self, shards: DataFrame) -> int:
        """New shards; one that is there already is an error."""
        known = shards.join(self.shards().select("shard"), "shard", "left_semi").select("shard").limit(5).collect()
        if known:
            raise ValueError(f"shards are there already: {[r[0] for r in known]}")
        return self.table.merge(self._full(shards))

    def update(self, shards: DataFrame) -> int:
        """Changed columns of known shards; those not named stay, unknown shards are left out."""
        named = [c for c in shards.columns if c != "shard"]
        j = self.shards().alias("a").join(shards.alias("b"), "shard")
        return self.table.merge(j.select("shard", *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in named else F.col(f"a.{c}") for c in self.shards().columns if c != "shard"]))

    def totals(self) -> dict:
        r = self.shards().agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0)), F.max("max_id")).first()
        return {"shards": r[0], "rows": r[1], "max_id": r[2]}

    def _full(self, shards: DataFrame) -> DataFrame:
        kinds = dict(x.strip().split(" ") for x in MANIFEST.split(","))
        return shards.select(*[(F.col(c) if c in shards.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def split_errors(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows without error; those with one are written as JSON lines if a path is given."""
    if path:
        df.where("error is not null").write.mode("append").json(path)
    return df.where("error is null").drop("error")
