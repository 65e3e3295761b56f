"""A store of vectors: databases of collections, one collection a source, each a snapshot table of documents.

A document is (id, text, work_id, source_name, text_type, paper_id, embedding). Searches embed their text with the same
embedder as the documents and are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.operators.latest import top_per_key
from litmill.operators.nearest import nearest
from litmill.operators.payloads import embed
from litmill.sources.store import SnapshotTable

DOCUMENT = "id string, text string, work_id string, source_name string, text_type string, paper_id string, embedding array<float>"
#: Fields that a query returns unless it names others.
FIELDS = ["id", "work_id", "paper_id", "source_name", "text_type", "text"]
#: What collections are called: this before the source's name.
PREFIX = "of_"


def equals(filter_: dict) -> Column:
    """All fields equal their values."""
    out = F.lit(True)
    for name, value in filter_.items():
        out = out & (F.col(name) == F.lit(value))
    return out


class VectorStore:
    """Collections below a root folder; ``sources`` are the names that may be stored."""

    def __init__(self, spark: SparkSession, root: str, database: str, sources: list[str], embedder: Callable[[DataFrame, str, str], DataFrame] = embed) -> None:
        self.spark, self.root, self.database, self.sources, self.embedder = spark, root.rstrip("/"), database, sources, embedder

    # ---- catalogue
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _folders(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def databases(self) -> list[str]:
        return self._folders(self.root)

    def ensure_database(self) -> bool:
        """Create the database if it is missing; whether it was."""
        fs, p = self._fs(f"{self.root}/{self.database}")
        return not fs.exists(p) and bool(fs.mkdirs(p))

    def drop_database(self) -> bool:
        fs, p = self._fs(f"{self.root}/{self.database}")
        return fs.exists(p) and bool(fs.delete(p, True))

    def collection(self, source: str) -> SnapshotTable:
        """The table of a source's collection, which need not exist yet; an unknown source is an error."""
        if source not in self.sources:
            raise ValueError(f"unknown source: {source}")
        return SnapshotTable(self.spark, f"{self.root}/{self.database}", f"{PREFIX}{source}", ["id"])

    def collections(self) -> list[str]:
        return self._folders(f"{self.root}/{self.database}")

    def ensure_collection(self, source: str) -> bool:
        """Create a source's collection if it is missing; whether it was."""
        self.ensure_database()
        table = self.collection(source)
        if table.exists():
            return False
        table.write(self.spark.createDataFrame([], DOCUMENT))
        return True

    def drop_collection(self, source: str) -> bool:
        return self.collection(source).drop()

    def describe(self, source: str) -> dict:
        """Whether a collection exists, its documents, those with a vector, and its fields."""
        table = self.collection(source)
        out = {"collection": f"{PREFIX}{source}", "source_name": source, "exists": table.exists(), "documents": 0, "indexed": 0, "fields": []}
        if out["exists"]:
            n = table.read().agg(F.count("*"), F.count("embedding")).first()
            out |= {"documents": n[0], "indexed": n[1], "fields": [c for c, _ in table.columns()]}
        return out

    def info(self) -> dict:
        """All sources with their collections, and how many exist."""
        every = [self.describe(s) for s in self.sources]
        return {"database": self.database, "collections": every, "existing": sum(c["exists"] for c in every), "documents": sum(c["documents"] for c in every)}

    # ---- documents
    def upsert(self, source: str, documents: DataFrame) -> DataFrame:
        """Store (work_id, text, [text_type], [paper_id]); (id, action) says which were inserted and which updated.

        A document's id is its work's. Rows without work id are left out, and of several rows of a work one is stored.
        """
        self.ensure_collection(source)
        table = self.collection(source)
        has = documents.columns
        d = documents.where("work_id is not null").select(
            F.col("work_id").alias("id"), "text", "work_id", F.lit(source).alias("source_name"),
            (F.coalesce("text_type", F.lit("abstract")) if "text_type" in has else F.lit("abstract")).alias("text_type"),
            (F.col("paper_id").cast("string") if "paper_id" in has else F.lit(None).cast("string")).alias("paper_id"),
        ).dropDuplicates(["id"])
        d = d.join(self.embedder(d, "id", "text"), "id", "left")
        before = table.version()
        known = table.read(before).select("id", F.lit("updated").alias("action"))
        table.merge(d)
        return d.select("id").join(known, "id", "left").select("id", F.coalesce("action", F.lit("inserted")).alias("action"))

    def delete(self, source: str, ids: DataFrame | None = None, filter_: dict | None = None, limit: int | None = None) -> int:
        """Remove documents by id, by equal fields, or both, at most ``limit`` of them by id; how many went. Without either nothing goes."""
        table = self.collection(source)
        if not table.exists() or (ids is None and not filter_):
            return 0
        gone = table.read().where(equals(filter_ or {})).select("id")
        if ids is not None:
            gone = gone.join(ids.select("id").distinct(), "id", "left_semi")
        if limit is not None:
            gone = gone.orderBy("id").limit(limit)
        n = gone.count()
        if n:
            table.delete(gone)
        return n

    def query(self, source: str, ids: list[str] | None = None, filter_: dict | None = None, limit: int | None = None, fields: list[str] | None = None) -> DataFrame:
        """Documents by id and equal fields, in the order of their ids; a missing collection has none."""
        table = self.collection(source)
        d = table.read() if table.exists() else self.spark.createDataFrame([], DOCUMENT)
        d = d.where(equals(filter_ or {}))
        if ids is not None:
            d = d.where(F.col("id").isin(ids)) if ids else d.limit(0)
        d = d.select(*(fields or FIELDS), *([] if "id" in (fields or FIELDS) else ["id"]))
        if limit is not None:
            d = d.orderBy("id").limit(limit)
        return d.select(*(fields or FIELDS))

    def search(self, queries: DataFrame, k: int, sources: list[str] | None = None, way: str = "dense") -> DataFrame:
        """(query_id, id, source_name, score): the ``k`` best documents of (query_id, text) over the sources' collections.

        Collections that do not exist are left out. Only dense search is there; another way is an error.
        """
        if way != "dense":
            raise NotImplementedError(f"search {way}")
        asked = self.embedder(queries.select(F.col("query_id").cast("long").alias("query_id"), "text"), "query_id", "text").withColumnRenamed("id", "query_id")
        every = None
        for s in sources if sources is not None else self.sources:
            table = self.collection(s)
            if table.exists():
                part = table.read().select("id", "source_name", "embedding")
                every = part if every is None else every.unionByName(part)
        if every is None:
            return self.spark.createDataFrame([], "query_id bigint, id string, source_name string, score double")
        hits = nearest(every, asked, k, group="source_name")
        return top_per_key(hits, ["query_id"], [F.desc("score"), F.asc("id"), F.asc("source_name")], k)
