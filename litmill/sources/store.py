"""Keyed tables as versioned snapshots: folders of parquet per bucket of keys and a manifest per version.

Plain Spark has no table with MERGE. A write puts the buckets that it changes into new folders and then
creates the manifest of the next version, which names the folder of every bucket; a manifest is created
only if there is none of that number yet, so of two writers one fails and none destroys the other's rows.
Readers see a whole version, and a job that dies leaves the old one in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; a merge rewrites those that its keys fall into. Fixed when the table is first written.
BUCKETS = 16


class VersionConflict(RuntimeError):
    """Another writer has made the version first; its rows must be read before writing again."""


class SnapshotTable:
    """One keyed table below a root folder."""

    def __init__(self, spark: SparkSession, root: str, name: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, f"{root.rstrip('/')}/{name}", keys, buckets

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The current version; -1 for a table without any."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return -1
        done = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(n[9:-5]) for n in done if n.startswith("manifest-") and n.endswith(".json")], default=-1)

    def exists(self) -> bool:
        return self.version() >= 0

    def manifest(self, version: int | None = None) -> dict:
        """{"buckets": n, "schema": DDL, "folders": {bucket: folder}} of a version."""
        v = self.version() if version is None else version
        fs, p = self._fs(f"{self.path}/manifest-{v}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _load(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in sorted(manifest["folders"].items()) if buckets is None or int(b) in buckets]
        schema = manifest["schema"]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        return self._load(self.manifest(version))

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(n)).cast("int")

    def _commit(self, version: int, df: DataFrame, kept: dict[str, str], n: int) -> int:
        folder = f"v-{version}-{uuid.uuid4().hex[:8]}"
        df.withColumn("_bucket", self._bucket(n)).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, p = self._fs(f"{self.path}/{folder}")
        made = {s.getPath().getName().split("=")[1]: f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.getPath().getName().startswith("_bucket=")}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        text = json.dumps({"buckets": n, "schema": schema, "folders": {**kept, **made}})
        fs, p = self._fs(f"{self.path}/manifest-{version}.json")
        try:
            stream = fs.create(p, False)
        except Exception as e:  # the manifest is there already
            raise VersionConflict(f"version {version} of {self.path} was written by another job") from e
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        return version

    def write(self, df: DataFrame) -> int:
        """A new version with these rows alone."""
        return self._commit(self.version() + 1, df, {}, self.buckets)

    def merge(self, changes: DataFrame, order: list[str] | None = None) -> int:
        """Rows of ``changes`` replace those with their key or are added.

        With ``order`` the row that is largest by these columns stays, stored or new, so an old delivery that comes late
        loses; without it new rows replace stored ones, and of several new rows with one key an arbitrary one is kept.
        """
        v = self.version()
        cols = changes.columns
        newest = lambda df: df.groupBy(*self.keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select("_r.*")
        fresh = newest(changes) if order else changes.dropDuplicates(self.keys)
        if v < 0:
            return self._commit(0, fresh, {}, self.buckets)
        m = self.manifest(v)
        n = m["buckets"]
        touched = [r[0] for r in fresh.select(self._bucket(n).alias("b")).distinct().collect()]  # at most as many as there are buckets
        stored = self._load(m, touched)
        if order:
            rows = stored.unionByName(fresh, allowMissingColumns=True)
            cols = rows.columns
            out = newest(rows)
        else:
            out = stored.join(fresh.select(*self.keys), self.keys, "left_anti").unionByName(fresh, allowMissingColumns=True)
        kept = {b: f for b, f in m["folders"].items() if int(b) not in touched}
        return self._commit(v + 1, out.select(*stored.columns, *[c for c in out.columns if c not in stored.columns]), kept, n)

    def delete(self, keys: DataFrame) -> int:
        """Drop the rows whose key is in ``keys``, which may hold some of the key columns only."""
        on = [k for k in self.keys if k in keys.columns]
        v = self.version()
        m = self.manifest(v)
        gone = keys.select(*on).distinct()
        touched = [r[0] for r in gone.select(self._bucket(m["buckets"]).alias("b")).distinct().collect()] if on == self.keys else None
        left = self._load(m, touched).join(gone, on, "left_anti")
        kept = {b: f for b, f in m["folders"].items() if touched is not None and int(b) not in touched}
        return self._commit(v + 1, left, kept, m["buckets"])

    def vacuum(self, keep: int = 2) -> int:
        """Remove the manifests and the folders of buckets that none of the last ``keep`` versions needs; how many folders went."""
        v = self.version()
        alive = {f for k in range(max(0, v - keep + 1), v + 1) for f in self.manifest(k)["folders"].values()}
        fs, p = self._fs(self.path)
        gone = 0
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("manifest-") and int(name[9:-5]) <= v - keep:
                fs.delete(s.getPath(), False)
            elif name.startswith("v-") and int(name.split("-")[1]) <= v:
                parts = [x.getPath() for x in fs.listStatus(s.getPath()) if x.isDirectory()]
                dead = [x for x in parts if f"{name}/{x.getName()}" not in alive]
                for x in [s.getPath()] if len(dead) == len(parts) else dead:
                    fs.delete(x, True)
                gone += len(dead)
        return gone

    def drop(self) -> bool:
        """Remove the table with all its versions; whether there was one."""
        fs, p = self._fs(self.path)
        return bool(fs.delete(p, True)) if fs.exists(p) else False

    def get(self, keys: DataFrame) -> DataFrame:
        """The stored rows of whole keys; only their buckets are read."""
        m = self.manifest()
        wanted = keys.select(*self.keys).distinct()
        touched = [r[0] for r in wanted.select(self._bucket(m["buckets"]).alias("b")).distinct().collect()]
        return self._load(m, touched).join(wanted, self.keys, "left_semi")

    def has(self, keys: DataFrame) -> DataFrame:
        """The keys with ``stored``: whether there is a row of each."""
        found = self.get(keys).select(*self.keys, F.lit(True).alias("stored"))
        return keys.select(*self.keys).distinct().join(found, self.keys, "left").fillna(False, ["stored"])

    def columns(self) -> list[tuple[str, str]]:
        """(name, type) of the current version."""
        return self.read().dtypes if self.exists() else []

    def missing_columns(self, wanted: list[str]) -> list[str]:
        return [c for c in wanted if c not in dict(self.columns())]


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame, key: str = "paper_id") -> dict[str, DataFrame]:
    """Every table without the rows of the keys: one anti-join each.

    ``keys`` may give work ids instead; these are looked up in the table papers.
    """
    if key not in keys.columns and "work_id" in keys.columns:
        keys = tables["papers"].join(keys.select("work_id").distinct(), "work_id", "left_semi")
    gone = keys.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}
