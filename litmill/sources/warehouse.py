"""The tables of the warehouse: set up, changed step by step, described and removed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.sources.store import SnapshotTable

#: Tables with their keys and columns.
TABLES: dict[str, tuple[list[str], str]] = {
    "papers": (["paper_id"], "paper_id int, work_id string, canonical_title string, canonical_abstract string, canonical_language string, canonical_publisher string, canonical_source_id bigint, submitted_at timestamp_ntz, online_at timestamp_ntz, published_at timestamp_ntz, merge_status string, created_at timestamp_ntz, updated_at timestamp_ntz"),
    "paper_sources": (["paper_source_id"], "paper_source_id bigint, paper_id int, source_name string, platform string, source_record_id string, source_url string, abstract_url string, pdf_url string, title string, abstract string, publisher string, language string, doi string, arxiv_id string, pubmed_id string, semantic_scholar_id string, submitted_at timestamp_ntz, online_at timestamp_ntz, published_at timestamp_ntz, updated_at_source timestamp_ntz, version string, is_preprint boolean, is_published boolean, is_primary_source boolean, sync_status string, updated_at timestamp_ntz"),
    "paper_source_metadata": (["paper_source_id"], "paper_source_id bigint, raw_json string, normalized_json string, parser_version string"),
    "paper_author_affiliation": (["paper_id"], "paper_id int, authors array<struct<name:string,sequence:int,affiliations:array<string>>>"),
    "paper_keywords": (["paper_id", "keyword_type", "keyword", "source"], "paper_id int, keyword_type string, keyword string, weight float, source string, created_at timestamp_ntz"),
    "paper_references": (["paper_id", "reference_order"], "paper_id int, reference_order int, reference_raw string"),
    "categories": (["cat_id"], "cat_id int, domain string, subdomain string"),
    "paper_categories": (["paper_id", "cat_id"], "paper_id int, cat_id int, is_primary boolean"),
    "embedding_status": (["paper_id"], "paper_id int, status string, attempt_count int, error string, updated_at timestamp_ntz"),
    "update_log": (["log_id"], "log_id string, paper_id int, field string, old_value string, new_value string, source string, at timestamp_ntz"),
}
Step = Callable[["Warehouse"], None]


class Warehouse:
    """Snapshot tables below one root folder, and which changes of their form have been made."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[list[str], str]] | None = None) -> None:
        self.spark, self.root, self.forms = spark, root, tables if tables is not None else TABLES

    def table(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, self.root, name, self.forms[name][0])

    def setup(self) -> list[str]:
        """Create the tables that are missing, empty; their names."""
        made = []
        for name, (_, columns) in self.forms.items():
            if not self.table(name).exists():
                self.table(name).write(self.spark.createDataFrame([], columns))
                made.append(name)
        return made

    def migrate(self, steps: dict[str, Step]) -> list[str]:
        """Run the steps that have not been run, in the order of their names; each is noted once it is done."""
        log = SnapshotTable(self.spark, self.root, "_steps", ["name"], buckets=1)
        done = {r[0] for r in log.read().collect()} if log.exists() else set()  # one row per step
        run = []
        for name in sorted(set(steps) - done):
            steps[name](self)
            log.merge(self.spark.createDataFrame([(name,)], "name string"))
            run.append(name)
        return run

    def add_column(self, name: str, column: str, kind: str) -> None:
        """A new column, null in all rows; one that is there already is left alone."""
        t = self.table(name)
        if column not in dict(t.columns()):
            t.write(t.read().withColumn(column, F.lit(None).cast(kind)))

    def columns(self) -> DataFrame:
        """(table_name, position, column_name, column_type) of all tables that exist."""
        rows = [(n, i, c, k) for n in self.forms if self.table(n).exists() for i, (c, k) in enumerate(self.table(n).columns())]
        return self.spark.createDataFrame(rows, "table_name string, position int, column_name string, column_type string")

    def check(self) -> dict[str, list[str]]:
        """Columns that tables lack; all of a table's if it does not exist."""
        lacks = {n: self.table(n).missing_columns([c.strip().split(" ")[0] for c in _split(columns)]) for n, (_, columns) in self.forms.items()}
        return {n: c for n, c in lacks.items() if c}

    def sizes(self) -> DataFrame:
        """(table_name, rows, bytes, size) of the tables that exist; the bytes of all their versions."""
        rows = []
        for n in self.forms:
            t = self.table(n)
            if t.exists():
                fs, p = t._fs(t.path)
                rows.append((n, t.read().count(), fs.getContentSummary(p).getLength()))
        out = self.spark.createDataFrame(rows, "table_name string, rows bigint, bytes bigint")
        return out.withColumn("size", byte_size(F.col("bytes")))

    def clean(self) -> int:
        """Remove all tables and what is noted of their changes; how many tables there were."""
        SnapshotTable(self.spark, self.root, "_steps", ["name"]).drop()
        return sum(self.table(n).drop() for n in self.forms)


def _split(columns: str) -> list[str]:
    """Parts of a list of columns at its outer commas."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def byte_size(n):
    """A number of bytes in the largest unit that leaves one or more, with two digits."""
    out = F.concat(F.format_number(n, 0), F.lit(" B"))
    for i, unit in enumerate(["KB", "MB", "GB", "TB", "PB"], 1):
        out = F.when(n >= 1024**i, F.concat(F.format_number(n / float(1024**i), 2), F.lit(f" {unit}"))).otherwise(out)
    return out
