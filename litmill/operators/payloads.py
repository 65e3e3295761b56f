"""Fan-out of normalised records to the tables, result rows, and a deterministic embedder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.text import collapse, filled

#: Numbers of the default embedder's vectors.
DIMS = 64


def fan_out(records: DataFrame, generated_source: str = "paper_metadata") -> dict[str, DataFrame]:
    """The six table payloads of normalised records (see sources.adapters); each a plain select of its columns.

    Lists are numbered from one; weights default to 1; blank keywords and references are left out.
    Records with an error give no rows.
    """
    ok = records.where("error is null")
    has = set(records.columns)
    empty = F.array().cast("array<string>")
    keywords = F.col("keywords") if "keywords" in has else F.when(F.col("keyword").isNotNull(), F.array("keyword")).otherwise(empty) if "keyword" in has else empty
    kind = F.lit("concept" if "keywords" in has else "category")
    references = F.col("references") if "references" in has else empty
    link = F.col("source_url") if "source_url" in has else F.col("abstract_url")
    institutions = F.transform("institutions", lambda i: F.struct(i.alias("name")))
    normalised = F.to_json(
        F.struct(
            F.struct("title", "abstract", "language", "publisher", F.col("authors").alias("authors"), keywords.alias("keywords")).alias("common"),
            F.struct("doi", "online_at", institutions.alias("institutions"), references.alias("references")).alias("source_specific"),
        )
    )
    return {
        "papers": ok.select("record_id", F.col("title").alias("canonical_title"), F.col("abstract").alias("canonical_abstract"), F.col("language").alias("canonical_language"), F.col("publisher").alias("canonical_publisher"), F.col("online_at").try_cast("date").alias("online_at")),
        "paper_sources": ok.select("record_id", "source_name", "doi", "title", link.alias("source_url"), F.col("online_at").try_cast("date").alias("online_at")),
        "paper_source_metadata": ok.select("record_id", normalised.alias("normalized_json")),
        "paper_author_affiliation": ok.select("record_id", "authors"),
        "paper_keywords": ok.select("record_id", F.explode(keywords).alias("k")).select("record_id", kind.alias("keyword_type"), collapse(F.col("k")).alias("keyword"), F.lit(1.0).alias("weight"), F.lit(generated_source).alias("source")).where("keyword <> ''"),
        "paper_references": ok.select("record_id", F.posexplode(references).alias("p", "r")).select("record_id", (F.col("p") + 1).alias("reference_order"), collapse(F.col("r")).alias("reference_raw")).where("reference_raw <> ''"),
    }


def result_rows(hits: DataFrame, papers: DataFrame, sources: DataFrame, authors: DataFrame) -> DataFrame:
    """Display rows of (query_id, paper_id, score): the canonical source's details, else the first source's; unknown papers are dropped.

    The DOI is the canonical source's, else the first that is known.
    """
    s = sources.groupBy("paper_id").agg(
        F.min_by(F.struct("source_name", F.coalesce("source_url", "abstract_url", "pdf_url").alias("link")), "paper_source_id").alias("first_source"),
        F.min_by("doi", F.when(F.col("doi").isNotNull(), F.col("paper_source_id"))).alias("first_doi"),
    )
    c = sources.select(F.col("paper_source_id").alias("canonical_source_id"), F.struct("source_name", F.coalesce("source_url", "abstract_url", "pdf_url").alias("link")).alias("canonical"), F.col("doi").alias("canonical_doi"))
    a = authors.select("paper_id", F.array_join(F.transform("authors", lambda x: x["name"]), ", ").alias("authors"))
    p = papers.select("paper_id", filled(F.col("canonical_title")).alias("title"), "canonical_source_id", "online_at")
    j = hits.join(p, "paper_id").join(c, "canonical_source_id", "left").join(s, "paper_id", "left").join(a, "paper_id", "left")
    shown = F.coalesce("canonical", "first_source")
    return j.select(
        "query_id", "paper_id", "title", "authors", shown["source_name"].alias("source_name"), shown["link"].alias("link"), F.coalesce("canonical_doi", "first_doi").alias("doi"),
        F.date_format("online_at", "yyyy-MM-dd").alias("day"), F.round("score", 4).alias("similarity"),
    )


NORMALISED = "common struct<title:string,abstract:string,language:string,publisher:string,authors:array<struct<sequence:int,name:string>>,keywords:array<string>>, source_specific struct<doi:string,online_at:string,institutions:array<struct<name:string>>,references:array<string>>"


def read_normalised(json: DataFrame, column: str = "normalized_json") -> DataFrame:
    """The fields of records that fan_out wrote as JSON, beside the other columns; null where the text is none."""
    r = json.withColumn("_r", F.from_json(column, NORMALISED))
    fields = [F.col(f"_r.common.{c}").alias(c) for c in ("title", "abstract", "language", "publisher", "authors", "keywords")]
    more = [F.col(f"_r.source_specific.{c}").alias(c) for c in ("doi", "online_at", "institutions", "references")]
    return r.select(*[c for c in json.columns], *fields, *more)


def source_label(name: Column, labels: dict[str, str], key: bool = False) -> Column:
    """What a source is shown as: the label of the longest prefix that it begins with, else its name; a dash without one. ``key`` gives a lower-case key, unknown without a name."""
    out = F.lower(name) if key else name
    for prefix in sorted(labels, key=len):
        out = F.when(F.startswith(name, F.lit(prefix)), labels[prefix].lower() if key else labels[prefix]).otherwise(out)
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown" if key else "-").otherwise(out)


def keyword_rows(records: DataFrame, keywords: str = "keywords") -> DataFrame:
    """(record_id, keyword_type, keyword, weight, source) of arrays of such structs: the type concept, the record's source and the weight 1 where they are missing; blank keywords are left out."""
    k = records.select("record_id", "source_name", F.explode(keywords).alias("k"))
    return k.select(
        "record_id", F.coalesce(filled(F.trim("k.keyword_type")), F.lit("concept")).alias("keyword_type"), filled(collapse(F.col("k.keyword"))).alias("keyword"),
        F.coalesce(F.col("k.weight").cast("double"), F.lit(1.0)).alias("weight"), F.coalesce(filled(F.trim("k.source")), "source_name").alias("source"),
    ).where("keyword is not null")


def full_papers(papers: DataFrame, sources: DataFrame, authors: DataFrame, keywords: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Papers with ``sources`` (undated first, then newest, then by id), ``authors``, ``keywords`` (by type and spelling) and ``references`` (in their order) as arrays of structs.

    Each child is reduced to one row per paper before the join; a paper's children must fit a row. Papers without children have null lists.
    """
    inner = [c for c in sources.columns if c != "paper_id"]
    order = F.struct(F.col("online_at").isNotNull().alias("a"), (-F.unix_micros(F.coalesce(F.col("online_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")))).alias("b"), F.col("paper_source_id").alias("c"))
    s = sources.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*inner).alias("r")))), lambda x: x["r"]).alias("sources"))
    k = keywords.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("keyword_type", "keyword", "weight", "source"))).alias("keywords"))
    out = papers.join(s, "paper_id", "left").join(authors.select("paper_id", "authors"), "paper_id", "left").join(k, "paper_id", "left")
    if references is not None:
        r = references.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("reference_order", "reference_raw"))).alias("references"))
        out = out.join(r, "paper_id", "left")
    return out


def embed(rows: DataFrame, id_col: str, text_col: str, dims: int = DIMS, seed: int = 0) -> DataFrame:
    """(id, embedding) of unit length from hashed words: a stand-in where no model is at hand. Texts without words are left out."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = rows.select(F.col(id_col).alias("id"), F.transform(words, lambda w: F.xxhash64(F.lit(seed), w)).alias("_h")).where("size(_h) > 0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), dims))
            for i, h in enumerate(b["_h"]):
                u = np.asarray(h, dtype=np.int64).view(np.uint64)
                np.add.at(out[i], (u % np.uint64(dims)).astype(int), np.where(u >> np.uint64(63), 1.0, -1.0))
            n = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.DataFrame({"id": b["id"], "embedding": list(np.divide(out, n, out=out, where=n > 0).astype(np.float32))})

    return hashed.mapInPandas(run, f"id {dict(rows.dtypes)[id_col]}, embedding array<float>")


def route_shards(manifest: DataFrame, corpus: str, routes: dict[str, list[int]], writable: bool | None = None) -> DataFrame:
    """The shards of a corpus key ('default', 'domain:x', 'source:x'); an unknown key falls back to default. Repeated shard ids count once."""
    wanted = list(dict.fromkeys(routes.get(corpus, routes.get("default", []))))
    out = manifest.where(F.col("shard").isin(wanted)) if wanted else manifest.limit(0)
    return out if writable is None else out.where(F.col("writable") == writable)


def notice(routed: DataFrame) -> DataFrame:
    """What to tell about a routed query (operators.understand): a message and an action."""
    return routed.withColumns(
        {
            "action": F.when(F.col("route") == "metadata_author", "show_author").when(F.col("route") == "author_suggestion", "offer_author").when(F.col("corrected_query").isNotNull(), "show_corrected").when(F.col("suggestion").isNotNull(), "offer_correction").otherwise("none"),
            "message": F.when(F.col("route").isin("metadata_author", "author_suggestion"), F.concat(F.lit("Author: "), "author")).when(F.col("suggestion").isNotNull(), F.concat(F.lit("Did you mean: "), "suggestion")),
        }
    )
