"""Keywords that models generate: their types, how they are cleaned and stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.text import collapse

# Types that a generated keyword may have, and the types of the labels that entity models give.
TYPES = ["domain", "concept", "method", "task", "disease", "gene", "protein", "model", "dataset", "metric", "organism", "chemical"]
LABELS = {
    "CHEMICAL": "chemical", "DISEASE": "disease", "GENE": "gene", "GGP": "gene", "GENE_OR_GENE_PRODUCT": "gene", "ORGANISM": "organism", "ORGANISM_SUBDIVISION": "organism",
    "ORGANISM_SUBSTANCE": "organism", "ORGAN": "concept", "CELL": "concept", "CELL_LINE": "concept", "CELL_TYPE": "concept", "CELLULAR_COMPONENT": "concept",
    "DEVELOPING_ANATOMICAL_STRUCTURE": "concept", "IMMATERIAL_ANATOMICAL_ENTITY": "concept", "ANATOMICAL_SYSTEM": "concept", "DNA": "gene", "RNA": "gene", "PROTEIN": "protein",
    "AMINO_ACID": "chemical", "SIMPLE_CHEMICAL": "chemical", "CANCER": "disease", "PATHOLOGICAL_FORMATION": "disease", "MULTI_TISSUE_STRUCTURE": "concept", "TISSUE": "concept", "ENTITY": "concept",
}
#: Most keywords of a paper that its entities give.
MOST = 12


def type_of(label: Column) -> Column:
    """The keyword type of an entity's label; concept for labels that are not known."""
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.upper(label)), F.lit("concept"))


def clean(c: Column) -> Column:
    """A keyword without blanks and marks at its ends, with single blanks."""
    return F.regexp_replace(F.regexp_replace(c, r"^[ \t\r\n.,;:()\[\]{}]+|[ \t\r\n.,;:()\[\]{}]+$", ""), r"\s+", " ")


def clamped(weight: Column) -> Column:
    """A weight between 0 and 1; 1 where there is none that can be read."""
    w = weight.cast("string").try_cast("double")
    return F.when(w.isNull() | F.isnan(w), 1.0).otherwise(F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)))


def count_entities(entities: DataFrame, most: int = MOST) -> DataFrame:
    """(paper_id, keyword_type, keyword, weight, position) of (paper_id, position, label, text): a paper's entities by how often they occur.

    Entities that differ by case are one, shown as the first; the weight is the share of the most frequent one's count, to
    three digits. ``most`` a paper, the more frequent first and the earlier among equals.
    """
    from litmill.operators.latest import top_per_key

    e = entities.select("paper_id", "position", type_of(F.col("label")).alias("keyword_type"), clean(F.col("text")).alias("text")).where("text <> ''")
    per = e.groupBy("paper_id", "keyword_type", F.lower("text").alias("key")).agg(F.count("*").alias("n"), F.min_by("text", "position").alias("keyword"), F.min("position").alias("position"))
    top = per.groupBy("paper_id").agg(F.max("n").alias("top"))
    best = top_per_key(per, ["paper_id"], [F.desc("n"), F.asc("position"), F.asc("keyword_type")], most)
    return best.join(top, "paper_id").select("paper_id", "keyword_type", "keyword", F.round(F.col("n") / F.col("top"), 3).alias("weight"), "position")


def upsert_generated(stored: DataFrame, generated: DataFrame, papers: DataFrame, source: str, allowed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(keywords, counters): the keywords (paper_id, keyword_type, keyword, weight, source) after those of a model are stored, and what became of these.

    ``generated`` has (paper_id, position, keyword_type, keyword, weight). Blank ones, types that are not allowed, papers that do not exist and
    repeats without regard to case are skipped, the first in order of position staying. A stored keyword of the source
    keeps its spelling and takes the new weight. ``counters`` has (paper_id, inserted, updated, skipped, unknown_types, error) of every paper with generated keywords.
    """
    g = generated.select("paper_id", "position", F.coalesce(F.trim("keyword_type"), F.lit("")).alias("keyword_type"), F.coalesce(collapse(F.col("keyword")), F.lit("")).alias("keyword"), clamped(F.col("weight")).alias("weight"))
    g = g.join(papers.select("paper_id", F.lit(True).alias("there")).distinct(), "paper_id", "left")
    unknown = ~F.col("keyword_type").isin(allowed if allowed is not None else TYPES)
    state = F.when(F.col("there").isNull(), "no paper").when((F.col("keyword_type") == "") | (F.col("keyword") == ""), "blank").when(unknown, "unknown type").otherwise("kept")
    g = g.withColumns({"state": state, "t": F.lower("keyword_type"), "k": F.lower("keyword")})
    once = g.where("state = 'kept'").groupBy("paper_id", "t", "k").agg(F.min_by(F.struct("keyword_type", "keyword", "weight"), "position").alias("g"))
    mine = F.lower("source") == source.lower()
    known = stored.where(mine).select("paper_id", F.lower("keyword_type").alias("t"), F.lower("keyword").alias("k"), F.lit(True).alias("old")).distinct()
    placed = once.join(known, ["paper_id", "t", "k"], "left")
    fresh = placed.where("old is null").select("paper_id", "g.keyword_type", "g.keyword", "g.weight", F.lit(source).alias("source"))
    new = once.select("paper_id", "t", "k", F.col("g.weight").alias("_w"))
    held = stored.where(mine).withColumns({"t": F.lower("keyword_type"), "k": F.lower("keyword")}).join(new, ["paper_id", "t", "k"], "left")
    kind = dict(stored.dtypes)["weight"]
    kept = held.select("paper_id", "keyword_type", "keyword", F.coalesce(F.col("_w").cast(kind), "weight").alias("weight"), "source")
    rest = stored.where(F.coalesce(~mine, F.lit(True))).select("paper_id", "keyword_type", "keyword", "weight", "source")
    per = g.groupBy("paper_id").agg(F.count("*").alias("n"), F.sum((F.col("state") == "unknown type").cast("long")).alias("unknown_types"), F.max(F.when(F.col("state") == "no paper", "paper does not exist")).alias("error"))
    made = placed.groupBy("paper_id").agg(F.sum(F.col("old").isNull().cast("long")).alias("inserted"), F.sum(F.col("old").isNotNull().cast("long")).alias("updated"))
    counters = per.join(made, "paper_id", "left").fillna(0, ["inserted", "updated"])
    counters = counters.select("paper_id", "inserted", "updated", (F.col("n") - F.col("inserted") - F.col("updated")).alias("skipped"), "unknown_types", "error")
    return rest.unionByName(kept).unionByName(fresh.withColumn("weight", F.col("weight").cast(kind))), counters
