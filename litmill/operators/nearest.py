"""Exact nearest neighbours of a set of query vectors among all vectors, in blocks of queries.

Rows never meet queries in a join: a block of queries is a small matrix that is sent to the tasks, each
Arrow batch is multiplied with it, and only the batch's best rows leave the task. Larger query sets
take more blocks, each of bounded size; the best rows of every few blocks are written before the next
are begun, so that neither the plan nor what the driver holds grows with the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.operators.latest import top_per_key
from litmill.session import settle

#: Queries of a block. With vectors of 4,096 numbers a block takes 64 MB.
BLOCK = 2048
#: Blocks in one plan.
TOGETHER = 8


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, group: str | None = None, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(query_id, id, [group,] score): the ``k`` best rows of each query, or of each query and group.

    ``vectors`` has (id, embedding, [group]), ``queries`` (query_id, embedding). Null and empty vectors are
    never found; vectors without length have the cosine 0. A row may find itself. Ties go to the smallest id.
    Scores are rounded to six digits.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)
    keep = ["id", *([group] if group else [])]
    rows = vectors.select(*keep, "embedding").where("size(embedding) > 0")
    schema = f"query_id bigint, id {kind['id']}, {f'`{group}` {kind[group]}, ' if group else ''}score double"
    found = None

    def search(matrix, ids):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q, names = matrix.value, ids
            for b in batches:
                x = np.stack(b["embedding"].to_numpy()).astype(np.float64)
                s = q @ (_unit(x) if metric == "cosine" else x).T
                s = np.round(s, 6)
                for g, at in [(None, np.arange(len(b)))] if group is None else [(g, np.asarray(i)) for g, i in b.groupby(group, dropna=False).indices.items()]:
                    part = s[:, at]
                    n = min(k, part.shape[1])
                    # All rows with a score not below the k-th, so that ties are left to the final order.
                    edge = np.partition(part, part.shape[1] - n, axis=1)[:, part.shape[1] - n]
                    qi, xi = np.nonzero(part >= edge[:, None])
                    out = pd.DataFrame({"query_id": names[qi], "id": b["id"].to_numpy()[at[xi]], "score": part[qi, xi]})
                    if group:
                        out[group] = b[group].to_numpy()[at[xi]]
                        out = out[["query_id", "id", group, "score"]]
                    yield out

        return run

    def blocks() -> Iterator[list]:
        held = []
        for r in queries.where("size(embedding) > 0").select(F.col("query_id").cast("long"), "embedding").toLocalIterator():
            held.append(r)
            if len(held) == block:
                yield held
                held = []
        if held:
            yield held

    best = lambda df: top_per_key(df, ["query_id", *([group] if group else [])], [F.desc("score"), F.asc("id")], k)
    done, sent = None, []
    for held in blocks():
        if len(sent) == TOGETHER:
            # Queries of one block are in no other, so what is written is final.
            part = settle(best(found))
            done = part if done is None else settle(done.unionByName(part))
            for x in sent:
                x.unpersist()
            found, sent = None, []
        m = np.array([r[1] for r in held], dtype=np.float64)
        shared = spark.sparkContext.broadcast(_unit(m) if metric == "cosine" else m)
        sent.append(shared)
        part = rows.mapInPandas(search(shared, np.array([r[0] for r in held], dtype=np.int64)), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return best(found) if done is None else done.unionByName(best(found))


def prioritised(hits: DataFrame, priority: dict[int, int], k: int) -> DataFrame:
    """The hits of each query in order of their group's priority, then score; a work found in several groups counts in the first."""
    p = F.coalesce(*[F.when(F.col("label") == g, F.lit(n)) for g, n in priority.items()], F.lit(len(priority)))
    ranked = hits.withColumn("priority", p)
    once = top_per_key(ranked, ["query_id", "id"], [F.asc("priority"), F.desc("score")])
    return top_per_key(once, ["query_id"], [F.asc("priority"), F.desc("score"), F.asc("id")], k)


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """Weighted sum of vector and keyword scores, a missing one counting as 0."""
    v = vector_hits.select("query_id", "id", F.col("score").alias("vector_score"))
    w = keyword_hits.select("query_id", "id", F.lit(1.0).alias("keyword_score")).distinct()
    both = v.join(w, ["query_id", "id"], "full_outer").fillna(0.0, ["vector_score", "keyword_score"])
    both = both.withColumn("score", F.round(weight * F.col("vector_score") + (1 - weight) * F.col("keyword_score"), 6))
    return top_per_key(both, ["query_id"], [F.desc("score"), F.asc("id")], k)
