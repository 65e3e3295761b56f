"""Mixing sources to target weights.

Documents are counted by source and exact token length. The size of the mixture is the largest at
which no source is used more often than it may be. A source's budget is spent on full rounds over
all its documents and, for the rest, on a number of documents of each length: shares rounded down,
single documents, and a bounded-knapsack table over the last tokens, so that the budget is met exactly
where the lengths allow. The documents of a length are picked in a seeded
order, by rank within a slice of that order, so that no task ranks a whole hot length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litmill.session import settle

#: Budget left to the knapsack table, in tokens; up to one document more. The table's bits are as many.
TABLE_TOKENS = 20_000
#: Documents of one length ranked together on average.
SLICE_DOCS = 20_000


def fit_budget(lengths: dict[int, int], budget: int, table: int = TABLE_TOKENS) -> dict[int, int]:
    """How many of the available documents of each length to take so that their lengths sum to the budget or just below.

    All but ``table`` tokens of the budget are shared out over all lengths alike; a bounded-knapsack table over what is
    left, whole documents of any length, finds the best sum. A budget within ``table`` is left to the table alone.
    """
    avail = {n: c for n, c in lengths.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in avail.items())
    if budget >= total:
        return dict(avail)
    share = max(0, budget - table) / total
    take = {n: int(c * share) for n, c in avail.items()}
    left = budget - sum(n * k for n, k in take.items())
    # Single documents, those whose count was rounded down most first, until the table can do the rest.
    for n in sorted(avail, key=lambda n: (-(avail[n] * share - take[n]), -n)):
        if left - n >= table and take[n] < avail[n]:
            take[n] += 1
            left -= n
    for n in sorted(avail, reverse=True):
        more = min(avail[n] - take[n], max(0, (left - table) // n))
        take[n] += more
        left -= more * n
    mask = (1 << (left + 1)) - 1
    reach, steps = 1, []
    for n in sorted(avail):
        spare, k = min(avail[n] - take[n], left // n), 1
        while spare > 0:
            k = min(k, spare)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            spare, k = spare - k, 2 * k
        if (reach >> left) & 1:
            break
    at = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not (before >> at) & 1:
            take[n] += k
            at -= n * k
    return {n: k for n, k in take.items() if k}


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one source: (source, n_tokens, docs, budget, total) -> (source, n_tokens, rounds, take)."""
    budget, total = int(rows["budget"].iloc[0]), int(rows["total"].iloc[0])
    rounds = budget // total if total else 0
    counts = dict(zip(rows["n_tokens"].astype(int), rows["docs"].astype(int), strict=True))
    extra = fit_budget(counts, budget - rounds * total)
    return pd.DataFrame({"source": rows["source"], "n_tokens": rows["n_tokens"], "rounds": rounds, "take": [extra.get(int(n), 0) for n in rows["n_tokens"]]})


def mixture(sizes: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """(id, source, n_tokens, n_uses) of the chosen documents; ``sizes`` has (id, source, n_tokens).

    ``targets`` has (source, target_share, max_repeats): a null or non-positive share or cap, a null
    source, or one without tokens takes no part, and the other shares are scaled to sum to one; a
    source that repeats counts with its largest share and cap. Documents without tokens are not used.
    No document is used more than max_repeats times. Empty input gives no rows.
    """
    aims = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    docs = sizes.where("n_tokens > 0").join(aims.select("source"), "source", "left_semi")
    counts = docs.groupBy("source", "n_tokens").agg(F.count("*").alias("docs"))
    totals = counts.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("total")).join(aims, "source")
    # The scale is the largest that no source's cap forbids; the window holds one row per target.
    scale = F.min(F.col("total") * F.col("cap") / F.col("share")).over(Window.partitionBy(F.lit(1)))
    budgets = totals.withColumn("scale", scale).select("source", "total", "cap", F.least(F.floor(F.col("share") * F.col("scale") + 1e-6), F.col("total") * F.col("cap")).alias("budget"))
    plan = (
        counts.join(budgets, "source")
        .groupBy("source")
        .applyInPandas(_plan, "source string, n_tokens bigint, rounds bigint, take bigint")
        .where("rounds > 0 or take > 0")
    )
    plan = settle(plan.join(counts, ["source", "n_tokens"]))  # read several times, made once
    slices = F.greatest(F.ceil(F.col("docs") / SLICE_DOCS), F.lit(1))
    placed = (
        docs.join(plan, ["source", "n_tokens"])
        .withColumn("_o", F.xxhash64(F.lit(seed), "id"))
        .withColumn("_slice", F.floor((F.col("_o") / 2.0**64 + 0.5) * slices).cast("int"))
    )
    some = placed.where("take > 0")
    per = some.groupBy("source", "n_tokens", "_slice").agg(F.count("*").alias("_n"))
    before = per.withColumn("_before", F.sum("_n").over(Window.partitionBy("source", "n_tokens").orderBy("_slice")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "_slice").orderBy("_o", "id"))
    ranked = some.join(before, ["source", "n_tokens", "_slice"]).withColumn("_rank", F.col("_before") + rank)
    uses = F.col("rounds") + F.when(F.col("_rank") <= F.col("take"), 1).otherwise(0)
    chosen = ranked.select("id", "source", "n_tokens", uses.cast("int").alias("n_uses"))
    rest = placed.where("take = 0").select("id", "source", "n_tokens", F.col("rounds").cast("int").alias("n_uses"))
    return chosen.unionByName(rest).where("n_uses > 0")


def reached_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_uses) for every target."""
    per = mix.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.count("*").alias("documents"), F.max("n_uses").alias("most_uses")
    )
    whole = F.sum("tokens").over(Window.partitionBy())  # one row per target
    out = targets.select("source", "target_share").join(per, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return out.withColumn("_all", whole).select(
        "source", "target_share", F.round(F.coalesce(tokens / F.col("_all"), F.lit(0.0)), 6).alias("actual_share"), tokens.alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
