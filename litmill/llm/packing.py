"""Filling fixed-capacity containers with neighbouring texts.

Hashed document vectors are projected to few dimensions and range-sorted by their place on a
Hilbert curve. Each task packs its stretch of the curve: it takes a window of neighbours, largest
first, and puts each into the open container with the least room that still holds it. Containers
with room stay open for the next windows, so only the last ones of a stretch stay part empty.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.tokens import pieces

#: Neighbours packed at a time, and containers kept open at most (the fullest are closed first): bounds of a task's memory
#: that cost room, never a text.
WINDOW, OPEN = 4096, 4096


class _Packer:
    """Best fit for one kind of container; yields nothing itself, only numbers containers."""

    def __init__(self, capacity: int, stretch: str) -> None:
        self.capacity, self.stretch, self.made = capacity, stretch, 0
        self.open: list[tuple[int, int]] = []  # (room, number), sorted

    def place(self, size: int) -> str:
        i = bisect_left(self.open, (size, -1))
        if i < len(self.open):
            room, number = self.open.pop(i)
        else:
            room, number = self.capacity, self.made
            self.made += 1
        room -= size
        if room > 0:
            insort(self.open, (room, number))
            if len(self.open) > OPEN:
                self.open.pop(0)
        return f"{self.stretch}-{number}"


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    packer, kind, waiting = None, None, []

    def flush(rows: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not rows:
            return
        df = pd.concat(rows, ignore_index=True).sort_values(["size", "id", "piece"], ascending=[False, True, True])
        df["container_id"] = [packer.place(int(s)) for s in df["size"]]
        yield df[["container_kind", "container_id", "id", "piece", "start", "size"]]

    held = 0
    for batch in batches:
        for k, part in batch.groupby("container_kind", sort=False):
            if k != kind:
                yield from flush(waiting)
                waiting, held, kind = [], 0, k
                first = part.iloc[0]
                packer = _Packer(int(first["capacity_tokens"]), f"{k}-{first['id']}-{first['piece']}")
            for lo in range(0, len(part), WINDOW):
                waiting.append(part.iloc[lo : lo + WINDOW])
                held += len(waiting[-1])
                if held >= WINDOW:
                    yield from flush(waiting)
                    waiting, held = [], 0
    if waiting:
        yield from flush(waiting)


def packed(sizes: DataFrame, kinds: list[tuple[str, int]], stretches: int | None = None) -> DataFrame:
    """(container_kind, container_id, id, piece, start, size) of (id, n_tokens, curve) for every kind (name, capacity).

    Every id is placed once per kind, whole if its n_tokens are within the capacity, else as pieces of the
    capacity and a rest. Empty texts take no room but are placed too. Kinds with a null name or a capacity
    below one are left out; a name that repeats keeps its smallest capacity. A container never mixes kinds.
    Stretches of the curve are packed apart, so which texts share a container depends on the number of shuffle partitions.
    Ids are taken to be unique; a repeated one is placed as often as it occurs.
    """
    known: dict[str, int] = {}
    for name, capacity in kinds:
        if name is not None and capacity is not None and capacity >= 1:
            known[name] = min(int(capacity), known.get(name, int(capacity)))
    spark = sizes.sparkSession
    schema = f"container_kind string, container_id string, id {dict(sizes.dtypes)['id']}, piece int, start bigint, size bigint"
    if not known:
        return spark.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).cast("long").alias("c")) for k, c in sorted(known.items())]))
    rows = sizes.withColumn("_kind", each).select("id", "curve", F.col("_kind.k").alias("container_kind"), F.col("_kind.c").alias("capacity_tokens"), "n_tokens")
    rows = rows.withColumn("_p", F.explode(pieces(F.col("n_tokens"), F.col("capacity_tokens"))))
    rows = rows.select("container_kind", "curve", "id", F.col("_p.piece").alias("piece"), F.col("_p.start").alias("start"), F.col("_p.size").alias("size"), "capacity_tokens")
    order = ["container_kind", "curve", "id", "piece"]
    n = [stretches] if stretches else []
    return rows.repartitionByRange(*n, *order).sortWithinPartitions(*order).mapInPandas(_pack, schema)
