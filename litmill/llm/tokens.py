"""Token counts and projected vectors of whole texts, in one pass of a public tokenizer.

The tokenizer is a ranks file in tiktoken's format, given by its path; it must be present on
every executor under that path.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.session import spread

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Dimensions of the projection, bits kept of each.
DIMS, AXIS_BITS = 3, 16


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def projection(size: int) -> np.ndarray:
    """Weighted signs per token and dimension. Ids rise as tokens get rarer, so common tokens weigh less."""
    rng = np.random.default_rng(5)
    signs = rng.choice([-1.0, 1.0], size=(size, DIMS))
    return signs * np.log1p(np.arange(size) / 500.0)[:, None]


def count_and_project(texts: pd.Series, enc, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(len(texts), dtype=np.int64)
    points = np.zeros((len(texts), DIMS))
    for i, text in enumerate(texts):
        if not text:
            continue
        ids = enc.encode_to_numpy(text)
        counts[i] = len(ids)
        w = signs[ids]
        norm = np.sqrt((w[:, 0] ** 2).sum())
        points[i] = w.sum(axis=0) / norm if norm else 0.0
    return counts, points


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Position along the Hilbert curve (Skilling's transform) of points whose axes are about normal."""
    n, bits = DIMS, AXIS_BITS
    squeezed = 1.0 / (1.0 + np.exp(-1.7 * np.clip(points, -20, 20)))
    x = np.minimum((squeezed * (1 << bits)).astype(np.int64), (1 << bits) - 1).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(df: DataFrame, id_col: str, text_col: str, *keep: str, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id, *keep, n_tokens, curve): tokens of the whole text (0 for null or empty) and its place on the curve.

    The text itself does not leave the scan's tasks.
    """
    kinds = dict(df.dtypes)
    picked = spread(df.select(F.col(id_col).alias("id"), *[F.col(c) for c in keep], F.col(text_col).alias("_text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)  # once a task
        signs = projection(enc.n_vocab)
        for b in batches:
            counts, points = count_and_project(b["_text"], enc, signs)
            out = b.drop(columns="_text")
            out["n_tokens"], out["curve"] = counts, hilbert_keys(points)
            yield out

    schema = ", ".join([f"id {kinds[id_col]}", *[f"`{c}` {kinds[c]}" for c in keep], "n_tokens bigint", "curve bigint"])
    return picked.mapInPandas(run, schema)


def pieces(n_tokens: Column, capacity: Column) -> Column:
    """Array of (piece, start, size): the whole text, or full pieces and a rest if it is longer than the capacity."""
    last = F.greatest(F.ceil(n_tokens / capacity), F.lit(1)) - 1
    return F.transform(
        F.sequence(F.lit(0).cast("long"), last.cast("long")),
        lambda i: F.struct(i.cast("int").alias("piece"), (i * capacity).alias("start"), F.least(capacity, n_tokens - i * capacity).alias("size")),
    )
