"""Near-duplicate records by b-bit MinHash.

Texts are cut into runs of words (shingles). One text stands for all rows with the
same words. Its MinHash minima give band keys; texts that share a band key are
candidates. Of every minimum only the lowest ``BITS`` bits are kept, packed into
words of 64 bits, and the share of equal positions, counted with bit operations and
corrected for chance collisions, estimates the similarity of a candidate pair. The
estimate only gates an exact comparison of the shingle sets, which are made again
for the few texts that take part in a pair, so no set is kept or moved for the rest.

Words, shingles, minima and band keys are made in one pass over the texts, with array
operations over whole Arrow batches. Band keys travel packed: a batch's entries for
one stretch of keys are one row of 12 bytes an entry, and equal keys are found by
sorting. A key with more than ``BLOCK`` texts leaves that step as rows of its own and
is compared in blocks: its rows are dealt to blocks and every pair of blocks is a join
key of its own, so that no task holds the key's texts, and only pairs that pass the
estimate leave the join. No key is capped and no pair of a key is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.operators.components import components
from litmill.session import settle, spread

#: Minima per text, rows of a band, bits kept of a minimum.
HASHES, ROWS, BITS = 256, 4, 2
WORDS_64, BANDS = HASHES // 64, HASHES // ROWS
#: The estimate's standard error is about 0.04; pairs this far below the threshold are not compared exactly.
MARGIN = 0.16
#: Keys with more texts than this are joined in blocks of this size.
BLOCK = 256
#: Entries that a task holds before it looks for keys with more than BLOCK texts.
HELD = 4_000_000
#: Letters (bytes) worked on at once.
SLICE = 2_000_000
#: Most ids of paired texts that are sent to all tasks; more are joined by shuffle.
SENT_IDS = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def range_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Sum of values[i] * base ** (i - start) over each range [start, end), modulo 2 ** 64; base is odd."""
    back = pow(base, -1, 1 << 64)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * _powers(base, len(values)), dtype=np.uint64)])
    return (total[ends] - total[starts]) * _powers(back, len(values) + 1)[starts]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of a-z and 0-9 of the lower-case texts, one text after another; the words of each text)."""
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    letters = np.frombuffer(b"\n".join([*coded, b""]), dtype=np.uint8)
    inside = np.concatenate([[False], _LETTER[letters], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    owner = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), starts, side="right")
    return mixed(range_sums(letters.astype(np.uint64), starts, ends, int(_BASE))), np.bincount(owner, minlength=len(texts))


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``size`` words, of the whole text if it is shorter; the runs of each text), with repeats."""
    stop = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(words))
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(size):
        here = words[k:] * np.uint64((int(_BASE) * (2 * k + 1) | 1) & (2**64 - 1))
        here = np.concatenate([here, np.zeros(min(k, len(words)), dtype=np.uint64)])
        total += np.where(at + k < stop, here, np.uint64(0))
    first = at == stop - np.repeat(counts, counts)
    return mixed(total)[(at + size <= stop) | first], np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)


def _slices(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches of texts of about SLICE letters; a longer text is a stretch of its own."""
    size, lo = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > SLICE:
            yield lo, i
            size, lo = 0, i
        size += n + 1
    if lo < len(texts):
        yield lo, len(texts)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240611)
    odd = rng.integers(1, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def minhash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima, one row of HASHES 32-bit numbers per text; values holds the texts' shingles one after another."""
    a, b = _coefficients()
    out = np.empty((HASHES, len(starts)), dtype=np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    h = np.empty_like(x)
    for i in range(HASHES):
        np.multiply(x, a[i], out=h)
        h += b[i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum.reduceat(h, starts, out=out[i])
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x297A2D39)
    return np.ascontiguousarray((out ^ (out >> np.uint32(15))).T)


def pack_bits(minima: np.ndarray) -> np.ndarray:
    """The low bits of the minima as BITS planes of WORDS_64 words each."""
    planes = []
    for bit in range(BITS):
        low = ((minima >> np.uint32(bit)) & np.uint32(1)).astype(np.uint8)
        planes.append(np.packbits(low, axis=1, bitorder="little").view(np.int64))
    return np.hstack(planes)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 32-bit key per band."""
    rows = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(minima), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        key = mixed(key ^ rows[:, :, r])
    return (key >> np.uint64(32)).astype(np.uint32)


#: Texts whose entries, and pairs that, are packed together.
PACKED = 10_000


def _signer(size: int, stretches: int):
    """Texts (_id, _t) to rows of two kinds, to be shuffled by p: texts with their keys and signatures, and packed entries of band keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        us, keys, held = [], [], 0
        for df in batches:
            for lo, hi in _slices(df["_t"]):  # slices bound the memory
                words, counts = word_hashes([t or "" for t in df["_t"].iloc[lo:hi]])
                some = counts > 0
                if not some.any():
                    continue
                counts = counts[some]
                ends = np.cumsum(counts)
                u, v = [mixed(range_sums(words, ends - counts, ends, base)) for base in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]
                runs, each = shingles(words, counts, size)
                minima = minhash(runs, np.cumsum(each) - each)
                ids = df["_id"].iloc[lo:hi].to_numpy()[some]
                us.append(u.view(np.int64))
                keys.append(band_keys(minima))
                held += len(u)
                yield pd.DataFrame({"p": (u % np.uint64(stretches)).astype(np.int32), "entries": None, "_id": ids, "_u": us[-1], "_v": v.view(np.int64), "_sig": list(pack_bits(minima))})
                if held >= PACKED:
                    yield _dealt(us, keys, stretches, ids[0])
                    us, keys, held = [], [], 0
        if held:
            yield _dealt(us, keys, stretches, ids[0])

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Columns _u, _id and _t; distinct 32-bit hashes of each text's runs.
        for df in batches:
            for lo, hi in _slices(df["_t"]):
                words, counts = word_hashes([t or "" for t in df["_t"].iloc[lo:hi]])
                runs, each = shingles(words, counts, size)
                parts = np.split((runs >> np.uint64(32)).astype(np.uint32).view(np.int32), np.cumsum(each)[:-1])
                yield pd.DataFrame({"_u": df["_u"].iloc[lo:hi].to_numpy(), "_id": df["_id"].iloc[lo:hi].to_numpy(), "_sh": [np.unique(p) for p in parts]})

    return run


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures, from the share of equal positions less chance collisions."""
    apart = F.lit(0)
    for w in range(WORDS_64):
        differ = F.lit(0).cast("long")
        for p in range(BITS):
            i = F.lit(p * WORDS_64 + w)
            differ = differ.bitwiseOR(F.get(F.col(a), i).bitwiseXOR(F.get(F.col(b), i)))
        apart = apart + F.bit_count(differ)
    chance = 2.0**-BITS
    return ((1 - apart / float(HASHES)) - chance) / (1 - chance)


#: A key's 32 bits within its stretch, and the text.
ENTRY = np.dtype([("h", "<u4"), ("u", "<i8")])


def _dealt(us: list[np.ndarray], keys: list[np.ndarray], stretches: int, any_id) -> pd.DataFrame:
    """Rows (p, entries): all entries of some texts whose keys lie in one stretch; copies of a text count once."""
    u, at = np.unique(np.concatenate(us), return_index=True)
    key = mixed(np.concatenate(keys)[at].astype(np.uint64) | (np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32))).ravel()
    p = ((key >> np.uint64(48)) % np.uint64(stretches)).astype(np.uint16)
    entries = np.empty(len(key), dtype=ENTRY)
    entries["h"], entries["u"] = key.astype(np.uint32), np.repeat(u, BANDS)
    order = np.argsort(p, kind="stable")
    p, entries = p[order], entries[order]
    lo = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return pd.DataFrame({"p": p[lo].astype(np.int32), "entries": [e.tobytes() for e in np.split(entries, lo[1:])], "_id": any_id, "_u": 0, "_v": 0, "_sig": None})


def _runs(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries with a key that occurs more than once, sorted and without repeats; length of each key's run)."""
    e = e[np.argsort(e["h"], kind="stable")]
    same = e["h"][1:] == e["h"][:-1]
    e = e[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(e) else e
    e = e[np.lexsort((e["u"], e["h"]))]
    e = e[np.concatenate([[True], e[1:] != e[:-1]])] if len(e) else e
    starts = np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]])) if len(e) else np.zeros(0, dtype=np.int64)
    return e, np.diff(np.append(starts, len(e)))


def _finder(most: int):
    """The signer's rows of some stretches to texts as they are, arrays of pairs (a, b), a < b, that share a key of at most ``most`` texts, and arrays of (a, hot) for each text of a larger key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = np.int64(TaskContext.get().partitionId()) << np.int64(32)
        hot = np.zeros(0, dtype=np.uint32)
        kept, size = [], 0

        def found(a: np.ndarray, b: np.ndarray | None = None, key: np.ndarray | None = None) -> pd.DataFrame:
            # Many in a row, as arrays.
            at = range(0, len(a), PACKED)
            many = lambda x: None if x is None else [x[i : i + PACKED] for i in at]
            return pd.DataFrame({"_id": None, "_u": None, "_v": None, "_sig": None, "a": many(a), "b": many(b), "hot": many(key)}, index=range(len(at)))

        larger = lambda e: found(e["u"], key=e["h"].astype(np.int64) + task)
        for df in batches:
            texts = df["entries"].isna()
            if texts.any():
                yield df.loc[texts, ["_id", "_u", "_v", "_sig"]].assign(a=None, b=None, hot=None)
            for x in df.loc[~texts, "entries"]:
                e = np.frombuffer(x, dtype=ENTRY)
                if len(hot):
                    known = np.isin(e["h"], hot)
                    if known.any():
                        yield larger(e[known])
                        e = e[~known]
                kept.append(e)
                size += len(e)
            if size > HELD:
                every = np.concatenate(kept)
                e, n = _runs(every)
                n = np.repeat(n, n)
                if (n > most).any():
                    yield larger(e[n > most])
                    hot = np.union1d(hot, e["h"][n > most])
                    every = every[~np.isin(every["h"], hot)]
                kept, size = [every], 0  # counts what comes next, so that entries are sorted anew only now and then
        if not kept:
            return
        e, n = _runs(np.concatenate(kept))
        many = np.repeat(n, n)
        if (many > most).any():
            yield larger(e[many > most])
        starts = np.cumsum(n) - n
        left, right = [], []
        for k in np.unique(n[(n > 1) & (n <= most)]):
            i, j = np.triu_indices(int(k), 1)
            at = starts[n == k]
            step = max(1, 500_000 // len(i))
            for lo in range(0, len(at), step):
                u = e["u"][at[lo : lo + step, None] + np.arange(k)]
                left.append(u[:, i].ravel())
                right.append(u[:, j].ravel())
            if sum(map(len, left)) > 1_000_000:
                yield found(*_distinct(left, right))
                left, right = [], []
        if left:
            yield found(*_distinct(left, right))

    return run


def _distinct(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.concatenate(left), np.concatenate(right)  # runs are sorted, so a < b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[new], b[new]


def _candidates(shared: DataFrame, sigs: DataFrame, gate: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of texts that share a band key and pass the estimate."""
    pairs = shared.where("b is not null").select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b").distinct()
    # Both joins find the signatures where their aggregation has left them.
    one = pairs.withColumnRenamed("a", "_u").join(sigs, "_u").select(F.col("_u").alias("a"), F.col("_sig").alias("sa"), F.col("b").alias("_u"))
    passed = one.join(sigs, "_u").where(estimate("sa", "_sig") >= gate).select("a", F.col("_u").alias("b"))
    many = shared.where("hot is not null").select(F.explode(F.arrays_zip("a", "hot")).alias("x")).select("x.hot", F.col("x.a").alias("_u")).distinct()
    if many.isEmpty():
        return passed
    sizes = many.groupBy("hot").agg(F.count("*").alias("n"))
    hot = many.join(sizes, "hot").join(sigs, "_u")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("_u", "hot"), blocks).cast("int")
    dealt = hot.withColumns({"_bs": blocks, "_m": mine}).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_bs") - 1)))
    # A row meets block _o as the left side if its own block comes first; within its own block as both sides.
    lo, hi = F.least("_m", "_o"), F.greatest("_m", "_o")
    left = dealt.where("_m <= _o").select("hot", lo.alias("i"), hi.alias("j"), F.col("_u").alias("x"), F.col("_sig").alias("sa"))
    right = dealt.where("_o <= _m").select("hot", lo.alias("i"), hi.alias("j"), F.col("_u").alias("y"), F.col("_sig").alias("sb"))
    blocked = (
        left.join(right, ["hot", "i", "j"])
        .where((F.col("x") != F.col("y")) & ((F.col("i") != F.col("j")) | (F.col("x") < F.col("y"))) & (estimate("sa", "sb") >= gate))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    return passed.unionByName(blocked).distinct()


def near_duplicates(df: DataFrame, id_col: str, text: Column, shingle_words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the rows whose texts' shingle sets have a Jaccard similarity of ``threshold`` or more.

    ``members`` has (id, rep) for every row with a text of at least one word: rep is the
    smallest id with the same words. ``links`` has (a, b, similarity), a < b, between reps.
    Rows with a null or wordless text have no members and no links. A row id that repeats
    counts once, with one of its texts. Texts are used whole. Columns of ``df`` besides the
    id and those of ``text`` are not read.

    Texts are known by two 64-bit hashes of their words, runs of words by one of 32 bits.
    """
    kind = dict(df.dtypes)[id_col]
    rows = spread(df.select(F.col(id_col).alias("_id"), text.alias("_t")))
    stretches = min(1 << 16, max(64, 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    text_row = f"_id {kind}, _u bigint, _v bigint, _sig array<bigint>"
    dealt = rows.mapInPandas(_signer(shingle_words, stretches), f"p int, entries binary, {text_row}").repartition("p")
    shared = settle(dealt.mapInPandas(_finder(BLOCK), f"{text_row}, a array<bigint>, b array<bigint>, hot array<bigint>"))
    signed = shared.where("a is null").select("_id", "_u", "_v", "_sig")
    keyed = signed.groupBy("_id").agg(F.min(F.struct("_u", "_v")).alias("k")).select("_id", "k.*")
    reps = keyed.groupBy("_u", "_v").agg(F.min("_id").alias("rep"))
    members = settle(keyed.join(reps, ["_u", "_v"]).select(F.col("_id").alias("id"), "rep", "_u"))
    own = members.where("id = rep").select(F.col("rep").alias("_id"), "_u")
    sigs = signed.groupBy("_u").agg(F.first("_sig").alias("_sig"))  # copies have one signature
    passed = settle(_candidates(shared, sigs, max(threshold - MARGIN, 0.05)))
    needed = passed.select(F.explode(F.array("a", "b")).alias("_u")).distinct().join(own, "_u")
    needed = settle(needed)
    sent = F.broadcast(needed) if needed.count() <= SENT_IDS else needed
    sets = rows.join(sent, "_id").select("_u", "_id", "_t").mapInPandas(_sets(shingle_words), f"_u bigint, _id {kind}, _sh array<int>")
    side = lambda x: sets.select(F.col("_u").alias(x), F.col("_id").alias(f"i{x}"), F.col("_sh").alias(f"x{x}"))
    both = passed.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    sim = common / (F.size("xa") + F.size("xb") - common)
    # Repeated ids repeat pairs; the few links are made distinct, not the many sets.
    links = both.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), sim.alias("similarity")).where(F.col("similarity") >= threshold)
    return links.dropDuplicates(["a", "b"]), members.select("id", "rep")


def member_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of rows: those of equal words and those of linked representatives."""
    m = members
    same = m.select("rep", F.col("id").alias("a")).join(m.select("rep", F.col("id").alias("b")), "rep").where("a < b").select("a", "b")
    cross = (
        links.select(F.col("a").alias("ra"), F.col("b").alias("rb"))
        .join(m.select(F.col("rep").alias("ra"), F.col("id").alias("x")), "ra")
        .join(m.select(F.col("rep").alias("rb"), F.col("id").alias("y")), "rb")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    return same.unionByName(cross)


def duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group_id, n_links): one row per member, its group, and the links of its text to other texts."""
    grouped = components(links).withColumnRenamed("id", "rep")
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return (
        members.join(grouped, "rep", "left").join(ends, "rep", "left")
        .select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
