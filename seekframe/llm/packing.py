"""Best-fit packing of documents into training sequences by a linear grouping scheme.

1. Documents longer than a sequence are cut into full sequences and a rest; every piece then has a length of at most ``capacity`` tokens.
2. Pieces above ``small`` of a sequence are ranked by length and cut into groups of equal cardinality, each group's lengths rounded up to
   its longest.  Configurations of these few sizes are optimised as a cutting-stock program by column generation.
3. The group's actual pieces take its places in the configurations, by rank; what the rounding wasted stays free.
4. Small pieces go best-fit into the free room, longest first, and open further sequences where none has room.

Only the histogram of lengths (at most ``capacity`` rows) comes to the driver.  Ranks are row numbers within
salted lengths plus offsets, places are arithmetic on ranks, and step 4 runs in independent shards of sequences and small pieces;
each shard leaves at most one sequence that is not well filled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, shuffle_partitions

CAPACITY = 4096
#: Pieces of at most this share of a sequence are small.
SMALL = 1 / 8
#: Groups of equal cardinality, hence different sizes in the configurations.
GROUPS = 24
#: Small pieces and sequences in a shard of the best-fit step, about.
SHARD_ROWS = 400_000


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable configuration: an unbounded knapsack, one item more at each pass."""
    value, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        new, pick = value.copy(), np.full(capacity + 1, -1, np.int32)
        for j, s in enumerate(sizes):
            here = np.full(capacity + 1, -1.0)
            here[s:] = value[: capacity + 1 - s] + worth[j]
            better = here > new + 1e-12
            new[better], pick[better] = here[better], j
        picks.append(pick)
        if (pick < 0).all():
            break
        value = new
    out, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if (j := pick[room]) >= 0:
            out[j] += 1
            room -= int(sizes[j])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, times): configurations that hold the demand in nearly the least number of sequences."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(50 * n):
        duals = np.linalg.solve(basis.T, np.ones(n))
        pattern = _best_pattern(sizes, duals, capacity)
        if duals @ pattern <= 1 + 1e-9:
            break
        step, x = np.linalg.solve(basis, pattern.astype(float)), np.linalg.solve(basis, demand.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = pattern
    times = np.floor(np.maximum(np.linalg.solve(basis, demand.astype(float)), 0) + 1e-9).astype(np.int64)
    out = [(basis[:, i].round().astype(np.int64), int(times[i])) for i in range(n) if times[i]]
    left = np.maximum(demand - sum((p * k for p, k in out), np.zeros(n, np.int64)), 0)
    by_size = np.argsort(-sizes, kind="stable")
    while left.any():  # what rounding down left: first-fit decreasing, a few sequences for each size
        pattern, room = np.zeros(n, np.int64), capacity
        for j in by_size:
            pattern[j] = min(int(left[j]), room // int(sizes[j]))
            room -= int(pattern[j] * sizes[j])
        times = int(min(left[j] // pattern[j] for j in np.flatnonzero(pattern)))
        out.append((pattern, times))
        left = left - pattern * times
    return out


def plan(histogram: dict[int, int], capacity: int, small: float, groups: int):
    """Places of the large pieces: (group size, rows (group, lo, hi, base, per sequence), number of sequences)."""
    lengths = np.array(sorted((k for k in histogram if small * capacity < k <= capacity), reverse=True), np.int64)
    if not len(lengths):
        return 1, [], 0
    counts = np.array([histogram[k] for k in lengths], np.int64)
    ends, total = np.cumsum(counts), int(counts.sum())
    each = -(-total // groups)
    starts = np.arange(0, total, each)
    sizes = lengths[np.searchsorted(ends, starts, side="right")]
    demand = np.minimum(each, total - starts)
    rows, base, at = [], 0, np.zeros(len(sizes), np.int64)
    for pattern, times in configurations(sizes, demand, capacity):
        for j in np.flatnonzero(pattern):
            rows.append((int(j), int(at[j]), int(at[j] + pattern[j] * times), base, int(pattern[j])))
            at[j] += pattern[j] * times
        base += times
    return each, rows, base


def best_fit(room: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The sequence of each piece (longest first, into the least room that takes it), and how many are opened.

    room is the free room of sequences 0, 1, ...; opened ones are numbered on from there.
    """
    levels: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, r in enumerate(room):
        if r > 0:
            levels[int(r)].append(i)
    where, opened = np.full(len(lengths), -1, np.int64), 0
    order = np.argsort(-lengths, kind="stable")
    falling = -lengths[order]
    at, low, last = 0, 0, None
    while at < len(order):
        size = int(lengths[order[at]])
        if size != last:
            low, last = size, size
        while low <= capacity and not levels[low]:
            low += 1
        if low > capacity:
            levels[capacity].append(len(room) + opened)
            opened += 1
            low = capacity
        i = levels[low].pop()
        # what is left of it is the tightest room for the next piece of this size, if it takes one
        take = min(low // size, int(np.searchsorted(falling, -size, side="right")) - at) if low >= 2 * size else 1
        where[order[at : at + take]] = i
        at += take
        levels[low - take * size].append(i)
        if low - take * size >= size:
            low = low - take * size
    return where, opened


def tokens(text: Column) -> Column:
    """Length of a text: its runs without white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


_PLACED = "doc_id bigint, piece int, start bigint, length int, seq bigint"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS, length=None) -> DataFrame:
    """(doc_id, piece, start, length, seq, offset): where each piece of each document goes.

    A piece is tokens start .. start + length - 1 of its document and lies in sequence seq from token offset on; no sequence holds more than capacity tokens.
    Lengths are counted by tokens(), or by the Column ``length``.  Null, empty and blank texts have no
    tokens and no rows; a null id is passed on; repeated rows are packed once each; equal lengths are ranked by id; an
    empty table gives no rows; other columns aren't read; a very long text is cut as said above, losing nothing.
    Ids must be integers.
    """
    spark = docs.sparkSession
    salts = shuffle_partitions(spark)
    size = tokens(F.col(f"`{text_col}`")) if length is None else length
    sizes = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), size.cast("bigint").alias("size")).filter("size > 0")
    last = F.ceil(F.col("size") / F.lit(capacity)).cast("int") - 1
    cut = sizes.select("doc_id", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    pieces = Table(cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("size") - start).cast("int").alias("length"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int").alias("salt")), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.df.groupBy("length").count().collect()}
    each, places, n_large = plan(histogram, capacity, small, groups)
    limit = small * capacity
    large, little = pieces.df.filter(F.col("length") > limit), pieces.df.filter(F.col("length") <= limit)

    placed = None
    if places:
        longer, above = {}, 0
        for k in sorted(histogram, reverse=True):
            longer[k] = above
            above += histogram[k]
        cells = large.groupBy("length", "salt").count()
        before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
        cells = cells.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
        first = F.broadcast(spark.createDataFrame([(k, v) for k, v in longer.items() if k > limit], "length int, above bigint"))  # at most capacity rows
        within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
        ranked = large.withColumn("within", within).join(cells, ["length", "salt"]).join(first, "length")
        ranked = ranked.withColumn("rank", F.col("above") + F.col("before") + F.col("within"))
        ranked = ranked.withColumn("group", F.floor(F.col("rank") / F.lit(each))).withColumn("place", F.col("rank") % F.lit(each))
        spots = F.broadcast(spark.createDataFrame(places, "g bigint, lo bigint, hi bigint, base bigint, per bigint"))  # at most some groups * groups rows
        at = (F.col("group") == F.col("g")) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))
        seq = F.col("base") + F.floor((F.col("place") - F.col("lo")) / F.col("per"))
        placed = Table(ranked.join(spots, at).select("doc_id", "piece", "start", "length", seq.cast("bigint").alias("seq")), "placed").df

    n_small = sum(v for k, v in histogram.items() if k <= limit)
    if n_small:
        shards = max(1, -(-(n_small + n_large) // SHARD_ROWS), min(salts, n_small // 20_000))
        mine = little.withColumn("shard", F.pmod(F.xxhash64("piece", "doc_id", F.lit("s")), F.lit(shards)).cast("int"))
        if placed is None:
            free = spark.createDataFrame([], "shard int, seq bigint, room int")
        else:
            free = placed.groupBy("seq").agg(F.sum("length").cast("int").alias("full")).filter(F.col("full") < capacity)
            free = free.select(F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int").alias("shard"), "seq", (F.lit(capacity) - F.col("full")).alias("room"))

        def fit(key, rooms: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
            rooms = rooms.sort_values(["room", "seq"], ignore_index=True)
            items = items.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
            where, opened = best_fit(rooms["room"].to_numpy(np.int64), items["length"].to_numpy(np.int64), capacity)
            numbers = np.concatenate((rooms["seq"].to_numpy(np.int64), n_large + int(key[0]) + shards * np.arange(opened, dtype=np.int64)))
            return items[["doc_id", "piece", "start", "length"]].assign(seq=numbers[where] if len(items) else np.zeros(0, np.int64))

        fitted = Table(free.groupBy("shard").cogroup(mine.groupBy("shard")).applyInPandas(fit, _PLACED), "fitted").df
        placed = fitted if placed is None else placed.unionByName(fitted)
    if placed is None:
        placed = spark.createDataFrame([], _PLACED)
    order = Window.partitionBy("seq").orderBy(F.desc("length"), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("offset", F.sum("length").over(order) - F.col("length"))
