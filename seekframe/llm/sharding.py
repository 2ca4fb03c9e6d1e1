"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes have places on a ring of 64-bit numbers.  Keys arrive in the order of their places; each goes
clockwise to the next virtual node whose shard isn't full.  A shard is full at ceil((1 + slack) * rows / shards).

The arcs between virtual nodes are a fixed number, so their counts alone (one row each) decide which ranks of which arc go where:
rows are only ranked within the few arcs that a filling shard cuts in two.  There are no more of these than shards.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed

SHARDS = 64
VNODES = 128
SLACK = 0.05


def ring(shards: int | list[str], vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in ascending order, and the shard of each.

    A virtual node's place depends on its shard's name alone, so adding or removing a shard moves no other node.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    at = sorted((xxhash.xxh3_64_intdigest(f"{name}#{v}") - (1 << 63), i) for i, name in enumerate(names) for v in range(vnodes))
    return np.array([a for a, _ in at], np.int64), np.array([s for _, s in at], np.int32)


def assign_ranks(counts: np.ndarray, owner: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(arc, from rank, to rank, shard): where the rows of each arc go, in the order of arrival."""
    room = np.full(int(owner.max()) + 1, capacity, np.int64)
    n, out = len(owner), []
    # follow[i] leads from arc i towards the next one whose shard has room
    follow = list(range(n))

    def open_from(i: int) -> int:
        path = []
        while True:
            j = follow[i]
            if j == i:
                if room[owner[i]] > 0:
                    break
                j = (i + 1) % n
            path.append(i)
            i = j
        for p in path:
            follow[p] = i
        return i

    for arc in np.flatnonzero(counts):
        done, left, i = 0, int(counts[arc]), int(arc)
        while left:
            i = open_from(i)
            take = min(left, int(room[owner[i]]))
            out.append((int(arc), done, done + take, int(owner[i])))
            room[owner[i]] -= take
            done, left = done + take, left - take
    return out


def _arc(places: np.ndarray):
    @F.pandas_udf("int")
    def arc(at: pd.Series) -> pd.Series:
        # clockwise: the first virtual node at or after the key, and past the last one the first
        return pd.Series((np.searchsorted(places, at.to_numpy(np.int64), side="left") % len(places)).astype(np.int32))

    return arc


def shard(docs: DataFrame, key_col: str = "doc_id", shards: int | list[str] = SHARDS, vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """(row, shard): each row of docs as a struct column, and the number of its shard; see shard_rows() for its columns side by side.

    Every row counts one, so no shard holds more than ceil((1 + slack) * rows / shards).  A null key has a place as
    any other key; rows repeated under one key arrive one after the other, and where a shard fills between them, which of
    them goes on is open, though not how many.  An empty table gives no rows; texts aren't looked at.  slack must not be negative.
    """
    if slack < 0:
        raise ValueError("slack must not be negative")
    spark = docs.sparkSession
    places, owner = ring(shards, vnodes)
    at = F.xxhash64(F.coalesce(F.col("row").getField(key_col).cast("string"), F.lit("\0")))
    rows = packed(docs).withColumn("at", at).withColumn("arc", _arc(places)("at"))
    counts = np.zeros(len(owner), np.int64)
    # at most one row for each virtual node comes to the driver
    for r in packed(docs.select(f"`{key_col}`")).withColumn("at", at).select(_arc(places)("at").alias("arc")).groupBy("arc").count().collect():
        counts[r["arc"]] = r["count"]
    capacity = ceil((1 + slack) * int(counts.sum()) / (int(owner.max()) + 1) - 1e-9)
    ranges = pd.DataFrame(assign_ranks(counts, owner, capacity) or [(0, 0, 0, 0)], columns=["arc", "lo", "hi", "shard"])
    ways = ranges.groupby("arc")["shard"].transform("size")
    whole = np.full(len(owner), -1, np.int32)
    whole[ranges["arc"][ways == 1]] = ranges["shard"][ways == 1]

    @F.pandas_udf("int")
    def of_arc(arc: pd.Series) -> pd.Series:
        return pd.Series(whole[arc.to_numpy(np.int64)])

    rows = rows.withColumn("shard", of_arc("arc"))
    if not (ways > 1).any():
        return rows.select("row", "shard")
    cut = F.broadcast(spark.createDataFrame(ranges[ways > 1].astype("int64"), "arc bigint, lo bigint, hi bigint, to bigint"))
    ranked = rows.filter("shard < 0").withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("at", F.col("row").getField(key_col))) - 1)
    moved = ranked.alias("r").join(cut.alias("c"), (F.col("r.arc") == F.col("c.arc")) & (F.col("r.rank") >= F.col("c.lo")) & (F.col("r.rank") < F.col("c.hi")))
    return rows.filter("shard >= 0").select("row", "shard").unionByName(moved.select("r.row", F.col("c.to").cast("int").alias("shard")))


def shard_rows(docs: DataFrame, key_col: str = "doc_id", shard_col: str = "shard", **ring_of) -> DataFrame:
    """docs with the number of each row's shard in shard_col, which docs mustn't have; the cases are as in shard()."""
    if shard_col in docs.columns:
        raise ValueError(f"{shard_col} is a column already; name another shard_col")
    return shard(docs, key_col, **ring_of).select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("shard").alias(shard_col))
