"""Fusion of rankings: (query_id, list_id, doc_id, rank, score), best first by rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topk import DIGITS

RRF_K = 60


def rankings(*lists: DataFrame) -> DataFrame:
    """Ranked hits as one relation, numbered by list from 0 on."""
    return reduce(DataFrame.unionByName, (x.select("query_id", F.lit(i).alias("list_id"), "doc_id", "rank", F.col("score").cast("double").alias("score")) for i, x in enumerate(lists)))


def _weight(weights, n: int):
    if weights is None:
        return F.lit(1.0)
    if len(weights) != n:
        raise ValueError(f"{len(weights)} weights for {n} lists")
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("list_id") + 1)


def _fused(parts: DataFrame) -> DataFrame:
    # equal scores are ordered by first appearance: list by list, by rank
    both = parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"), F.min(F.struct("list_id", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "seen")
    return both.withColumn("rank", F.row_number().over(order)).select("query_id", "doc_id", "score", "rank")


def rrf(lists: list[DataFrame], k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """Sum of weight / (k + rank).  A weight of 0 adds nothing, but its list still orders ties."""
    if k <= 0:
        raise ValueError("k must be positive")
    return _fused(rankings(*lists).withColumn("part", _weight(weights, len(lists)) / (F.lit(k) + F.col("rank"))))


def rsf(lists: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Sum of weight times the score scaled to 0..1 within its list; where all scores of a list are equal each is 1."""
    one = Window.partitionBy("query_id", "list_id")
    scaled = rankings(*lists).withColumn("lo", F.min("score").over(one)).withColumn("hi", F.max("score").over(one))
    part = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))
    return _fused(scaled.withColumn("part", _weight(weights, len(lists)) * part))


def hybrid(dense: DataFrame, lexical: DataFrame, shortlist: int, k: int = RRF_K) -> DataFrame:
    """RRF of the two shortlists, the dense one first; the union may exceed the shortlist, and one <= 0 gives nothing."""
    return rrf([x.filter(F.col("rank") <= max(0, shortlist)) for x in (dense, lexical)], k)
