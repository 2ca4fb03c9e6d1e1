"""Selection: the best rows, in all or for each query, by (score descending, id ascending)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are ordered by this many digits, so that the order of summation decides no tie.
DIGITS = 9


def ordering(score: str = "score", ids: str = "doc_id") -> list[Column]:
    return [F.round(F.col(score), DIGITS).desc(), F.col(ids).asc()]


def top_k(df: DataFrame, k: int, by: list[str] = (), score: str = "score", ids: str = "doc_id", positive: bool = False, nonpositive_k: str = "none") -> DataFrame:
    """The k best rows for each value of ``by``, with their rank from 1 on; NaN scores are dropped.

    positive: only scores above 0.  nonpositive_k says what k < 0 or k = 0 give: "none" nothing for 0 and an error below, "all" everything ranked,
    "negative_all" everything for k < 0 and nothing for k = 0.
    """
    if k < 0 and nonpositive_k == "none":
        raise ValueError("k must not be negative")
    df = df.filter(~F.isnan(score))
    if positive:
        df = df.filter(F.col(score) > 0)
    if k == 0 and nonpositive_k != "all":
        return df.withColumn("rank", F.lit(0)).limit(0)
    if not by and k > 0:
        df = df.orderBy(*ordering(score, ids)).limit(k)  # per-partition heaps, so the window below sees k rows
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by or [F.lit(0)]).orderBy(*ordering(score, ids))))
    return ranked.filter(F.col("rank") <= k) if k > 0 else ranked


def threshold(df: DataFrame, k: int, by: list[str] = (), score: str = "score") -> DataFrame:
    """What a newcomer must exceed: the k-th best score, -inf for fewer rows than k, +inf for k = 0."""
    if k == 0:
        return df.groupBy(*by).agg(F.lit(float("inf")).alias("threshold"))
    best = top_k(df, k, list(by), score)
    return best.groupBy(*by).agg(F.when(F.count("*") < k, F.lit(float("-inf"))).otherwise(F.min(score)).alias("threshold"))
