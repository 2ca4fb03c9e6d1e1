"""Learned-sparse retrieval over (doc_id, term, weight) postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(vectors: DataFrame) -> DataFrame:
    """Postings with a weight above 0 of (doc_id, terms, weights); the shorter array bounds a vector, repeated terms stay."""
    n = F.least(F.size("terms"), F.size("weights"))
    pairs = F.arrays_zip(F.slice("terms", F.lit(1), n).alias("term"), F.slice("weights", F.lit(1), n).alias("weight"))
    return vectors.select("doc_id", F.inline(F.transform(pairs, lambda p: F.struct(p["term"].cast("bigint").alias("term"), p["weight"].cast("double").alias("weight"))))).filter("weight > 0")


def fold(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight) with repeated terms summed and sums of 0 dropped; negative weights stay."""
    return queries.groupBy("query_id", "term").agg(F.sum(F.col("weight").cast("double")).alias("weight")).filter("weight <> 0")


def scores(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the documents that share a term with a query."""
    q = fold(queries).withColumnRenamed("weight", "qw")
    return postings.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))


def scores_all(docs: DataFrame, postings: DataFrame, queries: DataFrame) -> DataFrame:
    """scores() with a 0 for every document that shares no term with a query; docs has the doc_id of every document."""
    every = queries.select("query_id").distinct().crossJoin(docs.select("doc_id"))
    return every.join(scores(postings, queries), ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def splade_pool(logits: DataFrame) -> DataFrame:
    """(doc_id, term, weight) of (doc_id, pos, term, logit): log(1 + the greatest logit above 0) of each term."""
    top = logits.groupBy("doc_id", "term").agg(F.max("logit").alias("top")).filter("top > 0")
    return top.select("doc_id", "term", F.log1p("top").alias("weight"))
