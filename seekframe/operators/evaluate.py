"""Evaluation and benchmark reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, by: list[str], value: str, ps: list[int]) -> DataFrame:
    """Nearest-rank percentiles: the element at p * (n - 1) / 100, rounded down."""
    w = Window.partitionBy(*by)
    at = df.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return at.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == F.floor(F.lit(p) * (F.col("_n") - 1) / 100), F.col(value))).alias(f"p{p}") for p in ps])


def ndcg(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) for queries with judgements: DCG over the first k ranks by that of the ideal ranking; 0 without relevant ones."""
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    dcg = ranked.filter(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain).alias("dcg"))
    best = qrels.filter("rel > 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))).filter(F.col("rank") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(gain).alias("idcg"))
    both = qrels.select("query_id").distinct().join(dcg, "query_id", "left").join(ideal, "query_id", "left")
    return both.select("query_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"))


def ndcg_of_groups(ranked: DataFrame, queries: DataFrame, docs: DataFrame, group: str, k: int = 10) -> DataFrame:
    """ndcg() where the relevant documents of a query are those of its group, with gain 1: (query_id, group) and (doc_id, group) instead of their pairs."""
    many = docs.groupBy(group).agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1) / F.log2(i + F.lit(1)))
    best = queries.select("query_id", group).join(many, group).select("query_id", group, ideal.alias("idcg"))
    top = ranked.filter(F.col("rank") <= k).join(docs.select("doc_id", F.col(group).alias("_of")), "doc_id").select("query_id", "_of", "rank")
    dcg = F.coalesce(F.sum(F.when(F.col("_of") == F.col(group), F.lit(1) / F.log2(F.col("rank") + 1))), F.lit(0.0))
    return best.join(top, "query_id", "left").groupBy("query_id").agg((dcg / F.first("idcg")).alias("ndcg"))


def latest(records: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last record of each key."""
    return records.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(seq)))).filter("_rn = 1").drop("_rn")


def speedups(records: DataFrame, key: list[str], backend: str, value: str, base: str) -> DataFrame:
    """Each record's value over that of the base backend with the same key."""
    own = records.filter(F.col(backend) == base).select(*key, F.col(value).alias("base_value"))
    return records.join(own, key).select(*key, backend, (F.col(value) / F.col("base_value")).alias("speedup"))


def crossover(speed: DataFrame, by: list[str], size: str) -> DataFrame:
    """The least size from which a speed-up of 1 is seen in each group."""
    return speed.groupBy(*by).agg(F.min(F.when(F.col("speedup") >= 1, F.col(size))).alias("crossover"))


def human(n):
    """1500000 as 1.5M, 10000 as 10k."""
    short = lambda x, unit: F.concat(F.regexp_replace(F.format_string("%.1f", x), r"\.0$", ""), F.lit(unit))
    return F.when(n >= 1_000_000, short(n / 1e6, "M")).when(n >= 1000, short(n / 1e3, "k")).otherwise(F.regexp_replace(F.format_string("%.1f", n.cast("double")), r"\.0$", ""))


def pivoted(speed: DataFrame, by: list[str], backend: str, names: list[str]) -> DataFrame:
    """A column of speed-ups for each of the named backends."""
    return speed.groupBy(*by).pivot(backend, names).agg(F.max("speedup"))


def table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(place, line): df as a Markdown table, its head at places 0 and 1, its rows by their columns from 2 on.  For reports: it's numbered in one task."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))]
    rows = df.select((F.row_number().over(Window.orderBy(*columns)) + 1).alias("place"), line.alias("line"))
    return df.sparkSession.createDataFrame(head, "place int, line string").unionByName(rows)


def append_records(records: DataFrame, path: str) -> None:
    """Add records to a folder of JSON lines."""
    records.write.mode("append").json(path)


def load_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """Records of such a folder; blank lines are passed over, a line that can't be read is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def measure(queries: dict, run, warm: int = 8) -> dict:
    """{name: (p50, p95, per second)} of run(query) in seconds, after some calls that don't count; by nearest rank."""
    import time

    out = {}
    for name, asked in queries.items():
        asked = list(asked)
        for q in asked[:warm]:
            run(q)
        took = []
        for q in asked:
            began = time.perf_counter()
            run(q)
            took.append(time.perf_counter() - began)
        took.sort()
        at = lambda p: took[p * (len(took) - 1) // 100]
        out[name] = (at(50), at(95), len(took) / sum(took)) if took else (0.0, 0.0, 0.0)
    return out
