"""The corpus operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import Table
from .exact import exact_pairs
from .license import scan_licenses
from .lines import LineIndex, shards_for
from .njoin import ngram_classes
from .packing import pack
from .quality import quality_report
from .secrets import scan_secrets
from .sharding import shard_rows
from .suffix import repeats


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_pairs(_documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents arrive first, then all others; then those that are labelled as bad are deleted again."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    bad = docs.join(Table(labels.filter("quality = 0").select("doc_id").distinct(), "bad").side(), "doc_id", "left_semi")
    return LineIndex(spark, shards_for(docs)).insert(docs.filter(english)).insert(docs.filter(~english)).delete(bad).dropped()


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(_documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_documents(spark, sf_dir))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_packing, op3_quality_rules, op4_sharding, op5_bpe, op6_exact_dedup, op7_line_dedup, op8_ngram_join, op9_secret_scan, op10_repeats)}

ORACLE_SQL = {
    "op8_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
         g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1)::BIGINT + 1)) AS i FROM w WHERE len(w) > 0)),
         s AS MATERIALIZED (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
         o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
         p AS MATERIALIZED (SELECT x, y FROM o JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE n >= 0.3 * (a.size + b.size - n) - 1e-9),
         e AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
         r AS (SELECT DISTINCT x AS doc_id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y)
        SELECT doc_id, min(root) AS class_id, links FROM r JOIN (SELECT x AS doc_id, count(*) AS links FROM e GROUP BY x) USING (doc_id) GROUP BY ALL""",
    "op6_exact_dedup": """
        SELECT doc_id, keep_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL)
        WHERE doc_id <> keep_id""",
    "op7_line_dedup": """
        WITH lines AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
        ranked AS (SELECT doc_id, line_no, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY line ORDER BY doc_id, line_no))
        SELECT doc_id, line_no, keep_id FROM ranked WHERE rn > 1""",
}
