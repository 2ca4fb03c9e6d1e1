"""The corpus pipeline: five stages over documents, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seekframe.llm.common import Table
from seekframe.llm.exact import exact_dedup
from seekframe.llm.njoin import near_dedup
from seekframe.llm.packing import pack
from seekframe.llm.quality import quality_filter
from seekframe.llm.secrets import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their compression bands.

    Null, empty and blank texts go; each repeated row is measured by itself; a ratio at a limit is within; a long text is
    measured whole; null ids and clashing columns are passed on; an empty table stays empty.
    """
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the least id, one with an id before one without.

    Null texts all stay, empty texts are equal; of rows with equal text and id one stays; long texts are compared whole; all columns
    are passed on; an empty table stays empty.
    """
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are no near copy of one with a smaller id that stays.

    Null, empty and wordless texts and rows with a null id stay; rows repeated under one id stay or go together; a pair at exactly the
    threshold counts; long texts count whole; all columns are passed on; an empty table stays empty.
    """
    return near_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked, n_chars set to the new length where a text changed.

    Null and empty texts, null ids, repeated rows and other columns are as before; of rules that match at one place the first counts; long
    texts are scanned whole; an empty table stays empty.
    """
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a training sequence.

    Null, empty and blank texts have no place; a null id is passed on; repeated rows are packed once each; equal lengths are ranked by id; a long
    text is cut into full sequences and a rest; other columns aren't read; an empty table gives no rows.
    """
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]

#: Compression, decoding and packing have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; only the last one's input is left behind, until the JVM ends."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        table = Table(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            last.drop()
        docs, last = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
