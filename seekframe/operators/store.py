"""Kept indexes: Parquet tables of one folder with a manifest that says what they are.

An index is written once and read by version; what a reader doesn't know, lacks or finds in another shape is an error, not a guess.
The manifest is written last, so a folder whose writing broke off can't be loaded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
MANIFEST = "kind string, version int, part string, columns string, settings map<string,string>"


def save(spark: SparkSession, path: str, kind: str, parts: dict[str, DataFrame], settings: dict | None = None) -> None:
    """Write an index into a new folder; an existing one is an error."""
    for name, df in parts.items():
        df.write.parquet(f"{path}/{name}")
    rows = [(kind, VERSION, n, df.schema.simpleString(), {k: str(v) for k, v in (settings or {}).items()}) for n, df in parts.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The parts of an index, and its settings."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    except Exception as e:
        raise ValueError(f"{path} holds no index") from e
    if not rows:
        raise ValueError(f"{path} holds no index")
    parts = {}
    for r in rows:
        if r["kind"] != kind:
            raise ValueError(f"{path} holds an index of kind {r['kind']!r}, not {kind!r}")
        if r["version"] != VERSION:
            raise ValueError(f"{path} has version {r['version']}; {VERSION} is supported")
        df = spark.read.parquet(f"{path}/{r['part']}")
        if df.schema.simpleString() != r["columns"]:
            raise ValueError(f"{path}/{r['part']} has other columns than its manifest says")
        parts[r["part"]] = df
    return parts, dict(rows[0]["settings"] or {})
