"""How rows lie in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table of up to so many bytes for each core may lie in fewer partitions than there are cores.
SMALL_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it's small: a file of one row group is read by one task, however many cores wait for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= cores * SMALL_BYTES else df


def lanes(df: DataFrame) -> int:
    """Into how many partitions df is laid out for work that grows with more than its rows: one for each core, more for what isn't small."""
    s = df.sparkSession
    cores = s.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return cores if size <= cores * SMALL_BYTES else max(cores, int(s.conf.get("spark.sql.shuffle.partitions")))
