"""Exact deduplication by distributed MSD radix partitioning.

A text is sorted as its record: its length in bytes, then its bytes.  The first pass splits all records by
their most significant digit (the length and the first bytes); only that digit is shuffled, with map-side
counts, so a group of a million copies is one row per task.  Groups of one are done.  The rest are split by the next
bytes, the digit growing at each pass, until each group is a singleton or its records have ended; all
records of a group have the same length, so they end together.  Equality is found by the bytes alone,
no digest takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, packed, unpacked

FIRST_BYTES = 32
GROWTH = 16


def _slice(text, start: int, width: int):
    return F.substring(text.cast("binary"), start + 1, width)


def _ended_groups(docs: DataFrame, id_col: str, text_col: str, first_bytes: int, growth: int):
    """Rows in groups of equal texts (row, n, gid, rid); the first digits that rows share; the rows that share them."""
    text = F.col("row").getField(text_col)
    digit = [F.octet_length(text).alias("n"), _slice(text, 0, first_bytes).alias("digit")]
    rows = packed(docs)
    shared = Table(rows.select(*digit).filter("n is not null").groupBy("n", "digit").count().filter("count > 1").select("n", "digit", F.monotonically_increasing_id().alias("gid")), "radix-digits")
    rows = rows.select("row", *digit)
    work = sharing = Table(rows.join(shared.side(), ["n", "digit"]).select("row", "n", "gid", F.monotonically_increasing_id().alias("rid")), "radix-0")
    start, width, ended = first_bytes, first_bytes * growth, []
    while True:
        done = work.df.filter(F.col("n") <= start).select("row", "n", "gid", "rid")
        ended.append(done)
        rest = work.df.filter(F.col("n") > start).withColumn("digit", _slice(text, start, width))
        groups = Table(rest.groupBy("gid", "digit").agg(F.count("*").alias("k"), F.min("rid").alias("next")).filter("k > 1").select("gid", "digit", "next"), "radix-digits")
        if groups.df.isEmpty():
            groups.drop()
            break
        # The group's new number is its least row number, so groups stay apart in later passes.
        work = Table(rest.join(groups.side(), ["gid", "digit"]).select("row", "n", F.col("next").alias("gid"), "rid"), "radix-n")
        groups.drop()
        start, width = start + width, width * growth
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out, shared, sharing


def _with_keeper(groups: DataFrame, id_col: str) -> DataFrame:
    """Each row with the one that its group keeps, which is found with map-side minima: a group of any size is one row per task."""
    own = F.col("row").getField(id_col)
    # Only the first pass numbers groups otherwise than by a row of theirs; the length tells these apart.
    least = groups.groupBy("n", "gid").agg(F.min(F.struct(own.isNull().alias("no_id"), own.alias("id"), F.col("rid"))).alias("keeper"))
    return groups.join(Table(least, "radix-keepers").side(), ["n", "gid"])


def exact_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """(doc_id, keep_id) of every row whose text equals that of a row with a smaller id.

    keep_id is the least id of the group.  Null texts equal nothing; empty texts equal each other; a row with a null id
    may be a copy, and is kept only where no copy has an id; rows repeated under one id give (id, id) once for
    each repeat.  An empty table gives no rows; other columns are ignored.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    groups, _, _ = _ended_groups(narrow, "doc_id", "text", first_bytes, growth)
    slim = groups.select(F.struct(F.col("row.doc_id").alias("doc_id")).alias("row"), "n", "gid", "rid")
    return _with_keeper(slim, "doc_id").filter(F.col("rid") != F.col("keeper.rid")).select(F.col("row.doc_id").alias("doc_id"), F.col("keeper.id").alias("keep_id"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """docs with one row for each text, that with the least id, and all its columns.

    Of rows with equal text and id one stays, whichever.  Null texts all stay.  The other cases are as in exact_pairs().
    """
    groups, shared, sharing = _ended_groups(docs, id_col, text_col, first_bytes, growth)
    slim = groups.select(F.struct(F.col("row").getField(id_col).alias(id_col)).alias("row"), "n", "gid", "rid")
    dropped = Table(_with_keeper(slim, id_col).filter(F.col("rid") != F.col("keeper.rid")).select("rid"), "radix-dropped")
    text = F.col("row").getField(text_col)
    alone = packed(docs).select("row", F.octet_length(text).alias("n"), _slice(text, 0, first_bytes).alias("digit")).join(shared.side(), ["n", "digit"], "left_anti").select("row")
    kept = sharing.df.join(dropped.side(), "rid", "left_anti").select("row")
    return unpacked(alone.unionByName(kept), docs)
