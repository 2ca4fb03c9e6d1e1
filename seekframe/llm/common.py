"""Shared plumbing of the corpus operators.

Rows are carried as one struct column (``row``), so that a user's extra columns can never clash with an
operator's working columns.  Intermediate tables go to the folder all executors share
(``spark.checkpoint.dir``), as Parquet: they cut lineage, survive the loss of any executor, and are deleted
when the JVM ends or when the operator says so.
"""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table up to this many bytes may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; a local session without one (a test) gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_seekframe_dir", None)
    if own is None:
        own = spark._seekframe_dir = "file://" + tempfile.mkdtemp(prefix="seekframe-")
    return own


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def table_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _path(spark, path)
    return int(fs.getContentSummary(p).getLength())


class Table:
    """A DataFrame written once to the shared folder and read from there ever after."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def side(self) -> DataFrame:
        """As the build side of a join: broadcast if its measured size allows, else as it is.

        The Parquet size is taken four-fold for what it may need in memory.
        """
        return F.broadcast(self.df) if 4 * table_bytes(self.spark, self.path) <= BROADCAST_BYTES else self.df

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def packed(docs: DataFrame) -> DataFrame:
    """All columns of docs in one struct column ``row``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns that packed() put away."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in like.columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Logical plans made of these alone give their rows in the same order whenever they are read.
_STEADY = {"Project", "Filter", "Relation", "RelationV2", "LocalRelation", "Range", "Union", "LogicalRDD"}


def stable(df: DataFrame) -> bool:
    """Whether df gives the same rows in the same order if read again: reads tables, maps and filters, no shuffles."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return {re.match(r"[\s:+-]*(\w*)", line)[1] for line in plan.splitlines() if line.strip()} <= _STEADY


def components(edges: DataFrame) -> Table:
    """(id, label): for each vertex of edges (u, v), the least vertex that they lead to from it.

    Each round contracts every vertex into the least of its neighbours and itself, until no edge is left.
    """
    left, moves = Table(edges.filter("u <> v").distinct(), "parts-edges"), []
    while not left.df.isEmpty():
        both = left.df.unionByName(left.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        move = Table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), "parts-move")
        one = left.df.join(move.side(), "u").select(F.col("to").alias("u"), "v")
        both = one.join(move.side().select(F.col("u").alias("v"), F.col("to").alias("w")), "v").select("u", F.col("w").alias("v"))
        new = Table(both.filter("u <> v").distinct(), "parts-edges")
        left.drop()
        left = new
        moves.append(move)
    out = left.df.select(F.col("u").alias("id"), F.col("v").alias("label"))
    for move in reversed(moves):
        # what was contracted into a vertex goes where that one went in later rounds
        later = out.select(F.col("id").alias("to"), "label")
        out = move.df.join(later, "to", "left").select(F.col("u").alias("id"), F.coalesce("label", "to").alias("label"))
    out = Table(out, "parts")
    for t in (left, *moves):
        t.drop()
    return out


def slices(batches, text_col: str, chars: int = 4 << 20):
    """The rows of Arrow batches in pieces of about so many characters, so that a worker's arrays stay small.

    A text is never cut: a longer one is a piece by itself.
    """
    for pdf in batches:
        size = pdf[text_col].str.len().fillna(0).to_numpy()
        piece = (np.cumsum(size + chars / 50_000) // chars).astype(np.int64)  # 50,000 rows at most
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            if b > a:
                yield pdf.iloc[a:b].reset_index(drop=True)


# --- memory of Python workers ------------------------------------


def give_back() -> None:
    """Hand freed memory back to the system; a worker that waits for its next task would keep it, beside those at work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def lean(run):
    """A function of batches that gives back its memory once it has read them all."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def lean_group(run):
    """A function of one group that gives back its memory after each."""

    @functools.wraps(run)
    def inner(pdf):
        try:
            return run(pdf)
        finally:
            give_back()

    return inner


# --- word n-grams on bytes, a whole Arrow batch at a time -------------------------------------------------

_WORD = np.zeros(256, np.bool_)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words of a batch of texts, lower-cased: maximal runs of a-z, 0-9 and non-ASCII letters or signs.

    Returns the 64-bit name of each word, its byte start and end in the joined bytes, and for each text
    the index of its first word (one more entry closes the last), and the joined bytes.  A null text has
    no words.
    """
    parts = [t.lower().encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    data = b"\n".join(parts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    is_word = _WORD[raw]
    edge = np.diff(np.concatenate(([False], is_word, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lens = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    offsets = np.concatenate(([0], np.cumsum(lens)))
    first = np.searchsorted(starts, offsets)
    names = _names(raw, starts, ends)
    return names, starts, ends, first, data


def _names(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of the words by Horner's rule over eight bytes at a time, all words in step."""
    n = ends - starts
    h = n.astype(np.uint64) * _M2
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live, off = np.arange(len(n)), 0
    while len(live):
        left = n[live] - off
        chunk = np.ascontiguousarray(eight[starts[live] + off]).view("<u8").ravel()
        short = np.minimum(left, 8).astype(np.uint64)
        keep = np.where(short == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (short % np.uint64(8) * np.uint64(8))) - np.uint64(1))
        h[live] = mix((h[live] * _BASE) ^ (chunk & keep))
        live = live[left > 8]
        off += 8
    return h


def ngram_names(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all n-grams of a batch, and the text each comes from.

    A text with 1 to n-1 words has one gram, its whole word sequence; one without words has none.
    """
    total, count = len(words), np.diff(first)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.zeros(max(0, total - n + 1), np.uint64)
    for i in range(n):
        grams = mix(grams * _BASE + words[i : total - n + 1 + i]) if len(grams) else grams
    of = np.repeat(np.arange(len(count)), count)
    ok = np.flatnonzero(of[: len(grams)] == of[n - 1 : n - 1 + len(grams)]) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    extra = []
    for t in short:
        h = np.zeros(1, np.uint64)
        for w in words[first[t] : first[t + 1]]:
            h = mix(h * _BASE + w)
        extra.append(mix(h + np.uint64(count[t])))
    names = np.concatenate([grams[ok], *extra]) if extra else grams[ok]
    return names, np.concatenate([of[:-n + 1 or None][ok] if n > 1 else of[ok], short])
