"""Reversible line deduplication: sharded cuckoo filters over exact reference tables.

Lines are sharded by name (128 bits).  A shard holds every reference to its lines, (line, document, place), sorted; the number of
references of each line; and a cuckoo filter of its lines.  A batch of lines is probed in the filter: what it lacks is new and
isn't looked up, what it may hold is looked up in the exact table, so a false positive costs a search and changes nothing.
Deleting a document removes its references, and a line whose count falls to zero leaves the filter; a
line that lost its first reference is then kept in the next document that has it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, mix, shuffle_partitions

SLOTS = 4
MOST_LOAD = 0.85
MOST_KICKS = 400

_REF = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("doc", "<i8"), ("line", "<i4")])
_LINE = np.dtype([("k1", "<i8"), ("k2", "<i8")])
STATE = "shard int, filter binary, refs binary, counts binary"


class CuckooFilter:
    """Sixteen-bit fingerprints, four to a bucket; all operations take arrays of distinct lines."""

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), "<u2") if table is None else table
        self.random = np.random.default_rng(len(self.table))

    def _places(self, lines: np.ndarray):
        mask = np.uint64(len(self.table) - 1)
        mark = (lines["k2"].view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype("<u2")
        first = (mix(lines["k1"].view(np.uint64)) & mask).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def may_hold(self, lines: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(lines)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, lines: np.ndarray) -> bool:
        """False if they don't fit; the filter must then be rebuilt larger from the exact table."""
        mark, at, _ = self._places(lines)
        for kick in range(MOST_KICKS):
            if not len(at):
                return True
            order = np.argsort(at, kind="stable")
            at, mark = at[order], mark[order]
            lead = np.concatenate(([True], at[1:] != at[:-1]))
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))
            taken = self.table[at] != 0
            fits = rank < SLOTS - taken.sum(1)
            slot = np.argsort(taken, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            self.table[at[fits], slot[fits]] = mark[fits]
            at, mark = at[~fits], mark[~fits]
            if kick and len(at):  # both places are full: one of each bucket's newcomers drives out an old one
                _, one = np.unique(at, return_index=True)
                where = self.random.integers(0, SLOTS, len(one))
                out = self.table[at[one], where].copy()
                self.table[at[one], where] = mark[one]
                mark[one] = out
            at = self._other(at, mark)
        return not len(at)

    def delete(self, lines: np.ndarray) -> None:
        """Take out lines that were inserted."""
        mark, first, second = self._places(lines)
        left = self._clear(mark, first)
        self._clear(mark[left], second[left])

    def _clear(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Empty one slot for each mark in its bucket; which marks weren't there."""
        left, missed = np.arange(len(mark)), [np.zeros(0, np.int64)]
        while len(left):
            _, one = np.unique(at[left], return_index=True)  # one for each bucket at a time
            now = left[one]
            same = self.table[at[now]] == mark[now][:, None]
            hit = same.any(1)
            self.table[at[now][hit], same.argmax(1)[hit]] = 0
            missed.append(now[~hit])
            left = np.delete(left, one)
        return np.concatenate(missed)


class Shard:
    def __init__(self):
        self.filter, self.refs = CuckooFilter(), np.zeros(0, _REF)
        self.lines, self.counts = np.zeros(0, _LINE), np.zeros(0, np.int64)
        self.searched = 0

    @classmethod
    def load(cls, filter: bytes, refs: bytes, counts: bytes) -> Shard:
        out = cls()
        out.filter = CuckooFilter(table=np.frombuffer(filter, "<u2").reshape(-1, SLOTS).copy())
        out.refs, out.counts = np.frombuffer(refs, _REF), np.frombuffer(counts, "<i8").copy()
        out.lines = out.refs[["k1", "k2"]][np.concatenate(([0], np.cumsum(out.counts)[:-1])).astype(np.int64)].astype(_LINE) if len(out.counts) else out.lines
        return out

    def dump(self) -> tuple[bytes, bytes, bytes]:
        return self.filter.table.tobytes(), self.refs.tobytes(), self.counts.astype("<i8").tobytes()

    def _find(self, lines: np.ndarray) -> np.ndarray:
        """Place of each line in the exact table, or -1."""
        self.searched += len(lines)
        if not len(self.lines) or not len(lines):
            return np.full(len(lines), -1, np.int64)
        # by first halves, then along the few that are equal
        at = np.searchsorted(self.lines["k1"], lines["k1"])
        out = np.full(len(lines), -1, np.int64)
        live = np.flatnonzero(at < len(self.lines))
        while len(live):
            here = self.lines[at[live]]
            live, here = live[here["k1"] == lines["k1"][live]], here[here["k1"] == lines["k1"][live]]
            hit = here["k2"] == lines["k2"][live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < len(self.lines)]
        return out

    def insert(self, refs: np.ndarray) -> None:
        refs = refs[np.lexsort((refs["line"], refs["doc"], refs["k2"], refs["k1"]))]
        lead = np.ones(len(refs), np.bool_)
        lead[1:] = (refs["k1"][1:] != refs["k1"][:-1]) | (refs["k2"][1:] != refs["k2"][:-1])
        starts = np.flatnonzero(lead)
        lines, counts = refs[["k1", "k2"]][starts].astype(_LINE), np.diff(np.append(starts, len(refs)))
        old = np.full(len(lines), -1, np.int64)
        maybe = self.filter.may_hold(lines)
        old[maybe] = self._find(lines[maybe])
        self.counts[old[old >= 0]] += counts[old >= 0]
        new = old < 0
        every = np.concatenate((self.lines, lines[new]))
        order = np.lexsort((every["k2"], every["k1"]))
        self.lines, self.counts = every[order], np.concatenate((self.counts, counts[new]))[order]
        self.refs = np.concatenate((self.refs, refs))
        self.refs = self.refs[np.lexsort((self.refs["line"], self.refs["doc"], self.refs["k2"], self.refs["k1"]))]
        grown = len(self.lines) > MOST_LOAD * self.filter.table.size
        if grown or not self.filter.insert(lines[new]):
            buckets = len(self.filter.table)
            while True:
                buckets = max(64, 1 << int(np.ceil(np.log2(max(1, len(self.lines)) / (MOST_LOAD * SLOTS))))) if grown else 2 * buckets
                grown = False
                self.filter = CuckooFilter(buckets)
                if self.filter.insert(self.lines):
                    break

    def delete(self, refs: np.ndarray) -> None:
        """Remove all references of these lines from these documents."""
        gone = np.unique(refs[["k1", "k2", "doc"]].astype([("k1", "<i8"), ("k2", "<i8"), ("doc", "<i8")]))
        lines = np.unique(gone[["k1", "k2"]].astype(_LINE))
        known = lines[self.filter.may_hold(lines)]
        known = known[self._find(known) >= 0]
        which = pd.MultiIndex.from_arrays([self.refs[c] for c in ("k1", "k2", "doc")]).isin(pd.MultiIndex.from_arrays([gone[c] for c in ("k1", "k2", "doc")])) if len(known) else np.zeros(len(self.refs), np.bool_)
        at = self._find(self.refs[["k1", "k2"]][which].astype(_LINE))
        np.subtract.at(self.counts, at, 1)
        self.refs = self.refs[~which]
        dead = self.counts == 0
        self.filter.delete(self.lines[dead])
        self.lines, self.counts = self.lines[~dead], self.counts[~dead]

    def dropped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, place, document of the first) of all references but the first of each line."""
        starts = np.concatenate(([0], np.cumsum(self.counts)[:-1])).astype(np.int64) if len(self.counts) else np.zeros(0, np.int64)
        first = np.repeat(self.refs["doc"][starts], self.counts)
        later = np.ones(len(self.refs), np.bool_)
        later[starts] = False
        return self.refs["doc"][later], self.refs["line"][later], first[later]


def shards_for(docs: DataFrame, text_col: str = "text") -> int:
    """How many shards the lines of docs need, from the bytes of its texts."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    return max(1, -(-int(size) // SHARD_BYTES))


def lines_of(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, k1, k2, doc, line) of all lines that aren't blank; a line's spaces at either end don't count."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").alias("text")).filter("doc is not null")
    lines = narrow.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "body")).withColumn("body", F.trim("body")).filter("body <> ''")
    named = lines.select("doc", "line", F.xxhash64("body").alias("k1"), F.xxhash64(F.lit("second"), "body").alias("k2"))
    return named.select(F.pmod("k2", F.lit(shards)).cast("int").alias("shard"), "k1", "k2", "doc", "line")


def _apply(how: str):
    def run(key, state: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.load(*state[["filter", "refs", "counts"]].iloc[0]) if len(state) else Shard()
        refs = np.zeros(len(batch), _REF)
        for c in ("k1", "k2", "doc", "line"):
            refs[c] = batch[c]
        if len(refs):
            getattr(shard, how)(refs)
        return pd.DataFrame([(int(key[0]), *shard.dump())], columns=["shard", "filter", "refs", "counts"])

    return run


#: Bytes of text whose lines a shard is made for: some tens of thousands of references, so that its state fits a cell of a row.
SHARD_BYTES = 16 << 20


class LineIndex:
    """The state of all shards, as a table in the shared folder, replaced by each change.

    shards is best chosen for all the text that the index will ever hold: shards_for() gives it.  Each change takes null and
    empty texts as without lines, leaves rows with a null id out, and takes rows repeated under one id as that document's lines, each;
    an empty table changes nothing, and other columns aren't read.
    """

    def __init__(self, spark, shards: int | None = None):
        self.spark, self.shards = spark, shards or shuffle_partitions(spark)
        self.table = Table(spark.createDataFrame([], STATE), "lines")

    def _change(self, how: str, docs: DataFrame, id_col: str, text_col: str) -> LineIndex:
        batch = lines_of(docs, self.shards, id_col, text_col)
        new = Table(self.table.df.groupBy("shard").cogroup(batch.groupBy("shard")).applyInPandas(_apply(how), STATE), "lines")
        self.table.drop()
        self.table = new
        return self

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return self._change("insert", docs, id_col, text_col)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Take documents out again; their rows must have the texts that were inserted.  One that was never inserted changes nothing."""
        return self._change("delete", docs, id_col, text_col)

    def dropped(self) -> DataFrame:
        """(doc_id, line_no, keep_id) of every line that an earlier document, or place in its own, has: keep_id is the document that keeps it.

        Of equal lines that with the least (id, number) stays; an empty index gives no rows.
        """

        def run(batches):
            for pdf in batches:
                for parts in zip(pdf["filter"], pdf["refs"], pdf["counts"]):
                    doc, line, first = Shard.load(*parts).dropped()
                    yield pd.DataFrame({"doc_id": doc, "line_no": line, "keep_id": first})

        return self.table.df.mapInPandas(run, "doc_id bigint, line_no int, keep_id bigint")


def line_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """(doc_id, line_no, keep_id) of all lines to drop from docs, as LineIndex.dropped() gives them.

    Lines are numbered from 0.  Of equal lines that with the least (id, number) stays.  Blank lines all stay; null and
    empty texts have no lines; rows with a null id aren't indexed and keep their lines; rows repeated under one
    id count as one document's lines, each; an empty table gives no rows; other columns aren't read; a long text
    is indexed whole.  Ids must be integers.
    """
    return LineIndex(docs.sparkSession, shards or shards_for(docs, text_col)).insert(docs, id_col, text_col).dropped()


def drop_lines(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that ``dropped`` names; texts that lose none, null and empty ones among them, are as before.

    All columns stay, whatever their names; rows repeated under one id lose the same lines; a null id loses none.
    """
    columns = docs.columns
    by = dropped.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("_id")).join(by, "_id", "left")
    text = F.col("row").getField(text_col)
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.array_join(F.transform(F.filter(numbered, lambda s: ~F.array_contains(F.col("_gone"), s["i"])), lambda s: s["x"]), "\n")
    return rows.select(*[(F.when(F.col("_gone").isNull(), text).otherwise(kept) if c == text_col else F.col("row").getField(c)).alias(c) for c in columns])
