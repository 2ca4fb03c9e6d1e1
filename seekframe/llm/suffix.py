"""Repeated passages by a logarithmic family of suffix arrays.

A repeat is a run of at least LEAST words that stands at two places.  Every start of LEAST words belongs to the shard of
its least 8-gram (a minimizer), so equal starts meet in one shard, and neighbouring ones mostly share theirs and travel as one
segment.  A minimizer that occurs once is in no repeat; its segments aren't sent.

A shard takes its segments in batches.  A new batch gets a suffix array of its starts (prefix doubling up to LEAST words); neighbours
in it with a long enough common prefix are repeats within the batch.  It is then merge-scanned against each level of
the shard's family, which finds its repeats of earlier batches, and becomes a new level; levels of like size are merged until each is at
least twice as large as the next, so a start takes part in a logarithmic number of merges.  Of equal starts the first is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, mix, shuffle_partitions, slices, words_of

LEAST = 50
ANCHOR = 8
#: Arrival batches of a run over a whole table.
BATCHES = 4


# --- one shard's family -----------------------------------------------------------------------------------


def _dense(key: np.ndarray) -> np.ndarray:
    """Rank of each number among the distinct ones."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    step = np.concatenate(([0], (k[1:] != k[:-1]).astype(np.int64)))
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(step)
    return out


class Level:
    """Distinct starts of at least ``least`` words in the order of their first ``least`` words."""

    def __init__(self, words: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray):
        self.words, self.at, self.doc, self.place = words, at, doc, place

    def __len__(self) -> int:
        return len(self.at)


def build(words: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, least: int) -> tuple[Level, np.ndarray, np.ndarray]:
    """A level of the distinct starts; the starts that repeat an earlier one; and for each, which of the level it repeats.

    words: the segments one after the other; at: starts in them, each followed by ``least`` words of its segment; they
    come from ``place`` in document ``doc``.  Of equal starts the least (doc, place) is kept.
    """
    rank, width = _dense(words), 1
    while width < least:
        step = min(width, least - width)  # the last step overlaps
        next_rank = np.zeros(len(rank), np.int64)
        next_rank[: len(rank) - step] = rank[step:] + 1
        if width + step >= least:
            rank = rank[at] * (len(words) + 2) + next_rank[at]
        else:
            rank = _dense(rank * (len(words) + 2) + next_rank)
        width += step
    if least == 1:
        rank = rank[at]
    order = np.lexsort((place, doc, rank))  # the suffix array
    r = rank[order]
    lead = np.ones(len(r), np.bool_)
    lead[1:] = r[1:] != r[:-1]
    of = np.cumsum(lead) - 1
    kept = order[lead]
    return Level(words, at[kept], doc[kept], place[kept]), order[~lead], of[~lead]


def _compare(a: Level, i: np.ndarray, b: Level, j: np.ndarray, least: int) -> np.ndarray:
    """Sign of start i of a against start j of b, on their first ``least`` words."""
    out, live = np.zeros(len(i), np.int8), np.arange(len(i))
    p, q = a.at[i], b.at[j]
    for t in range(least):
        x, y = a.words[p[live] + t], b.words[q[live] + t]
        differ = x != y
        out[live[differ]] = np.where(x[differ] < y[differ], -1, 1)
        live = live[~differ]
        if not len(live):
            break
    return out


def locate(new: Level, old: Level, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of new, how many of old lie before it, and whether the next one equals it.

    A merge scan: both are sorted, so first words are matched in one pass, and the search goes on within runs of them only.
    """
    first_new, first_old = new.words[new.at], old.words[old.at]
    lo = np.searchsorted(first_old, first_new, "left")
    hi = np.searchsorted(first_old, first_new, "right")
    equal = np.zeros(len(new), np.bool_)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        sign = _compare(new, live, old, mid, least)
        equal[live[sign == 0]] = True
        hi[live] = np.where(sign <= 0, mid, hi[live])
        lo[live] = np.where(sign > 0, mid + 1, lo[live])
        live = live[lo[live] < hi[live]]
    return lo, equal


def merge(old: Level, new: Level, before: np.ndarray) -> Level:
    """Both levels as one; before: the places of new in old."""
    where = before + np.arange(len(new))
    keep = np.ones(len(old) + len(new), np.bool_)
    keep[where] = False

    def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(keep), np.int64)
        out[where], out[keep] = y, x
        return out

    return Level(np.concatenate((old.words, new.words)), both(old.at, new.at + len(old.words)), both(old.doc, new.doc), both(old.place, new.place))


class Family:
    """Levels from the largest to the smallest, no start in two of them."""

    def __init__(self, least: int = LEAST):
        self.least, self.levels, self.merges = least, [], 0

    def insert(self, words: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray):
        """(doc, place, first doc, first place) of the batch's starts that repeat another of it, or an earlier batch's."""
        if not len(at):
            return (np.zeros(0, np.int64),) * 4
        level, again, of = build(words, at, doc, place, self.least)
        first_doc, first_place = level.doc.copy(), level.place.copy()
        fresh = np.ones(len(level), np.bool_)
        for old in self.levels:
            here = np.flatnonzero(fresh)
            some = Level(level.words, level.at[here], level.doc[here], level.place[here])
            before, equal = locate(some, old, self.least)
            hit = here[equal]
            first_doc[hit], first_place[hit] = old.doc[before[equal]], old.place[before[equal]]
            fresh[hit] = False
        late = ~fresh
        out = (
            np.concatenate((doc[again], level.doc[late])), np.concatenate((place[again], level.place[late])),
            np.concatenate((first_doc[of], first_doc[late])), np.concatenate((first_place[of], first_place[late])),
        )
        if fresh.any():
            self.levels.append(Level(level.words, level.at[fresh], level.doc[fresh], level.place[fresh]))
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            new, old = self.levels.pop(), self.levels.pop()
            self.levels.append(merge(old, new, locate(new, old, self.least)[0]))
            self.merges += 1
        return out


# --- distribution -----------------------------------------------------------------------------------------


def _least_grams(texts, least: int, anchor: int):
    """Words of a slice, its starts of ``least`` words, their minimizers and the places of these, and the first word and the number of words of each text."""
    words, _, _, first, _ = words_of(texts)
    count = np.diff(first)
    wide = least - anchor + 1
    n = len(words)
    starts = np.concatenate([np.arange(a, a + c - least + 1) for a, c in zip(first, count) if c >= least] or [np.zeros(0, np.int64)])
    if not len(starts):
        return words, starts, np.zeros(0, np.int64), np.zeros(0, np.int32), first
    grams = np.zeros(n, np.uint64)
    for i in range(anchor):
        grams[: n - i] = mix(grams[: n - i] * np.uint64(0x9E3779B97F4A7C15) + words[i:])
    # the leftmost least gram of the first 1, 2, 4, ... places from each on
    low, where, width = grams, np.arange(n, dtype=np.int32), 1

    def first_least(i, j):
        right = low[j] < low[i]
        return np.where(right, low[j], low[i]), np.where(right, where[j], where[i])

    while 2 * width <= wide:
        new = first_least(slice(0, n - width), slice(width, n))
        low, where = (np.concatenate((x, y[n - width :])) for x, y in zip(new, (low, where)))
        width *= 2
    m, at = first_least(starts, starts + (wide - width))
    return words, starts, m.view(np.int64), at, first


def _runs(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bounds of the runs of neighbouring starts with one minimizer at one place."""
    if not len(starts):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero((np.diff(starts) != 1) | (np.diff(at) != 0)) + 1, [len(starts)]))


_SEGMENTS = "shard int, batch int, docs binary, places binary, counts binary, words binary"
_FOUND = "doc_id bigint, lo bigint, hi bigint, first_id bigint"


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """(doc_id, start_word, end_word, first_ids): every passage of at least ``least`` words that stands at an earlier place too.

    Words are lower-cased runs of letters and digits, numbered from 0; end_word is excluded.  Passages that overlap or touch are one.
    first_ids lists the documents that hold the first copies of its parts: earlier is what arrives in an earlier batch (by a hash of
    the id), and in one batch what has the smaller (id, place); it may be the same document.  Null, empty and short texts have
    no passages; rows with a null id are left out; rows repeated under one id repeat each other; an empty table gives
    no rows; other columns aren't read; texts count whole whatever their length.  Ids must be integers.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    anchor = max(1, min(ANCHOR, least - 1))
    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id is not null and text is not null")

    def anchors(batches_in):
        for pdf in slices(batches_in, "text"):
            _, starts, m, at, first = _least_grams(pdf["text"], least, anchor)
            cut = _runs(starts, at)[:-1]
            if len(starts):
                of = np.searchsorted(first, starts[cut], "right") - 1
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(np.int64)[of], "m": m[cut]})

    found = Table(narrow.mapInPandas(anchors, "doc_id bigint, m bigint"), "anchors")
    shared = found.df.groupBy("m").count().filter("count > 1").select("m")
    wanted = Table(found.df.join(shared, "m").groupBy("doc_id").agg(F.collect_set("m").alias("ms")), "anchors-shared")
    found.drop()

    def segments(batches_in):
        for pdf in slices(batches_in, "text"):
            words, starts, m, at, first = _least_grams(pdf["text"], least, anchor)
            if not len(starts):
                continue
            cut = _runs(starts, at)
            lo, hi, name = starts[cut[:-1]], starts[cut[1:] - 1], m[cut[:-1]]
            keep = np.isin(name, np.unique(np.concatenate([np.asarray(x, np.int64) for x in pdf["ms"]])))
            lo, hi, name = lo[keep], hi[keep], name[keep]
            of = np.searchsorted(first, lo, "right") - 1
            ids = pdf["doc_id"].to_numpy(np.int64)[of]
            shard = (mix(name.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            batch = (mix(ids.view(np.uint64)) % np.uint64(batches)).astype(np.int64)
            group = shard * batches + batch
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0, [True]))) if len(order) else np.zeros(1, np.int64)
            length = hi - lo + least
            out = []
            for a, b in zip(edges, edges[1:]):
                o = order[a:b]
                n = length[o]
                index = np.repeat(lo[o] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                # six bytes of a word's name are enough: all of the fifty would have to collide
                six = words[index].view(np.uint8).reshape(-1, 8)[:, :6]
                out.append((int(shard[o[0]]), int(batch[o[0]]), ids[o].tobytes(), (lo[o] - first[of[o]]).tobytes(), n.astype("<i4").tobytes(), six.tobytes()))
            yield pd.DataFrame(out, columns=["shard", "batch", "docs", "places", "counts", "words"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        family, hits = Family(least), []
        for _, part in sorted(pdf.groupby("batch"), key=lambda g: g[0]):
            six = np.frombuffer(b"".join(part["words"]), np.uint8).reshape(-1, 6)
            words = np.zeros((len(six), 8), np.uint8)
            words[:, :6] = six
            words = words.view("<i8").ravel()
            counts = np.frombuffer(b"".join(part["counts"]), "<i4").astype(np.int64)
            doc, place = (np.frombuffer(b"".join(part[c]), "<i8") for c in ("docs", "places"))
            each = counts - least + 1
            within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            hits.append(family.insert(words, np.repeat(np.cumsum(counts) - counts, each) + within, np.repeat(doc, each), np.repeat(place, each) + within))
        doc, place, first, at = (np.concatenate(x) for x in zip(*hits))
        order = np.lexsort((place, doc))
        doc, place, first, at = doc[order], place[order], first[order], at[order]
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(place) > 1) | (np.diff(first) != 0)))) if len(doc) else np.zeros(0, np.int64)
        last = np.append(cut[1:], len(doc)) - 1 if len(doc) else cut
        return pd.DataFrame({"doc_id": doc[cut], "lo": place[cut], "hi": place[last] + least, "first_id": first[cut]})

    sent = narrow.join(wanted.df.hint("merge"), "doc_id").mapInPandas(segments, _SEGMENTS)
    hits = Table(sent.groupBy("shard").applyInPandas(search, _FOUND), "repeats")
    wanted.drop()
    in_doc = Window.partitionBy("doc_id").orderBy("lo", "hi", "first_id")
    so_far = F.max("hi").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.df.withColumn("new", (so_far.isNull() | (F.col("lo") > so_far)).cast("int")).withColumn("span", F.sum("new").over(in_doc))
    out = spans.groupBy("doc_id", "span").agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"), F.array_sort(F.collect_set("first_id")).alias("first_ids"))
    return out.drop("span")
