"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two documents are linked if the Jaccard similarity of their sets of word n-grams is at least ``threshold``.  A gram is
named by 64 bits.  Of documents with identical texts, then of those with identical sets, the least id stands for all.

1. Filter.  Documents are read in slices.  Of each gram a bucket and MARK_BITS bits are sent to that bucket, sorted and delta-coded; a bucket's
   task tells each slice which of its documents' grams another document may hold too.  A document needs T = ceil(threshold * size) of
   these, or it's linked to nothing.  Equal bits of different grams only let a document pass.
2. Sets.  The documents that pass get their grams named in full, those held by one document alone are dropped, and the rest are ordered from the rarest to the
   commonest; fewer than T left, and the document is linked to nothing.
3. Homes.  A document lives in the index shard of its commonest gram, where its near copies mostly live too.  Two linked documents share a gram
   among the size - T + 1 rarest of both, so each document is also sent as a query to the homes that hold one of its own.
4. Search.  A shard answers queries from inverted lists: the short lists are heap-merged to count each document's occurrences,
   documents with T - L of them are completed by binary probes of the L long lists, and those with the
   overlap that their own size requires are links.  For classes, grams that DENSE residents or more hold are bits instead of lists: they are counted
   64 at a time, so that lines that many documents repeat, and large families of near copies, aren't merged for each of their members.  What leaves a shard is linear in its documents: classes and counts, or edges to documents that may stay.

Filters only drop what can't reach the threshold, and nothing is capped.  Numbers of buckets and shards follow from measured bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_left
from itertools import chain, groupby
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, components, lean, lean_group, mix, ngram_names, packed, shuffle_partitions, stable, unpacked, words_of

N = 5
THRESHOLD = 0.3
#: Bytes of text, and named grams, that a bucket of the first two steps is made for.
BUCKET_BYTES, BUCKET_GRAMS = 16 << 20, 2 << 20
#: Bits of a gram's mark within its bucket; of some 2.4 million in one, 4 % then seem to be shared by chance.
MARK_BITS = 26
#: Postings that a bin of homes is made for, and that a home holds at most, unless a single document has more.
BIN_POSTINGS, SHARD_POSTINGS = 400_000, 1 << 20
#: Residents of a shard from which on a gram that they hold is a bit of theirs, and no list.
DENSE = 64
SLICE_CHARS, SLICE_DOCS = 4 << 20, 50_000

_EPS = 1e-9
_LOW = np.uint64(0xFFFFFFFF)


def need(size: int, threshold: float) -> int:
    """T: the least overlap with any set that a set of this size needs."""
    return max(1, ceil(size * threshold - _EPS))


def _needs(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.maximum(1, np.ceil(size * threshold - _EPS)).astype(np.int64)


# --- blobs ------------------------------------------------------------------------------------------------


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1) if len(x) else b""


def _spread(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _text_slices(batches):
    """(ids, texts) of Arrow batches in pieces of about SLICE_CHARS bytes; a text is never cut, and a longer one is a piece by itself."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy()
        piece = (np.cumsum(size + SLICE_CHARS / SLICE_DOCS) // SLICE_CHARS).astype(np.int64)
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(size)]):
            if b > a:
                yield batch["doc_id"].slice(a, b - a).to_numpy(zero_copy_only=False), batch["text"].slice(a, b - a).to_pylist()


# --- step 1 -----------------------------------------------------------------------------------------------

_MARKS = "bucket int, slice bigint, marks binary, docs binary, ids binary, sizes binary"
_HELD = "slice bigint, docs binary, ids binary, sizes binary"


def _mark(n: int, buckets: int):
    bits = np.uint64(min(MARK_BITS, 48 - (buckets - 1).bit_length()))  # of a mark; its place among all buckets and 16 bits of a document fill 64
    b, sixteen = np.uint64(buckets), np.uint64(16)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for ids, texts in _text_slices(batches):
            words, _, _, first, _ = words_of(texts)
            grams, of = ngram_names(words, first, n)
            number += 1
            # the place of each gram among the buckets, in 1 / 2**bits of one
            place = ((grams >> np.uint64(32)) * b + (((grams & _LOW) * b) >> np.uint64(32))) >> (np.uint64(32) - bits)
            key = np.sort(place << sixteen | of.astype(np.uint64))
            key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
            docs = (key & np.uint64(0xFFFF)).astype("<u2")
            marks = (key >> sixteen & ((np.uint64(1) << bits) - np.uint64(1))).astype("<u4")
            cut = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << (bits + sixteen))
            rows = [(k, number, _squeeze(np.diff(marks[cut[k] : cut[k + 1]], prepend=np.uint32(0))), _squeeze(docs[cut[k] : cut[k + 1]]), None, None) for k in np.flatnonzero(np.diff(cut)).tolist()]
            sizes = np.bincount(docs, minlength=len(ids)).astype("<u4")
            rows.append((number % buckets, number, b"", b"", _squeeze(np.asarray(ids, "<i8")), _squeeze(sizes)))
            yield _batch(_MARKS, rows)

    return run


def _count_marks(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each slice of a bucket, the document of each gram that another document may hold."""
    marks = [np.cumsum(_spread(m, "<u4"), dtype=np.uint32) for m in pdf["marks"]]
    cut = np.concatenate(([0], np.cumsum([len(m) for m in marks])))
    marks = np.concatenate(marks)
    order = np.argsort(marks)
    m = marks[order]
    same = m[1:] == m[:-1]
    several = np.zeros(len(m), np.bool_)
    several[order] = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(m) else False
    del order, m, marks
    out = []
    for i, (number, docs, ids, sizes) in enumerate(zip(pdf["slice"], pdf["docs"], pdf["ids"], pdf["sizes"])):
        here = several[cut[i] : cut[i + 1]]
        if ids is not None or here.any():
            out.append((number, _squeeze(_spread(docs, "<u2")[here]), ids, sizes))
    return pd.DataFrame(out, columns=["slice", "docs", "ids", "sizes"])


def _passing(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["ids"].notna()].iloc[0]
        ids, sizes = _spread(head["ids"], "<i8"), _spread(head["sizes"], "<u4").astype(np.int64)
        held = np.zeros(len(ids), np.int64)
        for docs in pdf["docs"]:
            held += np.bincount(_spread(docs, "<u2"), minlength=len(ids))
        able = (sizes > 0) & (held >= _needs(sizes, threshold))
        return pd.DataFrame({"id": ids[able], "size": sizes[able]})

    return run


# --- step 2 -----------------------------------------------------------------------------------------------

_SET = "id bigint, size int, k1 bigint, k2 bigint, grams binary, places binary, lines binary, counts binary"


def _lines_of(words: np.ndarray, starts: np.ndarray, first: np.ndarray, data: bytes):
    """Line of each word, numbered over the batch; the name of each line that has words, by these; and its first word."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(breaks, starts)
    begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    within = np.arange(len(line)) - np.repeat(begin, np.diff(np.append(begin, len(line))))
    names = np.add.reduceat(mix(words ^ mix(within.astype(np.uint64) + np.uint64(1))), begin) if len(begin) else np.zeros(0, np.uint64)
    return np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(line)))), names, begin


def _name(n: int, with_lines: bool):
    """(id, size, name of the set, grams ascending) of each document; with_lines: the line of each gram, if one holds it whole, and the names and numbers of grams of the lines."""

    def run(batches):
        for ids, texts in _text_slices(batches):
            words, starts, _, first, data = words_of(texts)
            grams, of = ngram_names(words, first, n)
            at = np.full(len(grams), -1, np.int64)
            names = begin = np.zeros(0, np.uint64)
            if with_lines and len(words):
                line, names, begin = _lines_of(words, starts, first, data)
                # the grams of texts with n words come first, in their order, then the single ones of shorter texts
                long = int((np.diff(first)[of] >= n).sum())
                lead = first[of]
                lead[:long] += np.arange(long) - np.searchsorted(of[:long], of[:long], "left")
                last = np.concatenate((lead[:long] + n, first[of[long:] + 1])) - 1
                at = np.where(line[lead] == line[last], line[lead], -1)
            order = np.lexsort((grams, of))
            grams, of, at = grams[order], of[order], at[order]
            fresh = np.ones(len(grams), np.bool_)
            fresh[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
            grams, of, at = grams[fresh], of[fresh], at[fresh]
            cut = np.searchsorted(of, np.arange(len(ids) + 1))
            rows = []
            for t in np.flatnonzero(np.diff(cut)).tolist():
                own, own_at = grams[cut[t] : cut[t + 1]], at[cut[t] : cut[t + 1]]
                k1, k2 = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "<i8").tolist()
                lines = counts = places = b""
                if with_lines:
                    a, b = np.searchsorted(begin, (first[t], first[t + 1])).tolist()
                    lines = names[a:b].tobytes()
                    counts = np.bincount(own_at[own_at >= 0] - a, minlength=b - a).astype("<u4").tobytes()
                    places = np.where(own_at >= 0, own_at - a, -1).astype("<i4").tobytes()
                rows.append((int(ids[t]), len(own), k1, k2, own.tobytes(), places, lines, counts))
            if rows:
                yield _batch(_SET, rows)

    return run


_GRAMS = "bucket int, slice bigint, grams binary, docs binary, places binary, rows binary, lines binary, counts binary"
_SHARED = "slice bigint, grams binary, docs binary, places binary, dfs binary, rows binary, lines binary, counts binary"
_ROW = ("id", "k1", "size", "weight")


def _blobs(buckets: int):
    """The grams of a slice of sets by bucket, and the sets' own numbers and lines once."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                number += 1
                own = [np.frombuffer(x, "<u8") for x in part["grams"].to_pylist()]
                docs = np.repeat(np.arange(len(own)), [len(x) for x in own]).astype("<u2")
                grams, places = np.concatenate(own), np.frombuffer(b"".join(part["places"].to_pylist()), "<i4")
                order = np.argsort(grams, kind="stable")
                grams, docs, places = grams[order], docs[order], places[order] if len(places) else places
                place = ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cut = np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64))
                rows = []
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    here = slice(cut[k], cut[k + 1])
                    rows.append((k, number, _squeeze(np.diff(grams[here], prepend=np.uint64(0))), _squeeze(docs[here]), _squeeze(places[here]), None, None, None))
                lines = part["lines"].to_pylist()
                head = [part[c].to_numpy().astype("<i8") for c in _ROW] + [np.array([len(x) // 8 for x in lines], "<i8")]
                rows.append((number % buckets, number, b"", b"", b"", _squeeze(np.concatenate(head)), b"".join(lines), b"".join(part["counts"].to_pylist())))
                yield _batch(_GRAMS, rows)

    return run


def _count_grams(pdf: pd.DataFrame) -> pd.DataFrame:
    """The grams of a bucket that two sets or more hold, with their number, by slice."""
    each = [np.cumsum(_spread(g, "<u8"), dtype=np.uint64) for g in pdf["grams"]]
    cut = np.concatenate(([0], np.cumsum([len(g) for g in each])))
    grams = np.concatenate(each)
    del each
    order = np.argsort(grams)
    g = grams[order]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    length = np.diff(np.append(starts, len(g)))
    df = np.empty(len(g), "<u4")
    df[order] = np.repeat(length, length)
    del order, g
    out = []
    for i, (number, docs, places, rows, lines, counts) in enumerate(zip(*(pdf[c] for c in ("slice", "docs", "places", "rows", "lines", "counts")))):
        here = df[cut[i] : cut[i + 1]]
        several = here > 1
        if rows is not None or several.any():
            places = _spread(places, "<i4")
            out.append((number, _squeeze(np.diff(grams[cut[i] : cut[i + 1]][several], prepend=np.uint64(0))), _squeeze(_spread(docs, "<u2")[several]), _squeeze(places[several]) if len(places) else b"", _squeeze(here[several]), rows, lines, counts))
    return pd.DataFrame(out, columns=["slice", "grams", "docs", "places", "dfs", "rows", "lines", "counts"])


_RANKED = "id bigint, k1 bigint, size bigint, weight bigint, ranked binary, places binary, lines binary, counts binary"


def _rank_slice(threshold: float):
    """The sets of a slice that can be linked, their shared grams from the rarest to the commonest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["rows"].notna()].iloc[0]
        heads = _spread(head["rows"], "<i8").reshape(len(_ROW) + 1, -1).T
        line = np.concatenate(([0], np.cumsum(heads[:, -1])))
        grams = np.concatenate([np.cumsum(_spread(g, "<u8"), dtype=np.uint64) for g in pdf["grams"]])
        docs, places, df = (np.concatenate([_spread(x, k) for x in pdf[c]]) for c, k in (("docs", "<u2"), ("places", "<i4"), ("dfs", "<u4")))
        order = np.lexsort((grams, df, docs))
        docs, grams, places = docs[order], grams[order], places[order] if len(places) else places
        cut = np.searchsorted(docs, np.arange(len(heads) + 1))
        out = []
        for i in np.flatnonzero(np.diff(cut) >= _needs(heads[:, 2], threshold)):
            own, lines = slice(cut[i], cut[i + 1]), (line[i], line[i + 1])
            out.append((*heads[i, :-1].tolist(), grams[own].tobytes(), places[own].tobytes(), head["lines"][8 * lines[0] : 8 * lines[1]], head["counts"][4 * lines[0] : 4 * lines[1]]))
        return pd.DataFrame(out, columns=[*_ROW, "ranked", "places", "lines", "counts"])

    return run


# --- step 3 -----------------------------------------------------------------------------------------------

_PREFIX = "gram bigint, id bigint, home bigint, size int"


def _prefixes(threshold: float, halved: bool):
    """The size - T + 1 rarest grams of each set, T by its whole size; halved: half their names, where another gram with the same half only adds a route, of which there are ever more in larger tables."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                size = part["size"].to_numpy()
                own = [np.frombuffer(x, "<i8") for x in part["ranked"].to_pylist()]
                own = [x[: len(x) - t + 1] for x, t in zip(own, _needs(size, threshold))]
                n = [len(x) for x in own]
                columns = [np.concatenate(own).astype(np.int32 if halved else np.int64), np.repeat(part["id"].to_numpy(), n), np.repeat(part["home"].to_numpy(), n), np.repeat(size, n).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "id", "home", "size"])

    return run


# --- step 4 -----------------------------------------------------------------------------------------------


class Lists:
    """Inverted lists of the documents of one shard, which are added in ascending order of their ids."""

    def __init__(self):
        self.lists, self.ids, self.sizes = {}, [], []

    def add(self, ident: int, size: int, grams: list[int]) -> int:
        d, lists = len(self.ids), self.lists
        for g in grams:
            held = lists.get(g)
            if held is None:
                lists[g] = d  # most lists have one entry
            elif isinstance(held, list):
                held.append(d)
            else:
                lists[g] = [held, d]
        self.ids.append(ident)
        self.sizes.append(size)
        return d

    def of(self, grams: list[int]) -> list[list[int]]:
        """The lists of these grams, those that are here, shortest first."""
        found = [x if isinstance(x, list) else [x] for x in map(self.lists.get, grams) if x is not None]
        found.sort(key=len)
        return found


def heap_merge(lists: list[list[int]], least: int = 1) -> list[tuple[int, int]]:
    """(document, on how many of the lists it is) of the documents on ``least`` lists or more, ascending.

    The heap holds one number for each list, its next document and its own number behind it; a document's lists leave the heap together.
    """
    bits = len(lists).bit_length()
    mask = (1 << bits) - 1
    heap = [x[0] << bits | i for i, x in enumerate(lists)]
    heapq.heapify(heap)
    rest = [iter(x) for x in lists]
    for it in rest:
        next(it)
    out, replace, pop = [], heapq.heapreplace, heapq.heappop
    while heap:
        d, n = heap[0] >> bits, 0
        end = (d + 1) << bits
        while heap and (top := heap[0]) < end:
            n += 1
            after = next(rest[top & mask], None)
            if after is None:
                pop(heap)
            else:
                replace(heap, after << bits | top & mask)
        if n >= least:
            out.append((d, n))
    return out


def _apart(lists: list[list[int]], t: int) -> int:
    """DivideSkip's number of long lists to probe, the lists being sorted by length: longer lists are worth more probes."""
    longest = len(lists[-1])
    return min(t - 1, int(t / (0.01 * np.log2(longest + 1) + 1))) if longest > 1 else 0


def divide_skip(index: Lists, grams: list[int], size: int, threshold: float, before: int, sure: float = 1.0) -> list[tuple[int, int]]:
    """(place, overlap) of the shard's documents with ids below ``before`` that are linked to a set.

    An overlap that makes the similarity ``sure`` or more is one found by then; the lists left aren't probed for the rest of it.
    """
    t = need(size, threshold)
    lists = index.of(grams)
    if len(lists) < t:
        return []
    apart = _apart(lists, t)
    short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
    ids, sizes, out = index.ids, index.sizes, []
    for d, n in heap_merge(short, t - apart):
        if ids[d] >= before:
            break
        both = sizes[d] + size
        required = max(t, ceil(both * threshold / (1 + threshold) - _EPS))
        enough = max(required, both * sure / (1 + sure))
        left = apart
        for x in long:
            if n + left < required or n >= enough:
                break
            left -= 1
            at = bisect_left(x, d)
            n += at < len(x) and x[at] == d
        if n >= required:
            out.append((d, n))
    return out


class Shard:
    """All residents of one shard, in ascending order of their ids: inverted lists of the grams that few hold, bits for the others.

    A word has the bits of 64 grams, and is kept for the residents alone that hold one of them.
    """

    def __init__(self, ids: list[int], sizes: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes, n = ids, np.array(sizes, np.int64), len(ids)
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        grams, self.docs = grams[order], np.repeat(np.arange(n), [len(x) for x in sets])[order]
        first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        self.grams, self.cut = grams[first], np.append(first, len(grams))
        length = np.diff(self.cut)
        dense = np.flatnonzero(length >= DENSE)
        # the grams of one resident are neighbours, so that those that hold the same ones have few words
        dense = dense[np.argsort(order[first[dense]])]
        self.bit = np.full(len(first), -1)
        self.bit[dense] = np.arange(len(dense))
        self.listed = np.bincount(self.docs[np.repeat(self.bit < 0, length)], minlength=n)
        length = length[dense]
        at = np.repeat(first[dense] - np.cumsum(length) + length, length) + np.arange(length.sum())
        bit = np.repeat(np.arange(len(dense)), length)
        key = (bit >> 6) * n + self.docs[at]
        order = np.argsort(key, kind="stable")
        key, mask = key[order], np.uint64(1) << (bit[order] & 63).astype(np.uint64)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.masks = np.bitwise_or.reduceat(mask, first) if len(first) else mask
        words = -(-len(dense) // 64)
        self.holders, self.word = key[first] % n, np.searchsorted(key[first], np.arange(words + 1) * n)

    def dense_overlaps(self, bits: np.ndarray, end: int) -> np.ndarray:
        """How many of these bits each of the first ``end`` residents has."""
        out = np.zeros(end, np.int64)
        asked = np.zeros(len(self.word) - 1, np.uint64)
        np.bitwise_or.at(asked, bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))
        for w in np.flatnonzero(asked).tolist():
            a, b = self.word[w], self.word[w + 1]
            b = a + np.searchsorted(self.holders[a:b], end)
            out[self.holders[a:b]] += np.bitwise_count(self.masks[a:b] & asked[w])
        return out

    def lists(self, at: np.ndarray, end: int) -> list[list[int]]:
        """The lists of the grams at these places among the first ``end`` residents, those that aren't empty, shortest first."""
        length = self.cut[at + 1] - self.cut[at]
        docs = self.docs[np.repeat(self.cut[at] - np.cumsum(length) + length, length) + np.arange(length.sum())]
        of = np.repeat(np.arange(len(at)), length)[docs < end]
        length = np.bincount(of, minlength=len(at))
        begin = np.cumsum(length) - length
        docs, order = docs[docs < end].tolist(), np.argsort(length, kind="stable")[np.count_nonzero(length == 0) :]
        return [docs[a:b] for a, b in zip(begin[order].tolist(), (begin + length)[order].tolist())]

    def links(self, grams: np.ndarray, size: int, threshold: float, before: int) -> np.ndarray:
        """Places of the residents with ids below ``before`` that are linked to a set."""
        end, t = bisect_left(self.ids, before), need(size, threshold)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        at = at[self.grams[at] == grams]
        if len(at) < t or not end:
            return np.zeros(0, np.int64)
        dense = self.bit[at] >= 0
        # what each resident still lacks for a link, and those that may hold as much among the grams with lists
        lack = np.maximum(t, np.ceil((self.sizes[:end] + size) * threshold / (1 + threshold) - _EPS).astype(np.int64)) - self.dense_overlaps(self.bit[at[dense]], end)
        able = np.flatnonzero(lack <= 0)
        open_lacks = lack[(lack > 0) & (lack <= np.minimum(self.listed[:end], np.count_nonzero(~dense)))]
        if not len(open_lacks):
            return able
        t_rest = int(open_lacks.min())
        lists = self.lists(at[~dense], end)
        if len(lists) < t_rest:
            return able
        apart = _apart(lists, t_rest)
        short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
        more = []
        for d, n in heap_merge(short, t_rest - apart):
            required = int(lack[d])
            if required <= 0:  # one of the able
                continue
            left = apart
            for x in long:
                if n + left < required or n >= required:
                    break
                left -= 1
                i = bisect_left(x, d)
                n += i < len(x) and x[i] == d
            if n >= required:
                more.append(d)
        return np.concatenate((able, np.array(more, np.int64)))


class Forest:
    """Classes of places: each leads to the least one of its class."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, places: np.ndarray) -> np.ndarray:
        at = self.parent[places]
        while not np.array_equal(up := self.parent[at], at):
            at = up
        self.parent[places] = at
        return at

    def join(self, places: np.ndarray) -> int:
        """Make the classes of these places one; its least place."""
        roots = self.roots(places)
        least = roots.min()
        self.parent[roots] = self.parent[places] = least
        return int(least)


def _homes(batches):
    """(home, kind, id, size, weight, ranked, the rest) of a partition sorted by home and, within it, with the residents first."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            yield from zip(*(part[c].to_pylist() for c in ("home", "kind", "id", "size", "weight", "ranked", "places", "lines", "counts")))


def _numbers(data: bytes) -> list[int]:
    return np.frombuffer(data, "<i8").tolist()


_FOUND = "id bigint, other bigint, links bigint"


def _search_classes(threshold: float):
    """For each document of a home or sent to it (id, a document of its class, links found here)."""

    def run(batches):
        out = []
        for _, rows in groupby(_homes(batches), key=lambda row: row[0]):
            held, sent = [], None
            for row in rows:
                if row[1]:
                    sent = row
                    break
                held.append(row)
            if not held:  # nothing lives here: read on
                continue
            ids, sizes, weights = (list(x) for x in zip(*((ident, size, weight) for _, _, ident, size, weight, *_ in held)))
            sets = [np.frombuffer(row[5], "<i8") for row in held]
            shard, forest, weights, links = Shard(ids, sizes, sets), Forest(len(ids)), np.array(weights, np.int64), np.zeros(len(ids), np.int64)
            del held
            for place, own in enumerate(sets):
                found = shard.links(own, sizes[place], threshold, ids[place])
                if len(found):
                    links[found] += weights[place]
                    links[place] += weights[found].sum()
                    forest.join(np.append(found, place))
            del sets
            for _, _, ident, size, weight, grams, *_ in () if sent is None else chain([sent], rows):
                found = shard.links(np.frombuffer(grams, "<i8"), size, threshold, ident)
                if len(found):
                    links[found] += weight
                    out.append((ident, ids[forest.join(found)], int(weights[found].sum())))
                if len(out) > 10_000:
                    yield _batch(_FOUND, out)
                    out = []
            linked = np.flatnonzero(links)
            out += [(ids[d], ids[r], n) for d, r, n in zip(linked.tolist(), forest.roots(linked).tolist(), links[linked].tolist())]
        if out:
            yield _batch(_FOUND, out)

    return run


#: From this similarity on, two documents are near copies.  Below, what both hold besides common lines has to confirm it.
STRONG = 0.5
#: The least similarity of the grams of two documents, without the lines that both hold, that confirms near copies.
LEAST_REST = 0.2


class _Lined:
    """What a document's grams and lines are, for alike_beside_lines()."""

    def __init__(self, size: int, grams: list[int], places: bytes, lines: bytes, counts: bytes):
        self.size, self.grams, self.parts = size, grams, (places, lines, counts)

    def open(self):
        places, lines, counts = (np.frombuffer(x, k) for x, k in zip(self.parts, ("<i4", "<u8", "<u4")))
        return dict(zip(self.grams, places.tolist())), lines.tolist(), counts.tolist()


def alike_beside_lines(a: _Lined, b: _Lined) -> bool:
    """Whether two documents are alike in more than some lines that both hold: in the grams that don't lie in these."""
    (at_a, lines_a, counts_a), (at_b, lines_b, counts_b) = a.open(), b.open()
    common = set(lines_a) & set(lines_b)
    if not common:
        return True
    out_a, out_b = ({i for i, x in enumerate(lines) if x in common} for lines in (lines_a, lines_b))
    both = sum(at_b.get(g, -2) not in out_b and g in at_b for g, i in at_a.items() if i not in out_a)
    either = a.size - sum(counts_a[i] for i in out_a) + b.size - sum(counts_b[i] for i in out_b) - both
    return not either or both >= LEAST_REST * either - _EPS


_EDGE = "a bigint, b bigint"


def _search_near(threshold: float, every: bool):
    """(a, b), a < b: b is a near copy of the resident a, which is none of a smaller resident that this holds for; (a, null): a resident a that is.

    every: all residents count, and aren't asked themselves.
    """

    def run(batches):
        home, out = None, []
        for at, kind, ident, size, _, grams, places, lines, counts in _homes(batches):
            if at != home:
                home, index, held = at, Lists(), []
            grams = _numbers(grams)
            own = _Lined(size, grams, places, lines, counts)
            near = []
            if kind or not every:
                for d, overlap in divide_skip(index, grams, size, threshold, ident, STRONG):
                    if overlap >= (STRONG - _EPS) * (size + index.sizes[d] - overlap) or alike_beside_lines(held[d], own):
                        near.append(index.ids[d])
            out += [(a, ident) for a in near]
            if kind == 0:
                if near:
                    out.append((ident, None))
                else:
                    index.add(ident, size, grams)
                    held.append(own)
            if len(out) > 10_000:
                yield _batch(_EDGE, out)
                out = []
        if out:
            yield _batch(_EDGE, out)

    return run


# --- the join ---------------------------------------------------------------------------------------------


def _total(table: Table, column) -> int:
    return int(table.df.agg(F.sum(column)).first()[0] or 0)


class _Join:
    """Steps 1 to 3: ``members`` (id, lead) of documents that another stands for, ``placed`` sets with their homes, and ``routes`` (id, home)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, weighted: bool = True, with_lines: bool = False, halved: bool = False):
        self.threshold, self.tables = threshold, []
        narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id is not null and text is not null")
        if not stable(narrow):
            narrow = self._table(narrow, "docs").df
        # of documents with identical texts, the least id stands for all
        named = narrow.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), F.octet_length("text").alias("bytes"))
        texts = Table(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("lead"), F.count_distinct("doc_id").alias("weight"), F.max("bytes").alias("bytes"), F.count("*").alias("n")), "join-texts")
        size, rows, ids = (int(x or 0) for x in texts.df.agg(F.sum("bytes"), F.sum("n"), F.sum("weight")).first())
        buckets = max(1, -(-size // BUCKET_BYTES))
        copied = texts.df.filter("weight > 1").select("h1", "h2", "lead")
        copies = Table(named.join(copied, ["h1", "h2"]).filter("doc_id <> lead").select("h1", "h2", F.col("doc_id").alias("copy"), "lead").distinct(), "join-copies")
        keys = [F.xxhash64("text") == F.col("h1"), F.xxhash64(F.lit("second"), "text") == F.col("h2"), F.col("doc_id") == F.col("copy")]
        first = narrow.join(copies.side(), keys, "left_anti")

        marks = first.mapInArrow(lean(_mark(n, buckets)), _MARKS).groupBy("bucket").applyInPandas(lean_group(_count_marks), _HELD)
        able = Table(marks.groupBy("slice").applyInPandas(lean_group(_passing(threshold)), "id bigint, size bigint"), "join-able")
        buckets, bins = (max(1, -(-_total(able, "size") // x)) for x in (BUCKET_GRAMS, BIN_POSTINGS))
        passed = first.join(able.side(), F.col("doc_id") == F.col("id"), "left_semi")
        sets = Table(passed.mapInArrow(lean(_name(n, with_lines)), _SET), "join-sets")
        able.drop()

        # of documents with identical sets, the least id stands for all
        heads = Table(sets.df.select("id", "k1", "k2").distinct(), "join-heads")
        same = Table(heads.df.groupBy("k1", "k2").agg(F.min("id").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n"), "join-same")
        alike = Table(heads.df.join(same.side(), ["k1", "k2"]).filter("id <> lead").select("id", "k1", "lead"), "join-alike")
        heads.drop()
        same.drop()
        renamed = copies.df.select("copy", "lead").join(alike.df.select(F.col("id").alias("lead"), F.col("lead").alias("new")), "lead", "left").select(F.col("copy").alias("id"), F.coalesce("new", "lead").alias("lead"))
        self.members = self._table(renamed.unionByName(alike.df.select("id", "lead")).filter("id <> lead").distinct(), "members")
        copies.drop()

        whole = sets.df.join(alike.side().select("id", "k1"), ["id", "k1"], "left_anti")
        if rows > ids:  # some rows are repeated under one id
            whole = whole.dropDuplicates(["id", "k1"])
        weights = self._table(self.members.df.groupBy(F.col("lead").alias("id")).agg((F.count_distinct("id") + 1).alias("weight")), "weights")
        if weighted:
            whole = whole.join(weights.side(), "id", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
        else:
            whole = whole.withColumn("weight", F.lit(1))
        blobs = whole.select(*_ROW, "grams", "places", "lines", "counts").mapInArrow(lean(_blobs(buckets)), _GRAMS).groupBy("bucket").applyInPandas(lean_group(_count_grams), _SHARED)
        ranked = blobs.groupBy("slice").applyInPandas(lean_group(_rank_slice(threshold)), _RANKED)
        ranked = Table(ranked.withColumn("bin", F.pmod(F.xxhash64(F.expr("substring(ranked, -8, 8)")), F.lit(bins))), "join-ranked")
        sets.drop()
        alike.drop()

        crowded = ranked.df.groupBy("bin").agg(F.ceil(F.sum(F.length("ranked")) / F.lit(8 * SHARD_POSTINGS)).alias("ways")).filter("ways > 1")
        crowded = self._table(crowded, "crowded")
        home = F.col("bin") * F.lit(1 << 24) + F.pmod(F.xxhash64("id", "k1"), F.coalesce("ways", F.lit(1)))
        self.placed = ranked.df.join(crowded.side(), "bin", "left").withColumn("home", home).drop("bin", "ways")
        self.tables.append(ranked)
        prefix = self.placed.select("id", "size", "ranked", "home").mapInArrow(lean(_prefixes(threshold, halved)), _PREFIX if not halved else _PREFIX.replace("gram bigint", "gram int"))
        lists = prefix.groupBy("gram", "home").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("id").alias("least"))
        a, b = prefix.alias("a"), lists.alias("b")
        near = (F.col("a.home") != F.col("b.home")) & (F.col("b.least") < F.col("a.id")) & (F.col("b.high") >= F.col("a.size") * F.lit(threshold) - _EPS) & (F.col("b.low") * F.lit(threshold) - _EPS <= F.col("a.size"))
        self.routes = self._table(a.join(b, (F.col("a.gram") == F.col("b.gram")) & near).select("a.id", "b.home").distinct(), "routes")
        self.tasks = max(bins, shuffle_partitions(docs.sparkSession))

    def _table(self, df: DataFrame, name: str) -> Table:
        self.tables.append(Table(df, f"join-{name}"))
        return self.tables[-1]

    def search(self, run, schema: str, residents: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
        """What ``run`` gives for each home's residents and the documents that are sent to it: by default all sets, by their routes.

        Given some residents alone, only their homes are asked, by what lives there too.
        """
        columns = ["home", "kind", "id", "size", "weight", "ranked", "places", "lines", "counts"]
        if residents is None:
            residents, sent = self.placed, self.placed.drop("home").join(self.routes.side(), "id")
        else:
            homes = self._table(residents.select("home").distinct(), "homes")
            routes = self._table(self.routes.df.join(homes.side(), "home", "left_semi"), "routes")
            sent = asked.drop("home").join(routes.side(), "id").unionByName(asked.join(homes.side(), "home", "left_semi"), allowMissingColumns=True)
        rows = residents.withColumn("kind", F.lit(0)).select(*columns).unionByName(sent.withColumn("kind", F.lit(1)).select(*columns))
        return rows.repartition(self.tasks, "home").sortWithinPartitions("home", "kind", "id").mapInArrow(lean(run), schema)

    def drop(self) -> None:
        for t in self.tables:
            t.drop()


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of every document that is linked to another.

    links is the number of documents whose similarity to it is at or above the threshold; class_id is the least id among all
    that links lead to from it, directly or through others.  Words are lower-cased runs of letters and digits; a text with fewer words than n has
    one gram.  A null, empty or wordless text is linked to nothing, nor is a row with a null id; rows repeated under an id count as one,
    and of different texts under one id the links are added up.  A pair at exactly the threshold is linked.  An empty table gives no rows, other
    columns are ignored, and texts count whole whatever their length.  Ids must be integers.
    """
    join = _Join(docs, id_col, text_col, n, threshold)
    found = Table(join.search(_search_classes(threshold), _FOUND), "join-found")
    labels = components(found.df.select(F.col("id").alias("u"), F.col("other").alias("v")))
    links = found.df.groupBy(F.col("id").alias("lead")).agg(F.sum("links").alias("found"))
    members = join.members.df
    every = members.unionByName(members.select(F.col("lead").alias("id"), "lead")).unionByName(found.df.select("id", F.col("id").alias("lead"))).distinct()
    weights = members.groupBy("lead").agg(F.count("*").alias("copies"))
    out = every.join(weights, "lead", "left").join(links, "lead", "left").join(labels.df.select(F.col("id").alias("lead"), "label"), "lead", "left")
    out = out.select(F.col("id").alias("doc_id"), F.coalesce("label", "lead").alias("class_id"), (F.coalesce("copies", F.lit(0)) + F.coalesce("found", F.lit(0))).alias("links"))
    out = Table(out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links")), "join-classes").df
    for t in (found, labels, join):
        t.drop()
    return out


def settle(edges: DataFrame) -> Table:
    """(id) of the documents dropped, where in the order of ids a document is dropped if an edge (a, b) leads to it from a smaller one that is kept.

    Each round keeps the documents without an open edge to them, drops what their edges lead to, and removes the edges of both.
    """
    left, dropped = Table(edges.select("a", "b").distinct(), "near-left"), []
    while not left.df.isEmpty():
        kept = left.df.select("a").distinct().join(left.df.select(F.col("b").alias("a")), "a", "left_anti")
        now = Table(left.df.join(kept, "a", "left_semi").select("b").distinct(), "near-dropped")
        dropped.append(now)
        rest = left.df.join(now.side(), "b", "left_anti").join(now.side().withColumnRenamed("b", "a"), "a", "left_anti")
        rest = Table(rest.select("a", "b"), "near-left")
        left.drop()
        left = rest
    out = left.df.select(F.col("b").alias("id"))
    for t in dropped:
        out = out.unionByName(t.df.select(F.col("b").alias("id")))
    out = Table(out, "near-gone")
    for t in (left, *dropped):
        t.drop()
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> Table:
    """(id) of every document that is a near copy of one with a smaller id that stays, never through a chain.

    Near copies are linked, and their similarity is STRONG or more or they are alike beside their common lines.  A
    home sends edges from those of its residents only that are near copies of no smaller such resident; one of the others that stays after all,
    as its near copies at home were dropped for some document elsewhere, is searched for once more.
    """
    join = _Join(docs, id_col, text_col, n, threshold, weighted=False, with_lines=True, halved=True)
    first = Table(join.search(_search_near(threshold, False), _EDGE), "near-edges")
    parts, done = [first], []
    while True:
        edges = parts[0].df.filter("b is not null")
        for t in parts[1:]:
            edges = edges.unionByName(t.df)
        gone = settle(edges)
        unsure = first.df.filter("b is null").select(F.col("a").alias("id")).distinct().join(gone.side(), "id", "left_anti")
        for t in done:
            unsure = unsure.join(t.df, "id", "left_anti")
        unsure = Table(unsure, "near-unsure")
        done.append(unsure)
        if unsure.df.isEmpty():
            break
        stay = join.placed.join(gone.side(), "id", "left_anti")
        parts.append(Table(join.search(_search_near(threshold, True), _EDGE, join.placed.join(unsure.side(), "id", "left_semi"), stay), "near-edges"))
        gone.drop()
    out = Table(gone.df.unionByName(join.members.df.select("id")).distinct(), "near-gone")
    for t in (*parts, *done, gone, join):
        t.drop()
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the near copies of documents that stay, with all columns; see near_copies().

    Documents with identical sets of grams are copies, of which the least id may stay.  Rows repeated under one id are one document and stay
    or go together; rows with a null id stay.  The other cases are as in ngram_classes().
    """
    gone = near_copies(docs, id_col, text_col, n, threshold)
    return unpacked(packed(docs).join(gone.side(), F.col("row").getField(id_col).cast("bigint") == F.col("id"), "left_anti"), docs)
