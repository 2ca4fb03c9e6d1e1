"""Scores of vectors by queries, a block of each at a time.

Rows are packed into blocks inside their own partitions.  A block of vectors meets a block of queries in one matrix product.
For the k best, each task holds some of the queries and the blocks of all vectors pass through it, one at a time: a query's k best
so far are kept there, so k rows of each query leave, however many vectors there are, and no more than one pair of blocks is in memory.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .rows import lanes

VECTOR_ROWS, QUERY_ROWS = 4096, 1024
#: Queries of which all scores are held at once, to be ranked.
RANKED_ROWS = 32
#: Scores of a block are held in pieces of at most so many.
MOST_SCORES = 1 << 22
_TIE = 2e-9


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[kind]


def pack(df: DataFrame, ids: str, values: str, kind: str, scale: str | None = None, matrix: bool = False, rows: int = VECTOR_ROWS, as_name: str = "v", of: str | None = None) -> DataFrame:
    """(ids, counts, dim, data, scales, no), prefixed by as_name: blocks of rows with one dimension.  kind: numpy type of the data, no: the block's number in its partition.

    matrix: values are arrays of vectors, of which counts says how many each row has.  Rows without values are left out, and
    so is what isn't as long as its row's first vector.  of: a column of arrays that goes along, as one more array.
    """
    id_type = df.schema[ids].dataType.simpleString()
    names = [as_name + c for c in ("ids", "counts", "dim", "data", "scales", "no")]

    def run(batches):
        no = count()
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch[ids], batch[values], *([batch[scale]] if scale else []), *([batch[of]] if of else [])], ["id", "v", *(["s"] if scale else []), *(["of"] if of else [])])
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                part = part.filter(pc.is_valid(part["v"]))
                v = part["v"]
                if matrix:
                    counts = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
                    v = v.flatten()
                else:
                    counts = np.ones(len(v), np.int64)
                width = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = v.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(counts)), counts)
                own = np.full(len(counts), width[0] if len(width) else 0)  # a row without vectors goes with the first
                lead = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
                own[row[lead]] = width[lead]
                for dim in np.unique(own).tolist():
                    mine = np.flatnonzero(own == dim)
                    fits = (width == dim) & (own[row] == dim)
                    n = np.bincount(row[fits], minlength=len(counts))
                    data = flat[np.repeat(fits, width)].astype(kind).tobytes()
                    s = part["s"].take(pa.array(mine)).to_numpy(zero_copy_only=False).astype("<f8").tobytes() if scale else b""
                    id_list = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), part["id"].take(pa.array(mine)).cast(_arrow(id_type)))
                    more = [pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), part["of"].take(pa.array(mine)))] if of else []
                    yield pa.RecordBatch.from_arrays([id_list, pa.array([n[mine].astype("<i4").tobytes()]), pa.array([dim], pa.int32()), pa.array([data]), pa.array([s]), pa.array([next(no)], pa.int64()), *more], names)

    schema = f"{names[0]} array<{id_type}>, {names[1]} binary, {names[2]} int, {names[3]} binary, {names[4]} binary, {names[5]} bigint"
    if of:
        names.append(as_name + "of")
        schema += f", {names[-1]} array<{df.schema[of].dataType.simpleString()}>"
    return df.select(*dict.fromkeys([ids, values, *([scale] if scale else []), *([of] if of else [])])).mapInArrow(run, schema)


def _best(s: np.ndarray, ids: np.ndarray | None, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each column by (score to 9 digits descending, id ascending); without numeric ids those that tie with the last stay too."""
    if k is None:
        row, col = np.nonzero(~np.isnan(s))
        return row, col
    s = np.where(np.isnan(s), -np.inf, s)
    if k < len(s):
        kth = np.partition(s, len(s) - k, axis=0)[len(s) - k]
        col, row = np.nonzero((s >= kth - _TIE).T & (s > -np.inf).T)
    else:
        col, row = np.nonzero((s > -np.inf).T)
    if ids is None or k >= len(s):
        return row, col
    order = np.lexsort((ids[row], -np.round(s[row, col], 9), col))
    row, col = row[order], col[order]
    rank = np.arange(len(col)) - np.searchsorted(col, col, "left")
    return row[rank < k], col[rank < k]


def _numbers(ids: pa.Array) -> np.ndarray:
    """Ids in an array that orders them as Spark does; they have no nulls."""
    return ids.to_numpy(zero_copy_only=False).astype(np.int64) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), dtype=str)


class Best:
    """The k best of each query of a block so far, by (score to 9 digits descending, id ascending)."""

    def __init__(self, queries: int, k: int):
        self.k, self.s, self.ids, self.new, self.pending = k, np.full((queries, k), -np.inf), None, [], 0

    def add(self, s: np.ndarray, ids: np.ndarray) -> None:
        """s: the scores (queries, vectors) of one more block."""
        hit = s >= (self.s[:, -1] - _TIE)[:, None]
        if self.s[:, -1].min() == -np.inf:
            hit &= s > -np.inf
        if s.shape[1] > self.k and np.count_nonzero(hit) > 4 * self.k * len(s):
            kth = np.partition(np.where(np.isnan(s), -np.inf, s), s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            hit &= s >= (kth - _TIE)[:, None]
        q, v = np.nonzero(hit)
        self.add_pairs(q, s[q, v], ids[v])

    def add_pairs(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        self.new.append((q, s.astype(np.float64), ids))
        self.pending += len(q)
        if self.pending >= self.k * len(self.s):  # sorting them costs more than a threshold that lags behind
            self.merge()

    def merge(self) -> None:
        if not self.pending:
            return
        if self.ids is None:
            self.ids = np.zeros(self.s.shape, self.new[0][2].dtype)
        n = len(self.s)
        q, s, ids = (np.concatenate(x) for x in zip((np.repeat(np.arange(n), self.k), self.s.ravel(), self.ids.ravel()), *self.new))
        order = np.lexsort((ids, -np.round(s, 9), q))
        q = q[order]
        many = np.bincount(q, minlength=n)
        first = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many) < self.k
        order = order[first]
        self.s, self.ids, self.new, self.pending = s[order].reshape(n, self.k), ids[order].reshape(n, self.k), [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id)"""
        self.merge()
        q, at = np.nonzero(self.s > -np.inf)
        return q, self.s[q, at], self.ids[q, at] if self.ids is not None else np.zeros(0, np.int64)


def _block(columns: dict, i: int, c: str) -> tuple:
    return columns[c + "data"][i].as_py(), np.frombuffer(columns[c + "counts"][i].as_py(), "<i4"), np.frombuffer(columns[c + "scales"][i].as_py(), "<f8")


def _types(vectors: DataFrame, queries: DataFrame) -> tuple[str, str]:
    return tuple(df.schema[c].dataType.elementType.simpleString() for df, c in ((vectors, "vids"), (queries, "qids")))


def scored(vectors: DataFrame, queries: DataFrame, ids: str, query_ids: str, product) -> DataFrame:
    """(query id, id, score) of all of blocks "v" and "q".

    product takes both blocks as (data, counts, scales), their dimension, and which queries to score, and gives the scores (vectors, queries).
    Blocks of unlike dimensions aren't scored.
    """
    id_type, query_type = _types(vectors, queries)
    names = [query_ids, ids, "score"]

    def run(batches):
        for batch in batches:
            columns = {c: batch[c] for c in batch.schema.names}
            for i in range(batch.num_rows):
                dim, other = columns["vdim"][i].as_py(), columns["qdim"][i].as_py()
                vids, qids = columns["vids"][i].values, columns["qids"][i].values
                if not len(vids) or not len(qids) or dim != other and dim and other:
                    continue
                got = {c: _block(columns, i, c) for c in "vq"}
                step = max(1, MOST_SCORES // max(1, len(vids)))
                for a in range(0, len(qids), step):
                    s = product(got["v"], got["q"], max(dim, other), slice(a, a + step))
                    row, col = _best(s, None, None)
                    out = [qids.slice(a, step).take(pa.array(col)), vids.take(pa.array(row)), pa.array(s[row, col].astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(out, names)

    schema = f"{query_ids} {query_type}, {ids} {id_type}, score double"
    return passing(vectors, queries).mapInArrow(run, schema)


def passing(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Each row of queries with each of vectors: all rows of vectors, one after the other, go through the task of each partition of queries."""
    return vectors.repartition(1).hint("shuffle_replicate_nl").crossJoin(queries)


def dealt(queries: DataFrame) -> DataFrame:
    """queries over the tasks that vectors pass through."""
    return queries.repartition(lanes(queries))


def nearest(vectors: DataFrame, queries: DataFrame, ids: str, query_ids: str, product, k: int) -> DataFrame:
    """As scored(), of each query the k best by (score to 9 digits descending, id ascending), and those without an id."""
    id_type, query_type = _types(vectors, queries)
    names = [query_ids, ids, "score"]

    def run(batches):
        held: dict[int, tuple[pa.Array, Best]] = {}
        for batch in batches:
            columns = {c: batch[c] for c in batch.schema.names}
            for i in range(batch.num_rows):
                dim, other = columns["vdim"][i].as_py(), columns["qdim"][i].as_py()
                vids, qids = columns["vids"][i].values, columns["qids"][i].values
                if not len(vids) or not len(qids) or dim != other and dim and other:
                    continue
                no = columns["qno"][i].as_py()
                if no not in held:
                    held[no] = qids.take(pa.array(np.arange(len(qids)))), Best(len(qids), k)
                s = product(_block(columns, i, "v"), _block(columns, i, "q"), max(dim, other), slice(0, len(qids)))
                if vids.null_count:
                    known = vids.is_valid().to_numpy(zero_copy_only=False)
                    row, col = _best(s[~known], None, None)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(col)), pa.nulls(len(row), vids.type), pa.array(s[~known][row, col].astype(np.float64))], names)
                    s, vids = s[known], vids.drop_null()
                held[no][1].add(s.T, _numbers(vids))
        for qids, best in held.values():
            yield _found(qids, best, id_type, names)

    schema = f"{query_ids} {query_type}, {ids} {id_type}, score double"
    return passing(vectors, queries).mapInArrow(run, schema)


def _found(qids: pa.Array, best: Best, id_type: str, names: list[str]) -> pa.RecordBatch:
    q, s, found = best.rows()
    return pa.RecordBatch.from_arrays([qids.take(pa.array(q)), pa.array(found.tolist() if found.dtype.kind == "U" else found, _arrow(id_type)), pa.array(s)], names)


def log_sums(vectors: DataFrame, queries: DataFrame, query_ids: str, product) -> DataFrame:
    """(query id, total): the logarithm of the sum of exp(score) over all vectors."""
    query_type = _types(vectors, queries)[1]

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            columns = {c: batch[c] for c in batch.schema.names}
            for i in range(batch.num_rows):
                dim, qids = columns["vdim"][i].as_py(), columns["qids"][i].values
                if not len(columns["vids"][i].values) or not len(qids) or dim != columns["qdim"][i].as_py():
                    continue
                no = columns["qno"][i].as_py()
                if no not in held:
                    held[no] = [qids.take(pa.array(np.arange(len(qids)))), np.full(len(qids), -np.inf)]
                s = product(_block(columns, i, "v"), _block(columns, i, "q"), dim, slice(0, len(qids)))
                s = np.where(np.isnan(s), -np.inf, s)
                top = s.max(0)
                top = np.where(np.isfinite(top), top, 0)
                with np.errstate(divide="ignore"):
                    held[no][1] = np.logaddexp(held[no][1], top + np.log(np.exp(s - top).sum(0)))
        for qids, total in held.values():
            yield pa.RecordBatch.from_arrays([qids, pa.array(total)], [query_ids, "total"])

    return passing(vectors, queries).mapInArrow(run, f"{query_ids} {query_type}, total double")


def ranked(vectors: DataFrame, queries: DataFrame, ids: str, query_ids: str, product) -> DataFrame:
    """(query id, id, score, rank) of all scores.  A block of queries stays while all vectors pass, so its queries are ranked where they are; nothing but the vectors is shuffled."""
    id_type, query_type = _types(vectors, queries)
    names = [query_ids, ids, "score", "rank"]

    def whole(qids: pa.Array, vids: list[pa.Array], scores: list[np.ndarray]):
        vids = pa.concat_arrays(vids)
        known = vids.is_valid().to_numpy(zero_copy_only=False)
        number = np.full(len(vids), -1, np.int64)
        number[known] = np.unique(_numbers(vids.drop_null()), return_inverse=True)[1]
        by_id = np.argsort(number, kind="stable")  # an id that isn't known comes first
        for i in range(len(qids)):
            s = np.concatenate([x[i] for x in scores])[by_id]
            order = np.argsort(-np.round(s, 9), kind="stable")
            order = order[: len(s) - np.count_nonzero(np.isnan(s))]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(np.full(len(order), i))), vids.take(pa.array(by_id[order])), pa.array(s[order]), pa.array(np.arange(1, len(order) + 1, dtype=np.int32))], names)

    def run(batches):
        no, qids, vids, scores = None, None, [], []
        for batch in batches:
            columns = {c: batch[c] for c in batch.schema.names}
            for i in range(batch.num_rows):
                if columns["qno"][i].as_py() != no:
                    if scores:
                        yield from whole(qids, vids, scores)
                    asked = columns["qids"][i].values
                    no, qids, vids, scores = columns["qno"][i].as_py(), asked.take(pa.array(np.arange(len(asked)))), [], []
                dim, own = columns["vdim"][i].as_py(), columns["vids"][i].values
                if len(own) and len(qids) and dim == columns["qdim"][i].as_py():
                    vids.append(own.take(pa.array(np.arange(len(own)))))
                    scores.append(np.ascontiguousarray(product(_block(columns, i, "v"), _block(columns, i, "q"), dim, slice(0, len(qids))).T))
        if scores:
            yield from whole(qids, vids, scores)

    schema = f"{query_ids} {query_type}, {ids} {id_type}, score double, rank int"
    return queries.hint("shuffle_replicate_nl").crossJoin(vectors.repartition(1)).mapInArrow(run, schema)


#: Pairs of rows that are multiplied at once.
PAIRS = 1 << 15


def rescored(vectors: DataFrame, queries: DataFrame, ids: str, query_ids: str, pairs, k: int) -> DataFrame:
    """(query id, id, score): the k best of each query among its own candidates, which the column of of pack() names.

    pairs takes both blocks as product does, their dimension, and the rows of both, and gives their scores one by one.  Vectors pass through as for nearest().
    """
    id_type, query_type = _types(vectors, queries)
    names = [query_ids, ids, "score"]

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            columns = {c: batch[c] for c in batch.schema.names}
            for i in range(batch.num_rows):
                dim, vids, qids = columns["vdim"][i].as_py(), columns["vids"][i].values, columns["qids"][i].values
                if not len(vids) or not len(qids) or dim != columns["qdim"][i].as_py():
                    continue
                no = columns["qno"][i].as_py()
                if no not in held:
                    asked = columns["qof"][i].values
                    of, named = np.repeat(np.arange(len(qids)), pc.list_value_length(asked).to_numpy(zero_copy_only=False)), _numbers(asked.flatten())
                    order = np.argsort(named, kind="stable")
                    held[no] = qids.take(pa.array(np.arange(len(qids)))), Best(len(qids), k), of[order], named[order]
                _, best, of, named = held[no]
                at, number = np.flatnonzero(vids.is_valid().to_numpy(zero_copy_only=False)), _numbers(vids.drop_null())
                low = np.searchsorted(named, number, "left")
                many = np.searchsorted(named, number, "right") - low
                v = np.repeat(np.arange(len(number)), many)
                q = of[np.arange(len(v)) + np.repeat(low - (np.cumsum(many) - many), many)]
                got = {c: _block(columns, i, c) for c in "vq"}
                for a in range(0, len(v), PAIRS):
                    x, y = v[a : a + PAIRS], q[a : a + PAIRS]
                    s = pairs(got["v"], got["q"], dim, at[x], y)
                    known = ~np.isnan(s)
                    best.add_pairs(y[known], s[known], number[x[known]])
        for qids, best, *_ in held.values():
            yield _found(qids, best, id_type, names)

    schema = f"{query_ids} {query_type}, {ids} {id_type}, score double"
    return passing(vectors, queries).mapInArrow(run, schema)


def _rows(data: bytes, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, max(1, dim))


def dot(v, q, dim, part):
    return (_rows(q[0], "<f8", dim)[part] @ _rows(v[0], "<f8", dim).T).T


def dot_f4(v, q, dim, part):
    """Of rows that are kept in 32 bits, in double."""
    return (_rows(q[0], "<f4", dim)[part].astype(np.float64) @ _rows(v[0], "<f4", dim).astype(np.float64).T).T


def dot_pairs(kind: str):
    return lambda v, q, dim, x, y: np.einsum("ij,ij->i", _rows(v[0], kind, dim)[x].astype(np.float64), _rows(q[0], kind, dim)[y].astype(np.float64))


def int8_pairs(v, q, dim, x, y):
    return np.einsum("ij,ij->i", _rows(v[0], "i1", dim)[x].astype(np.float64), _rows(q[0], "i1", dim)[y].astype(np.float64)) * q[2][y] * v[2][x]


def int8_dot(v, q, dim, part):
    """Whole-number products, exact in 32-bit floats up to 1040 dimensions, times both scales."""
    kind = np.float32 if dim <= 1040 else np.float64
    s = _rows(q[0], "i1", dim)[part].astype(kind) @ _rows(v[0], "i1", dim).astype(kind).T
    return (s.astype(np.float64) * q[2][part][:, None] * v[2]).T


def _signs(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1


def neg_hamming(v, q, dim, part):
    """Minus the number of differing bits of rows of 64-bit words."""
    a, b = _signs(_rows(v[0], "<i8", dim)), _signs(np.ascontiguousarray(_rows(q[0], "<i8", dim)[part]))
    return ((b @ a.T - a.shape[1]) / 2).T


def max_sim(v, q, dim, part):
    """Sum over a query's vectors of the greatest product with one of a row's; without any each counts 0."""
    n, m = v[1].astype(np.int64), q[1].astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(m)))
    some, asked = np.flatnonzero(n), m[part]
    a, b = starts[part.start], starts[min(part.stop, len(m))]
    out = np.zeros((len(n), len(asked)))
    full = np.flatnonzero(asked)
    if len(some) and len(full):
        s = _rows(v[0], "<f8", dim) @ _rows(q[0], "<f8", dim)[a:b].T
        best = np.maximum.reduceat(s, np.concatenate(([0], np.cumsum(n[some])[:-1])), axis=0)
        out[np.ix_(some, full)] = np.add.reduceat(best, np.concatenate(([0], np.cumsum(asked[full])[:-1])), axis=1)
    return out
