"""Approximate dense retrieval on layered proximity graphs, one for each shard of vectors.

A shard's graph is built in one task and kept as a row of arrays (numbers of a known width, nothing that runs when it's read), which are held
against each other when they're loaded.  A query goes through every shard's graph, and the shards' best are merged exactly.  Shards are sized by rows, so their number grows with the data.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block, store
from .topk import top_k

SHARD_ROWS = 50_000
#: Vectors that are linked, and queries that move, at a time.
STEP = 256
VERSION = 2
GRAPH = "version int, shard int, dim int, most int, start int, top int, ids binary, rows binary, scales binary, levels binary, counts binary, links binary"
#: What of (version, shard) and sizes a reader checks against each other.
_NUMBERS = {"ids": "<i8", "scales": "<f4", "levels": "<i4", "counts": "<i4", "links": "<i4"}


class Graph:
    """int8: vectors are held as 8-bit codes and a scale, and compared with 8-bit queries in whole numbers.

    near has the links of each layer, a row for each vector, filled up with -1.  A vector's candidates for links are the nearest of those before it, found
    exactly by products of blocks; links back are cut once, when all are known.  Queries move in step, many at a time, each with its own beam.
    """

    def __init__(self, dim: int, m: int = 16, build_ef: int = 200, seed: int = 1, heuristic: bool = True, int8: bool = False):
        self.m, self.most0, self.build_ef, self.heuristic, self.int8 = max(2, m), 2 * max(2, m), build_ef, heuristic, int8
        self.vectors, self.ids, self.near, self.top, self.start = np.zeros((0, dim), np.int8 if int8 else np.float32), np.zeros(0, np.int64), [], -1, -1
        self.scales, self.levels = np.zeros(0, np.float32), np.zeros(0, np.int32)
        self.random, self.scale = np.random.default_rng(seed), 1 / log(max(2, m))
        self._numbers = None

    def dump(self) -> tuple:
        """Everything but version and shard, as in GRAPH."""
        node = np.repeat(np.arange(len(self.ids)), self.levels)
        layer = np.arange(len(node)) - np.repeat(np.cumsum(self.levels) - self.levels, self.levels)
        rows = np.full((len(node), self.most0), -1, np.int32)
        for n, links in enumerate(self.near):
            rows[layer == n, : links.shape[1]] = links[node[layer == n]]
        parts = (self.ids.astype("<i8"), self.vectors, self.scales.astype("<f4"), self.levels.astype("<i4"), (rows >= 0).sum(1).astype("<i4"), rows[rows >= 0].astype("<i4"))
        return (self.vectors.shape[1], self.m, self.start, self.top, *(x.tobytes() for x in parts))

    @classmethod
    def load(cls, version: int, dim: int, most: int, start: int, top: int, **parts: bytes) -> Graph:
        """A kept graph; parts that don't fit together are an error."""
        if version != VERSION:
            raise ValueError(f"unknown graph version {version}")
        for name, kind in _NUMBERS.items():
            if len(parts[name]) % np.dtype(kind).itemsize:
                raise ValueError(f"broken graph: {name} isn't made of whole numbers")
        x = {name: np.frombuffer(parts[name], kind) for name, kind in _NUMBERS.items()}
        n, int8 = len(x["ids"]), len(x["scales"]) > 0
        width = dim * (1 if int8 else 4)
        fits = len(parts["rows"]) == n * width and len(x["levels"]) == n and len(x["scales"]) in (0, n) and x["levels"].sum() == len(x["counts"]) and x["counts"].sum() == len(x["links"])
        if not fits or (x["levels"] < 1).any() or (x["counts"] < 0).any() or len(x["links"]) and not (0 <= x["links"].min() and x["links"].max() < n) or n and not (0 <= start < n and x["levels"][start] == top + 1):
            raise ValueError("broken graph: its parts don't fit together")
        g = cls(dim, most, int8=int8)
        g.ids, g.vectors, g.scales, g.levels, g.start, g.top = x["ids"], np.frombuffer(parts["rows"], np.int8 if int8 else "<f4").reshape(n, dim), x["scales"], x["levels"], start, top
        node = np.repeat(np.arange(n), x["levels"])
        layer = np.arange(len(node)) - np.repeat(np.cumsum(x["levels"]) - x["levels"], x["levels"])
        row = np.repeat(np.arange(len(node)), x["counts"])
        place = np.arange(len(row)) - np.repeat(np.cumsum(x["counts"]) - x["counts"], x["counts"])
        for at in range(top + 1):
            own = layer[row] == at
            near = np.full((n, max([1, *x["counts"][layer == at]])), -1, np.int32)
            near[node[row[own]], place[own]] = x["links"][own]
            g.near.append(near)
        return g

    def _wide(self, v: np.ndarray) -> np.ndarray:
        # whole numbers of up to 2**24 are exact in 32-bit floats
        return v.astype(np.float32 if self.vectors.shape[1] <= 1040 else np.float64) if self.int8 else v

    def fill(self, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        self.ids, self.vectors = ids, vectors
        if self.int8:
            self.vectors, self.scales = quantized(vectors)
        self.levels = np.array([1 + int(-log(max(u, 1e-300)) * self.scale) for u in self.random.random(len(ids))], np.int32)
        if len(ids):
            self.start, self.top = int(self.levels.argmax()), int(self.levels.max()) - 1
        self.near = [self._layer(np.flatnonzero(self.levels > layer), self.m if layer else self.most0) for layer in range(self.top + 1)]
        return self

    def _layer(self, members: np.ndarray, most: int) -> np.ndarray:
        """Links among the vectors of a layer, in the order in which they came."""
        x, f = self._wide(self.vectors[members]), self.scales[members] if self.int8 else None
        links: list[list[int]] = [[] for _ in members]
        for a in range(0, len(members), STEP):
            b = min(a + STEP, len(members))
            s = x[a:b] @ x[:b].T
            if self.int8:
                s *= f[a:b, None] * f[:b]
            s[np.arange(b) >= np.arange(a, b)[:, None]] = -np.inf
            k = min(self.build_ef, b)
            found = np.argpartition(s, b - k, axis=1)[:, b - k :]
            s = np.take_along_axis(s, found, 1)
            order = np.lexsort((found, -s), axis=1)
            found, s = np.take_along_axis(found, order, 1), np.take_along_axis(s, order, 1)
            for i in range(b - a):
                n = min(k, a + i)
                links[a + i] = self._select(x, f, found[i, :n], s[i, :n], self.m)
                for other in links[a + i]:
                    links[other].append(a + i)
        near = np.full((len(self.ids), most), -1, np.int32)
        for i, own in enumerate(links):
            if len(own) > most:
                c = np.array(own)
                s = x[c] @ x[i]
                if self.int8:
                    s *= f[c] * f[i]
                order = np.lexsort((c, -s))
                own = self._select(x, f, c[order], s[order], most)
            near[members[i], : len(own)] = members[own]
        return near

    def _select(self, x: np.ndarray, f: np.ndarray | None, found: np.ndarray, s: np.ndarray, m: int) -> list[int]:
        """Of those found, best first, the nearest that no chosen one is nearer to than the base, then the nearest of the others."""
        if not self.heuristic or len(found) <= m:
            return found[:m].tolist()
        own, free, chosen = x[found], np.ones(len(found), bool), []
        limit = s if f is None else s / f[found]
        while len(chosen) < m:
            n = int(free.argmax())
            if not free[n]:
                break
            chosen.append(n)
            t = own @ own[n]
            free &= (t if f is None else t * f[found[n]]) <= limit
            free[n] = False
        if len(chosen) < m:
            rest = np.ones(len(found), bool)
            rest[chosen] = False
            chosen += np.flatnonzero(rest)[: m - len(chosen)].tolist()
        return found[chosen].tolist()

    def query(self, v: np.ndarray, k: int, ef: int = 64, keep: np.ndarray | None = None) -> list[tuple[int, float]]:
        if k <= 0 or self.start < 0 or len(v) != self.vectors.shape[1]:
            return []
        _, ids, s = self.query_many(np.asarray(v, np.float32)[None], k, ef, keep)
        return list(zip(ids.tolist(), s.tolist()))

    def query_many(self, q: np.ndarray, k: int, ef: int = 64, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best found for each row of q, by row and best first; keep says of each vector whether it may be returned."""
        if k <= 0 or self.start < 0 or not len(q) or q.shape[1] != self.vectors.shape[1]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        x = self._wide(self.vectors) if self._numbers is None else self._numbers
        self._numbers = x
        parts = []
        for a in range(0, len(q), STEP):
            some, factor = q[a : a + STEP], None
            if self.int8:
                codes, factor = quantized(some)
                some = self._wide(codes)
            nodes, s = self._beams(x, some, factor, max(ef, k), keep)
            order = np.lexsort((nodes, -s), axis=1)[:, :k]
            nodes, s = np.take_along_axis(nodes, order, 1), np.take_along_axis(s, order, 1)
            row, at = np.nonzero(s > -np.inf)
            parts.append((row + a, self.ids[nodes[row, at]], s[row, at].astype(np.float64)))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _beams(self, x: np.ndarray, q: np.ndarray, factor: np.ndarray | None, ef: int, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, scores) of the ef best found for each query, in no order; vectors outside keep lead on but aren't returned."""

        def scores(who, what):
            s = np.einsum("ij,ij->i", x[what], q[who])
            return s if factor is None else s * (factor[who] * self.scales[what])

        n, all_ = len(q), np.arange(len(q))
        at = np.full(n, self.start)
        s = scores(all_, at)
        for layer in range(self.top, 0, -1):
            act = all_
            while len(act):
                near = self.near[layer][at[act]]
                i, j = np.nonzero(near >= 0)
                t = np.full(near.shape, -np.inf, s.dtype)
                t[i, j] = scores(act[i], near[i, j])
                best = t.argmax(1)
                t = t[np.arange(len(act)), best]
                better = t > s[act]
                near, act, best = near[better], act[better], best[better]
                at[act], s[act] = near[np.arange(len(act)), best], t[better]
        # todo: those still to be followed, `many` places of it in use; held: the results; low: the worst of these, once there are ef
        seen = np.zeros((n, len(x)), bool)
        seen[all_, at] = True
        room = 4 * ef + 2 * self.near[0].shape[1]
        todo, todo_s, many = np.zeros((n, room), np.int32), np.full((n, room), -np.inf, s.dtype), np.ones(n, np.int64)
        held, held_s = np.zeros((n, ef), np.int32), np.full((n, ef), -np.inf, s.dtype)
        todo[:, 0], todo_s[:, 0], held[:, 0] = at, s, at
        held_s[:, 0] = s if keep is None else np.where(keep[at], s, -np.inf)
        low, act = held_s.min(1), all_
        while True:
            t = todo_s[act]
            first = t.argmax(1)
            t = t[np.arange(len(act)), first]
            go = (t > -np.inf) & (t >= low[act])
            act, first = act[go], first[go]
            if not len(act):
                return held, held_s
            near = self.near[0][todo[act, first]]
            todo_s[act, first] = -np.inf
            i, j = np.nonzero((near >= 0) & ~seen[act[:, None], near])
            what = near[i, j]
            seen[act[i], what] = True
            t = scores(act[i], what)
            hit = t > low[act[i]]
            i, j, what, t = i[hit], j[hit], what[hit], t[hit]
            if not len(i):
                continue
            rows, begin, place, each = np.unique(i, return_index=True, return_inverse=True, return_counts=True)
            if many[act].max() + near.shape[1] > todo.shape[1]:  # what no longer beats the worst result goes; there may be more than that leaves room for until ef can be returned
                alive = (todo_s[act] >= low[act, None]) & (todo_s[act] > -np.inf)
                order = np.argsort(~alive, axis=1, kind="stable")
                many[act] = alive.sum(1)
                todo[act] = np.take_along_axis(todo[act], order, 1)
                todo_s[act] = np.where(np.arange(todo.shape[1]) < many[act, None], np.take_along_axis(todo_s[act], order, 1), -np.inf)
                if 2 * many[act].max() > todo.shape[1] - near.shape[1]:
                    more = ((0, 0), (0, todo.shape[1]))
                    todo, todo_s = np.pad(todo, more), np.pad(todo_s, more, constant_values=-np.inf)
            at = many[act[i]] + np.arange(len(i)) - begin[place]
            todo[act[i], at], todo_s[act[i], at] = what, t
            new, new_s = np.zeros((len(rows), near.shape[1]), np.int32), np.full((len(rows), near.shape[1]), -np.inf, s.dtype)
            new[place, j], new_s[place, j] = what, t
            rows = act[rows]
            many[rows] += each
            if keep is not None:
                new_s[~keep[new]] = -np.inf
            both, both_s = np.concatenate((held[rows], new), 1), np.concatenate((held_s[rows], new_s), 1)
            best = np.argpartition(both_s, near.shape[1], axis=1)[:, near.shape[1] :]
            held[rows], held_s[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(both_s, best, 1)
            low[rows] = held_s[rows].min(1)


def quantized(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8-bit codes, scale) of each row; zeros have scale 1."""
    top = np.abs(v).max(1)
    scale = np.where(top > 0, top / 127, 1).astype(np.float32)
    return np.rint(v / scale[:, None]).clip(-127, 127).astype(np.int8), scale


def build(vectors: DataFrame, m: int = 16, build_ef: int = 200, int8: bool = False, heuristic: bool = True, shards: int | None = None, seed: int = 1) -> DataFrame:
    """Graphs as in GRAPH, to be kept once and searched often.  Without a number of shards the vectors are counted, which reads no column of theirs."""
    shards = shards or max(1, -(-vectors.count() // SHARD_ROWS))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        rows = pdf.pop("embedding").tolist()
        dim = len(rows[0])
        fits = [len(r) == dim for r in rows]
        v = np.array([r for r, ok in zip(rows, fits) if ok], np.float32)
        g = Graph(dim, m, build_ef, seed, heuristic, int8).fill(pdf["doc_id"].to_numpy(np.int64)[fits], v)
        return pd.DataFrame([(VERSION, int(key[0]), *g.dump())], columns=[f.split()[0] for f in GRAPH.split(", ")])

    placed = vectors.select("doc_id", "embedding", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    return placed.groupBy("shard").applyInPandas(one, GRAPH)


def save(graphs: DataFrame, path: str) -> None:
    store.save(graphs.sparkSession, path, "graph", {"graphs": graphs})


def load(spark: SparkSession, path: str) -> DataFrame:
    return store.load(spark, path, "graph")[0]["graphs"]


def search(graphs: DataFrame, queries: DataFrame, k: int, ef: int = 64, keep=None) -> DataFrame:
    """The k best for each query.  keep takes an array of ids and says which may be returned; k <= 0 gives nothing.

    A task holds some of the queries, and the graphs of all shards pass through it, one at a time.
    """
    query_type = queries.schema["query_id"].dataType.simpleString()
    names = ["query_id", "doc_id", "score"]

    def run(batches):
        held: dict[int, tuple] = {}
        shard, graph, alive = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                qids, dim = batch["qids"][i].values, batch["qdim"][i].as_py()
                if batch["shard"][i].as_py() != shard:
                    graph = None  # before the next one is there
                    row = {f.split()[0]: batch[f.split()[0]][i].as_py() for f in GRAPH.split(", ")}
                    shard = row.pop("shard")
                    graph = Graph.load(**row)
                    alive = None if keep is None else np.asarray(keep(graph.ids), bool)
                no = batch["qno"][i].as_py()
                if no not in held:
                    held[no] = qids.take(pa.array(np.arange(len(qids)))), block.Best(len(qids), k)
                if dim == graph.vectors.shape[1]:
                    q, ids, s = graph.query_many(np.frombuffer(batch["qdata"][i].as_py(), "<f4").reshape(-1, dim), k, ef, alive)
                    held[no][1].add_pairs(q, s, ids)
        for qids, best in held.values():
            q, s, ids = best.rows()
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), pa.array(ids, pa.int64()), pa.array(s)], names)

    if k <= 0:
        return top_k(graphs.sparkSession.createDataFrame([], f"query_id {query_type}, doc_id bigint, score double"), 0, ["query_id"])
    asked = block.pack(block.dealt(queries), "query_id", "query", "<f4", rows=block.QUERY_ROWS, as_name="q")
    found = block.passing(graphs, asked).mapInArrow(run, f"query_id {query_type}, doc_id bigint, score double")
    return top_k(found, k, ["query_id"])
