"""Model-side operators: static embeddings in SQL, a transformer encoder in numpy."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import block
from .rows import lanes


#: Documents whose vectors are summed up at once.
DOCS = 256


def _id_counts(ids: DataFrame) -> DataFrame:
    """(doc_id, ids, ks): how often each row has each of its ids."""
    kind, id_kind = ids.schema["doc_id"].dataType.simpleString(), ids.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch["ids"]), 0).to_numpy(zero_copy_only=False)
            own = batch["ids"].flatten().dictionary_encode()
            number, many = pc.fill_null(own.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(own.dictionary))
            key, k = np.unique((np.repeat(np.arange(len(n)), n) * many + number)[number >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(key // many, np.arange(len(n) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(ends, own.dictionary.take(pa.array(key % many))), pa.ListArray.from_arrays(ends, pa.array(k, pa.int64()))], ["doc_id", "ids", "ks"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<{id_kind}>, ks array<bigint>")


def static_vectors(ids: DataFrame, vocab: DataFrame, normalize: bool = True) -> DataFrame:
    """(doc_id, embedding): the weighted mean of the rows of (doc_id, ids) in (id, embedding, weight); unknown ids are skipped.

    A document's ids are counted where it is; only these numbers are shuffled. The vocabulary's rows that any document names pass by each block of
    documents. A document without known ids is a zero vector.
    """
    counts = _id_counts(ids).repartition(lanes(ids), "doc_id")  # read twice
    docs = counts.groupBy("doc_id").agg(F.flatten(F.collect_list(F.coalesce("ids", F.array()))).alias("ids"), F.flatten(F.collect_list("ks")).alias("ks"))
    docs = docs.crossJoin(F.broadcast(vocab.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width"))))

    def named(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pc.drop_null(pc.unique(batch["ids"].flatten()))], ["id"])

    # with all columns: a narrower exchange would be one of its own, and tokenize again
    used = vocab.join(counts.mapInArrow(named, f"id {ids.schema['ids'].dataType.elementType.simpleString()}").distinct(), "id", "left_semi")
    kind = "<f4" if vocab.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    v = block.pack(used.withColumn("weight", F.col("weight").cast("double")), "id", "embedding", kind, "weight")
    empty = docs.sparkSession.createDataFrame([([], b"", 0, b"", b"", -1)], v.schema)  # documents stay where no word is known
    doc_kind = ids.schema["doc_id"].dataType.simpleString()

    def blocks(batches):
        no = count()
        for batch in batches:
            for a in range(0, batch.num_rows, DOCS):
                part = batch.slice(a, DOCS).take(pa.array(np.arange(min(DOCS, batch.num_rows - a))))
                one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part["doc_id"], part["ids"], part["ks"])]
                yield pa.RecordBatch.from_arrays([*one, part["width"].slice(0, 1), pa.array([next(no)], pa.int64())], ["docs", "own", "ks", "width", "no"])

    packed = docs.select("doc_id", "ids", "ks", "width").mapInArrow(blocks, f"docs array<{doc_kind}>, own array<{docs.schema['ids'].dataType.simpleString()}>, ks array<array<bigint>>, width int, no bigint")

    def run(batches):
        held, no = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch["no"][i].as_py() != no:
                    if held:
                        yield done(*held)
                    no = batch["no"][i].as_py()
                    docs, own, ks, width = (batch[c][i] for c in ("docs", "own", "ks", "width"))
                    docs, width = docs.values.take(pa.array(np.arange(len(docs.values)))), width.as_py()
                    of, named, k = np.repeat(np.arange(len(docs)), pc.list_value_length(own.values).to_numpy(zero_copy_only=False)), block._numbers(own.values.flatten()), ks.values.flatten().to_numpy(zero_copy_only=False)
                    order = np.argsort(named, kind="stable")
                    of, named, k = of[order], named[order], k[order].astype(np.float64)
                    held = docs, np.zeros((len(docs), width)), np.zeros((len(docs), width))
                dim, number = batch["vdim"][i].as_py(), block._numbers(batch["vids"][i].values)
                low = np.searchsorted(named, number, "left")
                many = np.searchsorted(named, number, "right") - low
                met = np.flatnonzero(many)
                if not len(met) or not dim:
                    continue
                x = np.frombuffer(batch["vdata"][i].as_py(), kind).reshape(-1, dim)[met].astype(np.float64)
                weight, low, many = np.frombuffer(batch["vscales"][i].as_py(), "<f8")[met], low[met], many[met]
                word = np.repeat(np.arange(len(met)), many)
                at = np.arange(len(word)) + np.repeat(low - (np.cumsum(many) - many), many)
                c = np.bincount(of[at] * len(met) + word, k[at] * weight[word], len(held[0]) * len(met)).reshape(-1, len(met))
                held[1][:, :dim] += c @ x
                held[2][:, :dim] += c.sum(1)[:, None]
        if held:
            yield done(*held)

    def done(docs, s, w):
        y = np.divide(s, w, out=np.zeros_like(s), where=w != 0)
        if normalize:
            n = np.sqrt((y * y).sum(1))[:, None]
            y = np.divide(y, n, out=np.zeros_like(y), where=n >= 1e-12)
        ends = pa.array(np.arange(len(docs) + 1) * y.shape[1], pa.int32())
        return pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["doc_id", "embedding"])

    return packed.hint("shuffle_replicate_nl").crossJoin(v.unionByName(empty).repartition(1)).mapInArrow(run, f"doc_id {doc_kind}, embedding array<double>")


def static_embed(ids: DataFrame, vocab: DataFrame, normalize: bool = True) -> DataFrame:
    """(doc_id, pos, y) of static_vectors()."""
    return static_vectors(ids, vocab, normalize).select("doc_id", F.posexplode("embedding").alias("pos", "y"))


def erf(x: np.ndarray) -> np.ndarray:
    """The error function: its Taylor series below 2.5, above it a continued fraction of the complement, both to 1e-12."""
    x = np.asarray(x, np.float64)
    near, a = np.clip(x, -2.5, 2.5), np.maximum(np.abs(x), 2.5)
    term = total = near.copy()
    for n in range(1, 60):
        term = -term * near * near / n
        total = total + term / (2 * n + 1)
    tail = a.copy()
    for n in range(60, 0, -1):
        tail = a + n / 2 / tail
    far = 1 - np.exp(-a * a) / (np.sqrt(np.pi) * tail)
    return np.where(np.abs(x) <= 2.5, total * 2 / np.sqrt(np.pi), np.sign(x) * far)


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + erf(x / np.sqrt(2)))


def gelu_tanh(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def swiglu(gate: np.ndarray, up: np.ndarray) -> np.ndarray:
    return silu(gate) * up


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def layer_norm(x: np.ndarray, gain, shift, eps: float = 1e-12) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * gain + shift


def rope(x: np.ndarray, base: float = 10000.0) -> np.ndarray:
    """Rotary positions on (..., positions, head dim), halves rotated."""
    half = x.shape[-1] // 2
    angle = np.arange(x.shape[-2])[:, None] * base ** (-np.arange(half) / half)
    a, b = x[..., :half], x[..., half:]
    return np.concatenate((a * np.cos(angle) - b * np.sin(angle), b * np.cos(angle) + a * np.sin(angle)), -1)


class Encoder:
    """A post-norm transformer: learned positions, GELU, mean or first-token pooling, unit length."""

    def __init__(self, weights: dict[str, np.ndarray], heads: int, pooling: str = "mean", rotary: bool = False):
        if pooling not in ("mean", "cls"):
            raise ValueError(f"pooling {pooling!r} isn't supported")
        self.w, self.heads, self.pooling, self.rotary = weights, heads, pooling, rotary
        self.layers = 1 + max(int(k.split(".")[1]) for k in weights if k.startswith("layer."))

    @classmethod
    def random(cls, vocab: int = 64, dim: int = 16, layers: int = 2, heads: int = 2, longest: int = 512, seed: int = 0, **how) -> Encoder:
        r = np.random.default_rng(seed)
        w = {"tokens": r.normal(size=(vocab, dim)), "positions": r.normal(size=(longest, dim)) * 0.1}
        for i in range(layers):
            w |= {f"layer.{i}.{n}": r.normal(size=s) / np.sqrt(s[0]) for n, s in (("q", (dim, dim)), ("k", (dim, dim)), ("v", (dim, dim)), ("o", (dim, dim)), ("up", (dim, 4 * dim)), ("down", (4 * dim, dim)))}
        return cls(w, heads, **how)

    def tokens(self, ids: list[int]) -> np.ndarray:
        x = self.w["tokens"][ids] + (0 if self.rotary else self.w["positions"][: len(ids)])
        n, dim = x.shape
        for i in range(self.layers):
            q, k, v = (np.stack(np.split(x @ self.w[f"layer.{i}.{c}"], self.heads, -1)) for c in "qkv")
            if self.rotary:
                q, k = np.stack([rope(h) for h in q]), np.stack([rope(h) for h in k])
            a = softmax(q @ k.transpose(0, 2, 1) / np.sqrt(dim // self.heads)) @ v
            x = layer_norm(x + np.concatenate(list(a), -1) @ self.w[f"layer.{i}.o"], 1, 0)
            x = layer_norm(x + gelu(x @ self.w[f"layer.{i}.up"]) @ self.w[f"layer.{i}.down"], 1, 0)
        return x

    def encode(self, ids: list[int]) -> np.ndarray:
        x = self.tokens(ids)
        v = x.mean(0) if self.pooling == "mean" else x[0]
        n = np.sqrt((v * v).sum())
        return v / n if n >= 1e-12 else np.zeros_like(v)


def encode(ids: DataFrame, model: Encoder) -> DataFrame:
    """(doc_id, embedding) of (doc_id, ids); the model goes to the executors once, with the task's closure as a broadcast."""
    shared = ids.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            order = pdf["ids"].map(len).sort_values(kind="stable").index  # texts of like length together
            vectors = {i: shared.value.encode(list(pdf["ids"][i])).tolist() if len(pdf["ids"][i]) else None for i in order}
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "embedding": [vectors[i] for i in pdf.index]})

    return ids.select("doc_id", "ids").mapInPandas(run, "doc_id bigint, embedding array<double>")
