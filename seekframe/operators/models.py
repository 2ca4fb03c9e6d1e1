"""Transformer models in numpy, run a batch of like lengths at a time inside Arrow maps.

One tower serves all families: a loader maps a checkpoint's tensors to its own few names and says how the family differs (where norms
stand, how positions enter, whether the feed-forward part is gated or a mixture of experts).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encode import gelu, gelu_tanh, layer_norm, rope, silu, softmax
from .topk import top_k

BATCH_TOKENS, BATCH_TEXTS = 4096, 64
ACTIVATIONS = {"gelu": gelu, "gelu_tanh": gelu_tanh, "silu": silu, "tanh": np.tanh}

# --- weights ----------------------------------------------------------------------------------------------


def rows_i8(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scale of each row): symmetric 8-bit codes; a row of zeros has scale 1."""
    top = np.abs(w).max(-1, keepdims=True)
    scale = np.where(top > 0, top / 127, 1.0)
    return np.rint(w / scale).astype(np.int8), scale


def groups_i4(w: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes -7..7 as (rows, groups, group), scale of each group); the width must be a multiple of group."""
    g = w.reshape(len(w), -1, group)
    top = np.abs(g).max(-1, keepdims=True)
    scale = np.where(top > 0, top / 7, 1.0)
    return np.rint(g / scale).astype(np.int8), scale


def matmul_q8(a: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """a times the transpose of 8-bit rows."""
    return (a @ codes.astype(a.dtype).T) * scale.ravel()


def matmul_w8a8(a: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """As matmul_q8 with a's rows in 8 bits too: whole-number products."""
    own, own_scale = rows_i8(a)
    # sums of up to 2**53 are exact in 64-bit floats, and multiplied much faster than whole numbers
    return (own.astype(np.float64) @ codes.astype(np.float64).T) * own_scale * scale.ravel()


def matmul_q4(a: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """a times the transpose of rows in groups of 4 bits."""
    return a @ (codes * scale).reshape(len(codes), -1).T


def matmul_w4a8(a: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """As matmul_q4 with a's rows in 8 bits: whole-number products in each group."""
    own, own_scale = rows_i8(a.reshape(-1, a.shape[-1]))
    g = own.reshape(len(own), codes.shape[1], -1).astype(np.float64)
    out = np.einsum("ngk,mgk,mg->nm", g, codes.astype(np.float64), scale[..., 0]) * own_scale
    return out.reshape(*a.shape[:-1], -1)


BACKENDS = {"numpy": lambda a, b: a @ b.T, "float32": lambda a, b: (a.astype(np.float32) @ b.astype(np.float32).T).astype(a.dtype)}


def register_backend(name: str, matmul) -> None:
    """A provider of a @ b.T for full weights; a name is taken once."""
    if name in BACKENDS:
        raise ValueError(f"backend {name!r} is there already")
    BACKENDS[name] = matmul


class Weight:
    """A matrix as floats, or in 8 or 4 bits, and its product with activations."""

    def __init__(self, w: np.ndarray, kind: str = "f32", group: int = 32, activations8: bool = False, backend: str = "numpy"):
        self.kind, self.activations8, self.shape = kind, activations8, w.shape
        if backend not in BACKENDS:
            raise ValueError(f"no backend {backend!r}; there are {', '.join(sorted(BACKENDS))}")
        self.backend = backend
        if kind == "f32":
            self.parts = (np.asarray(w, np.float64),)
        elif kind == "int8":
            self.parts = rows_i8(np.asarray(w, np.float64))
        elif kind == "int4":
            self.parts = groups_i4(np.asarray(w, np.float64), group)
        else:
            raise ValueError(f"unknown kind of weights {kind!r}")

    def times(self, a: np.ndarray) -> np.ndarray:
        """a @ w.T"""
        if self.kind == "f32":
            return BACKENDS[self.backend](a, *self.parts)
        if self.kind == "int8":
            return (matmul_w8a8 if self.activations8 else matmul_q8)(a, *self.parts)
        return (matmul_w4a8 if self.activations8 else matmul_q4)(a, *self.parts)


# --- the tower --------------------------------------------------------------------------------------------


@dataclass
class Config:
    heads: int
    layers: int
    norm: str = "post"  # or "pre"
    positions: str = "learned"  # "rotary", "none"
    position_offset: int = 0
    activation: str = "gelu"
    gated: bool = False
    rope_base: float = 10000.0
    eps: float = 1e-12
    experts: int = 0
    experts_used: int = 0
    pooling: str = "mean"
    normalize: bool = True

    def __post_init__(self):
        if self.pooling not in ("mean", "cls"):
            raise ValueError(f"pooling {self.pooling!r} isn't supported")
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"activation {self.activation!r} isn't supported")
        if self.experts and not 0 < self.experts_used <= self.experts:
            raise ValueError("a mixture uses between one and all of its experts")


@dataclass
class Tower:
    """Named tensors ("embed", "positions", "types", "embed_norm", "final_norm", and of each layer "q k v o up gate down norm1 norm2 router expert...") and how to run them."""

    config: Config
    w: dict = field(default_factory=dict)

    def dense(self, x: np.ndarray, name: str) -> np.ndarray:
        out = self.w[name].times(x) if isinstance(self.w[name], Weight) else x @ self.w[name].T
        return out + self.w[name + ".b"] if name + ".b" in self.w else out

    def norm(self, x: np.ndarray, name: str) -> np.ndarray:
        return layer_norm(x, self.w[name], self.w.get(name + ".b", 0.0), self.config.eps) if name in self.w else x

    def mixture(self, x: np.ndarray, at: str) -> np.ndarray:
        """Each token goes to its best experts, weighted by the softmax over all of them (the weights taken aren't scaled up again); one bias for all."""
        c = self.config
        share = softmax(self.dense(x, f"{at}.router"))
        best = np.argsort(-share, axis=-1, kind="stable")[..., : c.experts_used]
        out = np.zeros_like(x)
        for e in range(c.experts):
            weight = np.where(best == e, np.take_along_axis(share, best, -1), 0).sum(-1)
            some = weight > 0
            if some.any():
                y = ACTIVATIONS[c.activation](x[some] @ self.w[f"{at}.expert{e}.up"].T) @ self.w[f"{at}.expert{e}.down"].T
                out[some] += weight[some][:, None] * y
        return out + self.w.get(f"{at}.bias", 0.0)

    def feed(self, x: np.ndarray, at: str) -> np.ndarray:
        c = self.config
        if c.experts and f"{at}.router" in self.w:
            return self.mixture(x, at)
        act = ACTIVATIONS[c.activation]
        up = self.dense(x, f"{at}.up")
        return self.dense(act(self.dense(x, f"{at}.gate")) * up if c.gated else act(up), f"{at}.down")

    def attend(self, x: np.ndarray, mask: np.ndarray, at: str) -> np.ndarray:
        n, length, dim = x.shape
        heads = self.config.heads
        q, k, v = (self.dense(x, f"{at}.{c}").reshape(n, length, heads, -1).transpose(0, 2, 1, 3) for c in "qkv")
        if self.config.positions == "rotary":
            q, k = rope(q, self.config.rope_base), rope(k, self.config.rope_base)
        s = q @ k.transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1])
        s = np.where(mask[:, None, None, :], s, -1e30)
        return self.dense((softmax(s) @ v).transpose(0, 2, 1, 3).reshape(n, length, -1), f"{at}.o")

    def run(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Hidden states (texts, tokens, dim) after all layers."""
        for i in range(self.config.layers):
            at = f"layer.{i}"
            if self.config.norm == "post":
                x = self.norm(x + self.attend(x, mask, at), f"{at}.norm1")
                x = self.norm(x + self.feed(x, at), f"{at}.norm2")
            else:
                x = x + self.attend(self.norm(x, f"{at}.norm1"), mask, at)
                x = x + self.feed(self.norm(x, f"{at}.norm2"), at)
        return self.norm(x, "final_norm")

    def embed(self, ids: np.ndarray, types: np.ndarray | None = None) -> np.ndarray:
        c, x = self.config, self.w["embed"][ids]
        if c.positions == "learned":
            if ids.shape[1] + c.position_offset > len(self.w["positions"]):
                raise ValueError(f"{ids.shape[1]} tokens are more than the model has positions for")
            x = x + self.w["positions"][c.position_offset : c.position_offset + ids.shape[1]]
        if "types" in self.w:
            x = x + self.w["types"][np.zeros_like(ids) if types is None else types]
        return self.norm(x, "embed_norm")

    def tokens(self, texts: list[list[int]], types: list[list[int]] | None = None) -> list[np.ndarray]:
        """A matrix of hidden states for each text; texts may be of unlike length."""
        length = max(map(len, texts), default=0)
        if not length:
            return [np.zeros((0, self.w["embed"].shape[1])) for _ in texts]
        ids, kinds = np.zeros((len(texts), length), np.int64), np.zeros((len(texts), length), np.int64)
        mask = np.zeros((len(texts), length), np.bool_)
        for i, t in enumerate(texts):
            ids[i, : len(t)], mask[i, : len(t)] = t, True
            if types is not None:
                kinds[i, : len(t)] = types[i]
        mask[:, 0] |= ~mask.any(1)
        x = self.run(self.embed(ids, kinds), mask)
        return [x[i, : len(t)] for i, t in enumerate(texts)]

    def encode(self, texts: list[list[int]]) -> list[np.ndarray]:
        out = []
        for x in self.tokens(texts):
            v = (x.mean(0) if self.config.pooling == "mean" else x[0]) if len(x) else np.zeros(self.w["embed"].shape[1])
            norm = np.sqrt((v * v).sum())
            out.append(v if not self.config.normalize else v / norm if norm >= 1e-12 else np.zeros_like(v))
        return out

    def quantized(self, kind: str = "int8", activations8: bool = True, group: int = 32) -> Tower:
        """The same tower with its layers' matrices in 8 or 4 bits."""
        layered = {k: Weight(v, kind, group, activations8) if k.startswith("layer.") and getattr(v, "ndim", 0) == 2 and "expert" not in k and "router" not in k else v for k, v in self.w.items()}
        return Tower(self.config, layered)


def length_batches(lengths: list[int], most_tokens: int = BATCH_TOKENS, most_texts: int = BATCH_TEXTS) -> list[list[int]]:
    """Texts by ascending length in batches: one more would make a batch exceed most_tokens, padded, or most_texts."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if not out or (len(out[-1]) + 1) * max(1, lengths[i]) > most_tokens or len(out[-1]) == most_texts:
            out.append([])
        out[-1].append(i)
    return out


# --- loaders ----------------------------------------------------------------------------------------------


def _take(tensors: dict, names: dict[str, str]) -> dict:
    """Tensors under their own names; biases go along where there are any, a missing weight is an error."""
    out = {}
    for own, name in names.items():
        if f"{name}.weight" not in tensors:
            raise ValueError(f"the checkpoint has no {name}.weight")
        out[own] = np.asarray(tensors[f"{name}.weight"], np.float64)
        if f"{name}.bias" in tensors:
            out[own + ".b"] = np.asarray(tensors[f"{name}.bias"], np.float64)
    return out


def _bare(tensors: dict) -> dict:
    """Tensors without the model's own prefix."""
    for prefix in ("bert.", "roberta.", "new.", "model.", "xlm-roberta."):
        if any(k.startswith(prefix) for k in tensors):
            return {k.removeprefix(prefix): v for k, v in tensors.items()}
    return tensors


def _layers(tensors: dict, prefix: str) -> int:
    return 1 + max((int(k[len(prefix) :].split(".")[0]) for k in tensors if k.startswith(prefix)), default=-1)


def bert(tensors: dict, heads: int, roberta: bool = False, **how) -> Tower:
    """Post-norm, learned positions (from 2 on for the RoBERTa family), erf GELU."""
    t = _bare(tensors)
    n = _layers(t, "encoder.layer.")
    names = {"embed": "embeddings.word_embeddings", "positions": "embeddings.position_embeddings", "embed_norm": "embeddings.LayerNorm"}
    if "embeddings.token_type_embeddings.weight" in t:
        names["types"] = "embeddings.token_type_embeddings"
    parts = {"q": "attention.self.query", "k": "attention.self.key", "v": "attention.self.value", "o": "attention.output.dense", "norm1": "attention.output.LayerNorm", "up": "intermediate.dense", "down": "output.dense", "norm2": "output.LayerNorm"}
    names |= {f"layer.{i}.{own}": f"encoder.layer.{i}.{name}" for i in range(n) for own, name in parts.items()}
    return Tower(Config(heads, n, position_offset=2 if roberta else 0, **how), _take(t, names))


def _split_rows(w: dict, at: str, joined: str, parts: str) -> None:
    """One matrix of several stacked ones, taken apart."""
    for suffix in ("", ".b"):
        if f"{at}.{joined}{suffix}" in w:
            for own, part in zip(parts.split(), np.split(w.pop(f"{at}.{joined}{suffix}"), len(parts.split()))):
                w[f"{at}.{own}{suffix}"] = part


def rotary_swiglu(tensors: dict, heads: int, experts: int = 0, experts_used: int = 0, **how) -> Tower:
    """Rotary positions, gated SiLU, first-token output that isn't scaled; layers with a router are mixtures of experts."""
    t = _bare(tensors)
    n = _layers(t, "encoder.layers.")
    w = _take(t, {"embed": "embeddings.word_embeddings", "embed_norm": "emb_ln"} | ({"types": "embeddings.token_type_embeddings"} if "embeddings.token_type_embeddings.weight" in t else {}))
    for i in range(n):
        at, here = f"layer.{i}", f"encoder.layers.{i}"
        w |= _take(t, {f"{at}.qkv": f"{here}.attn.Wqkv", f"{at}.o": f"{here}.attn.out_proj", f"{at}.norm1": f"{here}.norm1", f"{at}.norm2": f"{here}.norm2"})
        _split_rows(w, at, "qkv", "q k v")
        if f"{here}.mlp.router.layer.weight" in t:
            w |= _take(t, {f"{at}.router": f"{here}.mlp.router.layer"})
            for e, (up, down) in enumerate(zip(*(np.split(np.asarray(t[f"{here}.mlp.experts.mlp.{x}"], np.float64), experts) for x in ("w1", "w2")))):
                w[f"{at}.expert{e}.up"], w[f"{at}.expert{e}.down"] = up, down.T
            w[f"{at}.bias"] = np.asarray(t.get(f"{here}.mlp.experts.bias", 0.0), np.float64)
        else:
            w |= _take(t, {f"{at}.up": f"{here}.mlp.fc11", f"{at}.gate": f"{here}.mlp.fc12", f"{at}.down": f"{here}.mlp.fc2"})
    how = {"activation": "gelu" if experts else "silu", "gated": not experts, "pooling": "cls", "normalize": False} | how
    return Tower(Config(heads, n, positions="rotary", experts=experts, experts_used=experts_used, **how), w)


def gte(tensors: dict, heads: int, **how) -> Tower:
    """Rotary positions, one matrix for q, k and v, gated GELU whose gate and up part are one matrix."""
    t = _bare(tensors)
    n = _layers(t, "encoder.layer.")
    w = _take(t, {"embed": "embeddings.word_embeddings", "embed_norm": "embeddings.LayerNorm"})
    for i in range(n):
        at, here = f"layer.{i}", f"encoder.layer.{i}"
        w |= _take(t, {f"{at}.qkv": f"{here}.attention.qkv_proj", f"{at}.o": f"{here}.attention.o_proj", f"{at}.norm1": f"{here}.attn_ln", f"{at}.norm2": f"{here}.mlp_ln", f"{at}.upgate": f"{here}.mlp.up_gate_proj", f"{at}.down": f"{here}.mlp.down_proj"})
        _split_rows(w, at, "qkv", "q k v")
        _split_rows(w, at, "upgate", "up gate")
    return Tower(Config(heads, n, positions="rotary", gated=True, **({"pooling": "cls"} | how)), w)


class Splade:
    """A masked-word head on a tower: log(1 + the greatest logit above 0) of each vocabulary entry."""

    def __init__(self, tensors: dict, heads: int, **how):
        self.tower = bert(tensors, heads, **how)
        t = tensors
        self.head = _take(t, {"dense": "cls.predictions.transform.dense", "norm": "cls.predictions.transform.LayerNorm"})
        self.bias = np.asarray(t["cls.predictions.bias"], np.float64)

    def expand(self, texts: list[list[int]]) -> list[dict[int, float]]:
        out = []
        for x in self.tower.tokens(texts):
            if not len(x):
                out.append({})
                continue
            y = layer_norm(gelu(x @ self.head["dense"].T + self.head["dense.b"]), self.head["norm"], self.head["norm.b"], 1e-12)
            top = (y @ self.tower.w["embed"].T + self.bias).max(0)
            out.append({int(i): float(np.log1p(top[i])) for i in np.flatnonzero(top > 0)})
        return out


def pair_ids(query: list[int], doc: list[int], cls: int, sep: int, longest: int) -> tuple[list[int], list[int]]:
    """([cls] query [sep] doc [sep], their segments), cut to longest from the longer side; equal sides lose from doc first."""
    n, m = len(query), len(doc)
    while n + m > longest - 3:
        n, m = (n - 1, m) if n > m else (n, m - 1)
    return [cls, *query[:n], sep, *doc[:m], sep], [0] * (n + 2) + [1] * (m + 1)


class CrossEncoder:
    """Scores of (query, document) pairs that are read together."""

    def __init__(self, tensors: dict, heads: int, cls: int, sep: int, longest: int = 512, **how):
        self.tower, self.cls, self.sep, self.longest = bert(tensors, heads, **how), cls, sep, longest
        t = _bare(tensors)
        self.head = _take(t, {"pooler": "pooler.dense", "out": "classifier"})

    def scores(self, pairs: list[tuple[list[int], list[int]]]) -> np.ndarray:
        """(pairs, labels) of logits."""
        framed = [pair_ids(q, d, self.cls, self.sep, self.longest) for q, d in pairs]
        out = np.zeros((len(pairs), len(self.head["out"])))
        for batch in length_batches([len(i) for i, _ in framed]):
            hidden = self.tower.tokens([framed[i][0] for i in batch], [framed[i][1] for i in batch])
            first = np.stack([x[0] for x in hidden])
            pooled = np.tanh(first @ self.head["pooler"].T + self.head["pooler.b"])
            out[batch] = pooled @ self.head["out"].T + self.head["out.b"]
        return out


class LateScorer:
    """Late interaction of pairs of ids, given each id's vector; ids without one are left out, and an empty side scores 0."""

    def __init__(self, vectors):
        self.vectors = np.asarray(vectors, np.float64)

    def scores(self, pairs: list[tuple[list[int], list[int]]]) -> np.ndarray:
        out, n = np.zeros((len(pairs), 1)), len(self.vectors)
        for k, (q, d) in enumerate(pairs):
            q, d = ([i for i in x if 0 <= i < n] for x in (q, set(d)))
            if q and d:
                out[k] = (self.vectors[q] @ self.vectors[d].T).max(1).sum()
        return out


#: The least width to which a model's vectors may be cut.
LEAST_WIDTHS = {"nomic-embed-text-v1.5": 64, "mxbai-embed-large-v1": 64, "text-embedding-3-small": 256, "text-embedding-3-large": 256}


def least_width(model: str, floors: dict[str, int] = LEAST_WIDTHS) -> int:
    """What vectors of a model may be cut to; a model that wasn't trained for it is refused."""
    if model not in floors:
        raise ValueError(f"vectors of {model} can't be cut")
    return floors[model]


# --- images -----------------------------------------------------------------------------------------------

MOST_PIXELS = 64 << 20


def preprocess(image: np.ndarray, size: int, mean=(0.5, 0.5, 0.5), std=(0.5, 0.5, 0.5), most_pixels: int = MOST_PIXELS) -> np.ndarray:
    """(3, size, size) of an 8-bit (height, width, 3) image: bilinear at half-pixel centres, then (v / 255 - mean) / std."""
    h, w = image.shape[:2]
    if h * w > most_pixels:
        raise ValueError(f"an image of {h} x {w} is too large")

    def between(n: int):
        x = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        a = np.floor(x).astype(int)
        return a, np.minimum(a + 1, n - 1), x - a

    (a, b, f), (c, d, g) = between(h), between(w)
    v = image.astype(np.float64)
    rows = v[a] * (1 - f)[:, None, None] + v[b] * f[:, None, None]
    out = rows[:, c] * (1 - g)[None, :, None] + rows[:, d] * g[None, :, None]
    return ((out / 255 - np.array(mean)) / np.array(std)).transpose(2, 0, 1)


def patches(image: np.ndarray, patch: int) -> np.ndarray:
    """(patches, 3 * patch * patch), row by row; what doesn't fill a patch at the right and bottom is left out."""
    c, h, w = image.shape
    h, w = h // patch, w // patch
    return image[:, : h * patch, : w * patch].reshape(c, h, patch, w, patch).transpose(1, 3, 0, 2, 4).reshape(h * w, -1)


class VisionTower:
    """A pre-norm vision transformer over patches; its output is the sequence of patches."""

    def __init__(self, tensors: dict, heads: int, patch: int, **how):
        t = {k.removeprefix("vision_model."): v for k, v in tensors.items()}
        n = _layers(t, "encoder.layers.")
        kernel = np.asarray(t["embeddings.patch_embedding.weight"], np.float64)
        w = {"patch": kernel.reshape(len(kernel), -1), "patch.b": np.asarray(t["embeddings.patch_embedding.bias"], np.float64), "positions": np.asarray(t["embeddings.position_embedding.weight"], np.float64)}
        parts = {"q": "self_attn.q_proj", "k": "self_attn.k_proj", "v": "self_attn.v_proj", "o": "self_attn.out_proj", "norm1": "layer_norm1", "norm2": "layer_norm2", "up": "mlp.fc1", "down": "mlp.fc2"}
        w |= _take(t, {"final_norm": "post_layernorm"} | {f"layer.{i}.{own}": f"encoder.layers.{i}.{name}" for i in range(n) for own, name in parts.items()})
        self.patch, self.tower = patch, Tower(Config(heads, n, norm="pre", activation="gelu_tanh", positions="none", eps=1e-6, **how), w)

    def forward(self, image: np.ndarray) -> np.ndarray:
        x = self.tower.dense(patches(image, self.patch), "patch") + self.tower.w["positions"]
        return self.tower.run(x[None], np.ones((1, len(x)), np.bool_))[0]


# --- over DataFrames --------------------------------------------------------------------------------------


def _shared(df: DataFrame, model):
    return df.sparkSession.sparkContext.broadcast(model)


def embed(ids: DataFrame, tower: Tower) -> DataFrame:
    """(doc_id, embedding) of (doc_id, ids); null ids give null."""
    model = _shared(ids, tower)

    def run(batches):
        for pdf in batches:
            texts = [None if x is None else list(x) for x in pdf["ids"]]
            some = [i for i, x in enumerate(texts) if x is not None]
            out = [None] * len(texts)
            for batch in length_batches([len(texts[i]) for i in some]):
                for k, v in zip(batch, model.value.encode([texts[some[k]] for k in batch])):
                    out[some[k]] = v.tolist()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "embedding": out})

    return ids.select("doc_id", "ids").mapInPandas(run, "doc_id bigint, embedding array<double>")


def token_matrices(ids: DataFrame, tower: Tower) -> DataFrame:
    """(doc_id, matrix): a unit vector for each token, for late interaction."""
    model = _shared(ids, tower)

    def run(batches):
        for pdf in batches:
            out = []
            for x in pdf["ids"]:
                m = model.value.tokens([list(x) if x is not None else []])[0]
                out.append((m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)).tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "matrix": out})

    return ids.select("doc_id", "ids").mapInPandas(run, "doc_id bigint, matrix array<array<double>>")


def expand(ids: DataFrame, model: Splade) -> DataFrame:
    """(doc_id, terms, weights) by a masked-word head."""
    shared = _shared(ids, model)

    def run(batches):
        for pdf in batches:
            texts = [list(x) if x is not None else [] for x in pdf["ids"]]
            out = [None] * len(texts)
            for batch in length_batches([len(x) for x in texts]):
                for k, v in zip(batch, shared.value.expand([texts[k] for k in batch])):
                    out[k] = v
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "terms": [list(x) for x in out], "weights": [list(x.values()) for x in out]})

    return ids.select("doc_id", "ids").mapInPandas(run, "doc_id bigint, terms array<bigint>, weights array<double>")


def rerank(shortlist: DataFrame, queries: DataFrame, docs: DataFrame, k: int, score) -> DataFrame:
    """The k best of a shortlist (query_id, doc_id) by ``score``: a Column over query_ids and doc_ids, or a model with scores() of pairs of ids.

    queries (query_id, query_ids) and docs (doc_id, doc_ids) are joined to the shortlist, so only its pairs are ever scored. Its documents are picked
    where they are: the others' ids are neither shuffled nor sorted.
    """
    docs = docs.join(F.broadcast(shortlist.select("doc_id").distinct()), "doc_id", "left_semi")
    pairs = shortlist.select("query_id", "doc_id").join(queries, "query_id").join(docs, "doc_id").select("query_id", "doc_id", "query_ids", "doc_ids")
    if isinstance(score, Column):
        return top_k(pairs.select("query_id", "doc_id", score.alias("score")), k, ["query_id"])
    model = _shared(shortlist, score)

    def run(batches):
        for pdf in batches:
            s = model.value.scores([(list(q), list(d)) for q, d in zip(pdf["query_ids"], pdf["doc_ids"])])[:, 0] if len(pdf) else []
            yield pdf[["query_id", "doc_id"]].assign(score=s)

    return top_k(pairs.mapInPandas(run, "query_id bigint, doc_id bigint, score double"), k, ["query_id"])
