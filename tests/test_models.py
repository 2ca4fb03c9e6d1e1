"""The towers against plain loops over planted weights, their loaders, and the operators that run them."""

from math import erf, exp, sqrt, tanh

import numpy as np
import pytest

from seekframe.operators import encode, models

R = np.random.default_rng(0)
DIM, HEADS, VOCAB = 8, 2, 20


def t(*shape):
    return R.normal(size=shape) * 0.3


def bert_tensors(layers=2):
    out = {"bert.embeddings.word_embeddings.weight": t(VOCAB, DIM), "bert.embeddings.position_embeddings.weight": t(40, DIM), "bert.embeddings.token_type_embeddings.weight": t(2, DIM)}
    for name, rows, width in [("bert.embeddings.LayerNorm", DIM, 0)] + [
        (f"bert.encoder.layer.{i}.{n}", r, w)
        for i in range(layers)
        for n, r, w in [(f"attention.self.{x}", DIM, DIM) for x in ("query", "key", "value")] + [("attention.output.dense", DIM, DIM), ("attention.output.LayerNorm", DIM, 0), ("intermediate.dense", 16, DIM), ("output.dense", DIM, 16), ("output.LayerNorm", DIM, 0)]
    ]:
        out[f"{name}.weight"], out[f"{name}.bias"] = (t(rows, width) if width else 1 + t(rows)), t(rows)
    return out


def norm(v, g, b):
    m = sum(v) / len(v)
    s = sqrt(sum((x - m) ** 2 for x in v) / len(v) + 1e-12)
    return [(x - m) / s * g[i] + b[i] for i, x in enumerate(v)]


def plain_bert(w, ids, types, layers=2):
    """One text, by loops."""
    get = lambda n: w["bert." + n]
    lin = lambda v, n: [sum(a * b for a, b in zip(v, row)) + c for row, c in zip(get(n + ".weight"), get(n + ".bias"))]
    ln = lambda v, n: norm(v, get(n + ".weight"), get(n + ".bias"))
    x = [ln([a + b + c for a, b, c in zip(get("embeddings.word_embeddings.weight")[i], get("embeddings.position_embeddings.weight")[p], get("embeddings.token_type_embeddings.weight")[k])], "embeddings.LayerNorm") for p, (i, k) in enumerate(zip(ids, types))]
    for layer in range(layers):
        at = f"encoder.layer.{layer}."
        q, k, v = ([lin(y, at + f"attention.self.{c}") for y in x] for c in ("query", "key", "value"))
        out, wide = [[] for _ in x], DIM // HEADS
        for h in range(HEADS):
            part = slice(h * wide, (h + 1) * wide)
            for i in range(len(x)):
                s = [sum(a * b for a, b in zip(q[i][part], k[j][part])) / sqrt(wide) for j in range(len(x))]
                e = [exp(y - max(s)) for y in s]
                out[i] += [sum(e[j] / sum(e) * v[j][part][d] for j in range(len(x))) for d in range(wide)]
        x = [ln([a + b for a, b in zip(y, lin(o, at + "attention.output.dense"))], at + "attention.output.LayerNorm") for y, o in zip(x, out)]
        up = [[0.5 * z * (1 + erf(z / sqrt(2))) for z in lin(y, at + "intermediate.dense")] for y in x]
        x = [ln([a + b for a, b in zip(y, lin(u, at + "output.dense"))], at + "output.LayerNorm") for y, u in zip(x, up)]
    return np.array(x)


def test_bert_equals_loops_and_padding_changes_nothing():
    w = bert_tensors()
    m, texts = models.bert(w, HEADS), [[3, 5, 7], [1], [2, 4, 6, 8, 10, 19], []]
    for got, ids in zip(m.tokens(texts), texts):
        assert np.allclose(got, plain_bert(w, ids, [0] * len(ids)) if ids else np.zeros((0, DIM)))
    v = m.encode(texts)
    mean = plain_bert(w, texts[0], [0] * 3).mean(0)
    assert np.allclose(v[0], mean / np.linalg.norm(mean)) and not v[3].any()
    assert np.allclose(models.bert(w, HEADS, pooling="cls").encode([[3, 5]])[0] @ plain_bert(w, [3, 5], [0, 0])[0], np.linalg.norm(plain_bert(w, [3, 5], [0, 0])[0]))
    shifted = dict(w) | {"bert.embeddings.position_embeddings.weight": np.concatenate((t(2, DIM), w["bert.embeddings.position_embeddings.weight"]))}
    assert np.allclose(models.bert(shifted, HEADS, roberta=True).tokens([[3, 5, 7]])[0], m.tokens([[3, 5, 7]])[0])
    with pytest.raises(ValueError):
        m.tokens([[1] * 41])
    with pytest.raises(ValueError):
        models.bert({k: v for k, v in w.items() if "value" not in k}, HEADS)
    with pytest.raises(ValueError):
        models.bert(w, HEADS, pooling="max")


def test_quantized_towers_stay_close():
    m = models.bert(bert_tensors(), HEADS)
    for kind, group, least in (("int8", 32, 0.97), ("int4", 8, 0.9)):
        small = m.quantized(kind, group=group)
        for ids in ([1, 2, 3], [9, 8, 7, 6, 5]):
            assert m.encode([ids])[0] @ small.encode([ids])[0] >= least


def test_quantized_products_are_whole_number_products():
    a, w = t(4, 16), t(5, 16)
    a[1], w[2] = 0, 0
    codes, scale = models.rows_i8(w)
    own, own_scale = models.rows_i8(a)
    want = [[sum(int(x) * int(y) for x, y in zip(own[i], codes[j])) * own_scale[i, 0] * scale[j, 0] for j in range(5)] for i in range(4)]
    assert np.allclose(models.matmul_w8a8(a, codes, scale), want) and scale[2, 0] == own_scale[1, 0] == 1
    assert np.allclose(models.matmul_q8(a, codes, scale), a @ (codes * scale).T)
    c4, s4 = models.groups_i4(w, 8)
    want4 = [[sum(sum(int(x) * int(y) for x, y in zip(own[i, 8 * g : 8 * g + 8], c4[j, g])) * s4[j, g, 0] for g in range(2)) * own_scale[i, 0] for j in range(5)] for i in range(4)]
    assert np.allclose(models.matmul_w4a8(a, c4, s4), want4) and np.abs(c4).max() <= 7
    with pytest.raises(ValueError):
        models.Weight(w, "int2")
    with pytest.raises(ValueError):
        models.Weight(w, backend="none")
    with pytest.raises(ValueError):
        models.register_backend("numpy", None)


def test_rotary_families():
    def layer(i, ffn):
        at = f"encoder.layers.{i}"
        return {f"{at}.attn.Wqkv.weight": t(3 * DIM, DIM), f"{at}.attn.out_proj.weight": t(DIM, DIM), f"{at}.norm1.weight": 1 + t(DIM), f"{at}.norm1.bias": t(DIM), f"{at}.norm2.weight": 1 + t(DIM), f"{at}.norm2.bias": t(DIM)} | {f"{at}.{k}": v for k, v in ffn.items()}

    head = {"embeddings.word_embeddings.weight": t(VOCAB, DIM), "emb_ln.weight": 1 + t(DIM), "emb_ln.bias": t(DIM)}
    dense = {"mlp.fc11.weight": t(16, DIM), "mlp.fc12.weight": t(16, DIM), "mlp.fc2.weight": t(DIM, 16)}
    m = models.rotary_swiglu(head | layer(0, dense), HEADS)
    x = m.w["embed"][[4, 2]]
    y = x - 0
    gate, up = y @ dense["mlp.fc12.weight"].T, y @ dense["mlp.fc11.weight"].T
    assert np.allclose(m.feed(y, "layer.0"), (gate / (1 + np.exp(-gate)) * up) @ dense["mlp.fc2.weight"].T)
    assert not np.isclose(np.linalg.norm(m.encode([[1, 2, 3]])[0]), 1)
    # moving a text along changes no product of rotated queries and keys
    q, k = t(6, 4), t(6, 4)
    near, far = encode.rope(q) @ encode.rope(k).T, encode.rope(np.concatenate((np.zeros((3, 4)), q)))[3:] @ encode.rope(np.concatenate((np.zeros((3, 4)), k)))[3:].T
    assert np.allclose(near, far)
    experts = {"mlp.router.layer.weight": t(3, DIM), "mlp.experts.mlp.w1": t(3 * 16, DIM), "mlp.experts.mlp.w2": t(3 * 16, DIM), "mlp.experts.bias": t(DIM)}
    moe = models.rotary_swiglu(head | layer(0, experts), HEADS, experts=3, experts_used=2)
    x = t(1, 4, DIM)
    got = moe.feed(x, "layer.0")[0]
    for i, v in enumerate(x[0]):
        s = v @ experts["mlp.router.layer.weight"].T
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        want = experts["mlp.experts.bias"].copy()
        for e in np.argsort(-p)[:2]:
            h = experts["mlp.experts.mlp.w1"][16 * e : 16 * e + 16] @ v
            want += p[e] * (np.array([0.5 * z * (1 + erf(z / sqrt(2))) for z in h]) @ experts["mlp.experts.mlp.w2"][16 * e : 16 * e + 16])
        assert np.allclose(got[i], want)
    with pytest.raises(ValueError):
        models.Config(2, 1, experts=3, experts_used=4)


def test_gte():
    w = {"new.embeddings.word_embeddings.weight": t(VOCAB, DIM), "new.embeddings.LayerNorm.weight": 1 + t(DIM), "new.embeddings.LayerNorm.bias": t(DIM)}
    at = "new.encoder.layer.0"
    w |= {f"{at}.attention.qkv_proj.weight": t(3 * DIM, DIM), f"{at}.attention.qkv_proj.bias": t(3 * DIM), f"{at}.attention.o_proj.weight": t(DIM, DIM), f"{at}.mlp.up_gate_proj.weight": t(32, DIM), f"{at}.mlp.down_proj.weight": t(DIM, 16), f"{at}.mlp.down_proj.bias": t(DIM)}
    w |= {f"{at}.{n}.{p}": t(DIM) + (p == "weight") for n in ("attn_ln", "mlp_ln") for p in ("weight", "bias")}
    m = models.gte(w, HEADS)
    x = t(3, DIM)
    both = x @ w[f"{at}.mlp.up_gate_proj.weight"].T
    assert np.allclose(m.feed(x, "layer.0"), (models.gelu(both[:, 16:]) * both[:, :16]) @ w[f"{at}.mlp.down_proj.weight"].T + w[f"{at}.mlp.down_proj.bias"])
    assert np.allclose(m.dense(x, "layer.0.k"), x @ w[f"{at}.attention.qkv_proj.weight"][DIM : 2 * DIM].T + w[f"{at}.attention.qkv_proj.bias"][DIM : 2 * DIM])
    assert np.isclose(np.linalg.norm(m.encode([[1, 2, 3]])[0]), 1)


def splade_tensors():
    return bert_tensors(1) | {"cls.predictions.transform.dense.weight": t(DIM, DIM), "cls.predictions.transform.dense.bias": t(DIM), "cls.predictions.transform.LayerNorm.weight": 1 + t(DIM), "cls.predictions.transform.LayerNorm.bias": t(DIM), "cls.predictions.bias": t(VOCAB)}


def test_splade_and_cross_encoder(spark):
    w = splade_tensors()
    m = models.Splade(w, HEADS)
    x = plain_bert(w, [3, 4, 5], [0, 0, 0], 1)
    h = [[0.5 * z * (1 + erf(z / sqrt(2))) for z in row] for row in x @ w["cls.predictions.transform.dense.weight"].T + w["cls.predictions.transform.dense.bias"]]
    h = np.array([norm(v, w["cls.predictions.transform.LayerNorm.weight"], w["cls.predictions.transform.LayerNorm.bias"]) for v in h])
    top = (h @ w["bert.embeddings.word_embeddings.weight"].T + w["cls.predictions.bias"]).max(0)
    want = {i: np.log(1 + v) for i, v in enumerate(top) if v > 0}
    got = m.expand([[3, 4, 5], []])
    assert got[0].keys() == want.keys() and all(np.isclose(got[0][i], want[i]) for i in want) and got[1] == {}
    ids = spark.createDataFrame([(1, [3, 4, 5]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    rows = {r["doc_id"]: dict(zip(r["terms"], r["weights"])) for r in models.expand(ids, m).collect()}
    assert rows[1] == pytest.approx(want) and rows[2] == rows[3] == {}

    c = bert_tensors() | {"bert.pooler.dense.weight": t(DIM, DIM), "bert.pooler.dense.bias": t(DIM), "classifier.weight": t(1, DIM), "classifier.bias": t(1)}
    ce = models.CrossEncoder({k: v for k, v in c.items() if not k.startswith("classifier")} | {"bert.classifier.weight": c["classifier.weight"], "bert.classifier.bias": c["classifier.bias"]}, HEADS, 1, 2, longest=9)
    q, d = [3, 4], [5, 6, 7, 8, 9, 10, 11]
    framed, kinds = models.pair_ids(q, d, 1, 2, 9)
    assert framed == [1, 3, 4, 2, 5, 6, 7, 8, 2] and kinds == [0, 0, 0, 0, 1, 1, 1, 1, 1]
    first = plain_bert(c, framed, kinds)[0]
    pooled = [tanh(sum(a * b for a, b in zip(first, row)) + e) for row, e in zip(c["bert.pooler.dense.weight"], c["bert.pooler.dense.bias"])]
    want = float(np.array(pooled) @ c["classifier.weight"][0] + c["classifier.bias"][0])
    assert np.allclose(ce.scores([(q, d), (q, [5])])[0], want)
    short = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "query_id bigint, doc_id bigint")
    docs = spark.createDataFrame([(1, d), (2, [5]), (3, [6, 6])], "doc_id bigint, doc_ids array<int>")
    got = models.rerank(short, spark.createDataFrame([(0, q)], "query_id bigint, query_ids array<int>"), docs, 2, ce).collect()
    each = {1: want, 2: float(ce.scores([(q, [5])])[0, 0]), 3: float(ce.scores([(q, [6, 6])])[0, 0])}
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(each, key=lambda i: -each[i])[:2]


def test_embedding_and_matrices(spark):
    m = models.bert(bert_tensors(), HEADS)
    ids = spark.createDataFrame([(i, [i % VOCAB] * (1 + i % 7)) for i in range(30)] + [(99, None), (98, [])], "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["embedding"] for r in models.embed(ids, m).collect()}
    assert got[99] is None and got[98] == [0.0] * DIM and np.allclose(got[9], m.encode([[9] * 3])[0])
    rows = {r["doc_id"]: r["matrix"] for r in models.token_matrices(ids, m).collect()}
    assert len(rows[9]) == 3 and np.allclose(np.linalg.norm(rows[9], axis=1), 1) and rows[99] == []


def test_length_batches():
    lengths = [5, 1, 9, 3, 3, 700, 2]
    got = models.length_batches(lengths, 12, 3)
    assert sorted(i for b in got for i in b) == list(range(7)) and [lengths[i] for b in got for i in b] == sorted(lengths)
    assert all(len(b) <= 3 and (len(b) == 1 or len(b) * max(lengths[i] for i in b) <= 12) for b in got)
    assert models.length_batches([]) == []


def test_activations_and_widths():
    x = np.linspace(-6, 6, 301)
    assert np.allclose(encode.erf(x), [erf(v) for v in x], atol=1e-12) and np.allclose(encode.silu(x), x / (1 + np.exp(-x)))
    assert np.allclose(encode.gelu_tanh(x), [0.5 * v * (1 + tanh(sqrt(2 / np.pi) * (v + 0.044715 * v**3))) for v in x])
    assert models.least_width("nomic-embed-text-v1.5") == 64
    with pytest.raises(ValueError):
        models.least_width("other")


def test_images():
    flat = np.full((7, 5, 3), 128, np.uint8)
    assert np.allclose(models.preprocess(flat, 4), (128 / 255 - 0.5) / 0.5)
    ramp = np.repeat(np.arange(8, dtype=np.uint8)[:, None, None], 8, 1).repeat(3, 2)
    assert np.allclose(models.preprocess(ramp, 4, std=(1 / 255,) * 3, mean=(0,) * 3)[0, :, 0], [0.5, 2.5, 4.5, 6.5])
    with pytest.raises(ValueError):
        models.preprocess(flat, 4, most_pixels=10)
    image = R.normal(size=(3, 8, 8))
    p = models.patches(image, 4)
    assert np.allclose(p[1].reshape(3, 4, 4), image[:, :4, 4:])
    at = "vision_model.encoder.layers.0"
    w = {"vision_model.embeddings.patch_embedding.weight": t(DIM, 3, 4, 4), "vision_model.embeddings.patch_embedding.bias": t(DIM), "vision_model.embeddings.position_embedding.weight": t(4, DIM)}
    for name, rows, width in [("vision_model.post_layernorm", DIM, 0), *[(f"{at}.self_attn.{x}_proj", DIM, DIM) for x in ("q", "k", "v", "out")], (f"{at}.layer_norm1", DIM, 0), (f"{at}.layer_norm2", DIM, 0), (f"{at}.mlp.fc1", 16, DIM), (f"{at}.mlp.fc2", DIM, 16)]:
        w[f"{name}.weight"], w[f"{name}.bias"] = (t(rows, width) if width else 1 + t(rows)), t(rows)
    tower = models.VisionTower(w, HEADS, 4)
    got = tower.forward(image)
    x = p @ w["vision_model.embeddings.patch_embedding.weight"].reshape(DIM, -1).T + w["vision_model.embeddings.patch_embedding.bias"] + w["vision_model.embeddings.position_embedding.weight"]
    ln = lambda v, n: np.array([(y - y.mean()) / np.sqrt(y.var() + 1e-6) for y in v]) * w[n + ".weight"] + w[n + ".bias"]
    lin = lambda v, n: v @ w[f"{at}.{n}.weight"].T + w[f"{at}.{n}.bias"]
    h = ln(x, f"{at}.layer_norm1")
    heads = []
    for s in (slice(0, 4), slice(4, 8)):
        a = lin(h, "self_attn.q_proj")[:, s] @ lin(h, "self_attn.k_proj")[:, s].T / 2
        a = np.exp(a) / np.exp(a).sum(1, keepdims=True)
        heads.append(a @ lin(h, "self_attn.v_proj")[:, s])
    x = x + lin(np.concatenate(heads, 1), "self_attn.out_proj")
    x = x + lin(encode.gelu_tanh(lin(ln(x, f"{at}.layer_norm2"), "mlp.fc1")), "mlp.fc2")
    assert np.allclose(got, ln(x, "vision_model.post_layernorm"))
