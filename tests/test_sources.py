import json
import struct

import numpy as np
import pytest

from seekframe.sources import tensors
from seekframe.streaming import delta


def test_safetensors(spark, tmp_path):
    a, b = np.arange(6, dtype="<f4").reshape(2, 3), np.array([1.5, -2.0], "<f4")
    half = (b.view("<u4") >> 16).astype("<u2").tobytes()
    header = json.dumps({"a": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "b": {"dtype": "BF16", "shape": [2], "data_offsets": [24, 28]}}).encode()
    path = tmp_path / "x.safetensors"
    path.write_bytes(struct.pack("<Q", len(header)) + header + a.tobytes() + half)
    spark.dataSource.register(tensors.SafetensorsSource)
    got = {r["name"]: r for r in spark.read.format("safetensors").option("path", str(path)).load().collect()}
    assert got["a"]["values"] == a.ravel().tolist() and got["a"]["shape"] == [2, 3] and got["b"]["values"] == [1.5, -2.0]


def test_gguf_blocks(spark, tmp_path):
    d = np.array([0.5], "<f2").tobytes()
    q8 = d + np.arange(-16, 16, dtype=np.int8).tobytes()
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    head = b"GGUF" + struct.pack("<IQQ", 3, 1, 1) + text("general.name") + struct.pack("<I", 8) + text("tiny") + text("w") + struct.pack("<IQIQ", 1, 32, 8, 0)
    path = tmp_path / "x.gguf"
    path.write_bytes(head.ljust(-(-len(head) // 32) * 32, b"\0") + q8)
    assert tensors.gguf_header(str(path))[0] == {"general.name": "tiny"}
    spark.dataSource.register(tensors.GgufSource)
    row = spark.read.format("gguf").option("path", str(path)).load().first()
    assert row["values"] == [0.5 * x for x in range(-16, 16)]
    assert tensors.dequantize(d + bytes([0x10] * 16), "Q4_0").tolist() == [-4.0] * 16 + [-3.5] * 16
    with pytest.raises(ValueError):
        tensors.floats(b"", "X")


def test_delta_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i == j) for j in range(3)]) for i in range(3)], "doc_id bigint, embedding array<double>")
    rows.filter("doc_id = 2").write.parquet(str(tmp_path / "in"))
    delta.follow(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    queries = spark.createDataFrame([(0, [0.0, 0.0, 1.0])], "query_id bigint, query array<double>")
    late = spark.read.parquet(str(tmp_path / "out"))
    got = delta.answer(rows.filter("doc_id < 2"), late, queries, 3).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2}
    dead = spark.createDataFrame([(2,)], "doc_id bigint")
    assert {r["doc_id"] for r in delta.answer(rows.filter("doc_id < 2"), late, queries, 3, dead).collect()} == {0, 1}


def _loops(raw, kind):
    """One block by loops over its values, as the format's description gives them."""
    half = lambda i: float(np.frombuffer(bytes(raw[i : i + 2]), "<f2")[0])
    normal = [-127, -104, -83, -65, -49, -35, -22, -10, 1, 13, 25, 38, 53, 69, 89, 113]
    out = []
    if kind in ("Q4_1", "Q5_1"):
        at = 4 if kind == "Q4_1" else 8
        for i in range(32):
            q = raw[at + i % 16] >> (4 if i >= 16 else 0) & 15
            if kind == "Q5_1":
                q |= (raw[4 + i // 8] >> i % 8 & 1) << 4
            out.append(half(0) * q + half(2))
    elif kind == "IQ4_NL":
        out = [half(0) * normal[raw[2 + i % 16] >> (4 if i >= 16 else 0) & 15] for i in range(32)]
    elif kind == "MXFP4":
        values = [0, 0.5, 1, 1.5, 2, 3, 4, 6]
        for i in range(32):
            q = raw[1 + i % 16] >> (4 if i >= 16 else 0) & 15
            out.append((-1 if q & 8 else 1) * values[q & 7] * 2.0 ** (raw[0] - 127))
    elif kind == "IQ4_XS":
        for i in range(256):
            b, j = i // 32, i % 32
            s = raw[4 + b // 2] >> 4 * (b % 2) & 15 | ((raw[2] | raw[3] << 8) >> 2 * b & 3) << 4
            out.append(half(0) * (s - 32) * normal[raw[8 + 16 * b + j % 16] >> (4 if j >= 16 else 0) & 15])
    elif kind == "Q2_K":
        for i in range(256):
            q = raw[16 + i // 128 * 32 + i % 32] >> 2 * (i % 128 // 32) & 3
            out.append(half(80) * (raw[i // 16] & 15) * q - half(82) * (raw[i // 16] >> 4))
    elif kind == "Q3_K":
        for i in range(256):
            q = raw[32 + i // 128 * 32 + i % 32] >> 2 * (i % 128 // 32) & 3
            high = raw[i % 32] >> (i // 32) & 1
            g = i // 16
            s = (raw[96 + g % 8] >> (4 if g >= 8 else 0) & 15) | (raw[104 + g % 4] >> 2 * (g // 4) & 3) << 4
            out.append(half(108) * (s - 32) * (q - (0 if high else 4)))
    elif kind == "Q6_K":
        for i in range(256):
            n, k, j = i // 128, i % 128 // 32, i % 32
            low = raw[64 * n + j + 32 * (k % 2)] >> (4 if k >= 2 else 0) & 15
            q = (low | (raw[128 + 32 * n + j] >> 2 * k & 3) << 4) - 32
            s = raw[192 + i // 16]
            out.append(half(208) * (s - 256 if s > 127 else s) * q)
    else:
        at = 16 if kind == "Q4_K" else 48
        for i in range(256):
            g = i // 32
            q = raw[at + g // 2 * 32 + i % 32] >> (4 if g % 2 else 0) & 15
            if kind == "Q5_K":
                q |= (raw[16 + i % 32] >> g & 1) << 4
            s = raw[4:16]
            scale, least = (s[g] & 63, s[g + 4] & 63) if g < 4 else (s[g + 4] & 15 | s[g - 4] >> 6 << 4, s[g + 4] >> 4 | s[g] >> 6 << 4)
            out.append(half(0) * scale * q - half(2) * least)
    return out


@pytest.mark.parametrize("kind", ["Q4_1", "Q5_1", "IQ4_NL", "MXFP4", "IQ4_XS", "Q2_K", "Q3_K", "Q4_K", "Q5_K", "Q6_K"])
def test_block_formats_equal_loops(kind):
    r = np.random.default_rng(5)
    size, values = next((s, v) for n, s, v in tensors._BLOCKS.values() if n == kind)
    raw = r.integers(0, 256, (3, size), dtype=np.uint8)
    for at in {"Q2_K": (80, 82), "Q3_K": (108,), "Q6_K": (208,), "MXFP4": ()}.get(kind, (0, 2) if kind[:2] != "IQ" else (0,)):
        raw[:, at : at + 2] = r.normal(size=(3, 1)).astype("<f2").view(np.uint8)
    if kind == "MXFP4":
        raw[:, 0] = [120, 127, 130]
    got = tensors.dequantize(raw.tobytes(), kind).reshape(3, values)
    for row, block in zip(got, raw.tolist()):
        assert np.allclose(row, _loops(block, kind), rtol=1e-5, atol=1e-6)
    with pytest.raises(ValueError):
        tensors.dequantize(b"", "IQ9")


def test_sharded_safetensors(spark, tmp_path):
    def write(name, values):
        header, data, at = {}, b"", 0
        for k, v in values.items():
            header[k] = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [at, at + v.nbytes]}
            data, at = data + v.tobytes(), at + v.nbytes
        head = json.dumps(header).encode()
        (tmp_path / name).write_bytes(struct.pack("<Q", len(head)) + head + data)

    a, b = np.arange(4, dtype="<f4").reshape(2, 2), np.ones(3, "<f4")
    write("one.safetensors", {"a": a, "x": b})
    write("two.safetensors", {"b": b})
    index = tmp_path / "model.safetensors.index.json"
    index.write_text(json.dumps({"weight_map": {"a": "one.safetensors", "b": "two.safetensors"}}))
    got = tensors.read_safetensors(str(index))
    assert set(got) == {"a", "b"} and np.array_equal(got["a"], a)
    spark.dataSource.register(tensors.SafetensorsSource)
    assert {r["name"] for r in spark.read.format("safetensors").option("path", str(index)).load().collect()} == {"a", "b"}
    index.write_text(json.dumps({"weight_map": {"a": "one.safetensors", "c": "two.safetensors"}}))
    with pytest.raises(ValueError):
        tensors.read_safetensors(str(index))
