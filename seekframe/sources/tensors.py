"""Python data sources for tensor containers: ``spark.dataSource.register(SafetensorsSource)`` and so on.

Each tensor is one partition, of which only its own byte range is read.
"""

from __future__ import annotations

import json
import os
import struct

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, dtype string, shape array<bigint>, values array<float>"
_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "U8": "u1", "I8": "i1", "BOOL": "u1"}


def floats(data: bytes, dtype: str) -> np.ndarray:
    """Values of a little-endian payload as 32-bit floats; BF16 is the upper half of one."""
    if dtype == "BF16":
        return (np.frombuffer(data, "<u2").astype("<u4") << 16).view("<f4")
    if dtype not in _TYPES:
        raise ValueError(f"unknown tensor type {dtype}")
    return np.frombuffer(data, _TYPES[dtype]).astype("<f4")


def safetensors_header(path: str) -> tuple[dict, int]:
    """Header of a file, and where its data begin."""
    with open(path, "rb") as f:
        (n,) = struct.unpack("<Q", f.read(8))
        if n > 100 << 20:
            raise ValueError("header too long")
        header = json.loads(f.read(n))
    header.pop("__metadata__", None)
    return header, 8 + n


def safetensors_parts(path: str) -> list[tuple]:
    """(file, name, type, shape, start, end) of every tensor of a file, or of all files that an index (….index.json) names."""
    wanted = None
    files = [path]
    if path.endswith(".json"):
        with open(path) as f:
            wanted = json.load(f)["weight_map"]
        files = sorted({os.path.join(os.path.dirname(path), x) for x in wanted.values()})
    out = []
    for file in files:
        header, base = safetensors_header(file)
        size = os.path.getsize(file)
        for name, t in header.items():
            start, end = (base + x for x in t["data_offsets"])
            if not base <= start <= end <= size:
                raise ValueError(f"{name} lies outside of {file}")
            if wanted is None or os.path.join(os.path.dirname(path), wanted.get(name, "")) == file:
                out.append((file, name, t["dtype"], t["shape"], start, end))
    if wanted is not None and {x[1] for x in out} != set(wanted):
        raise ValueError(f"{path} names tensors that its files don't hold")
    return sorted(out, key=lambda x: x[1])


def read_safetensors(path: str) -> dict[str, np.ndarray]:
    """All tensors, as the loaders of models take them."""
    out = {}
    for file, name, kind, shape, start, end in safetensors_parts(path):
        with open(file, "rb") as f:
            f.seek(start)
            out[name] = floats(f.read(end - start), kind).reshape(shape)
    return out


class _Tensor(InputPartition):
    def __init__(self, path, name, dtype, shape, start, end):
        self.path, self.name, self.dtype, self.shape, self.start, self.end = path, name, dtype, shape, start, end


class _Reader(DataSourceReader):
    def __init__(self, parts, decode):
        self.parts, self.decode = parts, decode

    def partitions(self):
        return self.parts

    def read(self, p):
        with open(p.path, "rb") as f:
            f.seek(p.start)
            data = f.read(p.end - p.start)
        values = self.decode(data, p.dtype)
        if len(values) < int(np.prod(p.shape)):
            raise ValueError(f"{p.name}: {len(values)} values for shape {p.shape}")
        yield p.name, p.dtype, [int(x) for x in p.shape], values[: int(np.prod(p.shape))].tolist()


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls):
        return "safetensors"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader([_Tensor(*x) for x in safetensors_parts(self.options["path"])], floats)


#: GGUF tensor types: number -> (name, bytes of a block, values of a block)
_BLOCKS = {
    0: ("F32", 4, 1), 1: ("F16", 2, 1), 30: ("BF16", 2, 1), 2: ("Q4_0", 18, 32), 3: ("Q4_1", 20, 32), 6: ("Q5_0", 22, 32), 7: ("Q5_1", 24, 32), 8: ("Q8_0", 34, 32), 10: ("Q2_K", 84, 256),
    11: ("Q3_K", 110, 256), 12: ("Q4_K", 144, 256), 13: ("Q5_K", 176, 256), 14: ("Q6_K", 210, 256), 20: ("IQ4_NL", 18, 32), 23: ("IQ4_XS", 136, 256), 39: ("MXFP4", 17, 32),
}
_SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}


#: Values of 4-bit codes: a table made for normal weights, and floats of one sign, two exponent and one mantissa bit, doubled.
_NORMAL4 = np.array([-127, -104, -83, -65, -49, -35, -22, -10, 1, 13, 25, 38, 53, 69, 89, 113], np.float32)
_FLOAT4 = np.array([0, 1, 2, 3, 4, 6, 8, 12, 0, -1, -2, -3, -4, -6, -8, -12], np.float32)


def _half(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view("<f2").astype(np.float32)


def _nibbles(a: np.ndarray) -> np.ndarray:
    """All low halves of the last axis' bytes, then all high ones."""
    return np.concatenate((a & 15, a >> 4), -1)


def _bits(a: np.ndarray, width: int) -> np.ndarray:
    """(..., 8 / width, bytes): the fields of each byte, from the lowest on."""
    return a[..., None, :] >> np.arange(0, 8, width, dtype=np.uint8)[:, None] & ((1 << width) - 1)


def _six(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight 6-bit scales and minima in twelve bytes."""
    scale = np.concatenate((s[:, :4] & 63, (s[:, 8:] & 15) | (s[:, :4] >> 6 << 4)), 1)
    least = np.concatenate((s[:, 4:8] & 63, (s[:, 8:] >> 4) | (s[:, 4:8] >> 6 << 4)), 1)
    return scale.astype(np.float32), least.astype(np.float32)


def dequantize(data: bytes, dtype: str) -> np.ndarray:
    """Values of whole blocks."""
    if dtype in ("F32", "F16", "BF16"):
        return floats(data, dtype)
    size = next((b for n, b, _ in _BLOCKS.values() if n == dtype), None)
    if size is None:
        raise ValueError(f"unknown block type {dtype}")
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    n = len(raw)
    if dtype == "Q8_0":
        out = _half(raw[:, :2]) * raw[:, 2:].view(np.int8)
    elif dtype == "Q4_0":
        out = _half(raw[:, :2]) * (_nibbles(raw[:, 2:]).astype(np.int8) - 8)
    elif dtype == "Q4_1":
        out = _half(raw[:, :2]) * _nibbles(raw[:, 4:]) + _half(raw[:, 2:4])
    elif dtype in ("Q5_0", "Q5_1"):
        at = 2 if dtype == "Q5_0" else 4
        q = _nibbles(raw[:, at + 4 :]) | np.unpackbits(raw[:, at : at + 4], axis=1, bitorder="little") << 4
        out = _half(raw[:, :2]) * (q.astype(np.int8) - 16) if at == 2 else _half(raw[:, :2]) * q + _half(raw[:, 2:4])
    elif dtype == "IQ4_NL":
        out = _half(raw[:, :2]) * _NORMAL4[_nibbles(raw[:, 2:])]
    elif dtype == "MXFP4":
        out = np.exp2(raw[:, :1].astype(np.float32) - 128) * _FLOAT4[_nibbles(raw[:, 1:])]
    elif dtype == "IQ4_XS":
        high = np.ascontiguousarray(raw[:, 2:4]).view("<u2") >> np.arange(0, 16, 2, dtype=np.uint16) & 3
        low = np.stack((raw[:, 4:8] & 15, raw[:, 4:8] >> 4), 2).reshape(n, 8)
        scale = _half(raw[:, :2]) * ((low | high << 4).astype(np.float32) - 32)
        out = scale[:, :, None] * _NORMAL4[_nibbles(raw[:, 8:].reshape(n, 8, 16))]
    elif dtype == "Q2_K":
        s = raw[:, :16]
        q = _bits(raw[:, 16:80].reshape(n, 2, 32), 2).reshape(n, 16, 16)
        out = (_half(raw[:, 80:82]) * (s & 15))[:, :, None] * q - (_half(raw[:, 82:84]) * (s >> 4))[:, :, None]
    elif dtype == "Q3_K":
        s = raw[:, 96:108]
        scale = (_nibbles(s[:, :8]) | _bits(s[:, 8:], 2).reshape(n, 16) << 4).astype(np.float32) - 32
        low = _bits(raw[:, 32:96].reshape(n, 2, 32), 2).reshape(n, 16, 16).astype(np.int8)
        high = _bits(raw[:, :32], 1).reshape(n, 16, 16).astype(np.int8)
        out = (_half(raw[:, 108:110]) * scale)[:, :, None] * (low - 4 * (1 - high))
    elif dtype == "Q6_K":
        low = _nibbles(raw[:, :128].reshape(n, 2, 64)).reshape(n, 2, 4, 32)
        q = (low | _bits(raw[:, 128:192].reshape(n, 2, 32), 2) << 4).astype(np.int8) - 32
        out = (_half(raw[:, 208:210]) * raw[:, 192:208].view(np.int8))[:, :, None] * q.reshape(n, 16, 16)
    else:  # Q4_K, Q5_K
        scale, least = _six(raw[:, 4:16])
        at = 16 if dtype == "Q4_K" else 48
        q = raw[:, at:].reshape(n, 4, 32)
        q = np.stack((q & 15, q >> 4), 2).reshape(n, 8, 32)
        if dtype == "Q5_K":
            q = q | _bits(raw[:, 16:48], 1) << 4
        out = (_half(raw[:, :2]) * scale)[:, :, None] * q - (_half(raw[:, 2:4]) * least)[:, :, None]
    return out.astype(np.float32).ravel()


def gguf_header(path: str) -> tuple[dict, list[tuple]]:
    """(metadata, tensors as (name, type, shape, start, end))."""
    with open(path, "rb") as f:
        take = lambda kind: struct.unpack(kind, f.read(struct.calcsize(kind)))[0]
        text = lambda: f.read(take("<Q")).decode()
        if f.read(4) != b"GGUF":
            raise ValueError("not a GGUF file")
        version = take("<I")
        if version not in (2, 3):
            raise ValueError(f"GGUF version {version}")
        tensors, pairs = take("<Q"), take("<Q")

        def value(kind):
            if kind == 8:
                return text()
            if kind == 9:
                inner, n = take("<I"), take("<Q")
                return [value(inner) for _ in range(n)]
            if kind not in _SCALARS:
                raise ValueError(f"metadata type {kind}")
            return take(_SCALARS[kind])

        meta = {}
        for _ in range(pairs):
            key = text()
            meta[key] = value(take("<I"))
        found = []
        for _ in range(tensors):
            name = text()
            shape = [take("<Q") for _ in range(take("<I"))]
            kind, offset = take("<I"), take("<Q")
            if kind not in _BLOCKS:
                raise ValueError(f"{name}: tensor type {kind} isn't supported")
            label, size, per = _BLOCKS[kind]
            found.append((name, label, shape[::-1], offset, int(np.prod(shape)) // per * size))
        align = int(meta.get("general.alignment", 32))
        base = -(-f.tell() // align) * align
    return meta, [(n, t, s, base + o, base + o + size) for n, t, s, o, size in found]


class GgufSource(DataSource):
    @classmethod
    def name(cls):
        return "gguf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        path = self.options["path"]
        return _Reader([_Tensor(path, *t) for t in gguf_header(path)[1]], dequantize)
