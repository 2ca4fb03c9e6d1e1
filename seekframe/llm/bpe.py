"""Byte-level BPE encoding and decoding.

A text is cut by the vocabulary's pattern, and the merges of a piece are found in a segment tree over its byte positions.  A leaf
holds the rank of the pair that starts there, an inner node the leftmost least rank below it.  A merge is read
off the root; it changes the pairs of three positions (its own, its left neighbour's, and that of the position that it ends), whose
leaves are updated in logarithmic time.  Pieces of like length go through their trees in step, as rows of arrays; a
long piece goes through one of its own.  A worker keeps the pieces it has encoded, until there are MOST_CACHED of them.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pattern of that vocabulary: contractions, letters, digits, other signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
MOST_CACHED = 1_000_000
#: Characters encoded at a time.
SLICE_CHARS = 2 << 20

_NONE = np.int64(1) << 60


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern, self.cache = regex.compile(pattern), {}
        self.byte_ids = np.full(256, -1, np.int64)
        pairs = []
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte_ids[token[0]] = rank
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a << 24 | b, rank))
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs = dict(pairs)
        pairs.sort()
        self.keys, self.ranks = (np.array([p[i] for p in pairs] or [0], np.int64) for i in (0, 1))
        if not pairs:
            self.keys[0] = -1
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    @classmethod
    def load(cls, path: str, pattern: str = PATTERN) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << np.int64(24) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        shift, none, pairs = width.bit_length() - 1, int(_NONE), self.pairs
        token = [int(self.byte_ids[b]) for b in piece] + [-1]
        after, before = list(range(1, n + 1)) + [n], list(range(-1, n))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(token[i] << 24 | token[i + 1])
            if rank is not None:
                tree[width + i] = rank << shift | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += width
            while tree[i] != value:
                tree[i] = value
                i >>= 1
                if not i:
                    return
                value = min(tree[2 * i], tree[2 * i + 1])

        while (least := tree[1]) < none:
            i, rank = least & (width - 1), least >> shift
            j = after[i]
            k = after[j]
            token[i] = rank
            after[i] = k
            if k < n:
                before[k] = i
            put(j, none)
            right = pairs.get(rank << 24 | token[k]) if k < n else None
            put(i, none if right is None else right << shift | i)
            if (h := before[i]) >= 0:
                left = pairs.get(token[h] << 24 | rank)
                put(h, none if left is None else left << shift | h)
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def merge_all(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes, a power of two."""
        rows, shift = len(pieces), np.int64(width.bit_length() - 1)
        length = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        place = np.arange(width)
        # one column more for what lies beyond either end
        token = np.full((rows, width + 1), -1, np.int64)
        token[:, :width] = np.where(place < length[:, None], self.byte_ids[raw], -1)
        after = np.minimum(np.arange(1, width + 2), width)[None, :].repeat(rows, 0)
        after[:, :width] = np.where(after[:, :width] < length[:, None], after[:, :width], width)
        before = np.arange(-1, width)[None, :].repeat(rows, 0)
        before[:, 0] = width
        tree = np.full((rows, 2 * width), _NONE, np.int64)
        rank = self._pair_ranks(token[:, :width].ravel(), token[:, 1:].ravel()).reshape(rows, width)
        tree[:, width:] = np.where(rank < _NONE, rank << shift | place, _NONE)
        for level in range(int(shift) - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            least = tree[live, 1]
            i, rank = least & np.int64(width - 1), least >> shift
            j = after[live, i]
            k = after[live, j]
            token[live, i] = rank
            token[live, j] = -1
            after[live, i] = k
            before[live, k] = i  # column width takes what has no right neighbour
            h = before[live, i]
            right = self._pair_ranks(rank, np.where(k < width, token[live, np.minimum(k, width)], -1))
            left = self._pair_ranks(np.where(h < width, token[live, h], -1), rank)
            self._put(tree, live, j, np.full(len(live), _NONE), width)
            self._put(tree, live, i, np.where(right < _NONE, right << shift | i, _NONE), width)
            some = h < width
            self._put(tree, live[some], h[some], np.where(left < _NONE, left << shift | h, _NONE)[some], width)
            live = live[tree[live, 1] < _NONE]
        return [row[row >= 0] for row in token[:, :width]]

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, value: np.ndarray, width: int) -> None:
        at = place + width
        tree[rows, at] = value
        while width > 1:
            at >>= 1
            width >>= 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    def _learn(self, pieces: set[str]) -> None:
        by: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            data = p.encode("utf-8", "replace")
            by.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((p, data))
        for width, group in by.items():
            if width > 256 or len(group) < 24:
                for p, data in group:
                    self.cache[p] = np.array(self.merge(data), "<i4").tobytes()
                continue
            step = max(24, (1 << 17) // width)
            for a in range(0, len(group), step):
                some = group[a : a + step]
                for (p, _), ids in zip(some, self.merge_all([d for _, d in some], width)):
                    self.cache[p] = ids.astype("<i4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        cut = [self.pattern.findall(t) for t in texts]
        new = set().union(*cut).difference(self.cache) if cut else set()
        if len(self.cache) + len(new) > MOST_CACHED:
            self.cache.clear()
            new = set().union(*cut)
        self._learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<i4").tolist()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that aren't UTF-8 become U+FFFD, and an unknown id is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id lies outside the vocabulary")
        n = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        data = self.flat[np.repeat(self.starts[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        at = ends[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0]


@lru_cache(4)
def vocabulary(path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    """The vocabulary of a file, read once by each worker."""
    return Vocabulary.load(path, pattern)


def _cuts(sizes: np.ndarray, most: int) -> list[int]:
    piece = np.cumsum(sizes) // most
    return [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless): the token ids of each text, and whether decoding them gives the text again.

    A map without a shuffle.  A null text has null ids, an empty one none; a null id is passed on; rows repeated are each
    encoded; an empty table gives no rows; other columns aren't read; a text is encoded whole, whatever its length.
    Special tokens in a text are ordinary text.  The file must be readable at ``path`` on every executor.
    """

    def run(batches):
        words = vocabulary(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cuts = _cuts(np.array([len(t or "") for t in texts], np.int64), SLICE_CHARS)
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = texts[a:b]
                coded = words.encode_all([t or "" for t in part])
                offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
                ids = np.frombuffer(b"".join(coded), "<i4")
                missing = [t is None for t in part]
                back = words.decode_all(ids.astype(np.int64), offsets)
                null = pa.array([None if m else int(o) for m, o in zip(missing, offsets)] + [int(offsets[-1])], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.ListArray.from_arrays(null, pa.array(ids)), pa.array([None if m else k for m, k in zip(missing, np.diff(offsets).tolist())], pa.int32()), pa.array([None if m else x == t for m, x, t in zip(missing, back, part)], pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "lossless"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens int, lossless boolean")


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text): the texts of token ids.

    Null ids have a null text, no ids an empty one; an id outside the vocabulary, or a null among ids, is an error; bytes that
    aren't UTF-8 become U+FFFD.  The other cases are as in encode().
    """

    def run(batches):
        words = vocabulary(path, pattern)
        for batch in batches:
            runs = batch.column(1)
            sizes = np.array([0 if x is None else x for x in pa.compute.list_value_length(runs).to_pylist()], np.int64)
            cuts = _cuts(sizes, SLICE_CHARS)
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = runs[a:b]
                ids = part.flatten()
                if ids.null_count:
                    raise ValueError("null among ids")
                texts = words.decode_all(ids.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[a:b]))))
                texts = [t if ok else None for t, ok in zip(texts, part.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
