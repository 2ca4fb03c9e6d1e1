"""Byte-level BPE, and tokenizers as their JSON files describe them."""

from __future__ import annotations

import base64
import json

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subword import normalize, unigram_ids, wordpiece_word

#: The published pattern: white space stays with the word it stands before, but for the last sign of a run.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 1 << 16


def byte_letters() -> dict[int, str]:
    """A printable letter for each byte, as vocabulary files write them: printable Latin-1 stands for itself, the others come after."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines (base64 of the bytes, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


class BytePair:
    """merges: rank of each pair that may be joined; without it any two parts whose joined bytes have an id, by the ids."""

    def __init__(self, ids: dict[bytes, int], merges: dict[tuple[bytes, bytes], int] | None = None, pattern: str = PATTERN):
        self.ids, self.merges, self.words = ids, merges, regex.compile(pattern)
        self.bytes, self.cache = {i: b for b, i in ids.items()}, {}

    def _rank(self, a: bytes, b: bytes):
        return self.ids.get(a + b) if self.merges is None else self.merges.get((a, b))

    def piece(self, data: bytes) -> list[int]:
        """Ids of one word: the pair of the lowest rank, leftmost first, is joined until none is left."""
        if data in self.cache:
            return self.cache[data]
        parts = [bytes([b]) for b in data]
        ranks = [self._rank(a, b) for a, b in zip(parts, parts[1:])]
        while True:
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self._rank(parts[i - 1], parts[i])
            if i < len(ranks):
                ranks[i] = self._rank(parts[i], parts[i + 1])
        out = [self.ids[p] for p in parts]
        if len(data) < 64:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[data] = out
        return out

    def encode(self, text: str) -> list[int]:
        return [i for m in self.words.finditer(text) for i in self.piece(m[0].encode("utf-8", "replace"))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


class Tokenizer:
    """What a tokenizer file says: byte-level BPE, WordPiece or unigram, with added tokens carved out of the text first, the longest at a place."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kind = model.get("type") or ("BPE" if "merges" in model else "WordPiece")
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.added, self.split = added, regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=lambda t: (-len(t), t)))) + ")") if added else None
        if kind == "BPE":
            if "ByteLevel" not in json.dumps([spec.get("pre_tokenizer"), spec.get("decoder")]):
                raise ValueError("only BPE over bytes is supported")
            letter = {c: b for b, c in byte_letters().items()}
            raw = lambda t: bytes(letter[c] for c in t)
            ids = {raw(t): i for t, i in model["vocab"].items() if all(c in letter for c in t) and t not in added}
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.plain = BytePair(ids, {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}).encode
        elif kind == "WordPiece":
            vocab, unknown = model["vocab"], model["vocab"][model.get("unk_token", "[UNK]")]
            lower = (spec.get("normalizer") or {}).get("lowercase", True)
            words = regex.compile(r"[\p{P}$+<=>^`|~]|[^\s\p{P}$+<=>^`|~]+")
            self.plain = lambda t: [i for m in words.finditer(normalize(t, lower)) for i in wordpiece_word(m[0], vocab, unknown)]
        elif kind == "Unigram":
            scores = {piece: (i, score) for i, (piece, score) in enumerate(model["vocab"])}
            longest = max(map(len, scores))
            self.plain = lambda t: unigram_ids(t, scores, model.get("unk_id") or 0, longest) if t.strip() else []
        else:
            raise ValueError(f"tokenizers of type {kind!r} aren't supported")

    def encode(self, text: str) -> list[int]:
        out = []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            out += [self.added[part]] if k % 2 else self.plain(part) if part else []
        return out


def encode(docs: DataFrame, load) -> DataFrame:
    """(doc_id, ids) of (doc_id, text) by what ``load()`` gives, once for each task; null texts have null ids."""

    def run(batches):
        encoder = load()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [None if t is None else encoder.encode(t) for t in pdf["text"]]})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, ids array<int>")
