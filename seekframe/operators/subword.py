"""WordPiece and unigram tokenizers over (doc_id, text)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LONGEST_WORD = 100
#: Words of which a worker keeps the ids, and characters of texts that are cut before their ids are handed on.
WORDS, TEXTS = 1 << 16, 1 << 20
_CJK = re.compile("([㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f])")
_PIECES = re.compile(r"[^\w\s]|_|\w+", re.UNICODE)


def normalize(text: str, lower: bool = True) -> str:
    """Control characters go, white space becomes spaces, CJK signs stand alone, and lower-casing also strips accents."""
    text = "".join(" " if c in "\t\n\r" or unicodedata.category(c) == "Zs" else c for c in text if c in "\t\n\r" or unicodedata.category(c)[0] != "C" and c != "�")
    text = _CJK.sub(r" \1 ", text)
    if lower:
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
    return text


def wordpiece_word(word: str, vocab: dict[str, int], unknown: int) -> list[int]:
    """Longest match first; a word with an unmatched rest, or of more than LONGEST_WORD characters, is unknown."""
    if len(word) > LONGEST_WORD:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocab:
                out.append(vocab[piece])
                at = end
                break
        else:
            return [unknown]
    return out


def _ids(docs: DataFrame, encode) -> DataFrame:
    """(doc_id, ids); some TEXTS characters of texts at a time, however many rows a batch has."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                to = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + TEXTS, "right")))
                part = batch.slice(a, to - a)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([None if t is None else encode(t) for t in part["text"].to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])
                a = to

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _kept(cut):
    """cut, with what it gave for short words kept while there are no more than WORDS."""
    words: dict[str, list[int]] = {}

    def get(word: str) -> list[int]:
        if len(word) > LONGEST_WORD:
            return cut(word)
        if word not in words:
            if len(words) >= WORDS:
                words.clear()
            words[word] = cut(word)
        return words[word]

    return get


def wordpiece(docs: DataFrame, vocab: dict[str, int], unknown: str = "[UNK]") -> DataFrame:
    cut = _kept(lambda word: wordpiece_word(word, vocab, vocab[unknown]))
    return _ids(docs, lambda text: [i for word in _PIECES.findall(normalize(text)) for i in cut(word)])


def _least(scores: dict[str, tuple[int, float]]) -> float:
    return min(x for _, x in scores.values()) - 10


def _path(s: str, scores: dict[str, tuple[int, float]], unknown: int, longest: int, least: float) -> list[int]:
    best, back = [0.0] + [float("-inf")] * len(s), [(0, unknown)] * (len(s) + 1)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + longest) + 1):
            known = scores.get(s[i:j])
            if known is None and j > i + 1:
                continue
            ident, score = known or (unknown, least)
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, ident)
    out, at = [], len(s)
    while at:
        at, ident = back[at]
        if not (ident == unknown and out and out[-1] == unknown):
            out.append(ident)
    return out[::-1]


def unigram_ids(text: str, scores: dict[str, tuple[int, float]], unknown: int, longest: int) -> list[int]:
    """Ids of the likeliest cut; an unknown character scores 10 below the least, and neighbouring ones are one id."""
    return _path("▁" + re.sub(r"\s+", "▁", text.strip()), scores, unknown, longest, _least(scores))


def unigram(docs: DataFrame, scores: dict[str, tuple[int, float]], unknown: int = 0) -> DataFrame:
    """Texts are cut word by word, each word once, unless a piece reaches beyond the start of a word."""
    longest, least = max(map(len, scores)), _least(scores)
    if any("▁" in piece[1:] for piece in scores):
        return _ids(docs, lambda t: unigram_ids(t, scores, unknown, longest) if t.strip() else [])
    cut = _kept(lambda word: _path("▁" + word, scores, unknown, longest, least))

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for word in text.split():
            ids = cut(word)
            out += ids[1:] if out and out[-1] == unknown == ids[0] else ids
        return out

    return _ids(docs, encode)


def sample_vocabulary() -> dict[str, int]:
    """A small vocabulary of letters and common syllables, for tests."""
    letters = [chr(c) for c in range(33, 127) if not chr(c).isupper()]
    words = ["[UNK]", *letters, *["##" + c for c in letters], *[p + s for s in ("the", "tion", "er", "in", "on", "an", "es", "en", "ou", "que", "ion") for p in ("", "##")]]
    return {w: i for i, w in enumerate(dict.fromkeys(words))}


def sample_scores() -> dict[str, tuple[int, float]]:
    pieces = ["<unk>", "▁", *[chr(c) for c in range(33, 127)], "the", "tion", "er", "in", "▁the", "▁of", "on", "an", "es", "en", "ou", "que"]
    return {p: (i, -8.0 + len(p)) for i, p in enumerate(pieces)}
