"""Byte-level BPE against independent libraries, and tokenizer files."""

import json
import random

import pytest

from seekframe.operators import bytepair

HOME = "/opt/tokenizers"
TEXTS = ["", "   ", " a\n\n  b", "don't I'LL", "日本語 🎉🎉 naïve", "a" * 300, "Hello  world\t x", "<|endoftext|> and <|endoftext|>"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    return TEXTS + ["".join(r.choice("abcé日1 .\n'") for _ in range(80)) for _ in range(60)]


def test_ranks_equal_a_library(texts):
    import tiktoken

    ranks = bytepair.read_ranks(f"{HOME}/byte_bpe_50k.tiktoken")
    own, other = bytepair.BytePair(ranks), tiktoken.Encoding("own", pat_str=bytepair.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in texts:
        assert own.encode(t) == other.encode_ordinary(t) and own.decode(own.encode(t)) == t


def test_a_tokenizer_file_equals_a_library(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{HOME}/byte_bpe_50k.json"
    own, other = bytepair.Tokenizer(path), tokenizers.Tokenizer.from_file(path)
    for t in texts:
        assert own.encode(t) == other.encode(t, add_special_tokens=False).ids, t
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in bytepair.encode(df, lambda: bytepair.Tokenizer(path)).collect()}
    assert got[999] is None and all(got[i] == own.encode(t) for i, t in enumerate(texts))


def test_other_kinds(tmp_path):
    def file(spec):
        p = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        p.write_text(json.dumps(spec))
        return str(p)

    w = bytepair.Tokenizer(file({"model": {"type": "WordPiece", "unk_token": "[UNK]", "vocab": {"[UNK]": 0, "un": 1, "##aff": 2, "##able": 3, "!": 4}}, "normalizer": {"lowercase": True}, "added_tokens": [{"content": "[MASK]", "id": 9}, {"content": "[MASK]]", "id": 10}]}))
    assert w.encode("Unaffable! xyz[MASK]]un") == [1, 2, 3, 4, 0, 10, 1]
    u = bytepair.Tokenizer(file({"model": {"type": "Unigram", "unk_id": 0, "vocab": [["<unk>", -9.0], ["▁ab", -1.0], ["a", -2.0], ["▁", -3.0]]}}))
    assert u.encode("ab a") == [1, 3, 2] and u.encode("") == []
    with pytest.raises(ValueError):
        bytepair.Tokenizer(file({"model": {"type": "WordLevel", "vocab": {}}}))
    with pytest.raises(ValueError):
        bytepair.Tokenizer(file({"model": {"type": "BPE", "vocab": {}, "merges": []}}))
    assert len(set(bytepair.byte_letters().values())) == 256
