"""Literal cases of the operators' rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekframe.functions import text as T
from seekframe.functions import vector as V
from seekframe.operators import chunk, dense, encode, fuse, graph, subword
from seekframe.operators.topk import threshold, top_k


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("getHTTPResponse", "gethttpresponse get http response"), ("sha256sum", "sha256sum sha 256 sum"), ("XML_Parser", "xml_parser xml parser"), ("__init__", "__init__"), ("_42_is", "_42_is 42 is"), ("123abc", "abc"), ("naïve", "na ve"), ("PQRSTuv", "pqrstuv pqrs tuv"), (" .. ", "")],
)
def test_code_tokens(spark, text, want):
    assert " ".join(one(spark, T.tokenize_code(F.lit(text)))) == want


def test_plain_tokens(spark):
    assert one(spark, T.tokenize_plain(F.lit("GPT-4 and Café-BM25."))) == ["gpt", "4", "and", "café", "bm25"]


def test_top_k_rules(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, float("nan")), (5, -1.0)], "doc_id bigint, score double")
    assert [r["doc_id"] for r in top_k(df, 2).orderBy("rank").collect()] == [2, 3]
    assert top_k(df, 0).count() == 0
    with pytest.raises(ValueError):
        top_k(df, -1)
    assert top_k(df, 0, nonpositive_k="all").count() == 4
    assert top_k(df, -1, positive=True, nonpositive_k="negative_all").count() == 3
    assert threshold(df, 9).first()["threshold"] == float("-inf") and threshold(df, 0).first()["threshold"] == float("inf")


def _ranked(spark, keys, scores=None):
    return spark.createDataFrame([(0, k, i + 1, float(scores[i]) if scores else 0.0) for i, k in enumerate(keys)], "query_id int, doc_id string, rank int, score double")


def test_fusion(spark):
    order = [r["doc_id"] for r in fuse.rrf([_ranked(spark, "123"), _ranked(spark, "214")]).orderBy("rank").collect()]
    assert order == ["1", "2", "3", "4"]
    got = {r["doc_id"]: r["score"] for r in fuse.rsf([_ranked(spark, "xyz", [0.9, 0.5, 0.1]), _ranked(spark, "yzw", [10, 6, 2])]).collect()}
    assert got == pytest.approx({"x": 1.0, "y": 1.5, "z": 0.5, "w": 0.0})
    with pytest.raises(ValueError):
        fuse.rrf([_ranked(spark, "1")], k=0)
    with pytest.raises(ValueError):
        fuse.rrf([_ranked(spark, "1")], weights=[1, 2])


def test_max_sim(spark):
    sim = lambda q, d: one(spark, V.max_sim(F.array(*[F.array(*map(F.lit, v)) for v in q]), F.array(*[F.array(*map(F.lit, v)) for v in d]) if d else F.array().cast("array<array<double>>")))
    assert sim([(1.0, 0.0), (0.5, 0.75**0.5)], [(1.0, 0.0), (0.0, 1.0)]) == pytest.approx(1 + 0.75**0.5)
    assert sim([(1.0, 0.0)], [(-1.0, 0.0)]) == -1.0
    assert sim([(1.0, 0.0)], []) == 0.0


def test_pair_truncation_follows_the_loop(spark):
    rows = [(n, m) for n in range(0, 14) for m in range(0, 14)]
    df = spark.createDataFrame(rows, "n int, m int").withColumn("p", T.pair_truncate(F.expr("array_repeat(1, n)"), F.expr("array_repeat(2, m)"), 12))
    for r in df.collect():
        n, m = r["n"], r["m"]
        while n + m > 9:
            n, m = (n - 1, m) if n > m else (n, m - 1)
        assert (len(r["p"]["query"]), len(r["p"]["doc"])) == (n, m)


def test_quantized_rows(spark):
    assert one(spark, V.quantize_i8(F.array(F.lit(0.0), F.lit(0.0))))["scale"] == 1.0
    q = one(spark, V.quantize_i8(F.array(F.lit(1.0), F.lit(-0.5))))
    assert q["codes"] == [127, -64]


def test_graph_is_exact_with_a_wide_beam():
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = graph.Graph(16).fill(np.arange(300), v)
    for q in v[:20]:
        assert [i for i, _ in g.query(q, 5, 300)] == np.argsort(-(v @ q), kind="stable")[:5].tolist()
    keep = np.arange(300) % 3 == 0
    assert all(i % 3 == 0 for i, _ in g.query(v[0], 10, 300, keep))
    assert g.query(v[0], 0) == [] and g.query(v[0][:5], 3) == []


def test_chunkers():
    source = "package a\n\n// doc\nfunc A() {\n\ts := \"}\"\n}\n\nfunc B() {\n}\n"
    parts = chunk.regex_chunks(source, "go", 30)
    assert "".join(t for _, _, t in parts) == source
    assert any(t.startswith("// doc\nfunc A") for _, _, t in parts)
    md = "---\na: 1\n---\n# One\ntext\n\n```\n# no heading\n```\nTwo\n===\nend\n"
    assert [t.split("\n")[0] for _, _, t in chunk.markdown_chunks(md)] == ["---", "# One", "Two"]
    assert chunk.line_kinds("    ```\n- x\n| a | b |\n\n")[:4] == ["text", "list", "table", "blank"]
    assert chunk.merge_spans([(0, 4), (4, 9), (9, 12), (12, 30)], 10) == [(0, 9), (9, 12), (12, 30)]
    with pytest.raises(ValueError):
        chunk.chunker("none")


def test_line_windows(spark):
    df = spark.createDataFrame([(1, "".join(f"{i}\n" for i in range(96))), (2, ""), (3, "x")], "doc_id int, text string")
    got = [(r["doc_id"], r["start_line"], r["end_line"]) for r in chunk.line_windows(df).orderBy("doc_id", "start_line").collect()]
    assert got == [(1, 1, 50), (1, 46, 95), (1, 91, 96), (3, 1, 1)]


def test_subwords():
    vocab = {"[UNK]": 0, "un": 1, "##aff": 2, "##able": 3}
    assert subword.wordpiece_word("unaffable", vocab, 0) == [1, 2, 3]
    assert subword.wordpiece_word("unx", vocab, 0) == [0] and subword.wordpiece_word("u" * 101, vocab, 0) == [0]
    assert subword.normalize("Café\x00中A") == "cafe 中 a"
    scores = {"<unk>": (0, -9.0), "▁": (1, -3.0), "▁ab": (2, -1.0), "a": (3, -2.0), "b": (4, -2.0)}
    assert subword.unigram_ids("ab ??", scores, 0, 3) == [2, 1, 0]


def test_encoder(spark):
    m = encode.Encoder.random()
    assert np.linalg.norm(m.encode([1, 2, 3])) == pytest.approx(1)
    with pytest.raises(ValueError):
        encode.Encoder.random(pooling="max")
    got = encode.encode(spark.createDataFrame([(1, [1, 2, 3]), (2, [4])], "doc_id bigint, ids array<int>"), m).collect()
    assert np.allclose({r["doc_id"]: r["embedding"] for r in got}[1], m.encode([1, 2, 3]))


def test_recall_of_nothing_is_one(spark):
    empty = spark.createDataFrame([], "query_id bigint, doc_id bigint")
    some = spark.createDataFrame([(1, 2)], "query_id bigint, doc_id bigint")
    assert dense.recall(some, empty).first()["recall"] == 1.0
