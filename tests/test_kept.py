"""Kept indexes, pruning, block scores, languages of the chunkers, and windows over late rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekframe.functions import text as T
from seekframe.operators import block, chunk, dense, encode, evaluate, graph, lexical, sparse, store
from seekframe.operators.rows import spread
from seekframe.operators.topk import top_k
from seekframe.streaming import delta


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    words = [f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(40_000)]
    return spark.createDataFrame([(i, " ".join(words[20 * i : 20 * i + 20])) for i in range(2000)] + [(5000, ""), (5001, None)], "doc_id bigint, text string")


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "bm25")
    lexical.Index.build(spark, lexical.tokens(corpus, T.tokenize_plain), path)
    return lexical.Index.load(spark, path)


def test_index_gives_what_the_corpus_gives(spark, corpus, index):
    q = spark.createDataFrame([(0, ["w1", "w200"]), (1, ["none"]), (2, [f"w{i}" for i in range(1, 30)])], "query_id bigint, tokens array<string>")
    toks = lexical.tokens(corpus, T.tokenize_plain)
    get = lambda df: {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in df.collect()}
    assert get(index.bm25(q)) == get(lexical.bm25(toks, q))
    n, avgdl = index.corpus.first()
    assert n == 2002 and avgdl == pytest.approx(40_000 / 2002)


def test_pruning_scores_fewer_and_gives_the_same(spark, index):
    q = spark.createDataFrame([(0, ["w1", "w250"]), (1, ["w2", "w3", "w111", "w280"]), (2, ["w1"]), (3, [f"w{i}" for i in range(1, 12)])], "query_id bigint, tokens array<string>")
    best = lambda df: {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in top_k(df, 5, ["query_id"]).collect()}
    assert best(index.bm25_pruned(q, 5)) == best(index.bm25(q))
    count = lambda df: {r["query_id"]: r["count"] for r in df.groupBy("query_id").count().collect()}
    every, some = count(index.bm25(q)), count(index.candidates(q, 5))
    assert some[0] < every[0] / 3 and some[1] < every[1] and some[2] == every[2] and some[3] == every[3]
    assert best(index.bm25_pruned(q, 5, k1=-0.5)) == best(index.bm25(q, k1=-0.5))


def test_stores_refuse_what_they_do_not_know(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "x")
    store.save(spark, path, "some", {"a": df}, {"k": 1})
    parts, settings = store.load(spark, path, "some")
    assert parts["a"].count() == 3 and settings == {"k": "1"}
    with pytest.raises(ValueError):
        store.load(spark, path, "other")
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "none"), "some")
    spark.createDataFrame([("some", 99, "a", df.schema.simpleString(), {})], store.MANIFEST).write.mode("overwrite").parquet(path + "/manifest")
    with pytest.raises(ValueError, match="version"):
        store.load(spark, path, "some")
    store.save(spark, str(tmp_path / "y"), "some", {"a": df})
    spark.range(2).withColumn("z", F.lit(1)).write.mode("overwrite").parquet(str(tmp_path / "y" / "a"))
    with pytest.raises(ValueError, match="columns"):
        store.load(spark, str(tmp_path / "y"), "some")
    lexical.save_tokens(spark.createDataFrame([(1, ["a"])], "doc_id bigint, tokens array<string>"), str(tmp_path / "t"), "plain")
    assert lexical.load_tokens(spark, str(tmp_path / "t"), "plain").first()["tokens"] == ["a"]
    with pytest.raises(ValueError):
        lexical.load_tokens(spark, str(tmp_path / "t"), "code")


def test_kept_8_bit_index(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.5, -1.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 2.0, 3.0])], "doc_id bigint, embedding array<double>")
    dense.save_i8(dense.build_i8(v, 2), str(tmp_path / "i8"), 2)
    held, dim = dense.load_i8(spark, str(tmp_path / "i8"))
    rows = {r["doc_id"]: r for r in held.collect()}
    assert dim == 2 and rows[1]["codes"] == [64, -127] and rows[2]["codes"] == [0, 0] and rows[3]["codes"] == [127, 0] and rows[4]["codes"] == [64, 127]
    store.save(spark, str(tmp_path / "bad"), "flat-i8", {"rows": spark.createDataFrame([(1, [1], 1.0)], "doc_id bigint, codes array<int>, scale double")}, {"dim": 2})
    with pytest.raises(Exception, match="isn't 2 long"):
        dense.load_i8(spark, str(tmp_path / "bad"))[0].collect()


def test_scorers_agree(spark):
    r = np.random.default_rng(2)
    make = lambda n, dim, name, value: [(i, r.integers(-3, 4, dim).astype(float).tolist()) for i in range(n)]
    v = spark.createDataFrame(make(70, 6, 0, 0) + [(100, [1.0] * 5), (101, None), (102, [])], "doc_id bigint, embedding array<double>")
    q = spark.createDataFrame(make(9, 6, 0, 0) + [(50, [1.0] * 5)], "query_id bigint, query array<double>")
    get = lambda df: sorted(tuple(x) for x in df.select("query_id", "doc_id", F.round("score", 9), "rank").collect())
    for k in (3, 0, 200):
        assert get(dense.flat_top_k(v, q, k, scorer="block")) == get(dense.flat_top_k(v, q, k, scorer="sql"))
        assert get(dense.i8_top_k(dense.build_i8(v.filter("embedding is not null"), 6), q, k, 6)) == get(dense.i8_top_k(dense.build_i8(v.filter("embedding is not null"), 6), q, k, 6, scorer="sql"))
    named = v.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "embedding")
    assert [x[1:] for x in get(dense.flat_top_k(named.filter("doc_id <> 'd1'"), q, 3)) if x[0] == 1] == [x[1:] for x in get(dense.flat_top_k(named.filter("doc_id <> 'd1'"), q, 3, scorer="sql")) if x[0] == 1]
    with pytest.raises(ValueError):
        dense.flat(v, q, "none")
    assert dense.flat_top_k(v.limit(0), q, 3).count() == 0 == dense.flat_top_k(v, q.limit(0), 3).count()


def test_max_sim_blocks(spark):
    m = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[-1.0, 0.0]]), (3, []), (4, [[0.5, 0.5]])], "doc_id bigint, matrix array<array<double>>")
    q = spark.createDataFrame([(0, [[1.0, 0.0], [0.5, 0.75**0.5]]), (1, []), (2, [[1.0, 0.0]])], "query_id bigint, matrix array<array<double>>")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in dense.max_sim(m, q).collect()}
    assert len(got) == 12 and got[0, 1] == pytest.approx(1 + 0.75**0.5) and got[2, 2] == -1.0 and got[0, 3] == got[1, 1] == 0.0
    assert {(r["query_id"], r["doc_id"]) for r in dense.max_sim_top_k(m, q, 1).collect()} == {(0, 1), (1, 1), (2, 1)}


def test_block_ties_go_to_the_least_id():
    s = np.array([[1.0], [1.0 + 1e-13], [1.0], [0.5]])
    row, col = block._best(s, np.array([7, 9, 3, 1]), 2)
    assert row.tolist() == [2, 0] and col.tolist() == [0, 0]


def test_broken_graphs_are_refused(spark, tmp_path):
    r = np.random.default_rng(0)
    v = r.normal(size=(60, 8)).astype(np.float32)
    names = [f.split()[0] for f in graph.GRAPH.split(", ")][2:]
    for int8 in (False, True):
        g = graph.Graph(8, int8=int8).fill(np.arange(60), v)
        parts = dict(zip(names, g.dump()))
        again = graph.Graph.load(graph.VERSION, **parts)
        assert again.query(v[3], 5, 60) == g.query(v[3], 5, 60) and len(parts["rows"]) == 60 * 8 * (1 if int8 else 4)
        for name, value in (("ids", parts["ids"][:-8]), ("links", parts["links"][:-4]), ("rows", b""), ("start", 60), ("links", np.full(len(parts["links"]) // 4, 60, "<i4").tobytes()), ("counts", parts["counts"][:-3])):
            with pytest.raises(ValueError):
                graph.Graph.load(graph.VERSION, **(parts | {name: value}))
        with pytest.raises(ValueError, match="version"):
            graph.Graph.load(1, **parts)
    plain = graph.Graph(8, heuristic=False).fill(np.arange(60), v)
    assert [i for i, _ in plain.query(v[0], 5, 60)] == np.argsort(-(v @ v[0]), kind="stable")[:5].tolist()


def test_contracts(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    postings = spark.createDataFrame([(1, 5, 2.0)], "doc_id bigint, term bigint, weight double")
    q = spark.createDataFrame([(0, 5, 1.0), (0, 5, 1.0), (9, 7, 1.0)], "query_id bigint, term bigint, weight double")
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in sparse.scores_all(docs, postings, q).collect()} == {(0, 1): 4.0, (0, 2): 0.0, (0, 3): 0.0, (9, 1): 0.0, (9, 2): 0.0, (9, 3): 0.0}
    ids = spark.createDataFrame([(1, [1]), (2, [77]), (3, [])], "doc_id bigint, ids array<int>")
    vocab = spark.createDataFrame([(1, [3.0, 4.0], 1.0)], "id int, embedding array<double>, weight double")
    assert sorted(tuple(r) for r in encode.static_embed(ids, vocab).collect()) == [(1, 0, 0.6), (1, 1, 0.8), (2, 0, 0.0), (2, 1, 0.0), (3, 0, 0.0), (3, 1, 0.0)]
    assert spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert [spark.range(1).select(evaluate.human(F.lit(n))).first()[0] for n in (1_500_000, 10_000, 12, 0.5)] == ["1.5M", "10k", "12", "0.5"]
    lines = [r["line"] for r in evaluate.table(spark.createDataFrame([(2, "b"), (1, None)], "x int, y string"), ["x", "y"]).orderBy("place").collect()]
    assert lines == ["| x | y |", "| --- | --- |", "| 1 |  |", "| 2 | b |"]
    p50, p95, rate = evaluate.measure({"a": range(20)}, lambda q: None)["a"]
    assert 0 <= p50 <= p95 and rate > 0


SOURCES = {
    "typescript": ("import x from 'y';\n\n// about A\n@dec()\nexport class A<T> {\n  private n = 1;\n  constructor(n: number) {\n    if (n) { return; }\n  }\n\n  /** doc */\n  async go(a: string): Promise<void> {\n    const s = `}${a}{`;\n  }\n}\n\nexport const f = async (x) => {\n  return x;\n};\nexport default function g() {}\ntype U = { a: 1 };\nenum E { X }\n",
                   ["// about A", "  constructor(n", "  /** doc */", "export const f", "export default function g", "type U", "enum E"]),
    "java": ("package a;\n\n/** c */\n@Foo\npublic final class B {\n  static int x = 0;\n  public B(int y) throws E {\n    String s = \"}\";\n  }\n  @Override\n  public Map<String, int[]> m(int a) {\n    for (;;) { }\n  }\n}\n",
             ["/** c */", "  public B(int y)", "  @Override"]),
    "rust": ("use a;\n\n#[derive(Debug)]\npub struct S { a: u8 }\n\nimpl<T> S {\n    /// doc\n    pub(crate) async fn f(&self) -> u8 {\n        let s = r#\"}\"{\"#; match x { _ => 1 }\n    }\n}\nmacro_rules! m { () => {} }\npub const X: u8 = 1;\n",
             ["#[derive", "impl<T>", "    /// doc", "macro_rules!", "pub const X"]),
    "python": ("import os\n\n# c\n@dec\ndef f():\n    return 1\n\n\nclass A:\n    def g(self):\n        pass\n\n    async def h(self):\n        pass\n",
               ["# c", "class A"]),
    "go": ("package a\n\n// doc\nfunc A() {\n\ts := \"}\"\n\tq := `}\n}`\n}\n\nfunc B() {\n}\ntype T struct {\n}\n",
           ["// doc", "func B", "type T"]),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_languages(language):
    source, starts = SOURCES[language]
    for name in ("regex", "cast"):
        for size in (1, 30, 80, 10_000):
            parts, why = chunk.cut_file(name, source, language, size)
            assert why == "none" and "".join(x for _, _, x in parts) == source and parts[0][0] == 1
            assert all(a == b + 1 for (a, _, _), (_, b, _) in zip(parts[1:], parts))
    lines = chunk.split_lines(source)
    found = [lines[i] for i in sorted(chunk.definition_lines(lines, language))]
    assert len(found) == len(starts) and all(x.startswith(y) for x, y in zip(found, starts)), found


def test_syntax_chunks_hold_whole_definitions():
    source = "import os\n\n\ndef a():\n    return 1\n\n\nclass B:\n    x = 1\n\n    def c(self):\n        y = 2\n        return y\n\n    def d(self):\n        pass\n"
    assert [x.split("\n")[0] for _, _, x in chunk.cast_chunks(source, "python", 60)] == ["import os", "    def c(self):", "    def d(self):"]
    assert chunk.cut_file("cast", "def (:\n", "python") == ([(1, 1, "def (:\n")], "parse_error")
    assert chunk.cut_file("cast", "x\n", "cobol")[1] == "unsupported" and chunk.cast_chunks("", "go") == []


def test_fallbacks_are_counted_by_running(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.py", "def (:"), ("c.txt", "x"), ("d.go", None)], "file string, source string")
    assert {(r["fallback"], r["n"]) for r in chunk.fallback_stats(files, "cast").collect()} == {("none", 2), ("parse_error", 1), ("unsupported", 1)}


def test_windows_wait_for_late_rows_and_drop_what_comes_after(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    schema = "ts timestamp, kind string"
    batches = [[(at(1), "a"), (at(4), "a"), (at(12), "b")], [(at(3), "a"), (at(31), "a")], [(at(2), "a"), (at(33), "a"), (at(59), "b")], [(at(58), "b")]]
    source = tmp_path / "in"
    source.mkdir()
    stream = delta.windowed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), "ts", "10 seconds", "10 seconds", "kind")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
        part.rename(source / f"{i}.parquet")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    got = {(r["start"].second, r["kind"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # the row of second 3 is late but in time, that of second 2 comes after its window was given out
    assert {(0, "a", 3), (10, "b", 1)} <= got and not any(s == 50 for s, _, _ in got)
