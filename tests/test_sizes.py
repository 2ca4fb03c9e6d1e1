"""What odd inputs and larger tables have shown: each case failed, or took far more than its input, before."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seekframe.functions import text as T
from seekframe.operators import dense, encode, graph, lexical, subword
from seekframe.operators import evaluate as E
from seekframe.operators.topk import top_k
from seekframe.plans.catalog import ORACLE_SQL, QUERIES


def same_as_sql(spark, d, name, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    want = c.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    got = QUERIES[name](spark, d).toPandas()[columns]
    assert sorted(map(str, got.astype(str).values.tolist())) == sorted(map(str, want[columns].astype(str).values.tolist()))


def test_pages_of_one_address_stay_apart(spark, tmp_path):
    spark.createDataFrame([(1, "a/x", "<p>one\n"), (2, "a/x", "<p>two\n"), (3, "b", "")], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    same_as_sql(spark, str(tmp_path), "chunk_regex_joined", "pages")


def test_pairs_are_made_of_numbers_of_tokens(spark):
    """No text and no array of tokens crosses the join, and an exchange keeps the count of tokens out of its loop."""
    q = QUERIES["pair_truncate"](spark, "/root/testdata/sf0.001")
    plan = q._jdf.queryExecution().executedPlan().toString()
    joined = plan[: plan.index("regexp_extract_all")]
    assert "Join" in joined and "Exchange hashpartitioning(doc_id" in joined
    n, m = T.pair_lengths(F.lit(40), F.lit(5), 64)
    assert spark.range(1).select(n, m).first() == (40, 5)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_vectors(spark, n, dim=8, ids="bigint", seed=0):
    r = np.random.default_rng(seed).normal(size=(n, dim)).round(1).tolist()  # many ties
    rows = [(str(i) if ids == "string" else i, v) for i, v in enumerate(r)]
    return spark.createDataFrame(rows, f"doc_id {ids}, embedding array<double>").repartition(6)


@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_k_rows_leave_for_a_query_from_however_many_blocks(spark, ids):
    v, q = some_vectors(spark, 300, ids=ids), some_vectors(spark, 20, seed=1).toDF("query_id", "query")
    assert dense.flat(v, q, k=4).count() == 80
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect())
    assert rows(dense.flat_top_k(v, q, 4)) == rows(dense.flat_top_k(v, q, 4, scorer="sql"))
    assert rows(dense.flat_top_k(v, q, 0)) == rows(dense.flat_top_k(v, q, 0, scorer="sql"))


def test_vectors_without_id_or_number_stay_and_go(spark):
    v = spark.createDataFrame([(None, [1.0, 0.0]), (1, [float("nan"), 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (4, [1.0]), (5, None)], "doc_id bigint, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, query array<double>")
    assert [r["doc_id"] for r in dense.flat_top_k(v, q, 2).orderBy("rank").collect()] == [None, 2]
    assert [r["doc_id"] for r in dense.flat_top_k(v, q, 0).orderBy("rank").collect()] == [None, 2, 3]


@pytest.mark.parametrize("rerank", ["f32", "i8"])
def test_candidates_are_scored_where_the_vectors_pass(spark, rerank):
    """No candidate is joined with its vector; as many candidates as vectors give the exact order."""
    v, q = some_vectors(spark, 60), some_vectors(spark, 10, seed=1).toDF("query_id", "query")
    found = dense.binary_top_k(v, q, 5, 8, rerank=rerank)
    assert not re.search(r"Join[^\n]*\[doc_id", planned(found))
    exact = dense.flat_top_k(v, q, 5) if rerank == "f32" else dense.i8_top_k(dense.build_i8(v, 8), q, 5, 8)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(found) == rows(exact)


def test_gains_of_groups_need_no_pairs(spark):
    ranked = spark.createDataFrame([(0, 10, 1), (0, 11, 2), (0, 12, 3), (1, 11, 1)], "query_id bigint, doc_id bigint, rank int")
    q = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, None), (4, "c")], "query_id bigint, g string")
    docs = spark.createDataFrame([(10, "a"), (11, "b"), (12, "a"), (13, None)], "doc_id bigint, g string")
    pairs = q.join(docs, "g").select("query_id", "doc_id", F.lit(1).alias("rel"))
    rows = lambda df: sorted((r["query_id"], round(r["ndcg"], 9)) for r in df.collect())
    assert rows(E.ndcg_of_groups(ranked, q, docs, "g")) == rows(E.ndcg(ranked, pairs))


@pytest.mark.parametrize("name", ["softmax_rows", "flat_all_sorted"])
def test_all_pairs_are_neither_sorted_nor_shuffled(spark, name):
    assert not re.search("Window|Sort ", planned(QUERIES[name](spark, "/root/testdata/sf0.001")))


def test_queries_move_through_graphs_many_at_a_time(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(700, 8)).astype(np.float32)
    g, keep = graph.Graph(8).fill(np.arange(700), v), np.arange(700) % 7 == 0
    for kept, ef in ((None, 700), (keep, 700)):
        q, ids, _ = g.query_many(v[:300], 3, ef, kept)
        assert q.tolist() == np.repeat(np.arange(300), 3).tolist()
        want = np.where(np.ones(700, bool) if kept is None else kept, v[:300] @ v.T, -np.inf)
        assert (ids.reshape(300, 3) == np.argsort(-want, axis=1, kind="stable")[:, :3]).mean() > 0.99
    assert len(g.query_many(v[:5], 1, 1, keep)[0]) <= 5
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "doc_id bigint, embedding array<float>")
    found = graph.search(graph.build(df, shards=3), df.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query")), 2)
    assert "CoGroups" not in planned(found) and found.count() == 1400


def test_best_documents_of_blocks(spark, tmp_path):
    """k documents of each query leave a task, the same from a corpus, from a kept index and pruned; ties and texts without words too."""
    words = "ab cd ef gh ij kl".split()
    r = np.random.default_rng(0)
    rows = [(i, " ".join(r.choice(words, r.integers(0, 6)))) for i in range(600)] + [(600, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    q = spark.createDataFrame([(0, ["ab", "cd", "ab"]), (1, ["kl"]), (2, ["no"]), (3, [])], "query_id bigint, tokens array<string>")
    toks = lexical.tokens(docs, T.tokenize_plain)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in top_k(df, 7, ["query_id"], positive=True).collect())
    want = rows(lexical.bm25(toks, q))
    few = lexical.bm25(toks, q, k=7)
    assert rows(few) == want and few.count() <= 7 * 3 * few.rdd.getNumPartitions() and len(want) == 14
    index = lexical.Index.build(spark, toks, str(tmp_path / "i"))
    assert rows(index.bm25(q, k=7)) == rows(index.bm25_pruned(q, 7)) == want


def test_a_shortlist_picks_its_documents_where_they_are(spark):
    plan = planned(QUERIES["rerank_topk"](spark, "/root/testdata/sf0.001"))
    assert re.search(r"BroadcastHashJoin \[doc_id#\d+L?\], \[doc_id#\d+L?\], LeftSemi", plan)


def test_ids_of_texts_leave_before_there_are_many(spark):
    assert unigram_words("ab a\x00b  ab ▁a") == subword.unigram_ids("ab a\x00b  ab ▁a", subword.sample_scores(), 0, 5)
    cut = subword._kept(lambda w: [len(w)])
    for i in range(subword.WORDS + 10):
        cut(str(i))
    assert len(cut.__closure__[-1].cell_contents) <= subword.WORDS
    rows = [(i, "in the end " * 20000 if i % 3 else None) for i in range(12)]
    got = subword.wordpiece(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), subword.sample_vocabulary()).collect()
    assert sorted((r["doc_id"], r["ids"] and len(r["ids"])) for r in got) == [(i, 20000 * 4 if i % 3 else None) for i in range(12)]


def unigram_words(text):
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame([(1, text)], "doc_id bigint, text string")
    return subword.unigram(df, subword.sample_scores()).first()["ids"]


def test_static_vectors_meet_each_word_once(spark):
    ids = spark.createDataFrame([(1, [1, 1, 2]), (1, [2]), (2, [77]), (3, []), (4, None), (5, [3])], "doc_id bigint, ids array<int>")
    vocab = spark.createDataFrame([(1, [3.0, 0.0], 1.0), (2, [0.0, 4.0], 0.5), (2, [0.0, 2.0], 0.5), (3, [5.0], 2.0)], "id int, embedding array<double>, weight double")
    got = {r["doc_id"]: [round(x, 9) for x in r["embedding"]] for r in encode.static_vectors(ids, vocab, normalize=False).collect()}
    assert got == {1: [1.5, 1.5], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0], 5: [5.0, 0.0]}
    assert "Window" not in planned(encode.static_embed(ids, vocab))


@pytest.mark.parametrize("name", ["bm25_topk", "static_embed"])
def test_a_corpus_is_tokenized_once(spark, name):
    """The statistics read the exchange that the scores read."""
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    assert "ReusedExchange" in planned(df)
    final = planned(df).split("Initial Plan")[0]
    assert len(re.findall(r"regexp_extract_all\(lower\(text", final)) == 1
