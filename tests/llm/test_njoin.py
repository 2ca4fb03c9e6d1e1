"""The n-gram join and its near stage against brute force, and the pipeline against an implementation of its own."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seekframe.llm import njoin
from seekframe.llm.common import components, stable

SF = "/root/testdata/sf0.001"


def words(r, n, size=400):
    return " ".join(f"w{r.randrange(size)}x" for _ in range(n))


def grams(text, n=5):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.3):
    """({id: (class, links)}, {id: {linked id: similarity}})"""
    sets = {i: grams(t) for i, t in rows if i is not None and grams(t)}
    links = {i: {} for i in sets}
    for a in sets:
        for b in sets:
            if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold - 1e-9:
                links[a][b] = links[b][a] = j
    least = {i: i for i in sets}
    while True:
        new = {i: min([least[i], *(least[j] for j in links[i])]) for i in sets}
        if new == least:
            return {i: (least[i], len(links[i])) for i in sets if links[i]}, links
        least = new


def classes(df, **how):
    return {r["doc_id"]: (r["class_id"], r["links"]) for r in njoin.ngram_classes(df, **how).collect()}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    long, base, shared = words(r, 30000, 5000), words(r, 120), words(r, 70, 10**6)
    near = " ".join(w if r.random() > 0.03 else "changed" for w in base.split())
    out = [(1, base), (2, near), (3, base), (4, words(r, 30) + " " + shared), (5, shared + " " + words(r, 60)), (6, None), (7, ""), (8, "  \n"), (9, long), (10, long), (10, long), (None, base), (11, base + " "), (12, base.upper())]
    return out + [(100 + i, words(r, r.randrange(1, 80), 30)) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(["row", "id", "lead", "home", "size", "kind", "h1", "k1", "gram"])])


def test_classes(docs, rows):
    got = classes(docs)
    assert got == brute(rows)[0] and got[2] == (1, 4) and got[10] == (9, 1)
    assert classes(docs.limit(0)) == {}
    assert classes(docs, n=3, threshold=0.1)  # all settings run


def test_classes_of_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert classes(d) == brute([(r["doc_id"], r["text"]) for r in d.collect()])[0]


def test_small_buckets_homes_and_unsteady_input(spark, docs, rows, monkeypatch):
    for name, value in (("BUCKET_BYTES", 3000), ("BUCKET_GRAMS", 500), ("BIN_POSTINGS", 300), ("SHARD_POSTINGS", 500), ("SLICE_CHARS", 2000)):
        monkeypatch.setattr(njoin, name, value)
    mixed = docs.repartition(3, "text")
    assert stable(docs) and not stable(mixed)
    want, links = brute(rows)
    assert classes(mixed) == want
    check_kept(rows, links, {r["id"] for r in njoin.near_copies(docs).df.collect()})


def check_kept(rows, links, gone):
    """Every dropped document has a smaller near copy that stays, and no two that stay are sure near copies."""
    stay = {i for i, _ in rows if i is not None} - gone
    assert all(any(j < i and j in stay for j in links[i]) for i in gone)
    assert not [(i, j) for i in stay for j, s in links.get(i, {}).items() if j < i and j in stay and s >= njoin.STRONG]


def test_near_copies_of_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    kept = njoin.near_dedup(d)
    assert kept.columns == d.columns
    check_kept(rows, brute(rows)[1], {i for i, _ in rows} - {r["doc_id"] for r in kept.collect()})


def test_near_dedup(docs):
    kept = njoin.near_dedup(docs)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and 1 in ids and not {2, 3, 10, 11, 12} & set(ids) and ids[None] == 1 and ids[6] == ids[9] == 1
    assert njoin.near_dedup(docs.limit(0)).count() == 0


def test_near_stage_keeps_documents_that_share_only_lines(spark):
    r = random.Random(8)
    line, base = words(r, 13, 10**6), words(r, 60, 10**6).split()
    other = lambda k: words(r, k, 10**6)
    # 1 and 2 share a line with 3 only; 11 to 13 are a chain of which only neighbours are near copies
    rows = [(1, other(5) + "\n" + line + "\n" + other(6)), (2, line + "\n" + other(11)), (3, line + "\n" + other(5))]
    rows += [(11, " ".join(base[:48])), (12, " ".join(base[6:54])), (13, " ".join(base[12:60] + other(14).split())), (14, " ".join(base[:24] + ["changed"] + base[25:36] + ["changed"] + base[37:48]))]
    _, links = brute(rows)
    assert min(links[1][3], links[2][3]) >= njoin.THRESHOLD and min(links[11][12], links[12][13]) >= njoin.STRONG and links[11].get(13, 0) < njoin.STRONG
    kept = {x["doc_id"] for x in njoin.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {1, 2, 3, 11} <= kept and not {12, 14} & kept


def test_settling(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 5), (4, 6), (1, 7), (7, 8)], "a bigint, b bigint")
    assert {r["id"] for r in njoin.settle(edges).df.collect()} == {2, 4, 7}
    assert njoin.settle(edges.limit(0)).df.count() == 0


def test_a_resident_whose_copies_at_home_are_dropped_elsewhere(spark):
    # 2 drops 3 at home; elsewhere 1 drops 2, so 3 stays, and its own copy 4 must still go
    grams = lambda *parts: b"".join(int(g).to_bytes(8, "little") for p in parts for g in p)
    none = (b"\xff\xff\xff\xff" * 10, b"", b"")
    rows = [(0, 0, 2, 10, 1, grams(range(10)), *none), (0, 0, 3, 10, 1, grams(range(3, 13)), *none), (0, 0, 4, 10, 1, grams(range(6, 16)), *none)]
    schema = "home bigint, kind int, id bigint, size bigint, weight bigint, ranked binary, places binary, lines binary, counts binary"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    first = {tuple(r) for r in df.mapInArrow(njoin._search_near(0.3, False), njoin._EDGE).collect()}
    assert first == {(2, 3), (3, None)}
    again = [r[:1] + (i > 1,) + r[2:] for i, r in enumerate(rows)][1:]
    again = [(a, int(b), *c) for a, b, *c in again]
    more = {tuple(r) for r in spark.createDataFrame(again, schema).coalesce(1).mapInArrow(njoin._search_near(0.3, True), njoin._EDGE).collect()}
    assert more == {(3, 4)}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1050)] + [(7, 7)]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(60):
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    got = {x["id"]: x["label"] for x in components(spark.createDataFrame(edges, "u bigint, v bigint")).df.collect()}
    assert got == least


def test_divide_skip_equals_counting():
    r, index = random.Random(0), njoin.Lists()
    sets = [sorted(r.sample(range(200), r.randrange(1, 60))) for _ in range(80)]
    for q, s in enumerate(sets):
        want = {(i, len(set(sets[i]) & set(s))) for i in range(q) if len(set(sets[i]) & set(s)) >= 0.3 * len(set(sets[i]) | set(s)) - 1e-9}
        assert set(njoin.divide_skip(index, s, len(s), 0.3, q)) == want
        index.add(q, len(s), s)


@pytest.mark.parametrize("dense", [2, 5, 64])
def test_shard_equals_counting(monkeypatch, dense):
    monkeypatch.setattr(njoin, "DENSE", dense)
    r = random.Random(dense)
    sets = [r.sample(range(200), r.randrange(1, 60)) for _ in range(80)]
    sizes, ids = [len(s) + r.randrange(4) for s in sets], sorted(r.choices(range(200), k=80))
    shard = njoin.Shard(ids, sizes, [np.array(s, np.int64) for s in sets])
    for q in range(80):
        both = [len(set(s) & set(sets[q])) for s in sets]
        want = [i for i in range(80) if ids[i] < ids[q] and both[i] >= 0.3 * (sizes[i] + sizes[q] - both[i]) - 1e-9]
        assert sorted(shard.links(np.array(sets[q], np.int64), sizes[q], 0.3, ids[q])) == want
    assert not len(shard.links(np.array([500, 501]), 2, 0.3, 10**6))


def test_families_and_repeated_lines_are_not_merged_for_each_member(monkeypatch):
    """Near copies of one document, and short documents with a line in common: both grow with the table."""

    def search(m):
        r, sets, sizes = random.Random(m), [], []
        for i in range(m):
            holes = {g for at in r.sample(range(100), 4) for g in range(at, at + 5)}
            sets += [[g for g in range(100) if g not in holes], [*range(200, 209), 1000 + i // 2]]
            sizes += [100, r.randrange(12, 31)]
        kinds = [0] * m + [1] * m  # half of them live here
        rows = [(0, k, i, n, 1, np.array(s, "<i8").tobytes(), b"", b"", b"") for i, (k, n, s) in enumerate(zip(kinds, sizes, sets))]
        names = ["home", "kind", "id", "size", "weight", "ranked", "places", "lines", "counts"]
        merged, merge = [0], njoin.heap_merge

        def counted(lists, least=1):
            merged[0] += sum(map(len, lists))
            return merge(lists, least)

        with monkeypatch.context() as patch:
            patch.setattr(njoin, "heap_merge", counted)
            batches = njoin._search_classes(0.3)([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)])
            found = [x for b in batches for x in zip(*b.to_pydict().values())]
        links = Counter()
        every = [frozenset(s) for s in sets]
        for b in range(2 * m):
            for a in range(min(b, m)):
                both = len(every[a] & every[b])
                if both >= 0.3 * (sizes[a] + sizes[b] - both) - 1e-9:
                    links[a] += 1
                    links[b] += 1
        got = Counter()
        for i, _, n in found:
            got[i] += n
        assert got == links and {other % 2 for i, other, _ in found if i % 2} == {1}
        return merged[0]

    assert search(600) <= 5 * search(150) + 1000


BANDS = [(0, 0.0, 2.0), (64, 0.7, 2.2), (128, 0.9, 2.6), (256, 1.1, 2.8), (512, 1.25, 3.0), (1024, 1.35, 3.2), (2048, 1.4, 3.5), (4096, 1.45, 4.0), (16384, 1.5, 4.5)]


def within_bands(text):
    import zstandard

    data = (text or "").encode()
    if not data.strip():
        return False
    # level 3, as a one-shot frame
    ratio = lambda x: len(x) / len(zstandard.compress(x, 3))
    band = lambda x: [b for b in BANDS if b[0] <= len(x)][-1][1:]
    side = lambda x: (ratio(x) > band(x)[1]) - (ratio(x) < band(x)[0])
    chunks = [side(data[i : i + 4096]) for i in range(0, len(data), 4096)] if len(data) > 4096 else [side(data)]
    return side(data) == 0 and chunks.count(1) <= 0.3 * len(chunks) and chunks.count(-1) <= 0.3 * len(chunks)


def near_brute(rows):
    """Ids that stay, by looking at every pair in the order of ids."""
    word = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    every = {}
    for i, text in rows:
        lines = [w for x in text.split("\n") if (w := word(x))]
        flat = [(w, k) for k, x in enumerate(lines) for w in x]
        n = min(5, len(flat))
        place = {}
        for j in range(len(flat) - n + 1 if n else 0):
            run = flat[j : j + n]
            place.setdefault(tuple(w for w, _ in run), tuple(lines[run[0][1]]) if run[0][1] == run[-1][1] else None)
        every[i] = place, {tuple(x) for x in lines}

    def copies(a, b):
        (at_a, lines_a), (at_b, lines_b) = every[a], every[b]
        both = len(at_a.keys() & at_b.keys())
        j = both / max(1, len(at_a.keys() | at_b.keys()))
        if j >= 0.5 - 1e-9 or j < 0.3 - 1e-9:
            return j >= 0.5 - 1e-9
        common = lines_a & lines_b
        left = [{g for g, x in at.items() if x not in common} for at in (at_a, at_b)]
        return not left[0] | left[1] or len(left[0] & left[1]) >= 0.2 * len(left[0] | left[1]) - 1e-9

    stay = []
    for i in sorted(every):
        if not every[i][0] or not any(copies(j, i) for j in stay):
            stay.append(i)
    return stay


def test_near_copies_equal_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = sorted(r["doc_id"] for r in njoin.near_dedup(d).collect())
    assert kept == near_brute([(r["doc_id"], r["text"]) for r in d.collect()])


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "exact", "near", "secrets", "packing"]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    first = {}
    for r in sorted(d.collect(), key=lambda r: r["doc_id"]):
        if within_bands(r["text"]):
            first.setdefault(r["text"], r["doc_id"])
    texts = {i: t for t, i in first.items()}
    # a secret's span has no white space in these tables, so masking changes no count of words
    want = {i: len(texts[i].split()) for i in near_brute(texts.items())}
    got = p.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == want
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, d, SF).columns == d.columns, name
