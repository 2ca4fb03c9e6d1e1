"""License scans, quality rules, packing and the stages against brute force and on hard rows."""

import random
import re
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F
from test_njoin import within_bands

from seekframe.llm import lines, license, packing, quality, queries

SF = "/root/testdata/sf0.001"
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


def exact_notices(text):
    """{(license, start)} of the exact templates in a text, by comparing all of them at every word; of those that overlap the longest stays."""
    found, words = [], [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text or "")]
    for k, (name, body) in enumerate(license.TEMPLATES):
        if "{" in body:
            continue
        want = [w.lower() for w in _WORD.findall(body)]
        for i in range(len(words) - len(want) + 1):
            if [w for w, _, _ in words[i : i + len(want)]] == want:
                found.append((-len(want), k, words[i][1], words[i + len(want) - 1][2], name))
    out = []
    for f in sorted(found):
        if not any(f[2] < g[3] and g[2] < f[3] for g in out):
            out.append(f)
    return {(f[4], f[2]) for f in out}


def test_license_scan_equals_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = {(r["doc_id"], *f) for r in d.collect() for f in exact_notices(r["text"])}
    got = {(r["doc_id"], r["license"], r["start"]) for r in queries.op1_license_scan(spark, SF).filter("exact and license <> 'proprietary'").collect()}
    assert want and got == want


@pytest.mark.parametrize("seed", range(5))
def test_planted_notices_are_found_whatever_surrounds_them(seed):
    r, scanner = random.Random(seed), license.Scanner()
    plain = [t for t in license.TEMPLATES if "{" not in t[1]]
    prose = lambda n: " ".join(r.choice("some plain words that say nothing about terms of use".split()) for _ in range(n))
    text = ""
    for _, body in r.sample(plain, 6):
        text += prose(r.randrange(60)) + r.choice([". ", "\n", "\n\n"]) + body + r.choice([" ", "\n"]) + prose(r.randrange(3, 60)) + "\n" * r.randrange(5)
    assert {(f[0], f[2]) for f in scanner.scan(text) if f[1]} == exact_notices(text)


def test_changed_wording_is_never_exact():
    r, scanner = random.Random(3), license.Scanner()
    for name, body in license.TEMPLATES:
        w = body.split()
        if len(w) < 12 or "{" in body:
            continue
        i = r.randrange(2, len(w) - 2)
        changed = " ".join([*w[:i], "otherwise", *w[i + 1 :]])
        assert not any(f[1] and f[0] == name and len(f[6]) + len(f[7]) == 0 and f[3] - f[2] > 0.9 * len(body) for f in scanner.scan(changed)), name
    spdx = scanner.scan("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;\n# SPDX-License-Identifier: EUPL-1.2\n")
    assert [(f[0], f[1]) for f in spdx] == [("(MIT OR Apache-2.0)", True), ("EUPL-1.2", True)]
    assert scanner.scan("Released under the MIT License. " * 2)[1][2] == len("Released under the MIT License. ")


def test_quality_rules_equal_an_own_computation(spark):
    got = {r["doc_id"]: r["keep"] for r in queries.op3_quality_rules(spark, SF).collect()}
    assert got == {r["doc_id"]: within_bands(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_a_ratio_at_a_limit_is_within():
    import zstandard

    text = "the same words again and again, the same words again and again, and so on"
    ratio = len(text) / len(zstandard.compress(text.encode(), 3))
    measured = lambda low, high: quality.measure(text, bands=((0, low, high),))[5:]
    assert measured(ratio, ratio) == (True, None)
    assert measured(0, ratio - 1e-9) == (False, "repetitive") and measured(ratio + 1e-9, 99) == (False, "incompressible")


def optimum(lengths, capacity):
    """The least number of sequences, by trying all."""

    @lru_cache(None)
    def fits(left, rooms):
        if not left:
            return True
        return any(fits(left[1:], tuple(sorted(rooms[:i] + (room - left[0],) + rooms[i + 1 :]))) for i, room in enumerate(rooms) if room >= left[0] and room not in rooms[:i])

    n = -(-sum(lengths) // capacity)
    while not fits(tuple(sorted(lengths, reverse=True)), (capacity,) * n):
        n += 1
    return n


@pytest.mark.parametrize("seed", range(12))
def test_large_pieces_are_packed_nearly_as_well_as_can_be(seed):
    r = random.Random(seed)
    lengths = [r.randrange(14, 101) for _ in range(r.randrange(4, 13))]
    each, rows, n = packing.plan(Counter(lengths), 100, 1 / 8, 24)
    where, ranked = Counter(), sorted(lengths, reverse=True)
    for rank, size in enumerate(ranked):
        (row,) = [x for x in rows if x[0] == rank // each and x[1] <= rank % each < x[2]]
        where[row[3] + (rank % each - row[1]) // row[4]] += size
    assert max(where.values()) <= 100 and len(where) <= optimum(tuple(lengths), 100) + 1 and max(where) < n


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_trying_every_room(seed):
    r = random.Random(seed)
    import numpy as np

    room, lengths = [r.randrange(0, 30) for _ in range(20)], sorted((r.randrange(1, 12) for _ in range(40)), reverse=True)
    where, opened = packing.best_fit(np.array(room), np.array(lengths), 30)
    left = room[:]
    rooms = Counter()
    for size in lengths:
        best = min((x for x in left if x >= size), default=None)
        if best is None:
            left.append(30)
            best = 30
        left[left.index(best)] -= size
    for i, size in zip(where, lengths):
        rooms[int(i)] += size
    free = sorted(x - rooms[i] for i, x in enumerate(room + [30] * opened))
    assert min(free) >= 0 and free == sorted(left)


def test_stages_on_hard_rows(spark):
    import corpus_pipeline as p

    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randrange(2, 9))) for _ in range(n))
    one, long, secret = prose(60), prose(20_000), prose(40) + " token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, one), (2, one), (2, one), (None, one), (3, None), (4, ""), (5, " \n "), (6, long), (7, secret), (8, prose(50)), (9, "x"), (None, None)]
    names = ["row", "id", "new", "n", "gid", "rid", "piece", "length", "start", "seq", "home", "kind", "lead", "m", "shard"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"), *[F.lit(k).alias(c) for k, c in enumerate(names)])
    out = {}
    for name, stage in p.STAGES:
        got = stage(spark, docs, SF)
        out[name] = got.toPandas()
        assert name == "packing" or got.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    ids = lambda name: sorted(out[name]["doc_id"].fillna(-1).astype(int))
    assert ids("quality") == [-1, 1, 2, 2, 6, 7, 8, 9]
    assert ids("exact") == [-1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert ids("near") == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert ids("secrets") == sorted(-1 if i is None else i for i, _ in rows)
    masked = out["secrets"][out["secrets"]["doc_id"] == 7].iloc[0]
    assert masked["text"].endswith("token = [SECRET]") and masked["n_chars"] == len(masked["text"]) and masked["m"] == names.index("m")
    assert sorted(set(ids("packing"))) == [-1, 1, 2, 6, 7, 8, 9] and out["packing"].groupby("seq")["length"].sum().max() <= packing.CAPACITY


def test_line_query_equals_a_rebuild_without_the_deleted(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bad = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").select("doc_id")
    want = lines.line_duplicates(d.join(bad, "doc_id", "left_anti"))
    get = lambda df: sorted(map(tuple, df.collect()))
    got = get(queries.op7_line_dedup(spark, SF))
    assert got and got == get(want)
