import math
from collections import Counter

import pytest

from graphloom.llm import search
from graphloom.llm.common import real_words


def brute(rows, every=20, k=10, n_terms=8):
    """Every score of every pair, with the same choice of query terms."""
    docs = [(i, Counter(real_words(t))) for i, t in rows if i is not None]
    n, df = len(docs), Counter(w for _, c in docs for w in c)
    average = sum(c.total() for _, c in docs) / max(n, 1)
    hash_of = search._Hashes()
    idf = {w: math.log(1 + (n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    found = {}
    for number, (i, own) in enumerate(docs):
        if i % every:
            continue
        chosen = sorted(own, key=lambda w: (-own[w] * idf[w], hash_of[w]))[:n_terms]
        scores = []
        for d, c in docs:
            s = sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / average)) for w in chosen if w in c)
            if s > 0:
                scores.append((-round(s, 9), d))
        found.setdefault(i, []).append(sorted(scores)[:k])
    return found


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in search.search(df, **more).collect():
        got.setdefault(r.query_id, {}).setdefault(r["rank"], []).append((-round(r.score, 9), r.doc_id))
    for i, expected in brute(rows).items():
        for hits in expected:
            assert len(hits) == len(got.get(i, {})), i
            for rank, (s, d) in enumerate(hits, 1):
                assert any(math.isclose(s, x, rel_tol=1e-7) for x, _ in got[i][rank]), (i, rank)
        if len({s for s, _ in hits}) == len(hits):
            assert {d for _, d in hits} == {d for own in got.get(i, {}).values() for _, d in own}


def test_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(400)], k=rng.randint(1, 80)))) for i in range(600)]
    rows += [(1000 + i, rows[20][1]) for i in range(40)]  # copies: ties go to the smaller id
    check(spark, rows)
    check(spark, rows, shard_bytes=6000, query_block=10)


def shard_of(texts, **more):
    import numpy as np

    terms, starts, docs, tfs, lengths = search.postings(texts)
    gaps = docs.copy()
    gaps[1:] -= docs[:-1]
    term_gaps = terms.copy()
    term_gaps[1:] -= terms[:-1]
    pack = search._pack
    row = {"ids": pack(np.arange(len(texts))), "lengths": pack(lengths), "terms": pack(term_gaps), "starts": pack(np.diff(starts).astype(np.uint32)), "docs": pack(gaps), "tfs": pack(tfs)}
    return search.Shard(row, lengths.mean(), **more), terms, starts


def test_long_lists_are_pruned_exactly():
    import numpy as np

    rng = np.random.default_rng(3)
    shard, terms, starts = shard_of([" ".join(rng.choice([f"t{i}" for i in range(12)], rng.integers(1, 30))) for _ in range(3000)])
    chosen, totals = [], []
    for q in range(30):
        found = [(q, int(t), float(w)) for t, w in zip(np.sort(rng.choice(len(terms), rng.integers(1, 6), replace=False)), rng.random(6) * 3 + 0.1)]
        total = np.zeros(3000)
        for _, t, w in found:
            np.add.at(total, shard.docs[starts[t] : starts[t + 1]], shard.impacts[starts[t] : starts[t + 1]] * w)
        chosen += found
        totals.append(total)
    q, lists, idfs = (np.array(x) for x in zip(*chosen))
    for floors in (np.zeros(30), np.array([sorted(t)[-5] for t in totals])):
        for cells in (4_000_000, 9_000):
            of, docs_found, scores = shard.search(q, lists, idfs, floors, 10, cells)
            for i, total in enumerate(totals):
                order = [d for d in sorted(range(3000), key=lambda d: (-total[d], d))[:10] if total[d] > 0 and total[d] >= floors[i]]
                assert docs_found[of == i].tolist() == order
                assert np.array_equal(scores[of == i], total[order])


def test_whole_queries_skip_windows_exactly():
    """Documents of one topic stand together; queries with many terms, frequent and rare, against sums over all postings."""
    import numpy as np

    rng = np.random.default_rng(4)
    n = 1003  # the last window is not full
    texts = [" ".join([f"t{d // 150}x{i}" for i in rng.integers(0, 40, 60)] + [f"c{i}" for i in rng.integers(0, 25, 20)] + [f"r{i}" for i in rng.integers(0, 3000, 5)]) for d in range(n)]
    texts[700:720] = texts[20:40]  # ties
    shard, terms, starts = shard_of(texts, blocks=False)
    idf = np.log(1 + (n - np.diff(starts) + 0.5) / (np.diff(starts) + 0.5))
    chosen, totals = [], []
    for q, d in enumerate(range(0, n, 20)):
        lists = np.unique(np.repeat(np.arange(len(terms)), np.diff(starts))[shard.docs == d])
        total = np.zeros(n)
        for t in lists:
            np.add.at(total, shard.docs[starts[t] : starts[t + 1]], shard.impacts[starts[t] : starts[t + 1]] * idf[t])
        chosen += [(q, t, idf[t]) for t in lists]
        totals.append(np.round(total, 9))
    q, lists, idfs = (np.array(x) for x in zip(*chosen))
    for floors in (np.zeros(len(totals)), np.array([sorted(t)[-10] for t in totals])):
        for cells in (4_000_000, 9_000):
            shard.entered = shard.offered = 0
            of, found, scores = shard.search_whole(q, lists, idfs, floors, 10, cells)
            for i, total in enumerate(totals):
                order = sorted(range(n), key=lambda d: (-total[d], d))[:10]
                assert found[of == i].tolist() == order
                assert np.allclose(scores[of == i], total[order], rtol=0, atol=2e-9)
            assert shard.offered == len(totals) * -(-n // search.SPAN)
            assert (shard.entered < shard.offered // 2) == bool(floors.any())


def test_single_precision_decides_nothing():
    """Frequent lists are multiplied in single precision; scores that it can't tell apart are ordered by full precision."""
    import numpy as np

    shard, terms, starts = shard_of(["a b" if d % 3 else "a c" for d in range(200)], blocks=False)
    assert search.Shard.frequent(shard)[2].dtype == np.float32
    by_size = np.argsort(-np.diff(starts))  # a, b, c
    lists = np.sort(by_size)
    weight = dict(zip(by_size.tolist(), (100.0, 1e-6, 2e-6)))
    idfs = np.array([weight[x] for x in lists.tolist()])
    for floor in (0.0, 100 * shard.impacts[0] + 1.5e-6 * shard.impacts[0]):
        _, docs, scores = shard.search_whole(np.zeros(3, np.int64), lists, idfs, np.array([floor]), 10)
        assert docs.tolist() == list(range(0, 30, 3))
        assert np.allclose(scores, 100.000002 * shard.impacts[0], rtol=0, atol=2e-9)


def test_home_shards_are_searched_once(spark, monkeypatch):
    """Blocks of queries share one search of the shards that queries come from."""
    rows = [(i, f"w{i % 7} w{i % 11} w{i % 13} all") for i in range(400)]
    made, real = [], search.save
    monkeypatch.setattr(search, "save", lambda df, name: made.append(name) or real(df, name))
    check(spark, rows, query_block=5)
    assert made.count("search-floors") == 1 and made.count("search-found") > 1


@pytest.mark.parametrize("rows", [[], [(20, None), (40, ""), (None, "a b"), (60, "!?")], [(20, "one"), (20, "one"), (21, None)], [(0, "wort " * 30000 + "ende"), (3, "ende")]])
def test_edges(spark, rows):
    check(spark, rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(20, "a b", 1, 2.0, "x")], "doc_id long, text string, key int, score double, rank string")
    assert [tuple(r)[:3] for r in search.search(df).collect()] == [(20, 1, 20)]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 6000, "query_block": 10}])
def test_query_searches_whole_texts(spark, tmp_path, monkeypatch, sizes):
    """The registered query against BM25 over all distinct terms of the query rows."""
    import random

    from graphloom.llm import queries

    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(900)], k=rng.choice([3, 60, 200])))) for i in range(500)]
    rows += [(600 + i, rows[20][1]) for i in range(30)] + [(None, "w1 w2"), (700, None), (720, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    if sizes:
        real = search.search
        monkeypatch.setattr(search, "search", lambda docs, **more: real(docs, **more, **sizes))
    got = {}
    for r in queries.op6_topk_search(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    docs = [(i, Counter(real_words(t))) for i, t in rows if i is not None]
    n, df = len(docs), Counter(w for _, c in docs for w in c)
    average = sum(c.total() for _, c in docs) / n
    idf = {w: math.log(1 + (n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    asked = {i: own for i, own in docs if i % 20 == 0 and own}
    assert set(got) == set(asked)
    for i, own in asked.items():
        scores = ((d, sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / average)) for w in own if w in c)) for d, c in docs)
        best = sorted((-round(s, 7), d) for d, s in scores if s > 0)[:10]
        assert [got[i][rank][0] for rank in range(1, len(best) + 1)] == [d for _, d in best], i
        assert all(math.isclose(got[i][rank][1], -s, rel_tol=1e-6) for rank, (s, _) in enumerate(best, 1)), i
