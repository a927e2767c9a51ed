import random

from graphloom.llm import near_dedup


def brute(rows, width, percent):
    sets = [(i, near_dedup.shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, len(x), find(i)) for i, x in sets}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, base = [], [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(40)]
    for i in range(400):
        ws = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        rows.append((i * 3, " ".join(ws)))
    return rows + [(5, None), (7, ""), (8, " \t"), (10, "One"), (11, "one"), (13, "É one two"), (14, "y " * 4000)]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L AS id", "'x' AS key", "2 AS root")
    for width in (2, 5):
        got = near_dedup.near_duplicates(docs, width, 80).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, width, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_kept_leaves_one_of_each_group(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS kept")
    expected = sorted({c for _, _, c in brute(rows, 5, 80)})
    out = near_dedup.kept(docs, 5, 80)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == expected


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c d e f"), (4, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(docs, 2).collect())
    assert got == [(-1, 0, -1, True), (-1, 2, 4, False), (-1, 5, -1, True), (4, 2, 4, True)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_pigeonhole_guarantee():
    import numpy as np

    rng = np.random.default_rng(1)
    chunk = near_dedup.PER_CHUNK
    for _ in range(300):
        wrong = rng.choice(near_dedup.SYMBOLS, 2 * near_dedup.CHUNKS - 1, replace=False)
        assert min(np.bincount(wrong // chunk, minlength=near_dedup.CHUNKS)) <= 1
