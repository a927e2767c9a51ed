import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import line_dedup

PATTERN = re.compile(line_dedup.PATTERN)


def shingles(line):
    norm = re.sub(r"[ \t\n\x0b\f\r]+", " ", "".join(c.lower() if c.isascii() else c for c in line)).strip(" ")
    return {m.group(1) for m in PATTERN.finditer(norm)}, norm


def brute(rows):
    at, found = [], []
    for i, t in rows:
        for pos, line in enumerate(t.split("\n") if t else []):
            s, norm = shingles(line)
            if norm:
                at.append((i, pos))
                found.append(s)
    root = list(range(len(at)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, x in enumerate(found):
        for j in range(k):
            both = len(x & found[j])
            if 100 * both >= 80 * (len(x) + len(found[j]) - both):
                root[max(find(k), find(j))] = min(find(k), find(j))
    gone = {}
    best = {}
    for k in sorted(range(len(at)), key=lambda k: at[k]):
        r = find(k)
        if r in best:
            gone.setdefault(at[k][0], []).append(at[k][1])
        best.setdefault(r, k)
    return gone


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 4, 7, 20]))) for _ in range(200)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12, 60]))] for _ in range(30)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(6)):
            ws = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            lines.append((" " * rng.choice([1, 2])).join(ws))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "日本語の長い行です" * 3), (204, "日本語の長い行です" * 3 + "別"), (205, "x" * 9000), (206, "É ü\n \tÉ  ü")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS row", "1 AS id", "2 AS pos")
    expected = brute(rows)
    got = line_dedup.dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.removed == expected.get(r.doc_id, []), r
        text = dict(rows)[r.doc_id]
        assert r.n_lines == (len(text.split("\n")) if text else 0) and r.n_kept == r.n_lines - len(r.removed)
    clean = line_dedup.deduplicated(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        text = dict(rows)[r.doc_id]
        lines = [x for pos, x in enumerate(text.split("\n")) if pos not in expected.get(r.doc_id, [])] if text else None
        assert r.text == (text if not text else "\n".join(lines))


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "same line here"), (1, "same line here"), (None, "same line here")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_kept) for r in line_dedup.dedup(docs).collect()) == [(0, 1), (1, 0), (1, 0)]
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_signatures_of_similar_lines_agree():
    """A value is the same with the probability of the similarity, and unlike lines share nothing, whatever stands beside them."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    base = [letters(300) for _ in range(200)]
    edited = [x[:150] + letters(28) + x[178:] for x in base]
    sims = []
    for x, y in zip(base, edited):
        u, v = ({z[i : i + 5] for i in range(len(z) - 4)} for z in (x, y))
        sims.append(len(u & v) / len(u | v))
    (s, k), (t, m) = line_dedup.signed(pa.array(base)), line_dedup.signed(pa.array(edited))
    same = 1 - 2 * sum((int(a) ^ int(b)).bit_count() if (int(a) ^ int(b)) >= 0 else 64 - (~(int(a) ^ int(b))).bit_count() for a, b in zip(s, t)) / (64 * len(s))
    assert abs(same - sum(sims) / len(sims)) < 0.03
    assert ((k == m).any(axis=1)).all() and not (k == np.roll(m, 1, axis=0)).any()
    alone = [line_dedup.signed(pa.array([x])) for x in base[:5]]
    assert all((alone[i][1][0] == k[i]).all() and alone[i][0][0] == s[i] for i in range(5))


def test_small_edits_match_a_brute_force_of_its_own(spark):
    """One letter or one word changed in lines of 8 to 25 words; the shingles are made here, not with PATTERN."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9)))
    rows = []
    for n in range(8, 26):
        for _ in range(3):
            ws = [word() for _ in range(n)]
            line, at = " ".join(ws), rng.randrange(n)
            letter = rng.randrange(len(line))
            rows += [line, line[:letter] + "z" + line[letter + 1 :], " ".join([*ws[:at], word(), *ws[at + 1 :]])]
    rows += ["𝒳𝒴𝒵 日本語の行" * 4, "𝒳𝒴𝒵 日本語の行" * 4 + "x", "abcd", "abce", "abcd"]
    sets = [{s[i : i + 5] for i in range(max(1, len(s) - 4))} for s in rows]
    root = list(range(len(rows)))
    for k, x in enumerate(sets):
        for j in range(k):
            if 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                root = [root[j] if r == root[k] else r for r in root]
    expected = {k for k in range(len(rows)) if root.index(root[k]) < k}
    assert len(expected) > 60
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup(docs).collect() if r.removed} == expected


def test_keys_meet_packed(spark):
    """Only the keys that several ids have become rows, all of them, however they are dealt; every line is signed once."""
    rng = random.Random(7)
    rows = [(i * 1_000_003, [rng.randrange(-(1 << 63), 1 << 63) for _ in range(line_dedup.BANDS)]) for i in range(3000)]
    for i in range(0, 3000, 7):  # near and far apart, at both ends of the keys
        rows[i][1][3] = rows[(i * 5 + 1) % 3000][1][4] = rng.choice([-1, -(1 << 63), (1 << 63) - 1, 0, i << 40])
    signs = spark.createDataFrame(rows, "id long, bands array<long>").repartition(5)
    owners = {}
    for i, keys in rows:
        for k in keys:
            owners.setdefault((k % (1 << 64)) >> 16, []).append(i)
    got = {}
    for r in line_dedup.shared(signs, len(rows)).df.collect():
        got.setdefault(r.key, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in owners.items() if len(v) > 1}


def test_full_texts_are_dropped_on_the_way(spark, monkeypatch):
    """Tables that hold every line's text or keys are dropped before links are followed; keys are never a row each."""
    from graphloom.llm.common import Saved

    dropped, kept = [], []
    real_drop, real_linked = Saved.drop, line_dedup.linked
    monkeypatch.setattr(Saved, "drop", lambda self: (dropped.append(self.path.rsplit("/", 1)[1].rsplit("-", 1)[0]), real_drop(self))[1])

    def linked(keys, features, near, verify):
        kept.append(isinstance(keys, Saved))
        features(keys.df.select("id").distinct())
        assert {"lines", "line-kinds", "line-signatures"} <= set(dropped)
        return keys.df.selectExpr("id AS v", "id AS root").limit(0)

    monkeypatch.setattr(line_dedup, "linked", linked)
    docs = spark.createDataFrame([(1, "one line that stands here\nother"), (2, "one line that stands here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_kept) for r in line_dedup.dedup(docs).collect()) == [(1, 2), (2, 0)]
    assert kept == [True] and real_linked


def test_pairs_are_verified_in_turns(spark, monkeypatch):
    """However many pairs there are, the texts of PAIRS of them are shuffled at once, about; no link is lost."""
    texts = [(i, f"{'abcdefghij'[i // 4] * 9} is the name of this line, which has {'x' * (i % 4 + 1)} at its end") for i in range(40)]
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 40)], "a long, b long")
    alike = {(a, b) for a in range(40) for b in range(a + 1, 40) if 100 * len(set.intersection(*(shingles(texts[i][1])[0] for i in (a, b)))) >= 80 * len(set.union(*(shingles(texts[i][1])[0] for i in (a, b))))}
    made, real = [], line_dedup.save
    monkeypatch.setattr(line_dedup, "save", lambda df, name: made.append(name) or real(df, name))
    monkeypatch.setattr(line_dedup, "PAIRS", 200)
    found = line_dedup.in_turns(pairs, spark.createDataFrame(texts, "id long, norm string")).collect()
    assert sorted(map(tuple, found)) == sorted(alike) and 0 < len(alike) < 780
    assert made == ["line-links"] * (780 // 200 + 1)


def test_sketches_sort_out_unlike_long_lines(spark, monkeypatch):
    """Of long lines, no pair that shares nothing is left to be verified, and every pair that is alike is."""
    rng = random.Random(13)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    base = [letters(300) for _ in range(200)]
    edited = [x[:150] + letters(20) + x[170:] for x in base]
    left = []

    def linked(keys, features, near, verify):
        found = features(spark.range(400).select("id")).withColumnRenamed("f", "f_a")
        other = found.selectExpr("id AS b", "f_a AS f_b")
        left.extend((r.id, r.b) for r in found.join(other, found.id < other.b).filter(near(F.col("f_a"), F.col("f_b"))).collect())
        return spark.createDataFrame([], "v long, root long")

    monkeypatch.setattr(line_dedup, "linked", linked)
    monkeypatch.setattr(F, "monotonically_increasing_id", lambda: F.expr("CAST(at.doc_id AS long)"))
    monkeypatch.setattr(line_dedup, "listed", lambda docs: line_dedup.save(docs.selectExpr("doc_id AS row", "doc_id", "0 AS pos", "text AS norm", "doc_id AS h1", "doc_id AS h2"), "lines"))
    line_dedup.dedup(spark.createDataFrame(list(enumerate(base + edited)), "doc_id long, text string"))
    assert sorted(left) == [(i, i + 200) for i in range(200)]


def test_groups_are_rows_not_pairs(spark):
    """A group whose lines share a key and have no link costs rows, not pairs; a pair is verified if its sketches are near."""
    from graphloom.llm import linking
    from graphloom.llm.common import save

    rows = [(7, i, 0) for i in range(300)] + [(8, i, 400) for i in (400, 401)] + [(9, i, 500) for i in (500, 501)]
    asked = []

    class Verify:
        def __call__(self, pairs):
            asked.append(sorted(map(tuple, pairs.collect())))
            return pairs

        def within(self, cells, parts):
            asked.append(cells.count())
            return cells.selectExpr("id AS a", "id AS b").limit(0)

    keys = save(spark.createDataFrame(rows, "key long, id long, lead long"), "test-keys")
    features = lambda ids: ids.selectExpr("id", "id DIV 100 AS f")
    roots = linking.linked(keys, features, lambda a, b: (a == b) & (a == 5), Verify())
    assert asked == [[(500, 501)], 300] and [tuple(r) for r in roots.collect()] == [(501, 500)]


def test_large_groups_are_cut_into_cells(spark, monkeypatch):
    """With cells and parts of any size, near copies of a line have the components that a brute force finds."""
    from graphloom.llm import linking

    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows = []
    for _ in range(4):
        base = [word() for _ in range(20)]
        for _ in range(70):
            ws = list(base)
            for at in rng.sample(range(20), rng.choice([0, 1, 2, 3, 4, 5])):
                ws[at] = word()
            rows.append((len(rows), " ".join(ws)))
    expected = {i for i, places in brute(rows).items() if places}
    assert 40 < len(expected) < 270
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for cell, small, size in ((2048, 1, 2000), (16, 4, 500)):
        monkeypatch.setattr(linking, "CELL", cell)
        monkeypatch.setattr(line_dedup, "SMALL", small)
        monkeypatch.setattr(line_dedup, "CELL_BYTES", size)
        assert {r.doc_id for r in line_dedup.dedup(docs).collect() if r.removed} == expected, (cell, small, size)


def test_unlike_lines_of_one_language_share_few_keys():
    """Few pairs of lines of the same words share a key (19,305 did with bands of four values)."""
    rng = random.Random(19)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(3000)]
    keys = line_dedup.signed(pa.array(texts))[1].ravel()
    _, n = np.unique(keys, return_counts=True)
    assert (n * (n - 1) // 2).sum() < len(texts) // 5
