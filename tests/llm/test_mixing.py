from fractions import Fraction

import pytest

from graphloom.llm import mixing


def brute_targets(sizes):
    """Shares by weight, excess beyond twice the size shared again among the rest, until none is above."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, left, open_ = {}, Fraction(3, 2) * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / total > 2 * sizes[n]}
        if not over:
            return target | {n: left * weight[n] / total for n in open_}
        for n in over:
            target[n] = Fraction(2 * sizes[n])
            left -= target[n]
        open_ -= over
    return target


def corpus(n=1500):
    sources = ["b", "a", "é", "hot", None, "tiny"]
    rows = []
    for i in range(n):
        s = "hot" if i % 3 == 0 else sources[i % len(sources)]
        if s == "tiny" and i > 200:
            s = "a"
        rows.append((i, None if i % 97 == 0 else "w " * (i % 40), s))
    return rows + [(5, "one\ttwo three four", "a"), (5, "one\ttwo three four", "a"), (None, "x y", None), (7000, "z " * 20000, "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS h", "3 AS run", "4 AS target")


def test_targets_and_bounds(docs):
    sizes = {}
    for _, t, s in corpus():
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    got = mixing.taken(docs).collect()
    assert len(got) == len(corpus())
    expected = brute_targets(sizes)
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_size.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sum(t for _, t in by_size) == pytest.approx(1.5 * sum(sizes.values()))
    assert [x for pair in sorted(by_size) for x in pair] == pytest.approx([x for pair in sorted((s, float(expected[n])) for n, s in sizes.items()) for x in pair])
    for (_, target), taken in by_size.items():
        assert abs(sum(taken) - target) <= 3 * mixing.BLOCK_WORDS
    assert got == mixing.taken(docs).collect() or sorted(map(str, got)) == sorted(map(str, mixing.taken(docs).collect()))


def test_the_mix_holds_what_is_taken(docs):
    total = {}
    for r in mixing.taken(docs).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.taken
    pieces = mixing.mix(docs).collect()
    from_mix = {}
    for r in pieces:
        from_mix[r.doc_id] = from_mix.get(r.doc_id, 0) + r.words
    assert from_mix == {k: v for k, v in total.items() if v}
    assert len({(r.slot, r.source) for r in pieces}) == len({r.slot for r in pieces})
    by_block = {}
    for r in pieces:
        by_block[r.slot] = by_block.get(r.slot, 0) + r.words
    assert max(by_block.values()) == mixing.BLOCK_WORDS
    assert sum(v == mixing.BLOCK_WORDS for v in by_block.values()) >= len(by_block) - 6


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(v for k, v in counts.items() if k != 5) == 2 and counts[5] <= 6


def test_empty_and_native(docs):
    assert mixing.taken(docs.limit(0)).count() == 0
    assert mixing.taken(docs.filter("text IS NULL")).filter("taken = 0 AND target = 0").count() == docs.filter("text IS NULL").count()
    assert "Python" not in mixing.taken(docs)._jdf.queryExecution().toString()


def test_plan_holds_the_schedule_and_its_join(docs):
    plan = mixing.taken(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, ((number" in plan and "row_number" in plan and "Range (0" in plan


def test_points_are_exact_far_out(spark):
    """A slot beyond 2 ** 40 has the point that integer arithmetic gives."""
    plan = spark.createDataFrame([(1, 0.0, 1.0)], "number int, low double, high double")
    assert {r.block for r in mixing.slots(plan, 1).collect()} == {0}
    assert ((1 << 40) * mixing.GOLDEN + mixing.HALF) % mixing.WHOLE == spark.range(1 << 40, (1 << 40) + 1).selectExpr(
        f"pmod(cast(id as decimal(18,0)) * cast({mixing.GOLDEN} as decimal(20,0)) + cast({mixing.HALF} as decimal(20,0)), cast({mixing.WHOLE} as decimal(20,0))) AS x").first().x
