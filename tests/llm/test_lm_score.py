import math
import zlib
from collections import Counter

import pytest

from graphloom.llm import lm_score


def brute(rows):
    cut = lambda t: (t or "").encode().lower().split() + [None]
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in cut(t))
    n, v = sum(train.values()), len(train)
    return {i: (len(cut(t)), sum(train[w] > 0 for w in cut(t)), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in cut(t))) for i, t in rows}


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_counts_and_base_score_match_brute_force(spark, block_bytes):
    texts = ["the cat sat", "The CAT  ran\tfar", None, "", "a b a b a b " * 30, "é ü é", "the cat sat", "x" * 5000]
    rows = [(i, texts[i % len(texts)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fold", "2 AS block", "3 AS part")
    got = lm_score.score(docs, block_bytes).collect()
    expected = brute(rows)
    assert len(got) == 60
    for r in got:
        n, known, total, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.score <= 0
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_empty_table(spark):
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
