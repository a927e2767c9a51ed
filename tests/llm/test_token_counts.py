import random

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import token_counts as T

with open(T.RANKS, "rb") as f:
    RANKS = f.read()
count = T.counter(RANKS)
ALPHABET = "ab é'st 1\n\t .,-日 "


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=1500), st.lists(st.tuples(st.integers(0, 1600), st.integers(0, 40), st.text(ALPHABET, max_size=60)), max_size=6))
def test_counts_equal_a_full_encoding(text, edits):
    tree = T.Tree(T.cut(text, 24), count)
    assert tree.n_tokens == count(text)
    for start, length, new in edits:
        a = min(start, len(text))
        text = text[:a] + new + text[min(start + length, len(text)) :] if start <= len(text) else text + new
        tree.edit(start, start + length, new)
        assert tree.text == text
        assert tree.n_tokens == count(text)


def test_only_what_is_touched_is_encoded():
    text = "some words of a long text. " * 4000
    tree = T.Tree(T.cut(text), count)
    tree.edit(50_000, 50_004, "other")
    assert tree.encoded < 3000
    tree.edit(10, 10, "new words " * 5000)  # grows beyond its leaves
    assert tree.n_tokens == count(tree.text)


def test_rows(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "call +49 170 1234567 or mail a.b@c.org now", "x" * 50_000, "it's 12345678 " * 3000]
    texts += [" ".join(rng.choices(["alpha", "beta", "12345678901", "a@b.de", "don't"], k=300)) for _ in range(20)]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(3, texts[3], "again", 7), (None, texts[3], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_edits int")
    out = T.count(df).collect()
    assert len(out) == len(rows)
    for r in out:
        text = texts[3 if r.doc_id is None else r.doc_id]
        edited = T.PERSONAL.sub(T.MASK, text) if text is not None else None
        assert (r.n_tokens, r.n_tokens_after) == (count(text or ""), count(edited or ""))
        assert sum(r.leaf_chars) == len(edited or "")
    kept = T.count(df.filter("doc_id > 5"), edits=None).join(df.select("doc_id", "text"), "doc_id")
    again = {r.doc_id: r for r in T.recount(kept, T.masks).collect()}
    for r in out:
        if r.doc_id is not None and r.doc_id > 5:
            assert again[r.doc_id].n_tokens_after == r.n_tokens_after
    assert T.count(df.limit(0)).count() == 0
