"""Token counts that follow edits.

A text is cut into leaves of about LEAF characters at places where a pre-token must begin whatever stands elsewhere: a
space between a character that is no white space and a letter. Tokens never cross such a place, so a leaf is encoded by itself. A
segment tree over the leaves holds sums of characters and tokens. An edit is found by going down the sums;
the leaves that it touches, and those whose border it may have changed (a border depends on the characters next to it), are
encoded again as one stretch, and the sums above them are updated. The rest of the text is not read.

Edits are (start, end, new text) in characters of the text as the edits before left it; places beyond the end are
clipped. Null texts have no tokens and no leaves; an empty text has one empty leaf. The tokenizer is byte-level
BPE from a file of ranks, which the driver reads and broadcasts (its size is fixed). Each row is by itself: no shuffle.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Sequence

import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import map_rows

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of this tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 512
BORDER = regex.compile(r"(?<=\S) (?=\p{L})")

#: The edits of the registered query: long numbers and mail addresses are masked.
PERSONAL = regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+?\d[\d ()-]{6,}\d")
MASK = "[removed]"


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def counter(ranks: bytes) -> Callable[[str], int]:
    encode = _encoding(ranks).encode_ordinary
    return lambda text: len(encode(text)) if text else 0


def cut(text: str, leaf: int = LEAF) -> list[str]:
    """Leaves of `leaf` characters or more, as far as borders allow."""
    parts, at = [], 0
    while len(text) - at > leaf:
        m = BORDER.search(text, at + leaf)
        if m is None:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    parts.append(text[at:])
    return parts


class Tree:
    """A segment tree over leaves: sums of characters and of tokens. Leaves that an edit empties stay, with zeros."""

    def __init__(self, leaves: Sequence[str], count: Callable[[str], int], tokens: Sequence[int] | None = None) -> None:
        self.count, self.encoded = count, 0
        self.build(list(leaves), tokens)

    def build(self, leaves: list[str], tokens: Sequence[int] | None = None) -> None:
        self.leaves = leaves
        self.base = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, t in enumerate(leaves):
            self.chars[self.base + i] = len(t)
            self.tokens[self.base + i] = self.count(t) if tokens is None else tokens[i]
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last leaf for the end), and where it begins."""
        node, before = 1, 0
        at = min(at, max(0, self.chars[1] - 1))
        while node < self.base:
            node *= 2
            if at - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return min(node - self.base, len(self.leaves) - 1), before

    def edit(self, start: int, end: int, new: str) -> None:
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        # a border at i depends on characters i - 1, i and i + 1: those from start - 1 to end may have changed
        first, at = self.find(max(0, start - 2))
        last, last_at = self.find(min(self.n_chars, end + 1))
        stretch = "".join(self.leaves[first : last + 1])
        stretch = stretch[: start - at] + new + stretch[end - at :]
        touched = last - first + 1
        self.encoded += len(stretch)
        if len(stretch) > 8 * LEAF * touched + 8 * LEAF:  # much was put in: cut anew, keeping the other leaves' counts
            fresh = cut(stretch)
            kept = [self.tokens[self.base + i] for i in range(len(self.leaves))]
            leaves = [*self.leaves[:first], *fresh, *self.leaves[last + 1 :]]
            self.build(leaves, [*kept[:first], *map(self.count, fresh), *kept[last + 1 :]])
            return
        pieces = cut(stretch, max(LEAF, -(-len(stretch) // touched)))
        pieces += [""] * (touched - len(pieces))
        if len(pieces) > touched:
            pieces = [*pieces[: touched - 1], "".join(pieces[touched - 1 :])]
        parents = set()
        for i, t in enumerate(pieces, first):
            self.leaves[i] = t
            self.chars[self.base + i], self.tokens[self.base + i] = len(t), self.count(t)
            parents.add((self.base + i) // 2)
        while parents and 0 not in parents:  # level by level, each node once
            for i in parents:
                self._sum(i)
            parents = {i // 2 for i in parents if i > 1}


def masks(text: str) -> list[tuple[int, int, str]]:
    """The edits of the registered query, from the end to the start, so that offsets stay true."""
    return [(m.start(), m.end(), MASK) for m in PERSONAL.finditer(text)][::-1]


SCHEMA = "doc_id {id}, n_tokens long, n_edits long, n_tokens_after long, n_leaves long, chars_encoded long, leaf_tokens array<int>, leaf_chars array<int>"


def count(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] | None = masks, ranks_path: str = RANKS) -> DataFrame:
    """Tokens of every row before and after its edits, the characters that the edits made encode again, and the tree's
    leaves after them (recount() takes them up)."""
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        tokens_of = counter(shared.value)

        def run(rows: dict) -> list:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                if text is None:
                    row = (doc_id, 0, 0, 0, 0, 0, [], [])
                else:
                    tree = Tree(cut(text), tokens_of)
                    before, todo = tree.n_tokens, edits(text) if edits else []
                    for e in todo:
                        tree.edit(*e)
                    n = len(tree.leaves)
                    row = (doc_id, before, len(todo), tree.n_tokens, n, tree.encoded, tree.tokens[tree.base : tree.base + n], tree.chars[tree.base : tree.base + n])
                for column, x in zip(out, row):
                    column.append(x)
            return out

        return run

    return map_rows(docs.select("doc_id", "text"), make, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()), chunk=64)


def recount(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]], ranks_path: str = RANKS) -> DataFrame:
    """As count(), for rows that have text, leaf_tokens and leaf_chars: nothing but the edited stretches is encoded."""
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        tokens_of = counter(shared.value)

        def run(rows: dict) -> list:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text, tokens, chars in zip(rows["doc_id"], rows["text"], rows["leaf_tokens"], rows["leaf_chars"]):
                if text is None:
                    row = (doc_id, 0, 0, 0, 0, 0, [], [])
                else:
                    leaves, at = [], 0
                    for n in chars:
                        leaves.append(text[at : at + n])
                        at += n
                    tree = Tree(leaves, tokens_of, tokens)
                    before, todo = tree.n_tokens, edits(text)
                    for e in todo:
                        tree.edit(*e)
                    n = len(tree.leaves)
                    row = (doc_id, before, len(todo), tree.n_tokens, n, tree.encoded, tree.tokens[tree.base : tree.base + n], tree.chars[tree.base : tree.base + n])
                for column, x in zip(out, row):
                    column.append(x)
            return out

        return run

    return map_rows(docs.select("doc_id", "text", "leaf_tokens", "leaf_chars"), make, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()), chunk=64)


def digest(counted: DataFrame) -> DataFrame:
    return counted.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_leaves", "chars_encoded")
