"""License scans: fuzzy search for short notices.

Each notice of m characters may occur with up to k edits. It is split into k + 1 pieces; by the pigeonhole
principle an occurrence with at most k edits holds one piece unchanged. An Aho-Corasick automaton finds
the pieces, and the regex library's bounded-error matching verifies the stretch around each of them. A match
begins and ends with a word. Of matches of one notice that overlap, the one with fewer edits is reported.

Texts are compared as their words joined by single spaces, so case, punctuation and line breaks don't count.
Null and empty texts have no words and no matches. Repeated rows each get their own result. Only the map
over rows is needed: there is no shuffle, and memory is bounded by a chunk of rows.
"""

from __future__ import annotations

import functools

import ahocorasick
import regex
from pyspark.sql import DataFrame

from .common import map_rows, real_words

#: (label, phrase) of the contract: exact places count.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: (label, notice, most edits).
NOTICES = (
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", 6),
    ("apache", "licensed under the apache license version 2 0", 3),
    ("apache", "you may not use this file except in compliance with the license", 5),
    ("gpl", "gnu general public license", 2),
    ("gpl", "this program is free software you can redistribute it and or modify", 5),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("bsd", "redistributions of source code must retain the above copyright notice", 5),
    ("bsd", "bsd 3 clause license", 1),
    ("bsd", "bsd 2 clause license", 1),
    ("mpl", "mozilla public license", 2),
    ("epl", "eclipse public license", 2),
    ("isc", "permission to use copy modify and or distribute this software", 5),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5),
    ("cc-by", "creative commons attribution", 2),
    ("cc-by", "licensed under cc by 4 0", 1),
    ("cc-by-nc", "licensed under cc by nc 4 0", 1),
    ("cc-by-sa", "licensed under cc by sa 4 0", 1),
    ("cc0", "cc0 1 0 universal public domain dedication", 3),
    ("reserved", "all rights reserved", 1),
)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=4)
def _compiled(notices: tuple):
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, (_, notice, k) in enumerate(notices):
        for at, piece in pieces(notice, k):
            seeds.setdefault(piece, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for piece, where in seeds.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n)}){{e<={k}}}(?![^ ])") for _, n, k in notices]


def fuzzy_matches(text: str, notices: tuple = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) in a normalised text: candidates from exact seeds, verified by regex."""
    automaton, patterns = _compiled(notices)
    windows: dict[int, list[list[int]]] = {}
    for end, (length, where) in automaton.iter(text):
        for i, at in where:
            k, m = notices[i][2], len(notices[i][1])
            lo = max(0, end - length + 1 - at - k)
            hi = text.find(" ", min(len(text), lo + m + 3 * k))  # a stretch is whole words
            lo, hi = text.rfind(" ", 0, lo) + 1, len(text) if hi < 0 else hi
            own = windows.setdefault(i, [])
            if own and lo <= own[-1][1]:
                own[-1][1] = max(own[-1][1], hi)
            else:
                own.append([lo, hi])
    found = []
    for i, spans in windows.items():
        spans.sort()
        joined: list[list[int]] = []
        for lo, hi in spans:
            if joined and lo <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], hi)
            else:
                joined.append([lo, hi])
        for lo, hi in joined:
            found += [(i, *place) for place in _best_first(patterns[i], text, lo, hi, len(notices[i][1]) - notices[i][2])]
    return found


def _best_first(pattern: regex.Pattern, text: str, lo: int, hi: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, edits): the best match of the stretch, then those of what is left before and after it."""
    found, rest = [], [(lo, hi)]
    while rest:
        lo, hi = rest.pop()
        if hi - lo >= least and (m := pattern.search(text, lo, hi)):
            found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            rest += [(lo, m.start() - 1), (m.end() + 1, hi)]
    return sorted(found)


def _places(text: str, phrase: str) -> list[int]:
    """Word indexes at which a phrase's words stand; text has a space at either end."""
    found, at, index, last = [], text.find(f" {phrase} "), 0, 0
    while at >= 0:
        index += text.count(" ", last, at)
        found.append(index)
        last = at
        at = text.find(f" {phrase} ", at + 1)
    return found


SCHEMA = "doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start_word:long,end_word:long,edits:int>>"


def scan(docs: DataFrame, notices: tuple = NOTICES) -> DataFrame:
    """One row per document: base places, labels, the best match's share of unchanged characters, and spans in words."""

    def make():
        def run(rows: dict) -> list:
            out: list[list] = [[] for _ in range(9)]
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                ws = real_words(text)
                joined = b" ".join(ws).decode("latin-1")
                padded = f" {joined} "
                base, labels, score, places, spans = set(), set(), 0.0, [], []
                for label, phrase in BASE:
                    if at := _places(padded, phrase):
                        base.add(label)
                        places += at
                        score = 1.0
                for i, start, end, edits in fuzzy_matches(joined, notices):
                    label, notice, _ = notices[i]
                    labels.add(label)
                    score = max(score, 1 - edits / len(notice))
                    first = joined.count(" ", 0, start + 1 if joined[start : start + 1] == " " else start)
                    spans.append({"label": label, "start_word": first, "end_word": joined.count(" ", 0, end - 1) + 1, "edits": edits})
                spans.sort(key=lambda s: (s["start_word"], s["end_word"], s["label"]))
                row = (doc_id, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, spans)
                for column, x in zip(out, row):
                    column.append(x)
            return out

        return run

    return map_rows(docs.select("doc_id", "text"), make, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))
