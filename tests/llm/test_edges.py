"""License scan, decontamination, classifier and shards: brute force, and nulls, empty tables, ties, repeats, clashing names."""

import collections
import heapq
import random

import numpy as np

from graphloom.llm import decontaminate, license_scan, quality, sharding


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_license_matches_against_edit_distances():
    """Several notices with 0 to k edits in a text; every place on word bounds within the errors is met by a match."""
    rng = random.Random(8)
    notices = (("r", "all rights reserved", 1), ("m", "mozilla public license", 2), ("b", "bsd 3 clause license", 1), ("c", "creative commons attribution", 3))
    filler = ["small", "rights", "the", "public", "bsd", "license", "common", "x"]
    hits = 0
    for _ in range(60):
        ws = []
        for _ in range(rng.randint(2, 6)):
            ws += [rng.choice(filler) for _ in range(rng.randint(0, 3))]
            _, notice, k = rng.choice(notices)
            chars = list(notice)
            for _ in range(rng.randint(0, k + 1)):
                at = rng.randrange(len(chars))
                chars[at : at + 1] = rng.choice([[], ["q"], [chars[at], "z"]])
            ws += "".join(chars).split()
        text = " ".join(ws)
        found = collections.defaultdict(list)
        for i, a, b, edits in license_scan.fuzzy_matches(text, notices):
            assert (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")
            assert distance(text[a:b], notices[i][1]) == edits <= notices[i][2]
            found[i].append((a, b))
        starts = [sum(len(w) + 1 for w in ws[:n]) for n in range(len(ws))]
        for i, (_, notice, k) in enumerate(notices):
            for n, a in enumerate(starts):
                for m in range(n, min(len(ws), n + 7)):
                    b = starts[m] + len(ws[m])
                    if abs(b - a - len(notice)) <= k and distance(text[a:b], notice) <= k:
                        hits += 1
                        assert any(x < b and a < y for x, y in found[i]), (text, notice, text[a:b])
    assert hits > 100
    assert license_scan.fuzzy_matches("small rights reserved", (("r", "all rights reserved", 0),)) == []


def test_license_scan_rows(spark):
    rows = [(1, "MIT License, mit license"), (None, None), (2, ""), (2, ""), (3, "Apache\nLicense " + "w " * 50000 + "all rights rezerved")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS labels", "2 AS n_words", "3 AS matches")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.scan(docs).collect()), key=str)
    assert got == [(0, 0, 0, None, None, "", ""), (1, 4, 2, 0, 2, "mit", "mit"), (2, 0, 0, None, None, "", ""), (2, 0, 0, None, None, "", ""), (3, 50005, 1, 0, 0, "apache", "apache,reserved")]
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_decontamination_spans_blocks_and_edges(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([("a", item), (None, "solo words here"), ("n", None), ("e", "")], "item_id string, text string")
    rows = [(1, f"é x — {item.upper()} y"), (2, "Solo, words; HERE"), (3, None), (4, ""), (5, "alpha beta gamma"), (1, "twice"), (None, item), (6, "q " * 60000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS items", "3 AS n_words")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.scan(docs, bench).collect()}
    first = got[1, 16]  # the dash is a word: it is no ASCII
    assert [rows[0][1][a:b] for a, b in first.spans] == [item.upper()] and first.items == ["a"] and first.ranges == [[3, 15]]
    assert got[2, 3].ranges == [[0, 3]] and got[2, 3].items == []
    assert got[6, 60012].ranges == [[60000, 60012]] and not got[5, 3].ranges and not got[3, 0].ranges
    plain = sorted(map(str, decontaminate.digest(decontaminate.scan(docs, bench)).collect()))
    assert plain == sorted(map(str, decontaminate.digest(decontaminate.scan(docs, bench, block_windows=5)).collect()))
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 3, 4, 5]
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows) and decontaminate.scan(docs.limit(0), bench).count() == 0


def test_quality_votes_and_held_out_labels(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(30)) if i % 3 else "SPAM !!! " * rng.randint(3, 20)) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "no id at all"), (4, rows[4][1]), (4, "another text"), (202, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "1 AS score", "2 AS held_out")
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(150)] + [(4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = {r.doc_id for r in got if r.held_out}
    flipped = labels.selectExpr("doc_id", "1 - quality AS quality", "toxic").filter("doc_id IN (%s)" % ",".join(map(str, held - {None})))
    kept = labels.filter("doc_id IS NULL OR doc_id NOT IN (%s)" % ",".join(map(str, held - {None})))
    assert sorted(map(str, quality.score(docs, kept.unionByName(flipped)).collect())) == sorted(map(str, got))
    model = quality.fit(docs, labels)
    texts = [t for _, t in rows[:40]]
    z = model._unit(quality.weighted(texts, model.idf) @ model.axes)
    for text, v in zip(texts, z):
        cosines = [round(float(x), 5) for x in model.vectors @ v]
        last = sorted(cosines)[-min(quality.NEIGHBOURS, len(cosines))]
        votes = [(max(x, 0) ** quality.POWER * w, y) for x, w, y in zip(cosines, model.votes, model.y) if x >= last]
        assert abs(sum(w for w, y in votes if y) / sum(w for w, _ in votes) - model.score([text])[0]) < 0.01
    assert np.all(quality.fit(docs, labels.limit(0)).score(["a", None]) == 0.5)
    assert quality.score(docs.limit(0), labels).count() == 0


def test_shards_against_a_heap(spark):
    rng = random.Random(6)
    rows = [(i, "a" * rng.choice([1, 5, 900, 3000, 70_000, 90_001]) + str(i % 150)) for i in range(400)]
    rows += [(None, None), (401, None), (402, ""), (402, ""), (7, "again"), (7, "again"), (8, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS shard", "3 AS key", "4 AS w")
    got = sharding.digest(sharding.shard(docs)).join(docs.select("doc_id", "text").distinct(), "doc_id", "left").collect()
    plain = sharding.shard(docs).collect()
    assert len(plain) == len(rows) and {r["law"] for r in got} == {"bytes"}
    groups = collections.Counter()
    for _, t in rows:
        groups[t] += len((t or "").encode()) + 1
    heap = [(0, s) for s in range(16)]
    for w in sorted(groups.values(), reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + w, s))
    loads, slots, together = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in plain:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        together[r["size"], r.text_crc32].add(r.shard)
    assert sum(loads.values()) == sum(groups.values()) and max(loads.values()) <= max(heap)[0] * (1 + 2 / 1024)
    assert all(len(s) == 1 for s in together.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, plain)) == sorted(map(str, sharding.shard(docs.repartition(7)).collect()))
    assert sharding.shard(docs.limit(0)).count() == 0
