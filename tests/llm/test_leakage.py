from __future__ import annotations

import random

from larkspur.llm import leakage
from larkspur.llm.leakage import find_leaks


def letters(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


def test_against_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh字é1") for _ in range(r.randint(2, 9)))
    passages = {k: " ".join(word() for _ in range(30)) for k in range(6)} | {6: "short", 7: None, 8: ""}
    docs = {}
    for k in range(80):
        own = " ".join(word() for _ in range(r.randint(0, 40)))
        source = passages[r.randrange(6)]
        at, size = r.randrange(len(source) - 60), r.randint(20, 75)
        part = source[at : at + size]
        part = part.upper() if r.random() < 0.3 else part.replace(" ", r.choice([" ", "-- ", "\n", ""]))
        docs[k] = own[: len(own) // 2] + " # " + part + " # " + own[len(own) // 2 :]
    docs |= {100: None, 101: "", 102: " "}
    runs = lambda s: {letters(s)[i : i + 40] for i in range(len(letters(s)) - 39)}
    want = {(d, p) for d, t in docs.items() for p, s in passages.items() if t and s and runs(t) & runs(s)}
    corpus = spark.createDataFrame([(k, t, 1) for k, t in docs.items()] * 2, "doc_id int, text string, exact int")
    items = spark.createDataFrame(list(passages.items()), "item_id int, passage string")
    found = find_leaks(corpus, "doc_id", "text", items, "item_id", "passage").collect()
    assert {(x.doc_id, x.item_id) for x in found if x.exact >= 40} == want and 5 < len(want) < 75
    assert len({(x.doc_id, x.item_id) for x in found}) == len(found)


def test_substitutions_are_seen(spark):
    passage = "the silver lantern stood beside an old harbour wall while rain kept falling over the quiet town"
    changed = list(passage)
    for k in (12, 40, 66):
        changed[k] = "z"
    docs = spark.createDataFrame([(1, "before " + "".join(changed) + " after")], "doc_id int, text string")
    items = spark.createDataFrame([(5, passage)], "item_id int, passage string")
    got = find_leaks(docs, "doc_id", "text", items, "item_id", "passage").first()
    assert got.exact < 40 and got.overlap >= 60 and 2 <= got.substitutions <= 3


def test_near_copies_at_all_alignments(spark):
    r = random.Random(4)
    some = lambda n: "".join(r.choice("abcdefghijklm") for _ in range(n))
    passages, docs, want = {}, {}, set()
    for item, (size, every) in enumerate([(60, 20), (80, 20), (60, 15), (100, 15)]):
        passages[item] = some(size)
        for phase in range(every):
            copy = "".join("z" if k % every == phase else c for k, c in enumerate(passages[item]))
            for ahead in range(17):
                docs[len(docs)] = some(ahead) + copy + some(30)
                want.add((len(docs) - 1, item, size - 2 * every))
    corpus = spark.createDataFrame(list(docs.items()), "doc_id int, text string").repartition(4)
    items = spark.createDataFrame(list(passages.items()), "item_id int, passage string")
    found = {(x.doc_id, x.item_id): x.overlap for x in find_leaks(corpus, "doc_id", "text", items, "item_id", "passage").collect()}
    assert not [w for w in want if found.get(w[:2], 0) < w[2]]


def test_overlaps_of_any_length(spark):
    r = random.Random(6)
    some = lambda n: "".join(r.choice("abcdefghijklm") for _ in range(n))
    passage = some(3000)
    changed = "".join("z" if k % 50 == 20 else c for k, c in enumerate(passage))
    docs = {1: some(500) + passage + some(500), 2: passage[700:1900], 3: some(90) + changed + some(20), 4: passage[:900] + some(700) + passage[1500:]}
    corpus = spark.createDataFrame(list(docs.items()) * 2, "doc_id int, text string")
    found = {x.doc_id: x for x in find_leaks(corpus, "doc_id", "text", spark.createDataFrame([(0, passage)], "item_id int, passage string"), "item_id", "passage").collect()}

    def longest(a: str, b: str) -> int:
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0] + [row[k] + 1 if x == y else 0 for k, y in enumerate(b)]
            best = max(best, *row)
        return best

    assert {k: found[k].exact for k in docs} == {k: longest(t, passage) for k, t in docs.items()}
    assert {k: found[k].exact for k in (1, 2, 4)} == {1: found[1].exact, 2: 1200, 4: found[4].exact} and found[1].exact >= 3000 and found[4].exact >= 1500
    assert 2980 <= found[3].overlap <= 3010 and 59 <= found[3].substitutions <= 62 and found[1].overlap >= 3000


def test_measuring_against_a_plain_walk():
    import numpy as np

    def walk(doc, item):
        differ = [k for k in range(len(doc)) if doc[k] != item[k]]
        reach, used = (differ[0] if differ else len(doc)), 0
        for k, (place, following) in enumerate(zip(differ, [*differ[1:], len(doc)]), 1):
            if place - reach >= leakage.GAP or k > max(2, leakage.DENSITY * (following + 1)):
                break
            if following > place + 1:
                reach, used = following, k
        return reach, used

    r = random.Random(5)
    for size in [*range(60), *[200] * 40]:
        share = r.choice([0.02, 0.1, 0.3])
        doc, item = np.zeros(size, int), np.array([int(r.random() < share) for _ in range(size)], int)
        assert leakage._reach(np.flatnonzero(doc != item), size) == walk(doc, item)


def test_no_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id int, text string"), spark.createDataFrame([], "item_id int, passage string")
    assert find_leaks(docs, "doc_id", "text", items, "item_id", "passage").count() == 0
