from __future__ import annotations

import random
from itertools import combinations

import pytest

from larkspur.llm import spans


def corpus() -> dict[int, str | None]:
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcdefghij klmno.字é") for _ in range(n))
    shared = [some(n) for n in (299, 300, 301, 450, 900, 1500)]
    docs: dict[int, str | None] = {}
    for k in range(60):
        part = shared[k % 6]
        cut = part if k % 5 else part[r.randrange(30) : len(part) - r.randrange(30)]
        docs[k] = some(r.randint(0, 200)) + cut + some(r.randint(0, 200))
    return docs | {100: None, 101: "", 102: docs[7], 103: docs[7], 104: "=" * 700, 105: "x" + "=" * 650, 106: some(250)}


def truth(docs: dict[int, str | None], span: int) -> set[tuple[int, int]]:
    windows = {k: {t[i : i + span] for i in range(len(t) - span + 1)} for k, t in docs.items() if t}
    return {(a, b) for a, b in combinations(sorted(windows), 2) if windows[a] & windows[b]}


@pytest.mark.parametrize("hot", [2, 64])
def test_pairs_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    docs = corpus()
    df = spark.createDataFrame([(k, t, "clash") for k, t in docs.items()] * 2, "doc_id bigint, text string, a string")
    got = [tuple(r) for r in spans.shared_pairs(*spans.shared_spans(df, "doc_id", "text", 300), "doc_id").collect()]
    assert set(got) == truth(docs, 300) and len(got) == len(set(got))


def test_amounts(spark):
    docs = {1: "a1b2c3d4e5" * 3 + "start " + "".join(chr(97 + (k * k + 3 * k) % 26) for k in range(400)), 2: "other " + "".join(chr(97 + (k * k + 3 * k) % 26) for k in range(400)) + " end", 3: "nothing in common " * 2}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_copies, r.n_partners, r.n_shared) for r in spans.shared_amounts(df, "doc_id", "text", 300).collect()}
    assert set(got) == {1, 2} and all(c == 0 and p == 1 and 400 <= n <= 402 for c, p, n in got.values())


@pytest.mark.parametrize("hot", [2, 64])
def test_amounts_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcdefghij klmno.字é") for _ in range(n))
    often, seldom = some(2000), some(800)
    docs = corpus() | {200 + k: some(50 + k) + often + (seldom if k < 2 else "") + some(30) for k in range(5)}
    docs |= {210: some(90) + often[300:1100] + some(20) + often[900:1500], 211: seldom + some(40) + seldom}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_partners, r.n_shared) for r in spans.shared_amounts(df, "doc_id", "text", 300).collect() if not r.n_copies}

    alone = {k: t for k, t in docs.items() if t and list(docs.values()).count(t) == 1}
    windows = {t: {t[i : i + 300] for i in range(len(t) - 299)} for t in docs.values() if t}
    expected = {}
    for k, t in alone.items():
        others = [w for other, w in windows.items() if other != t]
        places = {i for i in range(len(t) - 299) if any(t[i : i + 300] in w for w in others)}
        if places:
            expected[k] = (sum(not windows[t].isdisjoint(w) for w in others), len({c for i in places for c in range(i, i + 300)}))
    assert got == expected


def test_chunks_resist_insertions():
    import numpy as np

    r = random.Random(2)
    text = "".join(r.choice("abcdefghij ") for _ in range(4000))
    moved = text[:1000] + "INSERTED" + text[1000:]

    def parts(t: str) -> set[str]:
        values = spans._mixed(np.frombuffer(t.encode("utf-32-le"), np.uint32))
        owner, begin, end = spans.chunks(values, np.array([0, len(t)]), 95)
        return {t[a:b] for a, b in zip(begin, end)}

    a, b = parts(text), parts(moved)
    assert len(a & b) > 0.9 * len(a)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.shared_pairs(*spans.shared_spans(df, "doc_id", "text", 300), "doc_id").count() == 0


@pytest.mark.parametrize("hot", [2, 64])
def test_amounts_of_every_document(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    pairs = truth(docs, 300)
    windows = {k: [t[i : i + 300] for i in range(len(t) - 299)] for k, t in docs.items() if t}
    expected = {}
    for k in {k for p in pairs for k in p}:
        others = {w for j, own in windows.items() if j != k for w in own}
        places = {c for i, w in enumerate(windows[k]) if w in others for c in range(i, i + 300)}
        expected[k] = (sum(k in p for p in pairs), len(places))
    got = spans.document_amounts(df, "doc_id", "text", 300).collect()
    assert {r.doc_id: (r.n_partners, r.n_shared) for r in got} == expected and len(got) == len(expected) and {102, 103} <= set(expected)
