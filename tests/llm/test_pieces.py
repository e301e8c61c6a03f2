from __future__ import annotations

import random
import re

import pytest

from larkspur.llm import pieces
from larkspur.llm.pieces import oversized, split_files, split_texts


def made(seed: int, size: int) -> str:
    r = random.Random(seed)
    out = ""
    while len(out) < size:
        out += r.choice(["word ", "字", "é", "sentence. ", "句子。", "\n\n", "\n", "x" * r.randint(1, 60), "\U0001f469‍\U0001f4bb", "é"])
    return out[:size]


def check(text: str, found: list, limit: int, overlap: int) -> None:
    found = sorted(found, key=lambda p: p.piece)
    assert [p.piece for p in found] == list(range(len(found)))
    assert found[0].start == 0 and found[-1].end == len(text)
    for p in found:
        assert p.text == text[p.start : p.end] and 0 < len(p.text) <= limit
    for a, b in zip(found, found[1:]):
        assert overlap * 0.6 <= a.end - b.start <= overlap and b.end > a.end
    longest = max(map(len, re.split(r"[\s.!?。！？]", text)))
    assert {p.cut for p in found} == {"forced" if longest > limit else "natural"}


@pytest.mark.parametrize("range_bytes", [1, 1 << 16])
def test_round_trip(spark, range_bytes):
    limit, overlap = 200, 30
    texts = {k: made(k, 150 + 37 * k * k) for k in range(12)}
    texts |= {100: "y" * 5000, 101: "", 102: "a" * 199 + " " + "b" * 1000, 103: ("z" * 150 + "。") * 60, 104: "w" * 200, 105: "字" * 4000}
    rows = [(k, t, "clash") for k, t in texts.items()] + [(106, None, "clash")]
    df = split_texts(spark.createDataFrame(rows, "k int, t string, text string"), ["k"], "t", limit, overlap, range_bytes)
    got = df.collect()
    assert {p.k for p in got} == {k for k, t in texts.items() if len(t) > limit}
    for k in {p.k for p in got}:
        check(texts[k], [p for p in got if p.k == k], limit, overlap)
    assert {r.k: r.n_chars for r in oversized(df, ["k"]).collect()} == {k: len(t) for k, t in texts.items() if len(t) > limit}


def test_ranges_give_what_whole_texts_give(spark):
    """Workers that see a range and its halos find what one finds that has the whole text, and the table puts it in place."""
    limit, overlap = 200, 30
    texts = {k: made(20 + k, 1500 * k) for k in range(1, 9)} | {20: "字" * 5000, 21: "x" * 7000, 22: ("y" * 190 + ". ") * 40}
    rows = spark.createDataFrame(list(texts.items()), "k int, t string").repartition(3)
    got = {}
    for p in split_texts(rows, ["k"], "t", limit, overlap, 1).collect():
        got.setdefault(p.k, []).append((p.piece, p.start, p.end, p.text))
    for k, text in texts.items():
        raw = text.encode()
        edges = sorted({len(raw[: pieces._aligned(raw, at)].decode()) for at in range(0, len(raw), 8 * limit)} | {len(text)})
        want = []
        for a, b in zip(edges, edges[1:]):
            want += [(a + x, a + y, t) for x, y, t in pieces.range_pieces(text[:a], text[a:b], text[b:], a == 0, b == len(text), limit, overlap)]
        assert len(edges) > 2 or k == 1
        assert sorted(got[k]) == [(n, *w) for n, w in enumerate(want)]


def test_a_long_file(spark, tmp_path):
    (tmp_path / "long.txt").write_bytes(("word " * 400_000).encode())
    got = split_files(spark, str(tmp_path), 1200, 120, 1 << 16).agg({"end": "max", "piece": "max"}).first()
    assert got["max(end)"] == 2_000_000 and got["max(piece)"] > 1800


def test_files_by_ranges(spark, tmp_path):
    texts = {"a b.txt": made(5, 30_000), "c.txt": "short", "d.txt": "長" * 9000}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = split_files(spark, str(tmp_path), 200, 30, 2000).collect()
    names = {p.path.rsplit("/", 1)[1] for p in got}
    assert names == {"a b.txt", "d.txt"}
    for name in names:
        check(texts[name], [p for p in got if p.path.endswith(name)], 200, 30)


def test_no_rows(spark):
    assert split_texts(spark.createDataFrame([], "k int, t string"), ["k"], "t").count() == 0
