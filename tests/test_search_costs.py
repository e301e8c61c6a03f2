"""What keeps searches within their limits, against plain ways to the same."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import components, graph, lexical
from larkspur.plans import retrieval


def test_tokens_of_many_texts_at_once():
    rng = random.Random(3)
    texts = ["".join(rng.choices("aZ9 中文䷿鿿ꀀKİé\n\x00\U0001f600-_", k=rng.randrange(0, 30))) for _ in range(500)] + [""]
    of, code, names = lexical._tokens_in(texts)
    got = [[] for _ in texts]
    for k, c in zip(of, code):
        got[k].append(names[int(c)].as_py())
    assert all(sorted(g) == sorted(lexical._tokens_of(t)) for g, t in zip(got, texts))


def test_a_task_says_how_many_texts_have_each_token(spark):
    """Terms are summed up over tasks, not over every token of every text."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["red fish", "red red", "藍魚", None, "--"])], "id int, t string").coalesce(1)
    sums = lexical._counted(df, "id", "t").filter("len = -1").collect()
    assert dict(zip(sums[0].toks.split(" "), sums[0].tfs.split(" "))) == {"red": "2", "fish": "1", "藍": "1", "魚": "1", "藍魚": "1"}


def test_paragraphs_end_where_sql_ends_them(spark):
    """White space before a last line separator stays, as SQL's pattern ends at the end of the text alone."""
    df = spark.createDataFrame([("\n # Heading\nA paragraph that is long enough  ",), ("\t A paragraph without any marks \x0b",)], "t string")
    assert [p for r in df.select(text.paragraphs(F.col("t")).alias("p")).collect() for p in r.p] == ["Heading\nA paragraph that is long enough  ", "A paragraph without any marks"]


def test_terms_meet_names_as_numbers(spark):
    edges = spark.createDataFrame([("mem_person", "Memory", "m1", "Person", "Arne"), ("person_loc", "Person", "Arne", "Location", "Arnheim")], "rel string, src_label string, src string, dst_label string, dst string")
    numbers = graph._numbered(spark.createDataFrame([(1, "Arn"), (2, "Arn"), (2, "x"), (3, "heim")], "query_id int, term string"))
    assert sorted((r.term, r.no) for r in numbers.collect()) == [("Arn", 1), ("heim", 2)]
    (row,) = graph._held_terms(edges, numbers).collect()
    assert sorted(zip(row.toks, row.gains)) == [(1, 1.0), (1, 2.0), (2, 1.0)]


def test_layers_of_neighbours_sum_up_like_links():
    """A hub of more neighbours than there are layers, a chain, nodes in any order."""
    rng = np.random.default_rng(5)
    ends = np.array([(7, k) for k in range(8, 8 + 3 * graph.LAYERS)] + [(k, k + 1) for k in range(7)])
    n = int(ends.max()) + 1
    a, b = np.concatenate([ends, ends[:, ::-1]]).T
    place, layers, rest, share = graph._layers(a, b, n)
    values, want, got = rng.random(n), np.zeros(n), np.zeros(n)
    np.add.at(want, b, values[a])
    placed = np.empty(n)
    placed[place] = values
    for layer in layers:
        got[: len(layer)] += placed[layer]
    for k, more in rest:
        got[k] += placed[more].sum()
    assert len(layers) == graph.LAYERS and got[place] == pytest.approx(want)
    assert share[place] == pytest.approx(1 / np.bincount(a, minlength=n))


def test_components_of_few_edges_take_one_task(spark, monkeypatch):
    """No rounds of joins for the driver to plan, whatever the length of the chain; the same groups as by rounds."""
    pairs = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(70)] + [("ö", "z"), ("z", "中"), ("中", "\U0001f600"), ("q", "q"), (None, "r"), ("z", "ö")]
    edges = spark.createDataFrame(pairs, "a string, b string")
    written = []
    monkeypatch.setattr(components, "cut_lineage", lambda df, cut=components.cut_lineage: written.append(1) or cut(df))
    got = {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()}
    assert len(written) == 1
    assert got == {f"n{k:03d}": "n000" for k in range(71)} | dict.fromkeys(("z", "ö", "中", "\U0001f600"), "z")
    monkeypatch.setattr(components, "MOST_IN_A_TASK", 0)
    assert {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()} == got


def test_spreading_answers_every_query(spark):
    """Whatever the number of a query, by its hits and by the names in its text; a query without either in the graph has no rows."""
    hits = [(k, q, text, "dense", 0.5, path) for k, (q, text, path) in enumerate([(1, "x", "m1"), (10, "x", "m1"), (13, "Arne", None), (27, None, "m2"), (31, "x", "m9")])]
    results = spark.createDataFrame(hits, "result_id long, query_id long, query string, source string, score double, memory_path string").withColumn("chat_category", F.lit(None).cast("string"))
    edges = spark.createDataFrame([("mem_person", "Memory", m, "Person", "Arne") for m in ("m1", "m2", "m3")], "rel string, src_label string, src string, dst_label string, dst string")
    found = retrieval.spreading_topk({"search_results": results, "edges": edges}.__getitem__)
    assert sorted((r.query_id, r["rank"], r.path) for r in found.collect()) == [
        (1, 1, "m2"), (1, 2, "m3"), (10, 1, "m2"), (10, 2, "m3"), (13, 1, "m1"), (13, 2, "m2"), (13, 3, "m3"), (27, 1, "m1"), (27, 2, "m3"),
    ]
