from __future__ import annotations

import math
import random
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.operators import chunks as C
from larkspur.operators import dense, edits, evaluation, graph, lexical, memories, models, ordered, ranking, scoring
from larkspur.operators.components import connected_components
from larkspur.sources import vault
from larkspur.streaming import jobs


def test_fusion_by_hand(spark):
    rows = [("x", "A", 1), ("x", "B", 2), ("y", "B", 1), ("y", "C", 2)]
    got = {r.path: r.score for r in ranking.fuse(spark.createDataFrame(rows, "leg string, path string, rank int"), [], "path").collect()}
    assert got == pytest.approx({"A": 1 / 61, "B": 1 / 62 + 1 / 61, "C": 1 / 62})


def test_activation_by_hand(spark):
    now = datetime(2024, 1, 2)
    rows = [("a", datetime(2024, 1, 1, 20)), ("b", now), ("c", None)]
    got = {r.p: r.activation for r in ranking.activation(spark.createDataFrame(rows, "p string, t timestamp_ntz"), "p", "t", F.lit(now).cast("timestamp_ntz")).collect()}
    assert got["a"] == pytest.approx(-0.693147, abs=1e-6) and got["b"] == pytest.approx(2.302585, abs=1e-6) and "c" not in got


def test_boosts(spark):
    yes, no = F.lit(True), F.lit(False)
    row = spark.range(1).select(
        ranking.confidence_boost(F.lit(1.0), yes, F.lit(0.3)).alias("a"), ranking.penalty(F.lit(1.0), no, F.lit(0.6)).alias("b"), ranking.penalty(F.lit(1.0), yes, F.lit(0.6)).alias("c"), ranking.flat_boost(F.lit(1.0), yes).alias("d")
    ).first()
    assert tuple(row) == pytest.approx((1.2, 0.85, 1.0, 1.3))


def bm25_by_hand(texts, query):
    import re

    toks = {k: [w.lower() for w in re.findall("[a-zA-Z0-9]+", t)] for k, t in texts.items() if t}
    toks = {k: v for k, v in toks.items() if v}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for words in toks.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    idf = {w: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, r in raw.items()}
    out = {}
    for k, words in toks.items():
        score = sum(idf[w] * words.count(w) * 2.5 / (words.count(w) + 1.5 * (0.25 + 0.75 * len(words) / mean)) for w in query.split() if w in words)
        if score > 0:
            out[k] = score
    return out


def test_kept_index_against_plain_scores(spark, tmp_path):
    """Built, appended to (a delivery that is repeated adds nothing) and searched, the index scores like one over all texts at once."""
    texts = {1: "red fish", 2: "red bird red", 3: "red red stone", 4: None, 5: "", 6: "blue bird and fish", 7: "stone stone wall", 8: "red wall"}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    index = lexical.LexicalIndex.build(df.filter("id < 6"), "id", "t", str(tmp_path / "index"))
    index.append(df.filter("id > 2"), "t")
    index.append(df, "t")
    queries = spark.createDataFrame([("q", "fish red red"), ("empty", None), ("none", "zebra")], "query_id string, query string")
    got = {r.id: r.score for r in index.search(queries, "query").collect()}
    assert got == pytest.approx(bm25_by_hand(texts, "fish red red")) and index.figures()["n"] == 6
    index.refresh(spark.createDataFrame([(6, "red red bird"), (9, "new fish here")], "id int, t string"), "t", spark.createDataFrame([(6,), (7,), (50,)], "id int"))
    now = {k: v for k, v in texts.items() if k != 7} | {6: "red red bird", 9: "new fish here"}
    assert {r.id: r.score for r in index.search(queries, "query").filter("query_id = 'q'").collect()} == pytest.approx(bm25_by_hand(now, "fish red red"))
    index.append(spark.createDataFrame([(7, "red fish again")], "id int, t string"), "t")
    assert {r.id: r.score for r in index.search(queries, "query").filter("query_id = 'q'").collect()} == pytest.approx(bm25_by_hand(now | {7: "red fish again"}, "fish red red"))
    assert all(f"bucket={b}" in " ".join(index.postings().inputFiles()) for b in {r.bucket for r in index.postings().select("bucket").distinct().collect()})


def test_edges_in_time(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = [("r", "Memory", "m", "Person", "p", t(1), t(5)), ("r", "Memory", "n", "Person", "p", t(3), None), ("r", "Memory", "o", "Person", "p", None, None)]
    edges = spark.createDataFrame(rows, "rel string, src_label string, src string, dst_label string, dst string, t_valid_start timestamp_ntz, t_valid_end timestamp_ntz")
    at = lambda d: sorted(r.path for r in graph.memories_at(edges, F.lit(t(d)).cast("timestamp_ntz")).collect())
    assert (at(1), at(4), at(5)) == (["m"], ["m", "n"], ["n"])
    names = spark.createDataFrame([("p",)], "name string")
    assert graph.timeline(edges, names).count() == 3


def test_spreading_keeps_its_mass(spark):
    rows = [("r", "A", str(a), "A", str(b)) for a, b in [(1, 2), (2, 3), (3, 1), (3, 4)]]
    edges = spark.createDataFrame(rows, "rel string, src_label string, src string, dst_label string, dst string")
    seeds = spark.createDataFrame([("q", "A:1"), ("q", "A:missing")], "query_id string, node string")
    got = {r.node: r.score for r in graph.personalised_pagerank(edges, seeds).collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    near = {"A:1": ["A:2", "A:3"], "A:2": ["A:1", "A:3"], "A:3": ["A:1", "A:2", "A:4"], "A:4": ["A:3"]}
    p = {"A:1": 1.0}
    for _ in range(60):
        p = {n: 0.85 * (n == "A:1") + 0.15 * sum(p.get(m, 0) / len(near[m]) for m in near[n]) for n in near}
    assert got == pytest.approx(p, abs=1e-7)
    with pytest.raises(RuntimeError):
        graph.personalised_pagerank(edges, seeds, damping=0.9, most_steps=3)
    assert [r.path for r in graph.spreading_activation(edges.withColumn("src_label", F.lit("Memory")).withColumn("dst_label", F.lit("Memory")), graph.seed_nodes(edges, spark.createDataFrame([("q", "1")], "query_id string, path string")), 2).orderBy("rank").collect()] == ["3", "2"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components_as_union_find(spark, pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_edits_and_their_reversal(spark):
    rows = [(1, "p1", ["likes tea", "has a cat"]), (2, "p2", ["likes tea", "likes tea twice"]), (3, "p3", None), (4, "p4", ["a", "b", "c"])]
    m = spark.createDataFrame(rows, "memory_id int, memory_path string, personal_facts array<string>")
    steps = [("p1", 1, "update", "tea", "likes coffee"), ("p1", 2, "remove", "cat", ""), ("p1", 3, "add", "", "new"), ("p2", 1, "remove", "tea", ""), ("p3", 1, "add", "", "new"), ("p3", 2, "add", "", "new"), ("p4", 1, "remove", "b", ""), ("p4", 2, "update", "c", "d")]
    done = edits.apply_fact_edits(m, spark.createDataFrame(steps, "memory_path string, step int, op string, old string, new string")).cache()
    assert {r.memory_id: r.after for r in done.collect()} == {1: ["likes coffee", "new"], 2: ["likes tea", "likes tea twice"], 3: ["new"], 4: ["a", "d"]}
    log = edits.edit_log(done, F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")).cache()
    assert {(r.memory_path, r.step): (r.place, r.old, r.outcome) for r in log.collect()} == {
        ("p1", 1): (0, "likes tea", "applied"), ("p1", 2): (1, "has a cat", "applied"), ("p1", 3): (1, None, "applied"), ("p2", 1): (None, None, "unchanged"), ("p3", 1): (0, None, "applied"), ("p3", 2): (None, None, "unchanged"),
        ("p4", 1): (1, "b", "applied"), ("p4", 2): (1, "c", "applied"),
    }
    now = done.select("memory_path", F.col("after").alias("personal_facts"))
    assert {r.memory_path: r.reverted for r in edits.revert_edits(now, log).collect()} == {"p1": rows[0][2], "p3": [], "p4": rows[3][2]}
    one = log.filter("memory_path = 'p4' and step = 1").first().log_id
    assert [r.reverted for r in edits.revert_edits(now, edits.log_entry(log, one)).collect()] == [["a", "b", "d"]]
    assert {r.n for r in edits.pending_embeddings(log).filter("memory_path = 'p1'").collect()} == {3} and edits.log_lines(log).filter("line like '%removed: b'").count() == 1


def test_corrections_fold_over_fields(spark):
    rows = [("p", ["a", "b"], ["X"]), ("q", None, ["Y"])]
    m = spark.createDataFrame(rows, "memory_path string, tags array<string>, people array<string>")
    issues = [("p", 0, "people", "hallucination", "X", "Z"), ("p", 1, "tags", "missing", "", "c"), ("p", 2, "tags", "inaccurate", "a", ""), ("p", 3, "tags", "odd", "b", "")]
    changes = edits.corrections(spark.createDataFrame(issues, "memory_path string, nth int, field string, issue_type string, current_value string, suggested_value string"))
    more = spark.createDataFrame([("q", 0, "people", "set", "W"), ("q", 1, "tags", "add", "t"), ("q", 2, "tags", "add", "u"), ("q", 3, "tags", "remove", "#0")], "memory_path string, step int, field string, action string, value string")
    got = {r.memory_path: (r.tags, r.people) for r in edits.correct_fields(m, changes.unionByName(more)).collect()}
    assert got == {"p": (["b", "c"], ["Z"]), "q": (["u"], ["W"])}


def test_running_sums_and_neighbours(spark):
    r = random.Random(1)
    rows = [(k, r.choice("ab"), datetime(2024, 1, 1 + r.randrange(9), r.randrange(24)), r.randrange(5)) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, at timestamp_ntz, n int")
    want, total = {}, 0
    for x in sorted(rows, key=lambda x: (x[2], x[0])):
        want[x[0]] = total
        total += x[3]
    assert {x.id: x.s for x in ordered.running_sum(df, ["at", "id"], "n", "s").collect()} == want
    before, last = {}, {}
    for x in sorted(rows, key=lambda x: (x[2], x[0])):
        before[x[0]] = last.get(x[1])
        last[x[1]] = x[2]
    assert {x.id: x.b for x in ordered.with_previous(df, "k", "at", "id", F.date_trunc("day", "at"), "b").collect()} == before


@pytest.mark.parametrize("most", [2, 4096])
def test_nearest_in_blocks_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(dense, "MOST_QUERIES", most)
    r = random.Random(2)
    rows = [(k, [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] if k % 9 else None) for k in range(80)] + [(100, [0.0] * 3), (101, [1.0, 2.0]), (102, [])]
    v = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    q = spark.createDataFrame([(k, x) for k, x in rows if k % 10 == 1], "query_id int, vector array<double>")
    size = lambda x: math.sqrt(sum(a * a for a in x))
    fits = {k: x for k, x in rows if x and size(x)}
    want = set()
    for a in (k for k, _ in rows if k % 10 == 1 and k in fits):
        near = sorted((-round(sum(x * y for x, y in zip(fits[a], fits[b])) / size(fits[a]) / size(fits[b]), 9), b) for b in fits if len(fits[b]) == len(fits[a]))
        want |= {(a, b, k + 1) for k, (_, b) in enumerate(near[:5])}
    assert {(x.query_id, x.id, x["rank"]) for x in dense.nearest(v, "id", "v", q, 5).collect()} == want


def test_samples_sum_up(spark):
    rows = [(k, "big" if k < 60 else f"s{k % 7}") for k in range(100)]
    got = evaluation.stratified(spark.createDataFrame(rows, "id int, s string"), "id", F.col("s"), 10).collect()
    assert len(got) == 10 and {x.stratum for x in got} == {s for _, s in rows}


def test_validation_drops_what_the_text_does_not_hold(spark):
    row = (["Paris", "Rome"], ["我", "Ann"], ["party night"], ["joy"], "2020 trip", ["went to Paris", "zzz qqq"], ["a"] * 6, "odd", "Ann saw Paris at night in 2020")
    schema = "l array<string>, p array<string>, e array<string>, m array<string>, period string, personal_facts array<string>, themes array<string>, chat_category string, text string"
    df = spark.createDataFrame([row], schema).withColumn("entities", F.struct(F.col("l").alias("locations"), F.col("p").alias("people"), F.col("e").alias("events"), F.col("m").alias("emotions")))
    got = memories.validated(df, "text").first()
    assert (got.locations, got.people, got.events, got.emotions, got.facts, len(got.themes), got.chat_category) == (["Paris"], ["Ann"], ["party night"], [], ["went to Paris"], 4, None)


def test_metrics_by_hand(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "id int, rank int")
    got = evaluation.metrics(ranks).first()
    assert (got.recall_1, got.recall_5, got.mrr) == pytest.approx((1 / 3, 2 / 3, 4 / 9))


def test_cosine_and_means(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, [1.0, 1.0], "x"), (4, [1.0, 0.0], "y")]
    v = spark.createDataFrame(rows, "id int, v array<double>, g string")
    got = dense.mean_vectors(v, "g", "v", 3).collect()
    assert [r.g for r in got] == ["x"] and got[0].vector == pytest.approx([math.sqrt(0.5)] * 2)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert [r.id for r in dense.nearest(v, "id", "v", q, 2).orderBy("rank").collect()] == [1, 4]


def test_vault_files(spark, tmp_path):
    (tmp_path / "30_Journal").mkdir()
    (tmp_path / "00_System").mkdir()
    (tmp_path / "30_Journal" / "a.md").write_text('---\ntitle: "T"\ntags: [x, y]\ndormant: "True"\nentities:\n  people: [Ann]\nenriched_at: 2024\n---\nBody [[Ann]]\n', encoding="utf-8")
    (tmp_path / "b.md").write_text("no header", encoding="utf-8")
    (tmp_path / "00_System" / "c.md").write_text("skip", encoding="utf-8")
    docs = vault.parse_documents(vault.read_files(spark, str(tmp_path)))
    got = {r.path: r for r in docs.collect()}
    assert set(got) == {"30_Journal/a.md", "b.md"}
    a = got["30_Journal/a.md"]
    assert (a.title, a.tags, a.people, a.dormant, a.enriched, a.body) == ("T", ["x", "y"], ["Ann"], True, True, "Body [[Ann]]\n")
    tags, links = vault.semantic_index(docs)
    assert {(r.tag, r.path) for r in tags.collect()} == {("x", "30_Journal/a.md"), ("y", "30_Journal/a.md")} and [r.entity for r in links.collect()] == ["Ann"]
    assert [r.path for r in vault.awake(docs).collect()] == ["b.md"]
    again = {r.path: r for r in vault.parse_documents(vault.with_header(docs)).collect()}
    assert (again["30_Journal/a.md"].title, again["30_Journal/a.md"].people, again["30_Journal/a.md"].body) == (a.title, a.people, a.body)
    pages = spark.createDataFrame([("x/240501_trip.pages", "text"), ("x/none.pages", "")], "path string, text string")
    assert [tuple(r)[:3] for r in vault.journals_of(pages, F.lit("2026-01-01").cast("date")).collect()] == [("30_Journal/2024/240501_trip.md", "240501_trip", "2024-05-01")]
    out = str(tmp_path / "out")
    vault.write_routed(docs, out)
    vault.write_routed(docs, out)
    assert spark.read.parquet(out).count() == 2


def test_stream_appends_each_key_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string").write.parquet(source)
    for n in range(2):
        fresh = jobs.watch_table(spark, source, "id int, v string")
        jobs.append_new(fresh, target, ["id"], str(tmp_path / f"c{n}")).awaitTermination()
        spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string").write.mode("append").parquet(source)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_injected_model(spark):
    rows = spark.createDataFrame([("a", '{"x": 1}'), ("b", "nothing")], "k string, answer string")
    got = {r.k: r.answer for r in models.read_answer(rows, "answer", "x int").collect()}
    assert got["a"].x == 1 and got["b"] is None
    upper = models.apply_model(rows, lambda b: b.assign(answer=b["answer"].str.upper()), "k string, answer string")
    assert {r.answer for r in upper.collect()} == {'{"X": 1}', "NOTHING"}
    assert models.only_missing(rows, rows.filter("k = 'a'"), "k").count() == 1


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id int, t string")
    queries = spark.createDataFrame([], "query_id string, query string")
    index = lexical.LexicalIndex.build(none, "id", "t", str(tmp_path / "index"))
    assert index.search(queries, "query").count() == 0
    index.append(spark.createDataFrame([(1, "red fish"), (2, "grey stone"), (3, "green leaf")], "id int, t string"), "t")
    assert [r.id for r in index.search(spark.createDataFrame([("q", "fish")], "query_id string, query string"), "query").collect()] == [1]
    vectors = spark.createDataFrame([], "id int, v array<double>")
    assert dense.nearest(vectors, "id", "v", spark.createDataFrame([], "query_id int, vector array<double>"), 3).count() == 0
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
    assert memories.co_recalled(spark.createDataFrame([], "s int, i string"), F.col("s"), "i").count() == 0


def test_functions_of_sql(spark):
    from larkspur.functions import sql, text

    sql.register(spark)
    rows = spark.createDataFrame([("Ab 安靜的山路 c9é", "30_Journal/x.md"), ("", "y"), (None, None)], "t string, p string")
    rows.createOrReplaceTempView("some_rows")
    want = rows.select(text.tokens(F.coalesce("t", F.lit(""))).alias("a"), text.domain_of(F.col("p")).alias("b")).collect()
    assert [tuple(r) for r in spark.sql("select vault_tokens(t), vault_domain(p) from some_rows").collect()] == [tuple(r) for r in want]
    one = spark.sql("select vault_rrf(1, 1.0), ln(sum(vault_strength(timestamp_ntz'2024-01-01 20:00:00', timestamp_ntz'2024-01-02 00:00:00'))), vault_time_bonus(date'2024-01-15', date'2024-01-01', date'2024-01-31', date'2024-01-16', 1.0D)").first()
    assert tuple(one) == pytest.approx((1 / 61, -0.693147, 0.3 * (1 - 0.3 / 30)), abs=1e-6)


def test_what_follows_from_a_correction(spark, tmp_path):
    when = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    memory = "memory_path string, period string, personal_facts array<string>, entities struct<people:array<string>,locations:array<string>,events:array<string>>"
    before = spark.createDataFrame([("a", "", ["Ann in Rome"], (["Ann"], ["Rome"], [])), ("b", "", [], (["Bob"], [], []))], memory)
    after = spark.createDataFrame([("a", "", [], (["Ann"], ["Oslo"], [])), ("b", "", [], (["Bob"], [], []))], memory)
    docs = spark.createDataFrame([("a", "A paragraph about the city of Rome."), ("b", "A paragraph about nothing at all.")], "path string, text string")
    new_docs = spark.createDataFrame([("a", "A paragraph about the city of Oslo."), ("b", "A paragraph about nothing at all.")], "path string, text string")
    chunks = C.paragraph_chunks(docs, "path", "text")
    index = lexical.LexicalIndex.build(chunks.select("chunk_id", "para"), "chunk_id", "para", str(tmp_path / "i"))
    edges, cut = edits.cascade(graph.weave(before, when), chunks, index, after, new_docs, spark.createDataFrame([("a",)], "path string"), when)
    assert {(r.rel, r.src, r.dst) for r in edges.collect()} == {("mem_person", "a", "Ann"), ("mem_location", "a", "Oslo"), ("mem_person", "b", "Bob"), ("person_loc", "Ann", "Rome")}
    assert sorted(r.para for r in cut.collect()) == ["A paragraph about nothing at all.", "A paragraph about the city of Oslo."]
    asked = spark.createDataFrame([("q", "Oslo"), ("r", "Rome")], "query_id string, query string")
    assert index.figures()["n"] == 2 and {r.query_id for r in index.search(asked, "query").collect()} <= {"q"}


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_best_items_are_the_first_of_the_search(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(scoring, "BLOCK", block)
    r = random.Random(4)
    texts = [(f"d{r.randrange(40)}::{k}", " ".join(r.choice(["red", "fish", "the", "Stone", "安靜的路", "leaf", "x9"]) for _ in range(r.randrange(0, 9)))) for k in range(300)] + [("d1::odd", None), ("d2::odd", "İ the K")]
    df = spark.createDataFrame(texts, "id string, t string").repartition(3)
    index = lexical.LexicalIndex.build(df, "id", "t", str(tmp_path / "index"))
    rows = [(k, " ".join(r.choice(["red", "the", "fish", "安靜", "x9", "zebra"]) for _ in range(r.randrange(1, 5)))) for k in range(30)] + [(99, None), (98, "the"), (97, "the")]
    queries = spark.createDataFrame(rows, "query_id int, query string")
    item = F.regexp_replace("id", "::.*", "")
    for among in (None, spark.createDataFrame([(f"d{k}",) for k in range(0, 40, 2)], "item string")):
        all_of = index.search(queries, "query").select("query_id", item.alias("item"), F.round("score", 6).alias("score"))
        all_of = all_of if among is None else all_of.join(among, "item", "left_semi")
        want = ranking.with_rank(all_of, ["query_id"], "item").filter("rank <= 7")
        got = index.best(queries, "query", 7, item, among=among)
        plain = lambda df: sorted((x.query_id, x["rank"], x.item, round(x.score, 6)) for x in df.collect())
        assert plain(got) == plain(want) and got.count() > 100
    assert index.best(queries.filter("query_id = 99"), "query", 7, item).count() == 0
    few = queries.filter("query_id in (98, 97, 3)")
    assert plain(index.best(few, "query", 7, item)) == [x for x in plain(index.best(queries, "query", 7, item)) if x[0] in (98, 97, 3)]


def test_tokens_in_python_are_those_of_the_columns(spark):
    from larkspur.functions import text

    r = random.Random(5)
    rows = [("".join(r.choice("aZ9 .-_é安靜的山路İK\n㐀") for _ in range(r.randrange(60))),) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string").select("t", text.tokens(F.col("t")).alias("toks"))
    assert all(lexical._tokens_of(x.t) == x.toks for x in df.collect())


def test_patterns_of_many_queries(spark):
    r = random.Random(6)
    names = ["Anna", "Joanna", "Oslo", "summit", "Annaberg", "ab"]
    rows = [(*r.choice([("mem_person", "Memory", f"m{r.randrange(60)}", "Person"), ("person_loc", "Person", r.choice(names), "Location"), ("mem_location", "Memory", f"m{r.randrange(60)}", "Location"), ("event_loc", "Event", r.choice(names), "Location")]), r.choice(names)) for _ in range(150)]
    edges = spark.createDataFrame(rows, "rel string, src_label string, src string, dst_label string, dst string")
    asked = [(q, t) for q in range(12) for t in {r.choice(["An", "anna", "Anna", "os", "lo", "mm", "zz", "a"]) for _ in range(4)}] + [(20, "Anna"), (21, "Anna"), (21, "Anna")]
    found: dict[tuple, set] = {}
    for q, term in asked:
        if len(term) < 2:
            continue
        for rel, _, a, _, b in rows:
            if rel in graph.ONE_HOP and term in b:
                found.setdefault((q, a), set()).add((term, rel, graph.ONE_HOP[rel]))
            for (one, two, near), weight in graph.TWO_HOPS.items():
                for rel2, _, c, _, d in rows if rel == one else []:
                    if rel2 == two and b == (c if near == "src" else d) and term in (d if near == "src" else c):
                        found.setdefault((q, a), set()).add((term, one + two, weight))
    want = {k: sum(w for _, _, w in v) for k, v in found.items()}
    terms = spark.createDataFrame(asked, "query_id int, term string")
    assert {(x.query_id, x.path): x.score for x in graph.pattern_search(edges, terms).collect()} == pytest.approx(want)
    some = spark.createDataFrame([(f"m{k}",) for k in range(0, 60, 3)], "path string")
    got = [(x.query_id, x["rank"], x.path) for x in graph.first_by_pattern(edges, terms, 3, some).collect()]
    first = []
    for q in {q for q, _ in want}:
        own = sorted((-round(s, 6), p) for (k, p), s in want.items() if k == q and int(p[1:]) % 3 == 0)[:3]
        first += [(q, i + 1, p) for i, (_, p) in enumerate(own)]
    assert sorted(got) == sorted(first)


def test_spreading_for_many_queries_at_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "AT_ONCE", 300)
    r = random.Random(7)
    rows = [("r", "Memory", f"m{r.randrange(30)}", "Person", f"p{r.randrange(12)}") for _ in range(60)] + [("r", "Person", f"p{r.randrange(12)}", "Event", f"e{r.randrange(3)}") for _ in range(15)]
    edges = spark.createDataFrame(rows, "rel string, src_label string, src string, dst_label string, dst string")
    seeds = spark.createDataFrame([(q, f"Memory:m{r.randrange(32)}") for q in range(20) for _ in range(3)] + [(5, "Person:p1"), (77, "Memory:none")], "query_id int, node string")
    wanted = spark.createDataFrame([(q, f"Memory:m{k}") for q in range(20) for k in range(30)], "query_id int, node string")
    slow = graph.personalised_pagerank(edges, seeds, tolerance=1e-11).filter("node like 'Memory:%'").join(seeds, ["query_id", "node"], "left_anti").collect()
    want = {(x.query_id, x.node): x.score for x in slow}
    got = graph.activation_at(edges, seeds, wanted).collect()
    assert {(x.query_id, x.node): x.score for x in got} == pytest.approx(want, abs=1e-9)
    assert all(x.top == pytest.approx(max(s for (q, _), s in want.items() if q == x.query_id), abs=1e-9) for x in got)
    first = {(x.query_id, x["rank"]): x.path for x in graph.spreading_activation(edges, seeds, 4).collect()}
    for q in range(20):
        own = sorted((-round(s, 9), n[7:]) for (k, n), s in want.items() if k == q)[:4]
        assert [first.get((q, i + 1)) for i in range(len(own))] == [p for _, p in own]
