"""Imports, caches, logs, streams and the calls of a client."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.api import Vault
from larkspur.operators import chunks as C
from larkspur.sources import inbox
from larkspur.streaming import jobs

DAY = "2026-01-01"


def test_inbox(spark, tmp_path):
    (tmp_path / "below").mkdir()
    for name in ("a.md", "b.TXT", "c.pages", "_draft.md", ".hidden.md", "README.md", "d.pdf", "below/e.md"):
        (tmp_path / name).write_text("x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in inbox.scan_inbox(spark, str(tmp_path)).collect()) == ["a.md", "b.TXT", "c.pages"]
    stream = jobs.watch_vault(spark, str(tmp_path)).select("path").writeStream.format("memory").queryName("dropped").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("dropped").count() == 3


def test_imported_chats(spark):
    rows = [("20/旅行計畫_0a1b2c3d4e.md", "> 備份時間： 2024/05/06\n# head\nFirst line that is long enough\nshort"), ("20/plain.md", "Hello there, reader"), ("20/c.md", "---\ntitle: x\n---\nbody"), ("20/none.md", None)]
    got = {r.path: r for r in inbox.imported_chats(spark.createDataFrame(rows, "path string, text string"), F.lit(DAY).cast("date")).collect()}
    a = got["20/旅行計畫_0a1b2c3d4e.md"]
    assert (a.title, a.date_created, a.summary) == ("旅行計畫", "2024-05-06", "First line that is long enough") and a.text.startswith('---\nuuid: "') and a.text.endswith("short")
    assert (got["20/plain.md"].title, got["20/plain.md"].date_created) == ("Hello there, reader", "2026-01-01")
    assert got["20/c.md"].text == rows[2][1] and got["20/none.md"].title == "none"


def test_enrichment_scan(spark):
    rows = [("30_Journal/a.md", "x"), ("30_Journal/b.md", "enriched_at: 1"), ("10_Profile/c.md", "x"), ("00_System/d.md", ""), ("README.md", ""), ("e.txt", ""), ("f.md", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    assert {r.path for r in inbox.to_enrich(files).collect()} == {"30_Journal/a.md", "f.md"}
    assert [r.path for r in inbox.to_enrich(files, "10_Profile/c.md").collect()] == ["10_Profile/c.md"]


def test_caches_logs_and_sets(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"a.md::para0": ["one?", "two?"], "b.md::para1": [], "c::para2::para": ["x"]}))
    (tmp_path / "broken.json").write_text("{")
    cache = inbox.read_cache(spark, str(tmp_path / "q.json"), "array<string>").select("key", F.col("value").alias("questions"))
    assert {(r.path, r.question) for r in inbox.question_samples(cache).collect()} == {("a.md", "one?"), ("c", "x")}
    assert inbox.read_cache(spark, str(tmp_path / "none.json")).count() == 0 and inbox.read_cache(spark, str(tmp_path / "broken.json")).count() == 0
    for answers in ([("a", "1"), ("a", "1")], [("a", "2"), ("b", "3")]):
        inbox.append_cache(spark.createDataFrame(answers, "key string, value string"), str(tmp_path / "cache"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "cache")).collect()} == {("a", "1"), ("b", "3")}
    (tmp_path / "log.jsonl").write_text('{"id": "x1", "op": "add"}\n{"id": "x2", "op": "remove"}\n')
    assert [r.op for r in inbox.read_log(spark, str(tmp_path / "log.jsonl"), "id string, op string", "x2").collect()] == ["remove"]
    pytest.importorskip("yaml")
    (tmp_path / "g.yaml").write_text("Clio:\n  - query: when?\n    expected_paths: a.md\n  - query: who?\n    expected_paths: [b.md, c.md]\n    tags: [t]\n")
    assert [(r.key, r.expected_paths, r.tags) for r in inbox.golden_set(spark, str(tmp_path / "g.yaml")).orderBy("key").collect()] == [("Clio#0", ["a.md"], []), ("Clio#1", ["b.md", "c.md"], ["t"])]


def test_chunks(spark):
    docs = spark.createDataFrame([("a", "A first paragraph of some length.\n\nshort\n\n## Head\nA second paragraph of some length.", "sum"), ("b", None, " ")], "path string, text string, s string")
    notes = spark.createDataFrame([("a::para0", "note")], "chunk_id string, note string")
    questions = spark.createDataFrame([("a::para1", ["q1", "", "q2", "q3", "q4", "q5"])], "chunk_id string, questions array<string>")
    got = {r.chunk_id: r for r in C.build_chunks(docs, F.lit("[p]"), F.col("s"), notes, questions).collect()}
    assert set(got) == {"a::summary", "a::para0", "a::para1", "a::para1::q0", "a::para1::q2", "a::para1::q3", "a::para1::q4"}
    assert got["a::para0"].text == "[p]\n[語境：note]\nA first paragraph of some length." and got["a::summary"].text == "[p]\nsum"
    assert C.chunks_of(C.paragraph_chunks(docs, "path", "text"), spark.createDataFrame([("a",)], "path string")).count() == 2


def test_recent_accesses_keep_their_bound(spark, tmp_path):
    rows = [(k, "_vault/a.md" if k % 2 else "a.md", datetime(2024, 1, 1, 0, k)) for k in range(20)] + [(99, "b.md", datetime(2024, 1, 2)), (100, None, datetime(2024, 1, 2)), (101, "b.md", None)]
    schema = "id int, memory_path string, accessed_at timestamp_ntz"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    query = jobs.recent_accesses(jobs.watch_table(spark, str(tmp_path / "in"), schema, 1), 5).writeStream.format("memory").queryName("recent").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    best = {}
    for r in spark.table("recent").collect():
        best[r.memory_path] = max(best.get(r.memory_path, []), r.times)
    assert [t.minute for t in best["a.md"]] == [19, 18, 17, 16, 15] and len(best["b.md"]) == 1


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    docs = [("30_Journal/2024/a.md", "The lighthouse keeper repaired the old lamp in spring.", "2024-05-01", "journal"), ("50_Knowledge/b.md", "Lamps need oil and patience.\n\nA lighthouse is a tower with a lamp.", "2023-01-01", "knowledge"), ("10_Profile/c.md", "Profile text that is long enough to be a paragraph.\n\nAnother paragraph about bread and butter.\n\nOne more about rivers and wide valleys.\n\nThe last one is about trains at night.", None, "bio")]
    memory = [(k, p, f"title {k}", "summary", d, ["likes tea", "has a cat"]) for k, (p, _, d, _) in enumerate(docs)]
    m = spark.createDataFrame(memory, "memory_id int, memory_path string, title string, summary string, date_created string, personal_facts array<string>").withColumns(
        {"date_updated": F.lit("2024"), "importance": F.lit("low"), "dormant": F.lit(None).cast("string"), "type": F.lit("Note"), "enriched_at": F.lit(None).cast("timestamp_ntz")}
    )
    t = datetime(2024, 1, 1)
    edges = spark.createDataFrame([("mem_location", "Memory", docs[0][0], "Location", "lighthouse", "", t, None, t, None), ("mem_person", "Memory", docs[1][0], "Person", "Ann", "", t, None, t, None)], "rel string, src_label string, src string, dst_label string, dst string, evidence string, t_valid_start timestamp_ntz, t_valid_end timestamp_ntz, t_ingested timestamp_ntz, invalidated_by string")
    accesses = spark.createDataFrame([(1, docs[0][0], t, "search", t), (2, docs[1][0], t, "search", t)], "id int, memory_path string, accessed_at timestamp_ntz, source string, ingested_at timestamp_ntz")
    documents = spark.createDataFrame(docs, "path string, text string, date_created string, type string")
    return Vault(documents, m, edges, accesses).build_index(str(tmp_path_factory.mktemp("index") / "i"))


def test_client_searches(vault, spark, tmp_path):
    now, log = datetime(2024, 6, 1), str(tmp_path / "log")
    found = vault.search_memory("lighthouse lamp", now, log_to=log).orderBy("rank").collect()
    assert {r.path for r in found} == {"30_Journal/2024/a.md", "50_Knowledge/b.md"} and [r["rank"] for r in found] == [1, 2]
    assert [r.path for r in vault.search_memory("lighthouse lamp", now, domains=["Urania"], mode="hard").collect()] == ["50_Knowledge/b.md"]
    assert [r.path for r in vault.search_memory("lighthouse lamp", now, doc_type="journal").collect()] == ["30_Journal/2024/a.md"]
    assert vault.search_with_sections("patience", now).first().section.startswith("Lamps need oil")
    assert {r.path for r in vault.query_memory_at_time("lighthouse", now).collect()} <= {"30_Journal/2024/a.md", "50_Knowledge/b.md"}
    assert vault.read_file("10_Profile/c.md", now, log).count() == 1
    logged = spark.read.parquet(log)
    assert logged.count() == 3 and logged.select("accessed_at").distinct().count() == 1


def test_client_looks_things_up(vault):
    now = datetime(2024, 6, 1)
    assert vault.get_entity_timeline("Ann").count() == 1 and vault.get_profile().count() == 1 and vault.list_journals(2024).count() == 1
    assert {r.path for r in vault.find_memories("LIGHTHOUSE").collect()} == {"30_Journal/2024/a.md", "50_Knowledge/b.md"}
    assert {r.kind for r in vault.inspect("50_Knowledge/b.md").collect()} == {"memory", "edge mem_person", "chunk"}
    assert vault.get_memory_health().first().n == 3 and set(vault.optimize_memory(now)) == {"co_recalled", "forgettable", "names"}


def test_client_edits_and_reverts(vault, spark):
    from larkspur.operators import edits

    done = vault.update_fact("50_Knowledge/b.md", "tea", "likes coffee")
    assert done.first().after == ["likes coffee", "has a cat"]
    log = edits.edit_log(done, F.lit(datetime(2024, 6, 1)).cast("timestamp_ntz"))
    now = done.select("memory_path", F.col("after").alias("personal_facts"))
    assert vault.revert(now, log).first().reverted == ["likes tea", "has a cat"]
    assert vault.add_fact("50_Knowledge/b.md", "new").first().after[-1] == "new" and vault.invalidate_fact("50_Knowledge/b.md", "cat").first().after == ["likes tea"]
    assert vault.correct_text("50_Knowledge/b.md", "oil", "wax").first().outcome == "applied"
    asked = spark.createDataFrame([("when did I last swim",)], "t string")
    assert vault.guide(asked, "t").first().classes == ["READ-RECALL"]
