"""The pN_ queries over the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import canonical, cooccurrence, encoding, leakage, pieces, privacy, spans, variants
from larkspur.session import table

#: Where the public vocabularies lie.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

Query = Callable[[SparkSession, str], DataFrame]


def _recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "access_events")
    return events.select("accessed_at", F.regexp_replace("memory_path", "^_vault/", "").alias("path"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.link_variants(table(spark, sf_dir, "persons"), "person_id", "name", "aliases")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.entity_pairs(p1_entities(spark, sf_dir), "person_id")


def p1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's edges with person ends on one node for each entity."""
    persons = table(spark, sf_dir, "persons")
    return variants.redirected_edges(table(spark, sf_dir, "edges"), persons, p1_entities(spark, sf_dir), "person_id", "name")


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts that may hold personal information, each delivery of a key once."""
    messages = table(spark, sf_dir, "messages").dropDuplicates(["message_id"])
    memories = table(spark, sf_dir, "memories").dropDuplicates(["memory_id"])
    content = messages.select(F.lit("content").alias("field"), F.col("message_id").alias("item_id"), F.lit(0).cast("bigint").alias("pos"), F.col("content").alias("text"))
    facts = memories.select(F.lit("personal_facts").alias("field"), F.col("memory_id").alias("item_id"), F.posexplode("personal_facts").alias("pos", "text"))
    facts = facts.withColumn("pos", F.col("pos").cast("bigint"))
    summary = memories.select(F.lit("summary").alias("field"), F.col("memory_id").alias("item_id"), F.lit(0).cast("bigint").alias("pos"), F.col("summary").alias("text"))
    return content.unionByName(facts).unionByName(summary)


def _redactor(spark: SparkSession, sf_dir: str) -> privacy.Redactor:
    spellings = table(spark, sf_dir, "persons").select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).distinct()
    return privacy.Redactor.fit(spark, spellings, "name", _personal_texts(spark, sf_dir), "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["field", "item_id", "pos"]
    return _redactor(spark, sf_dir).spans(_personal_texts(spark, sf_dir), keys, "text").select(*keys, "kind").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redactor(spark, sf_dir).redact(_personal_texts(spark, sf_dir), ["field", "item_id", "pos"], "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.pair_counts(_recalls(spark, sf_dir), "accessed_at", "path", 8, 2.0)
    return pairs.select(F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.pair_counts(_recalls(spark, sf_dir), "accessed_at", "path", 8, 2.0)
    return pairs.withColumns({c: F.round(c, 6) for c in ("lift", "conviction")})


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "memories")
    fields = F.array(
        F.struct(F.lit("tags").alias("field"), F.col("tags").alias("entries")),
        F.struct(F.lit("locations").alias("field"), F.col("entities.locations").alias("entries")),
    )
    lists = memories.select("memory_id", F.inline(fields))
    return lists.select("memory_id", "field", F.explode("entries").alias("entry"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.changed_entries(_entries(spark, sf_dir), ["memory_id", "field"], "entry")


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All memories with both lists in plain form, entries that became equal only once."""
    plain = _entries(spark, sf_dir).select("memory_id", "field", canonical.canonical_column(F.col("entry")).alias("plain"))
    return plain.groupBy("memory_id", "field").agg(F.sort_array(F.collect_set("plain")).alias("entries"))


def _long_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns and sections longer than the limit, each delivery of a key once."""
    messages = table(spark, sf_dir, "messages").select(
        F.lit("messages").alias("item_table"), F.col("message_id").alias("item_id"), F.col("content").alias("text")
    )
    results = table(spark, sf_dir, "search_results").select(
        F.lit("search_results").alias("item_table"), F.col("result_id").alias("item_id"), F.col("parent_section").alias("text")
    )
    both = messages.unionByName(results).filter(F.char_length("text") > pieces.LIMIT)
    return both.dropDuplicates(["item_table", "item_id"])


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_texts(_long_items(spark, sf_dir), ["item_table", "item_id"], "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["item_table", "item_id"]
    return pieces.oversized(p3_pieces(spark, sf_dir), keys).select(*keys, "cut")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def _leaks(spark: SparkSession, sf_dir: str, tolerant: bool) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leakage.find_leaks(documents, "doc_id", "text", items, "item_id", "passage", 40, tolerant)


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, True)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, False).filter("exact >= 40").select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(*spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text", 300), "doc_id")


def p8_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_amounts(table(spark, sf_dir, "documents"), "doc_id", "text", 300)


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.document_amounts(table(spark, sf_dir, "documents"), "doc_id", "text", 300)


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_entities": p1_entities,
        "p1_edges": p1_edges,
        "p2_found": p2_found,
        "p2_canonical": p2_canonical,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p4_found": p4_found,
        "p4_redacted": p4_redacted,
        "p5_found": p5_found,
        "p5_scores": p5_scores,
        "p6_ids": p6_ids,
        "p7_found": p7_found,
        "p7_overlaps": p7_overlaps,
        "p8_found": p8_found,
        "p8_amounts": p8_amounts,
        "p8_documents": p8_documents,
    }
