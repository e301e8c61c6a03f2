"""The upkeep of memories: themes, reflections, verdicts on facts, audits, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import empty_strings, slug
from larkspur.operators.edits import FIELDS

#: Facts in one part of a theme's document.
PART = 200


def _themes(memories: DataFrame) -> DataFrame:
    facts = F.coalesce("personal_facts", empty_strings())
    return memories.filter(~F.col("dormant")).select(F.col("memory_path").alias("path"), F.explode("themes").alias("theme"), facts.alias("facts")).filter("theme is not null")


def theme_groups(memories: DataFrame, least: int = 5, sources: int = 5) -> DataFrame:
    """``theme, n_facts, n_sources, first_sources`` of the themes with ``least`` facts or more. Of the sources the first few are
    chosen before they are gathered."""
    rows = _themes(memories).select("theme", "path", F.size("facts").alias("nf"))
    totals = rows.groupBy("theme").agg(F.sum("nf").alias("n_facts")).filter(F.col("n_facts") >= least)
    paths = rows.select("theme", "path").distinct()
    place = F.row_number().over(Window.partitionBy("theme").orderBy("path"))
    first = paths.withColumn("_k", place).filter(F.col("_k") <= sources).groupBy("theme").agg(F.array_sort(F.collect_list("path")).alias("first_sources"))
    return totals.join(paths.groupBy("theme").agg(F.count("*").alias("n_sources")), "theme").join(first, "theme").select("theme", "n_facts", "n_sources", "first_sources")


def theme_documents(memories: DataFrame, least: int = 5) -> DataFrame:
    """``path, theme, part, n_facts, text``: documents that list the different facts of each theme, about PART in each, so that no
    theme is gathered whole."""
    facts = _themes(memories).select("theme", F.explode("facts").alias("fact")).distinct()
    sizes = facts.groupBy("theme").agg(F.ceil(F.count("*") / PART).alias("_parts"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    number = F.conv(F.substring(F.md5("fact"), 1, 8), 16, 10).cast("bigint")
    parts = facts.join(sizes, "theme").withColumn("part", F.pmod(number, F.col("_parts")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("fact")), lambda f: F.concat(F.lit("- "), f)), "\n")
    grouped = parts.groupBy("theme", "part").agg(F.count("*").alias("n_facts"), text.alias("text"))
    return grouped.select(F.concat(F.lit("10_Profile/themes/"), slug(F.col("theme")), F.lit("_"), "part", F.lit(".md")).alias("path"), "theme", "part", "n_facts", "text")


def reflection_rows(memories: DataFrame, as_of: Column, days: int = 7, least: int = 3) -> DataFrame:
    """``memory_path, date, line``: what a reflection on the last days is written from; nothing where there are fewer than ``least``
    memories."""
    recent = memories.filter((F.col("date") >= F.date_sub(as_of, days)) & (F.col("date") <= as_of) & ~F.col("dormant"))
    rows = recent.select("memory_path", "date", F.substring(F.coalesce("summary", "title", F.lit("")), 1, 200).alias("line"))
    enough = rows.agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return rows.join(F.broadcast(enough), how="inner").drop("_n")


def reflection_document(bodies: DataFrame, as_of: Column) -> DataFrame:
    """Written reflections (``body``) as documents of their own folder."""
    day = F.date_format(as_of, "yyyy-MM-dd")
    return bodies.select(F.concat(F.lit("10_Profile/reflections/"), day, F.lit("_"), F.substring(F.md5("body"), 1, 8), F.lit(".md")).alias("path"), F.lit("reflection").alias("type"), day.alias("date_created"), F.col("body").alias("text"))


def with_source(verdicts: DataFrame, facts: DataFrame) -> DataFrame:
    """Verdicts (``subject, fact``) with the ``source`` path of the fact they are about, else of the subject's first fact (``person,
    fact, path``)."""
    exact = facts.groupBy(F.col("person").alias("subject"), "fact").agg(F.min("path").alias("_exact"))
    first = facts.groupBy(F.col("person").alias("subject")).agg(F.min_by("path", F.struct("path", "fact")).alias("_first"))
    joined = verdicts.join(exact, ["subject", "fact"], "left").join(first, "subject", "left")
    return joined.withColumn("source", F.coalesce("_exact", "_first")).drop("_exact", "_first")


def apply_verdicts(edges: DataFrame, verdicts: DataFrame, at: Column) -> DataFrame:
    """The graph after verdicts on people's places and events (``subject, operation, rel, old_object, new_object, source``): UPDATE
    and INVALIDATE end the open edges to the old object; ADD and UPDATE add one to the new, if none is open; NOOP does nothing."""
    mine = verdicts.withColumn("operation", F.upper("operation")).filter(F.col("rel").isin("person_loc", "person_event"))
    ends = mine.filter("operation in ('UPDATE', 'INVALIDATE') and old_object != ''").groupBy("rel", F.col("subject").alias("src"), F.col("old_object").alias("dst")).agg(F.min("source").alias("_by"), F.lit(True).alias("_ends"))
    joined = edges.join(ends, ["rel", "src", "dst"], "left")
    hit = F.col("t_valid_end").isNull() & F.col("_ends").isNotNull() & (F.col("src_label") == "Person")
    kept = joined.withColumns({"invalidated_by": F.when(hit, F.col("_by")).otherwise(F.col("invalidated_by")), "t_valid_end": F.when(hit, at).otherwise(F.col("t_valid_end"))}).select(*edges.columns)
    fresh = mine.filter("operation in ('ADD', 'UPDATE') and new_object != ''").groupBy("rel", F.col("subject").alias("src"), F.col("new_object").alias("dst")).agg(F.min(F.substring("fact", 1, 80)).alias("evidence"))
    fresh = fresh.join(kept.filter("t_valid_end is null").select("rel", "src", "dst").distinct(), ["rel", "src", "dst"], "left_anti")
    rows = fresh.select("rel", F.lit("Person").alias("src_label"), "src", F.when(F.col("rel") == "person_loc", "Location").otherwise("Event").alias("dst_label"), "dst", "evidence", at.alias("t_valid_start"), F.lit(None).cast("timestamp_ntz").alias("t_valid_end"), at.alias("t_ingested"), F.lit(None).cast("string").alias("invalidated_by"))
    return kept.unionByName(rows.select(*edges.columns))


def audit_issues(memories: DataFrame, checked: DataFrame) -> DataFrame:
    """``memory_path, nth, field, issue_type, current_value, suggested_value``: entries of memories that their ``checked`` rows (the same
    memories, validated against the source) lack. An outside judge's rows have the same columns."""
    lists = [f for f in FIELDS if f in memories.columns and f in checked.columns]
    both = memories.select("memory_path", *(F.coalesce(F.col(f), empty_strings()).alias(f) for f in lists)).join(checked.select("memory_path", *(F.col(f).alias(f"_{f}") for f in lists)), "memory_path")
    named = lambda field: lambda x: F.struct(F.lit(field).alias("field"), x.alias("current_value"))
    gone = F.concat(*(F.transform(F.array_except(f, f"_{f}"), named(f)) for f in lists))
    each = both.select("memory_path", F.posexplode(F.array_sort(gone)).alias("nth", "e"))
    return each.select("memory_path", "nth", "e.field", F.lit("hallucination").alias("issue_type"), "e.current_value", F.lit("").alias("suggested_value"))


def audit_report(memories: DataFrame, issues: DataFrame) -> DataFrame:
    """``field, n_issues, n_memories, n_scanned``: the figures of an audit by field."""
    scanned = memories.agg(F.count("*").alias("n_scanned"))
    return issues.groupBy("field").agg(F.count("*").alias("n_issues"), F.countDistinct("memory_path").alias("n_memories")).join(F.broadcast(scanned), how="inner")


def trace(paths: DataFrame, memories: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``path, kind, n, first``: what the vault, the graph and the index have about each path."""
    asked = paths.select("path").distinct()
    document = memories.join(asked, memories.memory_path == asked.path, "left_semi").groupBy(F.col("memory_path").alias("path")).agg(F.count("*").alias("n"), F.min("title").alias("first")).withColumn("kind", F.lit("memory"))
    linked = edges.filter("src_label = 'Memory'").join(asked, edges.src == asked.path, "left_semi").groupBy(F.col("src").alias("path"), F.concat(F.lit("edge "), "rel").alias("kind")).agg(F.count("*").alias("n"), F.min("dst").alias("first"))
    indexed = chunks.join(asked, "path", "left_semi").groupBy("path").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first")).withColumn("kind", F.lit("chunk"))
    columns = ["path", "kind", "n", "first"]
    return document.select(*columns).unionByName(linked.select(*columns)).unionByName(indexed.select(*columns))
