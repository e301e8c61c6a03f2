"""Chunks of documents: a summary, the paragraphs, questions that a paragraph answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import empty_strings, paragraphs, stripped

#: Questions that a paragraph may have.
MOST_QUESTIONS = 5


def paragraph_chunks(documents: DataFrame, path: str, text: str) -> DataFrame:
    """``chunk_id, path, chunk_index, para`` of every paragraph."""
    rows = documents.select(F.col(path).alias("path"), F.posexplode(paragraphs(F.col(text))).alias("chunk_index", "para"))
    return rows.select(F.concat("path", F.lit("::para"), "chunk_index").alias("chunk_id"), "path", "chunk_index", "para")


def build_chunks(documents: DataFrame, prefix: Column, summary: Column, notes: DataFrame | None = None, questions: DataFrame | None = None) -> DataFrame:
    """``chunk_id, path, chunk_type, view, chunk_index, text`` of documents with ``path, text`` and what ``prefix`` and
    ``summary`` need: one chunk for a summary that isn't blank, one for each paragraph, with its ``note`` where ``notes``
    (``chunk_id, note``) has one, and one for each of the first MOST_QUESTIONS entries of ``questions`` (``chunk_id, questions``)."""
    rows = documents.withColumns({"_prefix": F.coalesce(prefix, F.lit("")), "_summary": F.coalesce(stripped(summary), F.lit(""))})
    columns = ["chunk_id", "path", "chunk_type", "view", "chunk_index", "text"]
    head = lambda body: F.concat_ws("\n", F.when(F.col("_prefix") != "", F.col("_prefix")), body)
    first = rows.filter("_summary != ''").select(
        F.concat("path", F.lit("::summary")).alias("chunk_id"), "path", F.lit("summary").alias("chunk_type"), F.lit("summary").alias("view"), F.lit(-1).alias("chunk_index"), head(F.col("_summary")).alias("text")
    )
    paras = paragraph_chunks(rows, "path", "text").join(rows.select("path", "_prefix"), "path")
    paras = paras.join(notes.select("chunk_id", "note"), "chunk_id", "left") if notes is not None else paras.withColumn("note", F.lit(None).cast("string"))
    noted = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("[語境："), "note", F.lit("]")))
    raw = paras.select("chunk_id", "path", F.lit("paragraph").alias("chunk_type"), F.lit("raw").alias("view"), "chunk_index", head(F.concat_ws("\n", noted, "para")).alias("text"))
    out = first.select(*columns).unionByName(raw.select(*columns))
    if questions is not None:
        asked = paras.join(questions.select("chunk_id", F.slice(F.coalesce("questions", empty_strings()), 1, MOST_QUESTIONS).alias("_asked")), "chunk_id")
        each = asked.select("chunk_id", "path", "chunk_index", F.posexplode("_asked").alias("_k", "text")).filter("text != ''")
        out = out.unionByName(each.select(F.concat("chunk_id", F.lit("::q"), "_k").alias("chunk_id"), "path", F.lit("paragraph").alias("chunk_type"), F.lit("hyqe").alias("view"), "chunk_index", "text").select(*columns))
    return out


def chunks_of(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """The chunks of some paths."""
    return chunks.join(paths.select("path").distinct(), "path", "left_semi")


def section_texts(paragraph_rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_paragraphs, section``: sections put together again from ``sibling_order, para``."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sibling_order", "para"))), lambda s: s["para"]), "\n\n")
    return paragraph_rows.groupBy(*keys).agg(F.count("*").alias("n_paragraphs"), joined.alias("section"))


def parent_sections(hits: DataFrame, paragraph_rows: DataFrame) -> DataFrame:
    """Hits (``path``) with the ``title``, size and text of the section that the first chunk of their path stands in. Only the
    sections of paths that were hit are put together."""
    wanted = paragraph_rows.join(hits.select("path").distinct(), "path", "left_semi")
    first = wanted.groupBy("path").agg(F.min("section_no").alias("section_no"))
    whole = section_texts(wanted.join(first, ["path", "section_no"], "left_semi"), ["path", "section_no", "title"])
    return hits.join(whole.drop("section_no"), "path")
