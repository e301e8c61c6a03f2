"""Reading a vault of markdown files, and writing the tables that follow from it."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.dates import stem_date
from larkspur.functions.text import empty_strings, stem_of, wikilinks

#: Never read as memories.
SKIPPED = r"(^|/)(00_System/|README\.md$|\.cursorrules$)"
FRONT = (
    "title string, date_created string, type string, source string, tags array<string>, summary string, period string, themes array<string>, "
    "personal_facts array<string>, locations array<string>, people array<string>, events array<string>, emotions array<string>, enriched boolean, dormant boolean, body string"
)


def read_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """``path, text`` of the files below a folder, paths relative to it; system files are left out."""
    root = re.sub(r"/+$", "", re.sub(r"^file:/*", "/", folder))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root) + "/", "")
    return files.select(path.alias("path"), F.decode("content", "UTF-8").alias("text")).filter(~F.col("path").rlike(SKIPPED))


def split_front(text: str) -> tuple[str, str]:
    """The header between the first two lines of dashes, and the rest."""
    if not text.startswith("---"):
        return "", text
    end = text.find("\n---", 3)
    if end < 0:
        return "", text
    return text[3:end], text[text.find("\n", end + 1) + 1 :] if "\n" in text[end + 1 :] else ""


def _as_list(value: object) -> list[str]:
    if value is None or value == "":
        return []
    if isinstance(value, list):
        return [str(v) for v in value if v is not None]
    return [v.strip().strip("\"'") for v in str(value).strip("[]").split(",") if v.strip()]


def read_header(header: str) -> dict:
    """YAML where that can be read, else its lines ``key: value``."""
    lines = "\n".join(x for x in header.split("\n") if not x.lstrip().startswith("#"))
    try:
        import yaml

        found = yaml.safe_load(lines)
        if isinstance(found, dict):
            return found
    except Exception:  # any malformed header
        pass
    return {k.strip(): v.strip().strip("\"'") for k, _, v in (x.partition(":") for x in lines.split("\n")) if v and re.fullmatch(r"\w+", k.strip())}


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, text in batch.itertuples(index=False, name=None):
            header, body = split_front(text or "")
            f = read_header(header)
            e = f.get("entities") if isinstance(f.get("entities"), dict) else {}
            text_of = lambda k: None if f.get(k) is None else str(f[k])
            rows.append({
                "path": path, **{k: text_of(k) for k in ("title", "date_created", "type", "source", "summary", "period")}, **{k: _as_list(f.get(k)) for k in ("tags", "themes", "personal_facts")},
                **{k: _as_list(e.get(k, f.get(f"entities.{k}"))) for k in ("locations", "people", "events", "emotions")}, "enriched": bool(f.get("enriched_at")),
                "dormant": str(f.get("dormant")).strip().lower() in ("true", "yes", "1"), "body": body,
            })
        yield pd.DataFrame(rows, columns=["path", *(x.strip().split(" ")[0] for x in re.sub(r"<[^>]*>", "", FRONT).split(","))])


def parse_documents(files: DataFrame) -> DataFrame:
    """Header fields and body of each file; a file without a header is all body, a null text an empty one."""
    return files.select("path", "text").mapInPandas(_parsed, "path string, " + FRONT)


def page_text(raw: bytes) -> str:
    """Readable runs inside a ``.pages`` archive, each once, in order."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            data = archive.read("Index/Document.iwa")
    except (zipfile.BadZipFile, KeyError):
        return ""
    runs = re.findall(r"[一-鿿　-〿＀-￯\w ,.!?:;'\"()-]{4,}", data.decode("utf-8", "ignore"))
    return "\n".join(dict.fromkeys(r.strip() for r in runs if len(re.findall(r"[^\W\d_]", r)) >= 4))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [page_text(bytes(c)) for c in batch["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pages").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(texts, "path string, text string")


def semantic_index(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of inverted lists: ``tag, path`` and ``entity, path`` (targets of wiki links in the body), each once. A tag of very many
    documents stays many rows."""
    tags = documents.select(F.explode(F.coalesce("tags", empty_strings())).alias("tag"), "path").distinct()
    links = documents.select(F.explode(wikilinks(F.coalesce("body", F.lit("")))).alias("entity"), "path").distinct()
    return tags, links


def awake(documents: DataFrame) -> DataFrame:
    """Parsed documents that are indexed: those that aren't dormant."""
    return documents.filter(~F.coalesce("dormant", F.lit(False)))


def with_header(documents: DataFrame) -> DataFrame:
    """``path, text``: documents put together again, with a header of their fields (lists as JSON) and their body."""
    plain = [F.concat(F.lit(f'{k}: "'), F.replace(k, F.lit('"'), F.lit("'")), F.lit('"')) for k in ("title", "date_created", "type", "source", "summary", "period")]
    lists = [F.when(F.size(F.coalesce(k, empty_strings())) > 0, F.concat(F.lit(f"{k}: "), F.to_json(k))) for k in ("tags", "themes", "personal_facts")]
    named = [F.when(F.size(F.coalesce(k, empty_strings())) > 0, F.concat(F.lit(f"  {k}: "), F.to_json(k))) for k in ("locations", "people", "events", "emotions")]
    entities = F.concat_ws("\n", *named)
    lines = F.concat_ws("\n", *plain, *lists, F.when(entities != "", F.concat(F.lit("entities:\n"), entities)), F.when(F.coalesce("dormant", F.lit(False)), "dormant: true"))
    return documents.select("path", F.concat(F.lit("---\n"), lines, F.lit("\n---\n"), F.coalesce("body", F.lit(""))).alias("text"))


def journals_of(pages: DataFrame, as_of: Column) -> DataFrame:
    """Texts of ``.pages`` files (``path, text``) as journal documents ``path, title, date_created, type, text`` below their year; those without
    text are left out. The date is that of the file's name, else ``as_of``."""
    stem = stem_of(F.col("path"))
    day = F.coalesce(stem_date(stem), as_of)
    return pages.filter("text != ''").select(F.concat(F.lit("30_Journal/"), F.year(day), F.lit("/"), stem, F.lit(".md")).alias("path"), stem.alias("title"), F.date_format(day, "yyyy-MM-dd").alias("date_created"), F.lit("journal").alias("type"), "text")


def write_routed(documents: DataFrame, folder: str) -> None:
    """Documents below their area and year, those already written (by name) left alone."""
    spark = documents.sparkSession
    placed = documents.withColumn("area", F.element_at(F.split("path", "/"), 1)).withColumn("year", F.substring(F.coalesce("date_created", F.lit("none")), 1, 4)).withColumn("stem", stem_of(F.col("path")))
    try:
        places = placed.select("area", "year").distinct()  # folders: only theirs are read
        there = spark.read.parquet(folder).select("path", F.col("area").cast("string").alias("area"), F.col("year").cast("string").alias("year")).join(F.broadcast(places), ["area", "year"], "left_semi")
        placed = placed.join(there.select("path").distinct(), "path", "left_anti")
    except Exception as problem:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER_SCHEMA" not in str(problem):
            raise
    placed.write.mode("append").partitionBy("area", "year").parquet(folder)
