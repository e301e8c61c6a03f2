"""What comes in from outside: dropped files, exported chats, caches, logs, evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T

#: Files that are never taken in.
SKIP_NAMES = ("README.md", "README.txt", ".gitkeep", ".DS_Store")
QUESTIONS = "key string, questions array<string>"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def may_come_in(path: Column) -> Column:
    """Whether a dropped file is to be taken in: ``.pages``, ``.md`` or ``.txt``, no draft, hidden file or read-me."""
    name = file_name(path)
    return name.rlike(r"(?i)\.(pages|md|txt)$") & ~name.rlike("^[_.]") & ~name.isin(*SKIP_NAMES)


def scan_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, content`` of the files that lie in a folder, not below it."""
    files = spark.read.format("binaryFile").load(folder)
    return files.filter(may_come_in(F.col("path"))).select("path", "length", "content")


def to_enrich(files: DataFrame, only: str | None = None) -> DataFrame:
    """Files (``path, text``) that an extractor has yet to read: not of the system or the profile, and without its mark. ``only``
    names a single file, which is taken whatever it is."""
    if only is not None:
        return files.filter(F.col("path") == only)
    name = file_name(F.col("path"))
    return files.filter(F.col("path").endswith(".md") & ~F.col("path").rlike(r"(^|/)(00_System|10_Profile)/") & ~name.isin("README.md", ".cursorrules") & ~F.coalesce("text", F.lit("")).contains("enriched_at:"))


def imported_chats(files: DataFrame, as_of: Column) -> DataFrame:
    """Exported chats (``path, text``) as memories: ``path, uuid, title, date_created, tags, summary, text``, the last with a header. The title
    is the file's name without its hash, else the first plain line; the date that of the backup, else ``as_of``. A text that has a header
    stays as it is."""
    name, body = file_name(F.col("path")), F.coalesce("text", F.lit(""))
    stem = T.stem_of(F.col("path"))
    short = F.regexp_replace(stem, "_[0-9a-f]{8,}$", "")
    lines = F.filter(F.transform(F.split(body, "\n"), T.stripped), lambda s: (s != "") & ~s.startswith(">") & ~s.startswith("#"))
    title = F.when((short != "") & (short != stem), T.stripped(short)).otherwise(F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, 60), stem))
    backed_up = F.regexp_extract(body, r"備份時間：\s*(\d{4}/\d{2}/\d{2})", 1)
    day = F.when(backed_up != "", F.replace(backed_up, F.lit("/"), F.lit("-"))).otherwise(F.date_format(as_of, "yyyy-MM-dd"))
    told = F.filter(lines, lambda s: ~s.startswith("---") & (F.char_length(s) > 10))
    summary = F.replace(F.substring(F.array_join(F.slice(told, 1, 3), " "), 1, 150), F.lit('"'), F.lit("'"))
    rows = files.select("path", F.substring(F.md5(name), 1, 12).alias("uuid"), title.alias("title"), day.alias("date_created"), T.inferred_tags(body).alias("tags"), summary.alias("summary"), body.alias("_body"))
    header = F.format_string('---\nuuid: "%s"\ntitle: "%s"\ndate_created: %s\ndate_updated: %s\ntype: "chat"\nsource: "gemini"\ntags: %s\nsummary: "%s"\n---\n\n', "uuid", "title", "date_created", "date_created", F.to_json("tags"), "summary")
    return rows.withColumn("text", F.when(T.stripped(F.col("_body")).startswith("---"), F.col("_body")).otherwise(F.concat(header, "_body"))).drop("_body")


def read_cache(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """``key, value`` of a cache kept as one JSON object (keys to values of one type); none where there is no such file or it is broken."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"key string, value {value}")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return whole.filter("m is not null").select(F.explode("m").alias("key", "value"))


def append_cache(answers: DataFrame, folder: str) -> None:
    """New answers (``key`` and others) are appended to a cache kept as a table; those it has stay."""
    spark = answers.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fresh = answers.dropDuplicates(["key"])
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        fresh = fresh.join(spark.read.parquet(folder).select("key"), "key", "left_anti")
    fresh.write.mode("append").parquet(folder)


def question_samples(cache: DataFrame) -> DataFrame:
    """``key, path, question``: the first question of every chunk (``key`` is ``path::para0``, ``questions`` a list) that has any."""
    first = F.get("questions", F.lit(0))
    return cache.filter(F.size("questions") > 0).select("key", F.substring_index("key", "::para", 1).alias("path"), first.alias("question")).filter("question is not null")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """``muse, key, query, expected_paths, tags`` of an evaluation set in YAML; a single path may stand for a list. The file is
    written by hand, and so read on the driver."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    listed = lambda v: [v] if isinstance(v, str) else [str(x) for x in v or []]
    found = yaml.safe_load(text["value"]) if text else {}
    rows = [(muse, f"{muse}#{k}", e["query"], listed(e.get("expected_paths")), listed(e.get("tags"))) for muse, entries in (found or {}).items() for k, e in enumerate(entries or []) if e.get("query")]
    return spark.createDataFrame(rows, "muse string, key string, query string, expected_paths array<string>, tags array<string>")


def read_log(spark: SparkSession, path: str, schema: str, log_id: str | None = None) -> DataFrame:
    """Rows of a log of JSON lines, or the one with an id."""
    rows = spark.read.schema(schema).json(path)
    return rows if log_id is None else rows.filter(F.col("id") == log_id)


def append_accesses(found: DataFrame, folder: str, at: Column, source: str = "search") -> None:
    """Logs that paths (``path``) were read, all with one time; the log is a table that is only appended to."""
    rows = found.filter("path is not null").select(F.col("path").alias("memory_path"), at.alias("accessed_at"), F.lit(source).alias("source"))
    rows.write.mode("append").parquet(folder)
