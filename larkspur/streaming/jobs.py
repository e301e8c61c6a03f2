"""Structured Streaming jobs: incremental indexing, deduplication, activation as events arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.functions.text import plain_path
from larkspur.sources.inbox import may_come_in


def watch_table(spark: SparkSession, folder: str, schema: object, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def watch_vault(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they are dropped into a folder, those that may come in: ``path, length, content``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return files.filter(may_come_in(F.col("path"))).select("path", "length", "content")


def debounced(events: DataFrame, key: str, at: str, within: str = "2 seconds") -> DataFrame:
    """Of events with the same key less than ``within`` apart only the first."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


#: Folders that a table is divided into by its keys, so that a batch reads those of its own keys only.
PARTS = 64


def append_new(fresh: DataFrame, target: str, keys: list[str], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends rows whose keys aren't in the table yet; a batch that is delivered again adds nothing. The table is divided by the
    hash of its keys (column ``_part``), and a batch is compared with its own parts."""

    def write(batch: DataFrame, _: int) -> None:
        rows = (prepare(batch) if prepare else batch).dropDuplicates(keys).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))
        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            parts = [r["_part"] for r in rows.select("_part").distinct().collect()]  # not more than PARTS
            rows = rows.join(spark.read.parquet(target).filter(F.col("_part").isin(parts)).select(*keys), keys, "left_anti")
        rows.write.mode("append").partitionBy("_part").parquet(target)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def access_counts(events: DataFrame, lateness: str = "3 days", window: str = "1 hour") -> DataFrame:
    """``memory_path, window, n``: accesses per memory and window, each event once, late ones up to ``lateness``."""
    seen = events.filter("memory_path is not null and accessed_at is not null").withColumn("at", F.col("accessed_at").cast("timestamp")).withWatermark("at", lateness)
    once = seen.dropDuplicatesWithinWatermark(["id"]).withColumn("memory_path", plain_path(F.col("memory_path")))
    return once.groupBy("memory_path", F.window("at", window)).agg(F.count("*").alias("n"))


def recent_accesses(events: DataFrame, keep: int = 50) -> DataFrame:
    """``memory_path, times``: the last ``keep`` different times at which each memory was read, newest first, from which the activation can be
    computed at any time (its power law can't be carried along in a single number). That is all the state that a memory has."""
    seen = events.filter("memory_path is not null and accessed_at is not null").select(plain_path(F.col("memory_path")).alias("memory_path"), F.col("accessed_at").cast("timestamp").alias("at"))

    def last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = set(state.get[0]) if state.exists else set()
        for batch in batches:
            times = set(sorted(times | {int(x.value) // 1000 for x in batch["at"]}, reverse=True)[:keep])
        newest = sorted(times, reverse=True)
        state.update((newest,))
        yield pd.DataFrame({"memory_path": [key[0]], "times": [[pd.Timestamp(t, unit="us") for t in newest]]})

    return seen.groupBy("memory_path").applyInPandasWithState(last, "memory_path string, times array<timestamp>", "times array<bigint>", "update", GroupStateTimeout.NoTimeout)
