"""Order-dependent figures over whole tables without one task for all: running sums and neighbours by parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut_lineage


def running_sum(rows: DataFrame, order: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Adds in ``out`` the sum of ``value`` over all rows before, in the order of ``order`` (which must tell the rows apart). The
    rows are sorted into ranges, each adds up its own, and the few sums of ranges are added up once."""
    parts = parts or rows.sparkSession.sparkContext.defaultParallelism
    placed = cut_lineage(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy("_range").agg(F.sum(value).alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("_range", ahead.alias("_ahead"))  # one row a range
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(out, inside).join(F.broadcast(offsets), "_range").withColumn(out, F.col(out) + F.col("_ahead")).drop("_range", "_ahead")


def with_previous(rows: DataFrame, key: str, at: str, tie: str, bucket: Column, out: str) -> DataFrame:
    """Adds in ``out`` the time of the row before with the same key (by ``at``, then ``tie``), null for the first. Each key is cut
    into buckets of time, so that one with very many rows is many tasks' work; the first row of a bucket gets the last time of
    the bucket with rows before it."""
    placed = rows.withColumn("_bucket", bucket)
    inside = F.lag(at).over(Window.partitionBy(key, "_bucket").orderBy(at, tie))
    lasts = placed.groupBy(key, "_bucket").agg(F.max(at).alias("_last"))
    carried = lasts.select(key, "_bucket", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket")).alias("_carried"))
    return placed.withColumn(out, inside).join(carried, [key, "_bucket"]).withColumn(out, F.coalesce(out, "_carried")).drop("_bucket", "_carried")
