"""Recall, reciprocal rank, strata, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_ranks(samples: DataFrame, key: str, expected: str, ranked: DataFrame, item: str) -> DataFrame:
    """``key, rank``: the best place of any expected item, null where none is ranked. ``ranked`` has ``key, item, rank``."""
    wanted = samples.select(key, F.explode(F.array_distinct(expected)).alias(item))
    hits = wanted.join(ranked.select(key, item, "rank"), [key, item]).groupBy(key).agg(F.min("rank").alias("rank"))
    return samples.join(hits, key, "left")


def metrics(ranks: DataFrame, *groups: str) -> DataFrame:
    """Counts, recall at 1, 5 and 10 and mean reciprocal rank; a sample without a rank counts as missed."""
    at = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return ranks.groupBy(*groups).agg(F.count("*").alias("n"), at(1).alias("recall_1"), at(5).alias("recall_5"), at(10).alias("recall_10"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def difference(now: DataFrame, then: DataFrame, key: str, value: str, drop: float = 0.02, same: float = 0.005) -> DataFrame:
    """Two reports side by side: worse by more than ``drop`` is a regression, within ``same`` unchanged."""
    both = now.select(key, F.col(value).alias("now")).join(then.select(key, F.col(value).alias("then")), key)
    delta = F.col("now") - F.col("then")
    verdict = F.when(delta < -drop, "regression").when(delta > same, "better").when(delta < -same, "worse").otherwise("same")
    return both.select(key, "now", "then", delta.alias("delta"), verdict.alias("verdict"))


def report(ranks: DataFrame, parts: dict[str, str]) -> DataFrame:
    """``part, name`` and the metrics: over all samples and by each of the columns named in ``parts``, in one pass by grouping sets."""
    columns = list(parts.values())
    sets = metrics(ranks.select("rank", F.explode(F.array(F.struct(F.lit("all").alias("part"), F.lit("all").alias("name")), *(F.struct(F.lit(p).alias("part"), F.col(c).alias("name")) for p, c in zip(parts, columns)))).alias("_g")).select("rank", "_g.*"), "part", "name")
    return sets


#: Parts of a stratum whose smallest hashes are found side by side.
PARTS = 64


def stratified(samples: DataFrame, key: str, stratum: Column, n: int, seed: str = "42") -> DataFrame:
    """n samples, every stratum in proportion and at least one; what rounding leaves too few or too many is given to or taken from
    the strata in turn, the largest first, up to four times each. Inside a stratum by the hash of seed and key."""
    sized = samples.withColumn("stratum", stratum)
    counts = sized.groupBy("stratum").agg(F.count("*").alias("size")).withColumn("total", F.sum("size").over(Window.partitionBy()))
    quota = F.least(F.col("size"), F.greatest(F.lit(1), F.round(F.lit(n) * F.col("size") / F.col("total")).cast("bigint")))
    first = counts.select("stratum", "size", quota.alias("quota")).withColumn("drift", F.lit(n) - F.sum("quota").over(Window.partitionBy()))
    room = F.least(F.lit(4), F.when(F.col("drift") > 0, F.col("size") - F.col("quota")).otherwise(F.col("quota") - 1))
    turns = first.withColumn("_room", room).filter("drift != 0 and _room > 0").select("stratum", "drift", "size", F.explode(F.sequence(F.lit(1), F.col("_room").cast("int"))).alias("_turn"))
    taken = turns.withColumn("_k", F.row_number().over(Window.orderBy("_turn", F.desc("size"), "stratum"))).filter("_k <= abs(drift)")
    moved = taken.groupBy("stratum").agg(F.sum(F.signum("drift")).cast("bigint").alias("_moved"))
    quotas = first.join(moved, "stratum", "left").select("stratum", (F.col("quota") + F.coalesce("_moved", F.lit(0))).alias("quota"))
    rows = sized.join(F.broadcast(quotas), "stratum").withColumns({"_hash": F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), "_part": F.pmod(F.xxhash64(key), F.lit(PARTS))})
    inside = F.row_number().over(Window.partitionBy("stratum", "_part").orderBy("_hash", key))
    few = rows.withColumn("_k", inside).filter("_k <= quota").drop("_k", "_part")
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("_hash", key))
    return few.withColumn("place", place).filter("place <= quota").drop("_hash")
