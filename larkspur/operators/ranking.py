"""Fusing ranked lists and moving scores by domain, time and use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def with_rank(scored: DataFrame, within: list[str], item: str, score: str = "score") -> DataFrame:
    """Each item once per list at its best score, with its place in it; ties go to the smaller item."""
    best = scored.groupBy(*within, item).agg(F.max(score).alias(score))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(score), F.asc(item))))


def fuse(lists: DataFrame, within: list[str], item: str, weight: Column | float = 1.0, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank) over the lists that have the item."""
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return lists.groupBy(*within, item).agg(F.sum(weight / (F.lit(k) + F.col("rank"))).alias("score"), F.count("*").alias("n_lists"))


def flat_boost(score: Column, match: Column, factor: float = 1.3) -> Column:
    return F.when(match, score * factor).otherwise(score)


def confidence_boost(score: Column, match: Column, confidence: Column, threshold: float = 0.2, k: float = 2.0, most: float = 1.5) -> Column:
    return F.when(match, score * F.least(1 + F.greatest(F.lit(0.0), confidence - threshold) * k, F.lit(most))).otherwise(score)


def penalty(score: Column, match: Column, confidence: Column, threshold: float = 0.2, k: float = 0.5, least: float = 0.85) -> Column:
    """Only what doesn't match loses, the more the surer the router is."""
    return F.when(match, score).otherwise(score * F.greatest(1 - F.greatest(F.lit(0.0), confidence - threshold) * k, F.lit(least)))


def activation(accesses: DataFrame, item: str, at: str, as_of: Column, decay: float = 0.5) -> DataFrame:
    """``item, activation, n``: log of the summed powers of the hours since each access (at least 0.01)."""
    hours = F.timestamp_diff("MICROSECOND", F.col(at), as_of) / 3.6e9
    strength = F.pow(F.greatest(hours, F.lit(0.01)), F.lit(-decay))
    return accesses.filter(F.col(item).isNotNull() & F.col(at).isNotNull()).groupBy(item).agg(F.log(F.sum(strength)).alias("activation"), F.count("*").alias("n"))


def blend_activation(ranked: DataFrame, activations: DataFrame, item: str, within: list[str], weight: float = 0.2) -> DataFrame:
    """Adds ``weight`` times the activation, as a share of the list's highest where that is positive; 0 without one."""
    joined = ranked.join(activations.select(item, "activation"), item, "left").withColumn("activation", F.coalesce("activation", F.lit(0.0)))
    top = F.max("activation").over(Window.partitionBy(*within))
    return joined.withColumn("score", F.when(top > 0, F.col("score") + weight * F.col("activation") / top).otherwise(F.col("score")))


def by_place(ranked: DataFrame) -> DataFrame:
    """Lists whose own scores aren't comparable (graph hits) scored by place: 1 / rank."""
    return ranked.withColumn("score", 1.0 / F.col("rank"))


def with_confidence(ranked: DataFrame, memberships: DataFrame, routed: DataFrame) -> DataFrame:
    """Adds ``confidence``, the router's highest score (``query_id, domain, score``) among the domains of the path
    (``path, domain``; there may be several), null where it chose none of them, and ``surest``, its highest for the query."""
    own = ranked.select("query_id", "path").join(memberships.select("path", "domain"), "path").join(routed.select("query_id", "domain", F.col("score").alias("_s")), ["query_id", "domain"])
    best = own.groupBy("query_id", "path").agg(F.max("_s").alias("confidence"))
    surest = routed.groupBy("query_id").agg(F.max("score").alias("surest"))
    return ranked.join(best, ["query_id", "path"], "left").join(surest, "query_id", "left")


def by_domain(ranked: DataFrame, mode: str, boost: float = 1.3) -> DataFrame:
    """Scores moved by the router (columns of `with_confidence`): ``hard`` keeps what it chose, where it chose anything;
    ``flat`` and ``confidence`` raise it; ``penalty`` lowers the rest."""
    match, score = F.col("confidence").isNotNull(), F.col("score")
    if mode == "hard":
        return ranked.filter(match | F.col("surest").isNull())
    moved = {
        "flat": flat_boost(score, match, boost), "confidence": confidence_boost(score, match, F.col("confidence")),
        "penalty": penalty(score, match, F.coalesce("surest", F.lit(0.0))),
    }
    return ranked.withColumn("score", moved[mode])
