"""Exact vector search, mean vectors and routing by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that a task is given at once; of more, the vectors are read once for each such block.
MOST_QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where the widths differ."""
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _unit(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors have that width and a length, and those, normalised."""
    fits = np.fromiter((v is not None and len(v) == width for v in vectors), bool, len(vectors))
    rows = np.array([np.asarray(v, np.float64) for v in vectors[fits]]).reshape(-1, width)
    length = np.sqrt((rows * rows).sum(axis=1))
    fits[np.flatnonzero(fits)[length == 0]] = False
    return fits, rows[length > 0] / length[length > 0, None]


def _blocks(queries: DataFrame) -> Iterator[tuple[list, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """The stated queries in blocks: their ids, and by width which of them and their normalised vectors."""
    rows = queries.select("query_id", "vector").dropna()
    parts = max(1, -(-rows.count() // MOST_QUERIES))
    for k in range(parts):
        some = rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k).toPandas() if parts > 1 else rows.toPandas()
        by_width = {}
        for width in {len(v) for v in some["vector"]}:
            fits, unit = _unit(some["vector"], width)
            by_width[width] = (np.flatnonzero(fits), unit)
        yield some["query_id"].tolist(), by_width


def _types(vectors: DataFrame, key: str, queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double"


def _scored(vectors: DataFrame, key: str, vector: str, queries: DataFrame, pick) -> DataFrame:
    """What ``pick(scores, keys)`` leaves of each batch of vectors: rows and columns of the matrix of cosines."""
    out = None
    for ids, by_width in _blocks(queries):

        def work(batches: Iterator[pd.DataFrame], ids=ids, by_width=by_width) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for width, (asked, unit) in by_width.items():
                    fits, own = _unit(batch[vector], width)
                    if len(own) and len(unit):
                        keys = batch[key][fits].to_numpy()
                        scores = own @ unit.T
                        rows, columns = pick(scores, keys)
                        yield pd.DataFrame({"query_id": [ids[q] for q in asked[columns]], key: keys[rows], "score": scores[rows, columns]})

        part = vectors.select(key, vector).filter(F.col(key).isNotNull()).mapInPandas(work, _types(vectors, key, queries))
        out = part if out is None else out.unionByName(part)
    return out


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """``query_id, key, score, rank``: the k nearest by cosine (rounded to ``digits``) of each row of ``queries`` (``query_id,
    vector``), which are set against all vectors in blocks; each batch of vectors keeps k a query and those that
    tie with them before anything is shuffled. Ties go to the smaller key. Null vectors and those of other widths or without a length are left out."""

    def pick(scores: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(keys) <= k:
            return tuple(np.indices(scores.shape).reshape(2, -1))
        least = np.partition(scores, len(keys) - k, axis=0)[len(keys) - k]
        return np.nonzero(scores >= least - 2 * 10.0**-digits)

    found = _scored(vectors, key, vector, queries, pick).withColumn("score", F.round("score", digits))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_per_group(vectors: DataFrame, group: str, vector: str, queries: DataFrame) -> DataFrame:
    """``query_id, group, score``: the best cosine of each query in each group of vectors (chunks of one memory)."""

    def pick(scores: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        rows, columns = [], []
        for begin, end in zip(bounds, [*bounds[1:], len(keys)]):
            rows.append(order[begin:end][scores[order[begin:end]].argmax(axis=0)])
            columns.append(np.arange(scores.shape[1]))
        return np.concatenate(rows), np.concatenate(columns)

    return _scored(vectors, group, vector, queries, pick).groupBy("query_id", group).agg(F.max("score").alias("score"))


def within(vectors: DataFrame, key: str, vector: str, queries: DataFrame, least: float) -> DataFrame:
    """``query_id, key, score`` of all vectors whose cosine with a query is at least ``least``."""
    return _scored(vectors, key, vector, queries, lambda scores, keys: np.nonzero(scores >= least))


def mean_vectors(vectors: DataFrame, group: str, vector: str, least: int = 3) -> DataFrame:
    """``group, n, vector``: normalised mean of each group with ``least`` vectors or more, summed by place in parallel."""
    placed = vectors.select(group, F.posexplode(vector).alias("_at", "_x"))
    means = placed.groupBy(group, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_mean"), F.count("*").alias("_n"))
    whole = means.groupBy(group).agg(F.max("_n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_at", "_mean"))), lambda s: s["_mean"]).alias("_v"))
    return whole.filter(F.col("n") >= least).select(group, "n", F.transform("_v", lambda x: x / norm(F.col("_v"))).alias("vector"))


def route(queries: DataFrame, centroids: DataFrame, group: str, k: int = 3, threshold: float = 0.15) -> DataFrame:
    """``query_id, group, score``: the k groups whose mean is nearest to each query, from ``threshold`` on."""
    found = nearest(centroids.withColumnRenamed("vector", "_v"), group, "_v", queries, k)
    return found.filter(F.col("score") >= threshold)
