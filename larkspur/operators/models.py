"""Outside models (extractors, judges, encoders) as injected functions over batches; none is called by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import fit_array, json_object


def apply_model(rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``model`` on each batch of rows, inside the tasks; it gives columns as named in ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)


def only_missing(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows for which the cache has no answer yet."""
    return rows.join(cache.select(key).distinct(), key, "left_anti")


def read_answer(answers: DataFrame, column: str, schema: str) -> DataFrame:
    """The outermost JSON object of a noisy answer, read by schema; null where there is none."""
    return answers.withColumn(column, F.from_json(json_object(F.col(column)), schema))


def fixed_questions(answers: DataFrame, column: str, most: int = 5) -> DataFrame:
    """Lists of questions cut or padded to the same length."""
    return answers.withColumn(column, fit_array(F.col(column), most))


def with_verdicts(claims: DataFrame, verdicts: DataFrame, on: list[str], default: str = "supported") -> DataFrame:
    """Claims with a judge's verdict; those that it passed over count as ``default``."""
    return claims.join(verdicts.select(*on, "verdict"), on, "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def critique_gate(rows: DataFrame, least: str = "medium") -> DataFrame:
    """Rows important enough for a second look."""
    rank = F.when(F.col("importance") == "high", 2).when(F.col("importance") == "medium", 1).when(F.col("importance") == "low", 0)
    return rows.filter(rank >= {"low": 0, "medium": 1, "high": 2}[least])
