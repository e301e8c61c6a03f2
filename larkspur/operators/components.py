"""Connected components of any edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from larkspur.session import cut_lineage

#: Different edges up to which one task finds all components; of more, rounds of joins do.
MOST_IN_A_TASK = 500_000


def _components_of(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``node, component`` of edges ``u, v`` without nulls, each node led to the smallest that it is linked with."""
    above: dict = {}

    def root(node: object) -> object:
        while (up := above[node]) != node:
            above[node] = node = above[up]
        return node

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(above.setdefault(u, u)), root(above.setdefault(v, v))
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([root(x) for x in nodes], schema.field(1).type)], schema=schema)


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int | None = None) -> DataFrame:
    """``node, component`` of all nodes that have an edge; the component is its smallest node.

    Up to MOST_IN_A_TASK edges are worked off in one task, unless rounds are bounded by the caller, as each round is some jobs
    that the driver has to plan. Of more edges, each round is two joins and aggregations on single edges, whatever the shape of the graph: no group is
    gathered in one place. Null ends and loops are left out, repeated edges count once; an empty table
    gives no rows. Raises where ``most_rounds`` (50 where none are given) don't suffice.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    both = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    stars = cut_lineage(edges.filter(both).select(high.alias("u"), low.alias("v")).distinct())
    if most_rounds is None and stars.count() <= MOST_IN_A_TASK:
        kinds = StructType([StructField(c, stars.schema["u"].dataType) for c in ("node", "component")])
        schema = to_arrow_schema(kinds)
        return stars.coalesce(1).mapInArrow(lambda batches: _components_of(batches, schema), kinds)
    most_rounds = 50 if most_rounds is None else most_rounds
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    mark = state(stars)
    for _ in range(most_rounds if mark[0] else 0):
        around = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # of each node's smaller neighbours the smallest takes the others, repeated ones going with the next step
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        stars = cut_lineage(small.distinct())
        now = state(stars)
        if now == mark:
            break
        mark = now
    else:
        if mark[0]:
            raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
