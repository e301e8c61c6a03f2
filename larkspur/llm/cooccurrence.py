"""Items that appear together, counted over collapsed baskets.

Every basket (here: one search) becomes a sorted array of item ids; equal arrays are merged into
one row with a weight, pairs are enumerated once per distinct array and their weights summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import cut_lineage

#: Baskets with more items than this are first freed of items that can't reach ``min_together``
#: and then enumerated in blocks of as many items, each block in its own row.
LARGE_BASKET = 256


def _hashes_collide(items: DataFrame) -> bool:
    return not items.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty()


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records with a 64-bit ``_id`` for each item, and what each stands for. Hashes serve, with no join, as long as no two items
    have the same; otherwise the items are numbered."""
    items = cut_lineage(pairs.groupBy("_item").count().select("_item", F.xxhash64("_item").alias("_h")))
    if not _hashes_collide(items):
        return pairs.select("_basket", F.xxhash64("_item").alias("_id")), items.select(F.col("_h").alias("_id"), F.col("_item").alias("_name"))
    names = cut_lineage(items.select(F.monotonically_increasing_id().alias("_id"), F.col("_item").alias("_name")))
    return pairs.join(names, pairs._item == names._name).select("_basket", "_id"), names


def pair_counts(records: DataFrame, basket: str, item: str, min_together: int = 8, min_lift: float = 2.0) -> DataFrame:
    """Pairs of items with their shared baskets and how far that exceeds chance.

    ``records`` has one row per item in a basket. Rows that lack either are left out; an item counts
    once per basket, however often its row is repeated; an empty table gives no pairs; other columns
    are ignored whatever their names. A pair comes once, the smaller item first, if it shares at least
    ``min_together`` baskets and at least ``min_lift`` times as many as by chance.

    Columns: ``item_a, item_b, n_a, n_b, n_ab, n_baskets, lift, conviction`` (conviction of a => b,
    null where b follows a always).
    """
    pairs = records.select(F.col(basket).alias("_basket"), F.col(item).alias("_item")).dropna()
    numbered, names = _numbered(pairs)
    collapsed = cut_lineage(
        numbered
        .groupBy("_basket").agg(F.sort_array(F.collect_set("_id")).alias("_ids"))
        .groupBy("_ids").agg(F.count("*").alias("_weight"))
    )
    total = collapsed.agg(F.sum("_weight")).first()[0] or 0
    counts = collapsed.select(F.explode("_ids").alias("_id"), "_weight").groupBy("_id").agg(F.sum("_weight").alias("_n"))

    def enumerate_pairs(baskets: DataFrame) -> DataFrame:
        rest = baskets.select("_ids", "_weight", F.posexplode("_ids").alias("_pos", "_a"))
        return rest.filter(F.col("_pos") < F.size("_ids") - 1).select(
            "_a", F.explode(F.slice("_ids", F.col("_pos") + 2, F.size("_ids"))).alias("_b"), "_weight"
        )

    small = enumerate_pairs(collapsed.filter(F.size("_ids").between(2, LARGE_BASKET)))
    together = small.unionByName(_large_pairs(collapsed.filter(F.size("_ids") > LARGE_BASKET), counts, min_together))
    together = together.groupBy("_a", "_b").agg(F.sum("_weight").alias("n_ab")).filter(F.col("n_ab") >= min_together)

    found = together
    for side in "ab":
        found = found.join(counts.select(F.col("_id").alias(f"_{side}"), F.col("_n").alias(f"_n_{side}")), f"_{side}")
    lift = F.col("n_ab") * F.lit(total).cast("double") / (F.col("_n_a") * F.col("_n_b"))
    found = found.filter(F.col("n_ab") * F.lit(total) >= F.lit(min_lift) * F.col("_n_a") * F.col("_n_b"))
    for side in "ab":
        found = found.join(names.select(F.col("_id").alias(f"_{side}"), F.col("_name").alias(f"_name_{side}")), f"_{side}")
    swap = F.col("_name_a") > F.col("_name_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    out = found.select(
        pick("_name_a", "_name_b").alias("item_a"), pick("_name_b", "_name_a").alias("item_b"),
        pick("_n_a", "_n_b").alias("n_a"), pick("_n_b", "_n_a").alias("n_b"),
        "n_ab", F.lit(total).cast("bigint").alias("n_baskets"), lift.alias("lift"),
    )
    never = 1 - F.col("n_ab") / F.col("n_a")
    return out.withColumn("conviction", F.when(never > 0, (1 - F.col("n_b") / F.col("n_baskets")) / never))


def _large_pairs(large: DataFrame, counts: DataFrame, min_together: int) -> DataFrame:
    """The same pairs for baskets of any size: items too rare for any pair go first, the rest is spread by blocks."""
    kept = (
        large.withColumn("_key", F.xxhash64("_ids")).select("_key", "_weight", F.explode("_ids").alias("_id"))
        .join(counts.filter(F.col("_n") >= min_together), "_id", "left_semi")
        .groupBy("_key", "_weight").agg(F.sort_array(F.collect_set("_id")).alias("_ids"))
    )
    block = F.explode(F.sequence(F.lit(0), F.floor((F.size("_ids") - 1) / LARGE_BASKET).cast("int"))).alias("_block")
    blocks = kept.select("_key", "_ids", "_weight", block).repartition("_key", "_block")
    first = F.posexplode(F.slice("_ids", F.col("_block") * LARGE_BASKET + 1, F.lit(LARGE_BASKET))).alias("_pos", "_a")
    rows = blocks.select("_ids", "_weight", "_block", first)
    after = F.col("_block") * LARGE_BASKET + F.col("_pos") + 2
    return rows.filter(after <= F.size("_ids")).select(
        "_a", F.explode(F.slice("_ids", after, F.size("_ids"))).alias("_b"), "_weight"
    )
