"""Memories and their log: one current row each, sessions, forgetting, names, edits, checks against the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.dates import loose_date
from larkspur.functions.text import empty_strings, high_risk, name_key, plain_path, replace_unique


def current_memories(memories: DataFrame) -> DataFrame:
    """The latest delivery of each memory, its type in lower case, ``dormant`` a boolean and ``date`` a date."""
    latest = Window.partitionBy("memory_id").orderBy(F.desc_nulls_last("date_updated"), F.desc_nulls_last("importance"), F.desc_nulls_last("dormant"))
    one = memories.withColumn("_nth", F.row_number().over(latest)).filter("_nth = 1").drop("_nth")
    return one.withColumns({
        "type": F.lower("type"), "dormant": F.coalesce(F.lower(F.trim("dormant")).isin("true", "yes", "1"), F.lit(False)), "memory_path": plain_path(F.col("memory_path")), "date": loose_date(F.col("date_created")),
    })


def accesses(events: DataFrame) -> DataFrame:
    """Each event once, with the memory's own path; those without path or time are left out."""
    return events.filter("memory_path is not null and accessed_at is not null").select("id", plain_path(F.col("memory_path")).alias("memory_path"), "accessed_at", "source").dropDuplicates(["id"])


#: Items of a session that one row pairs with those behind them.
BLOCK = 256


def co_recalled(events: DataFrame, session: Column, item: str, least: int = 3) -> DataFrame:
    """``a, b, strength``: pairs of items in the same session, the smaller first, with the sessions they share. Sessions with the
    same items are paired once; items that are in fewer than ``least`` sessions go before; a large session is paired in blocks."""
    rows = events.select(session.alias("_s"), F.col(item).alias("_i")).dropna().distinct()
    often = rows.groupBy("_i").count().filter(F.col("count") >= least).select("_i")
    baskets = rows.join(often, "_i", "left_semi").groupBy("_s").agg(F.array_sort(F.collect_set("_i")).alias("_items")).filter(F.size("_items") > 1)
    collapsed = baskets.groupBy("_items").agg(F.count("*").alias("_w"))
    blocks = collapsed.select("_items", "_w", F.explode(F.sequence(F.lit(0), F.floor((F.size("_items") - 1) / BLOCK).cast("int"))).alias("_b"))
    firsts = blocks.select("_items", "_w", "_b", F.posexplode(F.slice("_items", F.col("_b") * BLOCK + 1, F.lit(BLOCK))).alias("_k", "a"))
    behind = F.col("_b") * BLOCK + F.col("_k") + 2
    pairs = firsts.filter(behind <= F.size("_items")).select("a", F.explode(F.slice("_items", behind, F.size("_items"))).alias("b"), "_w")
    return pairs.groupBy("a", "b").agg(F.sum("_w").alias("strength")).filter(F.col("strength") >= least)


def forgettable(memories: DataFrame, activations: DataFrame, threshold: float = -1.0, missing: float = 0.0) -> DataFrame:
    """Memories that may go dormant: awake, of low importance, and activated no more than ``threshold``; those never
    read count as ``missing``."""
    joined = memories.join(activations.select("memory_path", "activation"), "memory_path", "left").withColumn("activation", F.coalesce("activation", F.lit(missing)))
    return joined.filter(~F.col("dormant") & (F.col("importance") == "low") & (F.col("activation") <= threshold))


def name_groups(nodes: DataFrame, name: str, degree: DataFrame) -> DataFrame:
    """Names that become equal in lower case without separators: ``key, names, canonical`` (the one with most edges)."""
    keyed = nodes.select(F.col(name).alias("name")).distinct().withColumn("key", name_key(F.col("name")))
    joined = keyed.join(degree, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    grouped = joined.groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("names"), F.min(F.struct(-F.col("degree"), F.col("name").alias("best"))).alias("_best"))
    return grouped.filter(F.size("names") > 1).select("key", "names", F.col("_best.best").alias("canonical"))


def merge_nodes(edges: DataFrame, label: str, to: DataFrame) -> DataFrame:
    """Edges with the nodes of a label renamed (``name, canonical``); equal edges become one with its earliest times."""
    for end in ("src", "dst"):
        names = to.select(F.col("name").alias(end), F.lit(label).alias(f"{end}_label"), F.col("canonical").alias("_to"))
        edges = edges.join(names, [end, f"{end}_label"], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    keys = ["rel", "src_label", "src", "dst_label", "dst"]
    return edges.groupBy(*keys).agg(F.min("t_valid_start").alias("t_valid_start"), F.min("t_ingested").alias("t_ingested"), F.min("evidence").alias("evidence"))


def aliases_after_merge(nodes: DataFrame, to: DataFrame) -> DataFrame:
    """``canonical, aliases``: names and aliases of all merged nodes without the canonical name."""
    joined = nodes.select("name", "aliases").join(to, "name")
    spread = joined.select("canonical", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", empty_strings()))).alias("alias")).filter("alias != canonical")
    return spread.groupBy("canonical").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def alias_map(nodes: DataFrame) -> DataFrame:
    """``alias_key, name``: every alias and the name itself under its key; a key of several names goes to the first."""
    spread = nodes.select("name", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", empty_strings()))).alias("alias"))
    return spread.select(name_key(F.col("alias")).alias("alias_key"), "name").filter("alias_key != ''").groupBy("alias_key").agg(F.min("name").alias("name"))


def validated(rows: DataFrame, source: str) -> DataFrame:
    """Entities and facts that the source text bears out. Places, people and feelings must stand in it, pronouns are no
    people; of an event any word; at most five facts with a word of theirs in it, at most four themes."""
    text = F.coalesce(F.col(source), F.lit(""))
    trimmed = lambda x: F.trim(x)
    in_text = lambda x: (F.char_length(trimmed(x)) > 0) & text.contains(trimmed(x))
    any_word = lambda x: F.exists(F.regexp_extract_all(x, F.lit("([a-zA-Z0-9]{2,}|[\\u4e00-\\u9fff]{2,})"), 1), lambda w: text.contains(w))
    pronouns = ("我", "你", "他", "她", "我們", "他們")
    get = lambda k: F.coalesce(F.col(f"entities.{k}"), empty_strings())
    return rows.withColumns({
        "locations": F.filter(get("locations"), in_text), "people": F.filter(get("people"), lambda x: in_text(x) & ~x.isin(*pronouns)), "emotions": F.filter(get("emotions"), in_text),
        "events": F.filter(get("events"), any_word), "period": F.when(any_word(F.coalesce("period", F.lit(""))), F.col("period")).otherwise(""),
        "facts": F.filter(F.slice(F.coalesce("personal_facts", empty_strings()), 1, 5), any_word), "themes": F.slice(F.coalesce("themes", empty_strings()), 1, 4),
        "chat_category": F.when(F.col("chat_category").isin("work", "life", "knowledge", "creative", "emotion"), F.col("chat_category")),
    })


def correct_texts(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts with ``old`` replaced by ``new`` where it occurs once: ``text, corrected, risky, outcome``."""
    joined = texts.join(edits, "path").withColumn("corrected", replace_unique(F.col("text"), F.col("old"), F.col("new")))
    return joined.withColumn("risky", high_risk(F.col("old"), F.col("new"))).withColumn("outcome", F.when(F.col("corrected").isNotNull(), "applied").otherwise("refused"))


def set_field(items: Column, action: Column, value: Column) -> Column:
    """A list after add, remove (all entries that hold the value) or set."""
    items = F.coalesce(items, empty_strings())
    return F.when(action == "set", F.array(value)).when((action == "add") & ~F.array_contains(items, value), F.concat(items, F.array(value))).when(action == "remove", F.filter(items, lambda x: ~x.contains(value))).otherwise(items)


def replaced_by_key(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The table with all rows of the keys in ``fresh`` replaced by its rows."""
    return table.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh.select(*table.columns))
