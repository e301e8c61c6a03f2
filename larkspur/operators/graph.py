"""A property graph as one edge table: time, patterns, spreading activation, changes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import scoring
from larkspur.session import cut_lineage

# How much a hit by each pattern counts.
ONE_HOP = {"mem_location": 2.0, "mem_person": 2.0, "mem_event": 2.0, "mem_period": 1.5}
TWO_HOPS = {("mem_person", "person_loc", "src"): 1.0, ("mem_event", "event_loc", "src"): 1.0, ("mem_person", "person_event", "src"): 1.0, ("mem_location", "event_loc", "dst"): 0.8}
#: Labels in the order in which a name is looked for.
LABELS = ("Person", "Location", "Event", "Period")


def current(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("t_valid_end").isNull())


def as_of(edges: DataFrame, when: Column) -> DataFrame:
    """Edges valid at a time, the end excluded; an edge without a start never is."""
    return edges.filter((F.col("t_valid_start") <= when) & (F.col("t_valid_end").isNull() | (F.col("t_valid_end") > when)))


def memories_at(edges: DataFrame, when: Column) -> DataFrame:
    """Memories with any edge valid at a time."""
    return as_of(edges, when).filter("src_label = 'Memory'").select(F.col("src").alias("path")).distinct()


def pattern_search(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, path, score``: memories one or two edges away from a node whose name holds a term; every pattern counts
    once per memory and term."""
    numbers = _numbered(terms)
    bags = _term_bags(terms, numbers)
    found = scoring.scored(_held_terms(edges, numbers), bags, _alike, _gains, None)
    return F.broadcast(bags.select("query_id", "_same")).join(found, "_same").select("query_id", F.col("item").alias("path"), "score")


def first_by_pattern(edges: DataFrame, terms: DataFrame, k: int, among: DataFrame | None = None) -> DataFrame:
    """``query_id, path, score, rank``: the first k of each query by `pattern_search` (rounded to 6 digits), of the paths in
    ``among`` (``path``), ties to the smaller path; a task keeps k a query."""
    numbers = _numbered(terms)
    rows = _held_terms(edges, numbers)
    if among is not None:
        rows = rows.join(among.select(F.col("path").alias("item")), "item", "left_semi")
    return scoring.first(rows, _term_bags(terms, numbers), _alike, _gains, k).withColumnRenamed("item", "path")


def _numbered(terms: DataFrame) -> DataFrame:
    """``term, no``: the different terms of two characters or more; lists of numbers are cheaper than lists of terms."""
    return cut_lineage(terms.filter(F.char_length("term") > 1).select("term").distinct().withColumn("no", F.row_number().over(Window.orderBy("term"))))


def _term_bags(terms: DataFrame, numbers: DataFrame) -> DataFrame:
    return scoring.bags(terms.join(numbers, "term").select("query_id", F.col("no").alias("tok"), F.lit(1).alias("_times")).distinct())


def _alike(terms: DataFrame) -> DataFrame:
    return terms.select("_same", "tok", F.lit(1.0).alias("weight"), F.lit(1).alias("df"))


def _gains(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(2).flatten().to_numpy()


def _held_terms(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """``item, toks, gains``: the numbers of the terms (``term, no``) that each memory meets, whoever asks them, with the weights of the patterns by which it does.
    Node names are matched first, so that edges are joined by equal ends only. Names and terms (of two characters or
    more) meet in a pair of characters that both have; the whole term is then looked for."""
    ends = edges.select(F.col("dst_label").alias("label"), F.col("dst").alias("name")).unionByName(edges.filter("src_label != 'Memory'").select(F.col("src_label").alias("label"), F.col("src").alias("name"))).distinct()
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("name") - 1), lambda i: F.substring("name", i, 2)))
    held = ends.filter(F.char_length("name") > 1).select("label", "name", F.explode(pairs).alias("_pair"))
    asked = numbers.select("term", "no", F.substring("term", 1, 2).alias("_pair"))
    hits = cut_lineage(held.join(asked, "_pair").filter(F.col("name").contains(F.col("term"))).select("label", "name", F.col("no").alias("term")).distinct())
    by_name = cut_lineage(hits.groupBy("label", "name").agg(F.collect_list("term").alias("toks")))
    found = []
    for rel, weight in ONE_HOP.items():
        one = edges.filter(F.col("rel") == rel).select(F.col("src").alias("path"), F.col("dst_label").alias("label"), F.col("dst").alias("name")).distinct()
        found.append(one.join(by_name, ["label", "name"]).select("path", F.lit(rel).alias("pattern"), F.lit(weight).alias("weight"), "toks"))
    for (first, second, near), weight in TWO_HOPS.items():
        far = "dst" if near == "src" else "src"
        step = edges.filter(F.col("rel") == second).select(F.col(near).alias("mid"), F.col(f"{far}_label").alias("label"), F.col(far).alias("name")).distinct()
        reached = step.join(hits, ["label", "name"]).select("term", "mid").distinct().groupBy("mid").agg(F.collect_list("term").alias("toks"))
        start = edges.filter(F.col("rel") == first).select(F.col("src").alias("path"), F.col("dst").alias("mid")).distinct()
        found.append(start.join(reached, "mid").select("path", F.lit(f"{first}>{second}").alias("pattern"), F.lit(weight).alias("weight"), "toks"))
    # lists of terms go along instead of a row for each: of one pattern a term counts once, of several it adds up
    each = reduce(DataFrame.unionByName, found).filter(F.col("path").isNotNull()).groupBy("path", "pattern", "weight").agg(F.array_distinct(F.flatten(F.collect_list("toks"))).alias("toks"))
    rows = each.groupBy(F.col("path").alias("item")).agg(F.collect_list(F.struct("toks", F.expr("array_repeat(weight, size(toks))").alias("gains"))).alias("_t"))
    return cut_lineage(rows.select("item", F.flatten("_t.toks").alias("toks"), F.flatten("_t.gains").alias("gains")))


def node_id(label: Column | str, name: Column | str) -> Column:
    return F.concat_ws(":", label, name)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each pair of nodes once, whatever the relation."""
    pairs = edges.select(node_id("src_label", "src").alias("a"), node_id("dst_label", "dst").alias("b")).filter("a != b")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.15, tolerance: float = 1e-7, most_steps: int = 100, keep_every: int = 3) -> DataFrame:
    """``query_id, node, score``, the fixed point of p = (1 - d) t + d M'p over the undirected graph, t spread evenly over the
    seeds (``query_id, node``) that are in it. Each step is one join on the node and one aggregation; every few steps
    the ranks are written and compared with those written before: it ends where the differences sum up to less than
    ``tolerance`` for every query, and raises where ``most_steps`` don't suffice. Nodes are in the graph by their edges, so none dangles."""
    links = undirected(edges)
    degree = links.groupBy("a").agg(F.count("*").alias("deg"))
    links = cut_lineage(links.join(degree, "a").select("a", "b", (1.0 / F.col("deg")).alias("share")))
    inside = seeds.distinct().join(links.select(F.col("a").alias("node")), "node", "left_semi")
    count = inside.groupBy("query_id").agg(F.count("*").alias("n"))
    start = cut_lineage(inside.join(count, "query_id").select("query_id", "node", (1.0 / F.col("n")).alias("t")))
    ranks = before = start.select("query_id", "node", F.col("t").alias("p"))
    for step in range(1, most_steps + 1):
        moved = ranks.join(links, ranks.node == links.a).select("query_id", F.col("b").alias("node"), (damping * F.col("p") * F.col("share")).alias("p"))
        ranks = moved.unionByName(start.select("query_id", "node", ((1 - damping) * F.col("t")).alias("p"))).groupBy("query_id", "node").agg(F.sum("p").alias("p"))
        if step % keep_every == 0:
            ranks = cut_lineage(ranks)
            both = ranks.unionByName(before.select("query_id", "node", (-F.col("p")).alias("p"))).groupBy("query_id", "node").agg(F.abs(F.sum("p")).alias("d"))
            most = both.groupBy("query_id").agg(F.sum("d").alias("d")).agg(F.max("d")).first()[0]
            if most is None or most < tolerance:
                return ranks.select("query_id", "node", F.col("p").alias("score"))
            before = ranks
    raise RuntimeError(f"activation still spreads after {most_steps} steps")


def seed_nodes(edges: DataFrame, paths: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``query_id, node`` for spreading: memories (``query_id, path``) and, of entity names (``query_id, name``), the node under the
    first label that has one of that name."""
    seeds = paths.select("query_id", node_id(F.lit("Memory"), "path").alias("node"))
    if names is None:
        return seeds.distinct()
    ends = edges.select(F.col("src_label").alias("label"), F.col("src").alias("name")).unionByName(edges.select(F.col("dst_label").alias("label"), F.col("dst").alias("name"))).filter(F.col("label").isin(*LABELS)).distinct()
    order = reduce(lambda c, k: c.when(F.col("label") == LABELS[k], k), range(1, len(LABELS)), F.when(F.col("label") == LABELS[0], 0))
    first = names.select("query_id", "name").join(ends, "name").groupBy("query_id", "name").agg(F.min_by("label", order).alias("label"))
    return seeds.unionByName(first.select("query_id", node_id("label", "name").alias("node"))).distinct()


#: Links (both directions counted) up to which every task gets the graph and spreads for some queries at once.
MOST_LINKS = 16_000_000
#: Nodes times queries that are held at once.
AT_ONCE = 1 << 22
#: Neighbours up to which nodes are summed up side by side, the first of each, then the second; what nodes have more is summed up by node.
LAYERS = 32


def _layers(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, np.ndarray]], np.ndarray]:
    """Of a graph's links (both directions of each, every node with one at least) the nodes' places by falling degree, and in these the first,
    second, ... neighbour of all nodes that have so many, what is left of the neighbours of the others, and 1 / degree."""
    degree = np.bincount(b, minlength=n)
    by = np.argsort(-degree, kind="stable")
    place = np.empty(n, np.int32)
    place[by] = np.arange(n)
    source, starts, degree = place[a[np.argsort(b, kind="stable")]], (np.cumsum(degree) - degree)[by], degree[by]
    layers = [source[starts[: np.count_nonzero(degree > k)] + k] for k in range(min(LAYERS, int(degree[0]) if n else 0))]
    rest = [(k, source[starts[k] + LAYERS : starts[k] + degree[k]]) for k in range(np.count_nonzero(degree > LAYERS))]
    return place, layers, rest, 1.0 / degree


def _spread_rows(group: pd.DataFrame, graph: object, damping: float, tolerance: float, most_steps: int, pick: Callable) -> pd.DataFrame:
    """What ``pick(scores, seeds, wanted)`` keeps of each query's activation, ``group`` having ``query_id, no, seed``."""
    place, layers, rest, share, memory = graph.value
    asked, names = group["query_id"].factorize()
    no, seed = group["no"].to_numpy(), group["seed"].to_numpy()
    out, width = [], max(1, min(32, AT_ONCE // max(1, len(place))))
    for begin in range(0, len(names), width):
        some = (asked >= begin) & (asked < begin + width)
        own, start = asked[some] - begin, np.zeros((len(place), min(width, len(names) - begin)))
        start[place[no[some & seed]], own[seed[some]]] = 1.0
        start /= np.maximum(start.sum(axis=0), 1.0)
        ranks = start
        for _ in range(most_steps):
            shared, before = ranks * (damping * share)[:, None], ranks
            ranks = (1 - damping) * start
            for layer in layers:
                ranks[: len(layer)] += shared[layer]
            for k, more in rest:
                ranks[k] += shared[more].sum(axis=0)
            if np.abs(ranks - before).sum(axis=0).max() < tolerance:
                break
        else:
            raise RuntimeError(f"activation still spreads after {most_steps} steps")
        for q in range(ranks.shape[1]):
            mine = no[some][own == q]
            is_seed = seed[some][own == q]
            left = memory.copy()
            left[mine[is_seed]] = False
            at, score, top = pick(ranks[place, q], left, mine[~is_seed])
            out.append(pd.DataFrame({"query_id": names[begin + q], "no": at, "score": score, "top": top}))
    return pd.concat(out)


def _spread_picked(edges: DataFrame, seeds: DataFrame, wanted: DataFrame | None, pick: Callable, damping: float = 0.15, tolerance: float = 1e-9, most_steps: int = 100) -> DataFrame | None:
    """``query_id, node, score, top`` that ``pick`` keeps, without a row for every query and node; None where the graph is too large
    to be handed out. Nodes are numbered in their order. ``wanted`` has ``query_id, node``, too."""
    links = cut_lineage(undirected(edges))
    if links.count() > MOST_LINKS:
        return None
    nodes = cut_lineage(links.select(F.col("a").alias("node")).distinct().withColumn("no", F.row_number().over(Window.orderBy("node")) - 1))
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("no").alias(f"{c}_no"))
    numbered = links.join(of("a"), "a").join(of("b"), "b").select("a_no", "b_no").toArrow()
    a, b = (numbered.column(c).to_numpy() for c in ("a_no", "b_no"))
    memory = nodes.filter(F.col("node").startswith("Memory:")).select("no").toArrow().column("no").to_numpy()
    n = nodes.count()
    is_memory = np.zeros(n, bool)
    is_memory[memory] = True
    graph = edges.sparkSession.sparkContext.broadcast((*_layers(a, b, n), is_memory))
    asked = seeds.select("query_id", "node").distinct().join(nodes, "node").select("query_id", "no", F.lit(True).alias("seed"))
    queries = asked.select("query_id").distinct()
    blocks = max(1, queries.count() // 64)
    if wanted is not None:
        asked = asked.unionByName(wanted.select("query_id", "node").distinct().join(nodes, "node").join(queries, "query_id", "left_semi").select("query_id", "no", F.lit(False).alias("seed")))
    kinds = f"query_id {seeds.schema['query_id'].dataType.simpleString()}, no int, score double, top double"
    work = lambda group: _spread_rows(group, graph, damping, tolerance, most_steps, pick)
    grouped = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).repartition(min(blocks, 512), "_block").groupBy("_block")
    found = cut_lineage(grouped.applyInPandas(lambda group: work(group.drop(columns="_block")), kinds))
    return found.join(nodes, "no").select("query_id", "node", "score", "top")


def activation_at(edges: DataFrame, seeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """``query_id, node, score, top``: what reaches the memories ``wanted`` (``query_id, node``) other than the seeds, and
    the most that reaches any such memory."""

    def pick(scores: np.ndarray, left: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        at = wanted[left[wanted]]
        return at, scores[at], float(scores[left].max()) if left.any() else 0.0

    found = _spread_picked(edges, seeds, wanted, pick)
    if found is not None:
        return found.filter("score > 0")
    spread = personalised_pagerank(edges, seeds).filter(F.col("node").startswith("Memory:")).join(seeds, ["query_id", "node"], "left_anti")
    top = spread.groupBy("query_id").agg(F.max("score").alias("top"))
    return spread.join(wanted.select("query_id", "node").distinct(), ["query_id", "node"], "left_semi").join(top, "query_id")


def spreading_activation(edges: DataFrame, seeds: DataFrame, top_k: int = 15, **steps: object) -> DataFrame:
    """``query_id, path, score, rank``: the memories that most of what spreads from the seeds reaches, the seeds themselves left out."""

    def pick(scores: np.ndarray, left: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(left & (scores > 0))
        rounded = np.floor(scores[at] * 1e9 + 0.5) / 1e9
        first = np.lexsort((at, -rounded))[:top_k]
        return at[first], rounded[first], 0.0

    found = _spread_picked(edges, seeds, None, pick, **steps)
    spread = found.drop("top") if found is not None else personalised_pagerank(edges, seeds, **steps).filter(F.col("node").startswith("Memory:")).join(seeds, ["query_id", "node"], "left_anti")
    scored = spread.select("query_id", F.substring(F.col("node"), 8, 10_000).alias("path"), F.round("score", 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("path")))
    return scored.withColumn("rank", place).filter(F.col("rank") <= top_k)


def timeline(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges of each name (``name``), taken as the first label that has it, from both ends; without a start first."""
    sides = edges.select(F.col("src_label").alias("label"), F.col("src").alias("name"), F.col("dst").alias("other"), "rel", "t_valid_start", "t_valid_end").unionByName(
        edges.select(F.col("dst_label").alias("label"), F.col("dst").alias("name"), F.col("src").alias("other"), "rel", "t_valid_start", "t_valid_end")
    )
    mine = sides.join(names.select("name").distinct(), "name").filter(F.col("label").isin(*LABELS))
    order = reduce(lambda c, k: c.when(F.col("label") == LABELS[k], k), range(1, len(LABELS)), F.when(F.col("label") == LABELS[0], 0))
    first = mine.groupBy("name").agg(F.min(order).alias("_first"))
    return mine.join(first, "name").filter(order == F.col("_first")).select("name", "label", "rel", "other", "t_valid_start", "t_valid_end").distinct()


def degrees(edges: DataFrame, label: str) -> DataFrame:
    """``name, degree`` of the nodes of a label over all relations."""
    ends = edges.filter(F.col("src_label") == label).select(F.col("src").alias("name")).unionAll(edges.filter(F.col("dst_label") == label).select(F.col("dst").alias("name")))
    return ends.groupBy("name").agg(F.count("*").alias("degree"))


def invalidate(edges: DataFrame, verdicts: DataFrame, on: list[str]) -> DataFrame:
    """Open edges that a verdict (``on..., ended, by``) names get an end and its author; all others stay."""
    marked = edges.join(verdicts.select(*on, F.col("ended"), F.col("by")), on, "left")
    hit = F.col("t_valid_end").isNull() & F.col("ended").isNotNull()
    return marked.withColumns(
        {"t_valid_end": F.when(hit, F.col("ended")).otherwise(F.col("t_valid_end")), "invalidated_by": F.when(hit, F.col("by")).otherwise(F.col("invalidated_by"))}
    ).select(*edges.columns)


def weave(memories: DataFrame, at: Column) -> DataFrame:
    """Edges that follow from the memories' entities: memory to each person, place, event and the period; event to place
    inside a memory; person to event; person to place where one fact names both, with the fact as evidence."""
    m = memories.select("memory_path", "period", "personal_facts", *(F.array_distinct(F.coalesce(F.col(f"entities.{k}"), F.array().cast("array<string>"))).alias(k) for k in ("people", "locations", "events")))

    def edge(df: DataFrame, rel: str, a: str, src: str, b: str, dst: str, evidence: Column | None = None) -> DataFrame:
        return df.select(
            F.lit(rel).alias("rel"), F.lit(a).alias("src_label"), F.col(src).alias("src"), F.lit(b).alias("dst_label"), F.col(dst).alias("dst"), (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence")
        )

    people, places, events = (m.select("memory_path", F.explode(c).alias(one)) for c, one in (("people", "person"), ("locations", "location"), ("events", "event")))
    mentions = m.select("memory_path", "personal_facts", F.explode("people").alias("person"), "locations").select("memory_path", "personal_facts", "person", F.explode("locations").alias("location"))
    fact = F.filter(F.coalesce("personal_facts", F.array().cast("array<string>")), lambda f: f.contains(F.col("person")) & f.contains(F.col("location")))
    parts = [
        edge(people, "mem_person", "Memory", "memory_path", "Person", "person"),
        edge(places, "mem_location", "Memory", "memory_path", "Location", "location"),
        edge(events, "mem_event", "Memory", "memory_path", "Event", "event"),
        edge(m.filter("period != ''"), "mem_period", "Memory", "memory_path", "Period", "period"),
        edge(events.join(places, "memory_path"), "event_loc", "Event", "event", "Location", "location"),
        edge(people.join(events, "memory_path"), "person_event", "Person", "person", "Event", "event"),
        edge(mentions.withColumn("_fact", F.get(fact, F.lit(0))).filter("_fact is not null"), "person_loc", "Person", "person", "Location", "location", F.substring("_fact", 1, 80)),
    ]
    woven = reduce(DataFrame.unionByName, parts)
    keys = ["rel", "src_label", "src", "dst_label", "dst"]
    return woven.groupBy(*keys).agg(F.min("evidence").alias("evidence")).withColumns({"t_valid_start": at, "t_valid_end": F.lit(None).cast("timestamp_ntz"), "t_ingested": at, "invalidated_by": F.lit(None).cast("string")})


def insert_new(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose keys aren't there yet, each once."""
    return candidates.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")
