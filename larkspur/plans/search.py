"""Hybrid search as one plan: lexical, dense and graph legs, fusion, domain, time and use."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.dates import loose_date, nearness_bonus, with_time_range
from larkspur.functions.text import domain_of, graph_terms, plain_path
from larkspur.operators import dense, graph, lexical, memories, ranking
from larkspur.session import cut_lineage


@dataclass
class Corpus:
    """What is searched; a leg whose table is missing is left out."""

    documents: DataFrame | None = None  # path, text, date, type
    index: lexical.LexicalIndex | None = None  # over paragraph chunks
    vectors: DataFrame | None = None  # path, vector; view where some are to be left out
    edges: DataFrame | None = None
    accesses: DataFrame | None = None  # id, memory_path, accessed_at, source
    centroids: DataFrame | None = None  # domain, vector
    memberships: DataFrame | None = None  # path, domain; by default a path's top folder


@dataclass
class Options:
    """What a search may be told."""

    k: int = 10
    doc_type: str | None = None
    exclude_views: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    mode: str = "flat"  # flat, confidence, penalty or hard
    boost: float = 1.3
    auto_route: bool = False
    route_top_k: int = 2
    route_threshold: float = 0.2
    spreading: bool = False
    knowledge_penalty: float = 1.0
    activation_weight: float = 0.2


def _of_type(rows: DataFrame, corpus: Corpus, options: Options) -> DataFrame:
    if options.doc_type is None or corpus.documents is None:
        return rows
    return rows.join(corpus.documents.filter(F.lower("type") == options.doc_type).select("path"), "path", "left_semi")


def lexical_leg(corpus: Corpus, queries: DataFrame, fetch: int, options: Options = Options()) -> DataFrame:
    """Paths by their best chunk."""
    among = None
    if options.doc_type is not None and corpus.documents is not None:
        among = corpus.documents.filter(F.lower("type") == options.doc_type).select(F.col("path").alias("item"))
    return corpus.index.best(queries, "query", fetch, F.regexp_replace(corpus.index.key, "::para[0-9]+$", ""), among=among).withColumnRenamed("item", "path")


def dense_leg(corpus: Corpus, queries: DataFrame, fetch: int, options: Options = Options()) -> DataFrame:
    """Types and views are left out before vectors are compared."""
    vectors = corpus.vectors.filter(~F.col("view").isin(*options.exclude_views)) if options.exclude_views else corpus.vectors
    found = dense.nearest(_of_type(vectors, corpus, options), "path", "vector", queries.select("query_id", "vector"), fetch)
    return ranking.with_rank(found, ["query_id"], "path")


def graph_leg(corpus: Corpus, queries: DataFrame, fetch: int, options: Options = Options()) -> DataFrame:
    terms = queries.select("query_id", F.explode(graph_terms(F.col("query"))).alias("term"))
    among = None
    if options.doc_type is not None and corpus.documents is not None:
        among = corpus.documents.filter(F.lower("type") == options.doc_type).select("path")
    return ranking.by_place(graph.first_by_pattern(corpus.edges, terms, fetch, among))


def with_metadata(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (of the graph, that know nothing but paths) with what the first row of each path says."""
    first = documents.groupBy("path").agg(F.min_by(F.struct(*(F.col(c) for c in documents.columns if c not in ("path", "text"))), F.xxhash64(*(c for c in documents.columns if c != "text"))).alias("_m"))
    return hits.join(first, "path", "left").select(*hits.columns, "_m.*")


def legs(corpus: Corpus, queries: DataFrame, fetch: int, options: Options = Options()) -> list[DataFrame]:
    """Ranked lists ``query_id, path, rank``, each named in ``leg``."""
    parts = [(corpus.index, lexical_leg, "bm25"), (corpus.vectors, dense_leg, "dense"), (corpus.edges, graph_leg, "graph")]
    return [leg(corpus, queries, fetch, options).select("query_id", "path", "rank", F.lit(name).alias("leg")) for table, leg, name in parts if table is not None and (name != "dense" or "vector" in queries.columns)]


def memberships_of(corpus: Corpus, ranked: DataFrame) -> DataFrame:
    return corpus.memberships if corpus.memberships is not None else ranked.select("path").distinct().withColumn("domain", domain_of(F.col("path")))


def moved_by_domain(ranked: DataFrame, corpus: Corpus, queries: DataFrame, options: Options) -> DataFrame:
    """Explicit domains have no confidence: what isn't theirs goes in the hard mode, else theirs gets the flat boost. A router's
    choice, by the mean vectors of the domains, has."""
    if options.domains:
        named = queries.select("query_id").distinct().crossJoin(F.broadcast(queries.sparkSession.createDataFrame([(d, 1.0) for d in options.domains], "domain string, score double")))
        return ranking.by_domain(ranking.with_confidence(ranked, memberships_of(corpus, ranked), named), "hard" if options.mode == "hard" else "flat", options.boost)
    if not options.auto_route:
        return ranked
    routed = dense.route(queries.select("query_id", "vector"), corpus.centroids, "domain", options.route_top_k, options.route_threshold)
    return ranking.by_domain(ranking.with_confidence(ranked, memberships_of(corpus, ranked), routed), options.mode, options.boost)


def search(corpus: Corpus, queries: DataFrame, as_of: Column, options: Options = Options()) -> DataFrame:
    """``query_id, path, rank, score``. ``queries`` has ``query_id, query`` and, for the dense leg and the router, ``vector``. Legs
    fetch max(3 k, 15) each; after fusion, what spreads from the first, the domains and the categories, k are kept, which time and use
    then only reorder."""
    k = options.k
    fetch = max(3 * k, 15)
    both = reduce(DataFrame.unionByName, legs(corpus, queries, fetch, options))
    ranked = cut_lineage(ranking.fuse(both, ["query_id"], "path").drop("n_lists"))  # not more than three times fetch a query
    if options.spreading:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("path")))
        ranked = with_spreading(cut_lineage(ranked.withColumn("rank", place)), corpus.edges).drop("rank")
    ranked = moved_by_domain(ranked, corpus, queries, options)
    if options.knowledge_penalty != 1.0:
        ranked = ranked.join(corpus.documents.select("path", F.lower("type").alias("_type")), "path", "left").withColumn("score", F.when(F.col("_type") == "knowledge", F.col("score") * options.knowledge_penalty).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("path"))
    kept = cut_lineage(ranked.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).select("query_id", "path", "score"))
    if corpus.documents is not None:
        ranges = with_time_range(queries.select("query_id", "query"), "query", as_of.cast("date")).select("query_id", "start", "end", "anchor", "confidence")
        dated = kept.join(corpus.documents.select("path", loose_date(F.col("date")).alias("_date")), "path", "left").join(ranges, "query_id", "left")
        bonus = nearness_bonus(F.col("_date"), F.col("start"), F.col("end"), F.col("anchor"), F.col("confidence"))
        kept = dated.select("query_id", "path", (F.col("score") + F.when(F.col("start").isNotNull(), bonus).otherwise(0.0)).alias("score"))
    if corpus.accesses is not None:
        events = corpus.accesses.withColumn("memory_path", plain_path(F.col("memory_path"))).join(kept.select(F.col("path").alias("memory_path")).distinct(), "memory_path", "left_semi")
        used = ranking.activation(memories.accesses(events), "memory_path", "accessed_at", as_of).select(F.col("memory_path").alias("path"), "activation")
        kept = ranking.blend_activation(kept, used, "path", ["query_id"], options.activation_weight).select("query_id", "path", "score")
    return kept.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("path"))))


def context(corpus: Corpus, parts: DataFrame, as_of: Column, fetch: int = 10, keep: int = 4, least: float = 0.05, judge: Column | None = None) -> DataFrame:
    """What an answer is written from: the planned queries of a question (``query_id, part, query``) searched each, their lists
    fused, judged (``judge``, an outside reranker's score; else a path's share of its list's best), ``keep`` from
    ``least`` on, in order, with the text."""
    fused = decomposed(corpus, parts, as_of, fetch)
    share = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
    judged = fused.join(corpus.documents.select("path", "text"), "path").withColumn("judged", F.round(judge if judge is not None else share, 6)).filter(F.col("judged") >= least)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("judged"), F.asc("path")))
    return judged.withColumn("place", place).filter(F.col("place") <= keep).select("query_id", "place", "path", "judged", "text")


def decomposed(corpus: Corpus, parts: DataFrame, as_of: Column, k: int = 10) -> DataFrame:
    """Queries given as several (``query_id, part, query``): each part is searched alone, its lists are fused again."""
    alone = parts.select(F.concat_ws("/", "query_id", "part").alias("query_id"), "query")
    found = search(corpus, alone, as_of, Options(k=max(3 * k, 15))).withColumn("_whole", F.substring_index("query_id", "/", 1)).select(F.col("_whole").alias("query_id"), "path", "rank")
    fused = ranking.fuse(found, ["query_id"], "path").withColumn("score", F.round("score", 8))
    return ranking.with_rank(fused, ["query_id"], "path").filter(F.col("rank") <= k)


def search_at(ranked: DataFrame, edges: DataFrame, when: Column, k: int) -> DataFrame:
    """The best k of a ranking among memories with an edge valid at a time."""
    kept = ranked.join(graph.memories_at(edges, when), "path", "left_semi")
    return ranking.with_rank(kept, ["query_id"], "path").filter(F.col("rank") <= k)


def with_spreading(ranked: DataFrame, edges: DataFrame, seeds: int = 5, weight: float = 0.015, names: DataFrame | None = None) -> DataFrame:
    """Adds ``weight`` times each path's share of the highest activation that spreads from the first ``seeds`` of its list, and
    from the entities that its query names (``query_id, name``); the seeds get none, and no path is added."""
    first = cut_lineage(graph.seed_nodes(edges, ranked.filter(F.col("rank") <= seeds).select("query_id", "path"), names))
    spread = graph.activation_at(edges, first, ranked.select("query_id", graph.node_id(F.lit("Memory"), "path").alias("node")))
    share = spread.select("query_id", F.substring(F.col("node"), 8, 10_000).alias("path"), (weight * F.col("score") / F.col("top")).alias("_more"))
    return ranked.join(share, ["query_id", "path"], "left").withColumn("score", F.col("score") + F.coalesce("_more", F.lit(0.0))).drop("_more")
