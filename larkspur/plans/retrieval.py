"""Queries of search, fusion, boosts and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import chunks as C
from larkspur.operators import dense, evaluation, graph, lexical, memories, ranking
from larkspur.operators.components import connected_components
from larkspur.plans import search as S
from larkspur.plans.registry import ACC, AS_OF, MEM, TOKENS, Registry, ranges_sql, spread_sql
from larkspur.plans.texts import DOMAIN_SQL, PARAGRAPHS
from larkspur.session import shared_folder, spread

R = Registry()


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


#: Queries of the searches below: every fiftieth hit's.
ASKED_SQL = "q AS (SELECT DISTINCT result_id AS query_id, query FROM search_results WHERE result_id % 50 = 0 AND query IS NOT NULL)"


def asked(t):
    return t("search_results").filter("result_id % 50 = 0 and query is not null").select(F.col("result_id").alias("query_id"), "query").distinct()


_kept: dict[tuple, lexical.LexicalIndex] = {}


def chunk_index(t) -> lexical.LexicalIndex:
    """The lexical index over the paragraphs of all documents, built once in a session."""
    docs = t("documents")
    spark = docs.sparkSession
    kept = (spark.sparkContext.applicationId, *docs.inputFiles())
    if kept not in _kept:
        chunks = C.paragraph_chunks(spread(docs.select("path", "text")), "path", "text").select("chunk_id", "para")
        _kept[kept] = lexical.LexicalIndex.build(chunks, "chunk_id", "para", f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}")
    return _kept[kept]


#: CTEs that end in ``bm25(query_id, path, score)``, the best chunk of each document, for ``q``.
BM25_SQL = f"""{PARAGRAPHS},
tk AS MATERIALIZED (SELECT path || '::para' || (i - 1) AS chunk_id, path, {TOKENS.format("paras[i]")} AS toks FROM (SELECT path, paras, unnest(range(1, len(paras) + 1)) AS i FROM p)),
post AS MATERIALIZED (SELECT chunk_id, path, len(toks) AS dl, tok, count(*) AS tf FROM (SELECT chunk_id, path, toks, unnest(toks) AS tok FROM tk) GROUP BY ALL),
df AS MATERIALIZED (SELECT tok, count(*) AS n FROM post GROUP BY tok), nd AS (SELECT count(*) AS nn, avg(len(toks)) AS avgdl, sum(len(toks)) AS total FROM tk WHERE len(toks) > 0),
raw AS (SELECT tok, ln(nn - n + 0.5) - ln(n + 0.5) AS r FROM df, nd), idf AS (SELECT tok, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query_id, tok, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS tok FROM q) GROUP BY ALL),
bc AS (SELECT query_id, path, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN qt USING (tok) JOIN idf USING (tok), nd GROUP BY ALL HAVING score > 0),
bm25 AS (SELECT query_id, path, max(round(score, 6)) AS score FROM bc GROUP BY ALL)"""


@R.add("lexical_index", f"WITH q AS (SELECT 1 AS query_id, '' AS query), {BM25_SQL} SELECT nn AS n, total::bigint AS total, (SELECT count(*) FROM df) AS n_terms, round((SELECT avg(r) FROM raw), 6) AS mean FROM nd")
def lexical_index(t):
    """The figures of the index over all paragraphs."""
    return chunk_index(t)._read("figures").select("n", "total", "n_terms", F.round("mean", 6).alias("mean"))


@R.add("bm25_topk", f"WITH {ASKED_SQL}, {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM bm25) SELECT query_id, path, rank, score FROM r WHERE rank <= 20")
def bm25_topk(t):
    found = S.lexical_leg(S.Corpus(index=chunk_index(t)), asked(t), 20)
    return found.select("query_id", "path", F.col("rank").cast("bigint").alias("rank"), "score")


COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


QV = "b AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0)"


def vector_queries(t):
    """Every fiftieth vector."""
    return t("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@R.add("dense_topk", f"""
WITH {QV}, s AS (SELECT query_id, vec_id, round({COS}, 5) AS score FROM embeddings a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score FROM r WHERE rank <= 10""")  # fmt: skip
def dense_topk(t):
    """Every fiftieth vector against all."""
    return dense.nearest(t("embeddings"), "vec_id", "embedding", vector_queries(t), 10, 5).select("query_id", "vec_id", "score")


@R.add("dense_filtered", f"""
WITH {QV}, s AS (SELECT query_id, vec_id, round({COS}, 5) AS score FROM embeddings a JOIN documents d ON d.doc_id = a.vec_id AND lower(d.type) = 'note', b WHERE label != 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score FROM r WHERE rank <= 10""")  # fmt: skip
def dense_filtered(t):
    """The same among vectors of one type of document, without those of one view (here: a label), left out before anything is compared."""
    some = t("documents").filter("lower(type) = 'note'").select(F.col("doc_id").alias("vec_id"))
    v = t("embeddings").filter("label != 3").join(some, "vec_id", "left_semi")
    return dense.nearest(v, "vec_id", "embedding", vector_queries(t), 10, 5).select("query_id", "vec_id", "score")


@R.add("dense_best_per_label", f"WITH {QV} SELECT query_id, label, round(max({COS}), 5) AS score FROM embeddings a, b GROUP BY ALL")
def dense_best_per_label(t):
    """The best hit of every group of vectors (chunks of one memory)."""
    return dense.best_per_group(t("embeddings"), "label", "embedding", vector_queries(t)).withColumn("score", F.round("score", 5))


CENTROIDS = """
m AS (SELECT label, i, avg(x::double) AS x, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i),
v AS (SELECT label, max(n) AS n, list(x ORDER BY i) AS v FROM m GROUP BY label HAVING max(n) >= 3),
c AS (SELECT label, n, [x / sqrt(list_dot_product(v, v)) for x in v] AS v FROM v)"""


@R.add("centroids", f"WITH {CENTROIDS} SELECT label, n, round(v[1], 6) AS first_value, round(list_sum(v), 6) AS total FROM c")
def centroids(t):
    c = dense.mean_vectors(t("embeddings"), "label", "embedding", 3)
    return c.select("label", "n", F.round(F.col("vector")[0], 6).alias("first_value"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


ROUTED = f"""{CENTROIDS},
s AS (SELECT b.vec_id AS query_id, label, list_cosine_similarity(c.v, b.embedding::double[]) AS score FROM c JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) b ON true),
routed AS (SELECT query_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM s WHERE score >= 0.15) WHERE rank <= 3)"""


def routed(t):
    return dense.route(vector_queries(t), dense.mean_vectors(t("embeddings"), "label", "embedding", 3), "label", 3, 0.15)


@R.add("route", f"WITH {ROUTED} SELECT query_id, label, round(score, 6) AS score FROM routed")
def route(t):
    return routed(t).select("query_id", "label", F.round("score", 6).alias("score"))


@R.add("boost_modes", f"""
WITH {ROUTED}, {QV}, hs AS (SELECT query_id, vec_id, label, round({COS}, 9) AS score FROM embeddings a, b),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM hs) WHERE rank <= 30),
top AS (SELECT query_id, max(score) AS best FROM routed GROUP BY query_id),
j AS (SELECT h.query_id, h.vec_id, h.score, r.score AS conf, t.best FROM hits h LEFT JOIN routed r ON r.query_id = h.query_id AND r.label = h.label LEFT JOIN top t ON t.query_id = h.query_id)
SELECT query_id, vec_id, round(CASE WHEN conf IS NOT NULL THEN score * 1.3 ELSE score END, 5) AS flat,
  round(CASE WHEN conf IS NOT NULL THEN score * least(1 + greatest(0, conf - 0.2) * 2, 1.5) ELSE score END, 5) AS confident,
  round(CASE WHEN conf IS NOT NULL THEN score ELSE score * greatest(1 - greatest(0, coalesce(best, 0) - 0.2) * 0.5, 0.85) END, 5) AS penalised, conf IS NOT NULL OR best IS NULL AS kept FROM j""")  # fmt: skip
def boost_modes(t):
    """The first thirty hits of each query in all four modes of the router."""
    hits = dense.nearest(t("embeddings"), "vec_id", "embedding", vector_queries(t), 30).withColumnRenamed("vec_id", "path")
    labels = t("embeddings").select(F.col("vec_id").alias("path"), F.col("label").alias("domain"))
    j = ranking.with_confidence(hits, labels, routed(t).withColumnRenamed("label", "domain"))
    moved = [ranking.by_domain(j, mode).select("query_id", F.col("path").alias("vec_id"), F.round("score", 5).alias(name)) for mode, name in (("flat", "flat"), ("confidence", "confident"), ("penalty", "penalised"))]
    kept = ranking.by_domain(j, "hard").select("query_id", F.col("path").alias("vec_id"), F.lit(True).alias("kept"))
    return moved[0].join(moved[1], ["query_id", "vec_id"]).join(moved[2], ["query_id", "vec_id"]).join(kept, ["query_id", "vec_id"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


HITS = """hits AS (SELECT DISTINCT result_id, query_id, source, regexp_replace(memory_path, '^_vault/', '') AS path, score, chat_category FROM search_results)"""


def hits(t):
    return t("search_results").select("result_id", "query_id", "source", text.plain_path(F.col("memory_path")).alias("path"), "score", "chat_category").distinct()


RANKED = f"""{HITS}, best AS (SELECT query_id, source, path, max(score) AS score FROM hits WHERE score IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, path) AS rank FROM best)"""


@R.add("ranked_lists", f"WITH {RANKED} SELECT query_id, source, path, rank, score FROM ranked")
def ranked_lists(t):
    return ranking.with_rank(hits(t).filter("score is not null"), ["query_id", "source"], "path").select("query_id", "source", "path", F.col("rank").cast("bigint").alias("rank"), "score")


@R.add("rrf_fusion", f"WITH {RANKED} SELECT query_id, path, count(*) AS n_lists, round(sum(1.0 / (60 + rank)), 8) AS score FROM ranked GROUP BY query_id, path")
def rrf_fusion(t):
    return ranking.fuse(ranked_lists(t), ["query_id"], "path").withColumn("score", F.round("score", 8))


@R.add("rrf_weighted", f"WITH {RANKED} SELECT path, round(sum(CASE source WHEN 'dense' THEN 2.0 WHEN 'graph' THEN 0.5 ELSE 1.0 END / (60 + rank)), 7) AS score FROM ranked GROUP BY path")
def rrf_weighted(t):
    weight = F.when(F.col("source") == "dense", 2.0).when(F.col("source") == "graph", 0.5).otherwise(1.0)
    return ranking.fuse(ranked_lists(t), [], "path", weight).select("path", F.round("score", 7).alias("score"))


@R.add("category_penalty", f"WITH {HITS} SELECT result_id, round(CASE WHEN chat_category = 'knowledge' THEN score * 0.85 ELSE score END, 6) AS score FROM hits")
def category_penalty(t):
    return hits(t).select("result_id", F.round(F.when(F.col("chat_category") == "knowledge", F.col("score") * 0.85).otherwise(F.col("score")), 6).alias("score"))


@R.add("rerank_keep", f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, result_id) AS place FROM hits WHERE score >= 0.05) SELECT query_id, result_id, place FROM r WHERE place <= 4""")
def rerank_keep(t):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "result_id")
    return hits(t).filter("score >= 0.05").withColumn("place", F.row_number().over(w).cast("bigint")).filter("place <= 4").select("query_id", "result_id", "place")


@R.add("list_overlap", f"""
WITH {HITS}, a AS (SELECT DISTINCT path FROM hits WHERE source = 'dense'), b AS (SELECT DISTINCT path FROM hits WHERE source = 'bm25')
SELECT CASE WHEN a.path IS NULL THEN 'only_bm25' WHEN b.path IS NULL THEN 'only_dense' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.path = b.path GROUP BY 1""")  # fmt: skip
def list_overlap(t):
    """What two configurations have in common, and what only one of them finds."""
    a, b = (hits(t).filter(F.col("source") == s).select("path").distinct() for s in ("dense", "bm25"))
    sides = [("both", a.intersect(b)), ("only_dense", a.exceptAll(b)), ("only_bm25", b.exceptAll(a))]
    out = None
    for name, df in sides:
        part = df.select(F.lit(name).alias("side"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("side").agg(F.count("*").alias("n"))


VALID = "e.t_valid_start <= TIMESTAMP '2025-06-01' AND (e.t_valid_end IS NULL OR e.t_valid_end > TIMESTAMP '2025-06-01')"


@R.add("as_of_search", f"""
WITH {RANKED}, ok AS (SELECT DISTINCT src AS path FROM edges e WHERE src_label = 'Memory' AND {VALID}), f AS (SELECT query_id, path, round(sum(1.0 / (60 + rank)), 8) AS score FROM ranked GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS place FROM f WHERE path IN (SELECT path FROM ok)) SELECT query_id, path, place AS rank, score FROM r WHERE place <= 5""")  # fmt: skip
def as_of_search(t):
    found = S.search_at(rrf_fusion(t), t("edges"), F.lit("2025-06-01").cast("timestamp_ntz"), 5)
    return found.select("query_id", "path", F.col("rank").cast("bigint").alias("rank"), "score")


def corpus(t) -> S.Corpus:
    """Texts by path; the embedding with the number of a document is taken as that document's, the mean vectors of the top
    folders route."""
    docs = t("documents")
    vectors = t("embeddings").join(docs.select(F.col("doc_id").alias("vec_id"), "path"), "vec_id").select("path", F.col("embedding").alias("vector"), F.concat(F.lit("view"), "label").alias("view"))
    means = dense.mean_vectors(vectors.select(text.domain_of(F.col("path")).alias("domain"), "vector"), "domain", "vector", 3)
    return S.Corpus(docs.select("path", "text", F.col("date_created").alias("date"), "type"), chunk_index(t), vectors, t("edges"), t("access_events"), means)


def asked_with_vectors(t):
    """The queries with the vectors that have their numbers, where there are such."""
    v = t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return asked(t).join(v, "query_id", "left")


GRAPH_SQL = """
terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(list_concat(w, flatten([[substr(x, i, 2) for i in range(1, length(x))] for x in w]))) AS term
  FROM (SELECT query_id, list_filter(regexp_split_to_array(query, '\\s+'), lambda w: length(w) >= 2) AS w FROM q))),
one AS (SELECT DISTINCT query_id, term, src AS path, rel AS pattern, CASE rel WHEN 'mem_period' THEN 1.5 ELSE 2.0 END AS w FROM edges JOIN terms ON contains(dst, term)
  WHERE rel IN ('mem_location', 'mem_person', 'mem_event', 'mem_period')),
two AS (
  SELECT DISTINCT query_id, term, a.src AS path, 'p>l' AS pattern, 1.0 AS w FROM edges a JOIN edges b ON a.dst = b.src JOIN terms ON contains(b.dst, term) WHERE a.rel = 'mem_person' AND b.rel = 'person_loc'
  UNION ALL SELECT DISTINCT query_id, term, a.src, 'e>l', 1.0 FROM edges a JOIN edges b ON a.dst = b.src JOIN terms ON contains(b.dst, term) WHERE a.rel = 'mem_event' AND b.rel = 'event_loc'
  UNION ALL SELECT DISTINCT query_id, term, a.src, 'p>e', 1.0 FROM edges a JOIN edges b ON a.dst = b.src JOIN terms ON contains(b.dst, term) WHERE a.rel = 'mem_person' AND b.rel = 'person_event'
  UNION ALL SELECT DISTINCT query_id, term, a.src, 'l<e', 0.8 FROM edges a JOIN edges b ON a.dst = b.dst JOIN terms ON contains(b.src, term) WHERE a.rel = 'mem_location' AND b.rel = 'event_loc'),
graph AS (SELECT query_id, path, sum(w) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL)"""


@R.add("graph_pattern_search", f"WITH {ASKED_SQL}, {GRAPH_SQL} SELECT query_id, path, round(score, 6) AS score FROM graph")
def graph_pattern_search(t):
    terms = asked(t).select("query_id", F.explode(text.graph_terms(F.col("query"))).alias("term"))
    return graph.pattern_search(t("edges"), terms).select("query_id", "path", F.round("score", 6).alias("score"))


def legs_sql(documents: str = "documents") -> str:
    """CTEs that end in ``fused(query_id, path, score)`` over the legs of `S.search`, hits being among ``documents``."""
    among = "" if documents == "documents" else f" WHERE path IN (SELECT path FROM {documents})"
    return f"""{BM25_SQL}, {GRAPH_SQL},
v AS (SELECT path, embedding, label FROM embeddings JOIN documents ON vec_id = doc_id), qv AS (SELECT query_id, embedding FROM q JOIN embeddings ON vec_id = query_id),
dense AS (SELECT query_id, path, round(list_cosine_similarity(v.embedding::double[], qv.embedding::double[]), 9) AS score FROM v, qv),
lists AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM bm25{among}
  UNION ALL SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) FROM dense{among}
  UNION ALL SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path) FROM graph{among}),
fused AS (SELECT query_id, path, sum(1.0 / (60 + rank)) AS score FROM lists WHERE rank <= 30 GROUP BY query_id, path)"""


PICK, THEN = ranges_sql("query", f"DATE '{AS_OF[:10]}'")


def kept_sql(scored: str, k: int = 10, used: bool = True) -> str:
    """CTEs from ``scored`` to ``s``: the first k, moved by time and use."""
    moved = f"""act AS (SELECT path, ln(sum(greatest(date_diff('microsecond', accessed_at, TIMESTAMP '{AS_OF}') / 3.6e9, 0.01) ^ -0.5)) AS act FROM acc GROUP BY path),
z AS (SELECT query_id, path, score, coalesce(act, 0) AS act, max(coalesce(act, 0)) OVER (PARTITION BY query_id) AS top FROM b LEFT JOIN act USING (path)),
s AS (SELECT query_id, path, round(CASE WHEN top > 0 THEN score + 0.2 * act / top ELSE score END, 6) AS score FROM z)"""
    return f"""k AS (SELECT query_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS place FROM {scored}) WHERE place <= {k}),
r1 AS (SELECT query_id, {PICK} FROM q), r2 AS (SELECT query_id, {THEN} FROM r1), rg AS (SELECT *, "start" + floor(("end" - "start") / 2)::int AS anchor FROM r2),
dd AS (SELECT path, CASE WHEN regexp_matches(regexp_replace(left(date_created, 10), '[-/]', '', 'g'), '^\\d{{8}}$') THEN try_strptime(regexp_replace(left(date_created, 10), '[-/]', '', 'g'), '%Y%m%d')::date END AS d FROM documents),
b AS (SELECT k.query_id, k.path, score + CASE WHEN "start" IS NULL OR d IS NULL THEN 0 WHEN d BETWEEN "start" AND "end" THEN 0.3 * (1 - 0.3 * abs(d - anchor) / greatest("end" - "start", 1)) * confidence
  ELSE 0.3 * exp(-abs(d - anchor) / 365.0) * 0.5 * confidence END AS score FROM k LEFT JOIN dd USING (path) LEFT JOIN rg USING (query_id)),
{moved if used else "s AS (SELECT query_id, path, round(score, 6) AS score FROM b)"}"""


FINAL = "SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM s"


def found(df):
    return df.select("query_id", "path", "score", F.col("rank").cast("bigint").alias("rank"))


@R.add("hybrid_search", f"""
WITH {ASKED_SQL}, {ACC}, {legs_sql()}, f AS (SELECT query_id, path, score * CASE WHEN path LIKE '30\\_Journal%' ESCAPE '\\' THEN 1.3 ELSE 1 END AS score FROM fused), {kept_sql('f')} {FINAL}""")  # fmt: skip
def hybrid_search(t):
    return found(S.search(corpus(t), asked_with_vectors(t), now(), S.Options(domains=("Clio",))))


@R.add("typed_search", f"""
WITH {ASKED_SQL}, {ACC}, j AS (SELECT path FROM documents WHERE lower(type) = 'note'), {legs_sql('j')},
f AS (SELECT query_id, path, score FROM fused WHERE path LIKE '30\\_Journal%' ESCAPE '\\' OR path LIKE '50\\_Knowledge%' ESCAPE '\\'), {kept_sql('f')} {FINAL}""")  # fmt: skip
def typed_search(t):
    """One type of document only, in every leg, and only two domains."""
    return found(S.search(corpus(t), asked_with_vectors(t), now(), S.Options(doc_type="note", domains=("Clio", "Urania"), mode="hard")))


ROUTES = f"""dm AS (SELECT domain, i, avg(x::double) AS x, count(*) AS n FROM (SELECT {DOMAIN_SQL.format('path')} AS domain, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM v) GROUP BY domain, i),
dv AS (SELECT domain, list(x ORDER BY i) AS v FROM dm GROUP BY domain HAVING max(n) >= 3),
rs AS (SELECT query_id, domain, round(list_cosine_similarity(dv.v, qv.embedding::double[]), 9) AS conf FROM dv, qv),
rt AS (SELECT query_id, domain, conf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY conf DESC, domain) AS rank FROM rs) WHERE rank <= 2 AND conf >= 0.05),
best AS (SELECT query_id, max(conf) AS best FROM rt GROUP BY query_id),
fj AS (SELECT f.query_id, f.path, f.score, rt.conf, best FROM fused f LEFT JOIN rt ON rt.query_id = f.query_id AND rt.domain = {DOMAIN_SQL.format('f.path')} LEFT JOIN best ON best.query_id = f.query_id)"""


@R.add("routed_search", f"""
WITH {ASKED_SQL}, {ACC}, {legs_sql()}, {ROUTES},
f AS (SELECT query_id, path, CASE WHEN conf IS NOT NULL THEN score ELSE score * greatest(1 - greatest(0, coalesce(best, 0) - 0.2) * 0.5, 0.85) END AS score FROM fj), {kept_sql('f')} {FINAL}""")  # fmt: skip
def routed_search(t):
    """Domains chosen by the mean vectors; what the router didn't choose loses."""
    return found(S.search(corpus(t), asked_with_vectors(t), now(), S.Options(auto_route=True, route_threshold=0.05, mode="penalty")))


@R.add("confident_search", f"""
WITH {ASKED_SQL}, {ACC}, {legs_sql()}, {ROUTES}, g AS (SELECT query_id, path, CASE WHEN conf IS NOT NULL THEN score * least(1 + greatest(0, conf - 0.2) * 2, 1.5) ELSE score END AS score FROM fj),
f AS (SELECT query_id, g.path, score * CASE WHEN lower(type) = 'knowledge' THEN 0.85 ELSE 1 END AS score FROM g JOIN documents USING (path)), {kept_sql('f')} {FINAL}""")  # fmt: skip
def confident_search(t):
    """Domains chosen by the mean vectors and raised by the router's confidence; knowledge a little less."""
    return found(S.search(corpus(t), asked_with_vectors(t), now(), S.Options(auto_route=True, route_threshold=0.05, mode="confidence", knowledge_penalty=0.85)))


SPREAD = spread_sql("SELECT DISTINCT query_id, 'Memory:' || path AS node FROM fr WHERE rank <= 5")


@R.add("spreading_search", f"""
WITH {RANKED}, ff AS (SELECT query_id, path, round(sum(1.0 / (60 + rank)), 8) AS score FROM ranked GROUP BY query_id, path), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM ff),
{SPREAD}, m AS (SELECT query_id, substr(node, 8) AS path, p FROM sp WHERE node LIKE 'Memory:%' AND (query_id, node) NOT IN (SELECT query_id, node FROM sd)), t AS (SELECT query_id, max(p) AS top FROM m GROUP BY 1)
SELECT fr.query_id, fr.path, round(score + coalesce(0.015 * p / top, 0), 6) AS score FROM fr LEFT JOIN m ON m.query_id = fr.query_id AND m.path = fr.path LEFT JOIN t ON t.query_id = fr.query_id""")  # fmt: skip
def spreading_search(t):
    """The fused lists after what spreads from their first five."""
    ranked = ranking.with_rank(rrf_fusion(t), ["query_id"], "path")
    return S.with_spreading(ranked, t("edges")).select("query_id", "path", F.round("score", 6).alias("score"))


@R.add("spreading_topk", f"""
WITH {RANKED}, fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM (SELECT query_id, path, round(sum(1.0 / (60 + rank)), 8) AS score FROM ranked GROUP BY query_id, path)),
en AS (SELECT DISTINCT query_id, unnest(string_split(query, ' ')) AS name FROM search_results WHERE query IS NOT NULL),
ed AS (SELECT DISTINCT label, name FROM (SELECT src_label AS label, src AS name FROM edges UNION ALL SELECT dst_label, dst FROM edges) WHERE label IN ('Person', 'Location', 'Event', 'Period')),
es AS (SELECT query_id, arg_min(label, CASE label WHEN 'Person' THEN 0 WHEN 'Location' THEN 1 WHEN 'Event' THEN 2 ELSE 3 END) || ':' || name AS node FROM en JOIN ed USING (name) GROUP BY query_id, name),
{spread_sql("SELECT DISTINCT query_id, 'Memory:' || path AS node FROM fr WHERE rank <= 3 UNION SELECT query_id, node FROM es")},
m AS (SELECT query_id, substr(node, 8) AS path, round(p, 9) AS score FROM sp WHERE node LIKE 'Memory:%' AND (query_id, node) NOT IN (SELECT query_id, node FROM sd)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM m) SELECT query_id, path, rank FROM o WHERE rank <= 15""")  # fmt: skip
def spreading_topk(t):
    """The memories that most spreads to from the first three hits and the entities that the query names."""
    ranked = ranking.with_rank(rrf_fusion(t), ["query_id"], "path").filter("rank <= 3")
    names = t("search_results").filter("query is not null").select("query_id", F.explode(F.split("query", " ")).alias("name")).distinct()
    seeds = graph.seed_nodes(t("edges"), ranked, names)
    return graph.spreading_activation(t("edges"), seeds, 15).select("query_id", "path", F.col("rank").cast("bigint").alias("rank"))


PARTS_SQL = "parts AS (SELECT result_id || '/' || k AS query_id, result_id AS whole, ws[k] AS query FROM (SELECT result_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT DISTINCT result_id, string_split(query, ' ')[1:3] AS ws FROM search_results WHERE result_id % 50 = 0 AND query IS NOT NULL)))"
DECOMPOSED = f"""{PARTS_SQL}, q AS (SELECT query_id, query FROM parts), {BM25_SQL}, l1 AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM bm25),
f1 AS (SELECT query_id, path, 1.0 / (60 + rank) AS score FROM l1 WHERE rank <= 90), {kept_sql('f1', 30, False)},
pr AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM s),
wh AS (SELECT whole AS query_id, path, round(sum(1.0 / (60 + rank)), 8) AS score FROM pr JOIN parts ON parts.query_id = pr.query_id GROUP BY 1, 2),
wr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM wh)"""


def parts_of(t):
    """The first three words of each query as searches of their own."""
    words = asked(t).select("query_id", F.posexplode(F.slice(F.split("query", " "), 1, 3)).alias("_k", "query"))
    return words.select("query_id", (F.col("_k") + 1).alias("part"), "query")


def plain_corpus(t) -> S.Corpus:
    return S.Corpus(t("documents").select("path", "text", F.col("date_created").alias("date"), "type"), chunk_index(t))


@R.add("decomposed_search", f"WITH {DECOMPOSED} SELECT query_id, path, rank, score FROM wr WHERE rank <= 10")
def decomposed_search(t):
    out = S.decomposed(plain_corpus(t), parts_of(t), now(), 10)
    return out.select(F.col("query_id").cast("bigint").alias("query_id"), "path", F.col("rank").cast("bigint").alias("rank"), "score")


@R.add("answer_context", f"""
WITH {DECOMPOSED}, h AS (SELECT query_id, path, score, rank FROM wr WHERE rank <= 10), ju AS (SELECT query_id, path, round(score / max(score) OVER (PARTITION BY query_id), 6) AS judged FROM h),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY judged DESC, path) AS place FROM ju WHERE judged >= 0.05) SELECT query_id, place, path, judged, length(text) AS n_chars FROM pl JOIN documents USING (path) WHERE place <= 4""")  # fmt: skip
def answer_context(t):
    """What an answer to each query would be written from: planned, searched, fused, judged, four kept."""
    out = S.context(plain_corpus(t), parts_of(t), now(), 10)
    return out.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("place").cast("bigint").alias("place"), "path", "judged", F.char_length("text").cast("bigint").alias("n_chars"))


@R.add("graph_hits", f"""
WITH {ASKED_SQL}, {GRAPH_SQL}, rk AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path) AS rank FROM graph)
SELECT query_id, path, rank, round(1.0 / rank, 6) AS score, d.type, d.date_created AS date FROM rk LEFT JOIN documents d USING (path) WHERE rank <= 15""")  # fmt: skip
def graph_hits(t):
    """Hits of the graph by place, with what the documents say about them."""
    c = S.Corpus(t("documents").select("path", "text", F.col("date_created").alias("date"), "type"), edges=t("edges"))
    hits = S.with_metadata(S.graph_leg(c, asked(t), 15).withColumn("score", F.round("score", 6)), c.documents)
    return hits.select("query_id", "path", F.col("rank").cast("bigint").alias("rank"), "score", "type", "date")


@R.add("similar_vectors", f"WITH {QV} SELECT query_id, vec_id, round({COS}, 5) AS score FROM embeddings a, b WHERE vec_id != query_id AND {COS} >= 0.3")
def similar_vectors(t):
    """Pairs whose vectors are nearly the same, candidates for one name of a thing; every fiftieth against all."""
    pairs = dense.within(t("embeddings"), "vec_id", "embedding", vector_queries(t), 0.3)
    return pairs.filter("vec_id != query_id").withColumn("score", F.round("score", 5))


@R.add("similar_groups", f"""
WITH RECURSIVE {QV}, pr AS (SELECT query_id AS a, vec_id AS b FROM embeddings a, b WHERE vec_id != query_id AND {COS} >= 0.3), l AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr),
w AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, w.root FROM w JOIN l ON l.a = w.node) SELECT node, min(root) AS component FROM w GROUP BY node""")  # fmt: skip
def similar_groups(t):
    """What is linked by such pairs, directly or through others."""
    return connected_components(dense.within(t("embeddings"), "vec_id", "embedding", vector_queries(t), 0.3).select(F.col("query_id").alias("a"), F.col("vec_id").alias("b")), "a", "b")


EVAL = f"""q AS (SELECT item_id AS query_id, question AS query FROM eval_items), {BM25_SQL},
rk AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM bm25),
w AS (SELECT item_id, muse_hint, question, unnest(expected_paths) AS path FROM eval_items),
hit AS (SELECT item_id, min(rank) AS rank FROM w JOIN rk ON rk.query_id = w.item_id AND rk.path = w.path WHERE rank <= 100 GROUP BY item_id),
ev AS (SELECT i.item_id, i.muse_hint, i.question, rank FROM eval_items i LEFT JOIN hit USING (item_id))"""
METRICS = """count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5,
round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr"""


def evaluated(t):
    items = t("eval_items")
    ranked = S.lexical_leg(S.Corpus(index=chunk_index(t)), items.select(F.col("item_id").alias("query_id"), F.col("question").alias("query")), 100)
    return evaluation.best_ranks(items, "item_id", "expected_paths", ranked.select(F.col("query_id").alias("item_id"), "path", "rank"), "path")


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("recall_1", "recall_5", "recall_10", "mrr")})


@R.add("recall_mrr", f"WITH {EVAL} SELECT {METRICS} FROM ev")
def recall_mrr(t):
    return rounded(evaluation.metrics(evaluated(t)))


@R.add("recall_by_domain", f"WITH {EVAL} SELECT muse_hint, {METRICS} FROM ev GROUP BY muse_hint")
def recall_by_domain(t):
    return rounded(evaluation.metrics(evaluated(t), "muse_hint"))


@R.add("recall_by_length", f"WITH {EVAL} SELECT CASE WHEN length(question) < 15 THEN 'short' WHEN length(question) < 40 THEN 'medium' ELSE 'long' END AS bucket, {METRICS} FROM ev GROUP BY 1")
def recall_by_length(t):
    return rounded(evaluation.metrics(evaluated(t).withColumn("bucket", text.length_bucket(F.col("question"))), "bucket"))


@R.add("metric_difference", f"""
WITH {HITS}, now AS (SELECT query_id, max(score) AS s FROM hits GROUP BY 1), x AS (SELECT {DOMAIN_SQL.format('path')} AS domain, avg(score) AS now FROM hits WHERE source = 'fused' GROUP BY 1),
y AS (SELECT {DOMAIN_SQL.format('path')} AS domain, avg(score) AS "then" FROM hits WHERE source != 'fused' GROUP BY 1)
SELECT domain, round(now, 6) AS now, round("then", 6) AS "then", round(now - "then", 6) AS delta,
  CASE WHEN now - "then" < -0.02 THEN 'regression' WHEN now - "then" > 0.005 THEN 'better' WHEN now - "then" < -0.005 THEN 'worse' ELSE 'same' END AS verdict FROM x JOIN y USING (domain)""")  # fmt: skip
def metric_difference(t):
    """Two runs' figures by domain, with the verdict of the gate."""
    rows = hits(t).withColumn("domain", text.domain_of(F.col("path")))
    now, then = (rows.filter(c).groupBy("domain").agg(F.avg("score").alias("m")) for c in ("source = 'fused'", "source != 'fused'"))
    return evaluation.difference(now, then, "domain", "m").withColumns({c: F.round(c, 6) for c in ("now", "then", "delta")})


@R.add("stratified_sample", f"""
WITH {MEM}, s AS (SELECT memory_id, {DOMAIN_SQL.format('path')} AS stratum FROM mem), c AS (SELECT stratum, count(*) AS size FROM s GROUP BY 1), t AS (SELECT sum(size) AS total FROM c),
q AS (SELECT stratum, size, least(size, greatest(1, round(100 * size::double / total)::bigint)) AS quota FROM c, t), d AS (SELECT *, 100 - sum(quota) OVER () AS drift FROM q),
tu AS (SELECT stratum, drift, size, unnest(range(1, 1 + least(4, CASE WHEN drift > 0 THEN size - quota ELSE quota - 1 END)::bigint)) AS turn FROM d WHERE drift != 0),
mv AS (SELECT stratum, count(*) * sign(max(drift)) AS moved FROM (SELECT *, row_number() OVER (ORDER BY turn, size DESC, stratum) AS k FROM tu) WHERE k <= abs(drift) GROUP BY stratum),
q2 AS (SELECT d.stratum, quota + coalesce(moved, 0) AS quota FROM d LEFT JOIN mv USING (stratum)),
o AS (SELECT s.memory_id, s.stratum, quota, row_number() OVER (PARTITION BY s.stratum ORDER BY md5('42' || memory_id::varchar), memory_id) AS place FROM s JOIN q2 USING (stratum))
SELECT memory_id, stratum FROM o WHERE place <= quota""")  # fmt: skip
def stratified_sample(t):
    m = memories.current_memories(t("memories"))
    return evaluation.stratified(m, "memory_id", text.domain_of(F.col("memory_path")), 100).select("memory_id", "stratum")
