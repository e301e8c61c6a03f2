"""Queries of the graph and of the upkeep of memories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import graph as G
from larkspur.operators import lifecycle as L
from larkspur.operators import memories as M
from larkspur.operators import ranking
from larkspur.operators.components import connected_components
from larkspur.operators.ordered import running_sum, with_previous
from larkspur.plans.registry import ACC, AS_OF, MEM, Registry, spread_sql
from larkspur.session import shared_folder

R = Registry()
WHEN = "2025-06-01"


def at(s: str):
    return F.lit(s).cast("timestamp_ntz")


def log(t):
    return M.accesses(t("access_events"))


def mem(t):
    return M.current_memories(t("memories"))


ACT = f"""act AS (SELECT path, ln(sum(greatest(date_diff('microsecond', accessed_at, TIMESTAMP '{AS_OF}') / 3.6e9, 0.01) ^ -0.5)) AS a, count(*) AS n FROM acc GROUP BY path)"""


@R.add("activation", f"WITH {ACC}, {ACT} SELECT path, round(a, 6) AS activation, n FROM act")
def activation(t):
    return ranking.activation(log(t), "memory_path", "accessed_at", at(AS_OF)).select(F.col("memory_path").alias("path"), F.round("activation", 6).alias("activation"), "n")


@R.add("activation_rerank", f"""
WITH {ACC}, {ACT}, h AS (SELECT query_id, regexp_replace(memory_path, '^_vault/', '') AS path, max(score) AS score FROM search_results WHERE score IS NOT NULL GROUP BY ALL),
j AS (SELECT query_id, h.path, score, coalesce(a, 0) AS a, max(coalesce(a, 0)) OVER (PARTITION BY query_id) AS top FROM h LEFT JOIN act ON act.path = h.path)
SELECT query_id, path, round(CASE WHEN top > 0 THEN score + 0.2 * a / top ELSE score END, 6) AS score FROM j""")  # fmt: skip
def activation_rerank(t):
    h = t("search_results").filter("score is not null").groupBy("query_id", text.plain_path(F.col("memory_path")).alias("path")).agg(F.max("score").alias("score"))
    used = ranking.activation(log(t), "memory_path", "accessed_at", at(AS_OF)).withColumnRenamed("memory_path", "path")
    return ranking.blend_activation(h, used, "path", ["query_id"]).select("query_id", "path", F.round("score", 6).alias("score"))


@R.add("chronicle_stats", """
SELECT coalesce(source, 'none') AS source, count(*) AS n_events, count(DISTINCT regexp_replace(memory_path, '^_vault/', '')) AS n_memories, min(accessed_at) AS first_at, max(accessed_at) AS last_at
FROM (SELECT DISTINCT id, source, memory_path, accessed_at FROM access_events) GROUP BY 1""")  # fmt: skip
def chronicle_stats(t):
    rows = t("access_events").select("id", "source", text.plain_path(F.col("memory_path")).alias("path"), "accessed_at").dropDuplicates(["id"])
    return rows.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n_events"), F.countDistinct("path").alias("n_memories"), F.min("accessed_at").alias("first_at"), F.max("accessed_at").alias("last_at"))


@R.add("top_accessed", f"WITH {ACC} SELECT path, count(*) AS n FROM acc GROUP BY path ORDER BY n DESC, path LIMIT 10")
def top_accessed(t):
    return log(t).groupBy(F.col("memory_path").alias("path")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(10)


@R.add("co_recalled", f"""
WITH {ACC}, s AS (SELECT DISTINCT accessed_at, path FROM acc) SELECT x.path AS a, y.path AS b, count(*) AS strength FROM s x JOIN s y ON x.accessed_at = y.accessed_at AND x.path < y.path GROUP BY 1, 2 HAVING count(*) >= 3""")  # fmt: skip
def co_recalled(t):
    return M.co_recalled(log(t), F.col("accessed_at"), "memory_path", 3)


@R.add("forgetting_candidates", f"WITH {MEM}, {ACC}, {ACT} SELECT memory_id, mem.path, round(coalesce(a, 0), 6) AS activation FROM mem LEFT JOIN act ON act.path = mem.path WHERE NOT dormant AND importance = 'low' AND coalesce(a, 0) <= 1.5")
def forgetting_candidates(t):
    used = ranking.activation(log(t), "memory_path", "accessed_at", at(AS_OF))
    return M.forgettable(mem(t), used, threshold=1.5).select("memory_id", F.col("memory_path").alias("path"), F.round("activation", 6).alias("activation"))


@R.add("lifecycle_counts", f"WITH {MEM} SELECT type, count(*) AS n, count(*) FILTER (dormant) AS n_dormant, count(*) FILTER (enriched_at IS NOT NULL) AS n_enriched, count(*) FILTER (path LIKE '10\\_Profile/reflections/%' ESCAPE '\\') AS n_reflections FROM mem GROUP BY type")
def lifecycle_counts(t):
    return mem(t).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("dormant").cast("bigint")).alias("n_dormant"), F.count("enriched_at").alias("n_enriched"), F.sum(F.col("memory_path").startswith("10_Profile/reflections/").cast("bigint")).alias("n_reflections"))


@R.add("debounced_accesses", f"""
WITH {ACC}, l AS (SELECT id, path, accessed_at, lag(accessed_at) OVER (PARTITION BY path ORDER BY accessed_at, id) AS before FROM acc)
SELECT path, count(*) AS n FROM l WHERE before IS NULL OR date_diff('microsecond', before, accessed_at) >= 2000000 GROUP BY path""")  # fmt: skip
def debounced_accesses(t):
    """Accesses of a memory that don't come within two seconds of the one before."""
    rows = with_previous(log(t), "memory_path", "accessed_at", "id", F.date_trunc("day", "accessed_at"), "before")
    kept = rows.filter(F.col("before").isNull() | (F.timestamp_diff("MICROSECOND", F.col("before"), F.col("accessed_at")) >= 2_000_000))
    return kept.groupBy(F.col("memory_path").alias("path")).agg(F.count("*").alias("n"))


EDGE = "rel, src_label, src, dst_label, dst"


@R.add("edges_current", f"SELECT DISTINCT {EDGE} FROM edges WHERE t_valid_end IS NULL")
def edges_current(t):
    return G.current(t("edges")).select("rel", "src_label", "src", "dst_label", "dst").distinct()


@R.add("edges_as_of", f"SELECT DISTINCT {EDGE} FROM edges WHERE t_valid_start <= TIMESTAMP '{WHEN}' AND (t_valid_end IS NULL OR t_valid_end > TIMESTAMP '{WHEN}')")
def edges_as_of(t):
    return G.as_of(t("edges"), at(WHEN)).select("rel", "src_label", "src", "dst_label", "dst").distinct()


@R.add("memories_at_time", f"SELECT DISTINCT src AS path FROM edges WHERE src_label = 'Memory' AND t_valid_start <= TIMESTAMP '{WHEN}' AND (t_valid_end IS NULL OR t_valid_end > TIMESTAMP '{WHEN}')")
def memories_at_time(t):
    return G.memories_at(t("edges"), at(WHEN))


SIDES = """s AS (SELECT src_label AS label, src AS name, dst AS other, rel, t_valid_start, t_valid_end FROM edges UNION ALL SELECT dst_label, dst, src, rel, t_valid_start, t_valid_end FROM edges)"""


@R.add("entity_timeline", f"""
WITH {SIDES}, n AS (SELECT name FROM (SELECT name, count(*) AS c FROM s WHERE label != 'Memory' GROUP BY 1 ORDER BY c DESC, name LIMIT 5)),
f AS (SELECT name, min(CASE label WHEN 'Person' THEN 0 WHEN 'Location' THEN 1 WHEN 'Event' THEN 2 ELSE 3 END) AS k FROM s WHERE name IN (SELECT name FROM n) AND label != 'Memory' GROUP BY 1)
SELECT DISTINCT s.* FROM s JOIN f USING (name) WHERE CASE label WHEN 'Person' THEN 0 WHEN 'Location' THEN 1 WHEN 'Event' THEN 2 WHEN 'Period' THEN 3 END = k""")  # fmt: skip
def entity_timeline(t):
    """Everything about the five nodes with most edges."""
    e = t("edges")
    ends = e.filter("src_label != 'Memory'").select(F.col("src").alias("name")).unionAll(e.filter("dst_label != 'Memory'").select(F.col("dst").alias("name")))
    names = ends.groupBy("name").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "name").limit(5)
    return G.timeline(e, names)


@R.add("graph_stats", "SELECT rel, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst, count(*) FILTER (t_valid_end IS NULL) AS n_open FROM edges GROUP BY rel")
def graph_stats(t):
    return t("edges").groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"), F.sum(F.col("t_valid_end").isNull().cast("bigint")).alias("n_open"))


@R.add("person_degrees", f"WITH {SIDES} SELECT name, count(*) AS degree FROM s WHERE label = 'Person' GROUP BY name")
def person_degrees(t):
    return G.degrees(t("edges"), "Person")


@R.add("spreading_activation", f"""
WITH {spread_sql("SELECT 'q' AS query_id, a AS node FROM (SELECT a, deg FROM g WHERE a LIKE 'Person:%' ORDER BY deg DESC, a LIMIT 5)")} SELECT node, round(p, 6) AS score FROM sp""")  # fmt: skip
def spreading_activation(t):
    """From the five people with most neighbours until nothing changes any more."""
    e = t("edges")
    seeds = G.undirected(e).groupBy("a").agg(F.count("*").alias("deg")).filter("a like 'Person:%'").orderBy(F.desc("deg"), "a").limit(5)
    seeds = seeds.select(F.lit("q").alias("query_id"), F.col("a").alias("node"))
    return G.personalised_pagerank(e, seeds).select("node", F.round("score", 6).alias("score"))


@R.add("invalidated_edges", f"""
WITH v AS (SELECT dst, max(t_ingested) AS ended FROM edges WHERE rel = 'mem_location' AND t_ingested IS NOT NULL GROUP BY dst)
SELECT e.rel, e.src, e.dst, CASE WHEN e.t_valid_end IS NULL AND v.ended IS NOT NULL THEN v.ended ELSE e.t_valid_end END AS t_valid_end,
  CASE WHEN e.t_valid_end IS NULL AND v.ended IS NOT NULL THEN 'audit' ELSE e.invalidated_by END AS invalidated_by FROM edges e LEFT JOIN v ON e.dst = v.dst AND e.rel = 'mem_location'""")  # fmt: skip
def invalidated_edges(t):
    """Open edges to a place end when it was last heard of."""
    e = t("edges")
    verdicts = e.filter("rel = 'mem_location' and t_ingested is not null").groupBy("dst").agg(F.max("t_ingested").alias("ended")).select("dst", F.lit("mem_location").alias("rel"), "ended", F.lit("audit").alias("by"))
    return G.invalidate(e, verdicts, ["rel", "dst"]).select("rel", "src", "dst", "t_valid_end", "invalidated_by")


WOVEN = f"""{MEM}, x AS (SELECT path, period, personal_facts, list_distinct(coalesce(entities.people, [])) AS people, list_distinct(coalesce(entities.locations, [])) AS locations, list_distinct(coalesce(entities.events, [])) AS events FROM mem),
pe AS (SELECT path, unnest(people) AS person FROM x), lo AS (SELECT path, unnest(locations) AS location FROM x), ev AS (SELECT path, unnest(events) AS event FROM x),
pl AS (SELECT path, personal_facts, person, unnest(locations) AS location FROM (SELECT path, personal_facts, locations, unnest(people) AS person FROM x)),
wv AS (SELECT 'mem_person' AS rel, path AS src, person AS dst FROM pe UNION SELECT 'mem_location', path, location FROM lo UNION SELECT 'mem_event', path, event FROM ev UNION SELECT 'mem_period', path, period FROM x WHERE period != ''
  UNION SELECT 'event_loc', event, location FROM ev JOIN lo USING (path) UNION SELECT 'person_event', person, event FROM pe JOIN ev USING (path)
  UNION SELECT 'person_loc', person, location FROM pl WHERE len(list_filter(coalesce(personal_facts, []), lambda f: contains(f, person) AND contains(f, location))) > 0)"""


@R.add("weave_edges", f"WITH {WOVEN} SELECT rel, src, dst FROM wv")
def weave_edges(t):
    return G.weave(mem(t), at(AS_OF)).select("rel", "src", "dst")


@R.add("weave_missing", f"WITH {WOVEN} SELECT rel, src, dst FROM wv WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.rel = wv.rel AND e.src = wv.src AND e.dst = wv.dst)")
def weave_missing(t):
    """Edges that follow from the memories and aren't in the graph yet."""
    return G.insert_new(t("edges"), G.weave(mem(t), at(AS_OF)), ["rel", "src", "dst"]).select("rel", "src", "dst")


@R.add("outgoing_edges", "SELECT src AS path, rel, count(*) AS n, min(dst) AS first_dst FROM edges WHERE src_label = 'Memory' GROUP BY ALL")
def outgoing_edges(t):
    return t("edges").filter("src_label = 'Memory'").groupBy(F.col("src").alias("path"), "rel").agg(F.count("*").alias("n"), F.min("dst").alias("first_dst"))


@R.add("backfilled_times", "SELECT rel, src, dst, coalesce(t_ingested, t_valid_start, TIMESTAMP '2026-01-01 00:00:00') AS t_ingested FROM edges")
def backfilled_times(t):
    return t("edges").select("rel", "src", "dst", F.coalesce("t_ingested", "t_valid_start", at(AS_OF)).alias("t_ingested"))


NAMES = f"""{SIDES}, dg AS (SELECT name, count(*) AS degree FROM s WHERE label = 'Person' GROUP BY name),
k AS (SELECT DISTINCT p.name, translate(lower(p.name), '-_ ', '') AS key, coalesce(degree, 0) AS degree FROM persons p LEFT JOIN dg ON dg.name = p.name),
grp AS (SELECT key, list_sort(list(name)) AS names, first(name ORDER BY degree DESC, name) AS canonical FROM k GROUP BY key HAVING count(*) > 1)"""


def _name_groups(t):
    return M.name_groups(t("persons"), "name", G.degrees(t("edges"), "Person"))


@R.add("name_groups", f"WITH {NAMES} SELECT key, names, canonical FROM grp")
def name_groups(t):
    return _name_groups(t)


@R.add("merged_edges", f"""
WITH {NAMES}, c AS (SELECT unnest(names) AS name, canonical FROM grp)
SELECT e.rel, coalesce(a.canonical, e.src) AS src, coalesce(b.canonical, e.dst) AS dst, min(t_valid_start) AS t_valid_start, min(t_ingested) AS t_ingested FROM edges e
LEFT JOIN c a ON e.src_label = 'Person' AND a.name = e.src LEFT JOIN c b ON e.dst_label = 'Person' AND b.name = e.dst GROUP BY e.rel, e.src_label, 2, e.dst_label, 3""")  # fmt: skip
def merged_edges(t):
    to = _name_groups(t).select(F.explode("names").alias("name"), "canonical")
    return M.merge_nodes(t("edges"), "Person", to).select("rel", "src", "dst", "t_valid_start", "t_ingested")


@R.add("merged_aliases", f"""
WITH {NAMES}, c AS (SELECT unnest(names) AS name, canonical FROM grp), x AS (SELECT canonical, unnest(list_concat([p.name], coalesce(p.aliases, []))) AS alias FROM persons p JOIN c USING (name))
SELECT canonical, list_sort(list(DISTINCT alias)) AS aliases FROM x WHERE alias != canonical GROUP BY canonical""")  # fmt: skip
def merged_aliases(t):
    to = _name_groups(t).select(F.explode("names").alias("name"), "canonical")
    return M.aliases_after_merge(t("persons"), to)


ALIAS = """am AS (SELECT alias_key, min(name) AS name FROM (SELECT translate(lower(alias), '-_ ', '') AS alias_key, name FROM (SELECT name, unnest(list_concat([name], coalesce(aliases, []))) AS alias FROM persons)) WHERE alias_key != '' GROUP BY 1)"""


@R.add("alias_map", f"WITH {ALIAS} SELECT alias_key, name FROM am")
def alias_map(t):
    return M.alias_map(t("persons"))


@R.add("resolved_people", f"""
WITH {MEM}, {ALIAS}, x AS (SELECT memory_id, unnest(coalesce(entities.people, [])) AS person FROM mem)
SELECT memory_id, list_sort(list(DISTINCT coalesce(name, person))) AS people FROM x LEFT JOIN am ON alias_key = translate(lower(person), '-_ ', '') GROUP BY memory_id""")  # fmt: skip
def resolved_people(t):
    rows = mem(t).select("memory_id", F.explode("entities.people").alias("person")).withColumn("alias_key", text.name_key(F.col("person")))
    return rows.join(M.alias_map(t("persons")), "alias_key", "left").groupBy("memory_id").agg(F.array_sort(F.collect_set(F.coalesce("name", "person"))).alias("people"))


@R.add("graph_components", """
WITH RECURSIVE ed AS (SELECT DISTINCT src_label || ':' || src AS a, dst_label || ':' || dst AS b FROM edges WHERE rel IN ('person_loc', 'person_event', 'event_loc')), l AS (SELECT a, b FROM ed WHERE a != b UNION SELECT b, a FROM ed WHERE a != b),
w AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, w.root FROM w JOIN l ON l.a = w.node) SELECT node, min(root) AS component FROM w GROUP BY node""")  # fmt: skip
def graph_components(t):
    """What is linked among the entities, by all relations between them."""
    e = t("edges").filter(F.col("rel").isin("person_loc", "person_event", "event_loc"))
    return connected_components(e.select(G.node_id("src_label", "src").alias("a"), G.node_id("dst_label", "dst").alias("b")), "a", "b")


WORDS = "'[a-zA-Z0-9]{{2,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'".replace("{{", "{").replace("}}", "}")


@R.add("validated_memories", f"""
WITH {MEM}, x AS (SELECT mem.*, coalesce(dc.text, '') AS text FROM mem LEFT JOIN documents dc ON dc.path = mem.path)
SELECT memory_id, list_filter(coalesce(entities.locations, []), lambda l: length(trim(l)) > 0 AND contains(text, trim(l))) AS locations,
  list_filter(coalesce(entities.people, []), lambda p: length(trim(p)) > 0 AND contains(text, trim(p)) AND p NOT IN ('我', '你', '他', '她', '我們', '他們')) AS people,
  list_filter(coalesce(entities.emotions, []), lambda e: length(trim(e)) > 0 AND contains(text, trim(e))) AS emotions,
  list_filter(coalesce(entities.events, []), lambda e: len(list_filter(regexp_extract_all(e, {WORDS}), lambda w: contains(text, w))) > 0) AS events,
  CASE WHEN len(list_filter(regexp_extract_all(coalesce(period, ''), {WORDS}), lambda w: contains(text, w))) > 0 THEN period ELSE '' END AS period,
  list_filter(coalesce(personal_facts, [])[1:5], lambda f: len(list_filter(regexp_extract_all(f, {WORDS}), lambda w: contains(text, w))) > 0) AS facts,
  coalesce(themes, [])[1:4] AS themes, CASE WHEN chat_category IN ('work', 'life', 'knowledge', 'creative', 'emotion') THEN chat_category END AS chat_category FROM x""")  # fmt: skip
def validated_memories(t):
    rows = mem(t).join(t("documents").select(F.col("path").alias("memory_path"), "text"), "memory_path", "left")
    return M.validated(rows, "text").select("memory_id", "locations", "people", "emotions", "events", "period", "facts", "themes", "chat_category")


@R.add("facts_of_people", f"""
WITH {MEM}, x AS (SELECT memory_id, unnest(entities.people) AS person, personal_facts FROM mem), f AS (SELECT DISTINCT person, fact FROM (SELECT person, unnest(personal_facts) AS fact FROM x) WHERE contains(fact, person) AND person != '')
SELECT person, count(*) AS n FROM f GROUP BY person HAVING count(*) >= 2""")  # fmt: skip
def facts_of_people(t):
    """Facts that name a person of the same memory."""
    rows = mem(t).select(F.explode("entities.people").alias("person"), "personal_facts").select("person", F.explode("personal_facts").alias("fact"))
    return rows.filter(F.col("fact").contains(F.col("person")) & (F.col("person") != "")).distinct().groupBy("person").agg(F.count("*").alias("n")).filter("n >= 2")


@R.add("recent_memories", f"WITH {MEM} SELECT memory_id, d AS date FROM mem WHERE d >= DATE '2026-01-01' - 30 AND NOT dormant")
def recent_memories(t):
    return mem(t).filter((F.col("date") >= F.date_sub(F.lit("2026-01-01").cast("date"), 30)) & ~F.col("dormant")).select("memory_id", "date")


@R.add("theme_groups", f"""
WITH {MEM}, x AS (SELECT path, unnest(themes) AS theme, len(personal_facts) AS nf FROM mem WHERE NOT dormant)
SELECT theme, sum(nf)::bigint AS n_facts, count(DISTINCT path) AS n_sources, list_sort(list(DISTINCT path))[1:5] AS first_sources FROM x WHERE theme IS NOT NULL GROUP BY theme HAVING sum(nf) >= 5""")  # fmt: skip
def theme_groups(t):
    return L.theme_groups(mem(t), 5, 5)


@R.add("corrected_texts", """
SELECT doc_id, CASE WHEN (length(text) - length(replace(text, title, ''))) / length(title) = 1 THEN 'applied' ELSE 'refused' END AS outcome,
  CASE WHEN (length(text) - length(replace(text, title, ''))) / length(title) = 1 THEN md5(replace(text, title, '[title]')) END AS digest,
  length(title) > 120 OR abs(7 - length(title)) > 200 AS risky FROM documents WHERE title IS NOT NULL AND title != '' AND text IS NOT NULL""")  # fmt: skip
def corrected_texts(t):
    docs = t("documents").filter("title is not null and title != '' and text is not null").select("doc_id", "path", "title", "text")
    edits = docs.select("path", F.col("title").alias("old"), F.lit("[title]").alias("new"))
    return M.correct_texts(docs, edits).select("doc_id", "outcome", F.md5("corrected").alias("digest"), "risky")


@R.add("edited_tags", f"""
WITH {MEM} SELECT memory_id, CASE WHEN memory_id % 3 = 0 THEN ['reviewed'] WHEN memory_id % 3 = 1 AND NOT list_contains(coalesce(tags, []), 'reviewed') THEN list_append(coalesce(tags, []), 'reviewed')
  WHEN memory_id % 3 = 2 THEN list_filter(coalesce(tags, []), lambda v: NOT contains(v, '-')) ELSE coalesce(tags, []) END AS tags FROM mem""")  # fmt: skip
def edited_tags(t):
    pick = (F.col("memory_id") % 3 + 1).cast("int")
    action = F.element_at(F.array(F.lit("set"), F.lit("add"), F.lit("remove")), pick)
    value = F.element_at(F.array(F.lit("reviewed"), F.lit("reviewed"), F.lit("-")), pick)
    return mem(t).select("memory_id", M.set_field(F.col("tags"), action, value).alias("tags"))


@R.add("new_chunks", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE regexp_replace(m.memory_path, '^_vault/', '') = d.path)")
def new_chunks(t):
    """Documents that no memory has yet."""
    return t("documents").join(mem(t).select(F.col("memory_path").alias("path")), "path", "left_anti").select("doc_id")


@R.add("replaced_paths", """
WITH fresh AS (SELECT path, title FROM documents WHERE lower(lang) = 'fr') SELECT path, 'old' AS version FROM documents d WHERE path NOT IN (SELECT path FROM fresh) UNION ALL SELECT path, 'new' FROM fresh""")  # fmt: skip
def replaced_paths(t):
    """A cascade: all rows of the changed paths are replaced."""
    old = t("documents").select("path", F.lit("old").alias("version"))
    fresh = t("documents").filter("lower(lang) = 'fr'").select("path", F.lit("new").alias("version"))
    return M.replaced_by_key(old, fresh, ["path"])


@R.add("history_window", """
WITH m AS (SELECT DISTINCT message_id, conv_id, turn, lower(role) AS role FROM messages),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, message_id DESC) AS k FROM m WHERE role != 'system')
SELECT message_id, conv_id, turn FROM r WHERE k <= 16 UNION ALL SELECT message_id, conv_id, turn FROM m WHERE role = 'system'""")  # fmt: skip
def history_window(t):
    """The last sixteen turns of each conversation, and its system turns."""
    m = t("messages").select("message_id", "conv_id", "turn", F.lower("role").alias("role")).distinct()
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("message_id")))
    last = m.filter("role != 'system'").withColumn("k", k).filter("k <= 16").drop("k")
    return last.unionByName(m.filter("role = 'system'")).select("message_id", "conv_id", "turn")


@R.add("latest_search", "SELECT query, max(searched_at) AS searched_at, arg_max(query_id, (searched_at, query_id)) AS query_id FROM search_results WHERE query IS NOT NULL AND searched_at IS NOT NULL GROUP BY query")
def latest_search(t):
    rows = t("search_results").filter("query is not null and searched_at is not null")
    return rows.groupBy("query").agg(F.max("searched_at").alias("searched_at"), F.max_by("query_id", F.struct("searched_at", "query_id")).alias("query_id"))


@R.add("capped_facts", f"""
WITH {MEM}, x AS (SELECT path, memory_id, coalesce(len(personal_facts), 0) AS n FROM mem),
r AS (SELECT *, sum(n) OVER (ORDER BY path, memory_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x) SELECT memory_id, n::bigint AS n FROM r WHERE coalesce(before, 0) < 400""")  # fmt: skip
def capped_facts(t):
    """Memories in the order of their paths up to the one with which they reach four hundred facts."""
    x = mem(t).select("memory_path", "memory_id", F.size(F.coalesce("personal_facts", text.empty_strings())).cast("bigint").alias("n"))
    return running_sum(x, ["memory_path", "memory_id"], "n", "before").filter("before < 400").select("memory_id", "n")


@R.add("list_journals", f"WITH {MEM} SELECT path, left(regexp_replace(summary, chr(10), ' ', 'g'), 80) AS line FROM mem WHERE path LIKE '30\\_Journal/2024/%' ESCAPE '\\' ORDER BY path DESC LIMIT 20")
def list_journals(t):
    rows = mem(t).filter(F.col("memory_path").startswith("30_Journal/2024/"))
    return rows.orderBy(F.desc("memory_path")).limit(20).select(F.col("memory_path").alias("path"), F.substring(F.replace("summary", F.lit("\n"), F.lit(" ")), 1, 80).alias("line"))


@R.add("keyword_finder", "SELECT doc_id, contains(lower(path), 'lantern') AS in_path FROM documents WHERE contains(lower(path), 'lantern') OR contains(lower(coalesce(text, '')), 'lantern')")
def keyword_finder(t):
    in_path = F.lower("path").contains("lantern")
    return t("documents").filter(in_path | F.lower(F.coalesce("text", F.lit(""))).contains("lantern")).select("doc_id", in_path.alias("in_path"))


@R.add("profile_texts", "SELECT path, left(text, 250) AS start FROM documents WHERE path LIKE '10\\_Profile/%' ESCAPE '\\' AND text IS NOT NULL")
def profile_texts(t):
    return t("documents").filter(F.col("path").startswith("10_Profile/") & F.col("text").isNotNull()).select("path", F.substring("text", 1, 250).alias("start"))


@R.add("review_counts", f"WITH {MEM}, x AS (SELECT unnest(needs_review) AS reason FROM memories) SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY reason")
def review_counts(t):
    return t("memories").select(F.explode("needs_review").alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@R.add("chat_categories_to_fill", f"WITH {MEM} SELECT memory_id FROM mem WHERE (path LIKE '20\\_AI\\_Chats%' ESCAPE '\\' OR type = 'chat') AND chat_category IS NULL")
def chat_categories_to_fill(t):
    chats = F.col("memory_path").startswith("20_AI_Chats") | (F.col("type") == "chat")
    return mem(t).filter(chats & F.col("chat_category").isNull()).select("memory_id")


@R.add("memory_domains", f"""
WITH {MEM}, x AS (SELECT memory_id, path, type, coalesce(period, '') AS period, d, array_to_string(coalesce(themes, []), ' ') AS th, array_to_string(coalesce(entities.emotions, []), ' ') AS em FROM mem),
y AS (SELECT *, path LIKE '30\\_Journal%' ESCAPE '\\' AS j, period != '' OR contains(th, 'history') OR coalesce(year(d) <= 2023, false) AS old FROM x)
SELECT memory_id, j AND old AS clio, j AND NOT old AS thalia, path LIKE '20\\_AI\\_Chats%' ESCAPE '\\' OR coalesce(type = 'chat', false) AS calliope, path LIKE '50\\_Knowledge%' ESCAPE '\\' AS urania,
  path LIKE '10\\_Profile%' ESCAPE '\\' OR coalesce(type = 'bio', false) AS polyhymnia, path LIKE '40\\_Projects%' ESCAPE '\\' AS terpsichore,
  regexp_matches(th || ' ' || em, 'love|愛|感情') AS erato, regexp_matches(th || ' ' || em, 'sad|anxious|anxiety|grief|焦慮|悲傷') AS melpomene, regexp_matches(th, 'music|art|craft|creative|音樂|創作') AS euterpe FROM y""")  # fmt: skip
def memory_domains(t):
    """Which of nine domains a memory belongs to."""
    joined = lambda c: F.array_join(F.coalesce(F.col(c), text.empty_strings()), " ")
    m = mem(t).withColumns({"th": joined("themes"), "em": joined("entities.emotions")})
    p, journal = F.col("memory_path"), F.col("memory_path").startswith("30_Journal")
    old = (F.coalesce("period", F.lit("")) != "") | F.col("th").contains("history") | F.coalesce(F.year("date") <= 2023, F.lit(False))
    is_type = lambda k: F.coalesce(F.col("type") == k, F.lit(False))
    both = F.concat_ws(" ", "th", "em")
    return m.select(
        "memory_id", (journal & old).alias("clio"), (journal & ~old).alias("thalia"), (p.startswith("20_AI_Chats") | is_type("chat")).alias("calliope"), p.startswith("50_Knowledge").alias("urania"),
        (p.startswith("10_Profile") | is_type("bio")).alias("polyhymnia"), p.startswith("40_Projects").alias("terpsichore"), both.rlike("love|愛|感情").alias("erato"),
        both.rlike("sad|anxious|anxiety|grief|焦慮|悲傷").alias("melpomene"), F.col("th").rlike("music|art|craft|creative|音樂|創作").alias("euterpe"),
    )


@R.add("stream_new_messages", "SELECT DISTINCT message_id, conv_id FROM messages")
def stream_new_messages(t):
    """Messages taken in as a stream, each key once, however often it is delivered."""
    import uuid

    from larkspur.streaming.jobs import append_new

    source = t("messages")
    spark = source.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    first = source.inputFiles()[0]
    folder, name = first.rsplit("/", 1)
    pattern = name if len(source.inputFiles()) == 1 else "*.parquet"
    fresh = spark.readStream.schema(source.schema).option("pathGlobFilter", pattern).parquet(folder).select("message_id", "conv_id")
    append_new(fresh, f"{base}/table", ["message_id"], f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/table").select("message_id", "conv_id")
