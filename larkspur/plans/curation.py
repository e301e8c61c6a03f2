"""Queries of edits, verdicts, audits, imports and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import chunks as C
from larkspur.operators import edits as E
from larkspur.operators import evaluation
from larkspur.operators import lifecycle as L
from larkspur.operators import memories as M
from larkspur.plans.registry import AS_OF, MEM, Registry
from larkspur.plans.retrieval import EVAL, METRICS, evaluated, rounded
from larkspur.plans.texts import PARAGRAPHS
from larkspur.sources import inbox

R = Registry()


def at(s: str = AS_OF):
    return F.lit(s).cast("timestamp_ntz")


def mem(t):
    return M.current_memories(t("memories"))


def flat(m):
    """The lists of ``entities`` as columns of their own."""
    return m.withColumns({k: F.col(f"entities.{k}") for k in ("people", "locations", "events", "emotions")})


#: Three edits of every memory, one after the other.
EDITED = f"""{MEM}, e0 AS (SELECT memory_id, path, coalesce(personal_facts, []) AS f0, coalesce(entities.people[1] || ' lives in ' || entities.locations[1], 'keeps a new notebook') AS n1, entities FROM mem),
e1 AS (SELECT *, CASE WHEN NOT list_contains(f0, n1) THEN list_append(f0, n1) ELSE f0 END AS f1, CASE WHEN NOT list_contains(f0, n1) THEN len(f0) END AS p1 FROM e0),
e2 AS (SELECT *, list_filter(f1, lambda v: contains(v, 'lives')) AS h2 FROM e1),
e3 AS (SELECT *, CASE WHEN len(h2) = 1 THEN [CASE WHEN v = h2[1] THEN 'writes on paper' ELSE v END for v in f1] ELSE f1 END AS f2, CASE WHEN len(h2) = 1 THEN list_position(f1, h2[1]) - 1 END AS p2 FROM e2),
e4 AS (SELECT *, list_filter(f2, lambda v: contains(v, 'paper')) AS h3 FROM e3),
e5 AS (SELECT *, CASE WHEN memory_id % 2 = 0 AND len(h3) = 1 THEN list_filter(f2, lambda v: v != h3[1]) ELSE f2 END AS f3, CASE WHEN memory_id % 2 = 0 AND len(h3) = 1 THEN list_position(f2, h3[1]) - 1 END AS p3 FROM e4)"""


def edited(t):
    m = mem(t)
    told = F.coalesce(F.concat(F.get("entities.people", F.lit(0)), F.lit(" lives in "), F.get("entities.locations", F.lit(0))), F.lit("keeps a new notebook"))
    steps = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("add").alias("op"), F.lit("").alias("old"), told.alias("new")),
        F.struct(F.lit(2).alias("step"), F.lit("update").alias("op"), F.lit("lives").alias("old"), F.lit("writes on paper").alias("new")),
        F.struct(F.lit(3).alias("step"), F.lit("remove").alias("op"), F.lit("paper").alias("old"), F.lit("").alias("new")),
    )
    edits = m.select("memory_id", "memory_path", F.inline(steps)).filter("step < 3 or memory_id % 2 = 0").drop("memory_id")
    return m, E.apply_fact_edits(m, edits)


@R.add("edited_facts", f"WITH {EDITED} SELECT memory_id, f3 AS after FROM e5")
def edited_facts(t):
    return edited(t)[1].select("memory_id", "after")


@R.add("edit_log", f"""
WITH {EDITED} SELECT path AS memory_path, step, op, place::int AS place, CASE WHEN place IS NULL THEN 'unchanged' ELSE 'applied' END AS outcome FROM (
  SELECT path, 1 AS step, 'add' AS op, p1 AS place FROM e5 UNION ALL SELECT path, 2, 'update', p2 FROM e5 UNION ALL SELECT path, 3, 'remove', p3 FROM e5 WHERE memory_id % 2 = 0)""")  # fmt: skip
def edit_log(t):
    return E.edit_log(edited(t)[1], at()).select("memory_path", "step", "op", "place", "outcome")


@R.add("reverted_facts", f"WITH {MEM} SELECT memory_id, coalesce(personal_facts, []) AS facts FROM mem")
def reverted_facts(t):
    """Edits applied, logged and taken back by the log: every list as it was."""
    m, applied = edited(t)
    now = applied.select("memory_id", "memory_path", F.col("after").alias("personal_facts"))
    back = E.revert_edits(now, E.edit_log(applied, at()))
    return now.join(back, "memory_path", "left").select("memory_id", F.coalesce("reverted", "personal_facts").alias("facts"))


@R.add("pending_embeddings", f"WITH {EDITED} SELECT path AS memory_path, ((p1 IS NOT NULL)::int + (p2 IS NOT NULL)::int + (p3 IS NOT NULL)::int)::bigint AS n FROM e5 WHERE coalesce(p1, p2, p3) IS NOT NULL")
def pending_embeddings(t):
    return E.pending_embeddings(E.edit_log(edited(t)[1], at())).select("memory_path", "n")


@R.add("synced_edges", f"""
WITH {EDITED}, gone AS (SELECT DISTINCT left(h2[1], 80) AS ev FROM e5 WHERE p2 IS NOT NULL UNION SELECT left(h3[1], 80) FROM e5 WHERE p3 IS NOT NULL),
k AS (SELECT rel, src, dst, CASE WHEN t_valid_end IS NULL AND rel IN ('person_loc', 'person_event') AND evidence IN (SELECT ev FROM gone) THEN 'edit' ELSE invalidated_by END AS invalidated_by,
  t_valid_end IS NULL AND NOT coalesce(rel IN ('person_loc', 'person_event') AND evidence IN (SELECT ev FROM gone), false) AS open FROM edges),
nf AS (SELECT n1 AS fact, entities FROM e5 WHERE p1 IS NOT NULL UNION ALL SELECT 'writes on paper', entities FROM e5 WHERE p2 IS NOT NULL),
np AS (SELECT fact, src, unnest(entities.locations) AS dst FROM (SELECT fact, entities, unnest(entities.people) AS src FROM nf)), nw AS (SELECT DISTINCT src, dst FROM np WHERE contains(fact, src) AND contains(fact, dst))
SELECT rel, src, dst, invalidated_by, open FROM k UNION ALL SELECT 'person_loc', src, dst, NULL, true FROM nw WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.rel = 'person_loc' AND k.open AND k.src = nw.src AND k.dst = nw.dst)""")  # fmt: skip
def synced_edges(t):
    """The graph after the edits."""
    m, applied = edited(t)
    found = E.synced_edges(t("edges"), E.edit_log(applied, at()), flat(m), at())
    return found.select("rel", "src", "dst", "invalidated_by", F.col("t_valid_end").isNull().alias("open"))


CHECKED = f"""{MEM}, x AS (SELECT mem.memory_id, mem.path, mem.entities, coalesce(dc.text, '') AS text FROM mem LEFT JOIN documents dc ON dc.path = mem.path),
iss AS (SELECT memory_id, path, 'locations' AS field, list_distinct(list_filter(coalesce(entities.locations, []), lambda l: NOT (length(trim(l)) > 0 AND contains(text, trim(l))))) AS gone FROM x
  UNION ALL SELECT memory_id, path, 'emotions', list_distinct(list_filter(coalesce(entities.emotions, []), lambda l: NOT (length(trim(l)) > 0 AND contains(text, trim(l))))) FROM x)"""


def audited(t):
    m = flat(mem(t)).select("memory_id", "memory_path", "entities", "personal_facts", "themes", "period", "chat_category", "locations", "emotions")
    rows = m.join(t("documents").select(F.col("path").alias("memory_path"), "text"), "memory_path", "left")
    checked = M.validated(rows.select("memory_id", "memory_path", "entities", "personal_facts", "themes", "period", "chat_category", "text"), "text")
    lists = m.select("memory_id", "memory_path", "locations", "emotions")
    return lists, L.audit_issues(lists, checked.select("memory_path", "locations", "emotions"))


@R.add("audit_report", f"WITH {CHECKED} SELECT field, sum(len(gone))::bigint AS n_issues, count(*) FILTER (len(gone) > 0) AS n_memories, (SELECT count(*) FROM mem) AS n_scanned FROM iss GROUP BY field HAVING sum(len(gone)) > 0")
def audit_report(t):
    """Entities that the source text doesn't bear out."""
    lists, issues = audited(t)
    return L.audit_report(lists, issues)


@R.add("corrected_memories", f"""
WITH {CHECKED}, l AS (SELECT x.memory_id, coalesce(entities.locations, []) AS v, gone FROM x JOIN iss ON iss.memory_id = x.memory_id AND field = 'locations')
SELECT memory_id, list_filter(v, lambda a: len(list_filter(gone, lambda g: contains(a, g))) = 0) AS locations FROM l""")  # fmt: skip
def corrected_memories(t):
    """The report's corrections applied to the lists they are about."""
    lists, issues = audited(t)
    return E.correct_fields(lists, E.corrections(issues)).select("memory_id", F.coalesce("locations", text.empty_strings()).alias("locations"))


VERDICTS = """vd AS (SELECT src AS subject, rel, dst AS old_object, CASE left(md5(src || dst), 1) WHEN '0' THEN 'UPDATE' WHEN '1' THEN 'INVALIDATE' WHEN '2' THEN 'ADD' ELSE 'NOOP' END AS operation
  FROM (SELECT DISTINCT rel, src, dst FROM edges WHERE rel IN ('person_loc', 'person_event') AND src_label = 'Person'))"""


@R.add("verdict_edges", f"""
WITH {MEM}, {VERDICTS}, pf AS (SELECT person, path FROM (SELECT path, unnest(entities.people) AS person FROM mem WHERE len(personal_facts) > 0)), fs AS (SELECT person, min(path) AS first_path FROM pf GROUP BY 1),
en AS (SELECT rel, subject, old_object, first_path FROM vd LEFT JOIN fs ON person = subject WHERE operation IN ('UPDATE', 'INVALIDATE')),
k AS (SELECT e.rel, e.src, e.dst, e.t_valid_end IS NULL AND en.subject IS NULL AS open, CASE WHEN e.t_valid_end IS NULL AND en.subject IS NOT NULL THEN first_path ELSE e.invalidated_by END AS invalidated_by
  FROM edges e LEFT JOIN en ON en.rel = e.rel AND en.subject = e.src AND en.old_object = e.dst AND e.src_label = 'Person'),
nw AS (SELECT DISTINCT rel, subject AS src, 'Newtown' AS dst FROM vd WHERE operation IN ('ADD', 'UPDATE'))
SELECT rel, src, dst, open, invalidated_by FROM k UNION ALL SELECT rel, src, dst, true, NULL FROM nw WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.open AND k.rel = nw.rel AND k.src = nw.src AND k.dst = nw.dst)""")  # fmt: skip
def verdict_edges(t):
    """Verdicts on some facts of people; the source of a change is the person's first fact."""
    pairs = t("edges").filter("rel in ('person_loc', 'person_event') and src_label = 'Person'").select(F.col("src").alias("subject"), "rel", F.col("dst").alias("old_object")).distinct()
    digit = F.substring(F.md5(F.concat("subject", "old_object")), 1, 1)
    verdicts = pairs.withColumns({"operation": F.when(digit == "0", "UPDATE").when(digit == "1", "INVALIDATE").when(digit == "2", "ADD").otherwise("NOOP"), "new_object": F.lit("Newtown"), "fact": F.lit("")})
    facts = mem(t).select(F.col("memory_path").alias("path"), F.explode("entities.people").alias("person"), "personal_facts").select("path", "person", F.explode("personal_facts").alias("fact"))
    found = L.apply_verdicts(t("edges"), L.with_source(verdicts, facts), at())
    return found.select("rel", "src", "dst", F.col("t_valid_end").isNull().alias("open"), "invalidated_by")


@R.add("reflection_input", f"""
WITH {MEM}, r AS (SELECT path AS memory_path, d AS date, left(coalesce(summary, title, ''), 200) AS line FROM mem WHERE d BETWEEN DATE '2025-11-02' AND DATE '2026-01-01' AND NOT dormant) SELECT * FROM r WHERE (SELECT count(*) FROM r) >= 3""")  # fmt: skip
def reflection_input(t):
    return L.reflection_rows(mem(t), F.lit("2026-01-01").cast("date"), 60, 3)


@R.add("theme_documents", f"""
WITH {MEM}, f AS (SELECT DISTINCT theme, fact FROM (SELECT theme, unnest(facts) AS fact FROM (SELECT unnest(themes) AS theme, personal_facts AS facts FROM mem WHERE NOT dormant)) WHERE theme IS NOT NULL),
n AS (SELECT theme, ceil(count(*) / 200.0)::bigint AS parts FROM f GROUP BY theme HAVING count(*) >= 5), p AS (SELECT f.theme, fact, ('0x' || left(md5(fact), 8))::bigint % parts AS part FROM f JOIN n USING (theme))
SELECT theme, part, count(*) AS n_facts, md5(array_to_string(list_sort(list('- ' || fact)), chr(10))) AS digest FROM p GROUP BY theme, part""")  # fmt: skip
def theme_documents(t):
    return L.theme_documents(mem(t)).select("theme", "part", "n_facts", F.md5("text").alias("digest"))


@R.add("traced_paths", f"""
WITH {MEM}, {PARAGRAPHS}, a AS (SELECT path FROM mem WHERE memory_id % 50 = 0), ch AS (SELECT path, path || '::para' || (i - 1) AS chunk_id FROM (SELECT path, unnest(range(1, len(paras) + 1)) AS i FROM p))
SELECT path, 'memory' AS kind, count(*) AS n, min(title) AS first FROM mem WHERE path IN (SELECT path FROM a) GROUP BY path UNION ALL SELECT src, 'edge ' || rel, count(*), min(dst) FROM edges WHERE src_label = 'Memory' AND src IN (SELECT path FROM a) GROUP BY src, rel
UNION ALL SELECT path, 'chunk', count(*), min(chunk_id) FROM ch WHERE path IN (SELECT path FROM a) GROUP BY path""")  # fmt: skip
def traced_paths(t):
    """What there is about every fiftieth memory."""
    m = mem(t)
    asked = m.filter("memory_id % 50 = 0").select(F.col("memory_path").alias("path"))
    return L.trace(asked, m, t("edges"), C.paragraph_chunks(t("documents"), "path", "text"))


@R.add("files_to_enrich", "SELECT path FROM documents WHERE path LIKE '%.md' AND NOT regexp_matches(path, '(^|/)(00_System|10_Profile)/') AND NOT contains(coalesce(text, ''), 'enriched_at:') AND string_split(path, '/')[-1] NOT IN ('README.md', '.cursorrules')")
def files_to_enrich(t):
    return inbox.to_enrich(t("documents").select("path", "text")).select("path")


STEM = "regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')"
ENDS = "'^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g'"


@R.add("imported_chats", f"""
WITH c AS (SELECT path, coalesce(text, '') AS body, {STEM} AS stem FROM documents WHERE path LIKE '20\\_AI\\_Chats/%' ESCAPE '\\'),
x AS (SELECT *, regexp_replace(stem, '_[0-9a-f]{{8,}}$', '') AS short, list_filter([regexp_replace(s, {ENDS}) for s in string_split(body, chr(10))], lambda s: s != '' AND NOT starts_with(s, '>') AND NOT starts_with(s, '#')) AS lines,
  regexp_extract(body, '備份時間：\\s*(\\d{{4}}/\\d{{2}}/\\d{{2}})', 1) AS dt FROM c)
SELECT path, left(md5(string_split(path, '/')[-1]), 12) AS uuid, CASE WHEN short != '' AND short != stem THEN trim(short) ELSE coalesce(left(lines[1], 60), stem) END AS title, CASE WHEN dt != '' THEN replace(dt, '/', '-') ELSE '2026-01-01' END AS date_created,
  replace(left(array_to_string(list_filter(lines, lambda s: NOT starts_with(s, '---') AND length(s) > 10)[1:3], ' '), 150), '"', '''') AS summary, starts_with(regexp_replace(body, {ENDS}), '---') AS had_header FROM x""")  # fmt: skip
def imported_chats(t):
    """Exported chats as memories."""
    rows = t("documents").filter(F.col("path").startswith("20_AI_Chats/")).select("path", "text")
    done = inbox.imported_chats(rows, F.lit("2026-01-01").cast("date"))
    had = rows.select("path", text.stripped(F.coalesce("text", F.lit(""))).startswith("---").alias("had_header"))
    return done.join(had, "path").select("path", "uuid", "title", "date_created", "summary", "had_header")


@R.add("question_samples", """
WITH c AS (SELECT path || '::para0' AS key, path, list_sort(list(DISTINCT query)) AS qs FROM (SELECT regexp_replace(memory_path, '^_vault/', '') AS path, query FROM search_results WHERE query IS NOT NULL) GROUP BY path) SELECT key, path, qs[1] AS question FROM c""")  # fmt: skip
def question_samples(t):
    """A sample for every memory: the first of the queries that found it."""
    hits = t("search_results").filter("query is not null").select(text.plain_path(F.col("memory_path")).alias("path"), "query").distinct()
    cache = hits.groupBy("path").agg(F.array_sort(F.collect_set("query")).alias("questions")).select(F.concat("path", F.lit("::para0")).alias("key"), "questions")
    return inbox.question_samples(cache)


@R.add("evaluation_report", f"""
WITH {EVAL}, b AS (SELECT *, CASE WHEN length(question) < 15 THEN 'short' WHEN length(question) < 40 THEN 'medium' ELSE 'long' END AS bucket FROM ev)
SELECT 'all' AS part, 'all' AS name, {METRICS} FROM b UNION ALL SELECT 'muse', coalesce(muse_hint, 'none'), {METRICS} FROM b GROUP BY 2 UNION ALL SELECT 'length', bucket, {METRICS} FROM b GROUP BY 2""")  # fmt: skip
def evaluation_report(t):
    """One report: all questions, by domain and by length."""
    ranks = evaluated(t).select("item_id", "rank", F.coalesce("muse_hint", F.lit("none")).alias("muse"), text.length_bucket(F.col("question")).alias("length"))
    return rounded(evaluation.report(ranks, {"muse": "muse", "length": "length"}))
