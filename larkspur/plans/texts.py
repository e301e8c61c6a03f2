"""Queries of the text functions: tokens, chunks, prefixes, dates, routing rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import dates, text
from larkspur.operators import chunks as C
from larkspur.operators import lexical
from larkspur.operators import memories as M
from larkspur.plans.registry import MEM, TOKENS, Registry, ranges_sql
from larkspur.session import spread

R = Registry()
TOK = TOKENS.format("coalesce(text, '')")


@R.add("tokenize_stats", f"""
WITH x AS (SELECT lower(lang) AS lang, {TOK} AS toks FROM documents)
SELECT lang, count(*) AS n_docs, sum(len(toks))::bigint AS n_tokens, max(len(toks))::bigint AS longest FROM x GROUP BY lang""")  # fmt: skip
def tokenize_stats(t):
    toks = t("documents").select(F.lower("lang").alias("lang"), text.token_count(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    n = F.col("n")
    return toks.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.max(n).alias("longest"))


@R.add("corpus_df", f"""
SELECT tok, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOK}) AS tok FROM documents) GROUP BY tok""")  # fmt: skip
def corpus_df(t):
    return lexical.postings(spread(t("documents").select("doc_id", "text")), "doc_id", "text").groupBy("tok").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


ENDS = "'^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g'"
PARAGRAPHS = f"""
p AS (SELECT doc_id, path, list_filter([regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, {ENDS}), '(?m)^#{{1,6}}[\\s\\x0b]+', '', 'g'), '(?m)^[-*_]{{3,}}$', '', 'g'), {ENDS})
    for b in regexp_split_to_array(text, '\\n{{2,}}')], lambda b: length(b) >= 25) AS paras FROM documents)"""


@R.add("paragraph_chunks", f"WITH {PARAGRAPHS} SELECT path || '::para' || (i - 1) AS chunk_id, doc_id, (i - 1)::int AS chunk_index, length(paras[i])::int AS n_chars FROM (SELECT *, unnest(range(1, len(paras) + 1)) AS i FROM p)")
def paragraph_chunks(t):
    rows = t("documents").select("doc_id", "path", F.posexplode(text.paragraphs(F.col("text"))).alias("chunk_index", "para"))
    return rows.select(F.concat("path", F.lit("::para"), "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", F.char_length("para").alias("n_chars"))


CLEAN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, {ENDS}), '(?m)^#{{1,6}}[\\s\\x0b]+', '', 'g'), '(?m)^[-*_]{{3,}}$', '', 'g'), {ENDS})"
#: Parts under second-level headings, and their paragraphs.
SECTIONS = f"""
sp AS (SELECT doc_id, path, regexp_split_to_array(coalesce(text, ''), '(?m)^##[ \\t]+') AS parts FROM documents),
se AS (SELECT doc_id, path, k - 1 AS section_no, CASE WHEN k = 1 THEN '_default' ELSE regexp_replace(string_split(parts[k], chr(10))[1], {ENDS}) END AS title,
  CASE WHEN k = 1 THEN parts[k] WHEN contains(parts[k], chr(10)) THEN substr(parts[k], instr(parts[k], chr(10)) + 1) ELSE '' END AS body FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM sp)),
sq AS (SELECT doc_id, path, section_no, title, list_filter([{CLEAN} for b in regexp_split_to_array(body, '\\n{{2,}}')], lambda b: length(b) >= 25) AS paras FROM se)"""


def section_rows(t):
    parts = t("documents").select("doc_id", "path", F.posexplode(text.sections(F.coalesce("text", F.lit("")))).alias("section_no", "section"))
    return parts.select("doc_id", "path", "section_no", F.col("section.title").alias("title"), F.posexplode(text.paragraphs(F.col("section.body"))).alias("sibling_order", "para"))


@R.add("section_paragraphs", f"WITH {SECTIONS} SELECT doc_id, section_no::int AS section_no, title, (i - 1)::int AS sibling_order, length(paras[i])::int AS n_chars FROM (SELECT *, unnest(range(1, len(paras) + 1)) AS i FROM sq)")
def section_paragraphs(t):
    """Paragraphs with the second-level section that they stand in and their order there."""
    return section_rows(t).select("doc_id", "section_no", "title", "sibling_order", F.char_length("para").alias("n_chars"))


@R.add("parent_sections", f"""
WITH {SECTIONS}, h AS (SELECT DISTINCT result_id, regexp_replace(memory_path, '^_vault/', '') AS path FROM search_results), f AS (SELECT path, min(section_no) AS section_no FROM sq WHERE len(paras) > 0 GROUP BY path)
SELECT result_id, path, title, len(paras)::bigint AS n_paragraphs, md5(array_to_string(paras, chr(10) || chr(10))) AS digest FROM h JOIN f USING (path) JOIN sq USING (path, section_no)""")  # fmt: skip
def parent_sections(t):
    """Each hit with the whole section that its document's first chunk stands in, put together again from its paragraphs."""
    hits = t("search_results").select("result_id", text.plain_path(F.col("memory_path")).alias("path")).distinct()
    return C.parent_sections(hits, section_rows(t)).select("result_id", "path", "title", "n_paragraphs", F.md5("section").alias("digest"))


@R.add("section_texts", f"WITH {SECTIONS} SELECT doc_id, section_no::int AS section_no, len(paras)::bigint AS n_paragraphs, md5(array_to_string(paras, chr(10) || chr(10))) AS digest FROM sq WHERE len(paras) > 0")
def section_texts(t):
    """Sections put together again from their paragraphs, in order."""
    whole = C.section_texts(section_rows(t), ["doc_id", "section_no"])
    return whole.select("doc_id", "section_no", "n_paragraphs", F.md5("section").alias("digest"))


@R.add("chunk_table", f"""
WITH {MEM}, {PARAGRAPHS}, d AS (SELECT p.path, paras, coalesce(mem.summary, '') AS summary, mem.title AS mtitle FROM p LEFT JOIN mem ON mem.path = p.path),
c AS (SELECT path || '::summary' AS chunk_id, 'summary' AS view, -1 AS chunk_index, CASE WHEN coalesce(mtitle, '') != '' THEN '[' || mtitle || ']' || chr(10) ELSE '' END || regexp_replace(summary, {ENDS}) AS text FROM d WHERE regexp_replace(summary, {ENDS}) != ''
  UNION ALL SELECT path || '::para' || (i - 1), 'raw', i - 1, CASE WHEN coalesce(mtitle, '') != '' THEN '[' || mtitle || ']' || chr(10) ELSE '' END || CASE WHEN i = 1 AND summary != '' THEN '[語境：' || left(summary, 40) || ']' || chr(10) ELSE '' END || paras[i] FROM (SELECT *, unnest(range(1, len(paras) + 1)) AS i FROM d)
  UNION ALL SELECT path || '::para0::q' || (k - 1), 'hyqe', 0, qs[k] FROM (SELECT path, qs, unnest(range(1, least(len(qs), 5) + 1)) AS k FROM (
    SELECT path, list_sort(list(DISTINCT query)) AS qs FROM (SELECT DISTINCT regexp_replace(memory_path, '^_vault/', '') AS path, query FROM search_results WHERE query IS NOT NULL AND query != '') GROUP BY path) WHERE path IN (SELECT path FROM p WHERE len(paras) > 0)))
SELECT chunk_id, view, chunk_index::int AS chunk_index, md5(text) AS digest FROM c""")  # fmt: skip
def chunk_table(t):
    """Summary, paragraph and question chunks; a memory's summary is the note of its first paragraph, the queries that found it its questions."""
    m = M.current_memories(t("memories")).select(F.col("memory_path").alias("path"), F.col("title").alias("_title"), F.col("summary").alias("_summary"))
    docs = t("documents").select("path", "text").join(m, "path", "left")
    notes = m.filter("_summary != ''").select(F.concat("path", F.lit("::para0")).alias("chunk_id"), F.substring("_summary", 1, 40).alias("note"))
    hits = t("search_results").filter("query is not null and query != ''").select(text.plain_path(F.col("memory_path")).alias("path"), "query").distinct()
    questions = hits.groupBy("path").agg(F.array_sort(F.collect_set("query")).alias("questions")).select(F.concat("path", F.lit("::para0")).alias("chunk_id"), "questions")
    prefix = F.when(F.coalesce("_title", F.lit("")) != "", F.concat(F.lit("["), "_title", F.lit("]")))
    return C.build_chunks(docs, prefix, F.col("_summary"), notes, questions).select("chunk_id", "view", "chunk_index", F.md5("text").alias("digest"))


@R.add("chunk_prefix", f"""
WITH {MEM}
SELECT memory_id, '[' || coalesce(type, 'note') || '][' || coalesce(left(date_created, 10), '') || ']'
  || CASE WHEN len(tags) > 0 THEN '[' || array_to_string(tags[1:4], ',') || ']' ELSE '' END
  || CASE WHEN len(filename_hint) > 0 THEN '[file:' || array_to_string(filename_hint, ',') || ']' ELSE '' END
  || CASE WHEN enriched_at IS NOT NULL THEN
      CASE WHEN len(entities.locations) > 0 THEN '[loc:' || array_to_string(entities.locations[1:5], ',') || ']' ELSE '' END
      || CASE WHEN len(themes) > 0 THEN '[theme:' || array_to_string(themes[1:3], ',') || ']' ELSE '' END
      || CASE WHEN period != '' THEN '[period:' || period || ']' ELSE '' END ELSE '' END
  || CASE WHEN title != '' THEN ' ' || title || ':' ELSE '' END AS prefix
FROM mem""")  # fmt: skip
def chunk_prefix(t):
    m = M.current_memories(t("memories"))
    c = F.col
    prefix = text.chunk_prefix(c("type"), c("date_created"), c("tags"), c("filename_hint"), c("entities.locations"), c("themes"), c("period"), c("title"), c("enriched_at").isNotNull())
    return m.select("memory_id", prefix.alias("prefix"))


@R.add("snippets", "SELECT doc_id, left(substr(text, instr(text, chr(10)) + 1), 200) AS snippet FROM documents WHERE text IS NOT NULL")
def snippets(t):
    return t("documents").filter("text is not null").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


DOMAIN_SQL = "CASE " + " ".join(f"WHEN {{0}} LIKE '{k.replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}' THEN '{v}'" for k, v in text.DOMAINS.items()) + " ELSE 'Unknown' END"


@R.add("paths_by_domain", f"""
WITH x AS (SELECT DISTINCT result_id, regexp_replace(memory_path, '^_vault/', '') AS path, query FROM search_results)
SELECT {DOMAIN_SQL.format('path')} AS domain, CASE WHEN length(query) < 15 THEN 'short' WHEN length(query) < 40 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM x GROUP BY 1, 2""")  # fmt: skip
def paths_by_domain(t):
    rows = t("search_results").select("result_id", text.plain_path(F.col("memory_path")).alias("path"), "query").distinct()
    return rows.groupBy(text.domain_of(F.col("path")).alias("domain"), text.length_bucket(F.col("query")).alias("bucket")).agg(F.count("*").alias("n"))


@R.add("document_formats", """
SELECT CASE WHEN lower(path) LIKE '%.pages' THEN 'pages' WHEN NOT regexp_matches(lower(path), '\\.(md|txt)$') THEN 'unknown'
  WHEN regexp_matches(coalesce(text, ''), '備份時間：|## 對話記錄|\\*\\*你\\*\\*\\s*\\n|\\*\\*Gemini\\*\\*\\s*\\n') OR regexp_matches(path, '_[0-9a-f]{8,16}\\.md$') THEN 'gemini'
  WHEN coalesce(text, '') LIKE '---%' AND lower(type) IN ('knowledge', '知識') THEN 'knowledge' ELSE 'journal' END AS format, count(*) AS n FROM documents GROUP BY 1""")  # fmt: skip
def document_formats(t):
    kind = text.document_format(F.col("path"), F.coalesce("text", F.lit("")), F.col("type"))
    return t("documents").groupBy(kind.alias("format")).agg(F.count("*").alias("n"))


STEM = "regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')"


@R.add("filename_hints", f"""
SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace({STEM}, '^\\d{{6,8}}', ''), '[_\\-\\s]+'),
  lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9a-f]{{8,}}$') AND NOT regexp_matches(w, '^\\d+$')) AS hints FROM documents""")  # fmt: skip
def filename_hints(t):
    return t("documents").select("doc_id", text.filename_hints(text.stem_of(F.col("path"))).alias("hints"))


@R.add("stem_dates", f"""
SELECT doc_id, CASE WHEN regexp_matches({STEM}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_strptime(left({STEM}, 10), '%Y-%m-%d') IS NOT NULL THEN try_strptime(left({STEM}, 10), '%Y-%m-%d')::date WHEN regexp_matches({STEM}, '^\\d{{6}}(\\D|$)') THEN try_strptime('20' || left({STEM}, 6), '%Y%m%d')::date END AS stem_date FROM documents""")  # fmt: skip
def stem_dates(t):
    return t("documents").select("doc_id", dates.stem_date(text.stem_of(F.col("path"))).alias("stem_date"))


@R.add("wikilink_index", "SELECT DISTINCT path, unnest(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1)) AS entity FROM documents")
def wikilink_index(t):
    """Entries of the inverted list, each once; one that very many have stays many rows."""
    return t("documents").select("path", F.explode(text.wikilinks(F.col("text"))).alias("entity")).distinct()


@R.add("tag_index", f"WITH {MEM} SELECT tag, count(*) AS n, min(path) AS first_path FROM (SELECT DISTINCT path, unnest(tags) AS tag FROM mem) WHERE tag IS NOT NULL GROUP BY tag")
def tag_index(t):
    rows = M.current_memories(t("memories")).select(F.col("memory_path").alias("path"), F.explode("tags").alias("tag")).filter("tag is not null").distinct()
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@R.add("summaries", """
SELECT doc_id, replace(left(array_to_string([regexp_replace(s, '^\\s+|\\s+$', '', 'g') for s in list_filter(string_split(text, chr(10)),
  lambda s: NOT starts_with(s, '#') AND NOT starts_with(s, '>') AND length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) > 10)[1:3]], ' '), 150), '"', '''') AS summary
FROM documents WHERE text IS NOT NULL""")  # fmt: skip
def summaries(t):
    return t("documents").filter("text is not null").select("doc_id", text.summary_of(F.col("text")).alias("summary"))


@R.add("inferred_tags", "SELECT doc_id, list_filter([" + ", ".join(
    f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{tag}' END" for tag, words in text.TAG_WORDS.items()
) + "], lambda x: x IS NOT NULL)[1:5] AS tags FROM documents WHERE text IS NOT NULL")
def inferred_tags(t):
    return t("documents").filter("text is not null").select("doc_id", text.inferred_tags(F.col("text")).alias("tags"))


@R.add("uids_and_slugs", "SELECT doc_id, left(md5(path), 12) AS uid, regexp_replace(lower(title), '[^a-z0-9_-]', '', 'g') AS slug FROM documents")
def uids_and_slugs(t):
    return t("documents").select("doc_id", text.short_uid(F.col("path")).alias("uid"), text.slug(F.col("title")).alias("slug"))


@R.add("intent_rules", "WITH m AS (SELECT DISTINCT message_id, content FROM messages WHERE content IS NOT NULL) SELECT message_id, list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(content), '{rx.replace(chr(39), chr(39) * 2)}') THEN '{name}' END" for name, rx in text.INTENTS.items()
) + "], lambda x: x IS NOT NULL) AS classes FROM m")
def intent_rules(t):
    rows = t("messages").filter("content is not null").select("message_id", "content").distinct()
    return rows.select("message_id", text.intents(F.col("content")).alias("classes"))


@R.add("query_complexity", """
WITH q AS (SELECT DISTINCT query, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS s FROM search_results WHERE query IS NOT NULL)
SELECT query, length(s) >= 15 OR regexp_matches(s, '[，、和與跟還有,&]| and | or | with | about ')
  OR len(regexp_extract_all(s, '[\\x{4e00}-\\x{9fff}]{2,}|[a-zA-Z][a-zA-Z0-9_\\x{4e00}-\\x{9fff}-]+')) >= 3 AS is_complex FROM q""")  # fmt: skip
def query_complexity(t):
    return t("search_results").select("query").dropna().distinct().withColumn("is_complex", text.is_complex(F.col("query")))


PICK, THEN = ranges_sql("content", "day")


@R.add("time_ranges", f"""
WITH m AS (SELECT message_id, content, min(ingested_at)::date AS day FROM messages WHERE regexp_matches(content, '[0-9]{{4}}|年|月|最近|近期|近來|這陣子') GROUP BY message_id, content),
x AS (SELECT message_id, {PICK} FROM m), y AS (SELECT message_id, {THEN} FROM x)
SELECT message_id, "start", "end", "start" + floor(("end" - "start") / 2)::int AS anchor, raw, confidence FROM y""")  # fmt: skip
def time_ranges(t):
    """The time that a chat turn speaks of, seen from the day on which it first came in."""
    turns = t("messages").filter(F.col("content").rlike("[0-9]{4}|年|月|最近|近期|近來|這陣子"))
    rows = turns.groupBy("message_id", "content").agg(F.to_date(F.min("ingested_at")).alias("day"))
    found = dates.with_time_range(rows, "content", F.col("day"))
    return found.select("message_id", "start", "end", "anchor", "raw", "confidence")


@R.add("temporal_bonus", f"""
WITH {MEM}, r AS (SELECT DATE '2023-12-01' AS s, DATE '2024-02-29' AS e, DATE '2024-01-15' AS a, 0.85 AS c)
SELECT memory_id, round(coalesce(CASE WHEN d BETWEEN s AND e THEN 0.3 * (1 - 0.3 * abs(d - a) / greatest(e - s, 1)) * c
  ELSE 0.3 * exp(-abs(d - a) / 365.0) * 0.5 * c END, 0), 6) AS bonus FROM mem, r""")  # fmt: skip
def temporal_bonus(t):
    day = lambda s: F.lit(s).cast("date")
    bonus = dates.nearness_bonus(F.col("date"), day("2023-12-01"), day("2024-02-29"), day("2024-01-15"), F.lit(0.85))
    return M.current_memories(t("memories")).select("memory_id", F.round(bonus, 6).alias("bonus"))


@R.add("time_filter", f"WITH {MEM} SELECT memory_id, d AS date FROM mem WHERE d BETWEEN DATE '2023-01-01' AND DATE '2023-12-31'")
def time_filter(t):
    return M.current_memories(t("memories")).filter(F.col("date").between("2023-01-01", "2023-12-31")).select("memory_id", "date")
