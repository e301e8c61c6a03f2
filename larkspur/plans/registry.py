"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.session import table

Query = Callable[[SparkSession, str], DataFrame]

#: The time that queries look back from.
AS_OF = "2026-01-01 00:00:00"

#: Common parts of the SQL: current memories, accesses.
MEM = """mem AS (SELECT * EXCLUDE (rn) FROM (
  SELECT memory_id, regexp_replace(memory_path, '^_vault/', '') AS path, title, lower(type) AS type, source, importance, period, tags, themes, personal_facts,
    entities, summary, chat_category, filename_hint, enriched_at, date_created, date_updated, coalesce(lower(trim(dormant)) IN ('true', 'yes', '1'), false) AS dormant,
    CASE WHEN regexp_matches(regexp_replace(left(date_created, 10), '[-/]', '', 'g'), '^\\d{8}$')
      THEN try_strptime(regexp_replace(left(date_created, 10), '[-/]', '', 'g'), '%Y%m%d')::date END AS d,
    row_number() OVER (PARTITION BY memory_id ORDER BY date_updated DESC NULLS LAST, importance DESC NULLS LAST, dormant DESC NULLS LAST) AS rn
  FROM memories) WHERE rn = 1)"""
ACC = """acc AS (SELECT DISTINCT id, regexp_replace(memory_path, '^_vault/', '') AS path, accessed_at FROM access_events
  WHERE memory_path IS NOT NULL AND accessed_at IS NOT NULL)"""
#: Tokens of a text as a list.
TOKENS = """flatten([CASE WHEN regexp_matches(r, '^[\\x{{4e00}}-\\x{{9fff}}]')
  THEN list_concat([substr(r, i, 1) for i in range(1, length(r) + 1)], [substr(r, i, 2) for i in range(1, length(r))]) ELSE [lower(r)] END
  for r in regexp_extract_all({0}, '[\\x{{4e00}}-\\x{{9fff}}]+|[a-zA-Z0-9]+')])"""


def ranges_sql(text: str, day: str) -> tuple[str, str]:
    """Columns for the time that a text speaks of: first those that pick the rule, then ``start, end, raw, confidence`` from them."""
    part = lambda rx, g: f"regexp_extract({text}, '{rx}', {g})"
    number = lambda rx, g: f"(CASE WHEN length({part(rx, g)}) BETWEEN 1 AND 6 THEN {part(rx, g)}::int END)"
    years, season = "(大前年|前年|去年|今年)", "([春夏秋冬])[天季]?"
    first = lambda g: f"(CASE {g} WHEN '春' THEN 3 WHEN '夏' THEN 6 WHEN '秋' THEN 9 WHEN '冬' THEN 12 END)"
    last = lambda g: f"(CASE {g} WHEN '春' THEN 5 WHEN '夏' THEN 8 WHEN '秋' THEN 11 WHEN '冬' THEN 2 END)"
    year = lambda g: f"(year({day}) + CASE {g} WHEN '大前年' THEN -3 WHEN '前年' THEN -2 WHEN '去年' THEN -1 ELSE 0 END)"
    rules = []

    def rule(when: str, y: str, a: str, b: str, raw: str, sure: float) -> None:
        rules.append(f"CASE WHEN {when} THEN {{'y': {y}, 'a': {a}, 'b': {b}, 'raw': {raw}, 'sure': {sure}::double}} END")

    rx = "((\\d{4})[-/](\\d{1,2}))(?:\\D|$)"
    rule(f"{number(rx, 3)} BETWEEN 1 AND 12", number(rx, 2), number(rx, 3), number(rx, 3), part(rx, 1), 0.95)
    rx = "(\\d{4})\\s*年\\s*(\\d{1,2})\\s*月"
    rule(f"{number(rx, 2)} BETWEEN 1 AND 12", number(rx, 1), number(rx, 2), number(rx, 2), part(rx, 0), 0.95)
    rx = f"(\\d{{4}})\\s*年?\\s*{season}"
    rule(f"{part(rx, 0)} != ''", number(rx, 1), first(part(rx, 2)), last(part(rx, 2)), part(rx, 0), 0.85)
    rx = "(\\d{4})\\s*年"
    rule(f"{number(rx, 1)} BETWEEN 1 AND 9999", number(rx, 1), "1", "12", part(rx, 0), 0.7)
    rx = "(?:^|\\D)(\\d{4})(?:\\D|$)"
    rule(f"{number(rx, 1)} BETWEEN 2000 AND 2100", number(rx, 1), "1", "12", part(rx, 1), 0.5)
    rx = f"{years}\\s*{season}"
    rule(f"{part(rx, 0)} != ''", year(part(rx, 1)), first(part(rx, 2)), last(part(rx, 2)), part(rx, 0), 0.8)
    rx = f"{years}\\s*(\\d{{1,2}})\\s*月"
    rule(f"{number(rx, 2)} BETWEEN 1 AND 12", year(part(rx, 1)), number(rx, 2), number(rx, 2), part(rx, 0), 0.85)
    rule(f"{part(years, 0)} != ''", year(part(years, 1)), "1", "12", part(years, 0), 0.65)
    rx = "(前三個月|前兩個月|上個月|上月|這個月|本月)"
    then = f"({day} - to_months(CASE {part(rx, 1)} WHEN '前三個月' THEN 3 WHEN '前兩個月' THEN 2 WHEN '上個月' THEN 1 WHEN '上月' THEN 1 ELSE 0 END))"
    rule(f"{part(rx, 0)} != ''", f"year({then})", f"month({then})", f"month({then})", part(rx, 0), 0.9)
    rx = "(\\d+)\\s*個?\\s*月前"
    then = f"({day} - to_months(coalesce({number(rx, 1)}, 0)))"
    rule(f"{number(rx, 1)} IS NOT NULL", f"year({then})", f"month({then})", f"month({then})", part(rx, 0), 0.8)
    full = "(\\d{4})-(\\d{1,2})-(\\d{1,2})"
    exact = f"try_strptime({part(full, 1)} || '-' || lpad({part(full, 2)}, 2, '0') || '-' || lpad({part(full, 3)}, 2, '0'), '%Y-%m-%d')::date"
    pick = f"coalesce({', '.join(rules)}) AS ru, CASE WHEN {part(full, 0)} != '' THEN {exact} END AS dy, {part(full, 0)} AS dr, regexp_matches({text}, '最近|近期|近來|這陣子') AS la, {day} AS nw"
    then = """coalesce(dy, CASE WHEN ru IS NOT NULL THEN make_date(ru.y, ru.a, 1) WHEN la THEN nw - 30 END) AS "start",
  coalesce(dy, CASE WHEN ru IS NOT NULL THEN last_day(make_date(ru.y + CASE WHEN ru.a > ru.b THEN 1 ELSE 0 END, ru.b, 1)) WHEN la THEN nw END) AS "end",
  CASE WHEN dy IS NOT NULL THEN dr WHEN ru IS NOT NULL THEN ru.raw WHEN la THEN '最近' END AS raw, CASE WHEN dy IS NOT NULL THEN 1.0 WHEN ru IS NOT NULL THEN ru.sure WHEN la THEN 0.6 END::double AS confidence"""
    return pick, then


#: Steps after which spreading activation has come to rest.
STEPS = 12


def spread_sql(seeds: str) -> str:
    """CTEs that end in ``sp(query_id, node, p)``, spreading from ``sd(query_id, node)``, given by ``seeds``."""
    parts = [
        "l AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT src_label || ':' || src AS a, dst_label || ':' || dst AS b FROM edges UNION ALL SELECT dst_label || ':' || dst, src_label || ':' || src FROM edges) WHERE a != b)",
        "g AS MATERIALIZED (SELECT a, count(*) AS deg FROM l GROUP BY a)", f"sd AS MATERIALIZED ({seeds})", "si AS (SELECT * FROM sd WHERE node IN (SELECT a FROM g))",
        "p0 AS MATERIALIZED (SELECT query_id, node, 1.0::double / count(*) OVER (PARTITION BY query_id) AS p FROM si)",
    ]
    for k in range(STEPS):
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT query_id, node, sum(p) AS p FROM (SELECT query_id, l.b AS node, 0.15::double * p / deg AS p FROM p{k} JOIN l ON l.a = node JOIN g ON g.a = node UNION ALL SELECT query_id, node, 0.85::double * p FROM p0) GROUP BY ALL)")
    return ", ".join([*parts, f"sp AS (SELECT * FROM p{STEPS})"])


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        """Registers ``f(t)``, t giving a table by name, under a name and with its SQL."""

        def register(f: Callable) -> Callable:
            self.queries[name] = lambda spark, sf_dir: f(lambda tab: table(spark, sf_dir, tab))
            if sql:
                self.sql[name] = sql
            return f

        return register
