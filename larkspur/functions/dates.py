"""Dates in text, time ranges of queries, and how near a date is to a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Months of the seasons, years and months of relative words.
SEASONS = {"春": (3, 5), "夏": (6, 8), "秋": (9, 11), "冬": (12, 2)}
YEARS = {"大前年": -3, "前年": -2, "去年": -1, "今年": 0}
MONTHS = {"前三個月": -3, "前兩個月": -2, "上個月": -1, "上月": -1, "這個月": 0, "本月": 0}


def loose_date(text: Column) -> Column:
    """A date from YYYY-MM-DD, YYYY/MM/DD or YYYYMMDD; null for anything else."""
    digits = F.regexp_replace(F.substring(text, 1, 10), "[-/]", "")
    return F.when(digits.rlike(r"^\d{8}$"), F.try_to_date(digits, "yyyyMMdd"))


def stem_date(stem: Column) -> Column:
    """A date from a file name that begins with YYMMDD or YYYY-MM-DD."""
    short = F.regexp_extract(stem, r"^(\d{6})(?!\d)", 1)
    full = F.regexp_extract(stem, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.when(full != "", F.try_to_date(full)), F.when(short != "", F.try_to_date(F.concat(F.lit("20"), short), "yyyyMMdd")))


def with_time_range(rows: DataFrame, text: str, as_of: Column) -> DataFrame:
    """Adds ``start, end, anchor, raw, confidence`` of the time that a text speaks of, null if none: by the first rule that
    fits, from a full date to "lately". Months from the last to the first go over New Year."""
    query = F.col(text)
    taken: dict[tuple[str, int], str] = {}

    def got(rx: str, group: int) -> Column:
        """A match that is taken from the text once, in a projection of its own."""
        return F.col(taken.setdefault((rx, group), f"_match{len(taken)}"))

    number = lambda rx, g: F.when(F.char_length(got(rx, g)).between(1, 6), got(rx, g).cast("int"))

    def months(when: Column, year: Column, first: Column, last: Column, raw: Column, confidence: float) -> Column:
        return F.when(when, F.struct(year.alias("y"), first.alias("a"), last.alias("b"), raw.alias("raw"), F.lit(confidence).alias("sure")))

    def looked_up(table: dict, key: Column, part: int | None = None) -> Column:
        pairs = [(F.lit(k), F.lit(v if part is None else v[part])) for k, v in table.items()]
        return F.element_at(F.create_map(*(x for pair in pairs for x in pair)), key)

    # The patterns below, in the order in which they are tried, and how sure each is.
    years, season = "(大前年|前年|去年|今年)", "([春夏秋冬])[天季]?"
    first, last = (F.lit(1), F.lit(12))
    rules = []
    for rx in (r"(\d{4})[-/](\d{1,2})(?!\d)", r"(\d{4})\s*年\s*(\d{1,2})\s*月"):
        rules.append(months(number(rx, 2).between(1, 12), number(rx, 1), number(rx, 2), number(rx, 2), got(rx, 0), 0.95))
    rx = rf"(\d{{4}})\s*年?\s*{season}"
    rules.append(months(got(rx, 0) != "", number(rx, 1), looked_up(SEASONS, got(rx, 2), 0), looked_up(SEASONS, got(rx, 2), 1), got(rx, 0), 0.85))
    for rx, low, high, sure in ((r"(\d{4})\s*年", 1, 9999, 0.7), (r"(?<!\d)(\d{4})(?!\d)", 2000, 2100, 0.5)):
        rules.append(months(number(rx, 1).between(low, high), number(rx, 1), first, last, got(rx, 0), sure))
    rx = rf"{years}\s*{season}"
    rules.append(months(got(rx, 0) != "", F.year(as_of) + looked_up(YEARS, got(rx, 1)), looked_up(SEASONS, got(rx, 2), 0), looked_up(SEASONS, got(rx, 2), 1), got(rx, 0), 0.8))
    rx = rf"{years}\s*(\d{{1,2}})\s*月"
    rules.append(months(number(rx, 2).between(1, 12), F.year(as_of) + looked_up(YEARS, got(rx, 1)), number(rx, 2), number(rx, 2), got(rx, 0), 0.85))
    rules.append(months(got(years, 0) != "", F.year(as_of) + looked_up(YEARS, got(years, 1)), first, last, got(years, 0), 0.65))
    rx = "(" + "|".join(MONTHS) + ")"
    then = F.add_months(as_of, F.coalesce(looked_up(MONTHS, got(rx, 1)), F.lit(0)))
    rules.append(months(got(rx, 0) != "", F.year(then), F.month(then), F.month(then), got(rx, 0), 0.9))
    rx = r"(\d+)\s*個?\s*月前"
    then = F.add_months(as_of, -F.coalesce(number(rx, 1), F.lit(0)))
    rules.append(months(number(rx, 1).isNotNull(), F.year(then), F.month(then), F.month(then), got(rx, 0), 0.8))

    full = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    day = F.try_to_date(F.when(got(full, 0) != "", F.format_string("%s-%02d-%02d", got(full, 1), number(full, 2), number(full, 3))), "yyyy-MM-dd")
    day_raw = got(full, 0)
    matches = {name: F.regexp_extract(query, rx, group) for (rx, group), name in taken.items()}
    steps = rows.withColumns(matches).withColumns({"_day": day, "_day_raw": day_raw, "_now": as_of, "_lately": query.rlike("最近|近期|近來|這陣子"), "_rule": F.coalesce(*rules)})
    rule, named = F.col("_rule"), F.col("_rule").isNotNull()
    over = F.when(rule["a"] > rule["b"], 1).otherwise(0)
    start = F.coalesce("_day", F.when(named, F.make_date(rule["y"], rule["a"], F.lit(1))).when(F.col("_lately"), F.date_sub("_now", 30)))
    end = F.coalesce("_day", F.when(named, F.last_day(F.make_date(rule["y"] + over, rule["b"], F.lit(1)))).when(F.col("_lately"), F.col("_now")))
    raw = F.coalesce(F.when(F.col("_day").isNotNull(), F.col("_day_raw")), rule["raw"], F.when(F.col("_lately"), "最近"))
    sure = F.coalesce(F.when(F.col("_day").isNotNull(), 1.0), rule["sure"], F.when(F.col("_lately"), 0.6))
    found = steps.withColumns({"start": start, "end": end, "raw": raw, "confidence": sure})
    anchor = F.date_add("start", F.floor(F.date_diff("end", "start") / 2).cast("int"))
    return found.withColumn("anchor", anchor).drop("_day", "_day_raw", "_now", "_lately", "_rule", *matches)


def nearness_bonus(date: Column, start: Column, end: Column, anchor: Column, confidence: Column, most: float = 0.3, days: float = 365.0) -> Column:
    """Up to ``most`` for a date inside the range, less the further it is from the anchor; half of that, fading with
    the distance from the anchor, outside; 0 without a date."""
    away = F.abs(F.date_diff(date, anchor))
    width = F.greatest(F.date_diff(end, start), F.lit(1))
    inside = F.lit(most) * (1 - F.lit(0.3) * away / width) * confidence
    outside = F.lit(most) * F.exp(-away / F.lit(days)) * 0.5 * confidence
    return F.coalesce(F.when(date.between(start, end), inside).otherwise(outside), F.lit(0.0))
