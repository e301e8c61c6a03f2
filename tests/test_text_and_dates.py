from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from larkspur.functions import dates, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="東京 Tokyo1") == ["東", "京", "東京", "tokyo1"]
    assert one(spark, text.tokens(F.col("t")), t="café — 我") == ["caf", "我"]
    assert one(spark, text.tokens(F.col("t")), t="") == []
    assert one(spark, text.tokens(F.col("t")), t=None) is None


def test_paragraphs_and_sections(spark):
    body = "# Title\n\nA paragraph that is long enough to stay.\n\nshort\n\n---\n\n## Part\nAnother paragraph that is long enough."
    assert one(spark, text.paragraphs(F.col("t")), t=body) == ["A paragraph that is long enough to stay.", "Part\nAnother paragraph that is long enough."]
    parts = one(spark, text.sections(F.col("t")), t=body)
    assert [p["title"] for p in parts] == ["_default", "Part"]


def test_small_helpers(spark):
    assert one(spark, text.filename_hints(F.col("t")), t="260410_CityA旅行_LakeB") == ["CityA旅行", "LakeB"]
    assert one(spark, text.filename_hints(F.col("t")), t="260410") == []
    assert one(spark, text.name_key(F.col("t")), t="Ann-Marie_X y") == "annmariexy"
    assert one(spark, text.wikilinks(F.col("t")), t="a [[B]] [[C d]]") == ["B", "C d"]
    assert one(spark, text.intents(F.col("t")), t="還記得那年") == ["READ-TEMPORAL", "READ-RECALL"]
    assert one(spark, text.replace_unique(F.col("t"), F.lit("a"), F.lit("b")), t="a-c") == "b-c"
    assert one(spark, text.replace_unique(F.col("t"), F.lit("a"), F.lit("b")), t="a-a") is None
    assert one(spark, text.json_object(F.col("t")), t="x {'a': [1, 2,],} y") == '{"a": [1, 2]}'
    assert one(spark, text.json_object(F.col("t")), t="none") is None
    assert one(spark, text.fit_array(F.array(F.col("t")), 3), t="a") == ["a", "", ""]
    assert one(spark, text.domain_of(F.col("t")), t="40_Projects/x.md") == "Terpsichore"


def test_dates(spark):
    assert one(spark, dates.loose_date(F.col("t")), t="2020/06/03") == date(2020, 6, 3)
    assert one(spark, dates.loose_date(F.col("t")), t="2025-02-31") is None
    assert one(spark, dates.stem_date(F.col("t")), t="190110_x") == date(2019, 1, 10)


def test_time_range(spark):
    rows = [("2023年冬天",), ("去年夏天",), ("2024-05-03",), ("大前年",), ("3個月前",), ("最近",), ("none 12345",), (None,)]
    got = dates.with_time_range(spark.createDataFrame(rows, "q string"), "q", F.lit("2026-03-15").cast("date")).collect()
    assert [(r.start, r.end, r.confidence) for r in got] == [
        (date(2023, 12, 1), date(2024, 2, 29), 0.85), (date(2025, 6, 1), date(2025, 8, 31), 0.8), (date(2024, 5, 3), date(2024, 5, 3), 1.0), (date(2023, 1, 1), date(2023, 12, 31), 0.65),
        (date(2025, 12, 1), date(2025, 12, 31), 0.8), (date(2026, 2, 13), date(2026, 3, 15), 0.6), (None, None, None), (None, None, None),
    ]


def test_nearness_bonus(spark):
    day = lambda s: F.lit(s).cast("date")
    bonus = lambda d: one(spark, F.round(dates.nearness_bonus(day(d), day("2024-01-01"), day("2024-01-01"), day("2024-01-01"), F.lit(1.0)), 6), t="")
    assert bonus("2024-01-01") == 0.3
    assert bonus("2024-12-31") == 0.055182
    assert bonus(None) == 0.0
