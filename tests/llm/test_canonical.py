from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm.canonical import QUICK_CHECK, canonical_column, changed_entries, plain_form

CASES = [
    ("plain", "plain"), ("ｆｕｌｌ", "full"), ("café", "café"), ("a​b﻿", "ab"), ("a 　b ", "a b"), ("lake‐town‑x", "lake-town-x"), ("раle", "pale"), ("музыka", "музыка"),
    ("ﬁnance", "finance"), ("ｶﾞｰﾃﾞﾝ", "ガーデン"), ("⼭", "山"), ("金", "金"), ("한", "한"), ("co₂ m²", "co₂ m²"), ("\U0001f469‍\U0001f4bb", "\U0001f469‍\U0001f4bb"), ("so­ft", "soft"), ("", ""), (" ​ ", ""),
    ("Åb", "Åb"), ("night-mаrkеt", "night-market"), ("Ореховка", "Ореховка"),
]


@pytest.mark.parametrize(("text", "plain"), CASES)
def test_plain_form(text, plain):
    assert plain_form(text) == plain


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=24))
def test_spliced_result_is_stable_and_composed(text):
    plain = plain_form(text)
    assert plain_form(plain) == plain
    if not QUICK_CHECK.search(text):
        assert plain == text == unicodedata.normalize("NFC", text)


def test_rows(spark):
    rows = [(1, "tags", text, "x") for text, _ in CASES] + [(1, "tags", None, "x"), (2, "tags", "ｆｕｌｌ", "x"), (2, "tags", "ｆｕｌｌ", "x"), (3, "tags", "long " * 5000 + "ａ", "x")]
    entries = spark.createDataFrame(rows, "memory_id int, field string, entry string, plain string")
    got = {tuple(r) for r in changed_entries(entries, ["memory_id", "field"], "entry").collect()}
    assert got == {(1, "tags", p) for t, p in CASES if t != p} | {(2, "tags", "full"), (3, "tags", "long " * 5000 + "a")}
    column = entries.filter("memory_id = 1").select("entry", canonical_column(F.col("entry")).alias("p")).collect()
    assert {r.entry: r.p for r in column} == {**dict(CASES), None: None}
    assert changed_entries(entries.limit(0), ["memory_id", "field"], "entry").count() == 0
