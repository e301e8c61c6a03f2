from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import pytest

from larkspur.llm import variants
from larkspur.llm.variants import entity_pairs, link_variants, near, read_form
from larkspur.operators.components import connected_components

SCHEMA = "person_id bigint, name string, aliases array<string>, entity string"


@pytest.mark.parametrize(("spelling", "form"), [
    ("Anna Bergström", ("p", "anna", [], "bergstrom")), ("Bergström, Anna", ("p", "anna", [], "bergstrom")), ("anna_bergstrom", ("p", "anna", [], "bergstrom")), ("AnnaBergstrom", ("p", "anna", [], "bergstrom")),
    ("Dr. Anna K. Bergstrom (work)", ("p", "anna", [], "bergstrom")), ("A. Bergstrom", ("i", "a", [], "bergstrom")), ("Mrs Bergstrom", ("i", "", [], "bergstrom")), ("Pat (Patricia) Bergstrom", ("p", "pat", ["patricia"], "bergstrom")),
    ("The Weller Logistics Inc.", ("o", "logistics", [], "weller")), ("Weller Log. Inc", ("o", "logistics", [], "weller")), ("University of Weller", ("o", "university", [], "weller")), ("王 小明", ("x", "", [], "王小明")),
    ("WANG, Xiao-ming", ("r", "", ["wang", "xiao", "ming"], "ming wang xiao")), ("quiet-lamp0042f1", ("h", "", [], "quiet-lamp0042f1")), ("the neighbour", ("", "", [], "")), ("  ", ("", "", [], "")), ("B3rgstrom", ("i", "b", [], "rgstrom")),
])
def test_forms(spelling, form):
    assert read_form(spelling) == form


@pytest.mark.parametrize(("a", "b", "same"), [("anna", "anna", True), ("berg", "begr", True), ("berg", "brg", False), ("berger", "beger", True), ("berger", "bergers", True), ("berger", "burgar", False), ("an", "am", False)])
def test_one_error(a, b, same):
    assert near(a, b) is same and near(b, a) is same


def test_links(spark):
    rows = [
        (1, "Deborah Lindqvarn", None), (2, "Lindqvarn, Deborah", []), (3, "Debbie Lindqvarn", ["cousin"]), (4, "D. Lindqvarn", None), (5, "Deborah Lindqvern", None),
        (6, "Samuel Lindqvarn", ["cousin"]), (7, "quiet-lamp0042f1", ["Sam Lindqvarn"]), (8, "Hartwell Bakery Ltd", None), (9, "Hartwell Bakery, Limited", None), (10, "Hartwell Hospital Ltd", None),
        (11, "J. Ostrander", None), (12, "Joseph Ostrander", None), (13, "Josefina Ostrander", None), (14, None, None), (15, "", [""]), (16, "王小明", ["Wang Xiaoming"]), (17, "Wang XiaoMing", None), (18, "landlord", None),
        (18, "landlord", None),
    ]
    people = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = link_variants(people, "person_id", "name", "aliases")
    groups = defaultdict(set)
    for r in got.collect():
        groups[r.entity].add(r.person_id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4, 5], [6, 7], [8, 9], [10], [11], [12], [13], [14], [15], [16, 17], [18]]
    assert all(min(v) == k for k, v in groups.items())
    pairs = {tuple(r) for r in entity_pairs(got, "person_id").collect()}
    assert (6, 7) in pairs and (1, 6) not in pairs and len(pairs) == 10 + 1 + 1 + 1


def test_merged_profiles_meet_again(spark):
    """Neither spelling of the last two is within one error of the first; the merged profile of 1 and 2 has both parts."""
    rows = [(1, "Francisco Ruvaraikmek", ["Franicsco Ruvarikmek"], ""), (2, "Franicsco Ruvaraikmek", None, ""), (3, "Francisco Ruvarikmek", None, "")]
    got = {r.person_id: r.entity for r in link_variants(spark.createDataFrame(rows, SCHEMA), "person_id", "name", "aliases").collect()}
    assert set(got.values()) == {1}


def test_rounds_that_do_not_suffice(spark):
    """What only the union of a record's spellings matches is found in a round of its own, a second such in the next."""
    rows = [(1, "Francisco Ruvarikmek", ["Pepe Quillon"], ""), (2, "Francisco Quillon", ["Ramona Tscherben"], ""), (3, "Pepe Tscherben", None, ""), (4, "F. Ruvarikmek", None, "")]
    people = spark.createDataFrame(rows, SCHEMA)
    assert {r.entity for r in link_variants(people, "person_id", "name", "aliases").collect()} == {1}
    for rounds in (0, 1):
        with pytest.raises(RuntimeError):
            link_variants(people, "person_id", "name", "aliases", most_rounds=rounds)
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int"), "a", "b", most_rounds=2)


@pytest.mark.parametrize("large", [2, 100])
def test_short_names_against_brute_force(spark, monkeypatch, large):
    """All pairs that `near` allows are linked, however short the names and however full their blocks."""
    monkeypatch.setattr(variants, "LARGE_BLOCK", large)
    given, family = ["Laura", "Luara", "Christopher", "Rolf", "Roolf", "Max", "Lena"], ["Klein", "Kleni", "Montague", "Berg", "Begr", "Wang", "Wnag", "Ott"]
    names = [(g, f) for g in given for f in family] + [("Klein", "Brigitt"), ("Brigitt", "Kleni"), ("Brigit", "Klein")]
    people = spark.createDataFrame([(k, f"{g} {f}", None, "") for k, (g, f) in enumerate(names)], SCHEMA)
    got = {r.person_id: r.entity for r in link_variants(people, "person_id", "name", "aliases").collect()}

    same = {k: k for k in range(len(names))}
    for (a, (ga, fa)), (b, (gb, fb)) in combinations(enumerate((g.lower(), f.lower()) for g, f in names), 2):
        if (near(ga, gb) and near(fa, fb)) or (near(ga, fb) and near(fa, gb)):
            old, new = max(same[a], same[b]), min(same[a], same[b])
            same = {k: new if v == old else v for k, v in same.items()}
    assert got == same


def test_no_rows(spark):
    assert link_variants(spark.createDataFrame([], SCHEMA), "person_id", "name", "aliases").count() == 0
