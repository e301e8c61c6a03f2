from __future__ import annotations

import re

import pytest

from larkspur.llm import privacy
from larkspur.llm.privacy_examples import example

TEXTS = {
    1: "Write to anna.berg@post.example, or call +44 7700 900 123 after six.",
    2: "My passport number is K283019475 and I live at 14 Mill Lane, Norbury.",
    3: "Thanks to Isabella Montague the shelf is straight; Norbury Library is closed.",
    4: "Invoice INV-20250101 was paid. See ISBN 978-0-000-01190-0. The build is 4.1.12.",
    5: "記得問王怡君先生那件事，電話：0912-345-678。",
    6: "",
    7: None,
    8: "Use checkout@v3 and ping @channel.",
    9: "Mail me at peter at post dot example. " + "Nothing here. " * 3000 + "My number is (415) 555 0134.",
}


@pytest.fixture(scope="module")
def redactor(spark):
    return privacy.Redactor.fit(spark)


def test_kinds_and_placeholders(spark, redactor):
    df = spark.createDataFrame([(k, t, "clash") for k, t in TEXTS.items()], "k int, t string, kind string")
    kinds = {}
    for r in redactor.spans(df, ["k"], "t").collect():
        kinds.setdefault(r.k, set()).add(r.kind)
    assert kinds == {1: {"email", "phone"}, 2: {"id", "address"}, 3: {"name"}, 5: {"name", "phone"}, 9: {"email", "phone"}}
    out = {r.k: r.text for r in redactor.redact(df, ["k"], "t").collect()}
    assert out[1] == "Write to [EMAIL], or call [PHONE] after six."
    assert out[3] == "Thanks to [NAME] the shelf is straight; Norbury Library is closed."
    assert out[4] == TEXTS[4] and out[6] == "" and out[7] is None and out[8] == TEXTS[8]


#: Sentences that neither the fit nor the thresholds have seen, other names and numbers in other words: <kind:value>.
UNSEEN = """
The invitation came back, so I tried <email:p.okafor@blue-mail.example.net> instead.|Whoever runs <email:desk77@city.test> never reads it.|<name:Marta Kovács> borrowed the ladder again.|After the match <name:Joaquín> and <name:Beatrix Holloway> shared a taxi.
My sister's landlord, <name:Gregor Vašek>, wants the rent in cash.|Voicemail from <phone:+44 7911 123 456> at dawn.|If nobody opens, try <phone:(503) 555-0199>.|Sag <name:Friederike Baumann> bitte Bescheid.|Der Notar ist in der <address:Lindenstraße 48> im zweiten Stock.
The parcel sits at <address:77 Harrow Lane, Weston> until noon.|Their studio, <address:12b Mill Road>, leaks.|Renewed my passport, it is now <id:M48201937>.|The nurse copied <id:QQ 12 34 56 C> onto the chart.|Le médecin s'appelle <name:Camille Rousseau>.|On dîne chez <name:Océane> samedi.
Mándame la factura a <email:lucia-perez@correo.test>, gracias.|Su teléfono, <phone:+34 612 345 678>, no contesta.|El piso está en <address:calle de Toledo, 15>.|週五要跟<name:林志豪>開會|<name:許雅婷>把票弄丟了。|我表姐<name:周佩怡>結婚了|醫院打來，號碼是<phone:0928-331-775>。|新家在<address:中正路二段45號3樓>，歡迎來玩。
護照<id:A301928374>快過期了|會計說寄到<email:acc@firma.test>就行|I dreamt that <name:Ottoline Pryce> had a horse.|<name:Bartholomew> snores.|Signed, <name:T. Ferreira>|Ms <name:Underhill> moved the exam.|The choir practised in Weston Hall all afternoon.|Trains to Glenbrook leave every hour.
We painted the Old Mill Inn blue.|The Riverside Bowling Club lost 4 to 2.|Release 7.2.14 broke build 20394.|ISBN 978-1-234-56789-7 is out of print.|It was 1998 or 1999, I forget.|The file has 10482993 rows and 12 columns.|Nothing beats Glenbrook Castle in May.|高速公路上塞車兩小時。|周圍的溫度上升了。|許多人喜歡夏天的海。|方便的話明天見。
Ich mag den Winter in Glenbrook.|El tren a Villanorte sale a las 10:45.|Le musée de Saint-Aubin ouvre à 9 h.|for i in range(300): total += 4|Invoice INV-2024551 over $1,250.00|See https://docs.example/page?id=4829104|server 10.0.0.12 restarted at 03:14|Happy Birthday to the whole Office!"""


def test_unseen_sentences(spark, redactor):
    rows, truth = [], set()
    for k, sentence in enumerate(x.strip() for x in re.split(r"[|\n]", UNSEEN) if x.strip()):
        truth |= {(k, kind) for kind in re.findall(r"<(\w+):", sentence)}
        rows.append((k, re.sub(r"<\w+:([^>]*)>", r"\1", sentence)))
    got = {(r.k, r.kind) for r in redactor.spans(spark.createDataFrame(rows, "k int, t string"), ["k"], "t").collect()}
    print("missed", sorted((rows[k][1], kind) for k, kind in truth - got), "wrong", sorted((rows[k][1], kind) for k, kind in got - truth))
    assert len(got & truth) / len(truth) > 0.85 and len(got & truth) / len(got) > 0.85


def test_frames_left_out_of_the_fit(spark, redactor):
    hit = wrong = missed = 0
    rows, truth = [], {}
    for k in range(0, 4000, 5):
        held, text, spans = example(k, 77)
        assert held
        rows.append((k, text))
        truth[k] = {kind for _, _, kind in spans}
    found = {}
    for r in redactor.spans(spark.createDataFrame(rows, "k int, t string"), ["k"], "t").collect():
        found.setdefault(r.k, set()).add(r.kind)
    for k, kinds in truth.items():
        hit += len(kinds & found.get(k, set()))
        wrong += len(found.get(k, set()) - kinds)
        missed += len(kinds - found.get(k, set()))
    print(hit, wrong, missed)
    assert hit / (hit + missed) > 0.93 and hit / (hit + wrong) > 0.93


def test_long_lists_of_names_are_joined(spark, redactor, monkeypatch):
    """The same findings whether the tasks get all name words or each text its own."""
    people = spark.createDataFrame([(f"{g} {f}",) for g in ("Xanthe", "Ulrik", "Pérrine", "Otis") for f in ("Quill", "Rowe", "Stagg", "Thorn")] + [(f"王{a}{b}",) for a in "婉婷" for b in "岑彤沐"], "name string")
    assert {r.word for r in privacy.name_words(people, "name").collect()} == {"gxanthe", "gulrik", "gperrine", "gotis", "fquill", "frowe", "fstagg", "fthorn"}
    texts = spark.createDataFrame([(1, "Xanthe Quill met ULRIK."), (2, "It was Otis, not Stagg."), (3, "nothing"), (4, None), (5, "The Thorn and Pérrine")], "k int, t string")
    handed = privacy.Redactor(redactor.model, redactor.thresholds, privacy.Names(redactor.names.given | {"xanthe", "ulrik", "perrine", "otis"}, frozenset({"quill", "rowe", "stagg", "thorn"}), redactor.names.signs))
    joined = privacy.Redactor(redactor.model, redactor.thresholds, privacy.Names(redactor.names.given, frozenset(), redactor.names.signs), privacy.name_words(people, "name"))
    found = [sorted(map(tuple, r.spans(texts, ["k"], "t").collect())) for r in (handed, joined)]
    assert found[0] == found[1] and found[0]


def test_kept_redactor_finds_the_same(spark, redactor, tmp_path):
    redactor.save(str(tmp_path / "kept"))
    again = privacy.Redactor.load(spark, str(tmp_path / "kept"))
    df = spark.createDataFrame(list(TEXTS.items()), "k int, t string")
    found = [sorted(map(tuple, r.spans(df, ["k"], "t").collect())) for r in (redactor, again)]
    assert found[0] == found[1] and again.names == redactor.names


def test_overlaps_and_no_rows(spark, redactor):
    assert privacy.best_spans([(0, 5, "phone", 0.9), (2, 9, "id", 0.95), (20, 30, "name", 0.6)]) == [(2, 9, "id"), (20, 30, "name")]
    assert redactor.spans(spark.createDataFrame([], "k int, t string"), ["k"], "t").count() == 0
