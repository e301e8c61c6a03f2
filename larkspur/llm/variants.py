"""Variant spellings of people and organisations, linked by merging and matching again.

Every spelling is read into a form: given name, family name and initial of a person; kind and own name of an
organisation; the syllables of a romanised name; or a string that means only itself. Nodes with a form in common are merged; a merged node has
the forms and initials of all its members, so that it meets others in more blocks; blocking, comparing and
merging go on until nothing merges any more.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.components import connected_components
from larkspur.session import cut_lineage

# Common short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha xander sandy", "alexandra": "alex sasha sandra", "amelie": "mel amy", "anastasia": "nastya stasia ana",
    "andrea": "andy drea", "andrew": "andy drew", "anthony": "tony", "bartholomew": "bart", "benjamin": "ben benji benny",
    "catherine": "cathy kate kitty", "charles": "charlie chuck", "charlotte": "lottie charlie", "christopher": "chris kit topher",
    "cornelius": "con neil", "daniel": "dan danny", "daniela": "dani", "david": "dave", "deborah": "deb debbie",
    "dolores": "lola", "dorothea": "dot dora thea", "dorothy": "dot dolly", "edward": "ed eddie ned ted teddy", "eleanor": "ellie nell nora",
    "elizabeth": "beth betty eliza lisa liz lizzie", "florence": "flo flossie", "francisco": "paco pancho", "frederick": "fred freddy freddie",
    "gabriel": "gabe", "gerald": "gerry jerry", "guadalupe": "lupe", "hannelore": "hanne lore", "harold": "hal harry", "henrietta": "etta hetty",
    "henry": "hal harry", "ignacio": "nacho", "ines": "nesi", "isabella": "bella izzy", "james": "jim jimmy jamie", "john": "jack johnny",
    "jonathan": "jon johnny", "josefina": "fina pepa", "joseph": "joe joey", "jurgen": "jogi", "katherine": "kate kathy kitty",
    "lawrence": "larry laurie", "leonard": "len lenny leo", "margaret": "maggie meg peggy", "matilda": "mattie tilly", "michael": "mike mick",
    "mikhail": "misha", "nathaniel": "nat nate", "nicholas": "nick nicky", "oliver": "ollie", "patricia": "pat patty trish", "patrick": "pat paddy",
    "penelope": "penny", "quentin": "quin", "raphael": "raffi rafe", "rebecca": "becky", "rene": "renny", "richard": "dick rick",
    "robert": "bob bobby rob robbie", "samantha": "sam sammy", "samuel": "sam sammy", "susannah": "sue susie", "theodore": "ted teddy theo",
    "thomas": "tom tommy", "timothy": "tim timmy", "ursula": "ulla uschi", "victoria": "tori vicky", "vincent": "vince vinny",
    "wilhelmina": "mina willa", "william": "bill billy liam will", "wolfgang": "wolf", "xaviera": "xavi", "yolanda": "yoli", "zachary": "zach zak",
}
# Titles before a name, words for a role, words and legal forms of organisations.
TITLES = set("dr mr mrs ms miss prof professor coach sir madam herr frau senor senora m mme".split())
ROLES = set("doctor coach cousin landlord boss neighbour neighbor teacher friend brother sister mother father aunt uncle colleague dentist".split()) | {
    "老師", "同事", "房東", "醫生", "醫師", "教練", "老闆", "鄰居", "朋友", "同學", "表弟", "表妹", "阿姨", "叔叔",
}
LEGAL = set("inc incorporated llc ltd limited co company corp corporation gmbh ag plc sa bv".split())
KINDS = set(
    "association bakery bank brothers centre clinic club college community foundation group hospital institute international laboratories "
    "library logistics manufacturing museum partners school services software solutions studio systems travel university".split()
)
SAME_KIND = {"center": "centre", "ctr": "centre", "intl": "international", "bros": "brothers", "labs": "laboratories", "mfg": "manufacturing"}
FILLERS = {"the", "of", "and", "for", "&"}

#: Words of this length and more may be one typing error apart, in comparing and so in blocking.
SHORTEST = 4
#: Blocks with more nodes than this are split by the given name, too.
LARGE_BLOCK = 100
#: Lists of entities up to this size (8 bytes each) are handed to every task, longer ones joined by a shuffle.
MOST_BROADCAST = 200_000
#: Given names pair up as short forms once seen so in profiles with as many different family names.
SUPPORT = 2

FORM = "kind string, given string, others array<string>, family string"
#: A syllable of a romanised Chinese name.
SYLLABLE = re.compile(
    "(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?"
    "(?:iang|iong|uang|ang|eng|ing|ong|ian|iao|uai|uan|ai|an|ao|ei|en|er|ia|ie|in|iu|ou|ua|ue|ui|un|uo|a|e|i|o|u)"
)
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


@lru_cache(1)
def _full_names() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for full, short in NICKNAMES.items():
        for name in short.split():
            out.setdefault(name, []).append(full)
    return out


def folded(text: str) -> str:
    """Ordinary width, no accents or invisible signs, single spaces; digits inside words as the letters they mimic."""
    text = unicodedata.normalize("NFKD", text).replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("ł", "l").replace("Ł", "L")
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    text = re.sub(r"[‘’`´]", "'", text)
    text = re.sub(r"(?<=[^\W\d_])[01]|[01](?=[^\W\d_]{2})", lambda m: "o" if m[0] == "0" else "l", text) if not re.search(r"\d\d", text) else text
    return unicodedata.normalize("NFC", re.sub(r"\s+", " ", text)).strip()


def _kind_of(word: str, dotted: bool) -> str | None:
    """The organisation's kind that a word names or abbreviates."""
    word = SAME_KIND.get(word, word)
    if word in KINDS:
        return word
    if dotted and len(word) >= 3:
        for kind in sorted(KINDS):
            if kind.startswith(word):
                return kind
    return None


def read_form(spelling: str, romanised: bool = True) -> tuple[str, str, list[str], str]:
    """``kind, given, others, family``: p a person, i one with an initial or less, o an organisation, r a romanised name
    (its syllables in ``others``), x and h a string that means only itself, the latter made up, and an empty
    kind for what names nobody. Without ``romanised`` such a name is q, its last word a family name and the rest a given one."""
    text = folded(spelling)
    plain = text.lower().strip(" .,")
    if not plain or plain in ROLES or plain.removeprefix("the ") in ROLES:
        return "", "", [], ""
    if re.search(r"[぀-ヿ㐀-鿿가-힯]", text):
        return "x", "", [], re.sub(r"[\s·・.,\-]", "", text)
    if re.search(r"\d\d", text):
        return "h", "", [], plain
    text = re.sub(r"\s+[-–]\s+\w+$|\s*\([^()]*\)$", "", text)
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)
    words = re.findall(r"[^\W\d_]+", re.sub(r"(?<=\w)\.(?=\w\.)", "", text.lower()))
    legal = [w for w in words if w in LEGAL]
    kinds = [(w, k) for m in re.finditer(r"([^\W\d_]+)(\.?)", text.lower()) if (k := _kind_of(w := m[1], bool(m[2])))]
    if legal or (kinds and len(words) > 1):
        named = {w for w, _ in kinds}
        own = [w for w in words if w not in LEGAL and w not in FILLERS and w not in named]
        if own:
            return "o", " ".join(sorted(k for _, k in kinds)), [], " ".join(sorted(own))
    comma = "," in text
    if comma:
        last, _, first = text.partition(",")
        text = f"{first.strip()} {last.strip()}"
        text = re.sub(r"(?<=[^\W\d_])-(?=[^\W\d_])", "", text)
    others = [m.lower() for m in re.findall(r"(?:\s|^)(?:\(([^\W\d_]+)\)|'([^\W\d_]+)'|\"([^\W\d_]+)\")(?=\s)", text) for m in m if m]
    text = re.sub(r"(?:\s|^)(?:\([^\W\d_]+\)|'[^\W\d_]+'|\"[^\W\d_]+\")(?=\s)", " ", text)
    words = [w.replace("'", "") for w in WORD.findall(text.lower().replace("_", " "))]
    while len(words) > 1 and words[0] in TITLES and len(words[0]) > 1:
        words = words[1:]
    full = [w for w in words if len(w) > 1]
    if not full:
        return "", "", [], ""
    if len(words) > 1 and all(re.fullmatch(f"(?:{SYLLABLE.pattern})+", w) for w in words):
        syllables = [x for w in ([*words[-1:], *words[:-1]] if comma else words) for x in SYLLABLE.findall(w)]
        if len(syllables) <= 4:
            return ("r", "", syllables, " ".join(sorted(syllables))) if romanised else ("q", "".join(words[:-1]), [], words[-1])
    family = full[-1]
    if len(full) > 1:
        return "p", full[0], others, family
    if others:
        return "p", others[0], others[1:], family
    return "i", next((w for w in words if len(w) == 1), ""), [], family


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    full = _full_names()
    for batch in batches:
        spelled = [(s, read_form(s)) for s in batch["spelling"]]
        # what could be a romanised name could also be any other, such as Lena Wang
        spelled += [(s, read_form(s, False)) for s, form in spelled if form[0] == "r"]
        out = pd.DataFrame([form for _, form in spelled], columns=["kind", "given", "others", "family"])
        out["others"] = [sorted({*o, *(f for g in (given, *o) for f in full.get(g, ()))} - {given}) if kind == "p" else o for kind, given, o in zip(out.kind, out.given, out.others)]
        out.insert(0, "spelling", [s for s, _ in spelled])
        yield out


def near(a: str, b: str) -> bool:
    """Equal or one typing error apart: a letter more, less or other, or two swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < SHORTEST:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) != len(b):
        short, long = sorted((a, b), key=len)
        return long[k + 1 :] == short[k:]
    return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def _match(given_a: pd.Series, family_a: pd.Series, given_b: pd.Series, family_b: pd.Series) -> pd.Series:
    """Whether two profiles name the same: any of their family names and any of their given names are alike, or one has
    them the other way round. Organisations have no given names."""

    def like(x: list[str], y: list[str]) -> bool:
        return bool(set(x) & set(y)) or any(near(a, b) for a in x for b in y)

    def same(ga: list[str], fa: list[str], gb: list[str], fb: list[str]) -> bool:
        if not ga or not gb:
            return like(fa, fb)
        return (like(fa, fb) and like(ga, gb)) or (like(fa, gb) and like(ga, fb))

    return pd.Series([same(*map(list, x)) for x in zip(given_a, family_a, given_b, family_b)])


def _none() -> Column:
    return F.array().cast("array<string>")


def _less(word: Column) -> Column:
    """The word and, where `near` allows an error, all its spellings with one letter less: words one error apart share one of them."""
    without = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(F.substring(word, 1, i - 1), F.substring(word, i + 1, F.char_length(word))))
    return F.when(F.char_length(word) >= SHORTEST, F.array_distinct(F.concat(F.array(word), without))).otherwise(F.array(word))


def spelling_forms(nodes: DataFrame, key: str, name: str, aliases: str) -> DataFrame:
    """``node, kind, given, others, family`` of every spelling that names someone, family names found by what stands
    for a given name elsewhere in the table, and short forms learnt from profiles added to ``others``."""
    spelled = nodes.select(F.col(key).alias("node"), F.explode(F.array_distinct(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))))).alias("spelling"))
    spelled = spelled.filter(F.col("node").isNotNull() & F.col("spelling").isNotNull())
    read = spelled.select("spelling").distinct().mapInPandas(_read, "spelling string, " + FORM)
    forms = cut_lineage(spelled.join(read, "spelling").filter("kind != ''").drop("spelling").distinct())

    givens = forms.filter("kind = 'p'").groupBy("given").agg(F.countDistinct("family").alias("n")).filter("n > 2").select("given")
    turned = forms.filter("kind = 'p'").join(givens.withColumn("_known", F.lit(True)), "given", "left").join(
        givens.select(F.col("given").alias("family"), F.lit(True).alias("_turned")), "family", "left"
    )
    swap = F.col("_known").isNull() & F.col("_turned").isNotNull()
    swapped = turned.select(
        "node", "kind", F.when(swap, F.col("family")).otherwise(F.col("given")).alias("given"), "others",
        F.when(swap, F.col("given")).otherwise(F.col("family")).alias("family"),
    )
    forms = cut_lineage(swapped.unionByName(forms.filter("kind != 'p'").select("node", "kind", "given", "others", "family")))

    people = forms.filter("kind = 'p'").select("node", "family", "given").distinct()
    pairs = people.join(people.select("node", "family", F.col("given").alias("short")), ["node", "family"]).filter("given != short")
    learnt = pairs.groupBy("given", "short").agg(F.countDistinct("family").alias("n")).filter(F.col("n") >= SUPPORT)
    learnt = learnt.join(givens, "given", "left_semi").join(givens.select(F.col("given").alias("short")), "short", "left_semi")
    learnt = learnt.groupBy("given").agg(F.collect_set("short").alias("_learnt"))
    forms = forms.join(learnt, "given", "left").select(
        "node", "kind", "given", F.array_union("others", F.coalesce("_learnt", F.array().cast("array<string>"))).alias("others"), "family"
    )
    return forms.unionByName(_romanised(forms))


def _romanised(forms: DataFrame) -> DataFrame:
    """Romanised forms of names in Chinese characters: each character's syllable is learnt from the nodes that have both."""
    signs = forms.filter("kind = 'x'").select("node", "family", F.split("family", "").alias("_signs")).filter(F.size("_signs").between(2, 4))
    latin = forms.filter("kind = 'r'").select("node", F.col("others").alias("_syllables"))
    both = signs.join(latin, "node").filter(F.size("_signs") == F.size("_syllables"))
    pairs = both.select(F.explode(F.arrays_zip("_signs", "_syllables")).alias("_p")).groupBy("_p").count()
    sounds = pairs.groupBy(F.col("_p._signs").alias("_sign")).agg(F.max_by("_p._syllables", F.struct("count", "_p._syllables")).alias("_sound"))
    each = signs.select("family", "_signs").distinct().select("family", F.size("_signs").alias("_n"), F.posexplode("_signs").alias("_at", "_sign"))
    heard = each.join(sounds, "_sign").groupBy("family", "_n").agg(F.array_sort(F.collect_list("_sound")).alias("_sounds"))
    heard = heard.filter(F.size("_sounds") == F.col("_n")).select("family", F.array_join("_sounds", " ").alias("_latin"))
    return signs.join(heard, "family").select(
        "node", F.lit("r").alias("kind"), F.lit("").alias("given"), F.array().cast("array<string>").alias("others"), F.col("_latin").alias("family")
    )


def link_variants(nodes: DataFrame, key: str, name: str, aliases: str, most_rounds: int | None = None) -> DataFrame:
    """``key, entity`` of every node: the smallest key of those that mean the same person or organisation.

    ``key`` is an integer, ``aliases`` an array of strings. Words for a role name nobody. An initial, or a family
    name alone, is linked only where exactly one entity fits. Null names and null, empty or blank aliases are
    passed over, a node without any name stays alone, repeated rows count once, rows without a key give
    none; an empty table gives none; other columns are ignored whatever their names. Texts of any length
    are read whole. Goes on until nothing merges; raises where ``most_rounds`` are given and don't suffice.
    """
    forms = cut_lineage(spelling_forms(nodes, key, name, aliases).distinct())
    everyone = nodes.select(F.col(key).alias("node")).dropna().distinct()

    # every form belongs to the first node that has it; the others are merged with that one
    whole = forms.filter("kind != 'i'").withColumn("_form", F.concat_ws("|", F.col("kind"), F.array_sort(F.array("given", "family"))))
    whole = cut_lineage(whole.join(whole.groupBy("_form").agg(F.min("node").alias("owner")), "_form"))
    exact = whole.select(F.col("node").alias("a"), F.col("owner").alias("b")).filter("a != b")
    owned = whole.select("owner", "kind", "given", "others", "family").distinct()
    owned = cut_lineage(owned.filter("kind in ('p', 'o', 'q')").withColumn("form", F.monotonically_increasing_id()))
    keys = cut_lineage(_block_keys(owned))

    # single forms first, then what has been merged
    alone = _alike(owned, keys, owned.select("form", F.col("form").alias("entity")), None)
    for s in "ab":
        alone = alone.join(owned.select(F.col("form").alias(s), F.col("owner").alias(f"_{s}")), s)
    edges = exact.unionByName(alone.select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a != b"))
    owned = owned.filter("kind != 'q'")
    before, entity = None, _merged(everyone.select("node", F.col("node").alias("entity")), edges)
    for done in count():
        member = owned.select("form", F.col("owner").alias("node")).join(entity, "node").select("form", "entity")
        edges = cut_lineage(_alike(owned, keys, member, _richer(owned, before, entity)))
        if edges.isEmpty():
            break
        if done == most_rounds:
            raise RuntimeError(f"spellings still merge after {most_rounds} rounds")
        before, entity = entity, _merged(entity, edges)
    # Initials change no profile's given and family names and join no two entities that have such, so that nothing can merge after
    # them: neither these, nor what has no name but initials, whose choice depends on nothing else.
    entity = _merged(entity, _by_initial(forms.join(entity, "node").select("entity", "kind", "given", "others", "family").distinct()))
    return entity.select(F.col("node").alias(key), "entity")


def _merged(entity: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges, "a", "b").select(F.col("node").alias("entity"), "component")
    return cut_lineage(entity.join(found, "entity", "left").select("node", F.coalesce("component", "entity").alias("entity")))


def _people(owned: DataFrame) -> DataFrame:
    """Forms of people and organisations: ``cat`` is an organisation's kind, ``names`` what stands for a person's given name,
    ``weak`` a romanised name read like others."""
    return owned.select(
        "form", F.col("owner").alias("node"), (F.col("kind") == "q").alias("weak"), F.when(F.col("kind") == "o", F.concat(F.lit("o|"), "given")).otherwise("p|").alias("cat"), "family",
        F.when(F.col("kind") == "o", _none()).otherwise(F.array_union(F.array("given"), "others")).alias("names"),
    )


def _block_keys(owned: DataFrame) -> DataFrame:
    """``form, turned, key``: the form's family name and, turned, its given names, each with one letter less."""
    sides = F.array(F.struct(F.lit(False).alias("turned"), F.array("family").alias("words")), F.struct(F.lit(True).alias("turned"), F.col("names").alias("words")))
    words = _people(owned).select("form", "cat", F.inline(sides)).select("form", "cat", "turned", F.explode("words").alias("word"))
    return words.distinct().select("form", "turned", F.explode(_less(F.col("word"))).alias("word"), "cat").select("form", "turned", F.concat_ws("|", "cat", "word").alias("key"))


def _richer(owned: DataFrame, before: DataFrame | None, entity: DataFrame) -> DataFrame:
    """Entities with more pairs of a family and a given name than were written, so that they can match what none of their
    forms did: those with several of both; of these, only what was just merged of several, once all have met."""
    each = _people(owned).join(entity, "node")
    if before is not None:
        each = each.join(before.select("node", F.col("entity").alias("_was")), "node")
    several = [F.countDistinct(c).alias(f"_{c}") for c in ("family", "names", *(["_was"] if before is not None else []))]
    many = each.groupBy("entity", "cat").agg(*several).filter("_family > 1 and _names > 1")
    return (many if before is None else many.filter("__was > 1")).select("entity").distinct()


def _alike(owned: DataFrame, keys: DataFrame, member: DataFrame, fresh: DataFrame | None) -> DataFrame:
    """Pairs of entities (``member`` has the ``entity`` of each ``form``) with like names, at least one of them ``fresh``
    (richer than when they last met) where that is given. Blocks hold the entities with family names one error apart; large blocks
    are split by given name one error apart, which like names always share. Two romanised names are never alike but equal."""
    if fresh is not None:
        fresh = cut_lineage(fresh)
        n_fresh = fresh.count()
        if not n_fresh:
            return fresh.select(F.col("entity").alias("a"), F.col("entity").alias("b"))
        new = lambda side: F.broadcast(fresh.withColumnRenamed("entity", side)) if n_fresh <= MOST_BROADCAST else fresh.withColumnRenamed("entity", side)
        keys = keys.join(keys.join(member.join(new("entity"), "entity", "left_semi"), "form", "left_semi").select("key").distinct(), "key", "left_semi")
    everyone = _people(owned).join(member, "form").groupBy("entity")
    profile = cut_lineage(everyone.agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("_g"), F.collect_set("family").alias("_f"), F.bool_and("weak").alias("weak")))
    keyed = keys.join(member, "form").select("entity", "turned", "key").distinct().join(profile, "entity")
    keyed = cut_lineage(keyed.select("entity", "turned", "weak", "key", F.when(F.col("turned"), F.col("_f")).otherwise(F.col("_g")).alias("rest")))
    # given names only meet family names: of two turned ones, the families meet as well
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bool_and("turned").alias("_turned"), F.bool_and("weak").alias("_weak")).filter("n > 1 and not _turned and not _weak")
    keyed = keyed.join(sizes.select("key", "n"), "key")
    each = ["entity", "turned", "weak", "rest"]
    large = keyed.filter((F.col("n") > LARGE_BLOCK) & (F.size("rest") > 0)).select(*each, "key", F.explode("rest").alias("given"))
    large = large.select(*each, "key", F.explode(_less(F.col("given"))).alias("given")).select(*each, F.concat_ws("|", "key", "given").alias("key"))
    blocks = keyed.filter((F.col("n") <= LARGE_BLOCK) | (F.size("rest") == 0)).select(*each, "key").unionByName(large)
    near_given = (F.size("x") == 0) | F.exists("x", lambda x: F.exists("y", lambda y: (x == y) | (F.levenshtein(x, y, 2) >= 0)))
    one, other = (blocks.select(F.col("entity").alias(e), F.col("rest").alias(r), F.col("turned").alias(f"turned_{e}"), F.col("weak").alias(f"weak_{e}"), "key") for e, r in ("ax", "by"))
    pairs = one.join(other, "key").filter("a < b and not (turned_a and turned_b) and not (weak_a and weak_b)").filter(near_given).select("a", "b").distinct()
    if fresh is not None:
        flags = [new(s).withColumn(f"_new_{s}", F.lit(True)) for s in "ab"]
        pairs = pairs.join(flags[0], "a", "left").join(flags[1], "b", "left").filter("_new_a or _new_b").select("a", "b")
    for s in "ab":
        pairs = pairs.join(profile.select(F.col("entity").alias(s), F.col("_g").alias(f"_g{s}"), F.col("_f").alias(f"_f{s}")), s)
    return pairs.filter(F.pandas_udf(_match, "boolean")("_ga", "_fa", "_gb", "_fb")).select("a", "b")


def _by_initial(profile: DataFrame) -> DataFrame:
    """Entities known only by an initial or family name, each with the only entity that it fits, family names written
    alike before those one error apart; with each other where nobody fits."""
    known = profile.filter("kind in ('p', 'q')")
    bare = profile.filter("kind = 'i'").join(profile.filter("kind not in ('i', 'h')").select("entity").distinct(), "entity", "left_anti")
    initials = F.array_union(F.transform(F.array_union(F.array("given"), "others"), lambda g: F.substring(g, 1, 1)), F.array(F.lit("")))
    fitting = known.select("entity", "family", F.explode(F.array_distinct(initials)).alias("given"))

    def only(asked: DataFrame, offered: DataFrame, on: list[str]) -> DataFrame:
        ends = offered.groupBy(*on).agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))
        return asked.join(ends, on).groupBy(F.col("entity").alias("a")).agg(F.min("lo").alias("b"), F.max("hi").alias("hi"))

    exact = only(bare, fitting, ["family", "given"])
    less = lambda df: df.select("entity", "given", F.explode(_less(F.col("family"))).alias("key"))
    rest = bare.join(exact.select(F.col("a").alias("entity")), "entity", "left_anti")
    loose = only(less(rest), less(fitting), ["key", "given"])
    alone = rest.join(loose.select(F.col("a").alias("entity")), "entity", "left_anti").filter("given != ''")
    each = alone.groupBy("family", "given").agg(F.min("entity").alias("b"))
    alone = alone.join(each, ["family", "given"]).filter("entity != b").select(F.col("entity").alias("a"), "b")
    return exact.unionByName(loose).filter("b = hi").select("a", "b").unionByName(alone)


def entity_pairs(entities: DataFrame, key: str) -> DataFrame:
    """All pairs inside each entity, the smaller key first."""
    a, b = (entities.select("entity", F.col(key).alias(f"{key}_{s}")) for s in "ab")
    return a.join(b, "entity").filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")


def redirected_edges(edges: DataFrame, persons: DataFrame, entities: DataFrame, key: str, name: str) -> DataFrame:
    """Graph edges whose person ends are moved to the name of the entity's first node; equal ones once."""
    named = entities.join(persons.select(F.col(key), F.col(name).alias("_name")), key)
    first = named.filter(F.col(key) == F.col("entity")).select("entity", F.col("_name").alias("_to"))
    to = named.join(first, "entity").select(F.col("_name"), "_to").dropDuplicates(["_name"])
    for end in ("src", "dst"):
        mine = to.select(F.col("_name").alias(end), F.lit("Person").alias(f"{end}_label"), "_to")
        edges = edges.join(mine, [end, f"{end}_label"], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges.distinct()
