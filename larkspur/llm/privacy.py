"""Personal information in free text: candidates, boosted trees, thresholds, placeholders.

Small generators propose every span that might be an email address, phone number, identity number, street
address or name: whatever has the form of a number or address, every few capitalised words in a row, every
sign of a Chinese family name with the next one or two. What stands around a span, lists of names and what its
words are otherwise used for are features only; gradient-boosted trees, fitted on labelled examples, score the spans; a
threshold per kind, set on frames left out of the fit, and the best of each group of overlapping spans
decide what is redacted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkspur.llm.privacy_examples import CJK_GIVEN, COMPOUND, CWORDS, KNOWN_FAMILY, KNOWN_WORDS, example
from larkspur.llm.variants import NICKNAMES
from larkspur.session import cut_lineage

KINDS = ("email", "phone", "id", "address", "name")
#: Labelled texts that the trees are fitted on.
MOST_EXAMPLES = 6000
#: Lists of name words up to this size are handed to every task; of longer ones each text gets its own by a join.
MOST_HANDED = 100_000
#: Words or signs stand for a given or family name once seen so beside as many others.
SUPPORT = 3
#: Pairs of signs are words, not beginnings of names, if they stand in the texts so often and at most so seldom before a name's sign.
WORD_COUNT, NAME_SHARE = 8, 0.4
#: Words in a row that a candidate for a name may have.
MOST_WORDS = 3

# Words around personal information, and around numbers and names that are none.
CUES = {
    "email": r"mail|inbox|reply|answer|subscri|login|account|contact|write|correo|buzón|escr[ií]b|schreib|postfach|adresse|écri|répond|信箱|郵件|帳號|回覆|寄",
    "phone": r"\btel|phone|call|ring|dial|mobile|\bcell|\bfax|text|whatsapp|sms|hotline|móvil|llam|telef|handy|ruf|anruf|appel|portable|numéro|電話|手機|打|撥|分機|傳真|聯絡",
    "id": r"\bid\b|identi|passport|licen[cs]e|\btax\b|insur|social|security|document|card|visa|\bdni\b|\bnie\b|pasaporte|tarjeta|ausweis|steuer|versicher|carte|sécurité|護照|身分|身份|證|健保|稅",
    "address": r"live|living|house|address|office|ship|deliver|move|rent|room|visit|wohn|anschrift|adresse|liefer|vivi|vivo|direcci|envi|habit|livr|住|地址|搬|送|寄|家|公司",
}
ANTI = r"\b(?:isbn|tracking|trk|parcel|inv|invoice|order|sha|commit|host|ping|grid|model|build|ticket|version|chapter|section|page|room|floor|route|bus|stop|row|port|info|flight|born)\b|nt\$|usd|[$€£]|print\(|range\("
STREETS = "street|st|road|rd|avenue|ave|lane|ln|close|crescent|drive|dr|court|ct|square|sq|terrace|boulevard|blvd|way|row|gardens|hill|grove|place|pl"
PLACES = frozenset(
    "library club choir bay street road lane hill station office bridge park school university college hospital café cafe town city village lake river mountain mount island "
    "museum theatre theater hotel market square church airport harbour harbor port beach valley coast company ltd inc team league society association avenue bakery radio tower museo calle "
    "straße platz bahnhof rue marché jardin jardins plaza garden gardens north south east west old new upper lower saint blue red green golden great project day morning book".split()
)
#: Words that stand for a person, before a comma or name; after these one may follow.
RELATIONS = frozenset(
    "friend colleague boss neighbour neighbor teacher doctor dentist nurse brother sister mother father mom dad mum uncle aunt cousin son daughter wife husband landlord landlady plumber client "
    "speaker owner coach roommate flatmate partner manager dear hi hello hey freund freundin kollege kollegin nachbar nachbarin bruder schwester amigo amiga hermano hermana vecino ami amie frère sœur voisin "
    "regards cheers sincerely love yours best warmly thanks by".split()
)
TO_PEOPLE = frozenset("with to for from and ask asked met meet saw told called call hired thanked visited gave owe miss believes heard mit von für und con de para y avec pour chez et à hat habe".split())
TO_PLACES = frozenset("in at near through over around towards toward into of the a an bei nach im am en au aux dans sur la le les el los las der die das den dem".split())
BY_PEOPLE = frozenset(
    "said says told tells asked asks called calls came comes went goes will would has had is was and wants wanted gave gives sent sends brought brings left thinks knows likes sings paints never always hat ist war kommt sagt und dijo dice me es era viene y a est dit et habite vient who".split()
)
# Words that no name begins or ends with.
FUNCTION = frozenset(
    "the a an i we you he she it they my our your his her its their this that these those there here when where while if but and or so then because although as at in on of to from for with without after before since until by about "
    "what who why how which yes no not nobody everyone everybody everything nothing something someone each every some any all both most later once now today tomorrow yesterday again also just only still very please "
    "monday tuesday wednesday thursday friday saturday sunday january february april june july august september october november december spring summer autumn winter christmas easter "
    "der die das ein eine ich wir du er sie es und oder aber wenn mit von für nach am im in montag dienstag mittwoch donnerstag freitag samstag sonntag el la los las un una yo y o pero si con de en le les des un une je nous vous il elle et ou mais si avec dans "
    "zwischen neben hinter unter über vor ohne gegen um durch während seit bis auf aus bei zu an als wie dann dort hier heute gestern morgen jeder jede jedes kein keine mein meine dein sein ihr unser nicht nur noch schon auch wo wer was warum "
    "entre sobre sin hasta desde para por cuando donde como porque aunque hoy ayer mañana este esta estos todo toda cada mi tu su no ya también nadie aquí ahora quien que del al se me "
    "sous sur sans contre vers chez entre depuis pendant pour par quand où comme parce hier demain aujourd'hui ce cette ces tout toute chaque mon ma mes ton son sa ses ne pas plus personne ici qui que au aux du se me on "
    "between beside behind under over above near against during through across along among around down up off out within outside inside instead unless whether whose whom many much few several other another such own same than too "
    "regards cheers sincerely yours dear hi hello best thanks re fw fwd info".split()
)
TITLES = r"(?:dr|mr|mrs|ms|miss|prof|sir|herr|frau|señora?|mme|m|coach|professor|doctor)"
AMBIGUOUS = frozenset("will con dot sue pat bill rob ana lore mina flo len hal ned drew mel nat dan mark may rose grace jack art dick chuck kit neil wolf sandy hope joy dawn".split())
SURNAMES = frozenset(
    "王李張劉陳楊黃趙吳周徐孫馬朱胡郭何林高羅鄭梁謝宋唐許韓馮鄧曹彭曾蕭田董袁潘蔡蔣余于杜葉程蘇魏呂丁任沈姚盧姜崔鍾譚陸汪范金石廖賈夏韋付方白鄒孟熊秦邱江尹薛閻段雷侯龍史陶黎賀顧毛郝龔邵萬錢嚴覃武戴莫孔向湯"
    "张刘陈杨黄赵吴孙马罗郑谢许韩冯邓萧蒋叶苏吕卢钟谭陆贾韦邹阎龙贺顾龚万钱严汤歐欧賴赖紀纪龐庞溫施洪詹游翁童康季伍符柯祝岳景單甘卓牛喬申包成管易路關簡"
)
# Signs that are common in given names, titles, and signs that stand before, behind and never inside names.
GIVEN_CJK = frozenset(CJK_GIVEN + "佳宜庭思穎宗筱哲彥廷強偉芳蘭梅麗珍雯慧敏靜娟信義仁安嘉慶銘峰凱翔昱睿品妍心怡萱瑜琪晴晨曦辰浩然博雨桐夢琳雪")
TITLE_CJK = re.compile("先生|小姐|女士|醫師|醫生|老師|教授|太太|同學|師傅|經理")
BEFORE_CJK = frozenset("和跟與同給對向問找陪見約請謝幫讓教是聽被替為由叫把到過了的友事師居生員理人兄姐弟妹親")
BEHIND_CJK = frozenset("說來去在有是很也的要會把教走回請打不沒今明昨今從住喜想看聽給跟和與被到問送寄唱笑哭先小老同")
INNER_CJK = re.compile("[和的是在說比了著過就也把被很與跟一這那不我你他她們有沒上下來去]")

_WIDTH = {0xFF01 + k: 0x21 + k for k in range(94)} | {c: 0x20 for c in (0xA0, 0x3000, 0x2007, 0x2009, 0x202F)} | {c: 0x2D for c in (0x2010, 0x2011, 0x2012)}

WIDE = re.compile("[！-～\u00a0\u2007\u2009-\u2012\u202f\u3000]")
_HOST = r"[\w-]+(?:\.[\w-]+)*"
EMAIL = re.compile(
    rf"[\w.+%-]+(?:(?:\s?@\s?|\s?[(\[{{]\s?at\s?[)\]}}]\s?){_HOST}(?:\s?[(\[]?\s?dot\s?[)\]]?\s?[\w-]+)*|\sat\s[\w-]+(?:\sdot\s[\w-]+)+)", re.A | re.I
)
#: One of these is in every address without an at sign.
WRITTEN_AT = ("at)", "at]", "at}", "at )", "at ]", "at }", " dot ")
PHONE = re.compile(r"(?<![\d])(?:\+\s?)?\(?\d[\d() ./-]{5,22}\d(?:\s?(?:ext\.?|x|#)\s?\d{1,5})?")
IDENT = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:[A-Z]{2}[ -]?|[A-Za-z]{1,2}-?)\d(?:[ -]?\d){4,10}(?:[ -]?[A-Z]|[a-z])?|\d{3}[ -]\d{2}[ -]\d{4}|\d{6,10}[ -]?[A-Za-z]|[A-Z]\d{2}[A-Z]{2}\d{2}[A-Z]\d)(?![A-Za-z0-9])"
)
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_WORD = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*(?!\w)"
ADDRESS = [
    re.compile(rf"(?:(?:Flat|Apt\.?|Unit|Suite)\s+\w+,\s+)?\b\d{{1,5}}\s?[A-Za-z]?\s+(?:{_CAP}\s+){{1,4}}?(?i:{STREETS})\b\.?(?:,\s*(?:Apt|Flat|Unit)\.?\s+\w+)?(?:,\s*{_CAP}(?:\s[A-Z]{{1,2}}\d+\s\d[A-Z]{{2}})?)?"),
    re.compile(rf"\b\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|chemin|quai|allée|impasse|route)\s+(?:de\s+la\s+|de\s+l'|du\s+|des\s+|de\s+|d')?{_CAP}(?:,\s*\d*\s*{_CAP})?"),
    re.compile(rf"{_CAP.replace('*', '*?')}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm)\s+\d{{1,4}}(?:\s?[a-z]\b)?(?:,\s*\d*\s*{_CAP})?"),
    re.compile(rf"\b(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|[Cc]amino|[Cc]/|[Aa]vda\.?)\s+(?:de\s+la\s+|de\s+los\s+|del\s+|de\s+)?{_CAP}(?:\s{_CAP})?,?\s+(?:n\.?º?\s*)?\d{{1,4}}(?:,\s*[\dº \w]{{1,8}})?"),
]
CJK_ADDRESS = re.compile(
    r"(?:[一-鿿]{2,4}[市縣县])?(?:[一-鿿]{1,4}[區区鄉乡鎮镇])?[一-鿿]{1,5}(?:路|街|大道|巷)(?:[一二三四五六七八九十\d]+段)?(?:\d+巷)?(?:\d+弄)?\d+(?:之\d+)?[號号](?:\d+樓(?:之\d+)?)?"
)
CJK = re.compile("[一-鿿]")
CJK_RUN = re.compile("[一-鿿]{2,}")
TOKEN = re.compile(rf"[A-ZÀ-Þ]\.|{_WORD}")
DIGIT, FIVE_DIGITS = re.compile(r"\d"), re.compile(r"\d(?:\D*\d){4}")
GAP = re.compile(r"[ ]?|[ ]\(?['\"]?|['\"]?\)?[ ]|,[ ]?")
BEFORE_WORD, AFTER_WORD = re.compile(r"([^\W\d_]+)[,:]?\s*$"), re.compile(r"('s\b|’s\b)?[,]?\s*([^\W\d_]*)")
TITLE_BEFORE = re.compile(rf"(?<!\w){TITLES}\.?\s$", re.I)
CODE = re.compile(r"^\s*(?:print\(|for \w+ in|return |INFO |import |if .*:|def |#)|^\s*\w+ = ")
URL = re.compile(r"https?://\S*$|[?&]\w+=$")
CUES_OF = {kind: re.compile(rx) for kind, rx in CUES.items()}
ANTI_RX, EXTENSION = re.compile(ANTI), re.compile(r"\s?(?:ext\.?|x|#)\s?\d{1,5}$")
DATE = re.compile(r"(?:19|20)\d\d[-/. ]\d{1,2}[-/. ]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)\d\d|(?:19|20)\d{6}")
QUAD, DECIMAL, NUMBERS = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}"), re.compile(r"\d\.\d+[, ]+\d+\.\d"), re.compile(r"\d+")
SHAPE_34, SHAPE_9, LETTERS, HEX = re.compile(r"\d{3}[ -]\d{2}[ -]\d{4}"), re.compile(r"[A-Za-z][ -]?\d{3}-?\d{6}|[A-Za-z]\d{8,9}"), re.compile(r"[A-Za-z]*"), re.compile(r"[0-9a-f]+")
AT_SIGN, DOTS, UNIT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]|\sat\s", re.I), re.compile(r"\.|\s?[(\[]?\s?dot\s?[)\]]?\s?", re.I), re.compile(r"flat|apt|unit|樓|段|巷", re.I)
ACCENTS = ("éèêëáàâäíìîïóòôöúùûüñçøå", "eeeeaaaaiiiioooouuuuncoa")
_PLAIN = str.maketrans(*ACCENTS)

FEATURES = (
    *(f"is_{k}" for k in KINDS), "length", "digits", "letters", "marks", "plus", "zero", "brackets", "before_letter", "before_sign", "before_cjk", "after_letter", "after_sign",
    "cue", "anti", "code", "url", "groups", "longest_group", "shortest_group", "date", "dotted_quad", "decimal", "isbn", "shape_34", "shape_9", "letter_end", "letter_start",
    "upper", "hex", "spaced_at", "word_at", "alpha_tld", "labels", "digit_tld", "house", "unit", "cjk", "given_first", "given_any", "given_last", "family_last", "family_any", "words", "title", "initial", "comma",
    "place_inside", "place_after", "place_before", "sentence_start", "line_start", "line_end", "ambiguous", "relation", "to_people", "to_places", "by_people", "lower_after", "possessive", "cap_before", "cap_after",
    "in_email", "compound", "cjk_known", "cjk_before", "cjk_behind", "cjk_edge", "cjk_inner", "cjk_word",
)
AT = {name: k for k, name in enumerate(FEATURES)}

# Common given names beside those of the nicknames' table.
COMMON = frozenset(
    "alice anna anne barbara carlos carmen claire clara david diana elena emily emma erik eva fatima george giulia hans helen hugo jane janet jean jorge jose "
    "juan julia karen klaus laura linda lucas lucia luis maria marie mark markus martin mary mia michel miguel monica nina olga omar otto pablo paul pedro "
    "peter philip pierre rachel ruth sara sarah simon sofia sophie stefan steven susan sven teresa thomas wei yuki".split()
)


@lru_cache(1)
def common_given() -> frozenset[str]:
    return frozenset({*COMMON, *NICKNAMES, *(s for short in NICKNAMES.values() for s in short.split())})


def _plain(word: str) -> str:
    return (word.lower() if word.isascii() else word.lower().translate(_PLAIN)).strip("'\"().,")


@dataclass(frozen=True)
class Names:
    """What is known from names: given names, family names, signs of Chinese given names; and words that begin like names."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    signs: frozenset[str] = frozenset()
    words: frozenset[str] = frozenset()


def _latin_spans(text: str) -> Iterator[tuple[int, int, list[re.Match], str, str]]:
    """All spans of up to MOST_WORDS words in a row that are capitalised (initials beside), with their words and the words of
    the same run before and behind them. A comma may stand between a last and a first name."""
    run: list[re.Match] = []
    for token in [*TOKEN.finditer(text), None]:
        if run and (token is None or not GAP.fullmatch(text, run[-1].end(), token.start())):
            yield from _spans_of_run(text, run)
            run = []
        if token is not None:
            run.append(token)


def _spans_of_run(text: str, run: list[re.Match]) -> Iterator[tuple[int, int, list[re.Match], str, str]]:
    plain = [_plain(m[0]) for m in run]
    usable = [len(m[0]) > 1 and p not in FUNCTION for m, p in zip(run, plain)]
    for i in range(len(run)):
        if not usable[i]:
            continue
        full, commas = 0, 0
        for j in range(i, min(len(run), i + MOST_WORDS + 2)):
            if not usable[j]:
                break
            if j > i and text[run[j - 1].end()] == ",":
                commas += 1
            full += run[j][0][-1] != "."
            if full > MOST_WORDS or commas > 1 or (commas and j - i > 2):
                break
            if full and (run[j][0][-1] != "." or (commas and full == 1)):
                before = plain[i - 1] if i and text[run[i - 1].end() : run[i].start()] == " " else ""
                behind = plain[j + 1] if j + 1 < len(run) and text[run[j].end() : run[j + 1].start()] == " " else ""
                yield run[i].start(), run[j].end(), run[i : j + 1], before, behind


def _cjk_spans(text: str) -> Iterator[tuple[int, int]]:
    """Each sign of a family name with the next one and two, compound names also with the next three."""
    for run in CJK_RUN.finditer(text):
        begin, end = run.span()
        for i in range(begin, end - 1):
            if text[i : i + 2] in COMPOUND:
                yield from ((i, i + n) for n in (3, 4) if i + n <= end)
            elif text[i] in SURNAMES:
                yield from ((i, i + n) for n in (2, 3) if i + n <= end)


def candidates(text: str, names: Names) -> list[tuple[int, int, str, list[float]]]:
    """Overlapping spans with their kinds and features. All places are those of the given text."""
    same = text.translate(_WIDTH) if WIDE.search(text) else text
    latin = same if same.isascii() else CJK.sub("·", same)
    out = []
    emails = [m.span() for m in EMAIL.finditer(latin)] if "@" in latin or any(x in latin.lower() for x in WRITTEN_AT) else []
    spans = {(*m, "email") for m in emails}
    if DIGIT.search(latin):
        if FIVE_DIGITS.search(latin):
            spans |= {(m.start(), m.end(), "phone") for m in PHONE.finditer(latin) if sum(map(str.isdigit, m[0])) >= 7}
            spans |= {(m.start(), m.end(), "id") for m in IDENT.finditer(latin) if sum(map(str.isdigit, m[0])) >= 5}
        spans |= {(m.start(), m.end(), "address") for rx in ADDRESS for m in rx.finditer(latin)}
        if "號" in same or "号" in same:
            spans |= {(m.start(), m.end(), "address") for m in CJK_ADDRESS.finditer(same)}
    for begin, end, kind in sorted(spans):
        f = _context(same, begin, end, kind)
        (_number_features if kind in ("phone", "id") else _email_features if kind == "email" else _address_features)(f, same[begin:end], kind)
        out.append((begin, end, kind, f))
    for begin, end, words, before, behind in _latin_spans(latin):
        f = _context(same, begin, end, "name")
        f[AT["in_email"]] = float(any(b <= begin and end <= e for b, e in emails))
        _name_features(f, same, begin, end, words, before, behind, names)
        out.append((begin, end, "name", f))
    for begin, end in _cjk_spans(same) if latin is not same else ():
        f = _context(same, begin, end, "name")
        _cjk_features(f, same, begin, end, names)
        out.append((begin, end, "name", f))
    return out


def _context(text: str, begin: int, end: int, kind: str) -> list[float]:
    """What all kinds have: the span's signs and what stands beside it on the same line."""
    f, span = [0.0] * len(FEATURES), text[begin:end]
    left, right = text[begin - 1 : begin] or " ", text[end : end + 1] or " "
    f[AT[f"is_{kind}"]] = 1.0
    f[AT["length"]] = float(end - begin)
    f[AT["before_letter"]], f[AT["after_letter"]] = float(left.isalnum() and left < "一"), float(right.isalnum() and right < "一")
    f[AT["before_sign"]], f[AT["after_sign"]] = float(left in "#$€£-_.:=&/+@"), float(right in "-_=&/@%" or (right == ":" and text[end + 1 : end + 2].isdigit()))
    f[AT["before_cjk"]] = float("一" <= left < "龥")
    f[AT["line_start"]], f[AT["line_end"]] = float(begin == 0 or left == "\n"), float(end == len(text) or right == "\n")
    if kind != "name":
        digits = sum(map(str.isdigit, span))
        letters = sum(map(str.isalpha, span))
        f[AT["digits"]], f[AT["letters"]], f[AT["marks"]] = float(digits), float(letters), float(end - begin - digits - letters)
        line_start = text.rfind("\n", 0, begin) + 1
        before, after = text[max(line_start, begin - 28) : begin].lower(), text[end : end + 14].split("\n")[0].lower()
        f[AT["cue"]] = float(bool(CUES_OF[kind].search(f"{before}¦{after}")))
        if kind in ("phone", "id"):
            f[AT["anti"]] = float(bool(ANTI_RX.search(before[-16:] + span.lower()[:4])))
        f[AT["code"]] = float(bool(CODE.search(text[line_start : text.find("\n", end) if text.find("\n", end) >= 0 else len(text)])))
        f[AT["url"]] = float(bool(URL.search(text[max(0, begin - 60) : begin])))
    return f


def _number_features(f: list[float], span: str, kind: str) -> None:
    f[AT["plus"]], f[AT["zero"]], f[AT["brackets"]] = float(span[0] == "+"), float(span.lstrip("(+")[:1] == "0"), float("(" in span)
    groups = [len(g) for g in NUMBERS.findall(EXTENSION.sub("", span) if kind == "phone" else span)]
    f[AT["groups"]], f[AT["longest_group"]], f[AT["shortest_group"]] = float(len(groups)), float(max(groups)), float(min(groups))
    f[AT["date"]], f[AT["dotted_quad"]], f[AT["decimal"]] = float(bool(DATE.fullmatch(span))), float(bool(QUAD.fullmatch(span))), float(bool(DECIMAL.search(span)))
    f[AT["isbn"]], f[AT["shape_34"]], f[AT["shape_9"]] = float(span.startswith(("978", "979"))), float(bool(SHAPE_34.fullmatch(span))), float(bool(SHAPE_9.fullmatch(span)))
    f[AT["letter_end"]], f[AT["letter_start"]] = float(span[-1].isalpha()), float(len(LETTERS.match(span)[0]))
    f[AT["upper"]], f[AT["hex"]] = float(span.upper() == span), float(bool(HEX.fullmatch(span)) and not span.isdigit())


def _email_features(f: list[float], span: str, kind: str) -> None:
    f[AT["spaced_at"]], f[AT["word_at"]] = float(" @" in span or "@ " in span), float("@" not in span)
    labels = DOTS.split(AT_SIGN.split(span)[-1].strip())
    f[AT["labels"]], f[AT["alpha_tld"]], f[AT["digit_tld"]] = float(len(labels)), float(len(labels) > 1 and labels[-1].isalpha() and len(labels[-1]) > 1), float(labels[-1][:1].isdigit())


def _address_features(f: list[float], span: str, kind: str) -> None:
    f[AT["house"]], f[AT["unit"]], f[AT["cjk"]], f[AT["words"]] = float(bool(DIGIT.search(span))), float(bool(UNIT.search(span))), float(bool(CJK.search(span))), float(len(span.split()))


def _name_features(f: list[float], text: str, begin: int, end: int, words: list[re.Match], before: str, behind: str, names: Names) -> None:
    own = [_plain(m[0]) for m in words if m[0][-1] != "."]
    given, family = [w in names.given for w in own], [w in names.family for w in own]
    f[AT["words"]], f[AT["initial"]], f[AT["comma"]] = float(len(own)), float(len(own) < len(words)), float("," in text[begin:end])
    f[AT["given_first"]], f[AT["given_any"]], f[AT["given_last"]] = float(given[0]), float(sum(given)), float(given[-1])
    f[AT["family_last"]], f[AT["family_any"]] = float(family[-1]), float(sum(family))
    f[AT["upper"]], f[AT["ambiguous"]] = float(text[begin:end].isupper()), float(len(own) == 1 and own[0] in AMBIGUOUS)
    f[AT["title"]] = float(bool(TITLE_BEFORE.search(text, max(0, begin - 12), begin)))
    f[AT["cap_before"]], f[AT["cap_after"]] = float(bool(before)), float(bool(behind))
    left = BEFORE_WORD.search(text, max(0, begin - 24), begin)
    word = left[1].lower() if left else ""
    f[AT["relation"]], f[AT["to_people"]], f[AT["to_places"]] = float(word in RELATIONS), float(word in TO_PEOPLE), float(word in TO_PLACES)
    right = AFTER_WORD.match(text, end, end + 24)
    following = right[2] if right else ""
    f[AT["possessive"]], f[AT["lower_after"]], f[AT["by_people"]] = float(bool(right and right[1])), float(following[:1].islower()), float(following in BY_PEOPLE)
    f[AT["place_inside"]] = float(sum(w in PLACES for w in own))
    f[AT["place_after"]], f[AT["place_before"]] = float(following.lower() in PLACES), float(before in PLACES or word in PLACES)
    edge = text[max(0, begin - 3) : begin].rstrip(" \"'(")
    f[AT["sentence_start"]] = float(not edge or edge[-1] in ".!?;:\n。！？·")


def _cjk_features(f: list[float], text: str, begin: int, end: int, names: Names) -> None:
    compound = text[begin : begin + 2] in COMPOUND
    own = text[begin + (2 if compound else 1) : end]
    left, right = text[begin - 1 : begin], text[end : end + 1]
    f[AT["cjk"]], f[AT["words"]], f[AT["compound"]] = 1.0, float(len(own)), float(compound)
    f[AT["cjk_known"]] = sum(c in names.signs for c in own) / len(own)
    f[AT["cjk_before"]], f[AT["cjk_behind"]] = float(left in BEFORE_CJK), float(right in BEHIND_CJK)
    f[AT["cjk_edge"]] = float(not CJK.match(left)) + 2.0 * float(not CJK.match(right))
    f[AT["cjk_inner"]], f[AT["cjk_word"]] = float(bool(INNER_CJK.search(own))), float(text[begin : begin + 2] in names.words) + 2.0 * float(text[end - 1 : end + 1] in names.words)
    f[AT["title"]] = float(bool(TITLE_CJK.match(text, end)))


def best_spans(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Of overlapping spans the surest, of equally sure ones the longest."""
    taken: list[tuple[int, int, str]] = []
    for begin, end, kind, _ in sorted(spans, key=lambda s: (-round(s[3], 2), s[0] - s[1], s[0], s[2])):
        if all(end <= b or begin >= e for b, e, _ in taken):
            taken.append((begin, end, kind))
    return sorted(taken)


def _spread(batches: Iterator[pa.RecordBatch], names: Names, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Candidates of each text: its keys, places, kind and features. The last two columns are the text and its known words."""
    for batch in batches:
        texts, knowns = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        for first in range(0, len(texts), 512):
            owner, begins, ends, kinds, flat = [], [], [], [], []
            for row, (text, known) in enumerate(zip(texts[first : first + 512], knowns[first : first + 512]), first):
                here = names if known is None else Names(names.given | {w[1:] for w in known if w[0] == "g"}, names.family | {w[1:] for w in known if w[0] == "f"}, names.signs, names.words)
                for begin, end, kind, features in candidates(text, here):
                    owner.append(row), begins.append(begin), ends.append(end), kinds.append(kind)
                    flat += features
            offsets = pa.array(np.arange(len(owner) + 1, dtype=np.int32) * len(FEATURES))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.array(flat, np.float32)))
            keys = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(batch.num_columns - 2)]
            columns = [*keys, pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.string()), lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _made(batches: Iterator[pd.DataFrame], seed: int, names: Names) -> Iterator[pd.DataFrame]:
    """Candidates of the labelled examples."""
    for batch in batches:
        rows = []
        for number in batch["id"]:
            held, text, truth = example(int(number), seed)
            rows += [(held, kind, features, _right(begin, end, kind, truth)) for begin, end, kind, features in candidates(text, names)]
        yield pd.DataFrame(rows, columns=["held", "kind", "features", "label"])


class Redactor:
    """The fitted trees and the threshold of each kind."""

    def __init__(self, model: GBTClassificationModel, thresholds: dict[str, float], names: Names, listed: DataFrame | None = None):
        self.model, self.thresholds, self.names, self.listed = model, thresholds, names, listed

    @classmethod
    def fit(cls, spark: SparkSession, people: DataFrame | None = None, name: str = "name", texts: DataFrame | None = None, text: str = "text", seed: int = 11) -> Redactor:
        """Trees fitted on MOST_EXAMPLES texts made of four of five frames; thresholds from those of the fifth: for each kind, of
        those with the best balance of right and missed spans, the one nearest to one half. ``people`` is a table whose
        ``name`` column teaches given names, family names and the signs of Chinese given names; ``texts`` teaches which pairs
        of signs are words that only begin like names."""
        fixed = Names(common_given(), KNOWN_FAMILY, GIVEN_CJK, KNOWN_WORDS)
        made = spark.range(MOST_EXAMPLES).repartition(8).mapInPandas(lambda b: _made(b, seed, fixed), "held boolean, kind string, features array<float>, label double")
        made = cut_lineage(made)
        vectors = made.withColumn("vector", array_to_vector("features"))
        trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=20, maxDepth=6, stepSize=0.3, maxBins=32, seed=seed, cacheNodeIds=False)
        model = trees.fit(vectors.filter("not held").coalesce(2))
        scored = model.transform(vectors.filter("held")).select("kind", "label", vector_to_array("probability")[1].alias("p")).toPandas()
        thresholds = {kind: _threshold(scored[scored.kind == kind]) for kind in KINDS}
        given, family, signs, listed = frozenset(), frozenset(), fixed.signs, None
        if people is not None:
            signs |= {r["sign"] for r in _name_signs(people, name).collect()}  # not more than there are signs
            listed = cut_lineage(name_words(people, name))
            if listed.count() <= MOST_HANDED:
                handed = [r["word"] for r in listed.collect()]
                given, family = (frozenset(w[1:] for w in handed if w[0] == k) for k in "gf")
                listed = None
        words = frozenset(CWORDS)
        if texts is not None:
            words |= {r["word"] for r in common_words(texts, text, signs).collect()}  # pairs of a family name's sign and another
        return cls(model, thresholds, Names(fixed.given | given, family, signs, words), listed)

    def save(self, folder: str) -> None:
        """Trees, thresholds and lists, so that they need not be made again."""
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{folder}/trees")
        spark.createDataFrame(list(self.thresholds.items()), "kind string, threshold double").write.mode("overwrite").parquet(f"{folder}/thresholds")
        rows = [(kind, word) for kind, words in (("given", self.names.given), ("family", self.names.family), ("sign", self.names.signs), ("word", self.names.words)) for word in words]
        spark.createDataFrame(rows, "kind string, word string").write.mode("overwrite").parquet(f"{folder}/names")
        if self.listed is not None:
            self.listed.write.mode("overwrite").parquet(f"{folder}/listed")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Redactor:
        names = {"given": set(), "family": set(), "sign": set(), "word": set()}
        for row in spark.read.parquet(f"{folder}/names").collect():  # as many as are handed to the tasks
            names[row["kind"]].add(row["word"])
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/listed")
        listed = spark.read.parquet(f"{folder}/listed") if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
        thresholds = {r["kind"]: r["threshold"] for r in spark.read.parquet(f"{folder}/thresholds").collect()}
        return cls(GBTClassificationModel.load(f"{folder}/trees"), thresholds, Names(*(frozenset(names[k]) for k in ("given", "family", "sign", "word"))), listed)

    def _known(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Adds the listed words that occur in each text as ``_known``; null where all are handed to the tasks."""
        if self.listed is None:
            return rows.withColumn("_known", F.lit(None).cast("array<string>"))
        words = F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(r"(\p{Lu}[\p{L}'’-]*)"), 1), _plain_column))
        each = rows.select(*keys, F.explode(words).alias("_plain")).join(self.listed.withColumn("_plain", F.substring("word", 2, 1000)), "_plain")
        found = each.groupBy(*keys).agg(F.collect_set("word").alias("_known"))
        return rows.join(found, keys, "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>")))

    def spans(self, texts: DataFrame, keys: list[str], text: str) -> DataFrame:
        """``keys, begin, end, kind`` of the personal information in each text. ``keys`` must tell the texts apart. Null
        and empty texts give no rows; texts of any length are read whole; other columns are ignored."""
        kinds = "".join(f"`{k}` {texts.schema[k].dataType.simpleString()}, " for k in keys)
        names = self.names
        rows = self._known(texts.select(*keys, F.col(text).alias("_text")).filter(F.char_length("_text") > 0), keys)
        kinds += "_begin int, _end int, _kind string, _features array<float>"
        schema = to_arrow_schema(StructType.fromDDL(kinds))
        found = rows.mapInArrow(lambda b: _spread(b, names, schema), kinds)
        scored = self.model.transform(found.withColumn("vector", array_to_vector("_features")))
        sure = scored.select(*keys, "_begin", "_end", "_kind", vector_to_array("probability")[1].alias("_p"))
        enough = F.element_at(F.create_map(*(F.lit(x) for kv in self.thresholds.items() for x in kv)), F.col("_kind"))
        sure = sure.filter(F.col("_p") >= enough)
        pick = F.udf(lambda spans: best_spans([tuple(s) for s in spans]), "array<struct<begin:int,end:int,kind:string>>", useArrow=True)
        each = sure.groupBy(*keys).agg(pick(F.collect_list(F.struct("_begin", "_end", "_kind", "_p"))).alias("_spans"))
        return each.select(*keys, F.inline("_spans"))

    def redact(self, texts: DataFrame, keys: list[str], text: str) -> DataFrame:
        """``keys, text`` with typed placeholders, otherwise unchanged; texts without findings and null texts as they are."""
        spans = self.spans(texts, keys, text).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("begin", "end", "kind"))).alias("_spans"))
        joined = texts.select(*keys, F.col(text).alias("_text")).join(spans, keys, "left")
        put = F.udf(_put, "string", useArrow=True)
        return joined.select(*keys, F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(put("_text", "_spans")).alias("text"))


def _put(text: str, spans: list) -> str:
    if spans is None:
        return text
    out, at = [], 0
    for begin, end, kind in (tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in spans):
        out += [text[at:begin], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _right(begin: int, end: int, kind: str, truth: set[tuple[int, int, str]]) -> float:
    """1 for a span that is nearly one of the true ones."""
    return float(any(k == kind and min(end, e) - max(begin, b) >= 0.75 * (max(end, e) - min(begin, b)) for b, e, k in truth))


def _threshold(scored: pd.DataFrame) -> float:
    positives = scored.label.sum()
    if not positives:
        return 0.5
    best, chosen = -1.0, [0.5]
    for k in range(10, 91):
        hit = scored.p >= k / 100
        right = (hit & (scored.label == 1)).sum()
        score = 2 * right / (hit.sum() + positives)
        if score > best + 1e-9:
            best, chosen = score, []
        if score > best - 1e-9:
            chosen.append(k / 100)
    return min(chosen, key=lambda t: abs(t - 0.5))


def _plain_column(word: Column) -> Column:
    """What `_plain` gives."""
    return F.trim(F.translate(F.lower(word), *ACCENTS), F.lit("'\"().,"))


def name_words(people: DataFrame, name: str) -> DataFrame:
    """``word``: g and each word that begins names with SUPPORT last words or more, f and each that ends names with as many first words."""
    plain = _plain_column(F.col(name))
    parts = people.select(F.regexp_extract(plain, r"^(\p{L}[\p{L}'’-]+) (?:\p{L}\.? )?(\p{L}[\p{L}'’-]+)$", 1).alias("given"), F.regexp_extract(plain, r"^(\p{L}[\p{L}'’-]+) (?:\p{L}\.? )?(\p{L}[\p{L}'’-]+)$", 2).alias("family"))
    parts = parts.filter("given != '' and family != ''")
    often = [parts.groupBy(one).agg(F.countDistinct(other).alias("n")).filter(F.col("n") >= SUPPORT).select(F.concat(F.lit(one[0]), one).alias("word")) for one, other in (("given", "family"), ("family", "given"))]
    return often[0].unionByName(often[1])


def _name_signs(people: DataFrame, name: str) -> DataFrame:
    """``sign``: signs that stand behind the first in two Chinese names or more."""
    names = people.select(F.regexp_replace(name, "[ ·・]", "").alias("n")).filter(F.col("n").rlike("^[\u4e00-\u9fff]{2,4}$")).distinct()
    return names.select(F.explode(F.split(F.substring("n", 2, 3), "")).alias("sign")).groupBy("sign").count().filter("count > 1 and sign != ''").select("sign")


def common_words(texts: DataFrame, text: str, signs: frozenset[str]) -> DataFrame:
    """``word``: pairs of signs that begin like a Chinese name, but stand in the texts WORD_COUNT times or more and in no more
    than NAME_SHARE of these before a sign of given names."""
    runs = F.regexp_extract_all(text, F.lit("([一-鿿]{2,})"), 1)
    three = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, 3))))
    grams = texts.select(F.explode(F.filter(three, lambda g: F.substring(g, 1, 1).isin(*sorted(SURNAMES)))).alias("gram"))
    named = F.substring("gram", 3, 1).isin(*sorted(signs)).cast("int")
    each = grams.groupBy(F.substring("gram", 1, 2).alias("word")).agg(F.count("*").alias("n"), F.avg(named).alias("share"))
    return each.filter((F.col("n") >= WORD_COUNT) & (F.col("share") <= NAME_SHARE)).select("word")
