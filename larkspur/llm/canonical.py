"""One consistent form for text that looks the same but differs in its characters.

A quick check finds the characters whose form may change; only the stretches around them, widened to the
next safe boundary, are normalised and spliced back into the unchanged rest. Spark's own regular
expressions apply the check to whole entries first, so clean entries never leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets that look like a Latin letter.
CYRILLIC_LIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "к": "k",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
}
GREEK_LIKE = {
    "ο": "o", "ν": "v", "α": "a", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "γ": "y", "χ": "x", "τ": "t", "ε": "e",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
}
TO_LATIN = {"CYRILLIC": CYRILLIC_LIKE, "GREEK": GREEK_LIKE}
FROM_LATIN = {s: {v: k for k, v in reversed(table.items())} for s, table in TO_LATIN.items()}

# Signs without a look of their own.
INVISIBLE = (
    "\u00ad\u034f\u061c\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff"
    "\ufff9-\ufffb\U000e0000-\U000e0fff\u0000-\u0008\u000e-\u001b\u007f-\u0084\u0086-\u009f"
)
SPACES = "\t-\r\u001c-\u001f \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\ufe63\uff0d"
#: Their ordinary forms are wider, narrower or joined letters, digits, kana and ideographs.
OTHER_WIDTH = "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff65-\uffdc\ufb00-\ufb06\ufb13-\ufb17\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\u2e80-\u2fd5"
JOINERS = "\u200c\u200d"


def _ranges(points: list[int]) -> str:
    out, begin = [], None
    for p, following in zip(points, [*points[1:], None]):
        begin = p if begin is None else begin
        if following != p + 1:
            out.append((begin, p))
            begin = None
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


def _unstable() -> str:
    """Characters that canonical composition may change, alone or with what stands before them."""
    nfc = [
        p for p in range(0xA0, 0x30000)
        if not 0xAC00 <= p < 0xD7A4 and not 0xD800 <= p < 0xE000
        and (unicodedata.combining(c := chr(p)) or unicodedata.category(c)[0] == "M" or unicodedata.normalize("NFC", c) != c)
    ]
    return _ranges(nfc) + "\u1100-\u11ff\ua960-\ua97c\ud7b0-\ud7ff"


ALPHABETS = "\u0370-\u052f\u1c80-\u1c88\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f"
UNSTABLE = _unstable() + INVISIBLE + HYPHENS + OTHER_WIDTH + ALPHABETS + SPACES.replace("\u001f ", "\u001f")
QUICK_CHECK = re.compile(f"[{UNSTABLE}]|  |^ | $")

_INVISIBLE, _SPACES, _HYPHENS = re.compile(f"[{INVISIBLE}]"), re.compile(f"[{SPACES}]+"), re.compile(f"[{HYPHENS}]")
_OTHER_WIDTH = re.compile(f"[{OTHER_WIDTH}]")
_LETTERS = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")


def _java(pattern: str) -> str:
    """The pattern with code points written out, as Java reads it."""
    return "".join(c if c in "[]|^$-\\" or " " <= c < "\x7f" else f"\\x{{{ord(c):x}}}" for c in pattern)


def needs_work(text: Column) -> Column:
    """True where the quick check finds anything; runs inside the JVM."""
    return text.rlike(_java(QUICK_CHECK.pattern))


def _pictograph(c: str) -> bool:
    return bool(c) and (unicodedata.category(c) in ("So", "Sk") or 0x1F000 <= ord(c) < 0x1FB00 or c in "\ufe0f\u20e3#*")


def _joins_script(c: str) -> bool:
    """Arabic and Indic letters change their look beside a joiner."""
    return bool(c) and (0x600 <= ord(c) < 0x8C0 or 0x900 <= ord(c) < 0xE00 or 0x1780 <= ord(c) < 0x18B0 or 0xFB50 <= ord(c) < 0xFE00)


def _visible(text: str) -> str:
    """The text without invisible signs, but for those that change its look."""

    def keep(m: re.Match) -> str:
        c, left, right = m[0], text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]
        if c == "\u200d" and _pictograph(left) and _pictograph(right):
            return c
        if c in JOINERS and _joins_script(left) and _joins_script(right):
            return c
        if c in "\ufe0e\ufe0f" and left and (_pictograph(left) or left.isdigit() or left in "\u00a9\u00ae\u203c\u2049\u3030\u303d"):
            return c
        if ("\ufe00" <= c <= "\ufe0d" or "\U000e0100" <= c <= "\U000e01ef") and left >= "\u2e80":
            return c
        if "\U000e0020" <= c <= "\U000e007f" and "\U0001f3f4" in text[: m.start()]:
            return c
        return ""

    return _INVISIBLE.sub(keep, text)


@lru_cache(100_000)
def _alphabet(letter: str) -> str:
    name = unicodedata.name(letter, "").split(" ")[0]
    return name if name in ("LATIN", "CYRILLIC", "GREEK") else ""


def _one_alphabet(m: re.Match) -> str:
    """A word in the alphabet of most of its letters, of those alphabets that have a look for all of them."""
    word = unicodedata.normalize("NFD", m[0])
    kinds = [_alphabet(c) for c in word if not unicodedata.combining(c)]
    used = {k for k in kinds if k}
    if len(used) < 2:
        return m[0]

    def whole(alphabet: str) -> bool:
        return all(_alphabet(c) in ("", alphabet) or _turned(c, alphabet) for c in word)

    best = max(sorted(used), key=lambda k: (whole(k), kinds.count(k), k == "LATIN"))
    turned = "".join(c if _alphabet(c) in ("", best) else _turned(c, best) or c for c in word)
    return unicodedata.normalize("NFC", turned)


def _turned(letter: str, alphabet: str) -> str | None:
    """The letter's look-alike in another alphabet."""
    kind = _alphabet(letter)
    latin = letter if kind == "LATIN" else TO_LATIN[kind].get(letter)
    return latin if alphabet == "LATIN" else FROM_LATIN[alphabet].get(latin)


def _segment(text: str) -> str:
    text = _visible(text)
    text = _SPACES.sub(" ", _HYPHENS.sub("-", text))
    text = _OTHER_WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return _LETTERS.sub(_one_alphabet, unicodedata.normalize("NFC", text))


_SAFE = re.compile(r"[!-,./:-@\[-`{-~\-]")  # ASCII signs, among them the hyphen and the underscore


@lru_cache(200_000)
def plain_form(text: str) -> str:
    """The one form of a text. Each unstable stretch is widened to the next ASCII signs on both sides, which no
    normalisation crosses, and replaced by its normal form."""
    if not (m := QUICK_CHECK.search(text)):
        return text
    out, done = [], 0
    while m:
        begin = m.start()
        while begin > done and not _SAFE.match(text[begin - 1]):
            begin -= 1
        end = m.end()
        while end < len(text) and not _SAFE.match(text[end]):
            end += 1
        out += [text[done:begin], _segment(text[begin:end])]
        done = end
        m = QUICK_CHECK.search(text, done)
    # a removed stretch may leave spaces side by side or at the ends
    return re.sub(" {2,}", " ", "".join([*out, text[done:]])).strip(" ")


def _plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for entries in batches:
        yield entries.map(plain_form)


def canonical_column(text: Column) -> Column:
    """``text`` in its plain form: composed, of ordinary width, without invisible signs, with single spaces, each
    word in one alphabet. Case and signs that look different stay. Null stays null, an entry of nothing but
    blank or invisible signs becomes empty; texts of any length are taken whole."""
    udf = F.pandas_udf(_plain, "string")
    return F.when(needs_work(text), udf(F.when(needs_work(text), text).otherwise(""))).otherwise(text)


def changed_entries(entries: DataFrame, keys: list[str], entry: str) -> DataFrame:
    """``keys`` and ``plain`` of each entry that isn't stored in its plain form, once. Null entries, clean ones and
    repeated rows give none; other columns are ignored whatever their names."""
    rows = entries.select(*keys, F.col(entry).alias("_entry")).filter(needs_work(F.col("_entry"))).distinct()
    rows = rows.select(*keys, "_entry", F.pandas_udf(_plain, "string")("_entry").alias("plain"))
    return rows.filter(F.col("_entry") != F.col("plain")).select(*keys, "plain").distinct()
