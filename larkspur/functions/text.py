"""Text functions as Column builders; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "\\u4e00-\\u9fff"
#: Shortest paragraph that becomes a chunk.
LEAST_PARAGRAPH = 25


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def stripped(text: Column) -> Column:
    """Without white space at both ends (Spark's trim removes spaces only unless told)."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


RUNS = f"([{HAN}]+|[a-zA-Z0-9]+)"


def run_tokens(run: Column) -> Column:
    """Tokens of one run of characters of the same kind."""
    n = F.char_length(run)
    ones = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, 1))
    twos = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, 2))).otherwise(empty_strings())
    return F.when(run.rlike(f"^[{HAN}]"), F.concat(ones, twos)).otherwise(F.array(F.lower(run)))


def tokens(text: Column) -> Column:
    """Runs of Han characters as single characters, then pairs; runs of ASCII letters and digits in lower case."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RUNS), 1), run_tokens))


def token_count(text: Column) -> Column:
    """How many tokens a text has, without making them: each Latin run is one, n Han characters in a row are 2 n - 1."""
    count = lambda rx: F.regexp_count(text, F.lit(rx))
    return count("[a-zA-Z0-9]+") + 2 * count(f"[{HAN}]") - count(f"[{HAN}]+")


def graph_terms(text: Column) -> Column:
    """Words of two characters or more and all pairs of characters of words, each once."""
    words = F.filter(F.split(text, r"\s+"), lambda w: F.char_length(w) >= 2)
    pairs = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 1), lambda i: F.substring(w, i, 2))))
    return F.array_distinct(F.concat(words, pairs))


def entity_terms(text: Column) -> Column:
    """Two Han characters or more, or a Latin word."""
    return F.regexp_extract_all(text, F.lit(rf"([{HAN}]{{2,}}|[a-zA-Z][a-zA-Z0-9_{HAN}-]+)"), 1)


def name_key(name: Column) -> Column:
    return F.translate(F.lower(name), "-_ ", "")


def snippet(text: Column, size: int = 200) -> Column:
    """What follows the first line."""
    return F.substring(F.substr(text, F.instr(text, "\n") + 1), 1, size)


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^_vault/", "")


# The domain of each top folder.
DOMAINS = {"10_Profile": "Polyhymnia", "20_AI_Chats": "Calliope", "30_Journal": "Clio", "40_Projects": "Terpsichore", "50_Knowledge": "Urania"}


def domain_of(path: Column) -> Column:
    out = F.lit("Unknown")
    for folder, domain in DOMAINS.items():
        out = F.when(path.startswith(folder), domain).otherwise(out)
    return out


def length_bucket(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n < 15, "short").when(n < 40, "medium").otherwise("long")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines without heading marks and rules, those of LEAST_PARAGRAPH characters or more."""

    def clean(block: Column) -> Column:
        return F.when(block.rlike(r"#|[-*_]{3}"), marked(block)).otherwise(stripped(block))

    def marked(block: Column) -> Column:
        block = F.regexp_replace(stripped(block), r"(?m)^#{1,6}\s+", "")
        return stripped(F.regexp_replace(block, r"(?m)^[-*_]{3,}$", ""))

    return F.filter(F.transform(F.split(text, "\n{2,}"), clean), lambda p: F.char_length(p) >= LEAST_PARAGRAPH)


def sections(text: Column) -> Column:
    """``title, body`` of the parts under second-level headings; what stands before the first is ``_default``."""
    parts = F.split(text, r"(?m)^##[ \t]+")
    first = F.array(F.struct(F.lit("_default").alias("title"), F.element_at(parts, 1).alias("body")))
    later = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
        lambda p: F.struct(stripped(F.substring_index(p, "\n", 1)).alias("title"), F.when(F.instr(p, "\n") > 0, F.substr(p, F.instr(p, "\n") + 1)).otherwise("").alias("body")),
    )
    return F.concat(first, later)


def wikilinks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1)


def summary_of(text: Column, size: int = 150) -> Column:
    """The first three lines of more than ten characters that are neither headings nor quotes."""
    lines = F.filter(F.split(text, "\n"), lambda s: ~s.startswith("#") & ~s.startswith(">") & (F.char_length(stripped(s)) > 10))
    return F.replace(F.substring(F.array_join(F.transform(F.slice(lines, 1, 3), stripped), " "), 1, size), F.lit('"'), F.lit("'"))


def short_uid(name: Column) -> Column:
    return F.substring(F.md5(name), 1, 12)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9_-]", "")


def filename_hints(stem: Column) -> Column:
    """Telling words of a file's name: no date in front, no single signs, hashes or numbers."""
    rest = F.regexp_replace(stem, r"^\d{6,8}", "")
    return F.filter(F.split(rest, r"[_\-\s]+"), lambda w: (F.char_length(w) >= 2) & ~w.rlike("^[0-9a-f]{8,}$") & ~w.rlike(r"^\d+$"))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def chunk_prefix(kind: Column, date: Column, tags: Column, hints: Column, locations: Column, themes: Column, period: Column, title: Column, enriched: Column) -> Column:
    """The metadata in front of a chunk: kind, date, four tags, file name; once enriched also places, themes, period."""
    part = lambda lead, items, n: F.when(F.size(F.coalesce(items, empty_strings())) > 0, F.concat(F.lit(lead), F.array_join(F.slice(items, 1, n), ","), F.lit("]"))).otherwise("")
    base = F.concat(F.lit("["), F.coalesce(kind, F.lit("note")), F.lit("]["), F.substring(F.coalesce(date, F.lit("")), 1, 10), F.lit("]"), part("[", tags, 4), part("[file:", hints, 100))
    rich = F.concat(part("[loc:", locations, 5), part("[theme:", themes, 3), F.when(F.coalesce(period, F.lit("")) != "", F.concat(F.lit("[period:"), period, F.lit("]"))).otherwise(""))
    return F.concat(base, F.when(enriched, rich).otherwise(""), F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" "), title, F.lit(":"))).otherwise(""))


# Words that give a text a tag.
TAG_WORDS = {
    "career": ["work", "interview", "salary", "工作", "面試", "求職"], "travel": ["travel", "flight", "station", "旅行", "機場", "行程"], "tech": ["python", "docker", "sql", "code", "程式"],
    "home": ["kitchen", "garden", "cottage", "廚房", "花園"], "music": ["guitar", "violin", "music", "吉他", "音樂"], "reflection": ["pride", "grief", "gratitude", "反思", "成長"],
}


def inferred_tags(text: Column, most: int = 5) -> Column:
    low = F.lower(text)

    def hit(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    return F.slice(F.array_compact(F.array(*(F.when(hit(words), tag) for tag, words in TAG_WORDS.items()))), 1, most)


# What a request is about, tried in this order.
INTENTS = {
    "READ-TEMPORAL": r"as of|before the|during the|in 20|那段時期|那年|那時|時間軸|歷年|\b(19|20)\d{2}",
    "WRITE-CORRECT": r"記錯了|應該是|改成|取消那個|wrong|correct me|remove that fact|that's not right|打錯了",
    "WRITE-INGEST": r"記一下|log this|幫我存|save this memory",
    "READ-RECALL": r"我上次|我之前|還記得|什麼時候|when did i|what did i say|remind me|last time|who did i|我有沒有",
}


def intents(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(rx), name) for name, rx in INTENTS.items())))


def is_complex(query: Column, least: int = 15) -> Column:
    """Whether a query is worth taking apart: long, with a connective, or of three terms or more."""
    q = stripped(query)
    return (F.char_length(q) >= least) | q.rlike("[，、和與跟還有,&]| and | or | with | about ") | (F.size(entity_terms(q)) >= 3)


def high_risk(before: Column, after: Column) -> Column:
    """An edit that touches much: long, over several lines, or changing the length a lot."""
    lines = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit("")))
    return (F.char_length(before) > 120) | (lines >= 2) | (F.abs(F.char_length(after) - F.char_length(before)) > 200)


def replace_unique(body: Column, old: Column, new: Column) -> Column:
    """The body with ``old`` replaced where it occurs exactly once, else null."""
    count = (F.char_length(body) - F.char_length(F.replace(body, old, F.lit("")))) / F.char_length(old)
    return F.when((F.char_length(old) > 0) & (count == 1), F.replace(body, old, new))


def json_object(text: Column) -> Column:
    """The outermost object in noisy text, trailing commas and single quotes mended; null where there is none."""
    begin, end = F.instr(text, "{"), F.char_length(text) - F.instr(F.reverse(text), "}") + 1
    body = F.when((begin > 0) & (F.instr(text, "}") > 0) & (end > begin), F.substring(text, begin, end - begin + 1))
    mended = F.regexp_replace(F.when(body.contains('"'), body).otherwise(F.translate(body, "'", '"')), r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(mended).isNotNull(), mended)


def fit_array(items: Column, size: int, fill: str = "") -> Column:
    """Cut or padded to ``size`` entries."""
    return F.slice(F.concat(F.coalesce(items, empty_strings()), F.array_repeat(F.lit(fill), size)), 1, size)


def document_format(path: Column, text: Column, kind: Column) -> Column:
    """pages, gemini, knowledge, journal or unknown, by suffix, marks in the text, name and type."""
    # Marks of exported chats.
    marks = r"備份時間：|## 對話記錄|\*\*你\*\*\s*\n|\*\*Gemini\*\*\s*\n"
    return (
        F.when(F.lower(path).endswith(".pages"), "pages")
        .when(~F.lower(path).rlike(r"\.(md|txt)$"), "unknown")
        .when(text.rlike(marks) | path.rlike(r"_[0-9a-f]{8,16}\.md$"), "gemini")
        .when(text.startswith("---") & F.lower(kind).isin("knowledge", "知識"), "knowledge")
        .otherwise("journal")
    )
