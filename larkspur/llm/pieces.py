"""Cutting oversized texts and files at natural boundaries, by ranges of bytes.

A text is looked at in ranges of some ten thousand bytes. Each range is handed out with a halo of the bytes
around it, so that a worker finds its boundaries alone; the small table of their numbers and lengths, without
any text, is then stitched: prefix sums of the characters place every piece in its text, and runs without a
boundary are joined across ranges. The pieces that were found are emitted at the places that this table gives.
No worker holds more of a file than a range and its halos.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.session import cut_lineage

LIMIT, OVERLAP, RANGE_BYTES = 1200, 120, 8 * 1200

#: What may end a piece, best first: a paragraph, a line, a sentence, white space.
BOUNDARIES = [re.compile(p) for p in (r"\n\s*\n", r"\n", r"[.!?](?=\s)|[。！？]", r"\s|[.!?]")]
#: A stretch without any of these can only be cut by force.
NATURAL = re.compile(r"[\s.!?。！？]")
#: Signs that stay with the one before them.
TAIL = re.compile("[\u0300-\u036f\u1ab0-᫿\u1dc0-\u1dff\u200d\u20d0-⃿\ufe00-\ufe0f\ufe20-\ufe2f\U0001f3fb-\U0001f3ff\U000e0100-\U000e01ef]")

RANGE = "_range int, _ranges int, _before binary, _body binary, _after binary"
PIECES = (
    "_range int, _chars bigint, _lead bigint, _inner bigint, _trail bigint, "
    "_pieces array<struct<start:bigint,end:bigint,text:string>>"
)


def best_cut(text: str, low: int, high: int) -> tuple[int, bool]:
    """The last boundary of the best kind in (low, high], or high itself, by force. Better kinds must lie in the
    upper half, so that pieces don't become small; True with a natural one."""
    for k, kind in enumerate(BOUNDARIES):
        begin = low if k == len(BOUNDARIES) - 1 else (low + high) // 2
        ends = [m.end() for m in kind.finditer(text, begin, high) if m.end() > low]
        if ends:
            return ends[-1], True
    if low < high < len(text):
        back = high
        while back > max(low + 1, high - 32) and (TAIL.match(text, back) or text[back - 1] == "\u200d"):
            back -= 1
        return back, False
    return high, False


def overlap_start(text: str, end: int, overlap: int) -> int:
    """Where the next piece begins: the last ``overlap`` characters or, up to a quarter less, from a word's start."""
    first = max(0, end - overlap)
    m = re.compile(r"\s+(?=\S)|[。！？](?=.)").search(text, first, first + overlap // 4)
    start = m.end() if m and m.end() < end else first
    while start < end and TAIL.match(text, start):
        start += 1
    return start


def range_pieces(before: str, body: str, after: str, first: bool, last: bool, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces of one range with their places relative to the body's start. The seams between ranges are cut at the
    best boundary before the range's edge, which both neighbours find alone from their halos."""
    text, edge = before + body + after, len(before)

    def seam(at: int) -> int:
        return best_cut(text, max(0, at - limit // 2), at)[0]

    begin = 0 if first else seam(edge)
    finish = len(text) if last else seam(edge + len(body))
    start = begin if first else overlap_start(text, begin, overlap)
    out, cut = [], begin
    while cut < finish:
        if finish - start <= limit:
            cut = finish
        else:
            cut, _ = best_cut(text, max(cut, start + overlap), start + limit)
        out.append((start - edge, cut - edge, text[start:cut]))
        start = overlap_start(text, cut, overlap)
    return out


def runs(text: str) -> tuple[int, int, int]:
    """Lengths of the stretch before the first natural boundary, the longest between two, the one after the last;
    all three the whole length where there is none."""
    at = [m.start() for m in NATURAL.finditer(text)]
    if not at:
        return len(text), len(text), len(text)
    inner = max((b - a - 1 for a, b in zip(at, at[1:])), default=0)
    return at[0], inner, len(text) - at[-1] - 1


def _aligned(raw: bytes, at: int) -> int:
    """The start of the character that byte ``at`` belongs to."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _halo(limit: int, overlap: int) -> int:
    """Bytes beside a range in which its seams and the pieces that begin there are found: a seam lies up to half a
    piece before the edge, and what it repeats before that."""
    return 4 * (limit // 2 + overlap + 64)


def _ranges_of_texts(batches: Iterator[pd.DataFrame], keys: list[str], range_bytes: int, halo: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for *key, text in batch.itertuples(index=False, name=None):
            raw = text.encode()
            edges = sorted({_aligned(raw, at) for at in range(0, len(raw), range_bytes)} | {len(raw)})
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                rows.append((*key, k, len(edges) - 1, raw[_aligned(raw, max(0, a - halo)) : a], raw[a:b], raw[b : _aligned(raw, b + halo)]))
                if len(rows) >= 256:
                    yield pd.DataFrame(rows, columns=[*keys, "_range", "_ranges", "_before", "_body", "_after"])
                    rows = []
        yield pd.DataFrame(rows, columns=[*keys, "_range", "_ranges", "_before", "_body", "_after"])


def _ranges_of_files(batches: Iterator[pd.DataFrame], range_bytes: int, halo: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, k, n, size in batch.itertuples(index=False, name=None):
            with open(path, "rb") as file:
                base = max(0, k * range_bytes - halo - 4)
                file.seek(base)
                raw = file.read(min(size, (k + 1) * range_bytes + halo + 4) - base)
            cut = [_aligned(raw, min(len(raw), at - base)) for at in (max(0, k * range_bytes - halo), k * range_bytes, (k + 1) * range_bytes, (k + 1) * range_bytes + halo)]
            if base:
                cut[0] = max(cut[0], _aligned(raw, 3))
            yield pd.DataFrame([(path, k, n, raw[cut[0] : cut[1]], raw[cut[1] : cut[2]], raw[cut[2] : cut[3]])], columns=["path", "_range", "_ranges", "_before", "_body", "_after"])


def _detect(batches: Iterator[pd.DataFrame], keys: list[str], limit: int, overlap: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for *key, k, n, before, body, after in batch.itertuples(index=False, name=None):
            left, text, right = (bytes(x).decode("utf-8", "replace") for x in (before, body, after))
            pieces = range_pieces(left, text, right, k == 0, k == n - 1, limit, overlap)
            rows.append((*key, k, len(text), *runs(text), [dict(zip(("start", "end", "text"), p)) for p in pieces]))
        yield pd.DataFrame(rows, columns=[*keys, "_range", "_chars", "_lead", "_inner", "_trail", "_pieces"])


def _stitched(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Of the table of ranges, which holds no text: the characters and pieces before each (prefix sums), and in ``_most``
    the text's longest stretch without a boundary, joined across whole ranges."""
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("_lead") == F.col("_chars")
    base = F.coalesce(F.sum("_chars").over(earlier), F.lit(0))
    ranges = ranges.withColumn("_base", base).withColumn("_count", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    opened = F.last(F.when(~whole, F.col("_base") + F.col("_chars") - F.col("_trail")), ignorenulls=True).over(earlier)
    joined = F.col("_base") + F.col("_lead") - F.coalesce(opened, F.lit(0))
    longest = F.max(F.greatest(joined, "_inner", "_trail")).over(Window.partitionBy(*keys))
    return ranges.select(*keys, "_range", "_base", "_count", longest.alias("_most"))


def _emitted(detected: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The pieces of all ranges at their places in the text."""
    detected = cut_lineage(detected)
    table = detected.select(*keys, "_range", "_chars", "_lead", "_inner", "_trail", F.size("_pieces").alias("_n"))
    placed = detected.select(*keys, "_range", "_pieces").join(_stitched(table, keys), [*keys, "_range"])
    return placed.select(*keys, "_base", "_count", "_most", F.posexplode("_pieces").alias("_pos", "_piece")).select(
        *keys,
        (F.col("_count") + F.col("_pos")).cast("bigint").alias("piece"),
        (F.col("_base") + F.col("_piece.start")).alias("start"),
        (F.col("_base") + F.col("_piece.end")).alias("end"),
        F.col("_piece.text").alias("text"),
        F.when(F.col("_most") > limit, "forced").otherwise("natural").alias("cut"),
    )


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def split_texts(items: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of the texts longer than ``limit`` code points: ``keys, piece, start, end, text, cut``.

    ``keys`` must tell the rows apart. Pieces are in order, have at most ``limit`` characters, end at the best
    boundary in reach and repeat the last ``overlap`` characters, or a little less, of the one before; their
    places are code points of the whole text. ``cut`` is ``forced`` if some stretch of more than ``limit``
    characters holds neither white space nor the end of a sentence. Null, empty and shorter texts give no
    rows; an empty table gives none; other columns are ignored whatever their names.
    """
    halo = _halo(limit, overlap)
    range_bytes = max(range_bytes, 8 * limit)
    long = items.select(*keys, F.col(text).alias("_text")).filter(F.char_length("_text") > limit)
    kinds = _kinds(items, keys)
    ranges = long.mapInPandas(lambda b: _ranges_of_texts(b, keys, range_bytes, halo), kinds + RANGE)
    return _emitted(ranges.mapInPandas(lambda b: _detect(b, keys, limit, overlap), kinds + PIECES), keys, limit)


def split_files(spark: SparkSession, folder: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 1 << 20) -> DataFrame:
    """The same for the UTF-8 files of a folder that all executors share; columns as above with ``path`` as key. Only
    names and sizes are listed first; each task opens a file at its range. Shorter files give no rows."""
    halo = _halo(limit, overlap)
    range_bytes = max(range_bytes, 8 * limit)
    listed = spark.read.format("binaryFile").load(folder).select("path", "length").filter(F.col("length") > limit)
    count = F.ceil(F.col("length") / range_bytes).cast("int")
    path = F.url_decode(F.regexp_replace(F.regexp_replace("path", r"\+", "%2B"), "^file:/*", "/"))
    rows = listed.select(path.alias("path"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k"), count.alias("n"), "length")
    rows = rows.repartition("path", "k")
    ranges = rows.mapInPandas(lambda b: _ranges_of_files(b, range_bytes, halo), "path string, " + RANGE)
    pieces = _emitted(ranges.mapInPandas(lambda b: _detect(b, ["path"], limit, overlap), "path string, " + PIECES), ["path"], limit)
    long = pieces.groupBy("path").agg(F.max("end").alias("_total")).filter(F.col("_total") > limit)
    return pieces.join(long.select("path"), "path", "left_semi")


def oversized(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """One row per split item with the kind of its cuts."""
    return pieces.groupBy(*keys).agg(F.max("end").alias("n_chars"), F.count("*").alias("n_pieces"), F.first("cut").alias("cut"))
