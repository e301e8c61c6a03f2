"""Long exact spans shared between records, by content-defined chunking.

A gear hash rolls over each text; its minima within any WINDOW places in a row are the cuts, so that cuts
depend only on the characters around them and an insertion moves none of the others. A chunk runs from each
cut to the first cut at least ``least_chunk`` characters later. Any common span of 300 characters holds a
whole chunk, with the same cuts in both texts; chunks are brought together by digest, and what is around
common ones is then compared character by character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkspur.session import cut_lineage

#: Characters that the gear hash looks back on, and places of which one is a cut.
GEAR, WINDOW = 16, 64
#: Characters that are handled at once in a task.
SLICE = 1 << 20
#: Chunks in more places than this are met by whole spans instead, with the same result (places, as repeats inside a text
#: multiply too).
HOT = 64
#: Lists of ids up to this size (8 bytes each) are handed to every task, longer ones joined by a shuffle.
MOST_BROADCAST = 200_000

#: Bases of the two digests; chunks have the first, whole spans both.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def least_chunk(span: int) -> int:
    """The longest minimum of a chunk with which every common span holds one: what is left of it after the characters
    up to its first cut, those from the minimum to the next cut, and the places that decide that cut."""
    return span - (GEAR - 1) - 3 * (WINDOW - 1) - 1


def _made_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, np.uint64(b), np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))


@lru_cache(2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(base, SLICE + (1 << 16))


def _mixed(points: np.ndarray) -> np.ndarray:
    x = (points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Digests:
    """Digests of any stretches of one array, from prefix sums."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        power, self.back = _powers(base) if len(values) < SLICE else _made_powers(base, len(values))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64)
        x ^= x >> np.uint64(31)
        return (x * np.uint64(0x94D049BB133111EB)).view(np.int64)


def cut_places(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All cuts of texts that lie one after the other, ``bounds`` being where they begin and end."""
    gear = values.copy()
    for k in (1, 2, 4, 8):  # after this each place has the gear hash of its last 16 characters
        gear[k:] += gear[:-k] << np.uint64(k)
    if len(values) < GEAR + WINDOW:
        return np.empty(0, np.int64)
    gear *= np.uint64(BASES[0])
    low = np.uint64((1 << 32) - 1)
    keys = (gear & ~low) | (np.uint64(len(values)) - np.arange(len(values), dtype=np.uint64))
    reach = 1
    while reach < WINDOW:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    begins = np.zeros(len(values) + 1, np.int8)
    sizes = np.diff(bounds)
    fits = sizes >= GEAR - 1 + WINDOW
    np.add.at(begins, bounds[:-1][fits] + GEAR - 1, 1)
    np.add.at(begins, bounds[1:][fits] - WINDOW + 1, -1)
    inside = np.cumsum(begins[: len(keys)], dtype=np.int8) > 0
    lows = (np.uint64(len(values)) - (keys[inside] & low)).astype(np.int64)
    return lows[np.concatenate([[True], lows[1:] != lows[:-1]])] if len(lows) else lows


def chunks(values: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of the texts: which text, begin and end."""
    cuts = cut_places(values, bounds)
    owner = np.searchsorted(bounds, cuts, side="right") - 1
    following = np.searchsorted(cuts, cuts + least)
    whole = following < len(cuts)
    whole[whole] = owner[following[whole]] == owner[whole]
    return owner[whole], cuts[whole], cuts[following[whole]]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, mixed characters and bounds of the batch's texts, about SLICE characters at once."""
    texts, first, size = batch.column(1).to_pylist(), 0, 0
    for k, text in enumerate([*texts, None]):
        if text is None or (size and size + len(text) > SLICE):
            some = texts[first:k]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield np.arange(first, k), _mixed(points), np.concatenate([[0], np.cumsum(lengths)])
            first, size = k, 0
        size += len(text or "")


def _chunk_rows(batches: Iterator[pa.RecordBatch], least: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, values, bounds in _slices(batch):
            owner, begin, end = chunks(values, bounds, least)
            base = bounds[:-1][owner]
            columns = [batch.column(0).take(pa.array(rows[owner])), pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), pa.array(Digests(values).of(begin, end))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _span_rows(batches: Iterator[pa.RecordBatch], span: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Digests of all whole spans around each given chunk: ``id, _begin, _digest, _more``."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            for rows, values, bounds in _slices(part):
                size = np.diff(bounds)
                begin, end = (part.column(k).to_numpy()[rows].astype(np.int64) for k in (2, 3))
                low, high = np.maximum(0, end - span), np.minimum(begin, size - span)
                count = np.maximum(0, high - low + 1)
                owner = np.repeat(np.arange(len(rows)), count)
                at = low[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
                digests = [pa.array(Digests(values, base).of(at + bounds[owner], at + bounds[owner] + span)) for base in BASES]
                columns = [part.column(0).take(pa.array(rows[owner])), pa.array(at.astype(np.int32)), *digests]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _grown(a_before: str, a_after: str, b_before: str, b_after: str) -> tuple[int, int]:
    """How many characters two texts have in common to the left and right of a common stretch."""
    left = next((k for k, (x, y) in enumerate(zip(reversed(a_before), reversed(b_before))) if x != y), min(len(a_before), len(b_before)))
    right = next((k for k, (x, y) in enumerate(zip(a_after, b_after)) if x != y), min(len(a_after), len(b_after)))
    return left, right


def _extension(a_before: pd.Series, a_after: pd.Series, b_before: pd.Series, b_after: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_grown(*x) for x in zip(a_before, a_after, b_before, b_after)], columns=["left", "right"])


def _in_arrow(rows: DataFrame, work: Callable, kinds: str) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(kinds))
    return rows.mapInArrow(lambda batches: work(batches, schema), kinds)


def _of_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with a list of ids, by broadcast where that is small."""
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, ids.columns[0], how)


def _unique_texts(records: DataFrame, key: str, text: str, span: int) -> tuple[DataFrame, DataFrame]:
    """Texts that can hold a span, each once under its smallest id, and which id stands for which others."""
    rows = records.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text")).filter(F.col("_id").isNotNull() & (F.char_length("_text") >= span))
    ids = rows.select("_id", F.unhex(F.md5("_text")).alias("_same"))
    same = ids.groupBy("_same").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    copies = same.filter("_first < _last")
    few = copies.count() <= MOST_BROADCAST
    members = cut_lineage(ids.join(F.broadcast(copies) if few else copies, "_same").select("_first", "_id").distinct())
    rest = members.filter("_id > _first").select("_id").distinct()
    return _of_ids(rows, rest, "left_anti"), members


def shared_spans(records: DataFrame, key: str, text: str, span: int = 300) -> tuple[DataFrame, DataFrame]:
    """Pairs of different texts with a common stretch of at least ``span`` characters, and the groups of copies.

    The first has ``a, b`` with a < b: ids of texts that stand for their copies. The second has ``_first, _id``: members
    of groups with the same text under the smallest id.

    ``key`` is an integer; rows without it, null, empty and shorter texts give nothing, repeated rows count
    once, an empty table gives no rows; other columns are ignored whatever their names.
    """
    found, members, places = _shared(records, key, text, span)
    return _pairs(found, places), members


def _pairs(found: DataFrame, places: DataFrame | None) -> DataFrame:
    pairs = found.select("a", "b")
    return (pairs if places is None else pairs.unionByName(_hot_pairs(places))).distinct()


def _shared(records: DataFrame, key: str, text: str, span: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Common stretches grown from chunks that stand in up to HOT places, as ``a, b, begin_a, begin_b, size`` (they may end
    ``span`` characters beside their chunks, if there are more of these), the groups of copies, and all places of
    common spans around the other chunks."""
    texts, members = _unique_texts(records, key, text, span)
    kinds = "_id bigint, _begin int, _end int, _digest bigint"
    least = least_chunk(span)
    if least < 1:
        raise ValueError("the span is too short for these chunks")
    all_chunks = cut_lineage(_in_arrow(texts, lambda b, schema: _chunk_rows(b, least, schema), kinds))
    shared = all_chunks.groupBy("_digest").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.count("*").alias("_n"))
    shared = cut_lineage(shared.filter("_lo < _hi").select("_digest", (F.col("_n") > HOT).alias("_hot")))
    cold = cut_lineage(_of_ids(all_chunks, shared.filter("not _hot").select("_digest"), "left_semi"))

    a, b = (cold.select("_digest", *(F.col(c).alias(f"{c}_{s}") for c in ("_id", "_begin", "_end"))) for s in "ab")
    pairs = a.join(b, "_digest").filter("_id_a < _id_b").select("_id_a", "_id_b", (F.col("_begin_a") - F.col("_begin_b")).alias("_shift"), "_begin_a", "_end_a").distinct()
    # chunks that touch on the same diagonal make one stretch
    along = Window.partitionBy("_id_a", "_id_b", "_shift").orderBy("_begin_a", "_end_a")
    reached = F.max("_end_a").over(along.rowsBetween(Window.unboundedPreceding, -1))
    pairs = pairs.withColumn("_new", (reached.isNull() | (F.col("_begin_a") > reached)).cast("int"))
    pairs = pairs.withColumn("_part", F.sum("_new").over(along))
    stretches = pairs.groupBy("_id_a", "_id_b", "_shift", "_part").agg(F.min("_begin_a").alias("_begin"), F.max("_end_a").alias("_end"))
    stretches = cut_lineage(stretches.drop("_part"))
    found = _grown_stretches(stretches, texts, span)

    hot = shared.filter("_hot").select("_digest")
    if hot.isEmpty():
        return found, members, None
    places = _hot_places(_of_ids(all_chunks, hot, "left_semi"), texts, span)
    return found, members, places


def _grown_stretches(stretches: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """The stretches with what the texts have in common beside them, those of at least ``span`` characters; stretches whose
    chunks only share a digest go."""
    needed = stretches.select(F.explode(F.array("_id_a", "_id_b")).alias("_id")).distinct()
    some = _of_ids(texts, needed, "left_semi")
    for s, shift in (("a", F.lit(0)), ("b", F.col("_shift"))):
        begin, end = F.col("_begin") - shift, F.col("_end") - shift
        low = F.greatest(F.lit(0), begin - span)
        stretches = stretches.join(some.select(F.col("_id").alias(f"_id_{s}"), "_text"), f"_id_{s}").withColumns(
            {
                f"_before_{s}": F.substring("_text", low + 1, begin - low), f"_after_{s}": F.substring("_text", end + 1, F.lit(span)),
                f"_inside_{s}": F.unhex(F.md5(F.substring("_text", begin + 1, end - begin))),
            }
        ).drop("_text")
    extension = F.pandas_udf(_extension, "left int, right int")
    grown = stretches.filter("_inside_a = _inside_b").withColumn("_by", extension("_before_a", "_after_a", "_before_b", "_after_b"))
    begin = F.col("_begin") - F.col("_by.left")
    out = grown.select(
        F.col("_id_a").alias("a"), F.col("_id_b").alias("b"), begin.alias("begin_a"), (begin - F.col("_shift")).alias("begin_b"),
        (F.col("_end") + F.col("_by.right") - begin).alias("size"),
    )
    return out.filter(F.col("size") >= span)


def _hot_places(chunk_rows: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """All places of whole spans around chunks that very many have which stand in more than one text: ``_digest, _more,
    _id, _begin``. The span's digests (128 bits) are the key, so that texts with nothing but the chunk in common never meet."""
    some = _of_ids(texts, chunk_rows.select("_id").distinct(), "left_semi")
    rows = chunk_rows.select("_id", "_begin", "_end").join(some, "_id").select("_id", "_text", "_begin", "_end")
    spans = _in_arrow(rows, lambda b, schema: _span_rows(b, span, schema), "_id bigint, _begin int, _digest bigint, _more bigint")
    spans = cut_lineage(spans.distinct())
    often = spans.groupBy("_digest", "_more").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).filter("_lo < _hi").select("_digest", "_more")
    return spans.join(often, ["_digest", "_more"], "left_semi")


def _hot_pairs(places: DataFrame) -> DataFrame:
    """Pairs of texts that share such a span. A long common ending holds hundreds of spans that all stand in the same
    texts: of spans whose texts are the same (by count and two sums of hashes) only one is paired."""
    each = cut_lineage(places.select("_digest", "_more", "_id").distinct())
    total = lambda seed: F.sum(F.xxhash64("_id", F.lit(seed)).cast("decimal(20,0)"))
    sets = each.groupBy("_digest", "_more").agg(F.count("*").alias("_n"), total(1).alias("_one"), total(2).alias("_two"))
    chosen = sets.groupBy("_n", "_one", "_two").agg(F.min(F.struct("_digest", "_more")).alias("_of")).select("_of._digest", "_of._more")
    kept = cut_lineage(each.join(chosen, ["_digest", "_more"], "left_semi"))
    a, b = (kept.select("_digest", "_more", F.col("_id").alias(s)) for s in "ab")
    return a.join(b, ["_digest", "_more"]).filter("a < b").select("a", "b").distinct()


def shared_pairs(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """All pairs of records, copies among them: ``{key}_a, {key}_b`` with the smaller first."""
    for s in "ab":
        own = members.select(F.col("_first").alias(s), F.col("_id").alias(f"_{s}"))
        pairs = pairs.join(own, s, "left").withColumn(f"_{s}", F.coalesce(f"_{s}", s))
    inside = members.select("_first", F.col("_id").alias("_a")).join(members.select("_first", F.col("_id").alias("_b")), "_first").filter("_a < _b")
    both = pairs.select("_a", "_b").unionByName(inside.select("_a", "_b"))
    return both.select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b")).distinct()


def _covered(found: DataFrame, hot: DataFrame | None, span: int) -> DataFrame:
    """``_id, n_shared``: characters of each text that also stand in another one."""
    places = found.select(F.explode(F.array(
        F.struct(F.col("a").alias("_id"), F.col("begin_a").alias("_begin"), (F.col("begin_a") + F.col("size")).alias("_end")),
        F.struct(F.col("b").alias("_id"), F.col("begin_b").alias("_begin"), (F.col("begin_b") + F.col("size")).alias("_end")),
    )).alias("_s")).select("_s.*")
    if hot is not None:  # with no pairing: every common span around a hot chunk counts wherever it stands
        places = places.unionByName(hot.select("_id", "_begin", (F.col("_begin") + span).alias("_end")))
    places = places.groupBy("_id", "_begin").agg(F.max("_end").alias("_end"))
    before = F.max("_end").over(Window.partitionBy("_id").orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("_end") - F.greatest(F.col("_begin"), F.coalesce(before, F.lit(0))))
    return places.withColumn("_fresh", fresh).groupBy("_id").agg(F.sum("_fresh").alias("n_shared"))


def shared_amounts(records: DataFrame, key: str, text: str, span: int = 300) -> DataFrame:
    """One row per text that shares something: ``key`` (the smallest of its copies), ``n_copies``, ``n_partners`` among
    different texts, and ``n_shared`` characters that also stand in another record (all, where there are copies)."""
    found, members, hot = _shared(records, key, text, span)
    found = cut_lineage(found)
    covered = _covered(found, hot, span)
    partners = _pairs(found, hot).select(F.explode(F.array("a", "b")).alias("_id")).groupBy("_id").agg(F.count("*").alias("n_partners"))
    copies = members.groupBy(F.col("_first").alias("_id")).agg((F.count("*") - 1).alias("n_copies"))
    sizes = records.select(F.col(key).cast("bigint").alias("_id"), F.char_length(text).cast("bigint").alias("_size")).groupBy("_id").agg(F.max("_size").alias("_size"))
    out = covered.join(partners, "_id").join(copies, "_id", "full").join(sizes, "_id")
    return out.select(
        F.col("_id").alias(key), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_partners", F.lit(0)).alias("n_partners"),
        F.when(F.col("n_copies") > 0, F.col("_size")).otherwise(F.col("n_shared")).alias("n_shared"),
    )


def document_amounts(records: DataFrame, key: str, text: str, span: int = 300) -> DataFrame:
    """One row per record that shares something, each copy among them: ``key``, ``n_partners``, all other records with a common
    stretch, copies on either side counted, and ``n_shared``, its characters that also stand in another record."""
    found, members, hot = _shared(records, key, text, span)
    found = cut_lineage(found)
    group = members.groupBy("_first").agg(F.count("*").alias("_n"))
    both = _pairs(found, hot).select(F.explode(F.array(F.struct(F.col("a").alias("_id"), F.col("b").alias("_first")), F.struct(F.col("b").alias("_id"), F.col("a").alias("_first")))).alias("_s")).select("_s.*")
    others = both.join(group, "_first", "left").groupBy("_id").agg(F.sum(F.coalesce("_n", F.lit(1))).alias("_others"))
    own = group.select(F.col("_first").alias("_id"), (F.col("_n") - 1).alias("_copies"))
    each = _covered(found, hot, span).join(others, "_id", "full").join(own, "_id", "full").withColumnRenamed("_id", "_first")
    sizes = records.select(F.col(key).cast("bigint").alias("_first"), F.char_length(text).cast("bigint").alias("_size")).groupBy("_first").agg(F.max("_size").alias("_size"))
    out = each.join(sizes, "_first").join(members, "_first", "left")
    return out.select(
        F.coalesce("_id", "_first").alias(key), (F.coalesce("_others", F.lit(0)) + F.coalesce("_copies", F.lit(0))).cast("bigint").alias("n_partners"),
        F.when(F.col("_copies") > 0, F.col("_size")).otherwise(F.col("n_shared")).cast("bigint").alias("n_shared"),
    )
