"""Evaluation passages inside a corpus, found by spaced seeds.

Texts are reduced to their letters and digits, regardless of case. A seed is a fixed mask over a window of
characters that ignores some of them; hashes of all windows of the passages are joined with those of all windows
of the corpus. Where only exact runs count, every n-th window of the corpus does, n being small enough that no
run of the wanted length slips through. Documents with hits are kept whole; each diagonal on which they meet a passage
is then measured from end to end, exactly and with substitutions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkspur.session import cut_lineage

#: Fixed masks over windows of 24 characters: 1 is hashed, 0 ignored. With all windows looked up they find any 40
#: characters with 1 substitution, 52 with 2 and 60 with 3, wherever those are.
MASKS = ("111011011101101110110111", "110111100111101101111011")
SPAN = len(MASKS[0])
#: Characters whose windows are hashed at once in a task.
SLICE = 1 << 18
#: So many hashes of passages (8 bytes each) are handed to every task at once.
MOST_BROADCAST = 4_000_000
#: How many substitutions in a row and in any 20 characters an overlap may have.
GAP, DENSITY = 3, 0.15


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter or digit, and its small letter."""
    points = [chr(p) for p in range(0x110000)]
    kept = np.fromiter((c.isalnum() for c in points), bool, len(points))
    small = np.fromiter((ord(s) if len(s := c.lower()) == 1 else ord(c) for c in points), np.int32, len(points))
    return kept, small


@lru_cache(1)
def _weights() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 62, SPAN, dtype=np.uint64) | np.uint64(1)


def reduced(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The small letters and digits of all texts in a row, and where each text begins and ends in it."""
    kept, small = _tables()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    use = kept[points]
    counted = np.concatenate([[0], np.cumsum(use)])
    return small[points[use]], counted[np.concatenate([[0], np.cumsum(lengths)])]


def seed_hashes(letters: np.ndarray, at: np.ndarray | None, mask: int) -> np.ndarray:
    """Hashes of the windows that begin at ``at``, or of all, by one mask."""
    n = max(0, len(letters) - SPAN + 1) if at is None else len(at)
    out = np.full(n, mask + 1, np.uint64)
    for k, bit in enumerate(MASKS[mask]):
        if bit == "1":
            out += ((letters[k : k + n] if at is None else letters[at + k]).astype(np.uint64) + np.uint64(0x9E3779B9)) * _weights()[k]
            out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def windows(bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of every ``step``-th whole window of each text, counted from the text's start, and the texts."""
    size = np.diff(bounds)
    count = np.maximum(0, (size - SPAN) // step + 1)
    owner = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(count) - count
    return bounds[:-1][owner] + (np.arange(len(owner)) - first[owner]) * step, owner


def _test_seeds(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """All windows of the passages: ``item, _hash, _at`` (a place in the reduced passage)."""
    for batch in batches:
        letters, bounds = reduced(batch.column(1).to_pylist())
        at, owner = windows(bounds, 1)
        for mask in range(len(MASKS)):
            columns = [batch.column(0).take(pa.array(owner)), pa.array(seed_hashes(letters, at, mask)), pa.array(at - bounds[:-1][owner])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _reduced(texts: pd.Series) -> pd.Series:
    letters, bounds = reduced(texts.tolist())
    whole = letters.astype("<i4").tobytes().decode("utf-32-le", "surrogatepass")
    return pd.Series([whole[a:b] for a, b in zip(bounds, bounds[1:])])


def _hits(batches: Iterator[pa.RecordBatch], step: int, wanted: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Texts of the corpus with windows whose hashes are wanted: ``key, _letters, _found`` with all those windows."""
    sieve = _sieve(wanted)
    for batch in batches:
        letters, bounds = reduced(batch.column(1).to_pylist())
        found = [x for mask in range(len(MASKS)) for x in _wanted_windows(letters, bounds, step, mask, wanted, sieve)]
        at, owner, hashes = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in range(3))
        order = np.argsort(owner, kind="stable")
        at, owner, hashes = at[order], owner[order], hashes[order]
        texts, begins = np.unique(owner, return_index=True)
        for text, begin, end in zip(texts.tolist(), begins.tolist(), [*begins[1:].tolist(), len(owner)]):
            first, last = bounds[text], bounds[text + 1]
            whole = letters[first:last].astype("<i4").tobytes().decode("utf-32-le", "surrogatepass")
            windows_found = pa.StructArray.from_arrays([pa.array(hashes[begin:end]), pa.array(at[begin:end] - first)], fields=list(schema.field(2).type.value_type))
            lists = pa.ListArray.from_arrays(pa.array([0, end - begin], pa.int32()), windows_found).cast(schema.field(2).type)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(text, 1), pa.array([whole], pa.string()), lists], schema=schema)


def _wanted_windows(letters: np.ndarray, bounds: np.ndarray, step: int, mask: int, wanted: np.ndarray, sieve: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, texts and hashes of every ``step``-th window with a wanted hash."""
    if step > 1:
        at, owner = windows(bounds, step)
        hashes = seed_hashes(letters, at, mask)
        hit = np.flatnonzero(_among(hashes, wanted, sieve))
        yield at[hit], owner[hit], hashes[hit]
        return
    for first in range(0, len(letters) - SPAN + 1, SLICE):
        hashes = seed_hashes(letters[first : first + SLICE + SPAN - 1], None, mask)
        hit = np.flatnonzero(_among(hashes, wanted, sieve))
        at = first + hit
        owner = np.searchsorted(bounds, at, side="right") - 1
        whole = at + SPAN <= bounds[owner + 1]
        yield at[whole], owner[whole], hashes[hit][whole]


def _sieve(wanted: np.ndarray) -> np.ndarray:
    """Which first bits the wanted hashes have."""
    out = np.zeros(1 << min(26, max(10, len(wanted).bit_length() + 4)), bool)
    out[_first_bits(wanted, out)] = True
    return out


def _first_bits(hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(65 - len(sieve).bit_length())).view(np.int64)


def _among(hashes: np.ndarray, wanted: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    out = sieve[_first_bits(hashes, sieve)]
    if len(wanted):
        some = hashes[out]
        out[out] = wanted[np.minimum(np.searchsorted(wanted, some), len(wanted) - 1)] == some
    return out


def _reach(differ: np.ndarray, n: int) -> tuple[int, int]:
    """How far two texts of ``n`` characters agree from their start on, with substitutions at the places ``differ``, and
    how many of those are within that reach: fewer than GAP in a row, and no more than two or DENSITY of what was passed."""
    ends = np.append(differ[1:], n)
    used = np.arange(1, len(differ) + 1)
    reach = np.concatenate([[differ[0] if len(differ) else n], ends])
    last_good = np.maximum.accumulate(np.where(np.concatenate([[True], ends > differ + 1]), reach, 0))
    stop = (differ - last_good[:-1] >= GAP) | (used > np.maximum(2, DENSITY * (ends + 1)))
    stopped = int(np.argmax(stop)) if stop.any() else len(differ)
    good = np.flatnonzero(np.concatenate([[True], ends > differ + 1])[: stopped + 1])[-1]
    return int(reach[good]), int(good)


def measured(doc: np.ndarray, item: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int]]:
    """Along one diagonal, both texts from its start on: longest exact run, and from the first window of ``hits`` that no
    overlap covers yet on to both sides the length with substitutions and their number, for each overlap."""
    n = min(len(doc), len(item))
    differ = np.flatnonzero(doc[:n] != item[:n])
    exact = int(np.diff(np.concatenate([[-1], differ, [n]])).max()) - 1
    out, covered = [], 0
    for hit in np.sort(hits).tolist():
        if hit + SPAN <= covered:
            continue
        left, wrong_left = _reach(hit - 1 - differ[differ < hit][::-1], hit)
        after = hit + SPAN
        right, wrong_right = _reach(differ[differ >= after] - after, n - after)
        inside = int(((differ >= hit) & (differ < after)).sum())
        covered = after + right
        out.append((exact, left + SPAN + right, wrong_left + inside + wrong_right))
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def _measure(batches: Iterator[pd.DataFrame], key: str, item: str) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for k, i, text, whole, shift, hits in zip(b[key], b[item], b._letters, b._whole, b._shift, b._hits):
            doc, own = _points(text[max(0, shift) :]), _points(whole[max(0, -shift) :])
            rows += [(k, i, *found) for found in measured(doc, own, np.asarray(hits) - max(0, shift))]
        yield pd.DataFrame(rows, columns=[key, item, "exact", "overlap", "substitutions"])


def find_leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, least: int = 40, tolerant: bool = True) -> DataFrame:
    """Rows ``key, item, exact, overlap, substitutions``: per pair of document and item the longest exact run of letters
    and digits on the diagonals of their common seeds and the longest overlap with substitutions, both of any length.
    Every pair with ``least`` letters or digits in a row is among them and, where ``tolerant``, every pair
    with a window in common by one of the masks (see there what they guarantee), however it lies in the document.

    ``least`` must be at least SPAN. Null, empty and short texts or passages give no rows; a document or item
    that comes in several rows comes out once per key; empty tables give no rows; other columns are ignored
    whatever their names. Every task gets the hashes of up to MOST_BROADCAST seeds; of more, the corpus is read
    once for each block of that size.
    """
    if least < SPAN:
        raise ValueError(f"least must be at least {SPAN}")
    step = 1 if tolerant else least - SPAN + 1
    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((corpus, key), (items, item))}

    passages = items.select(F.col(item), F.col(passage).alias("_text")).filter(F.char_length("_text") >= SPAN)
    test = cut_lineage(_in_arrow(passages, _test_seeds, f"`{item}` {kind[item]}, _hash bigint, _at bigint").distinct())
    whole = passages.select(item, F.pandas_udf(_reduced, "string")("_text").alias("_whole")).dropDuplicates([item])
    texts = corpus.select(F.col(key), F.col(text).alias("_text")).filter(F.char_length("_text") >= SPAN)

    hashes = test.select("_hash").distinct()
    blocks = max(1, math.ceil(hashes.count() / MOST_BROADCAST))
    touched = None
    for block in range(blocks):
        own = hashes.filter(F.pmod("_hash", F.lit(blocks)) == block).toPandas()["_hash"]
        wanted = np.sort(own.to_numpy(np.int64))
        some = _in_arrow(
            texts, lambda b, schema, w=wanted: _hits(b, step, w, schema),
            f"`{key}` {kind[key]}, _letters string, _found array<struct<_hash:bigint,_place:bigint>>",
        )
        touched = some if touched is None else touched.unionByName(some)
    touched = cut_lineage(touched.withColumn("_row", F.monotonically_increasing_id()))
    met = touched.select("_row", F.inline("_found")).join(test, "_hash")
    diagonals = met.groupBy("_row", item, (F.col("_place") - F.col("_at")).alias("_shift")).agg(F.collect_set("_place").alias("_hits"))
    both = diagonals.join(touched.select(key, "_letters", "_row"), "_row").join(whole, item).select(key, item, "_letters", "_whole", "_shift", "_hits")
    out = f"`{key}` {kind[key]}, `{item}` {kind[item]}, exact bigint, overlap bigint, substitutions bigint"
    found = both.mapInPandas(lambda b: _measure(b, key, item), out)
    best = F.max(F.struct(F.col("overlap"), (-F.col("substitutions")).alias("same")))
    return found.groupBy(key, item).agg(F.max("exact").alias("exact"), best.alias("_best")).select(
        key, item, "exact", F.col("_best.overlap").alias("overlap"), (-F.col("_best.same")).alias("substitutions")
    )


def _in_arrow(rows: DataFrame, work: Callable, kinds: str) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(kinds))
    return rows.mapInArrow(lambda batches: work(batches, schema), kinds)
