"""Encoding of whole texts with a public byte-level BPE vocabulary.

Spark cuts the texts into words with the vocabulary's pattern; inside each task the distinct words of a
batch are merged with a segment tree over the ranks of adjacent pairs, many words side by side, and the
ids are put together again by position. Nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode's White_Space, which Java's \\s is not.
SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How this vocabulary's text is cut into words before any merge.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Words with more bytes are merged one by one, shorter ones side by side.
SIDE_BY_SIDE = 512
#: Leaves of the trees that are merged side by side at once.
LEAVES = 1 << 19
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 200_000

NEVER = np.iinfo(np.int64).max


class Merges:
    """The vocabulary as arrays: ids of the bytes, and the sorted pairs with their ranks."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 for those that never merge."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], -1)


def merge_side_by_side(words: list[bytes], m: Merges) -> list[np.ndarray]:
    """Ids of words of similar length. Row w of ``tree`` is the segment tree of word w: leaf i holds the rank
    of the pair that begins at token i, joined with i, so that the root is the leftmost pair of lowest rank."""
    n = len(words)
    width = 1 << max(1, max(map(len, words)) - 1).bit_length()
    lengths = np.fromiter(map(len, words), np.int64, n)
    column = np.arange(width)
    inside = column < lengths[:, None]
    token = np.zeros((n, width + 1), np.int64)
    token[:, :width][inside] = m.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    after = np.tile(np.arange(1, width + 2), (n, 1))
    before = np.tile(np.arange(-1, width), (n, 1))
    alive = inside.copy()
    tree = np.full((n, 2 * width), NEVER)
    pair = column < lengths[:, None] - 1
    ranks = m.rank(token[:, :width][pair], token[:, 1:][pair])
    tree[:, width:][pair] = np.where(ranks < 0, NEVER, ranks * width + np.broadcast_to(column, pair.shape)[pair])
    low = width
    while low > 1:
        np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2], out=tree[:, low // 2 : low])
        low //= 2
    row = np.arange(n)
    while True:
        root = tree[row, 1]
        row, root = row[root != NEVER], root[root != NEVER]
        if not len(row):
            break
        at = root % width
        gone = after[row, at]
        following = after[row, gone]
        made = m.merged[root // width]
        token[row, at] = made
        alive[row, gone] = False
        after[row, at] = following
        before[row, np.minimum(following, width)] = at
        tree[row, width + gone] = NEVER
        has = following < lengths[row]
        rank = np.where(has, m.rank(made, token[row, np.minimum(following, width)]), -1)
        tree[row, width + at] = np.where(rank < 0, NEVER, rank * width + at)
        previous = before[row, at]
        has = previous >= 0
        some, previous = row[has], previous[has]
        rank = m.rank(token[some, previous], made[has])
        tree[some, width + previous] = np.where(rank < 0, NEVER, rank * width + previous)
        rows, leaf = np.concatenate([row, row, some]), np.concatenate([at, gone, previous]) + width
        while leaf[0] > 1:
            leaf = leaf >> 1
            tree[rows, leaf] = np.minimum(tree[rows, 2 * leaf], tree[rows, 2 * leaf + 1])
    kept = token[:, :width][alive].astype(np.int32)
    return np.split(kept, np.cumsum(alive.sum(1))[:-1])


def merge_alone(word: bytes, m: Merges) -> np.ndarray:
    """The same for one long word: n merges of log n steps each."""
    n = len(word)
    token = m.byte_id[np.frombuffer(word, np.uint8)]
    width = 1 << (n - 1).bit_length()
    ranks = m.rank(token[:-1], token[1:])
    never = int(NEVER)
    tree = [never] * (2 * width)
    tree[width : width + n - 1] = np.where(ranks < 0, NEVER, ranks * width + np.arange(n - 1)).tolist()
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    known = dict(zip(m.keys.tolist(), m.ranks.tolist()))
    merged, size = m.merged.tolist(), m.size
    token, after, before = token.tolist(), list(range(1, n + 1)), list(range(-1, n))
    alive = bytearray(b"\1") * n

    def put(leaf: int, left: int, right: int) -> None:
        rank = known.get(left * size + right) if left >= 0 and right >= 0 else None
        set_leaf(leaf, never if rank is None else rank * width + leaf)

    def set_leaf(leaf: int, value: int) -> None:
        i = width + leaf
        tree[i] = value
        while i > 1:
            i >>= 1
            best = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best

    while tree[1] != never:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        following = after[gone]
        token[at], alive[gone], after[at] = merged[rank], 0, following
        before[following] = at
        set_leaf(gone, never)
        put(at, token[at], token[following] if following < n else -1)
        if before[at] >= 0:
            put(before[at], token[before[at]], token[at])
    return np.array(token, np.int32)[np.frombuffer(alive, np.uint8) == 1]


def merge_words(words: list[bytes], m: Merges) -> list[np.ndarray]:
    """Ids of each word, in the given order."""
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
    groups: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        if len(word) > SIDE_BY_SIDE:
            out[k] = merge_alone(word, m)
        elif len(word) == 1:
            out[k] = m.byte_id[word[0] : word[0] + 1].astype(np.int32)
        elif word:
            groups.setdefault((len(word) - 1).bit_length(), []).append(k)
    for bits, members in groups.items():
        step = max(1, LEAVES >> bits)
        for i in range(0, len(members), step):
            some = members[i : i + step]
            for k, ids in zip(some, merge_side_by_side([words[k] for k in some], m)):
                out[k] = ids
    return out


_worker: dict = {}


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, key: str) -> Iterator[pa.RecordBatch]:
    if _worker.get("path") != path:
        _worker.update(path=path, merges=Merges.load(path), ids={})
    m, known = _worker["merges"], _worker["ids"]
    for batch in batches:
        words = batch.column(1)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = distinct
        known.update(zip(new, merge_words([w.encode() for w in new], m)))
        each = [known[w] for w in distinct]
        size = np.fromiter(map(len, each), np.int64, len(each))
        pool = np.concatenate(each) if each else np.empty(0, np.int32)
        start = np.cumsum(size) - size
        code = coded.indices.to_numpy()
        count = size[code]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.arange(total) + np.repeat(start[code] - (ends - count), count)]
        per_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])]
        lists = pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])


def encode(texts: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each row's ``text``, without special tokens.

    ``vocabulary`` is the path of the vocabulary's JSON file on the driver, from where every executor gets it. Null and empty
    texts give an empty list, blank texts are encoded like any other, the strings of special tokens are
    ordinary text. Repeated rows and keys come out as often as they come in; a null key stays null; an
    empty table gives no rows; other columns are ignored whatever their names.
    """
    words = F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))
    rows = texts.select(F.col(key), words.alias("_words"))
    kind = texts.schema[key].dataType.simpleString()
    texts.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name
    return rows.mapInArrow(lambda batches: encode_batches(batches, SparkFiles.get(name), key), f"`{key}` {kind}, ids array<int>")
