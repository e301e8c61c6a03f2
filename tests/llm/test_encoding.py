from __future__ import annotations

import os
import random

import pytest

from larkspur.llm.encoding import Merges, encode, merge_alone, merge_side_by_side
from larkspur.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_library(spark, reference):
    r = random.Random(9)
    pool = ["the", " quick", "'s", "don't", " 123", "\n\n ", "\t", "é", "字", "　", " ", "​", "👩‍💻", "<|endoftext|>", "=" * 40, "ﬁ", "мир", "\u0085", "\x1c", "  x", "ab" * 30]
    texts = ["", " ", "   ", "a", "\n", "<|endoftext|>", "x" * 3000, "字" * 700, "ab " * 400] + ["".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(300)]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(-1, None, "clash"), (None, "a", "clash"), (0, "", "clash")]
    got = encode(spark.createDataFrame(rows, "k int, t string, ids string"), "k", "t", PATH).collect()
    assert len(got) == len(rows)
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    for row in got:
        assert row.ids == ([] if row.k == -1 else [64] if row.k is None else want[row.k]) or row.k is None and row.ids == want[3]


def test_both_kernels_agree():
    m, r = Merges.load(PATH), random.Random(1)
    words = ["".join(r.choice("etaoin shrdlu-") for _ in range(n)).encode() for n in [2, 3, 5, 31, 32, 33, 200] for _ in range(4)]
    for size in {len(w) for w in words}:
        same = [w for w in words if len(w) == size]
        for word, ids in zip(same, merge_side_by_side(same, m)):
            assert ids.tolist() == merge_alone(word, m).tolist()


def test_no_rows(spark):
    assert encode(spark.createDataFrame([], "k int, t string"), "k", "t", PATH).count() == 0
