"""Ranked search against plain Python: whole small tables, ties, masks, blocks of items and of documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from affinity.llm import ranked_search as R
from tests.conftest import SF_SMALL
from tests.llm.cases import empty, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=50):
    """Rows (item_id, rank, doc_id, score) of (id, text) documents and items."""
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                        for t in set(_terms(text)) if t in bag)
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores, key=lambda s: s[:3])[:best], 1):
            out.append((item, rank, doc, -score))
    return out


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_small_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert _sorted(R.op12_ranked_search(spark, SF_SMALL).collect()) == _sorted(brute(docs, items))


def _made(rnd, count, words):
    return [(k, " ".join(rnd.choice(words) + rnd.choice(["", ".", "!"]) for _ in range(rnd.randint(0, 30)))) for k in range(count)]


@pytest.mark.parametrize("group,item_bytes,best", [(7, 60, 3), (64, 1 << 20, 50), (4096, 1, 1)])
def test_groups_blocks_and_ties(spark, monkeypatch, group, item_bytes, best):
    rnd = random.Random(group)
    words = [f"w{k}" for k in range(12)] + ["ünï", "日本", "Z9"]
    docs = _made(rnd, 150, words) + [(k, "w1 w2 W3") for k in range(500, 620)] + [(None, "w1 w2"), (None, None), (9, None), (9, "w1")]
    items = _made(rnd, 9, words) + [(100, "w1 w2 w3"), (101, "w1 w2 w3"), (None, "w1 w2 w3"), (102, None), (103, "... "), (104, "unseen")]
    monkeypatch.setattr(R, "GROUP_DOCS", group)
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = R.ranked_search(docs_df, items_df, best=best, item_bytes=item_bytes).collect()
    assert _sorted(got) == _sorted(brute(docs, items, best))


def test_masks_are_skipped_once_safe():
    """Documents whose mask cannot reach the kept scores are not scored."""
    rnd = random.Random(2)
    rows = [[t for t in range(12) if rnd.random() < (0.9 if k < 80 else 0.15)] or [0] for k in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array([20] * 4000, pa.int64()), pa.array(rows, pa.list_(pa.int32())),
                                        pa.array([[1] * len(r) for r in rows], pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])
    group, terms = R.Group(batch, np.arange(12, dtype=np.int64) * 7 + 900, 4000, 80_000), np.arange(12)
    kept, whole = R.Kept(20), R.Kept(4000)
    scored = R.evaluate(group, terms, kept)
    R.evaluate(group, terms, whole)
    assert 20 <= scored < 400
    assert kept.doc.tolist() == whole.doc[:20].tolist() and kept.score.tolist() == whole.score[:20].tolist()


def test_long_items_and_lengths_beyond_64_bits():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([10**13, 5], pa.int64()), pa.array([list(range(200)), [3]], pa.list_(pa.int32())),
                                        pa.array([[2] * 200, [1]], pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])
    group = R.Group(batch, np.full(200, 10, np.int64), 10**12, 10**13)
    kept = R.Kept(5)
    R.evaluate(group, np.arange(200), kept)
    m = 50 + 50 * 10**13 * 10**12 // 10**13
    assert dict(zip(kept.doc.tolist(), kept.score.tolist(), strict=True))[2] == 10 * (10**9 // (1000 + 20 * (50 + 50 * 5 * 10**12 // 10**13)))
    assert 200 * 10 * (2 * 10**9 // (2000 + 20 * m)) == dict(zip(kept.doc.tolist(), kept.score.tolist(), strict=True)).get(1, 0)


def test_awkward_tables(spark):
    items = spark.createDataFrame([(1, "w20 WORD5"), (2, None), (3, ""), (None, "solo two")], "item_id long, text string")
    from tests.llm.cases import ROWS
    got = R.ranked_search(table(spark), items).collect()
    assert _sorted(got) == _sorted(brute(ROWS, [(1, "w20 WORD5"), (2, None), (3, ""), (None, "solo two")]))
    assert R.ranked_search(empty(spark), items).count() == 0
    assert R.ranked_search(table(spark), items.where("false")).count() == 0
