"""Ranking against a plain version that scores every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from witnessframe.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain_rank(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c, n in counted:
            m = 25 + (75 * n * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, place + 1, doc_id, -score) for place, (score, _, _, doc_id) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def mine(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def random_texts(seed, n, most):
    draw = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "Ωx", "a1"]
    share = 1 / np.arange(1, len(words) + 1)
    return [" ".join(draw.choice(words, draw.integers(1, most), p=share / share.sum())) for _ in range(n)]


@pytest.mark.parametrize("postings", [1, 40, 1 << 19])
def test_rank_equals_plain(spark, monkeypatch, postings):
    docs = list(enumerate(random_texts(1, 400, 30)))
    items = list(enumerate(random_texts(2, 25, 12)))
    expected = plain_rank(docs, items)
    d, i = tables(spark, docs, items)
    assert mine(search.rank(d.repartition(3), i)) == expected
    # The same over small blocks, so that floors are carried from block to block.
    monkeypatch.setattr(search, "POSTINGS_AT_ONCE", postings)
    vocabulary = np.unique(np.concatenate([search._hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for _, t in items]))
    assert len(vocabulary) > 10


def test_limited_accumulators_are_exact():
    """Fewer documents get an accumulator than hold a term, and the best ten do not change, with any floor that they reach."""
    draw = np.random.default_rng(3)
    size, n = 12, 3000
    held = [np.flatnonzero(draw.random(size) < 1 / (1 + np.arange(size)[::-1])) for _ in range(n)]
    counts = [draw.integers(1, 5, len(h)) for h in held]
    lengths = np.array([c.sum() + 5 for c in counts])
    block = search.invert(
        np.arange(n).astype(object), lengths, np.array([len(h) for h in held]), np.concatenate(held), np.concatenate(counts), size, n, int(lengths.sum())
    )
    df = np.diff(block.start)
    order = np.argsort(df)
    query = search.Query(0, order, np.array([search.weight(n, int(df[t])) for t in order]))
    exact = np.zeros(n, np.int64)
    for t, w in zip(query.terms, query.weights):
        exact[block.doc[block.start[t] : block.start[t + 1]]] += w * block.impact[block.start[t] : block.start[t + 1]]
    expected = search._best(exact, block.doc_ids, 10)
    for floor in (0, int(expected[0][-1])):
        limited = search.accumulate(block, query, 10, floor)
        assert (limited > 0).sum() < (exact > 0).sum()
        assert ((limited == exact) | (limited < expected[0][-1])).all()
        best = search._best(limited, block.doc_ids, 10)
        assert best[0].tolist() == expected[0].tolist() and best[1].tolist() == expected[1].tolist()


def test_odd_rows(spark):
    docs = [
        (1, "Alpha beta"), (1, "Alpha beta"), (None, "alpha BETA"), (None, None), (3, ""), (4, " .,;"), (5, "gamma " * 40_000), (2, "alpha\x00beta"), (6, "É é"),
    ] + [(10 + i, "delta epsilon") for i in range(40)]
    items = [(1, "alpha"), (1, "beta beta"), (2, None), (3, "nothing here"), (4, "DELTA"), (None, "gamma É"), (5, "é")]
    d, i = tables(spark, docs, items)
    expected = plain_rank(docs, items)
    assert mine(search.rank(d, i)) == expected
    clash = search.rank(d.selectExpr("*", "1 as n", "2 as terms", "3 as item", "4 as score"), i.selectExpr("*", "5 as rank", "6 as doc_id"))
    assert mine(clash) == expected and clash.columns == ["item_id", "rank", "doc_id", "score"]
    assert search.rank(d.limit(0), i).count() == 0 and search.rank(d, i.limit(0)).count() == 0


def test_items_in_groups(spark, monkeypatch):
    docs, items = list(enumerate(random_texts(4, 120, 20))), list(enumerate(random_texts(5, 20, 8)))
    monkeypatch.setattr(search, "ITEMS_AT_ONCE", 6)
    assert mine(search.rank(*tables(spark, docs, items))) == plain_rank(docs, items)
