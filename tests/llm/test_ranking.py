"""Ranked search against scoring every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candela.llm import ranking

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, top=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    n_docs, n_words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 10 + (90 * n * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score long").repartition(3)
    i = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in ranking.rank_documents(d, i, **options).collect()), key=str)


DOCS = [(0, None), (1, ""), (2, "the cat sat"), (3, "the cat sat"), (None, "The CAT sat"), (None, "a dog"), (4, "the the the the dog É é ß"), (5, "x " * 4000 + "cat"), (6, "!!"), (6, "cat-dog")]
DOCS += [(k, f"w{k % 7} w{k % 11} w{k % 13} cat") for k in range(10, 80)]
ITEMS = [(0, None), (1, ""), (2, "cat"), (3, "CAT! dog the"), (4, "nothing here"), (5, "é w3 w5 w6 w1"), (6, "w3 w5 w6 w1 cat"), (6, "w1 w3 w5 w6 dog"), (None, "dog dog")]


@pytest.mark.parametrize("options", [{}, {"block_terms": 4}, {"cells": 40}, {"top": 1}])
def test_ranking_equals_brute_force(spark, options):
    assert found(spark, DOCS, ITEMS, **options) == brute(DOCS, ITEMS, options.get("top", 10))


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == found(spark, DOCS, []) == found(spark, [(1, None)], ITEMS) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=8))
def test_the_sharing_graph_sums_each_items_terms_once(items):
    block = ranking.build_block([(k, k, sorted(b"%d" % t for t in own)) for k, own in enumerate(items)])
    parts = [Counter(own) for own in block.sets]
    for x, y in block.sums:
        parts.append(parts[x] + parts[y])
    for own, (_, _, sets) in zip(items, block.items):
        total = sum((parts[k] for k in sets), Counter())
        assert total == Counter(block.words.index(b"%d" % t) for t in own)


def test_items_that_share_terms_share_accumulators():
    base = [b"%d" % k for k in range(30)]
    block = ranking.build_block([(k, k, [*base, b"own%d" % k]) for k in range(20)] + [(20 + k, k, base[:15]) for k in range(20)])
    assert len(block.sets) == 22 and sum(len(own) for _, _, own in block.items) <= 60


def test_best_keeps_ties_by_id():
    rng = np.random.default_rng(3)
    score, doc = rng.integers(0, 3, (4, 300)), rng.permutation(300)
    got = ranking._best(None, score, doc, ranking.NO_ID, 5)
    for k in range(4):
        assert list(zip(got[0][k].tolist(), got[1][k].tolist())) == sorted(zip(score[k].tolist(), doc.tolist()), key=lambda x: (-x[0], x[1]))[:5]
