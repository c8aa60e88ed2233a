"""Ranked search against scores of every document in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from carelake.llm import lexical
from carelake.llm.common import words_of


def by_hand(docs, items, k):
    counts = [(i, Counter(words_of((t or "").encode()))) for i, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    n_terms = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            n, score = sum(c.values()), 0
            for t in set(words_of((text or "").encode())):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("words", "items_at_once", "k"), [(60, 3, 4), (1 << 18, 1 << 12, 10)])
def test_ranked_search(spark, monkeypatch, words, items_at_once, k):
    monkeypatch.setattr(lexical, "BLOCK_WORDS", words)
    rng = random.Random(words)
    skewed = [f"w{min(rng.randrange(60), rng.randrange(60), rng.randrange(60))}" for _ in range(5000)]

    def some(n):
        return " ".join(rng.choice(skewed) for _ in range(n))
    docs = [(i, some(rng.randrange(1, 40))) for i in range(250)] + [(1000 + i, "w1 W2. w3") for i in range(60)]
    docs += [(7, some(9)), (7, some(9)), (None, "w1 w50 w51"), (2000, None), (2001, ""), (2002, "..."),
             (2003, some(3000)), (2004, "É é w50\x7fw51")]
    items = [(i, some(rng.randrange(1, 9))) for i in range(9)] + [(3, "w1 w2"), (3, "w1 w2"), (90, None), (91, ""),
             (92, "unseen words"), (93, "É W50"), (None, "w59 w58 w57 unseen")]
    rng.shuffle(docs)
    given = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, score int").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.ranked_search(given, asked, k, items_at_once).collect()]
    assert sorted(got, key=repr) == by_hand(docs, items, k)


def test_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    some = [(1, "a b")]
    for d, i in (([], some), (some, []), ([], []), ([(1, None)], some)):
        assert lexical.ranked_search(spark.createDataFrame(d, docs), spark.createDataFrame(i, items)).collect() == []


def test_a_pair_that_never_meets_bounds_less_than_both_terms():
    class Plain(lexical.Totals):
        def __init__(self):
            self.n, self.terms = 100, 1000
    asked = lexical.Asked([(0, [(5, 11), (6, 12), (9, 13)])], Plain())
    assert asked.pairs.tolist() == [[0, 1], [2, 2]]
    apart = lexical.Block(asked, 4, np.array([0, 1]), np.array([2, 4]), np.array([0, 1, 2, 3]), np.array([5, 9, 7, 3]),
                          *(np.zeros(0, np.int64) for _ in range(3)))
    assert apart.bounds.tolist() == [max(9 * asked.weights[0], 7 * asked.weights[1]), 0]
    # No document can reach a score above the pair's bound, though both maxima together would allow it.
    assert len(lexical.best_of(apart, asked, 0, int(apart.bounds[0]) + 1)[0]) == 0
    assert lexical.best_of(apart, asked, 0, int(apart.bounds[0]))[0].tolist() == [1]
