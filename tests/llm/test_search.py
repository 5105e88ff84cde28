"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import pytest

from labelaudit.llm import op13_search as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def counts(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute(docs, items, top=20):
    counted = [(i, c) for i, t in docs if (c := counts(t))]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // length
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, q in counts(text).items() if w in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def found(docs, items, **more):
    return sorted((tuple(r) for r in op.search(docs, items, **more).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(60)] + ["ÀÉ", "日本語", "don't", "A1b2", "x|y", "İstanbul"]
    text = lambda n: " ".join(rnd.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(k, text(rnd.choice([1, 5, 40, 300]))) for k in range(300)]
    docs += [(300 + k, docs[k][1]) for k in range(40)] + [(5, docs[7][1]), docs[3], (None, docs[8][1]), (900, None), (901, ""), (902, "?! ...\0"), (903, "w1 " * 20_000)]
    items = [(k, text(rnd.choice([1, 3, 30, 90]))) for k in range(25)] + [(50, "nowhere at all"), (51, None), (52, ""), (None, "w3 w4"), (53, "w1 W1 w1 w2"), (54, " ".join(words * 2))]
    return docs, items


def frames(spark, corpus):
    return spark.createDataFrame(corpus[0], "doc_id long, text string").repartition(4), spark.createDataFrame(corpus[1], "item_id long, text string")


def test_equals_scores_of_every_document(spark, corpus):
    assert found(*frames(spark, corpus)) == brute(*corpus)


@pytest.mark.parametrize("top", [1, 3, 1000])
def test_other_lengths_of_lists(spark, corpus, top):
    assert found(*frames(spark, corpus), top=top) == brute(*corpus, top=top)


def test_passes_and_small_blocks_give_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(op, "CELLS", 100)
    monkeypatch.setattr(op, "MASKS", 1)
    assert found(*frames(spark, corpus), pairs=200) == brute(*corpus)


def test_one_item_in_several_rows(spark, corpus):
    docs, _ = frames(spark, corpus)
    items = spark.createDataFrame([(1, "w2 w3"), (1, "w2 w3"), (1, "w9"), (2, "w4")], "item_id long, text string")
    assert found(docs, items) == brute(corpus[0], [(1, "w2 w3 w9"), (2, "w4")])


def test_empty_tables_and_clashing_columns(spark, corpus, no_docs):
    docs, items = frames(spark, corpus)
    assert found(no_docs, items) == [] and found(docs, items.where("false")) == []
    more = ["n", "tf", "places", "score", "rank", "salt", "item", "df"]
    assert found(docs.selectExpr("*", *(f"1 as {c}" for c in more)), items.selectExpr("*", *(f"2 as {c}" for c in more))) == brute(*corpus)


def test_few_masks_are_evaluated(spark, corpus, monkeypatch):
    """Once the first places are taken, groups whose bound is lower aren't looked at."""
    import numpy as np

    rnd = np.random.default_rng(0)
    parts = np.where(rnd.random((12, 4000)) < 0.3, rnd.integers(500, 1000, (12, 4000)), 0)
    there = parts > 0
    seen = []
    add = op.Best.add
    monkeypatch.setattr(op.Best, "add", lambda self, scores, *rest: (seen.append(len(scores)), add(self, scores, *rest)))
    best = op.Best(20)
    op.search_block([best], [(np.arange(12), np.arange(1, 13))], np.arange(4000), np.zeros(4000, bool), parts, there)
    whole = (parts * np.arange(1, 13)[:, None]).sum(axis=0)
    assert best.scores.tolist() == sorted(whole.tolist(), reverse=True)[:20] and sum(seen) < 1500
