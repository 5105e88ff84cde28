"""Links of 0.8 or more of whole sets of shingles, against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from labelaudit.llm import op12_minhash as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(rows)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, (_, x) in enumerate(sets):
        for j in range(k):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                label[top(k)] = top(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min((v for v in (least.get(top(k)), i) if v is not None), default=None)
    out = []
    for k, (i, x) in enumerate(sets):
        c = least[top(k)] if x else i
        out.append((i, len(x), c, None if i is None or c is None else i == c))
    return sorted(out, key=repr)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in op.near_sets(docs).collect()), key=repr)


def prose(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def test_equals_brute_force(spark, rows):
    assert found(spark, [(r[0], r[1]) for r in rows]) == brute([(r[0], r[1]) for r in rows])


def test_around_the_limit(spark):
    rnd = random.Random(3)
    rows = []
    for n in (1, 2, 3, 4, 5, 8, 13, 50, 103, 303):
        for _ in range(6):
            words = prose(rnd, n)
            for cut in {0, n // 12, n // 10, n // 9, n // 8, n // 7}:  # from well above to well below 0.8
                rows.append((len(rows), " ".join(words[: n - cut] + prose(rnd, cut))))
    assert found(spark, rows) == brute(rows)


def test_chains_whose_ends_are_unlike(spark):
    """Each text is near the next one only, so a star's centre is unlike most of its bucket."""
    rnd = random.Random(4)
    words, rows = prose(rnd, 1200), []
    for k in range(60):
        rows.append((59 - k, " ".join(words[10 * k : 10 * k + 203])))
    assert {c for _, _, c, _ in found(spark, rows)} == {0} and found(spark, rows) == brute(rows)


def test_a_passage_that_a_third_of_all_texts_share(spark, monkeypatch):
    rnd = random.Random(5)
    passage, rows = prose(rnd, 60), []
    for k in range(240):
        own = prose(rnd, 20)
        if k % 3 == 0:
            rows += [(len(rows), " ".join(own[:10] + passage + own[10:])), (len(rows) + 1, " ".join(own[:10] + passage + own[10:17]))]
        else:
            rows.append((len(rows), " ".join(own + prose(rnd, 60))))
    want = brute(rows)
    assert found(spark, rows) == want
    monkeypatch.setattr(op, "LARGE", 40)  # buckets cut by other keys, many tiles
    monkeypatch.setattr(op, "TILE", 20)
    assert found(spark, rows) == want


def test_repeats_nulls_nothing_and_clashing_columns(spark, no_docs, clashing):
    assert op.near_sets(no_docs).collect() == []
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "x y"), (3, "X Y"), (4, None), (5, ""), (6, " \n"), (None, None), (7, "one"), (8, "one"), (0, "ONE")]
    assert found(spark, rows) == brute(rows)
    plain = clashing.select("doc_id", "text")
    assert sorted(map(tuple, op.near_sets(clashing).collect()), key=repr) == sorted(map(tuple, op.near_sets(plain).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 3, 20, 400, 5000])
def test_bins_agree_as_often_as_sets_do(n):
    """Densified sketches of sparse and full sets alike estimate the similarity without bias."""
    rnd = np.random.default_rng(n)
    agree, share = [], []
    for _ in range(60):
        union = rnd.integers(1, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.unique(union[: n + n // 2]), np.unique(union[n // 2 :])
        both = np.concatenate([a, b])
        sketch = op.densified(op.bin_minima(both, np.array([0, len(a), len(both)])))
        assert (sketch != op.EMPTY).all()
        agree.append((sketch[0] == sketch[1]).mean())
        share.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(agree) - np.mean(share)) < 0.05
