"""Near copies against brute force over whole sets of shingles."""

import random

import numpy as np

import corpus_pipeline
from labelaudit.llm import op10_simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, linked):
    label = {i: i for i, _ in rows}
    sets = [(i, shingles(t)) for i, t in rows]
    pairs = [(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[k + 1 :] if linked(x, y)]
    while True:
        new = dict(label)
        for i, j in pairs:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            return label
        label = new


def near(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["component_id"] for r in op10_simhash.near_copies(docs).collect()}


def prose(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def test_similarity_is_exact(spark):
    rnd = random.Random(3)
    rows = []
    for n in (5, 6, 12, 50, 51, 104, 204, 604):
        for _ in range(8):
            words = prose(rnd, n)
            # words changed at an end cost one shingle each: from well above to well below 0.8
            for cut in {0, n // 12, n // 10, n // 9, n // 8, n // 7}:
                rows.append((len(rows), " ".join(words[: n - cut] + prose(rnd, cut))))
    assert found(spark, rows) == brute(rows, near)


def test_exactly_at_the_limit(spark):
    rnd = random.Random(4)
    words = prose(rnd, 94)  # 90 shingles
    at, below = words[:84] + prose(rnd, 10), words[:83] + prose(rnd, 11)  # 80 of 100 and 79 of 101 in common
    assert 5 * len(shingles(" ".join(words)) & shingles(" ".join(at))) == 4 * len(shingles(" ".join(words)) | shingles(" ".join(at)))
    assert found(spark, [(0, " ".join(words)), (1, " ".join(at))]) == {0: 0, 1: 0}
    assert found(spark, [(0, " ".join(words)), (1, " ".join(below))]) == {0: 0, 1: 1}


def test_repeats_within_a_text_do_not_count(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(10):
        passage, rest = prose(rnd, 100), prose(rnd, 500)
        # the same set of shingles
        rows += [(len(rows), " ".join(passage * 2 + rest)), (len(rows) + 1, " ".join(passage * 12 + rest))]
    assert found(spark, rows) == {i: i - i % 2 for i, _ in rows}


def test_equal_fingerprints_are_not_enough(spark):
    # "a a a a a" has most shingles of the second text, so its fingerprint, but half of its set
    assert found(spark, [(0, "a a a a a"), (1, "a a a a a a b"), (2, "a A a a a a b")]) == {0: 0, 1: 1, 2: 1}


def test_the_stage_compares_fingerprints_first(spark, monkeypatch):
    base = [f"w{k}" for k in range(400)]
    texts = [base, [*base[:399], "other"], [f"v{k}" for k in range(400)], [f"u{k}" for k in range(6)], [*(f"u{k}" for k in range(5)), "end"]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    pairs, compared = op10_simhash.fingerprint_pairs, []

    def kept(nodes, work, radius=op10_simhash.RADIUS):
        rows = nodes.select("node", "first", "fp").collect()
        found = pairs(nodes, work, radius)
        doc, fp = ({r["node"]: r[c] for r in rows} for c in ("first", "fp"))
        for r in found.collect():
            assert ((fp[r["a"]] ^ fp[r["b"]]) & (1 << 64) - 1).bit_count() <= radius
            compared.append(tuple(sorted((doc[r["a"]], doc[r["b"]]))))
        return found

    monkeypatch.setattr(op10_simhash, "fingerprint_pairs", kept)
    left = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2, 3, 4]
    assert (0, 1) in compared


def test_near_links_are_near():
    fps = np.array([0, 0b1111, 0b11111111, 1 << 63], np.uint64)
    found = {tuple(sorted(map(int, p))) for p in op10_simhash.links_of(fps, 4, near=True)}
    assert found == {(0, 15), (15, 255), (0, 1 << 63)}
