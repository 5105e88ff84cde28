"""Rows that share a doc_id, or have none, are rows of their own."""

import random
import time

import corpus_pipeline
from labelaudit.llm import op1_repeats, op10_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def table(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], SCHEMA).repartition(3)


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_one_of_each_keeps_unlike_rows_of_one_id(spark):
    rnd = random.Random(1)
    a, b, c = (prose(rnd, 60) for _ in range(3))
    near = a + " more"
    assert left(op10_simhash.one_of_each(table(spark, [(1, a), (5, a), (5, b)]))) == left(table(spark, [(1, a), (5, b)]))
    rows = [(7, a), (7, near), (7, b), (7, b), (None, b), (None, c), (None, c), (3, c), (None, None), (9, ""), (9, None)]
    got = left(op10_simhash.one_of_each(table(spark, rows)))
    assert [i for i, _ in got] == [3, 7, 7, 9] and {t for i, t in got if i == 7} >= {b} and len({t for i, t in got if i == 7} & {a, near}) == 1


def test_one_of_each_without_copies_or_rows(spark, no_docs):
    rnd = random.Random(2)
    rows = [(k, prose(rnd, 30)) for k in range(5)]
    assert left(op10_simhash.one_of_each(table(spark, rows))) == sorted(rows, key=repr)
    assert op10_simhash.one_of_each(no_docs).collect() == []


def test_columns_named_like_the_operators_own_stay(spark):
    docs = table(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None)]).selectExpr("*", "1 as row", "2 as t", "3 as same", "4 as root", "5 as count", "6 as `first`", "7 as `a.b`")
    out = op10_simhash.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def brute_removed(rows, least=100):
    """n_removed of each row: bytes covered by strings that start earlier, rows ordered by doc_id, then text."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = t.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - least + 1):
            if data[p : p + least] in seen:
                gone[p : p + least] = b"\1" * least
            seen.add(data[p : p + least])
        out.setdefault(i, []).append(sum(gone))
    return sorted((i, sorted(n)) for i, n in out.items())


def removed(docs):
    out = {}
    for r in op1_repeats.removal_digests(docs).collect():
        out.setdefault(r["doc_id"], []).append(r["n_removed"])
    return sorted((i, sorted(n)) for i, n in out.items())


def test_repeats_under_one_id(spark):
    rnd = random.Random(3)
    shared = prose(rnd, 60)
    rows = [(4 if k < 30 else k, prose(rnd, 20) + " " + (shared if k % 3 else "") + " " + prose(rnd, 20)) for k in range(40)]
    rows += rows[:3]
    assert removed(table(spark, rows)) == brute_removed(rows)


def test_work_does_not_grow_with_the_square_of_an_ids_rows(spark):
    rnd = random.Random(4)
    shared = prose(rnd, 60)
    texts = [prose(rnd, 10) + " " + shared + " " + prose(rnd, 10) for _ in range(2000)]

    def seconds(ids):
        docs = table(spark, [(i, t) for i, t in zip(ids, texts, strict=True)]).cache()
        docs.count()
        began = time.perf_counter()
        op1_repeats.removal_digests(docs).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(range(2000))
    assert seconds([1] * 2000) < 2.5 * seconds(range(2000)) + 2  # measured: about 1.3 times; the join by doc_id alone took over four


def test_pipeline_stages_with_repeated_ids_nulls_and_nothing(spark, no_docs, docs):
    sf = "/root/testdata/sf0.001"
    odd = docs.unionByName(docs.where("doc_id < 4").selectExpr("doc_id + 1 as doc_id", "text", "lang", "source", "n_chars"))
    for start in (odd, no_docs):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = spark.createDataFrame(stage(spark, now, sf).collect(), now.schema) if name != "best_fit_packing" else stage(spark, now, sf)
        assert now.count() >= 0
        if start is no_docs:
            assert now.isEmpty()
