"""Vectors, classifier, urls, archives and the pipeline."""

import base64
import hashlib
import math
import re

import numpy as np
import pytest

from labelaudit.llm import op2_multi_index, op4_classifier, op6_link_trust, op8_warc
from labelaudit.llm.common import new_folder

SF = "/root/testdata/sf0.001"


def vectors(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rnd.normal(size=8)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(40)]  # copies
    rows += [(500, None), (501, [0.0] * 8), (502, [math.nan] + [1.0] * 7), (503, [None] + [1.0] * 7), (504, [1.0] * 3), (505, [math.inf] + [1.0] * 7), (None, rows[1][1]), rows[3]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows


def test_op2_recall_and_exact_scores(spark):
    df, rows = vectors(spark)
    found = op2_multi_index.nearest_neighbours(df, lambda v: v % 20 == 0).collect()
    fine = {i: np.float32(v).astype(float) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for q in [i for i in fine if i % 20 == 0]:
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        truth = sorted((float(np.sqrt(((fine[q] - v) ** 2).sum())), i) for i, v in fine.items() if i != q)[:10]
        for r in mine:
            assert r["score"] == pytest.approx(float(np.sqrt(((fine[q] - fine[r["vec_id"]]) ** 2).sum())), abs=1e-12)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        hits += len({r["vec_id"] for r in mine} & {i for _, i in truth})
        total += 10
    assert {r["query_id"] for r in found} == {i for i in fine if i % 20 == 0}
    assert hits / total >= 0.9


def test_op2_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = op2_multi_index.nearest_neighbours(df, lambda v: v % 100 == 0).collect()
    table = df.select("vec_id", "embedding").toPandas()
    x = np.array(table["embedding"].tolist(), np.float64)
    ids = table["vec_id"].to_numpy()
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        truth = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits.append(len({r["vec_id"] for r in found if r["query_id"] == q} & set(truth)) / 10)
    assert np.mean(hits) >= 0.9


def test_op2_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op2_multi_index.nearest_neighbours(empty, lambda v: v % 100 == 0).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    found = op2_multi_index.nearest_neighbours(three, lambda v: v % 100 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [(0, 1, 2), (0, 2, 1)]


def test_op2_walk_is_in_order():
    rnd = np.random.default_rng(0)
    a, b = rnd.random(7), rnd.random(9)
    cells = op2_multi_index.walk(a, b, np.ones((7, 9), int), 63)
    sums = [a[i] + b[j] for i, j in cells]
    assert len(set(cells)) == 63 and sums == sorted(sums)
    some = op2_multi_index.walk(a, b, np.ones((7, 9), int), 3, within=sums[20])
    assert some == cells[:21]
    assert op2_multi_index.walk(a, b, np.ones((7, 9), int), 3, within=0.0) == cells[:3]


def test_op2_ties_go_to_the_smaller_id(spark):
    """Thousands of different vectors at one distance."""
    rows = [(0, [4.0] * 12 + [0.0])]
    rows += [(k, [4.0 + (1 if k >> b & 1 else -1) for b in range(11)] + [5.0, 0.0]) for k in range(1, 2025)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = op2_multi_index.nearest_neighbours(df, lambda v: v == 0, target=1.0).orderBy("rank").collect()
    assert [r["score"] for r in found] == [math.sqrt(12)] * 10
    assert [r["vec_id"] for r in found] == list(range(1, 11))


def test_op2_visits_few_of_clustered_vectors(spark):
    """Recall with clashing columns beside the vectors, and the share of vectors whose distance is taken."""
    from pyspark.sql import functions as F

    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(40, 16))
    x = (centres[np.arange(4000) % 40] + 0.15 * rnd.normal(size=(4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    df = df.withColumns({n: F.lit(1) for n in ("v", "ids", "entry", "c1", "c2", "query", "score", "rank", "place")})
    found = op2_multi_index.nearest_neighbours(df, lambda v: v % 100 == 0).collect()
    x, hits, seen = x.astype(float), 0, 0
    index = op2_multi_index.MultiIndex(x, len(x), 10)
    a, b = index.codes(x)
    counts = np.zeros([len(book) for book in index.books], np.int64)
    np.add.at(counts, (a, b), 1)
    q = x[::100]
    first, second = index.distances(q)
    within = index.within(q, first, second)
    for k in range(len(q)):
        d = np.sqrt(((x - q[k]) ** 2).sum(1))
        truth = {int(i) for i in np.argsort(d, kind="stable")[1:11]}
        hits += len(truth & {r["vec_id"] for r in found if r["query_id"] == 100 * k})
        seen += sum(counts[c] for c in op2_multi_index.walk(first[k], second[k], counts, 11, within[k]))
    assert hits >= 0.9 * 10 * len(q)
    assert seen < 0.3 * len(x) * len(q)


def test_op2_sends_no_table_to_the_driver(spark):
    """What queries ask is far larger than Spark takes it for, so no join may broadcast it; walks are dealt to all tasks."""
    df, rows = vectors(spark)
    found = op2_multi_index.nearest_neighbours(df, lambda v: v % 2 == 0)
    plans = [found._jdf.queryExecution().executedPlan().toString()]
    assert {r["query_id"] for r in found.collect()} == {*range(0, 440, 2)}
    plans += [found._jdf.queryExecution().executedPlan().toString()]
    for plan in plans:
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert "RoundRobinPartitioning(4)" in plan


def test_op2_distances_are_the_same_a_few_rows_at_once():
    rnd = np.random.default_rng(1)
    index = op2_multi_index.MultiIndex(rnd.normal(size=(300, 7)), 300, 10)
    x = rnd.normal(size=(3 * op2_multi_index.WALKS + 5, 7))
    for part, book, d in zip(index.halves(x), index.books, index.distances(x), strict=True):
        assert (d == ((part[:, None] - book[None]) ** 2).sum(2)).all()
    assert [d.shape for d in index.distances(x[:0])] == [(0, len(book)) for book in index.books]


def test_op2_tile_meets_visited_cells_only():
    """The nearest of each query's own cells, with all ties of the last; a query may find fewer than asked for, or none."""
    rnd = np.random.default_rng(2)
    y = rnd.integers(0, 3, (500, 4)).astype(float)
    x, c2 = y[:40] + 0.0, rnd.integers(0, 20, 500)
    cells = rnd.random((40, 20)) < 0.4
    cells[0], cells[1], cells[2] = True, False, np.arange(20) == c2[2]
    for held in (500, 30, 5):
        row, col, d = op2_multi_index.compared(x, cells, y[:held], c2[:held], 10)
        for k in range(40):
            exact = np.sqrt(((y[:held] - x[k]) ** 2).sum(1))
            mine = np.flatnonzero(cells[k, c2[:held]])
            last = np.sort(exact[mine])[min(10, len(mine) - 1)] if len(mine) else 0
            assert sorted(col[row == k]) == [i for i in mine if exact[i] <= last]
            assert (d[row == k] == exact[col[row == k]]).all()


def test_op2_finds_neighbours_that_lie_nearer_than_any_of_the_sample(spark, monkeypatch):
    """A sample with many vectors of each cluster, and a part of it as great as the sample is of all with a few."""
    monkeypatch.setattr(op2_multi_index, "TRAIN_ROWS", 512)
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(20, 24))
    x = (centres[np.arange(8000) % 20] + 0.1 * rnd.normal(size=(8000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = op2_multi_index.nearest_neighbours(df, lambda v: v % 100 == 0).collect()
    x, hits = x.astype(float), 0
    for q in range(0, 8000, 100):
        truth = np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:11]
        hits += len({r["vec_id"] for r in found if r["query_id"] == q} & set(truth.tolist()))
    assert hits >= 0.9 * 10 * 80


def test_op2_true_neighbours(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(300, 6)).astype(np.float32)
    c1, c2 = rnd.integers(0, 5, 300), rnd.integers(0, 5, 300)
    coded = spark.createDataFrame([(i, v.tolist(), int(c1[i]), int(c2[i])) for i, v in enumerate(x)], "entry long, v array<float>, c1 int, c2 int").repartition(5)
    x = x.astype(float)
    found = op2_multi_index.true_neighbours(coded, x[7:9], np.array([7, 8]), 10).collect()
    for k, q in enumerate((7, 8)):
        d = ((x - x[q]) ** 2).sum(1)
        truth = np.argsort(d)[1:11]
        mine = sorted((r["distance"], r["c1"], r["c2"]) for r in found if r["row"] == k)
        assert [m[1:] for m in mine] == [(c1[i], c2[i]) for i in truth]
        assert [m[0] for m in mine] == pytest.approx(d[truth].tolist())


def test_op2_leading_rows():
    row, score, ids = np.array([1, 0, 1, 1, 0]), np.array([2.0, 1.0, 2.0, 0.5, 1.0]), np.array([7, 9, 3, 8, 4])
    assert op2_multi_index.leading(row, score, ids, 2).tolist() == [4, 1, 3, 2]


def test_op4_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    found = op4_classifier.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() >= 0.97
    assert found[found["quality"] == 1]["predicted"].mean() >= 0.98
    assert found["score"].between(0, 1).all()


def test_op4_training_is_plain_ftrl():
    """Weights against the update written out one feature at a time."""
    rnd = np.random.default_rng(6)
    rows = [(np.unique(rnd.integers(0, 16, 5)), None, float(rnd.random() < 0.5)) for _ in range(60)]
    rows = [(p, rnd.random(len(p)), y) for p, _, y in rows]
    z, n = [0.0] * 17, [0.0] * 17
    a, b, l1, l2 = op4_classifier.ALPHA, op4_classifier.BETA, op4_classifier.L1, op4_classifier.L2

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for _ in range(2):
        for places, values, label in rows:
            w = [weight(i) for i in places]
            p = 1 / (1 + math.exp(-sum(x * v for x, v in zip(w, values, strict=True))))
            for i, x, v in zip(places, w, values, strict=True):
                g = (p - label) * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a
                z[i], n[i] = z[i] + g - s * x, n[i] + g * g
    assert op4_classifier.train(rows, bits=4, epochs=2) == pytest.approx([weight(i) for i in range(17)], abs=1e-12)


def test_op4_clashing_columns_and_repeated_ids(spark, docs, clashing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    one = sorted(tuple(r) for r in op4_classifier.quality_scores(docs.where("doc_id is not null"), labels).collect())
    two = sorted(tuple(r) for r in op4_classifier.quality_scores(clashing.repartition(2).where("doc_id is not null"), labels).collect())
    assert one == two
    kept = op4_classifier.accepted(clashing, labels)
    assert kept.columns == clashing.columns
    # of several texts of an id one is learnt from, whatever the order of rows
    twice = docs.where("doc_id < 12").unionByName(docs.where("doc_id < 12").selectExpr("doc_id", "concat(text, ' more') text", "lang", "source", "n_chars"))
    weights = [op4_classifier.fit(d, labels) for d in (twice, twice.orderBy("text"), twice.orderBy("n_chars"))]
    assert (weights[0] == weights[1]).all() and (weights[0] == weights[2]).all()


def test_op4_edges(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    found = op4_classifier.quality_scores(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    none = op4_classifier.quality_scores(docs, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {1}
    assert op4_classifier.quality_scores(no_docs, labels).count() == 0


def test_op4_never_learns_from_held_out_rows(spark, docs):
    from zlib import crc32

    held = [i for i in range(30) if crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, 0) for i in held], "doc_id long, quality int")
    assert {r["score"] for r in op4_classifier.quality_scores(docs, labels).collect()} == {0.5}


PAGES = [
    (0, "http://A.Example.net/en/1?x#y", "<p>same</p>"), (1, "https://x.net/de/", "<p>same</p>"), (2, "http://example.com/de/1", ""), (3, "http://shop.example.com/en/1", None),
    (4, "https://a.org/fr/2", "<a href='https://good.info/'>g</a>"), (5, "https://bad.info/", '<a href="http://x.net/de/">b</a>'), (6, None, "<p>n</p>"), (7, "no scheme", "<p>é</p>"),
    (8, "http://net", "x" * 200_000), (9, "http://good.info/?q", "<p>same</p>"), (9, "http://good.info/?q", "<p>same</p>"), (None, "http://good.info/z", "<p>lost</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"host": F.lit(1), "score": F.lit(2), "key": F.lit(3)})


def test_op6_rules_and_propagation(pages):
    found = {r["page_id"]: r for r in op6_link_trust.filter_urls(pages).collect()}
    assert (found[0]["host"], found[0]["path"], found[0]["rule"], found[0]["verdict"]) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (found[1]["rule"], found[1]["verdict"]) == ("net/", "block")
    assert (found[2]["rule"], found[2]["verdict"]) == ("example.com/de/", "block")
    assert (found[3]["rule"], found[4]["rule"], found[4]["verdict"]) == (None, "org/fr/", "allow")
    assert found[5]["rule"] is None and found[5]["verdict"] == "block" and found[5]["distrust"] > 0  # it links to a blocked host
    assert found[9]["verdict"] == "allow" and found[9]["trust"] > 0  # a trusted host links to it
    assert (found[6]["host"], found[6]["path"], found[6]["verdict"]) == ("", "", "allow")
    assert (found[7]["host"], found[8]["host"], found[8]["path"], found[8]["rule"]) == ("", "net", "", None)
    assert op6_link_trust.filter_urls(pages.where("false")).count() == 0
    assert op6_link_trust.filter_urls(pages).count() == len(PAGES)


def test_op6_scores_against_plain_iteration(pages):
    edges = {("a.org", "good.info"): 1.0, ("bad.info", "x.net"): 1.0, ("shop.example.com", "example.com"): 1.0, ("example.com", "shop.example.com"): 1.0}
    edges |= {("a.example.net", "example.net"): 1.0, ("example.net", "a.example.net"): 1.0}
    hosts = {"a.example.net", "x.net", "example.com", "shop.example.com", "a.org", "bad.info", "", "net", "good.info"}
    seeds = {"trust": {"a.example.net": 1.0, "a.org": 1.0}, "distrust": {"x.net": 1.0, "example.com": 1.0}}
    wanted = {}
    for kind, s in seeds.items():
        way = edges if kind == "trust" else {(b, a): w for (a, b), w in edges.items()}
        out = {a: sum(w for (x, _), w in way.items() if x == a) for a, _ in way}
        s = {h: w * len(hosts) / sum(s.values()) for h, w in s.items()}
        now = dict(s)
        for _ in range(op6_link_trust.ROUNDS):
            new = {h: 0.15 * w for h, w in s.items()}
            for (a, b), w in way.items():
                new[b] = new.get(b, 0) + 0.85 * now.get(a, 0) * w / out[a]
            now = new
        wanted[kind] = now
    for r in op6_link_trust.host_scores(pages).collect():
        for kind in wanted:
            assert r[kind] == pytest.approx(wanted[kind].get(r["host"], 0), abs=1e-9)


def test_op8_round_trip(spark, pages):
    found = op8_warc.archive_pages(pages).collect()
    assert len(found) == len(PAGES)
    text = {i: (h or "").encode() for i, _, h in PAGES}
    for r in found:
        data = text[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    by = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in found}
    assert by[0] == by[1] == ("revisit", 9) and by[9] == ("response", None)
    assert by[2] == ("revisit", 3) and by[3] == ("response", None) and by[None] == ("response", None)
    few = {r["page_id"]: r["record_type"] for r in op8_warc.archive_pages(pages, least_bytes=5).collect()}
    assert few[2] == "response" and few[0] == "revisit"
    assert op8_warc.archive_pages(pages.where("false")).count() == 0


def test_op8_lookup_by_url(spark, pages):
    archives, index = new_folder(spark, "warc"), new_folder(spark, "index")
    directory = op8_warc.write_index(op8_warc.write_archives(pages, archives), index, block=2)
    found = op8_warc.lookup(spark, directory, archives, index, ["http://example.com/de/1", "http://good.info/?q", "http://nowhere.example/"]).collect()
    assert sorted(r["page_id"] for r in found) == [2, 9, 9]
    assert op8_warc.lookup(spark, directory, archives, index, []).count() == 0
    keys = sorted(op8_warc.surt(p[1]) for p in PAGES)
    for key in {*keys, "", "zzz", "com,a)/"}:
        one = [f for f in directory.collect() if f["first_key"] <= key <= f["last_key"]]
        assert op8_warc.files_with(directory, [key]) == sorted(f["file"] for f in one)
    for r in directory.collect():
        firsts, lasts = [b["first"] for b in r["blocks"]], [b["last"] for b in r["blocks"]]
        for key in {*keys, "", "zzz"}:
            assert list(op8_warc.between(firsts, lasts, key)) == [i for i, (a, b) in enumerate(zip(firsts, lasts, strict=True)) if a <= key <= b]


def test_op8_records_are_plain_gzip_members():
    import gzip

    data = op8_warc.record(1, "http://a.b/ü c", b"<p>x</p>", None, None) + op8_warc.record(2, None, b"<p>x</p>", 1, "http://a.b/")
    text = gzip.decompress(data).decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.endswith("\r\n\r\n\r\n")
    for one in text.split("WARC/1.1\r\n")[1:]:
        head, _, rest = one.partition("\r\n\r\n")
        assert int(re.search(r"Content-Length: (\d+)\Z", head)[1]) == len(rest.encode()) - 4


def test_surt():
    assert op8_warc.surt("http://www.Example.com/a?b#c") == "com,example,www)/a?b"
    assert op8_warc.surt("http://x.org") == "org,x)/" and op8_warc.surt(None) == "" and op8_warc.surt("plain") == "plain"
