"""Link trust far from any seed."""

import pytest

from labelaudit.llm import op6_link_trust

N = 12


@pytest.fixture(scope="module")
def chain(spark):
    """h0 links to h1 and so on to a blocked host, which has many pages, so that the mean of 1 leaves much for the chain."""
    hosts = [f"h{k}.info" for k in range(N)]
    ways = [*hosts[1:], "bad.net"]
    rows = [(f"http://{a}/", f'<a href="http://{b}/">x</a>') for a, b in zip(hosts, ways, strict=True)]
    rows += [(f"http://lone{k}.info/", "") for k in range(40)] + [("http://bad.net/", "")]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")


@pytest.mark.parametrize("hub", [op6_link_trust.HUB, 1])
def test_scores_are_the_converged_ones(chain, hub):
    found = {r["host"]: r["distrust"] for r in op6_link_trust.host_scores(chain, hub=hub).collect()}
    total = N + 41
    for k in range(N):
        assert found[f"h{k}.info"] == pytest.approx(0.15 * total * 0.85 ** (N - k), abs=1e-9)


def test_distrust_reaches_the_far_end(chain):
    verdicts = {r["host"]: r["verdict"] for r in op6_link_trust.filter_urls(chain).collect()}
    assert all(verdicts[f"h{k}.info"] == "block" for k in range(N))
    assert verdicts["lone0.info"] == "allow"


def test_cycles_and_hubs_against_plain_iteration(spark):
    """A ring of four, whose rounds no extrapolation shortens, a hub that all link to, and hosts below one domain."""
    ring = [(f"ring{k}.info", f"ring{(k + 1) % 4}.info") for k in range(4)]
    pairs = ring + [(f"leaf{k}.info", "hub.info") for k in range(9)] + [("hub.info", "ring0.info"), ("ring2.info", "bad.net"), ("leaf3.info", "bad.net")]
    rows = [(f"http://{a}/", f'<a href="http://{b}/">x</a>') for a, b in pairs] + [("http://bad.net/", ""), ("http://s.one.info/", ""), ("http://t.one.info/", "")]
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    hosts = {a for a, _ in pairs} | {"bad.net", "s.one.info", "t.one.info"}
    edges = {(b, a): 1.0 for a, b in pairs} | {e: 1.0 for h in ("s.one.info", "t.one.info") for e in ((h, "one.info"), ("one.info", h))}
    seed = {"bad.net": float(len(hosts))}
    out, score = {}, dict(seed)
    for (a, _), w in edges.items():
        out[a] = out.get(a, 0.0) + w
    for _ in range(300):
        new = {h: 0.15 * w for h, w in seed.items()}
        for (a, b), w in edges.items():
            new[b] = new.get(b, 0.0) + 0.85 * score.get(a, 0.0) * w / out[a]
        score = new
    for hub in (op6_link_trust.HUB, 2):
        found = {r["host"]: r["distrust"] for r in op6_link_trust.host_scores(pages, hub=hub).collect()}
        assert found.keys() >= score.keys()
        for h, x in found.items():
            assert x == pytest.approx(score.get(h, 0.0), abs=1e-5)
