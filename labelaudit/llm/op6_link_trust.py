"""URL filter: host and path rules, and link-graph propagation where no rule fits.

The rule that fits a url and is longest decides. Other urls get the verdict of their host: personalised PageRank
carries trust from hosts with pages that the rules allow along host edges, and distrust from hosts with pages that the
rules block along the same edges reversed (who links to blocked hosts is suspect); a host's weight as a seed is the
share of its pages that are allowed or blocked. Host edges are the
hyperlinks of pages to other hosts, weighted by their number of pages, and ties in both directions between a host and
the domains above it (of two parts at least), which are nodes whether or not they have pages, so hosts of one domain
are two steps apart. Both scores are scaled to a mean of 1 over all hosts; a host is
blocked if its distrust reaches `THRESHOLD` and exceeds its trust.

Everything is a DataFrame job: links are counted per pair of hosts before the shuffle, so a host with a third of all
pages is one row a pair. Rounds go on until the scores settle, so distance from a seed doesn't matter. A round is a
join and a sum; every four rounds the scores are written to the shared folder, and of them only their summed change
goes to the driver. Links of hubs are salted.

Null urls and urls without :// have empty host and path and no rule; hosts without score are allowed. Null html has no
links. Repeated rows are judged each. Equally long rules: the first given wins. An empty table gives no rows. Columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelaudit.llm.common import stored

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A guard only: at the damping and tolerance below scores settle in at most about 120 rounds.
ROUNDS, DAMPING, THRESHOLD = 1000, 0.85, 0.5
#: Scores are settled when a round changes them by less than this share of their sum.
TOLERANCE = 1e-8
#: Parts into which a host's pages are dealt for the join with its scores.
SALTS = 16
#: Rounds from one written table of scores to the next.
CHAIN = 4
#: Links of a node in one salt.
HUB = 1 << 20
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def judged_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, rule_verdict."""
    host, path = host_and_path(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return placed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """src, dst, weight: hyperlinks between hosts, and ties between a host and the domains above it."""
    host, _ = host_and_path(F.col("url"))
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    linked = pages.where(F.col("html").contains("//")).select(host.alias("src"), F.explode(found).alias("dst")).where("src != '' and src != dst")
    linked = linked.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.concat_ws(".", F.slice(parts, n, F.size(parts))))
    ties = hosts.where("host != ''").where(F.size(parts) > 2).select("host", F.explode(above).alias("domain"))
    ties = ties.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("domain").alias("dst")), F.struct(F.col("domain").alias("src"), F.col("host").alias("dst")))).alias("e"))
    ties = ties.select("e.*", F.lit(1.0).alias("weight"))
    return linked.unionByName(ties).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def links_and_nodes(edges: DataFrame, seeds: DataFrame, damping: float, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """Links with the share of a score that they carry, and a row of its own for each node that holds its seed.

    Links of a node with more than hub links are dealt over salts; `salts` says how many its score must be copied to.
    """
    total = edges.groupBy("kind", "host").agg(F.sum("weight").alias("out"), F.ceil(F.count("*") / hub).cast("int").alias("salts"))
    part = (F.col("weight") / F.col("out") * damping).alias("part")
    salt = F.pmod(F.xxhash64("next"), F.col("salts")).cast("int").alias("salt")
    none = F.lit(None)
    moved = edges.join(total, ["kind", "host"]).select("kind", "host", salt, "next", part, none.cast("double").alias("back"), none.cast("int").alias("salts"))
    named = edges.select("kind", F.col("next").alias("host"), F.lit(0.0).alias("seed"), F.lit(1).alias("salts"))
    named = named.unionByName(seeds.select("kind", "host", "seed", F.lit(1).alias("salts"))).unionByName(total.select("kind", "host", F.lit(0.0).alias("seed"), "salts"))
    nodes = named.groupBy("kind", "host").agg(F.sum("seed").alias("seed"), F.max("salts").alias("salts"))
    own = nodes.select("kind", "host", F.lit(0).alias("salt"), F.col("host").alias("next"), F.lit(0.0).alias("part"), (F.col("seed") * (1 - damping)).alias("back"), "salts")
    start = nodes.select("kind", "host", F.col("seed").alias("score"), F.col("seed").alias("old"), F.col("seed").alias("older"), "salts")
    return moved.unionByName(own), start


def next_scores(state: DataFrame, links: DataFrame) -> DataFrame:
    """One round: a join and a sum; a node's own row brings its seed and keeps the scores of the two rounds before."""
    copies = state.select("kind", "host", "score", "old", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = copies.join(links.hint("merge"), ["kind", "host", "salt"])
    own = F.col("back").isNotNull()
    sent = both.select(
        "kind", F.col("next").alias("host"), "salts", (F.col("score") * F.col("part") + F.coalesce("back", F.lit(0.0))).alias("new"),
        F.when(own, F.col("score")).alias("was"), F.when(own, F.col("old")).alias("before"),
    )
    return sent.groupBy("kind", "host").agg(F.sum("new").alias("score"), F.sum("was").alias("old"), F.sum("before").alias("older"), F.max("salts").alias("salts"))


def settled(links: DataFrame, state: DataFrame, limit: float, rounds: int, damping: float) -> DataFrame:
    """kind, host, score: chains of rounds, a written table after each, until the last round changes scores by no more than limit.

    After the first chain scores are extrapolated over two rounds once: what goes to and fro between a host and its
    domains shrinks by damping**2 in two rounds, so its rest is a geometric series. Further rounds settle all else.
    """
    for done in range(0, rounds, CHAIN):
        for _ in range(min(CHAIN, rounds - done)):
            state = next_scores(state, links)
        state = stored(state, "host-scores")
        if (state.agg(F.sum(F.abs(F.col("score") - F.col("old")))).head()[0] or 0.0) <= limit:
            break
        if done == 0 and CHAIN < rounds:
            ahead = F.col("score") + damping**2 / (1 - damping**2) * (F.col("score") - F.col("older"))
            state = state.withColumn("score", ahead)
    else:
        raise RuntimeError(f"scores of hosts haven't settled in {rounds} rounds")
    return state.select("kind", "host", "score")


def host_scores(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING, hub: int = HUB) -> DataFrame:
    """host, trust, distrust: both with a mean of about 1 over hosts, 0 without a seed."""
    judged = judged_pages(pages, rules)
    hosts = stored(
        judged.groupBy("host").agg(
            F.count("*").alias("pages"),
            F.count_if(F.col("rule_verdict") == "allow").alias("allowed"),
            F.count_if(F.col("rule_verdict") == "block").alias("blocked"),
        ),
        "hosts",
    )
    one_way = host_edges(pages, hosts)
    edges = one_way.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("next"), "weight")
    edges = edges.unionByName(one_way.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("next"), "weight"))
    edges = stored(edges, "host-edges")
    share = lambda c, kind: hosts.where(f"host != '' and {c} > 0").select(F.lit(kind).alias("kind"), "host", (F.col(c) / F.col("pages")).alias("w"))
    seeds = share("allowed", "trust").unionByName(share("blocked", "distrust"))
    sums = {r["kind"]: r["w"] for r in seeds.groupBy("kind").agg(F.sum("w").alias("w")).collect()}
    n = hosts.count()
    scale = F.when(F.col("kind") == "trust", n / (sums.get("trust") or 1.0)).otherwise(n / (sums.get("distrust") or 1.0))
    seeds = stored(seeds.select("kind", "host", (F.col("w") * scale).alias("seed")), "host-seeds")
    state = seeds.select("kind", "host", F.col("seed").alias("score"))
    if sums:
        links, start = links_and_nodes(edges, seeds, damping, hub)
        state = settled(stored(links, "host-links"), stored(start, "host-scores"), TOLERANCE * n, rounds, damping)
    return state.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
    )


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    scores = host_scores(pages, rules, rounds)
    # a host may have a third of all pages: both sides are salted
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = judged_pages(pages, rules).withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    out = salted.join(scores.select("*", salts), ["host", "salt"], "left")
    suspect = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce("rule_verdict", F.when(suspect, "block").otherwise("allow"))
    return out.select(
        F.col("page_id").cast("long").alias("page_id"),
        "host",
        "path",
        "rule",
        verdict.alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
