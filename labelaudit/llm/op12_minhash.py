"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A text's set has its distinct shingles of k words (ASCII letters lower-cased; fewer words: one shingle of all). Texts
with equal sets are one node (a 128-bit hash of the sorted 64-bit shingle hashes). A sketch takes one permutation: the
hash's high part names one of `BANDS` x `ROWS` bins, and each bin keeps its least hash. An empty bin takes the value of
the first filled bin that a hash of (bin, attempt) names, so that bins of sparse sets agree as independently as those of
full ones. Each band of bins is a bucket's key.

A bucket's candidates form a star: every node of it with the bucket's first one, so there are no more candidates than
nodes times bands. Whole sets decide about them. Stars alone can miss a link between two members that are both unlike
the centre, so buckets whose nodes aren't tied into one component by then are gone through again: sketches of nodes not
yet tied are compared within the bucket, a bounded tile of it at a time, and whole sets decide again; first each node
with the one that agrees best, at last all that are still apart. Buckets of more than `LARGE` nodes are first cut by each
node's other keys, as near nodes share two keys or more. So what a link can be missed by is chance in the sketch
alone: at a similarity of exactly 0.8 no band agrees with 5e-7, only one with 8e-6.

Null, empty and wordless texts have the empty set, linked with nothing: component_id is their own doc_id. Repeated rows
share a component unless their set is empty. A null doc_id never names a component; if no other row is reachable,
component_id and kept are null. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelaudit.llm.common import batch, discard, stored, text_chunks, text_frame, tune
from labelaudit.llm.op10_simhash import CHUNK_BYTES, components, distinct_hashes, near_pairs_of, range_counts, shingle_hashes
from labelaudit.llm.segments import mixed

SHINGLE, SEED = 4, 42
BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: Sketches compared in one piece, and nodes beyond which a bucket is cut by its nodes' other keys.
TILE, LARGE = 512, 4096
#: Equal bins, of all, of two nodes worth a comparison of sets: 0.8 less six standard deviations.
ENOUGH = int(BINS * 0.8 - 6 * (BINS * 0.8 * 0.2) ** 0.5)
#: Pairs of a node looked at in a tile, round by round: those tied by the best ones needn't be compared further. At last all.
PARTNERS = (1, None)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
U64 = np.uint64


def bin_minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows by bins: the least hash of each bin, EMPTY where a row has none. Each row's hashes are distinct and ascending."""
    rows = len(bounds) - 1
    out = np.full(rows * BINS, EMPTY)
    spread = mixed(hashes)  # the shingles' hash also orders sets; the permutation is one of its own
    bins = ((spread >> U64(32)) * U64(BINS)) >> U64(32)
    at = np.repeat(np.arange(rows), np.diff(bounds)) * BINS + bins.astype(np.int64)
    np.minimum.at(out, at, spread)
    return out.reshape(rows, BINS)


def densified(minima: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the first filled bin that a hash of bin and attempt names. A row without any stays."""
    out = minima.copy()
    row, empty = np.nonzero((minima == EMPTY) & (minima != EMPTY).any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        named = ((mixed((empty.astype(np.uint64) << U64(32)) + U64(attempt)) >> U64(32)) * U64(BINS)) >> U64(32)
        value = minima[row, named.astype(np.int64)]
        done = value != EMPTY
        out[row[done], empty[done]] = mixed(value[done] + U64(attempt))  # a copy isn't taken for the bin's own minimum
        row, empty = row[~done], empty[~done]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Rows by bands: a hash of each band's bins and of its place."""
    keys = np.tile(mixed(np.arange(BANDS, dtype=np.uint64) + U64(1)), (len(sketch), 1))
    for k in range(ROWS):
        keys = mixed(keys + sketch[:, k::ROWS])
    return keys


def prints(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """For each row doc_id, t (hash of the text), same (hash of the set), n, band keys, sketch bytes and counts by range of hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.string()), ("same", pa.binary()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            hashes, bounds = distinct_hashes(*shingle_hashes(buf, offs, shingle, seed))
            same = [xxhash.xxh3_128_digest(hashes[p:q]) for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            sketch = densified(bin_minima(hashes, bounds))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1) * BANDS, pa.int32()), pa.array(band_keys(sketch).ravel().view(np.int64)))
            small = (sketch & U64(255)).astype(np.uint8)
            yield batch(schema, rows.column("doc_id"), rows.column("t"), same, np.diff(bounds), keys, [x.tobytes() for x in small], [x.tobytes() for x in range_counts(hashes, bounds)])

    texts = docs.withColumn("t", F.md5("text"))
    return texts.mapInArrow(run, "doc_id long, t string, same binary, n long, keys array<long>, sketch binary, counts binary")


def star_edges(keyed: DataFrame, work: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b), each node of a bucket with the bucket's first; and the rows (key, node) of shared buckets."""
    hubs = stored(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1"), f"{work}/hubs")
    shared = stored(keyed.join(hubs, "key").select("key", "node", "hub"), f"{work}/shared")
    return shared.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), shared.select("key", "node")


def untied(members: DataFrame, roots: DataFrame, work: str) -> DataFrame:
    """Rows (key, node, root, members) of those buckets whose nodes aren't all of one component."""
    rooted = stored(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), f"{work}/rooted")
    parted = rooted.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high"))
    return rooted.join(stored(parted.where("low < high").select("key", "members"), f"{work}/parted"), "key")


def similar_sketches(placed: DataFrame, nodes: DataFrame, most: int | None, work: str) -> DataFrame:
    """Pairs (a, b) of nodes of different components in one bucket whose sketches agree enough, and counts by range don't rule them out; most: of each node and tile only those that agree best."""
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    sketched = placed.join(nodes.select("node", "n", "sketch", "counts"), "node").withColumns({"tiles": tiles, "tile": F.pmod(F.xxhash64("node", "key"), tiles).cast("int")})
    tiled = stored(sketched.groupBy("key", "tiles", "tile").agg(F.collect_list(F.struct("node", "root", "n", "sketch", "counts")).alias("x")), f"{work}/tiles")
    meeting = tiled.select("key", "tile", F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("other"))
    second = tiled.select("key", F.col("tile").alias("other"), F.col("x").alias("y"))
    pairs = meeting.join(tiled.select("key", "tile", "x"), ["key", "tile"]).join(second, ["key", "other"]).repartition(F.rand(7))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def side(rows) -> tuple[np.ndarray, ...]:
        x = rows.values
        sketch, counts = (np.frombuffer(b"".join(x.field(c).to_pylist()), np.uint8).reshape(len(x), -1) for c in ("sketch", "counts"))
        return (*(x.field(c).to_numpy() for c in ("node", "root", "n")), sketch, counts)

    def run(batches):
        for rows in batches:
            for one, two in zip(rows.column("x"), rows.column("y"), strict=True):
                (a, ra, na, sa, ca), (b, rb, nb, sb, cb) = side(one), side(two)
                found = []
                for k in range(len(a)):
                    fit = np.flatnonzero((rb != ra[k]) & (5 * np.minimum(nb, na[k]) >= 4 * np.maximum(nb, na[k])))
                    agree = np.count_nonzero(sb[fit] == sa[k], axis=1)
                    least = np.minimum(cb[fit], ca[k])
                    fine = (agree >= ENOUGH) & ((9 * least.sum(axis=1, dtype=np.int64) >= 4 * (nb[fit] + na[k])) | (least == 255).any(axis=1))
                    fit, agree = fit[fine], agree[fine]
                    if most is not None and len(fit) > most:
                        fit = fit[np.argsort(-agree, kind="stable")[:most]]
                    found.append(np.stack([np.minimum(a[k], b[fit]), np.maximum(a[k], b[fit])]))
                both = np.unique(np.concatenate(found, axis=1), axis=1)
                yield batch(schema, both[0], both[1])

    return pairs.select("x", "y").mapInArrow(run, "a long, b long").distinct()


def near_sets(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs: links have 0.8 or more of both sets' shingles in common."""
    tune(docs.sparkSession)
    work = f"near-sets-{uuid.uuid4().hex}"  # tables that only the search itself reads
    texts = text_frame(docs)
    drawn = stored(prints(texts, shingle, seed), f"{work}/prints")
    one = F.min(F.struct("t", "n", "keys", "sketch", "counts"))
    nodes = drawn.where("n > 0").groupBy("same").agg(F.min("doc_id").alias("first"), one.alias("s"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "same", "first", "s.*"), f"{work}/nodes")

    keyed = nodes.select("node", F.explode("keys").alias("key"))
    met, members = star_edges(keyed, work)
    met = stored(met, f"{work}/met")
    near = near_pairs_of(met, texts, nodes, shingle, seed, work)
    roots = components(near, f"{work}/components")

    for most in PARTNERS:
        rest = stored(untied(members, roots, work), f"{work}/untied")
        large = rest.where(F.col("members") > LARGE)
        if not large.isEmpty():
            cut = large.join(nodes.select("node", "keys"), "node").select("node", F.col("key").alias("old"), F.explode("keys").alias("other"))
            cut = cut.where("old != other").select(F.xxhash64("old", "other").alias("key"), "node")
            rest = stored(rest.where(F.col("members") <= LARGE).unionByName(untied(cut, roots, work)), f"{work}/untied")
        more = stored(similar_sketches(rest, nodes, most, work).join(met, ["a", "b"], "left_anti"), f"{work}/more")
        found = near_pairs_of(more, texts, nodes, shingle, seed, work)
        met, near, members = met.unionByName(more), near.unionByName(found), rest.select("key", "node")
        if not found.isEmpty():
            roots = components(near, f"{work}/components")

    rooted = stored(nodes.join(roots, "node", "left").select("same", "first", F.coalesce("root", "node").alias("root")), f"{work}/roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("same", "component_id")
    out = drawn.select("doc_id", "same", F.col("n").alias("n_shingles")).join(named, "same", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = stored(out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")), "near-sets-result")
    discard(docs.sparkSession, work)
    return out
