"""SimHash near-duplicates: fingerprints, tiled exact comparison, connected components.

Fingerprints: words of a lower-cased text (ASCII letters only), k-word shingles joined by one space, XXH64 of each,
and a bit is 1 if more than half of the shingles' hashes have it. Fewer than k words are one shingle; none gives 0.

Linking is exact. Equal fingerprints are one node first, so copies never meet as pairs. Two fingerprints at most r bits
apart agree on m - r of m blocks of bits, so comparing within groups that share some m - r blocks finds every link; m
is chosen from the number of nodes so that the expected comparisons stay small (more nodes, longer keys). Each group
is sorted by bit count and cut into tiles; pairs of tiles whose bit counts differ by more than r are skipped and the
rest compared with numpy exclusive-or and bit counts. A group beyond `GROUP` nodes is cut into tiles of one bit count
that Spark deals out, so it never lies in one task. A comparison returns links that keep its members connected, not all
pairs. Components come from alternating star contraction, whose rounds are written to the shared folder.

Null text is empty. Rows with no words are linked like any other (fingerprint 0). Repeated rows share a component. A
null doc_id never names a component; if no other row is reachable, component_id is null. An empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelaudit.llm.common import batch, discard, stored, text_chunks, text_frame, tune
from labelaudit.llm.segments import SEPARATOR, gather, row_bounds, words

SHINGLE, RADIUS, SEED = 4, 4, 42
CHUNK_BYTES = 1 << 20
#: Nodes of a group compared in one task, and of a tile.
GROUP, TILE = 4096, 1024
BLOCK = 1 << 16  # shingles whose bits are counted at a time
#: For near copies: the words of a shingle and the least similarity of their sets, as a fraction.
COPY_SHINGLE, COPY_SIMILARITY = 5, (4, 5)
#: Texts looked at for frequent shingles, and the most of those kept; they set the order of shingles, not the result.
SAMPLE_TEXTS, FREQUENT = 20_000, 1 << 17


def bit_majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row's hashes the word of bits that over half of them have; 0 for none."""
    rows = len(bounds) - 1
    counts = np.zeros((rows, 64), np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[at : at + BLOCK]).astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(bounds, at, side="right")) - 1
        last = int(np.searchsorted(bounds, at + len(part), side="left"))
        cut = np.clip(bounds[first : last + 1] - at, 0, len(part))
        filled = np.flatnonzero(cut[1:] > cut[:-1])
        counts[first + filled] += np.add.reduceat(bits, cut[filled], axis=0, dtype=np.uint32)
    over = (2 * counts > np.diff(bounds)[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every row, and where each row's begin."""
    starts, ends = words(buf, offs)
    lengths = ends - starts
    # the words once more, lower-cased, with one space after each
    places = np.cumsum(lengths + 1) - (lengths + 1)
    flat = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    flat[gather(places, lengths)] = buf[~SEPARATOR[buf]]
    flat[(flat >= 0x41) & (flat <= 0x5A)] += 0x20
    bounds = row_bounds(starts, offs)
    n = np.diff(bounds)
    shingles = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    first = gather(bounds[:-1], shingles)
    last = np.minimum(first + shingle, np.repeat(bounds[1:], shingles)) - 1
    data, xxh = flat.tobytes(), xxhash.xxh64_intdigest
    begin, end = places[first].tolist(), (places[last] + lengths[last]).tolist()
    hashes = np.fromiter((xxh(data[a:b], seed) for a, b in zip(begin, end, strict=True)), np.uint64, len(begin))
    return hashes, np.concatenate([[0], np.cumsum(shingles)])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and the 64-bit fingerprint, as a signed long, of each row."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            yield batch(schema, rows.column("doc_id"), bit_majority(*shingle_hashes(buf, offs, shingle, seed)).view(np.int64))

    return text_frame(docs).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of every choice of blocks - radius blocks of bits."""
    cut = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << cut[k + 1]) - 1) ^ ((1 << cut[k]) - 1) for k in range(blocks)]
    return [sum(masks[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def choose_blocks(nodes: int, radius: int) -> int:
    """The number of blocks with the least expected work: copies of nodes made, and pairs compared."""

    def work(m: int) -> float:
        keys = comb(m, radius)
        return keys * nodes * (1000 + nodes / 2 ** (64 * (m - radius) // m))

    return min(range(radius + 1, radius + 5), key=work)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place connected to each of n places."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_of(fps: np.ndarray, radius: int, other: np.ndarray | None = None, tile: int = TILE, near: bool = False) -> np.ndarray:
    """Links within one array, or between two, that connect what is connected: pairs of fingerprints.

    near: pairs that are themselves at most radius bits apart, the first such partner on either side of each fingerprint.
    """
    both = fps if other is None else np.concatenate([fps, other])
    counts = np.bitwise_count(both).astype(np.int64)
    order = np.argsort(counts, kind="stable")
    pool, counts = both[order], counts[order]
    side = order >= len(fps)
    froms, tos = [], []
    for i in range(0, len(pool), tile):
        top = counts[min(i + tile, len(pool)) - 1]
        for j in range(i, len(pool), tile):
            if counts[j] - top > radius:
                break  # sorted: all later tiles differ by more
            a, b = near_pairs(pool[i : i + tile], pool[j : j + tile], radius)
            a, b = a + i, b + j
            keep = a < b
            if other is not None:
                keep &= side[a] != side[b]
            froms.append(a[keep])
            tos.append(b[keep])
    if not froms:
        return np.zeros((0, 2), np.uint64)
    if near:
        a, b = np.concatenate(froms), np.concatenate(tos)
        firsts = np.unique(np.concatenate([np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]]))
        return np.stack([pool[a[firsts]], pool[b[firsts]]], 1)
    label = connected(len(pool), np.concatenate(froms), np.concatenate(tos))
    at = np.flatnonzero(label != np.arange(len(pool)))
    return np.stack([pool[at], pool[label[at]]], 1)


def block_keys(nodes: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """k, part and fp: a row for each choice of blocks of bits of each node; links share one of them at least."""
    masks = block_masks(blocks or choose_blocks(nodes.count(), radius), radius)
    parts = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for k, m in enumerate(masks)]
    return nodes.select("fp", F.explode(F.array(*parts)).alias("key")).select("key.k", "key.part", "fp")


def links(keyed: DataFrame, radius: int = RADIUS, group: int = GROUP, near: bool = False) -> DataFrame:
    """Links (a, b) between fingerprints of one group (k, part), enough to connect all at most radius bits apart.

    near: see links_of.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    large = keyed.groupBy("k", "part").count().where(F.col("count") > group)
    keyed = keyed.join(large, ["k", "part"], "left")
    # groups of one task
    small = keyed.where(F.col("count").isNull()).groupBy("k", "part").agg(F.collect_list("fp").alias("one")).where(F.size("one") > 1)

    def found(one: pa.Array, two: pa.Array | None = None) -> np.ndarray:
        a, b = (None if x is None else x.to_numpy().view(np.uint64) for x in (one, two))
        return links_of(a, radius, b, near=near)

    def rows_of(pairs: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate([np.zeros((0, 2), np.uint64), *pairs])
        return batch(schema, *(np.ascontiguousarray(both[:, k]).view(np.int64) for k in (0, 1)))

    def within(batches):
        for rows in batches:
            yield rows_of([found(x.values) for x in rows.column("one")])

    # large groups: tiles of one bit count and a bounded size, and the pairs of them within the radius
    tiled = (
        keyed.where(F.col("count").isNotNull())
        .withColumn("ones", F.bit_count("fp"))
        .withColumn("sub", F.pmod(F.xxhash64("fp"), F.ceil(F.col("count") / TILE)).cast("int"))
        .groupBy("k", "part", "ones", "sub")
        .agg(F.collect_list("fp").alias("fps"))
    )
    left, right = tiled.alias("l"), tiled.alias("r")
    meet = (F.col("l.k") == F.col("r.k")) & (F.col("l.part") == F.col("r.part"))
    meet &= F.col("r.ones").between(F.col("l.ones"), F.col("l.ones") + radius)
    meet &= (F.col("l.ones") < F.col("r.ones")) | (F.col("l.sub") <= F.col("r.sub"))
    same = (F.col("l.ones") == F.col("r.ones")) & (F.col("l.sub") == F.col("r.sub"))
    pairs = left.join(right, meet).select(F.col("l.fps").alias("one"), F.when(~same, F.col("r.fps")).alias("two"))

    def between(batches):
        for rows in batches:
            for one, two in zip(rows.column("one"), rows.column("two"), strict=True):
                yield rows_of([found(one.values, two.values if two.is_valid else None)])

    out = "a long, b long"
    return small.select("one").mapInArrow(within, out).unionByName(pairs.repartition(F.rand(5)).mapInArrow(between, out)).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root (its component's smallest node) for each node of edges (a, b), by alternating star contraction."""
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = stored(edges.where("a != b").select(high.alias("a"), low.alias("b")).distinct(), name)
    seen = None
    while True:
        # large star: every larger neighbour is tied to the smallest neighbour
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour, and the node, are tied to the smallest
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = stored(small.select("e.*").where("a != b").distinct(), name)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs."""
    prints = stored(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(block_keys(nodes, radius), radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def distinct_hashes(hashes: np.ndarray, bounds: np.ndarray, late: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, ascending, those in late (sorted) after all others; and where each row's begin."""
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    keys = [hashes, row]
    if late is not None and len(late):
        keys.insert(1, late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes)
    order = np.lexsort(keys)
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=rows))]).astype(np.int64)


def prefix_lengths(n: np.ndarray) -> np.ndarray:
    """How many shingles, first in a common order, two sets of the least similarity can't both be without a common one."""
    up, down = COPY_SIMILARITY
    return np.where(n > 0, n - -(-up * n // down) + 1, 0)


def frequent_shingles(texts: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """Hashes, sorted, of shingles that many of a bounded sample of the distinct texts have."""
    step = max(1, -(-texts.count() // SAMPLE_TEXTS))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).groupBy(F.md5("text")).agg(F.first("text").alias("text"))

    def run(batches):
        for _, buf, offs in text_chunks(batches, CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(distinct_hashes(*shingle_hashes(buf, offs, shingle, seed))[0].view(np.int64))], names=["h"])

    counted = some.select("text").mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= max(4, -(-64 // step)))
    top = counted.orderBy(F.desc("count"), "h").limit(FREQUENT).select("h").toArrow()
    return np.sort(top.column("h").to_numpy().view(np.uint64))


def may_be_near(a: str, b: str) -> Column:
    """No certain sign against the least similarity: sizes n, and the places i of a shingle taken for the first common one."""
    up, down = COPY_SIMILARITY
    n, m, i, j = (F.col(f"{x}.{c}") for c in "ni" for x in (a, b))
    return (down * F.least(n, m) >= up * F.greatest(n, m)) & ((up + down) * F.least(n - i, m - j) >= up * (n + m))


def range_counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of each row's hashes lie in each of 256 equal ranges, 255 for more."""
    rows = len(bounds) - 1
    at = np.repeat(np.arange(rows), np.diff(bounds)) * 256 + (hashes >> np.uint64(56)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=rows * 256), 255).astype(np.uint8).reshape(rows, 256)


def not_ruled_out(pairs: DataFrame, nodes: DataFrame, work: str) -> DataFrame:
    """Pairs without those whose sets can't have enough in common: in no range more than the smaller of both counts."""
    up, down = COPY_SIMILARITY
    of = lambda c, x: nodes.select(F.col("node").alias(c), F.struct("n", "counts").alias(x))

    def run(batches):
        for rows in batches:
            x, y = ([np.frombuffer(b"".join(rows.column(c).field("counts").to_pylist()), np.uint8).reshape(-1, 256)] + [rows.column(c).field("n").to_numpy()] for c in "xy")
            least = np.minimum(x[0], y[0])
            may = ((up + down) * least.sum(1, dtype=np.int64) >= up * (x[1] + y[1])) | (least == 255).any(1)
            yield rows.select(["a", "b"]).filter(pa.array(may))

    return stored(pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), f"{work}/possible-pairs")


def near_pairs_of(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, seed: int, work: str) -> DataFrame:
    """Those of pairs (a, b) of nodes whose sets of shingles, taken anew from their texts, have the least similarity."""
    up, down = COPY_SIMILARITY
    pairs = not_ruled_out(pairs, nodes, work)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "t"), "node")
    # one text for each node; texts without a pair are not hashed again
    held = texts.withColumn("t", F.md5("text")).join(wanted, "t").groupBy("node").agg(F.first("text").alias("text"))
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            hashes, bounds = distinct_hashes(*shingle_hashes(buf, offs, shingle, seed))
            data, at = memoryview(hashes.view(np.uint8)), (8 * bounds).tolist()
            yield batch(schema, rows.column("node"), [bytes(data[p:q]) for p, q in zip(at[:-1], at[1:], strict=True)])

    sets = stored(held.mapInArrow(run, "node long, hashes binary"), f"{work}/sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")

    def compare(batches):
        for rows in batches:
            near = []
            for x, y in zip(rows.column("x"), rows.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                common = np.count_nonzero(merged[1:] == merged[:-1])
                near.append((up + down) * common >= up * (len(x) + len(y)))
            yield rows.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return stored(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), f"{work}/near-pairs")


def fingerprint_pairs(nodes: DataFrame, work: str, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints fp are at most radius bits apart: of each fingerprint its first node.

    All other nodes of a fingerprint are paired with its first.
    """
    named = stored(nodes.groupBy("fp").agg(F.min("node").alias("lead")), f"{work}/fingerprints")
    first = lambda fp, c: named.select(F.col("fp").alias(fp), F.col("lead").alias(c))
    apart = links(block_keys(named.select("fp"), radius), radius, near=True).join(first("a", "x"), "a").join(first("b", "y"), "b").select("x", "y")
    alike = nodes.select("node", "fp").join(named, "fp").where("node != lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))
    return apart.unionByName(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def copy_roots(docs: DataFrame, shingle: int = COPY_SHINGLE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """For each row of docs doc_id, t (hash of its text) and same (hash of its set of shingles); and the root of each same.

    Roots are equal for texts tied by links: sets of five-word shingles that overlap in 0.8 or more. Every such pair is
    found, and a link is a comparison of whole sets. Candidates are first the pairs whose fingerprints, of the shingles in
    their sets, are at most RADIUS bits apart. Sets alike in 0.8 may be further apart than that; these share a shingle.
    Shingles have one order in all texts (frequent ones last, then by hash); two sets alike in 0.8 have a common shingle
    within the first fifth of each. Candidates are the pairs with such a shingle whose sizes and places of it don't rule
    0.8 out. Of those that fingerprints haven't tied, first each text meets the next and the first one with the same
    shingle, which ties large groups; then all pairs that are not tied yet.
    """
    tune(docs.sparkSession)
    work = f"near-copies-{uuid.uuid4().hex}"  # tables that only the search itself reads
    texts = text_frame(docs).withColumn("text", F.coalesce("text", F.lit("")))
    late = frequent_shingles(texts, shingle, seed)
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.string()), ("same", pa.binary()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("counts", pa.binary())])

    def run(batches):
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            hashes, bounds = shingle_hashes(buf, offs, shingle, seed)
            whole, ends = distinct_hashes(hashes, bounds)
            same = [xxhash.xxh3_128_digest(whole[p:q]) for p, q in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            distinct, cuts = distinct_hashes(hashes, bounds, late)
            n = np.diff(cuts)
            first = prefix_lengths(n)
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first)]), pa.int32()), pa.array(distinct[gather(cuts[:-1], first)].view(np.int64)))
            counts = [x.tobytes() for x in range_counts(distinct, cuts)]
            yield batch(schema, rows.column("doc_id"), rows.column("t"), same, n, bit_majority(whole, ends).view(np.int64), keys, counts)

    drawn = texts.withColumn("t", F.md5("text")).mapInArrow(run, "doc_id long, t string, same binary, n long, fp long, keys array<long>, counts binary")
    prints = stored(drawn, "prints")
    nodes = prints.groupBy("same").agg(F.min("doc_id").alias("first"), F.min(F.struct("t", "n", "fp", "keys", "counts")).alias("s"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "same", "first", "s.*"), f"{work}/nodes")

    close = near_pairs_of(fingerprint_pairs(nodes, work), texts, nodes, shingle, seed, work)
    tied = components(close, f"{work}/components")

    keyed = nodes.select("node", "first", "n", F.posexplode("keys").alias("i", "h"))
    group = Window.partitionBy("h").orderBy("first", "node")
    member = F.struct("node", "n", "i")
    beside = keyed.withColumns({"next": F.lead(member).over(group), "hub": F.first(member).over(group)})
    shared = stored(beside.where("next is not null or hub.node != node").select("h", member.alias("one"), "next", "hub"), f"{work}/shared-shingles")
    ordered = [F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b")]
    met = shared.select("one", F.explode(F.array("next", "hub")).alias("two")).where("two is not null and one.node != two.node")
    met = met.where(may_be_near("one", "two")).select(*ordered).distinct()
    of = lambda c: tied.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = ~F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))
    met = stored(met.join(of("a"), "a", "left").join(of("b"), "b", "left").where(apart).select("a", "b"), f"{work}/met")
    near = close.unionByName(near_pairs_of(met, texts, nodes, shingle, seed, work))
    roots = components(near, f"{work}/components")
    placed = shared.select("h", "one", F.col("one.node").alias("node")).join(roots, "node", "left").select("h", "one", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    placed = stored(placed.join(mixed, "h"), f"{work}/untied")
    other = placed.select("h", F.col("one").alias("two"), F.col("root").alias("its"))
    rest = placed.join(other, "h").where((F.col("root") < F.col("its")) & may_be_near("one", "two")).select(*ordered).distinct()
    rest = stored(rest.join(met, ["a", "b"], "left_anti"), f"{work}/rest")
    more = near_pairs_of(rest, texts, nodes, shingle, seed, work)
    if not more.isEmpty():
        roots = components(near.unionByName(more), f"{work}/components")

    rooted = stored(nodes.join(roots, "node", "left").select("same", "first", F.coalesce("root", "node").alias("root")), "rooted")
    discard(docs.sparkSession, work)
    return prints.select("doc_id", "t", "same"), rooted


def near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and component_id (the smallest doc_id tied to it) for each row of docs, by the links of copy_roots."""
    prints, rooted = copy_roots(docs, shingle, seed)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.select("doc_id", "same").join(rooted.join(least, "root").select("same", "component_id"), "same").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, then with the smallest hash of its text.

    Rows are told apart by doc_id and text, so unlike texts under one doc_id are judged each by itself. Of rows alike in
    both, one stays; rows without a doc_id come after all others of their group.
    """
    prints, rooted = copy_roots(docs)
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "t")
    classes = stored(prints.groupBy("doc_id", "t", "same").count().join(rooted.select("same", "root"), "same"), "copy-classes")
    firsts = classes.groupBy("root").agg(F.min(place).alias("first"))
    judged = classes.join(firsts, "root").withColumn("goes", place != F.col("first")).where("goes or count > 1")
    judged = stored(judged.select(F.col("doc_id").alias("its_id"), F.col("t").alias("its_t"), "goes"), "judged-copies")
    if judged.isEmpty():
        return docs
    # names that no column of docs has; all columns of docs stay as they are
    row = F.struct(*[_quoted(c) for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("own_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_t"))
    # ids alone part the rows that nothing is said about from the few others, so texts needn't be shuffled for them
    ids = judged.where("its_id is not null").select(F.col("its_id").alias("own_id")).distinct()
    untouched = keyed.where("own_id is not null").join(ids, "own_id", "left_anti").select("row")
    others = keyed.join(ids, "own_id", "left_semi").select("row", "own_id", "own_t").unionByName(keyed.where("own_id is null"))
    same = F.col("own_id").eqNullSafe(F.col("its_id")) & (F.col("own_t") == F.col("its_t"))
    stays = others.join(judged.where("goes"), same, "left_anti")
    again = judged.where("not goes")
    if again.isEmpty():
        return untouched.unionByName(stays.select("row")).select("row.*")
    one = stays.join(again, same, "left_semi").groupBy("own_id", "own_t").agg(F.first("row").alias("row")).select("row")
    return untouched.unionByName(stays.join(again, same, "left_anti").select("row")).unionByName(one).select("row.*")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`").alias(name)
