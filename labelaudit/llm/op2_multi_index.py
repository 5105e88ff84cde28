"""Approximate nearest neighbours with an inverted multi-index.

A vector's two halves are quantised separately, each by `k` centroids; the pair of centroids is its cell. A query walks
the pairs in ascending order of summed distance with a heap, and the vectors of the cells visited, no others, are
reranked by their exact Euclidean distance in double precision. Vectors as near as the last one taken all count, so
ties are decided by id.

Centroids are fitted on at most `TRAIN_ROWS` distinct vectors (those with the smallest hashes). A walk ends by its own
query: the summed distance of the farthest cell of the query's `WITNESSES` nearest sample vectors says in which cells
its neighbours lie, and cells are visited up to `reach` times that, and until they hold more vectors than are asked
for. The factor is the least with which `TARGET` of the true nearest neighbours of `FIT_QUERIES` vectors are found (those
next in the order of hashes, which no centroid was fitted to; if the sample is all vectors, some of them). They are
looked for among all vectors, in one pass: how far they lie beyond the sample's own can't be told from the sample. So a
query in a cluster visits few cells; vectors without structure need about half of them. Every vector is indexed.

Equal vectors are one entry with the ids that can matter (the k + 1 smallest), so a vector that a third of all rows
share is one candidate. Entries lie in blocks: one first-half centroid, and at most about `BLOCK` entries by hash;
queries meet a block once, in parts of their own, and keep their k + 1 best of it. What queries ask grows with their
number times that of centroids, so blocks and questions are shuffled to each other and merged; nothing of either goes
through the driver, which holds the sample, the codebooks and the number of entries in each cell.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
null ids. Ties go to the smaller id. A repeated row counts once. Fewer candidates than k give fewer rows, an empty
table none. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelaudit.llm.common import batch, partitions, stored, tune
from labelaudit.llm.segments import gather

TRAIN_ROWS, BLOCK, QUERY_BLOCK, TARGET, MOST_CENTROIDS = 8192, 2048, 1024, 0.97, 1024
#: Nearest sample vectors that tell a query's cells, and queries that the factor is fitted to.
WITNESSES, FIT_QUERIES = 8, 512
#: Differences of squared distances that count as rounding, in parts of the squared lengths.
ROUNDING = 1e-11
ROUNDS = 10
#: Queries whose walks, and pairs of vectors whose differences, are held at once.
WALKS, DIFFERENCES = 32, 1 << 16


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<float>) of the rows that take part."""
    v = F.col("v")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    fine = fine.where(
        F.col("vec_id").isNotNull()
        & v.isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    sizes = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    centroids = np.unique(x, axis=0)
    centroids = centroids[np.linspace(0, len(centroids) - 1, min(k, len(centroids))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        full = count > 0
        centroids[full] = total[full] / count[full, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, least: int, within: float = np.inf) -> list[tuple[int, int]]:
    """Filled cells in ascending order of first[i] + second[j], up to a sum, and until they hold at least so many entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, out, held = [(x[0] + y[0], 0, 0)], [], 0
    while heap and (held < least or heap[0][0] <= within):
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]), int(b[j])
        n = counts[cell]
        if n:
            out.append(cell)
            held += int(n)
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


class MultiIndex:
    """Two codebooks, the sample they come from, and how far walks reach."""

    def __init__(self, sample: np.ndarray, entries: int, near: int, target: float = TARGET):
        self.half = sample.shape[1] // 2
        k = int(np.clip(np.sqrt(entries / 8), 2, MOST_CENTROIDS))
        self.books = [kmeans(part, k) for part in self.halves(sample)]
        self.sample, self.cells = sample, self.codes(sample)
        self.reach = np.inf
        if len(sample) > max(near, WITNESSES) + 1:
            q = sample[np.linspace(0, len(sample) - 1, min(FIT_QUERIES, len(sample))).astype(int)]
            truth = np.argsort(squared(q, sample), axis=1, kind="stable")[:, 1 : near + 1]
            self.fit(q, np.repeat(np.arange(len(q)), truth.shape[1]), *(c[truth.ravel()] for c in self.cells), target)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(nearest(part, book) for part, book in zip(self.halves(x), self.books, strict=True))

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        some = [slice(at, at + WALKS) for at in range(0, max(len(x), 1), WALKS)]
        return [
            np.concatenate([((part[at, None] - book[None]) ** 2).sum(2) for at in some]) for part, book in zip(self.halves(x), self.books, strict=True)
        ]

    def fit(self, q: np.ndarray, row: np.ndarray, c1: np.ndarray, c2: np.ndarray, target: float = TARGET) -> None:
        """The reach with which `target` of the nearest vectors of queries, in cells (c1, c2) for q[row], are found."""
        first, second = self.distances(q)
        needed = np.sort((first[row, c1] + second[row, c2]) / np.maximum(self._witnessed(q, first, second), 1e-300)[row])
        if len(needed):
            self.reach = float(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))])

    def _witnessed(self, q: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The largest summed distance of the cells of each query's nearest vectors in the sample."""
        if len(self.sample) <= WITNESSES + 1:
            return np.full(len(q), np.inf)
        exact = squared(q, self.sample)
        at = np.argpartition(exact, WITNESSES, axis=1)[:, : WITNESSES + 1]
        at = np.take_along_axis(at, np.argsort(np.take_along_axis(exact, at, 1), axis=1), 1)
        row = np.arange(len(q))
        sums = first[row[:, None], self.cells[0][at]] + second[row[:, None], self.cells[1][at]]
        own = exact[row, at[:, 0]] <= ROUNDING * (q**2).sum(1)  # a query that is in the sample is no neighbour of its own
        return np.where(own, sums[:, 1:].max(1), sums[:, :-1].max(1))

    def within(self, q: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Up to which summed distance each query visits cells, given its distances to the centroids."""
        return self.reach * self._witnessed(q, first, second)


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, but for rounding."""
    return np.maximum((q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1), 0)


def compared(x: np.ndarray, cells: np.ndarray, y: np.ndarray, c2: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x and of y, and their distance: for each x the near + 1 nearest y of its cells, and those as near as the last.

    cells: for each x which second-half centroids it visits; c2: that of each y. Vectors of other cells are not met.
    """
    order = np.argsort(c2, kind="stable")
    y, c2 = y[order], c2[order]
    x2, y2 = (x**2).sum(1), (y**2).sum(1)
    rough = np.full((len(x), len(y)), np.nan)
    cuts = [*np.flatnonzero(np.diff(c2, prepend=-1)), len(y)]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        asks = np.flatnonzero(cells[:, c2[begin]])
        rough[asks, begin:end] = y2[begin:end] - 2 * x[asks] @ y[begin:end].T
    if len(y) > near + 1:
        last = np.partition(rough, near, axis=1)[:, near]  # what is not met comes last
        bound = np.where(np.isnan(last), np.inf, last + ROUNDING * (x2 + y2.max()))
        row, col = np.nonzero(rough <= bound[:, None])
    else:
        row, col = np.nonzero(~np.isnan(rough))
    some = [slice(at, at + DIFFERENCES) for at in range(0, max(len(row), 1), DIFFERENCES)]
    exact = np.concatenate([np.sqrt(((y[col[at]] - x[row[at]]) ** 2).sum(1)) for at in some])
    return row, order[col], exact


def leading(row: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` smallest scores of each row, ties by id, in that order."""
    order = np.lexsort((ids, score, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < most]


def to_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def true_neighbours(coded: DataFrame, q: np.ndarray, own: np.ndarray, near: int) -> DataFrame:
    """row, distance (squared), c1, c2: the nearest entries of each row of q but its own one, all entries gone through."""

    def search(batches):
        out = pa.schema([("row", pa.int32()), ("distance", pa.float64()), ("c1", pa.int32()), ("c2", pa.int32())])
        held = np.full((len(q), near), np.inf), np.zeros((len(q), near), np.int32), np.zeros((len(q), near), np.int32)
        for b in batches:
            if b.num_rows:
                distance = squared(q, to_matrix(b.column("v")))
                distance[own[:, None] == b.column("entry").to_numpy()] = np.inf
                met = distance, *(np.broadcast_to(b.column(c).to_numpy(), distance.shape) for c in ("c1", "c2"))
                met = [np.concatenate(two, axis=1) for two in zip(held, met, strict=True)]
                at = np.argpartition(met[0], near - 1, axis=1)[:, :near]
                held = tuple(np.take_along_axis(x, at, 1) for x in met)
        row, place = np.nonzero(np.isfinite(held[0]))
        yield batch(out, row, *(x[row, place] for x in held))

    found = coded.mapInArrow(search, "row int, distance double, c1 int, c2 int")
    place = F.row_number().over(Window.partitionBy("row").orderBy("distance", "c1", "c2"))
    return found.withColumn("place", place).where(F.col("place") <= near).drop("place")


def nearest_neighbours(vectors: DataFrame, is_query, near: int = 10, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score for the rows for which is_query (a column of vec_id) holds, against all rows."""
    spark = vectors.sparkSession
    tune(spark)
    rows = usable(vectors)
    # equal vectors are one entry; a partial limit before the shuffle keeps a frequent one small
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = rows.distinct().withColumn("place", place).where(F.col("place") <= near + 1)
    entries = kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.col("ids")[0])
    entries = stored(entries, "ann-entries")
    total = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    sample = entries.orderBy(F.xxhash64("v"), "entry").limit(TRAIN_ROWS + FIT_QUERIES).select("v", "entry").toArrow()
    index = MultiIndex(to_matrix(sample.slice(0, TRAIN_ROWS).column("v").combine_chunks()), total, near, target)

    def assign(batches):
        for b in batches:
            first, second = index.codes(to_matrix(b.column("v")))
            columns = [*b.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "c1", "c2"])

    coded = stored(entries.mapInArrow(assign, "v array<float>, ids array<long>, entry long, c1 int, c2 int"), "ann-index")
    if total > TRAIN_ROWS:
        fitted = sample.slice(max(0, sample.num_rows - FIT_QUERIES))
        q = to_matrix(fitted.column("v").combine_chunks())
        cells = true_neighbours(coded, q, fitted.column("entry").to_numpy(), near).toArrow()
        index.fit(q, *(cells.column(c).to_numpy() for c in ("row", "c1", "c2")), target)
    # at most MOST_CENTROIDS ** 2 cells
    counts = np.zeros([len(b) for b in index.books], np.int64)
    filled = coded.groupBy("c1", "c2").count().toArrow()
    counts[filled["c1"].to_numpy(), filled["c2"].to_numpy()] = filled["count"].to_numpy()

    asked = rows.where(is_query(F.col("vec_id"))).distinct()
    asked = stored(asked.join(entries.select("v", "entry").hint("merge"), "v").select("vec_id", "entry", "v"), "ann-queries")
    queries = asked.groupBy("entry").agg(F.first("v").alias("v"))
    n_queries = queries.count()

    def plan(batches):
        out = pa.schema([("c1", pa.int32()), ("query", pa.int64()), ("qv", pa.list_(pa.float32())), ("cells", pa.binary())])
        for b in batches:
            for at in range(0, b.num_rows, WALKS):
                some = b.slice(at, WALKS)
                q = to_matrix(some.column("v"))
                first, second = index.distances(q)
                within = index.within(q, first, second)
                visited = np.zeros((len(q), *counts.shape), bool)
                for k in range(len(q)):
                    visited[(k, *zip(*walk(first[k], second[k], counts, near + 1, within[k]), strict=True))] = True
                row, c1 = np.nonzero(visited.any(2))
                bits = np.packbits(visited, axis=2)[row, c1]
                vectors = pa.array(list(q.astype(np.float32)), pa.list_(pa.float32())).take(pa.array(row))
                yield batch(out, c1, some.column("entry").take(pa.array(row)), vectors, [x.tobytes() for x in bits])

    # by no key: a shuffle by one that rows already lie by would be left out, and all walks be one task
    walkers = max(1, min(partitions(spark), -(-n_queries // WALKS)))
    planned = queries.repartition(walkers).mapInArrow(plan, "c1 int, query long, qv array<float>, cells binary")
    blocks = F.get(F.lit([max(1, -(-int(n) // BLOCK)) for n in counts.sum(1)]), F.col("c1"))
    tile = partitions(spark), "c1", "block"
    asking = planned.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).repartition(*tile)
    split = F.lit(max(1, -(-n_queries // QUERY_BLOCK)))
    asking = asking.groupBy("c1", "block", F.pmod(F.xxhash64("query"), split).alias("part"))
    asking = asking.agg(F.collect_list(F.struct("query", "qv", "cells")).alias("asking"))
    held = coded.withColumn("block", F.pmod(F.xxhash64("entry"), blocks).cast("int")).repartition(*tile)
    held = held.groupBy("c1", "block").agg(F.collect_list(F.struct("v", "ids", "c2")).alias("held"))

    def rerank(batches):
        out = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            for asking_row, held_row in zip(b.column("asking"), b.column("held"), strict=True):
                q, h = asking_row.values, held_row.values
                bits = np.frombuffer(b"".join(q.field("cells").to_pylist()), np.uint8).reshape(len(q), -1)
                met = to_matrix(q.field("qv")), np.unpackbits(bits, axis=1), to_matrix(h.field("v")), h.field("c2").to_numpy()
                row, col, score = compared(*met, near)
                ids, lengths = h.field("ids").flatten().to_numpy(), h.field("ids").value_lengths().to_numpy()
                begin = np.cumsum(lengths) - lengths
                # an entry's smallest id stands first, so entries in this order hold the ids in it
                best = leading(row, score, ids[begin[col]], near + 1)
                row, col, score = row[best], col[best], score[best]
                ids, row, score = ids[gather(begin[col], lengths[col])], np.repeat(row, lengths[col]), np.repeat(score, lengths[col])
                best = leading(row, score, ids, near + 1)
                yield batch(out, q.field("query").to_numpy()[row[best]], ids[best], score[best])

    found = asking.join(held.hint("merge"), ["c1", "block"]).select("asking", "held").mapInArrow(rerank, "query long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    found = found.withColumn("place", best).where(F.col("place") <= near + 1)
    tops = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("top"))
    answered = asked.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")).join(tops.hint("merge"), "query")
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, near)
    ranked = answered.select("query_id", F.posexplode(others).alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", "hit.score")
