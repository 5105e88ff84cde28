"""Ranked lexical search: presence masks of each item's terms, evaluated by descending bound.

Terms are maximal runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. A first pass over whole texts
keeps, for each document, its number of terms and the frequencies of those terms that some item has; N, L and df come
from it. A second pass goes through blocks of documents. A block holds one bitmap a term, and an item's bitmaps give
each document its mask of matched terms; documents with one mask form a group. No document of a group scores above the
sum of the greatest parts that the mask's terms reach in the block. Groups are evaluated by descending bound until the
next bound is below the score of the item's last place so far, which is kept from block to block of a task. Each task
returns its best rows of each item, and Spark ranks those.

Items are taken in passes of at most about `PAIRS` (item, term) pairs, so what tasks hold of them is bounded; a block is
cut so that terms times documents stay below `CELLS`.

Null texts have no terms and take no place. Repeated documents take a place each; a null doc_id comes after all others
of its score. Rows of one item_id are one item with the terms of all its different texts. Items without terms, and empty tables,
give no rows. Columns other than doc_id, item_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelaudit.llm.common import batch, stored, text_frame, tune
from labelaudit.llm.segments import gather

TOP = 20
PAIRS = 1 << 17  # (item, term) pairs of one pass
CELLS = 1 << 23  # terms times documents of one block
MASKS = 32  # masks evaluated first; twice as many each time after that
SALTS = 64  # groups in which the best rows of the tasks are ranked first

#: Bytes of terms as they are, A-Z lower-cased, all others blank.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | bytes | None) -> list[bytes]:
    """All terms of a text in order, repeats included."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(TERM_BYTES).split()


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and of the vocabulary's terms in the text the places and frequencies (uint32)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("places", pa.binary()), ("tf", pa.binary())])

    def run(batches):
        known = vocabulary.get
        for rows in batches:
            out: list[list] = [[], [], []]
            for text in rows.column("text").cast(pa.large_binary()):
                words = terms(text.as_py())
                found = [(p, c) for w, c in Counter(words).items() if (p := known(w)) is not None]
                out[0].append(len(words))
                for k in (0, 1):
                    out[k + 1].append(np.array([f[k] for f in found], "<u4").tobytes())
            yield batch(schema, rows.column("doc_id"), *out)

    return text_frame(docs).mapInArrow(run, "doc_id long, n long, places binary, tf binary")


def holding_counts(counts: DataFrame, size: int) -> np.ndarray:
    """For each term of the vocabulary how many documents hold it."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def run(batches):
        total = np.zeros(size, np.int64)
        for rows in batches:
            total += np.bincount(np.frombuffer(b"".join(rows.column("places").to_pylist()), "<u4"), minlength=size)
        there = np.flatnonzero(total)
        yield batch(schema, there, total[there])

    per = counts.select("places").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[per.column("term").to_numpy()] = per.column("df").to_numpy()
    return df


class Best:
    """The best rows so far of one item: by score, then documents with an id, then the smaller id."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.without = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        """A bound below this can't bring a row in."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, without: np.ndarray) -> None:
        fine = scores >= self.floor()
        scores, ids, without = (np.concatenate([x, y[fine]]) for x, y in ((self.scores, scores), (self.ids, ids), (self.without, without)))
        order = np.lexsort((ids, without, -scores))[: self.top]
        self.scores, self.ids, self.without = scores[order], ids[order], without[order]


def mask_groups(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of a matrix of bits by equality: their order, where each group begins in it, and how many it has."""
    packed = np.packbits(bits, axis=0)
    wide = np.zeros((bits.shape[1], -(-len(packed) // 8) * 8), np.uint8)
    wide[:, : len(packed)] = packed.T
    words = wide.view(np.uint64)
    order = np.lexsort(words.T)
    words = words[order]
    begin = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
    return order, begin, np.diff(np.append(begin, len(order)))


def search_block(best: list[Best], items: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, without: np.ndarray, parts: np.ndarray, there: np.ndarray) -> None:
    """Brings a block's documents into the items' best rows. parts, there: terms by documents."""
    most = parts.max(axis=1).astype(np.int64)
    for kept, (places, weights) in zip(best, items, strict=True):
        bits = there[places]
        order, begin, sizes = mask_groups(bits)
        bounds = ((most[places] * weights).astype(np.float64) @ bits[:, order[begin]]).astype(np.int64)  # whole numbers below 2**53
        by_bound = np.argsort(-bounds, kind="stable")
        at, step = 0, MASKS
        while at < len(by_bound) and bounds[by_bound[at]] >= kept.floor():
            groups = by_bound[at : at + step]
            groups = groups[bounds[groups] >= kept.floor()]
            found = order[gather(begin[groups], sizes[groups])]
            scores = (parts[np.ix_(places, found)] * weights[:, None]).sum(axis=0)
            kept.add(scores, ids[found], without[found])
            at, step = at + step, 2 * step


def best_rows(counts: DataFrame, names: list[int | None], items: list[tuple[np.ndarray, np.ndarray]], size: int, documents: int, length: int, top: int) -> DataFrame:
    """item, item_id, doc_id and score: of each task the best rows of each item."""
    schema = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    block = max(64, CELLS // max(1, size))

    def run(batches):
        best = [Best(top) for _ in items]
        waiting, held = [], 0

        def done() -> None:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            n = rows.column("n").to_numpy()
            places, tf = (rows.column(c).to_pylist() for c in ("places", "tf"))
            doc = np.repeat(np.arange(len(n)), [len(x) // 4 for x in places])
            term = np.frombuffer(b"".join(places), "<u4").astype(np.int64)
            tf = np.frombuffer(b"".join(tf), "<u4").astype(np.int64)
            m = 100 - 25 + 25 * n * documents // length
            parts, there = np.zeros((size, len(n)), np.int64), np.zeros((size, len(n)), bool)
            parts[term, doc] = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
            there[term, doc] = True
            ids = rows.column("doc_id")
            search_block(best, items, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), parts, there)

        for rows in batches:
            at = 0
            while at < rows.num_rows:
                part = rows.slice(at, block - held)
                waiting.append(part)
                at, held = at + part.num_rows, held + part.num_rows
                if held == block:
                    done()
                    waiting, held = [], 0
        if held:
            done()
        for k, x in enumerate(best):
            if len(x.scores):
                yield batch(schema, [k] * len(x.scores), [names[k]] * len(x.scores), pa.array(x.ids, mask=x.without), x.scores)

    return counts.where(F.octet_length("places") > 0).mapInArrow(run, "item int, item_id long, doc_id long, score long")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The top rows of each item with their rank; first within groups of rows, then over all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search_pass(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    names, wanted = [], []
    for row in items.orderBy("item_id").collect():  # a pass's items: bounded
        wanted.append(Counter(vocabulary.setdefault(w, len(vocabulary)) for w in terms(row["text"])))
        names.append(row["item_id"])
    counts = stored(term_counts(docs, vocabulary), "term-counts")
    total = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).head()
    df = holding_counts(counts, len(vocabulary))
    weight = np.array([term_weight(total["documents"], int(n)) for n in df], np.int64)
    searched = [(np.array(list(w), np.int64), np.array(list(w.values()), np.int64) * weight[list(w)]) for w in wanted]
    return ranked(best_rows(counts, names, searched, len(vocabulary), total["documents"], max(1, total["length"]), top), top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id and score: for each item (item_id, text) the documents with the highest scores above 0."""
    tune(docs.sparkSession)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"))
    # a text has at most half as many terms as characters, and one more
    sized = items.withColumn("most", F.octet_length("text") / 2 + 1).where("text != ''")
    size = sized.agg(F.coalesce(F.sum("most"), F.lit(0.0))).head()[0]
    passes = max(1, math.ceil(size / pairs))
    parts = [sized.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).select("item_id", "text") for k in range(passes)]
    return reduce(DataFrame.unionByName, [search_pass(docs, part, top) for part in parts])
