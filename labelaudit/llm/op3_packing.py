"""Packing documents into sequences: best fit, then a swap-based local search.

A document's ids end with a separator id; only documents longer than a sequence are cut, into full pieces and a last
one. Full pieces are sequences of their own and aren't shuffled. The rest, at most one per document, are dealt in turn
into buckets of about `BUCKET` pieces, whatever their doc_ids, each packed by itself: best fit, longest first, then a
local search. It takes the emptiest sequence and moves documents out, exchanges one for a shorter one, or two for one,
whenever that raises the sum of squared fills, until the sequence is empty or nothing helps, and so on with the next;
passes over all underfull sequences (under `UNDERFULL` of the room used) end when one empties none, or when a lower bound is met (ids over room, or documents
longer than half a sequence). The `OPEN` emptiest sequences of each bucket are then packed again together, in buckets
again, so that what buckets lose doesn't add up.

Null and empty texts are a piece of one id (the separator). Repeated rows are packed each for itself. An empty table
gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelaudit.llm.common import batch, stored, text_chunks, text_frame, tune
from labelaudit.llm.encoding import CHUNK_BYTES, default_tokenizer, encoder

SEQUENCE, SEPARATOR_ID = 2048, 0
#: Pieces in a bucket, the sequences of a bucket that are packed again, and how often.
BUCKET, OPEN, LEVELS = 4096, 2, 4
#: Sequences filled less than this are underfull: the search tries to empty them.
UNDERFULL = 0.9
#: Full pieces are numbered from here.
FULL_IDS = 1 << 61

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def cut_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = SEQUENCE, separator: int = SEPARATOR_ID) -> DataFrame:
    """One row for each piece of each document, with the checksum of its ids and a number of its own (row)."""
    tune(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])

    def run(batches):
        encode, made = encoder(path).encode, TaskContext.get().partitionId() << 40
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            ids, bounds = encode(buf, offs)
            ids, bounds = np.insert(ids, bounds[1:], separator), bounds + np.arange(len(bounds))
            lengths = np.diff(bounds)
            pieces = -(-lengths // limit)
            row = np.repeat(np.arange(len(lengths)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * limit
            length = np.minimum(lengths[row] - start, limit)
            raw, at = memoryview(ids.astype("<u4").view(np.uint8)), (bounds[row] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            yield batch(schema, rows.column("doc_id").take(pa.array(row)), piece, start, length, crc, made + np.arange(len(row)))
            made += len(row)

    return text_frame(docs).mapInArrow(run, PIECE)


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that has room; bins as lists of places."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # free, bin; sorted
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        at = bisect.bisect_left(rooms, (n, -1))
        if at < len(rooms):
            free, b = rooms.pop(at)
        else:
            free, b = limit, len(bins)
            bins.append([])
        bins[b].append(k)
        if free > n:
            bisect.insort(rooms, (free - n, b))
    return bins


def swap_search(lengths: list[int], bins: list[list[int]], limit: int) -> list[list[int]]:
    """Empty open bins by moves, one-for-one and two-for-one exchanges that raise the sum of squared fills."""
    size = np.asarray(lengths, np.int64)
    bins = [list(b) for b in bins if b]
    least = max(-(-int(size.sum()) // limit), int((2 * size > limit).sum()))
    fill = np.array([size[b].sum() for b in bins], np.int64)
    home = np.full(len(size), -1, np.int64)
    for b, docs in enumerate(bins):
        home[docs] = b
    alive = np.ones(len(bins), bool)

    def shift(k: int, a: int, b: int) -> None:
        bins[a].remove(k)
        bins[b].append(k)
        home[k] = b
        fill[a] -= size[k]
        fill[b] += size[k]

    def move(target: int, free: np.ndarray) -> bool:
        for k in sorted(bins[target], key=lambda k: (-size[k], k)):
            fits = np.flatnonzero(free >= size[k])
            if len(fits):
                shift(k, target, int(fits[np.argmin(free[fits])]))
                return True
        return False

    def exchange(target: int, free: np.ndarray) -> bool:
        """The exchange by which a fuller bin gains most."""
        docs = np.flatnonzero(home != target)
        room = free[home[docs]]
        docs, room = docs[room > 0], room[room > 0]
        if not len(docs):
            return False
        # of documents alike in length and room, one stands for all; likewise of ways to give away a total
        _, at = np.unique(size[docs] * (limit + 1) + room, return_index=True)
        docs, room = docs[at], room[at]
        own, ways = bins[target], {}
        for i, k in enumerate(own):
            ways.setdefault(int(size[k]), (k,))
        for i, k in enumerate(own):
            for m in own[i + 1 :]:
                ways.setdefault(int(size[k] + size[m]), (k, m))
        best = (0, None, None)
        for total, out in ways.items():
            gain = total - size[docs]
            gain[gain > room] = 0
            g = int(np.argmax(gain))
            if gain[g] > best[0]:
                best = (int(gain[g]), out, int(docs[g]))
        if best[1] is None:
            return False
        other = int(home[best[2]])
        shift(best[2], other, target)
        for k in best[1]:
            shift(k, target, other)
        return True

    emptied = True
    while emptied and alive.sum() > least:
        emptied = False
        for target in sorted(np.flatnonzero(alive & (fill < UNDERFULL * limit)).tolist(), key=lambda b: (fill[b], b)):
            while bins[target]:
                free = np.where(alive & (fill >= fill[target]), limit - fill, 0)  # only fuller bins gain: squared fill rises
                free[target] = 0
                if not (move(target, free) or exchange(target, free)):
                    break
            if not bins[target]:
                alive[target], emptied = False, True
                if alive.sum() <= least:
                    break
    return [b for b, on in zip(bins, alive.tolist(), strict=True) if on and b]


def pack(pieces: DataFrame, limit: int = SEQUENCE, bucket: int = BUCKET) -> DataFrame:
    """sequence_id and offset for each piece."""
    columns = [f.name for f in pieces.schema if f.name != "row"]
    full = pieces.where(F.col("length") == limit).select(*columns, (F.col("row") + FULL_IDS).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, rest, level = full, pieces.where(F.col("length") < limit), 0
    while True:
        buckets = max(1, -(-rest.count() // bucket))
        again = buckets > 1 and level < LEVELS
        done = rest.withColumn("bucket", F.pmod("row", F.lit(buckets)).cast("int")).groupBy("bucket").applyInPandas(_bucket_packer(limit, level, again), f"{PIECE}, sequence_id long, offset long, open boolean")
        if not again:
            return out.unionByName(done.drop("row", "open"))
        done = stored(done, "packed")
        out = out.unionByName(done.where("not open").drop("row", "open"))
        # numbered anew, so that neighbours go to different buckets
        rest = stored(done.where("open").select(*columns, F.monotonically_increasing_id().alias("row")), "open-pieces")
        level += 1


def _bucket_packer(limit: int, level: int, again: bool):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row").reset_index(drop=True)
        sizes = rows["length"].tolist()
        bins = sorted(swap_search(sizes, best_fit(sizes, limit), limit), key=lambda b: sum(sizes[k] for k in b))
        sequence, offset, is_open = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        length = np.asarray(sizes, np.int64)
        for b, members in enumerate(bins):
            at = np.array(sorted(members))
            sequence[at] = b
            offset[at] = np.cumsum(length[at]) - length[at]
            is_open[at] = again and b < OPEN
        return rows.assign(sequence_id=sequence + (int(key[0]) << 24) + (level << 56), offset=offset, open=is_open).drop(columns="bucket")

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = SEQUENCE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs."""
    return pack(stored(cut_documents(docs, tokenizer, limit), "pieces"), limit, bucket)
