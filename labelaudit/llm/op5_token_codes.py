"""Token-id output as directly addressable codes.

Ids are split into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id and a continuation bitmap;
level k + 1 holds the next chunk of those ids whose bit is set at level k. A rank directory (set bits before each
block of 512) turns a place at one level into the place at the next, so any token is read with one byte and one rank
per level, without decoding a block. Trailing levels that no id needs aren't written.

A shard is one file of segments; a segment is a run of whole documents: header, document table, then the levels.
Shards follow ascending doc_id (null first; equal ids in the order of a hash of their texts), one for each range
partition, so nothing passes through one task; rows alike in both are dealt over several, in any order. Only files that the manifest names belong to the output: a task that is run again
writes a file of its own, and the copy left by a lost executor is never read.

Null and empty texts hold the end id alone. Repeated rows stay repeated rows. An empty table gives no shard and no row.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelaudit.llm.common import batch, filesystem, new_folder, partitions, stored, text_chunks, text_frame, tune
from labelaudit.llm.encoding import CHUNK_BYTES, default_tokenizer, encoder

END_ID = 2
MAGIC = b"DAC1"
HEADER = struct.Struct("<4sIQQ")  # magic, levels, ids, documents
LEVEL = struct.Struct("<Q")  # ids at this level
RANK_BLOCK = 512

MANIFEST = "shard int, file string, n_tokens long, segments array<struct<at: long, size: long, n_tokens: long, n_docs: long>>"


def pack_levels(ids: np.ndarray) -> bytes:
    """Chunk bytes, continuation bits and rank directory of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // RANK_BLOCK) * (RANK_BLOCK // 8), np.uint8)
        padded[: len(bits)] = bits
        counts = np.bitwise_count(padded.reshape(-1, RANK_BLOCK // 8)).sum(1, dtype=np.uint64)
        ranks = np.cumsum(counts) - counts
        out += [LEVEL.pack(len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), padded.tobytes(), ranks.astype("<u8").tobytes()]
        rest = rest[more] >> 8
        if not len(rest):
            return b"".join(out)


def level_sizes(n: int) -> tuple[int, int, int]:
    """Bytes of the chunks, of the bitmap and of the rank directory of a level of n ids."""
    blocks = -(-n // RANK_BLOCK)
    return n, blocks * (RANK_BLOCK // 8), blocks * 8


def unpack_levels(data: memoryview, levels: int) -> np.ndarray:
    """All ids of a segment's levels."""
    at, places, ids, shift = 0, None, None, 0
    for _ in range(levels):
        (n,) = LEVEL.unpack_from(data, at)
        a, b, c = level_sizes(n)
        at += LEVEL.size
        chunk = np.frombuffer(data, np.uint8, a, at).astype(np.uint32)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, b, at + a), bitorder="little")[:n].astype(bool)
        if ids is None:
            ids, places = chunk, np.arange(n)
        else:
            ids[places] |= chunk << np.uint32(shift)
        places, shift, at = places[bits], shift + 8, at + a + b + c
    return ids


def token_at(read: Callable[[int, int], bytes], levels: int, i: int) -> int:
    """One id by its place: for each level a byte, a block of the bitmap and a rank. read(at, size) gives bytes of the levels."""
    at = value = shift = 0
    for _ in range(levels):
        (n,) = LEVEL.unpack(read(at, LEVEL.size))
        a, b, c = level_sizes(n)
        at += LEVEL.size
        value |= read(at + i, 1)[0] << shift
        block, place = divmod(i, RANK_BLOCK)
        bits = int.from_bytes(read(at + a + block * (RANK_BLOCK // 8), RANK_BLOCK // 8), "little")
        if not bits >> place & 1:
            return value
        (rank,) = LEVEL.unpack(read(at + a + b + 8 * block, 8))
        i, shift, at = rank + (bits & ((1 << place) - 1)).bit_count(), shift + 8, at + a + b + c
    return value


def segment(doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> bytes:
    body = pack_levels(ids) if len(ids) else b""
    levels = 0
    rest = int(ids.max()) if len(ids) else 0
    while len(ids) and (levels == 0 or rest):
        levels, rest = levels + 1, rest >> 8
    known = np.asarray(doc_ids.is_valid())
    numbers = np.asarray(doc_ids.fill_null(0)).astype("<i8")
    table = numbers.tobytes() + known.astype(np.uint8).tobytes() + np.diff(bounds).astype("<u8").tobytes()
    return HEADER.pack(MAGIC, levels, len(ids), len(numbers)) + table + body


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids and the place of each document's first id."""
    magic, levels, n, docs = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token codes")
    at = HEADER.size
    numbers = np.frombuffer(data, "<i8", docs, at)
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    ids = unpack_levels(memoryview(data)[at + 17 * docs :], levels) if n else np.zeros(0, np.uint32)
    doc_ids = [x if ok else None for x, ok in zip(numbers.tolist(), known.tolist(), strict=True)]
    return doc_ids, ids, np.concatenate([[0], np.cumsum(lengths)])


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids followed by the end id."""
    return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, n: int | None = None) -> DataFrame:
    """Write shards below folder, ascending doc_id over shards; the manifest's rows, stored in the shared folder."""
    spark = docs.sparkSession
    tune(spark)
    path = tokenizer or default_tokenizer()
    schema = pa.schema(
        [
            ("shard", pa.int32()),
            ("file", pa.string()),
            ("n_tokens", pa.int64()),
            ("segments", pa.list_(pa.struct([(k, pa.int64()) for k in ("at", "size", "n_tokens", "n_docs")]))),
        ]
    )

    def run(batches):
        shard = TaskContext.get().partitionId()
        encode, (fs, at), out, done = encoder(path).encode, filesystem(folder), None, []
        name, place, total = f"shard-{shard:06d}-{uuid.uuid4().hex}.dac", 0, 0
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            if out is None:
                fs.create_dir(at, recursive=True)
                out = fs.open_output_stream(f"{at}/{name}", compression=None)
            ids, bounds = with_end(*encode(buf, offs), end_id)
            data = segment(rows.column("doc_id"), ids, bounds)
            out.write(data)
            done.append({"at": place, "size": len(data), "n_tokens": len(ids), "n_docs": rows.num_rows})
            place, total = place + len(data), total + len(ids)
        if out is not None:
            out.close()
            yield batch(schema, [shard], [name], [total], [done])

    # a hash of the text and a number are part of the range key: rows of one doc_id, or alike, are spread as well
    spread = text_frame(docs).withColumns({"print": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "print", "row"]
    ordered = spread.repartitionByRange(n or partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    #: One short row for each shard, so this window is small however large the files are.
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spark = manifest.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        fs, at = filesystem(folder)
        for rows in batches:
            for row in rows.to_pylist():
                start = row["start"]
                with fs.open_input_file(f"{at}/{row['file']}") as file:
                    for part in row["segments"]:
                        file.seek(part["at"])
                        doc_ids, ids, bounds = read_segment(file.read(part["size"]))
                        raw, cut = memoryview(ids.astype("<u4").view(np.uint8)), (bounds * 4).tolist()
                        crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                        yield batch(schema, doc_ids, start + bounds[:-1], np.diff(bounds), crc)
                        start += len(ids)

    dealt = placed.select("shard", "file", "segments", "start").repartition(partitions(spark), "shard")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_token(spark: SparkSession, manifest: DataFrame, folder: str, place: int) -> int | None:
    """The id at one place of the whole output; None beyond it. Reads some bytes of each level, whatever a segment's size."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    hit = placed.where((F.col("start") <= place) & (place < F.col("start") + F.col("n_tokens"))).head()
    if hit is None:
        return None
    rest, (fs, at) = place - hit["start"], filesystem(folder)
    for part in hit["segments"]:
        if rest < part["n_tokens"]:
            with fs.open_input_file(f"{at}/{hit['file']}") as file:
                _, levels, _, docs = HEADER.unpack(file.read_at(HEADER.size, part["at"]))
                begin = part["at"] + HEADER.size + 17 * docs
                return token_at(lambda at, size: file.read_at(size, begin + at), levels, rest)
        rest -= part["n_tokens"]
    return None


def token_codes(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files, read them back: one row for each document, from the files alone."""
    folder = new_folder(docs.sparkSession, "token-codes")
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
