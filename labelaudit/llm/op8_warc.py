"""WARC archives with a two-level capture index.

Writing: of pages with equal payloads the one with the largest page_id becomes a response record, the others revisit
it. Each task writes an archive of gzip members, one a record, and hands on what the index needs. Index entries are
sorted by reversed-host key (com,example,www)/path, cut into blocks of `BLOCK` entries, compressed and written to index
files, one a range partition; the sparse directory has a row for each file, with each block's first and last key and
place. A lookup bisects the files by key (a row each, so few), then the blocks of the files it needs, then the entries of
the blocks it decodes, and reads the records' byte ranges alone.

Archives and index files lie in the shared folder and are written through Arrow's file systems (local, S3, HDFS where
its library is present). A task that runs again writes files of its own; only those that the written directory names
are ever read, so a lost executor leaves nothing behind that counts.

Null html is an empty payload; null urls have the empty key. Equal payloads are found by SHA-1 and length, counted
before the shuffle, so a payload that a third of all pages share is no hot group but in one join, which Spark splits.
Rows that repeat a page_id are records of their own; null page_ids are kept, and never referred to. An empty table
gives no record and no row. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.llm.common import batch, filesystem, new_folder, partitions, stored, tune

BLOCK, LEVEL, DATE = 256, 3, "2024-01-01T00:00:00Z"
ENTRY = "key string, page_id long, file string, at long, size long"
DIRECTORY = "first_key string, last_key string, file string, blocks array<struct<first: string, last: string, n: int, at: long, size: long>>"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """Reversed host, then path and query: http://www.Example.com/a?b -> com,example,www)/a?b"""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cut = min((rest.find(c) for c in "/?" if c in rest), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + (rest[cut:] or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_safe(text: str) -> str:
    return "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, target: str | None) -> bytes:
    """One record as a gzip member. refers_to: the response that this one revisits."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_safe(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if target is not None:
            head.append(f"WARC-Refers-To-Target-URI: {header_safe(target)}")
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record and of the response within, and the payload (empty for a revisit)."""
    text = zlib.decompress(data, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def record_row(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record, as it was read."""
    fields, http, payload = parse(data)
    name = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    page_id = int(name) if name else None
    if fields["WARC-Type"] == "revisit":
        return page_id, int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
    return page_id, len(payload), digest(payload), "response", None


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of pages below folder; index entries, stored in the shared folder."""
    tune(pages.sparkSession)
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    given = given.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    same = given.where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha", "n")
    same = same.agg(F.max("page_id").alias("last"), F.max_by("url", "page_id").alias("target"), F.count("*").alias("copies"))
    known = given.join(same, ["sha", "n"], "left")
    first = (F.col("n") < least_bytes) | F.col("last").isNull() | F.coalesce(F.col("page_id") == F.col("last"), F.lit(False))
    decided = known.select("page_id", "url", "html", F.when(~first, F.col("last")).alias("refers_to"), F.when(~first, F.col("target")).alias("target"))
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])

    def run(batches):
        out, name, place, (fs, at) = None, f"pages-{uuid.uuid4().hex}.warc.gz", 0, filesystem(folder)
        for rows in batches:
            if out is None:
                fs.create_dir(at, recursive=True)
                out = fs.open_output_stream(f"{at}/{name}", compression=None)
            keys, ids, places, sizes = [], [], [], []
            columns = (rows.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "target"))
            for page_id, url, html, refers_to, target in zip(*columns, strict=True):
                data = record(page_id, url, html.encode(), refers_to, target)
                out.write(data)
                keys.append(surt(url))
                ids.append(page_id)
                places.append(place)
                sizes.append(len(data))
                place += len(data)
            yield batch(schema, keys, ids, [name] * len(keys), places, sizes)
        if out is not None:
            out.close()

    return stored(decided.mapInArrow(run, ENTRY), "warc-entries")


def pack_block(entries: list[tuple]) -> bytes:
    return zlib.compress("\n".join(json.dumps(e, separators=(",", ":")) for e in entries).encode(), 6)


def unpack_block(data: bytes) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(data).split(b"\n")]


def write_index(entries: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Sort the entries by key into compressed blocks below folder; the sparse directory, stored in the shared folder."""
    one = pa.struct([("first", pa.string()), ("last", pa.string()), ("n", pa.int32()), ("at", pa.int64()), ("size", pa.int64())])
    schema = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("blocks", pa.list_(one))])

    def run(batches):
        out, name, place, (fs, at), blocks = None, f"index-{uuid.uuid4().hex}.cdxz", 0, filesystem(folder), []
        for entries in _runs(batches, block):
            if out is None:
                fs.create_dir(at, recursive=True)
                out = fs.open_output_stream(f"{at}/{name}", compression=None)
            data = pack_block(entries)
            out.write(data)
            blocks.append({"first": entries[0][0], "last": entries[-1][0], "n": len(entries), "at": place, "size": len(data)})
            place += len(data)
        if out is not None:
            out.close()
            yield batch(schema, [blocks[0]["first"]], [blocks[-1]["last"]], [name], [blocks])

    order = ["key", "page_id", "file", "at"]
    # the place in the archive is part of the range key: a key that a third of all captures share is spread
    dealt = entries.repartitionByRange(partitions(entries.sparkSession), *order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(run, DIRECTORY), "warc-directory")


def _runs(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for rows in batches:
        held += zip(*(rows.column(c).to_pylist() for c in ("key", "page_id", "file", "at", "size")), strict=True)
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def between(firsts: list[str], lasts: list[str], key: str) -> range:
    """Places of the sorted ranges first..last that can hold a key; neighbours may share a key at their ends."""
    at = bisect.bisect_left(lasts, key)
    return range(at, max(at, bisect.bisect_right(firsts, key)))


def files_with(directory: DataFrame, keys: list[str]) -> list[str]:
    """Names of the index files that can hold one of the keys."""
    files = directory.select("first_key", "last_key", "file").orderBy("first_key", "last_key").collect()  # a row for each range partition
    firsts, lasts = [f["first_key"] for f in files], [f["last_key"] for f in files]
    return sorted({files[k]["file"] for key in keys for k in between(firsts, lasts, key)})


def read_captures(directory: DataFrame, archives: str, index: str, urls: list[str] | None = None) -> DataFrame:
    """Rows of the records that the index names: all, or those of the urls (a short list, sent to every task)."""
    spark = directory.sparkSession
    keys = sorted({surt(u) for u in urls}) if urls is not None else None
    if keys is not None:
        files = directory.where(F.col("file").isin(files_with(directory, keys))).select("file", "blocks")
    else:
        files = directory.select("file", F.explode("blocks").alias("b")).repartition(partitions(spark), "file", "b.at").select("file", F.array("b").alias("blocks"))
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def blocks_with(blocks: list[dict]) -> list[tuple[dict, list[str] | None]]:
        """Blocks to decode, with the keys to look for; None for all."""
        if keys is None:
            return [(b, None) for b in blocks]
        firsts, lasts = [b["first"] for b in blocks], [b["last"] for b in blocks]
        found: dict[int, list[str]] = {}
        for key in keys:
            for k in between(firsts, lasts, key):
                found.setdefault(k, []).append(key)
        return [(blocks[k], some) for k, some in sorted(found.items())]

    def hits(entries: list[list], wanted: list[str] | None) -> list[list]:
        if wanted is None:
            return entries
        own = [e[0] for e in entries]
        return [e for k in wanted for e in entries[bisect.bisect_left(own, k) : bisect.bisect_right(own, k)]]

    def run(batches):
        archive_fs, archive_at = filesystem(archives)
        index_fs, index_at = filesystem(index)
        held: dict[str, pa.NativeFile] = {}

        def ranged(fs, path: str, at: int, size: int) -> bytes:
            if path not in held:
                if len(held) > 64:
                    held.pop(next(iter(held))).close()
                held[path] = fs.open_input_file(path)
            return held[path].read_at(size, at)

        for rows in batches:
            for file in rows.to_pylist():
                for block, wanted in blocks_with(file["blocks"]):
                    entries = hits(unpack_block(ranged(index_fs, f"{index_at}/{file['file']}", block["at"], block["size"])), wanted)
                    found = [record_row(ranged(archive_fs, f"{archive_at}/{name}", at, size)) for _, _, name, at, size in entries]
                    if found:
                        yield batch(schema, *zip(*found, strict=True))
        for file in held.values():
            file.close()

    return files.mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives and index, then read every record back through the index."""
    spark = pages.sparkSession
    archives, index = new_folder(spark, "warc"), new_folder(spark, "warc-index")
    directory = write_index(write_archives(pages, archives, least_bytes), index)
    return read_captures(directory, archives, index)


def lookup(spark: SparkSession, directory: DataFrame, archives: str, index: str, urls: list[str]) -> DataFrame:
    """Records of a short list of urls."""
    return read_captures(directory, archives, index, urls)
