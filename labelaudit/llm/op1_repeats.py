"""Suffix-array dedup: maximal repeated byte strings of a corpus, and their removal but for the first place.

Every window of `least` bytes has an anchor, the leftmost smallest of its k-byte hashes, which depends on the window
alone; so equal windows, wherever they start, have equal anchors at equal places. Consecutive windows with one anchor
make a context: their bytes, about `least` and a third. Contexts are few (one in about 35 bytes) and all equal windows
meet under the hash of their anchor:

1. Anchor and context hashes are sent, not bytes. A context equal to an earlier one repeats as a whole, and an anchor
   seen with one context alone repeats nowhere. Only contexts that share an anchor but not all bytes go on.
2. Their bytes are dealt by anchor, and each task builds an enhanced suffix array (order, common-prefix lengths, byte
   to the left) over the windows of its contexts. A stack scan gives the common-prefix intervals of at least `least`
   bytes; an interval whose occurrences differ to the left, or begin a context, is a maximal repeat group, reported
   with all its occurrences. Longer repeats appear as groups of consecutive contexts that overlap.
3. The spans of all occurrences but the first are joined to the documents and united.

An anchor that a sample shows to be frequent is salted in step 1. Its contexts, and those of any anchor that more than
`WIDE` others share, skip step 2: the first place of each of their windows is found by hash with partial aggregation,
and a document keeps of these windows only the bytes of its first places. So a passage that a third of all documents
share is in no single task, and a suffix array never holds more than about `WIDE` contexts of an anchor. Which way is
taken never changes the result.

Contexts and windows count as equal if two hashes over the prime 2**61 - 1 agree (of the second 32 bits, for contexts).
Their bases are drawn anew for each search, so two given strings of 170 bytes agree by chance in less than one of 2**80
searches, whatever the strings are.

Null text is empty. Texts shorter than `least` bytes are never cut. Long texts are worked through in blocks. Rows that
share a doc_id are ordered by text and treated as documents in that order. Rows with a null doc_id are left whole,
nothing is cut on their account, and they are not shuffled. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from labelaudit.llm.common import batch, partitions, stored, text_chunks, text_frame, tune
from labelaudit.llm.segments import BASE, PRIME, U64, RangeHash, gather, mixed, spans, sums_by_row

LEAST, K = 100, 32
CHUNK_BYTES, BLOCK = 1 << 20, 1 << 20
SAMPLE_DOCS, SALTS = 20_000, 256
#: Contexts of one anchor that a suffix array takes.
WIDE = 4096
#: A place in a text holds, above these bits, which of the rows with this doc_id it is in.
TURN_BITS = 40
SUFFIX_BYTES = 1 << 20
SPAN, WINDOWS, FIRST = 0, 1, 2
#: Anchors are chosen by a hash modulo 2**64; what has equal ones is compared by other means.
GRAM_BASE = 0x9E3779B97F4A7C15
GRAM_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1 << 62)


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each place; k is a power of two."""
    h, width = GRAM_TABLE[buf], 1
    while width < k:
        h = h[:-width] * U64(pow(GRAM_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    return mixed(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def contexts(buf: np.ndarray, offs: np.ndarray, least: int = LEAST, k: int = K, bases: tuple[int, int] = (BASE, BASE + 2)):
    """Runs of windows with one anchor: hash of the anchor, two of the context's bytes, row, first window, windows."""
    none = np.zeros(0, np.int64)
    long_enough = np.diff(offs) >= least
    if not long_enough.any():
        return (*[none.astype(np.uint64)] * 3, none, none, none)
    valid = np.zeros(len(buf) + 1, np.int8)
    valid[offs[:-1][long_enough]] += 1
    valid[offs[1:][long_enough] - least + 1] -= 1
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    firsts, anchors, hashes = [], [], []
    low = U64((1 << 24) - 1)
    for at in range(0, len(buf) - least + 1, BLOCK):
        part = buf[at : at + BLOCK + least - 1]
        h = gram_hashes(part, k)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_min(key, least - k + 1) & low).astype(np.int64)
        ok = valid[at : at + len(anchor)]
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
        first = np.flatnonzero(new)
        firsts.append(first + at)
        anchors.append(anchor[first] + at)
        hashes.append(h[anchor[first]])
    first, anchor, h = np.concatenate(firsts), np.concatenate(anchors), np.concatenate(hashes)
    # a run that goes on over the edge of a block is one run
    same = np.zeros(len(first), bool)
    same[1:] = (anchor[1:] == anchor[:-1]) & (first[1:] % BLOCK == 0) & valid[first[1:] - 1]
    first, h = first[~same], h[~same]
    row = np.searchsorted(offs, first, side="right") - 1
    end = np.append(first[1:], len(buf))
    windows = np.minimum(end, offs[1:][row] - least + 1) - first
    c, d = (RangeHash(buf, base)(first, first + windows + least - 1) for base in bases)
    return h, c, d, row, first - offs[row], windows


class SuffixArray:
    """Enhanced suffix array of the first `windows` suffixes of each of some byte strings, given one after another."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, windows: np.ndarray, skip: np.ndarray):
        """skip: bytes before a string's first suffix (0 or 1: the byte to its left, if it has one)."""
        lengths = np.diff(offs)
        places = np.cumsum(lengths + 1) - (lengths + 1)
        text = np.zeros(int((lengths + 1).sum()) + 256, np.uint8)
        # valid UTF-8 has no byte above F4, so 0 can end each string and sort before every byte
        text[gather(places, lengths)] = buf + 1
        self.string = np.repeat(np.arange(len(lengths)), windows)
        inner = gather(np.zeros(len(windows), np.int64), windows)
        start = (places + skip)[self.string] + inner
        rest = (places + lengths)[self.string] - start
        word = np.zeros(len(text) - 8, np.uint64)
        for k in range(8):
            word |= text[k : len(text) - 8 + k].astype(np.uint64) << U64(56 - 8 * k)
        self._rank = {8: word}
        below = word
        for width in (16, 32, 64):
            half = width // 2
            if width == 16:
                below = np.unique(below, return_inverse=True)[1].astype(np.uint64)
            pairs = below[: len(below) - half] << U64(32) | below[half:]
            below = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
            self._rank[width] = below
        r = self._rank[64]
        reach = lambda d: r[np.minimum(start + d, len(r) - 1)]
        self.order = np.lexsort((reach(128), reach(64), r[start]))
        self.start, self.rest, self.inner = start[self.order], rest[self.order], inner[self.order]
        self.string = self.string[self.order]
        self.left = np.where((self.inner > 0) | (skip[self.string] > 0), text[self.start - 1], 0)
        self.text_size = len(text)
        self.places = places
        self.prefix = self._prefixes()

    def _prefixes(self) -> np.ndarray:
        """Common prefix of each suffix with the one before it in order; 0 for the first."""
        a, b = self.start[:-1].copy(), self.start[1:].copy()
        for width in (64, 64, 32, 16, 8):
            rank = self._rank[width]
            same = rank[np.minimum(a, len(rank) - 1)] == rank[np.minimum(b, len(rank) - 1)]
            a += width * same
            b += width * same
        word = self._rank[8]
        differ = word[np.minimum(a, len(word) - 1)] ^ word[np.minimum(b, len(word) - 1)]
        for k in range(7):
            a += differ < U64(1) << U64(56 - 8 * k)
        common = a - self.start[:-1]
        return np.concatenate([[0], np.minimum(common, np.minimum(self.rest[:-1], self.rest[1:]))])

    def intervals(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Common-prefix intervals of at least `least` bytes: first and last place in order, and length."""
        long = np.append(self.prefix >= least, False)
        edge = np.flatnonzero(long[1:] & ~long[:-1])  # the place before a run's first long prefix
        stop = np.flatnonzero(long[:-1] & ~long[1:]) if len(edge) else edge
        if not len(edge):
            return edge, edge, edge
        top = np.maximum.reduceat(np.where(long[:-1], self.prefix, 0), edge + 1)
        low = np.minimum.reduceat(np.where(long[:-1], self.prefix, np.iinfo(np.int64).max), edge + 1)
        plain = low == top
        out_l, out_r, out_n = [edge[plain]], [stop[plain]], [low[plain]]
        deep_l, deep_r, deep_n = [], [], []
        for first, last in zip(edge[~plain].tolist(), stop[~plain].tolist(), strict=True):
            stack: list[tuple[int, int]] = []  # length, first place
            for i, n in enumerate([*self.prefix[first + 1 : last + 1].tolist(), 0], first + 1):
                begin = i - 1
                while stack and stack[-1][0] > n:
                    length, begin = stack.pop()
                    deep_l.append(begin)
                    deep_r.append(i - 1)
                    deep_n.append(length)
                if n >= least and (not stack or stack[-1][0] < n):
                    stack.append((n, begin))
        out_l.append(np.array(deep_l, np.int64))
        out_r.append(np.array(deep_r, np.int64))
        out_n.append(np.array(deep_n, np.int64))
        return np.concatenate(out_l), np.concatenate(out_r), np.concatenate(out_n)

    def maximal(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those intervals whose occurrences differ in the byte to the left, or have one at a string's first byte."""
        first, last, length = self.intervals(least)
        differ = np.zeros(len(self.left) + 1, np.int64)
        np.cumsum(np.append(self.left[1:] != self.left[:-1], False), out=differ[1:])
        opens = np.zeros(len(self.left) + 1, np.int64)
        np.cumsum(self.inner == 0, out=opens[1:])
        diverse = (differ[last] > differ[first]) | (opens[last + 1] > opens[first])
        return first[diverse], last[diverse], length[diverse]


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _own_key(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, list[str]]:
    """doc_id, text and turn, which tells rows of one doc_id apart (0 where ids are unique), carried columns as `rest`; and the columns that name a row.

    A constant turn is no key: the optimizer would drop it from joins, and texts dealt by it be shuffled again for each.
    """
    frame = text_frame(docs)
    if carry:
        frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[_quoted(c).alias(c) for c in carry]).alias("rest"))
    first = frame.withColumn("turn", F.lit(0).cast("long"))
    if frame.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return first, ["doc_id"]
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1
    known = frame.where("doc_id is not null").withColumn("turn", turn.cast("long"))
    return stored(known.unionByName(first.where("doc_id is null")), "turned"), ["doc_id", "turn"]


def _by_row(places: DataFrame, keys: list[str], item: Column, name: str) -> DataFrame:
    """The items of each row of the documents as a list; a place's high bits are its row's turn."""
    return places.withColumn("turn", F.shiftright("a", TURN_BITS)).groupBy(*keys).agg(F.collect_list(item).alias(name))


def _anchors(keyed: DataFrame, least: int, k: int, hot: np.ndarray, bases: tuple[int, int] = (BASE, BASE + 2)) -> DataFrame:
    schema = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("c", pa.int64()), ("d", pa.int32()), ("doc_id", pa.int64()), ("a", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            h, c, d, row, at, n = contexts(buf, offs, least, k, bases)
            h, ids = h.view(np.int64), rows.column("doc_id").to_numpy()[row]
            a = at + (rows.column("turn").to_numpy()[row] << TURN_BITS)
            # by place: one text can hold an anchor thousands of times, too
            spread = mixed(ids.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + a.astype(np.uint64)) % U64(SALTS) + U64(1)
            salt = np.where(np.isin(h, hot), spread, U64(0)) if len(hot) else np.zeros(len(h))
            yield batch(schema, h, salt.astype(np.int32), c.view(np.int64), d.astype(np.uint32).view(np.int32), ids, a, n)

    return keyed.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "turn").mapInArrow(run, "h long, salt int, c long, d int, doc_id long, a long, n int")


def frequent_anchors(keyed: DataFrame, least: int, k: int, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Anchors that would fill a fair share of a partition by themselves, judged from a sample; at most about twice as many as partitions."""
    spark = keyed.sparkSession
    total = keyed.count()
    sample = keyed if total <= sample_docs else keyed.sample(sample_docs / total, 11)
    size = sample.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    fair = max(64, int(size / (least - k + 2) * 2 / (2 * partitions(spark))))
    found = _anchors(sample, least, k, np.zeros(0, np.int64)).groupBy("h").count().where(F.col("count") > fair)
    return np.array(sorted(r["h"] for r in found.select("h").collect()), np.int64)


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    """doc_ids; rows without one have no contexts, so 0 may stand for null."""
    return pa.compute.fill_null(rows.column("doc_id"), 0).to_numpy()


def _slices(buf: np.ndarray, offs: np.ndarray, needs: pa.Array, least: int):
    """For each wanted context of each row: row, anchor, place, windows, and its bytes with the byte to the left."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(needs), 0)).astype(np.int64)
    rows, flat = np.repeat(np.arange(len(lengths)), lengths), needs.flatten()
    h, a, n = (flat.field(c).to_numpy().astype(np.int64) for c in ("h", "a", "n"))
    start = offs[:-1][rows] + (a & ((1 << TURN_BITS) - 1))
    skip = (start > offs[:-1][rows]).astype(np.int64)
    return rows, h, a, n, start - skip, n + least - 1 + skip, skip


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Batches joined and cut so that each holds whole anchors, of about SUFFIX_BYTES."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        if size >= SUFFIX_BYTES:
            both = pa.concat_batches([*held, b])
            h = both.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield both.slice(0, cut)
                both = both.slice(cut)
            held, size = [both], int(pa.compute.sum(pa.compute.binary_length(both.column("bytes"))).as_py())
        else:
            held.append(b)
            size += int(pa.compute.sum(pa.compute.binary_length(b.column("bytes"))).as_py())
    if held:
        yield pa.concat_batches(held)


def suffix_groups(rows: pa.RecordBatch, least: int):
    """Maximal groups over some contexts: the array, and first, last and length of each."""
    offs = np.concatenate([[0], np.cumsum(pa.compute.binary_length(rows.column("bytes")).to_numpy())]).astype(np.int64)
    buf = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8)
    array = SuffixArray(buf, offs, rows.column("n").to_numpy().astype(np.int64), rows.column("skip").to_numpy().astype(np.int64))
    return array, array.maximal(least)


def _positions(rows: pa.RecordBatch, array: SuffixArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id and place of each suffix in order, and its rank among all by (doc_id, place)."""
    ids = rows.column("doc_id").to_numpy()[array.string]
    at = rows.column("a").to_numpy()[array.string] + array.inner
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((at, ids))] = np.arange(len(ids))
    return ids, at, rank


def _first_of(rank: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place in order of the lowest rank within each interval."""
    n = last - first + 1
    at = gather(first, n)
    group = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((rank[at], group))
    return at[order][np.cumsum(n) - n]


class Repeats:
    """The steps of the search, for one table of documents."""

    def __init__(self, docs: DataFrame, least: int = LEAST, k: int = K, carry: list[str] | None = None):
        if not k <= least or 2 * least - k + 1 > 192:
            raise ValueError("contexts would be longer than the 192 bytes that suffixes are sorted by")
        tune(docs.sparkSession)
        self.least, self.k = least, k
        self.bases = tuple(secrets.randbelow(PRIME - 300) + 300 for _ in range(2))
        self.keyed, self.row = _own_key(docs, carry or [])
        # the joins below read the same columns, so that they share one shuffle of the texts
        self.columns = ["doc_id", "text", "turn", *(["rest"] if carry else [])]
        self.hot = frequent_anchors(self.keyed, least, k)
        self.dealt = self.keyed.where("doc_id is not null").repartition(*self.row)  # used by several joins below, and shuffled once

    def marked(self, everything: bool = False) -> DataFrame:
        """Contexts that repeat as a whole (again) or may in part. everything: also keep the equal ones for the suffix arrays."""
        spread = _anchors(self.keyed, self.least, self.k, self.hot, self.bases).repartition("h", "salt")
        same, anchor = Window.partitionBy("h", "salt", "c", "d"), Window.partitionBy("h", "salt")
        spread = spread.withColumn("again", F.row_number().over(same.orderBy("doc_id", "a")) > 1)
        differ = (F.min("c").over(anchor) != F.max("c").over(anchor)) | (F.min("d").over(anchor) != F.max("d").over(anchor))
        other = F.count_if(~F.col("again")).over(anchor)  # contexts that a suffix array would get
        spread = spread.withColumns({"mixed": F.count("*").over(anchor) > 1 if everything else differ, "wide": (F.col("salt") > 0) | (other > WIDE)})
        wanted = F.col("again") | F.col("mixed") | (F.col("salt") > 0)
        return stored(spread.where(wanted).select("doc_id", "a", "n", "h", "wide", "again"), "contexts")

    def context_bytes(self, wanted: DataFrame) -> DataFrame:
        """h, doc_id, a, n, skip and bytes of each wanted context."""
        lists = _by_row(wanted, self.row, F.struct("a", "n", "h"), "needs")
        schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("a", pa.int64()), ("n", pa.int32()), ("skip", pa.int32()), ("bytes", pa.binary())])
        least = self.least

        def run(batches):
            for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
                row, h, a, n, start, length, skip = _slices(buf, offs, rows.column("needs"), least)
                if len(row):
                    flat = buf[gather(start, length)].tobytes()
                    cut = np.concatenate([[0], np.cumsum(length)]).tolist()
                    data = [flat[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    yield batch(schema, h, _ids(rows)[row], a, n, skip, data)

        joined = self.dealt.join(lists, self.row, "left").select(*self.columns, "needs")
        return joined.mapInArrow(run, "h long, doc_id long, a long, n int, skip int, bytes binary")

    def from_suffix_arrays(self, wanted: DataFrame) -> DataFrame:
        """Spans (doc_id, a, n) of later occurrences of maximal groups."""
        least = self.least
        schema = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("n", pa.int64())])

        def run(batches):
            for rows in _groups(batches):
                array, (first, last, length) = suffix_groups(rows, least)
                if not len(first):
                    continue
                _, _, rank = _positions(rows, array)
                n = last - first + 1
                at, size = gather(first, n), np.repeat(length, n)
                later = at != np.repeat(_first_of(rank, first, last), n)
                cover = np.zeros(array.text_size + 1, np.int64)
                begin = array.start[at[later]]
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + size[later], -1)
                begin, end = spans(np.cumsum(cover) > 0, np.array([0, len(cover)]))
                string = np.searchsorted(array.places, begin, side="right") - 1
                at = rows.column("a").to_numpy()[string] + begin - array.places[string] - rows.column("skip").to_numpy()[string]
                yield batch(schema, rows.column("doc_id").to_numpy()[string], at, end - begin)

        dealt = self.context_bytes(wanted).repartition("h").sortWithinPartitions("h")
        return dealt.mapInArrow(run, "doc_id long, a long, n long")

    def groups(self) -> DataFrame:
        """All maximal repeat groups: anchor, place of the first occurrence (first_doc_id, first_start), length, doc_id, start.

        An occurrence's start counts from its document's beginning. Frequent anchors are included: this is for reports,
        not for the largest corpora.
        """
        self.hot = np.zeros(0, np.int64)
        wanted = self.marked(everything=True)
        least, mask = self.least, (1 << TURN_BITS) - 1
        names = ["anchor", "first_doc_id", "first_start", "length", "doc_id", "start"]
        schema = pa.schema([(c, pa.int64()) for c in names])

        def run(batches):
            for rows in _groups(batches):
                array, (first, last, length) = suffix_groups(rows, least)
                ids, place, rank = _positions(rows, array)
                n = last - first + 1
                at, lead = gather(first, n), np.repeat(_first_of(rank, first, last), n)
                anchor = rows.column("h").to_numpy()[array.string[at]]
                yield batch(schema, anchor, ids[lead], place[lead] & mask, np.repeat(length, n), ids[at], place[at] & mask)

        dealt = self.context_bytes(wanted).repartition("h").sortWithinPartitions("h")
        return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))

    def first_windows(self, wanted: DataFrame) -> DataFrame:
        """doc_id and place of the first of all equal windows of some contexts."""
        least, bases = self.least, self.bases
        lists = _by_row(wanted, self.row, F.struct("a", "n", "h"), "needs")
        schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("a", pa.int64())])

        def run(batches):
            for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
                row, _, a, n, start, _, skip = _slices(buf, offs, rows.column("needs"), least)
                if len(row):
                    at, inner = gather(start + skip, n), gather(np.zeros(len(n), np.int64), n)
                    one, two = (RangeHash(buf, base)(at, at + least).view(np.int64) for base in bases)
                    yield batch(schema, one, two, np.repeat(_ids(rows)[row], n), np.repeat(a, n) + inner)

        joined = self.dealt.join(lists, self.row, "left").select(*self.columns, "needs")
        windows = joined.mapInArrow(run, "w1 long, w2 long, doc_id long, a long")
        return windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "a")).alias("first")).select("first.*")

    def removals(self) -> DataFrame:
        """doc_id, text, turn and what to remove of every row, as cuts (a, n, kind).

        Kinds: SPAN, n bytes from a; WINDOWS, the windows that begin at a and the next n - 1 places; FIRST, but for the
        one at a.
        """
        marks = self.marked()
        span = lambda n, kind: (n.cast("long").alias("n"), F.lit(kind).alias("kind"))
        again = marks.where("again").select("doc_id", "a", *span(F.col("n") + (self.least - 1), SPAN))
        parts = self.from_suffix_arrays(marks.where("not again and not wide")).select("doc_id", "a", *span(F.col("n"), SPAN))
        wide = marks.where("not again and wide")
        found = again.unionByName(parts).unionByName(wide.select("doc_id", "a", *span(F.col("n"), WINDOWS)))
        if not wide.isEmpty():  # else the texts needn't be read for it
            found = found.unionByName(self.first_windows(wide).select("doc_id", "a", *span(F.lit(1), FIRST)))
        lists = _by_row(found, self.row, F.struct("a", "n", "kind"), "cuts")
        out = self.dealt.join(lists, self.row, "left").select(*self.columns, "cuts")
        whole = self.keyed.where("doc_id is null").select(*self.columns, F.lit(None).cast(out.schema["cuts"].dataType).alias("cuts"))
        return out.unionByName(whole)


def removed_bytes(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which bytes the rows' cuts cover."""
    cuts = rows.column("cuts")
    if cuts.null_count == len(cuts):
        return np.zeros(len(buf), bool)
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(cuts), 0)).astype(np.int64)
    flat = cuts.flatten()
    row = np.repeat(np.arange(len(lengths)), lengths)
    a, n, kind = (flat.field(c).to_numpy() for c in ("a", "n", "kind"))
    begin = offs[:-1][row] + (a & ((1 << TURN_BITS) - 1))

    def covered(at: np.ndarray, to: np.ndarray) -> np.ndarray:
        edges = np.bincount(at, minlength=len(buf) + 1) - np.bincount(to, minlength=len(buf) + 1)
        return np.cumsum(edges[:-1]) > 0

    k = kind == WINDOWS
    starts = covered(begin[k], (begin + n)[k])
    starts[begin[kind == FIRST]] = False
    at, to = spans(starts, offs)
    k = kind == SPAN
    return covered(np.concatenate([begin[k], at]), np.concatenate([(begin + n)[k], to - 1 + least]))


def removal_digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            gone = removed_bytes(rows, buf, offs, least)
            removed = sums_by_row(gone, offs)
            starts, _ = spans(gone, offs)
            runs = np.diff(np.searchsorted(starts, offs))
            kept, at = memoryview(buf[~gone].tobytes()), offs - np.concatenate([[0], np.cumsum(removed)])
            digests = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield batch(schema, rows.column("doc_id"), np.diff(offs), removed, runs, digests)

    return Repeats(docs, least).removals().mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows and columns of docs with the text that is left (n_chars, if there is one, follows it).

    A character is removed only as a whole. Rows whose text was repeats alone are left out.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text")] or ["doc_id"]
    removals = Repeats(docs, least, carry=carry).removals()

    def run(batches):
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            gone = removed_bytes(rows, buf, offs, least)
            lead = np.flatnonzero((buf & 0xC0) != 0x80)
            if len(lead):
                gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(buf))))
            removed = sums_by_row(gone, offs)
            kept, at = buf[~gone].tobytes(), offs - np.concatenate([[0], np.cumsum(removed)])
            null = rows.column("text").is_null().to_pylist()
            texts = [None if n else kept[x:y].decode() for n, x, y in zip(null, at[:-1].tolist(), at[1:].tolist(), strict=True)]
            keep = [not r or bool(t and t.strip()) for r, t in zip(removed.tolist(), texts, strict=True)]
            out = pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string()), rows.column("rest")], names=["doc_id", "text", "rest"])
            yield out.filter(pa.array(keep, pa.bool_()))

    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("rest", removals.schema["rest"].dataType)])
    out = removals.mapInArrow(run, schema)
    columns = {c: F.col("rest").getField(c) for c in carry} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("text").isNull(), columns["n_chars"]).otherwise(F.length("text"))
    return out.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in docs.schema])
