"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes says so, so equal passages of different documents give equal
chunks. Each distinct chunk is encoded once per Python worker (a bounded table kept between tasks); a document's ids
are gathered from its chunks. A cut may fall inside a word: there the chunks' ids beside the join are dropped and the
word is encoded anew. It is also encoded together with the words around it; if that doesn't give the word's ids between
those of its neighbours, the repair goes on to the next place where encodings agree for certain, the document's ends.

Sharing is per worker, not global: sending every chunk's text to one place and its ids back would shuffle several
times the input, while encoding is bounded by the distinct pieces of words either way.

Nulls and empty texts have no ids (n_tokens 0, digests of no bytes). Repeated rows give repeated rows. A null doc_id
stays null. An empty table gives no rows. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelaudit.llm.common import batch, text_chunks, text_frame, tune
from labelaudit.llm.encoding import CHUNK_BYTES, KnownBytes, PieceEncoder, default_tokenizer, encoder
from labelaudit.llm.segments import SEPARATOR, RangeHash, distinct_ranges, gather, mixed, words

#: Bytes that the rolling hash looks at, and one cut in so many places.
WINDOW, MEAN_CHUNK = 16, 128
#: Ids of chunks that a worker keeps.
MAX_IDS = 6_000_000

OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def cuts(buf: np.ndarray, offs: np.ndarray, window: int = WINDOW, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Starts of chunks: every row's start, and where the hash of the bytes before says so, between characters."""
    first = offs[:-1][offs[:-1] < offs[1:]]
    if len(buf) <= window:
        return first
    rolling = buf.astype(np.uint64)
    width = 1
    while width < window:  # after each step an entry covers twice the bytes
        rolling = mixed(rolling[:-width] * np.uint64(0x9E3779B97F4A7C15) + rolling[width:])
        width *= 2
    at = np.flatnonzero(rolling % np.uint64(mean) == 0) + width
    at = at[at < len(buf)]
    row = np.searchsorted(offs, at, side="right") - 1
    at = at[(at - offs[row] >= width) & ((buf[at] & 0xC0) != 0x80)]
    return np.union1d(first, at)


class ChunkEncoder:
    """encode(bytes, offsets) gives ids and the place of each row's first id, like the piece encoder beneath it."""

    def __init__(self, pieces: PieceEncoder, max_ids: int = MAX_IDS):
        self.pieces, self.max_ids = pieces, max_ids
        self.reused = self.seen = 0
        self._clear()

    def _clear(self) -> None:
        self._keys, self._slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._ids, self._bounds = np.zeros(0, np.uint32), np.zeros((0, 4), np.int64)
        self._known = KnownBytes()

    def _table(self, buf, starts, ends, heads, tails):
        """Row of self._bounds for each chunk: places of its head, body, tail and end in self._ids."""
        hashes = RangeHash(buf)(starts, ends)
        first, which = distinct_ranges(buf, starts, ends, hashes)
        keys, at, to = hashes[first], starts[first], ends[first]
        no_flag = np.zeros(len(first), bool)
        if len(self._ids) > self.max_ids:
            self._clear()
        slots = np.full(len(first), -1, np.int64)
        free = np.ones(len(first), bool)  # keys not in the table yet
        if len(self._keys):
            near = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
            met = np.flatnonzero(self._keys[near] == keys)
            free[met] = False
            met = met[self._known.equal(self._slots[near[met]], buf, at[met], to[met], no_flag[met])]
            slots[met] = self._slots[near[met]]
        new = np.flatnonzero(slots < 0)
        self.seen += len(which)
        self.reused += len(which) - len(new)
        if len(new):
            k = first[new]
            text = buf[gather(starts[k], ends[k] - starts[k])]
            parts = np.stack([heads[k] - starts[k], tails[k] - heads[k], ends[k] - tails[k]], 1).ravel()
            offs = np.concatenate([[0], np.cumsum(parts)])
            ids, bounds = self.pieces.encode(text, offs)
            bounds = bounds + len(self._ids)
            slots[new] = np.arange(len(self._bounds), len(self._bounds) + len(new))
            rows = np.stack([bounds[0:-1:3], bounds[1::3], bounds[2::3], bounds[3::3]], 1)
            self._bounds, self._ids = np.concatenate([self._bounds, rows]), np.concatenate([self._ids, ids])
            self._known.add(buf, at[new], to[new], no_flag[new])
            own_keys, place = np.unique(keys[new], return_index=True)
            own = new[place]
            own_keys, own = own_keys[free[own]], own[free[own]]
            where = np.searchsorted(self._keys, own_keys)
            self._slots = np.insert(self._slots, where, slots[own])
            self._keys = np.insert(self._keys, where, own_keys)
        return self._bounds[slots[which]]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        starts = cuts(buf, offs)
        ends = np.append(starts[1:], len(buf))
        word_start, word_end = words(buf, offs)
        # the head ends where the word at the chunk's start ends; the tail begins where the word at its end begins
        heads, tails = starts.copy(), ends.copy()
        if len(word_start):
            k = np.searchsorted(word_start, starts, side="right") - 1
            inside = (k >= 0) & (word_end[k] > starts)
            heads[inside] = np.minimum(word_end[k[inside]], ends[inside])
            k = np.searchsorted(word_start, ends, side="left") - 1
            inside = (k >= 0) & (word_end[k] >= ends)
            tails[inside] = np.maximum(word_start[k[inside]], starts[inside])
        tails = np.maximum(tails, heads)
        table = self._table(buf, starts, ends, heads, tails)
        # a join is broken where a word goes on across it
        row_start = np.isin(starts, offs[:-1])
        broken = np.zeros(len(starts) + 1, bool)
        at = starts[~row_start]
        broken[:-1][~row_start] = ~SEPARATOR[buf[at - 1]] & ~SEPARATOR[buf[at]]
        alone = (heads == ends) & (tails == ends)  # one word or part of one: its ids are all in the head
        from_head = ~broken[:-1] & ~(alone & broken[1:])
        lo = np.where(from_head, table[:, 0], table[:, 1])
        hi = np.where(broken[1:], table[:, 2], table[:, 3])
        hi = np.maximum(hi, lo)
        where = np.where(broken[:-1], heads, starts)
        # the words around broken joins, encoded anew
        joins = starts[broken[:-1]]
        k = np.unique(np.searchsorted(word_start, joins, side="right") - 1)
        repair_at, repair_to = word_start[k], word_end[k]
        lengths = repair_to - repair_at
        repaired, bounds = self._encoded(buf, repair_at, lengths)
        odd = np.unique(np.searchsorted(offs, repair_at[~self._agrees(buf, offs, word_start, word_end, k, repaired, bounds)], side="right") - 1)
        pool = np.concatenate([self._ids, repaired])
        item_at = np.concatenate([where, repair_at])
        item_lo = np.concatenate([lo, len(self._ids) + bounds[:-1]])
        item_n = np.concatenate([hi - lo, np.diff(bounds)])
        keep = item_n > 0
        item_at, item_lo, item_n = item_at[keep], item_lo[keep], item_n[keep]
        order = np.argsort(item_at, kind="stable")
        item_at, item_lo, item_n = item_at[order], item_lo[order], item_n[order]
        before = np.concatenate([[0], np.cumsum(item_n)])
        return self._replaced(pool[gather(item_lo, item_n)], before[np.searchsorted(item_at, offs)], buf, offs, odd)

    def _encoded(self, buf: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some ranges, each by itself, and where each one's begin."""
        return self.pieces.encode(buf[gather(at, n)], np.concatenate([[0], np.cumsum(n)]))

    def _agrees(self, buf, offs, word_start, word_end, k, repaired, bounds) -> np.ndarray:
        """Whether words encoded together with the words around them give the ids of the three by themselves."""
        row = np.searchsorted(offs, word_start[k], side="right") - 1
        before = np.where((k > 0) & (word_start[np.maximum(k - 1, 0)] >= offs[row]), k - 1, k)
        last = len(word_start) - 1
        after = np.where((k < last) & (word_start[np.minimum(k + 1, last)] < offs[row + 1]), k + 1, k)
        wide, wide_at = self._encoded(buf, word_start[before], word_end[after] - word_start[before])
        left, left_at = self._encoded(buf, word_start[before], np.where(before < k, word_end[before] - word_start[before], 0))
        right, right_at = self._encoded(buf, word_start[after], np.where(after > k, word_end[after] - word_start[after], 0))
        n = np.stack([np.diff(left_at), np.diff(bounds), np.diff(right_at)], 1)
        fine = n.sum(1) == np.diff(wide_at)
        pool = np.concatenate([left, repaired, right])
        at = np.stack([left_at[:-1], len(left) + bounds[:-1], len(left) + len(repaired) + right_at[:-1]], 1)
        ok = np.flatnonzero(fine)
        apart = pool[gather(at[ok].ravel(), n[ok].ravel())]
        together = wide[gather(wide_at[:-1][ok], n[ok].sum(1))]
        owner = np.repeat(ok, n[ok].sum(1))
        fine[owner[apart != together]] = False
        return fine

    def _replaced(self, ids: np.ndarray, bounds: np.ndarray, buf: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with those of some rows taken from the rows' whole texts instead."""
        if not len(rows):
            return ids, bounds
        whole, whole_at = self._encoded(buf, offs[:-1][rows], np.diff(offs)[rows])
        at, n = bounds[:-1].copy(), np.diff(bounds)
        at[rows], n[rows] = len(ids) + whole_at[:-1], np.diff(whole_at)
        return np.concatenate([ids, whole])[gather(at, n)], np.concatenate([[0], np.cumsum(n)])


class Decoder:
    """Decoded bytes of ids, as the library joins tokens where the file names no decoder: with single spaces."""

    def __init__(self, pieces: PieceEncoder):
        size = max(pieces.vocabulary.values()) + 1
        texts = [b""] * size
        for token, i in pieces.vocabulary.items():
            texts[i] = token.encode() + b" "
        self.length = np.fromiter(map(len, texts), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(texts), np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, and where each row's begin; each row ends with one space too many."""
        n = self.length[ids]
        before = np.concatenate([[0], np.cumsum(n)])
        return self.flat[gather(self.start[ids], n)], before[bounds]


_state: dict[str, tuple[ChunkEncoder, Decoder]] = {}


def chunk_encoder(path: str) -> tuple[ChunkEncoder, Decoder]:
    if path not in _state:
        pieces = encoder(path)
        _state[path] = ChunkEncoder(pieces), Decoder(pieces)
    return _state[path]


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string for each row of docs."""
    tune(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        chunks, decoder = chunk_encoder(path)
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            ids, bounds = chunks.encode(buf, offs)
            data, at = decoder.decode(ids, bounds)
            text = data.tobytes()
            decoded = [text[a : max(a, b - 1)].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, pa.array(decoded)], schema=schema)

    return text_frame(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs, without moving ids out of the task."""
    tune(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches):
        chunks, decoder = chunk_encoder(path)
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            ids, bounds = chunks.encode(buf, offs)
            data, at = decoder.decode(ids, bounds)
            raw, text = memoryview(ids.astype("<u4").view(np.uint8)), memoryview(data)
            pairs = list(zip((bounds * 4).tolist()[:-1], (bounds * 4).tolist()[1:], at.tolist()[:-1], at.tolist()[1:], strict=True))
            yield batch(
                OUT,
                rows.column("doc_id"),
                np.diff(bounds),
                [hashlib.sha256(raw[a:b]).hexdigest() for a, b, _, _ in pairs],
                [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for _, _, a, b in pairs],
            )

    return text_frame(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
