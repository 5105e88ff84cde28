"""Exact batch encoding with a public lower-casing word-end BPE file (tokenizers library).

The tokenizer splits at white space, then into runs of letters, single digits and runs of other characters,
and encodes each such piece on its own. So a text's ids are those of its pieces in order: numpy finds the pieces
of many texts at once, the library's BPE model encodes each distinct piece, and the ids of all occurrences are
gathered. Pieces count as equal if their bytes are; hashes only find them. Words beyond ASCII and the Latin-1 letters, with an apostrophe, a control character or the mark of a
special token go to the library whole, so that its own normaliser and splitter decide.
"""

from __future__ import annotations

import os

import numpy as np

from labelaudit.llm.segments import RangeHash, distinct_ranges, eights, gather, row_bounds, same_bytes, words

#: Distinct pieces whose ids a Python worker keeps; those met later are encoded where they occur.
MAX_PIECES = 1_000_000
#: Bytes of text encoded at a time.
CHUNK_BYTES = 2 << 20
#: Pieces given to the library in one call.
CALL = 2000

LETTER, DIGIT, OTHER, SPACE, HARD = 0, 1, 2, 3, 4


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, HARD, np.uint8)
    kinds[0x21:0x7F] = OTHER
    for first, last, kind in ((0x30, 0x39, DIGIT), (0x41, 0x5A, LETTER), (0x61, 0x7A, LETTER), (0x09, 0x0D, SPACE), (0x20, 0x20, SPACE)):
        kinds[first : last + 1] = kind
    kinds[[ord("'"), ord("|")]] = HARD
    return kinds


KINDS = _byte_kinds()


class KnownBytes:
    """The bytes that each slot of a table stands for, to compare new ones with."""

    def __init__(self):
        self._buf, self._size = np.zeros(1 << 16, np.uint8), 0  # grows by doubling; eight spare bytes at the end
        self._at, self._n, self._flag = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, flag: np.ndarray) -> None:
        n = ends - starts
        self._at = np.concatenate([self._at, self._size + np.cumsum(n) - n])
        self._n, self._flag = np.concatenate([self._n, n]), np.concatenate([self._flag, flag])
        size = self._size + int(n.sum())
        if size + 8 > len(self._buf):
            more = np.zeros(max(2 * len(self._buf), size + 8), np.uint8)
            more[: self._size] = self._buf[: self._size]
            self._buf = more
        self._buf[self._size : size] = buf[gather(starts, n)]
        self._size = size

    def equal(self, slots: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, flag: np.ndarray) -> np.ndarray:
        out = (self._n[slots] == ends - starts) & (self._flag[slots] == flag)
        k = np.flatnonzero(out)
        words8 = np.ndarray(len(self._buf) - 7, "<u8", self._buf, strides=(1,))
        out[k] = same_bytes(words8, self._at[slots[k]], eights(buf), starts[k], (ends - starts)[k])
        return out


class PieceEncoder:
    """encode(bytes, offsets) gives all ids, and the place of the first id of each row."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.max_pieces = load_tokenizer(path), max_pieces
        self._pieces = Tokenizer(self.tokenizer.model)
        self._pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(self.vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in self.vocabulary.items() if t.endswith(suffix)]] = True
        self._letters = {b: c for b, c in byte_letters().items() if b != 0x20}
        self._keys = np.zeros(0, np.uint64)  # sorted
        self._slots = np.zeros(0, np.int64)
        self._ids, self._start, self._length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._known = KnownBytes()

    def _call(self, joined: list[bytes], whole: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has. whole: not a piece of one kind but a word for the full tokenizer."""
        ids: list[np.ndarray | None] = [None] * len(joined)
        hard = [k for k, w in enumerate(whole) if w]
        easy = [k for k, w in enumerate(whole) if not w]
        for at in range(0, len(hard), CALL):
            part = hard[at : at + CALL]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([joined[k].decode("utf-8") for k in part], add_special_tokens=False), strict=True):
                ids[k] = np.array(e.ids, np.uint32)
        for at in range(0, len(easy), CALL):
            part = easy[at : at + CALL]
            text = b" ".join([joined[k] for k in part]).decode("latin-1").translate(self._letters)
            found = np.array(self._pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) != len(part):
                raise ValueError("this tokenizer has no word-end form of some byte")
            for k, one in zip(part, np.split(found, cuts[:-1]), strict=True):
                ids[k] = one
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), lengths

    def _pieces_of(self, buf: np.ndarray, offs: np.ndarray):
        """Lower-cased bytes, and the starts, ends and hardness of the pieces."""
        kinds = KINDS[buf]
        low = buf.copy()
        low[(buf >= 0x41) & (buf <= 0x5A)] += 0x20
        lead = np.flatnonzero(buf == 0xC3)
        if len(lead):
            lead = lead[lead + 1 < len(buf)]
            tail = buf[lead + 1]
            fine = (tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)
            kinds[lead[fine]] = LETTER
            kinds[lead[fine] + 1] = LETTER
            low[lead[fine & (tail <= 0x9E)] + 1] += 0x20
        starts, ends = words(buf, offs)
        if (kinds == HARD).any():
            bad = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(kinds == HARD, out=bad[1:])
            hard = bad[ends] > bad[starts]
            inside = gather(starts[hard], (ends - starts)[hard])
            kinds[inside] = HARD
            low[inside] = buf[inside]
        first = np.ones(len(buf), bool)
        first[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
        first[starts] = True
        first &= kinds != SPACE
        at = np.flatnonzero(first)
        # a piece ends where the next begins, or where its word ends
        to = ends[np.searchsorted(starts, at, side="right") - 1]
        to[:-1] = np.minimum(to[:-1], at[1:])
        return low, at, to, kinds[at] == HARD

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        low, starts, ends, hard = self._pieces_of(buf, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        hashes = RangeHash(low)(starts, ends) ^ hard.astype(np.uint64)
        first, which = distinct_ranges(low, starts, ends, hashes, hard)
        distinct, at, to = hashes[first], starts[first], ends[first]
        slots = np.full(len(first), -1, np.int64)
        free = np.ones(len(first), bool)  # keys not in the table yet
        if len(self._keys):
            near = np.minimum(np.searchsorted(self._keys, distinct), len(self._keys) - 1)
            met = np.flatnonzero(self._keys[near] == distinct)
            free[met] = False
            met = met[self._known.equal(self._slots[near[met]], low, at[met], to[met], hard[first[met]])]
            slots[met] = self._slots[near[met]]
        new = np.flatnonzero(slots < 0)
        ids, start, length = self._ids, self._start, self._length
        if len(new):
            data = low.tobytes()
            texts = [data[s:e] for s, e in zip(at[new].tolist(), to[new].tolist(), strict=True)]
            new_ids, lengths = self._call(texts, hard[first[new]].tolist())
            slots[new] = np.arange(len(start), len(start) + len(new))
            start = np.concatenate([start, len(ids) + np.cumsum(lengths) - lengths])
            length = np.concatenate([length, lengths])
            ids = np.concatenate([ids, new_ids])
            if len(self._keys) < self.max_pieces:
                self._ids, self._start, self._length = ids, start, length
                self._known.add(low, at[new], to[new], hard[first[new]])
                keys, place = np.unique(distinct[new], return_index=True)
                own = new[place]
                keys, own = keys[free[own]], own[free[own]]
                where = np.searchsorted(self._keys, keys)
                self._slots = np.insert(self._slots, where, slots[own])
                self._keys = np.insert(self._keys, where, keys)
        slots = slots[which]
        lengths = length[slots]
        before = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        return ids[gather(start[slots], lengths)], before[row_bounds(starts, offs)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each Python worker and file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
