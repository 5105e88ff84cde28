"""Quality rules as a short-circuit cascade.

Base figures are counted for every document. The rules of the cascade see only documents that the base rule keeps, and
each rule only those that the rules before it kept, once these are under half of the documents at hand (until then a
vector operation over all costs less than copying the rest). Their order comes from the data: on a sample (about
`SAMPLE_ROWS` documents that the base rule keeps) each rule's cost and rejections are counted, and rules run by
rejections per cost, best first. The cost is what a rule adds to the base figures, which are there already: the bytes,
words and lines it goes through. So the order is the same in every run over the same rows. It changes the cost and which
of several rejecting rules `rejected_by` names (the first in order), never the verdict, which is that all rules keep
the document. Ties go by name.

Null text has no words. Empty and wordless texts fail the base rule (fewer than 50 words). Very long texts are counted
whole. Repeated rows get equal rows. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelaudit.llm.common import batch, text_chunks, text_frame, tune
from labelaudit.llm.segments import SEPARATOR, RangeHash, distinct_ranges, eights, gather, lines, mixed, row_bounds, same_bytes, sums_by_row, words

CHUNK_BYTES = 1 << 20
SAMPLE_ROWS = 2000
SYMBOLS = b"[#*$%&|<>]"[1:-1]

_flag = np.zeros(256, bool)
IS_SYMBOL, IS_UPPER, IS_LETTER = _flag.copy(), _flag.copy(), _flag.copy()
IS_SYMBOL[list(SYMBOLS)] = True
IS_UPPER[0x41:0x5B] = True
IS_LETTER[0x41:0x5B] = IS_LETTER[0x61:0x7B] = IS_LETTER[0xC3:] = True


def _within(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


class Rows:
    """Bytes of some documents and what rules read of them, each worked out once when asked for."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        #: Elements gone through so far, the measure of cost.
        self.cost = 0

    def take(self, keep: np.ndarray) -> Rows:
        lengths = np.diff(self.offs)[keep]
        return Rows(self.buf[gather(self.offs[:-1][keep], lengths)], np.concatenate([[0], np.cumsum(lengths)]))

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        self.cost += len(self.buf)
        return words(self.buf, self.offs)

    @cached_property
    def bounds(self) -> np.ndarray:
        return row_bounds(self.words[0], self.offs)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    @cached_property
    def range_hash(self) -> RangeHash:
        return RangeHash(self.buf)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        self.cost += len(self.buf) + len(self.words[0])
        return self.range_hash(*self.words)

    @cached_property
    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.n_words)

    def bytes_by_row(self, flags: np.ndarray) -> np.ndarray:
        self.cost += len(flags)
        return sums_by_row(flags, self.offs)

    def within(self, flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes lie in each range."""
        self.cost += len(flags) + len(starts)
        return _within(flags, starts, ends)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words with equal hashes are equal."""
        starts, ends = self.words
        self.cost += len(a)
        out = ends[a] - starts[a] == ends[b] - starts[b]
        k = np.flatnonzero(out)
        out[k] = same_bytes(self.eights, starts[a[k]], self.eights, starts[b[k]], (ends - starts)[a[k]])
        return out

    @cached_property
    def eights(self) -> np.ndarray:
        self.cost += len(self.buf)
        return eights(self.buf)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.bytes_by_row(~SEPARATOR[self.buf] & ((self.buf & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.bytes_by_row(IS_SYMBOL[self.buf])

    @cached_property
    def worded_lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, rows = lines(self.buf, self.offs)
        full = self.within(~SEPARATOR[self.buf], starts, ends) > 0
        return starts[full], ends[full], rows[full]

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.worded_lines[2], minlength=len(self.offs) - 1)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        starts, ends, rows = self.worded_lines
        self.cost += len(self.buf) + len(starts)
        first, _ = distinct_ranges(self.buf, starts, ends, _keyed(self.range_hash(starts, ends), rows), rows)
        return self.n_lines - np.bincount(rows[first], minlength=len(self.offs) - 1)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        h, rows = self.word_hashes, self.word_rows
        covered = np.zeros(len(h), bool)
        if len(h) >= 3:
            inside = np.flatnonzero(rows[2:] == rows[:-2])
            m = np.uint64(0x9E3779B97F4A7C15)
            triple = mixed(mixed(h[inside] * m + h[inside + 1]) * m + h[inside + 2])
            self.cost += 3 * len(inside)
            keys, todo = _keyed(triple, rows[inside]), np.arange(len(inside))
            while len(todo):
                _, first, which = np.unique(keys[todo], return_index=True, return_inverse=True)
                # repeats of the first window with their hash, word for word; others look for one of their own
                lead = todo[first[which]]
                later = np.flatnonzero(lead != todo)
                a, b = inside[todo[later]], inside[lead[later]]
                same = rows[a] == rows[b]
                for k in range(3):
                    at = np.flatnonzero(same)
                    same[at] = self.equal(a[at] + k, b[at] + k)
                for k in range(3):
                    covered[a[same] + k] = covered[b[same] + k] = True
                todo = todo[later[~same]]
        return sums_by_row(covered, self.bounds)


def _keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mixed(hashes + rows.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def many_symbols(r: Rows) -> np.ndarray:
    return 10 * r.n_symbols > r.n_words


def odd_word_length(r: Rows) -> np.ndarray:
    return (r.word_chars < 2 * r.n_words) | (r.word_chars > 15 * r.n_words)


def same_lines(r: Rows) -> np.ndarray:
    return 2 * r.n_dup_lines > r.n_lines


def shouting(r: Rows) -> np.ndarray:
    """Over half of the ASCII letters are capitals."""
    lower = IS_LETTER & ~IS_UPPER
    lower[0x80:] = False
    return r.bytes_by_row(IS_UPPER[r.buf]) > r.bytes_by_row(lower[r.buf])


def few_letters(r: Rows) -> np.ndarray:
    """Under 7 in 10 words hold a letter; bytes from C3 on begin letters of other scripts."""
    with_letter = r.within(IS_LETTER[r.buf], *r.words) > 0
    return 10 * sums_by_row(with_letter, r.bounds) < 7 * r.n_words


def stuttering(r: Rows) -> np.ndarray:
    """Over a third of the words equal the word before."""
    same = np.zeros(len(r.word_hashes), bool)
    same[1:] = (r.word_hashes[1:] == r.word_hashes[:-1]) & (r.word_rows[1:] == r.word_rows[:-1])
    k = np.flatnonzero(same)
    same[k] = r.equal(k, k - 1)
    r.cost += len(same)
    return 3 * sums_by_row(same, r.bounds) > r.n_words


def bulleted(r: Rows) -> np.ndarray:
    """Over 9 in 10 lines begin with a bullet or hyphen."""
    starts, _, rows = r.worded_lines
    b = r.buf[starts]
    r.cost += len(starts)
    mark = (b == 0x2D) | (b == 0x2A)
    near = starts + 2 < len(r.buf)
    mark[near] |= (b[near] == 0xE2) & (r.buf[starts[near] + 1] == 0x80) & (r.buf[starts[near] + 2] == 0xA2)
    return 10 * np.bincount(rows, mark, minlength=len(r.offs) - 1) > 9 * np.maximum(r.n_lines, 1)


#: Base figures of every document.
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each says which documents it rejects.
RULES: dict[str, Callable[[Rows], np.ndarray]] = {
    f.__name__: f for f in (many_symbols, odd_word_length, same_lines, shouting, few_letters, stuttering, bulleted)
}


def base_failed(r: Rows, least_words: int = 50) -> np.ndarray:
    return (r.n_words < least_words) | (100 * r.n_repeat_words > 50 * r.n_words)


def cascade(r: Rows, alive: np.ndarray, order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Who is kept, and the place in the order of the rule that rejected (-1: none)."""
    alive, by = alive.copy(), np.full(len(alive), -1, np.int32)
    rows, places = r, np.arange(len(alive))  # rows holds the documents at these places
    for k, name in enumerate(order):
        left = alive[places]
        if not left.any():
            break
        if 2 * left.sum() < len(left):
            rows, places = rows.take(left), places[left]
        bad = places[RULES[name](rows)]
        bad = bad[alive[bad]]
        alive[bad], by[bad] = False, k
    return alive, by


def rule_order(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[str]:
    """Names of the rules by rejections per cost among a sample's documents that the base rule keeps, best first."""
    tune(docs.sparkSession)
    total = docs.count()
    sample = docs if total <= sample_rows else docs.sample(sample_rows / total, seed)
    schema = pa.schema([("rule", pa.string()), ("cost", pa.int64()), ("rejected", pa.int64())])

    def run(batches):
        for _, buf, offs in text_chunks(batches, CHUNK_BYTES):
            rows = Rows(buf, offs)
            rows = rows.take(~base_failed(rows))
            for name, rule in RULES.items():
                fresh = Rows(rows.buf, rows.offs)
                for figure in FIGURES:
                    getattr(fresh, figure)  # what the cascade finds counted
                before = fresh.cost
                bad = int(rule(fresh).sum())
                yield batch(schema, [name], [fresh.cost - before + len(offs)], [bad])

    counted = text_frame(sample).mapInArrow(run, "rule string, cost long, rejected long")
    found = {r["rule"]: r["worth"] for r in counted.groupBy("rule").agg(F.try_divide(F.sum("rejected"), F.sum("cost")).alias("worth")).collect()}
    return sorted(RULES, key=lambda name: (-(found.get(name) or 0.0), name))


def quality_rules(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Base figures, verdict and the rejecting rule (null: none) for each row of docs."""
    tune(docs.sparkSession)
    order = rule_order(docs) if order is None else order
    longs = list(FIGURES)
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in longs], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])

    def run(batches):
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            r = Rows(buf, offs)
            failed = base_failed(r)
            kept, by = cascade(r, ~failed, order)
            names = pa.array(["base" if f else order[k] if k >= 0 else None for f, k in zip(failed.tolist(), by.tolist(), strict=True)], pa.string())
            yield batch(schema, rows.column("doc_id"), *[getattr(r, c) for c in longs], failed, kept, names)

    return text_frame(docs).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in longs) + ", base_failed boolean, kept boolean, rejected_by string"
    )


def accepted(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of docs, whole, that the base rule and the cascade keep. Nothing is shuffled."""
    tune(docs.sparkSession)
    order = rule_order(docs) if order is None else order

    def run(batches):
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            r = Rows(buf, offs)
            yield rows.filter(pa.array(cascade(r, ~base_failed(r), order)[0]))

    return docs.mapInArrow(run, docs.schema)
