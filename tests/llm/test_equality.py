"""Equality by bytes: strings that simple polynomial hashes take for equal, and hashes made to collide."""

import collections
import hashlib

import numpy as np
import pytest

from labelaudit.llm import op1_repeats, op3_packing, op5_token_codes, op7_chunk_bpe, op9_rules, segments
from labelaudit.llm.encoding import PieceEncoder, default_tokenizer, load_tokenizer


def thue_morse(n, zero="a", one="b"):
    return "".join(one if k.bit_count() % 2 else zero for k in range(n))


X, Y = thue_morse(2048), thue_morse(2048, "b", "a")
TEXTS = [X + "\n" + Y, X + " " + Y, X + " " + X + "\n" + Y + "\n" + X]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)


@pytest.fixture(scope="module")
def wanted():
    tokenizer = load_tokenizer(default_tokenizer())
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_words_keep_their_own_ids(odd, wanted):
    found = {r["doc_id"]: r["ids_sha256"] for r in op7_chunk_bpe.encoding_digests(odd).collect()}
    assert found == {i: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for i, x in enumerate(wanted)}
    lengths = collections.Counter()
    for r in op3_packing.cut_documents(odd).collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {i: len(x) + 1 for i, x in enumerate(wanted)}
    assert {r["doc_id"]: r["n_tokens"] for r in op5_token_codes.token_codes(odd).collect()} == {i: len(x) + 1 for i, x in enumerate(wanted)}


def test_lines_and_words_are_compared(odd):
    found = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in op9_rules.quality_rules(odd).collect()}
    assert found == {0: (0, 0), 1: (0, 0), 2: (0, 0)}


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_results_do_not_depend_on_hashes(monkeypatch, bits):
    """With hashes of a few bits almost everything collides; nothing may change."""
    rnd = np.random.default_rng(8)
    texts = [" ".join(rnd.choice(["ab", "ba", "abc", "12", "don't", "é", "x|y"], 40)) + "\n" + " ".join(rnd.choice(["ab", "c"], 6)) + "\n" + "ab c\nab c" for _ in range(20)]
    flat = "".join(texts).encode()
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    buf = np.frombuffer(flat, np.uint8)

    def results():
        pieces = PieceEncoder(default_tokenizer())
        chunks = op7_chunk_bpe.ChunkEncoder(PieceEncoder(default_tokenizer()))
        rows = op9_rules.Rows(buf, offs)
        out = [pieces.encode(buf, offs)[0] for _ in range(2)] + [chunks.encode(buf, offs)[0] for _ in range(2)]
        return [x.tolist() for x in (*out, rows.n_dup_lines, rows.n_repeat_words, op9_rules.stuttering(rows))]

    plain = results()
    assert plain[0] == plain[1] == plain[2] == plain[3]
    whole = segments.RangeHash.__call__
    monkeypatch.setattr(segments.RangeHash, "__call__", lambda self, a, b: whole(self, a, b) & np.uint64((1 << bits) - 1))
    assert results() == plain


def test_hash_is_of_the_bytes_alone():
    rnd = np.random.default_rng(1)
    one = rnd.integers(0, 256, 400, dtype=np.uint8)
    twice = np.concatenate([rnd.integers(0, 256, 77, dtype=np.uint8), one, one[:50]])
    h = segments.RangeHash(twice)
    at = np.array([0, 3, 10])
    assert (h(77 + at, 77 + at + 40) == segments.RangeHash(one)(at, at + 40)).all()
    assert h(np.array([77]), np.array([127])) == h(np.array([477]), np.array([527]))
    assert len(set(h(np.arange(300), np.arange(300) + 9).tolist())) == len({twice[k : k + 9].tobytes() for k in range(300)})


def test_repeats_of_such_words(spark):
    docs = spark.createDataFrame([(0, X[:600]), (1, Y[:600]), (2, X[:600])], "doc_id long, text string")
    seen, wanted = set(), {}
    for i, t in ((0, X[:600]), (1, Y[:600]), (2, X[:600])):
        gone = np.zeros(600, bool)
        for p in range(501):
            if t[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(t[p : p + 100])
        wanted[i] = int(gone.sum())
    assert {r["doc_id"]: r["n_removed"] for r in op1_repeats.removal_digests(docs).collect()} == wanted
