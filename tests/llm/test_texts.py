"""Tokenizer operators and counts against the library and plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from labelaudit.llm import op1_repeats, op3_packing, op5_token_codes, op7_chunk_bpe, op9_rules, op10_simhash
from labelaudit.llm.common import new_folder
from labelaudit.llm.encoding import default_tokenizer, load_tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    return load_tokenizer(default_tokenizer())


@pytest.fixture(scope="module")
def ids(rows, tokenizer):
    return [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]


def le(x):
    return np.array(x, "<u4").tobytes()


def order(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


def same(found, wanted):
    assert sorted(map(tuple, found), key=order) == sorted(map(tuple, wanted), key=order)


def test_op7_equals_library(docs, clashing, no_docs, ids, tokenizer):
    wanted = [(i, len(x), hashlib.sha256(le(x)).hexdigest(), hashlib.sha256(tokenizer.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids]
    same(op7_chunk_bpe.encoding_digests(docs).collect(), wanted)
    same(op7_chunk_bpe.encoding_digests(clashing).collect(), wanted)
    assert op7_chunk_bpe.encoding_digests(no_docs).count() == 0


class Contextual:
    """An encoder whose id of a word depends on whether "q" stands before it in the same text."""

    def encode(self, buf, offs):
        data, ids, bounds = buf.tobytes(), [], [0]
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            before = b""
            for w in data[a:b].split():
                ids.append(2 * (sum(w) % 1000) + (before == b"q"))
                before = w
            bounds.append(len(ids))
        return np.array(ids, np.uint32), np.array(bounds)


def test_op7_repairs_until_encodings_agree():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["q", "word", "another", "x", "abcdefghijkl"]) + str(rnd.randrange(30)) * rnd.randrange(2) for _ in range(200)).encode() for _ in range(8)]
    texts = [t.replace(b"word", b"q word") for t in texts]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    word_start, word_end = op9_rules.words(buf, offs)
    chunks = op7_chunk_bpe.ChunkEncoder(Contextual())
    lone = np.array([k for k in range(1, len(word_start)) if buf[word_start[k - 1] : word_end[k - 1]].tobytes() == b"q"])[:5]
    ids, bounds = chunks._encoded(buf, word_start[lone], (word_end - word_start)[lone])
    assert not chunks._agrees(buf, offs, word_start, word_end, lone, ids, bounds).any()
    whole, at = Contextual().encode(buf, offs)
    rows = np.array([1, 4, 7])
    got, got_at = chunks._replaced(np.zeros_like(whole), at, buf, offs, rows)
    assert (got_at == at).all()
    for r in range(8):
        assert (got[at[r] : at[r + 1]] == (whole[at[r] : at[r + 1]] if r in rows else 0)).all()


def test_op7_with_the_table_dropped_all_the_time(rows, ids):
    from labelaudit.llm.encoding import PieceEncoder

    texts = [(r[1] or "").encode() for r in rows]
    chunks = op7_chunk_bpe.ChunkEncoder(PieceEncoder(default_tokenizer(), max_pieces=5), max_ids=1)
    for first in range(0, len(texts), 4):
        part = texts[first : first + 4]
        buf, offs = np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in part])])
        found, at = chunks.encode(buf, offs)
        assert [found[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x for _, x in ids[first : first + 4]]


def test_op7_gives_ids_and_text(docs, ids, tokenizer):
    found = op7_chunk_bpe.encode_documents(docs).collect()
    same([(r[0], tuple(r[1]), r[2]) for r in found], [(i, tuple(x), tokenizer.decode(x, skip_special_tokens=False)) for i, x in ids])


def test_op5_round_trip(spark, docs, clashing, no_docs, ids):
    found = sorted(op5_token_codes.token_codes(docs).collect(), key=lambda r: r["start"])
    ordered = sorted(((i, [*x, 2]) for i, x in ids), key=lambda p: (p[0] is not None, p[0] or 0))
    assert [r["doc_id"] for r in found] == [i for i, _ in ordered]
    start = 0
    for r, (_, x) in zip(found, ordered, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(x), zlib.crc32(le(x)))
        start += len(x)
    assert op5_token_codes.token_codes(clashing).count() == len(ids)
    assert op5_token_codes.token_codes(no_docs).count() == 0


def test_op5_random_access(spark, docs, ids):
    folder = new_folder(spark, "codes")
    manifest = op5_token_codes.write_token_files(docs, folder)
    flat = [t for _, x in sorted(ids, key=lambda p: (p[0] is not None, p[0] or 0)) for t in [*x, 2]]
    for place in (0, 1, 511, 512, 513, len(flat) // 2, len(flat) - 1):
        assert op5_token_codes.read_token(spark, manifest, folder, place) == flat[place]
    assert op5_token_codes.read_token(spark, manifest, folder, len(flat)) is None


@pytest.mark.parametrize("values", [[0], [255, 256], [1, 70000, 3, 1 << 24, 255], list(range(0, 5000, 7))])
def test_op5_levels(values):
    ids = np.array(values, np.uint32)
    data = memoryview(op5_token_codes.pack_levels(ids))
    levels = max(1, (int(ids.max()).bit_length() + 7) // 8)
    assert op5_token_codes.unpack_levels(data, levels).tolist() == values
    assert [op5_token_codes.token_at(lambda at, size: data[at : at + size], levels, i) for i in range(len(values))] == values


def test_op3_pieces_and_sequences(docs, clashing, no_docs, ids):
    found = op3_packing.pack_documents(docs, bucket=8).collect()
    wanted = []
    for i, x in ids:
        x = [*x, 0]
        wanted += [(i, p // 2048, p, len(x[p : p + 2048]), zlib.crc32(le(x[p : p + 2048]))) for p in range(0, len(x), 2048)]
    same([tuple(r)[:5] for r in found], wanted)
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    one = op3_packing.pack_documents(clashing).collect()
    assert len({r["sequence_id"] for r in one}) <= -(-sum(r["length"] for r in one) // 2048) + 1
    assert op3_packing.pack_documents(no_docs).count() == 0


def test_op3_rows_of_one_doc_id_are_spread(spark):
    docs = spark.range(600).selectExpr("cast(null as long) doc_id", "repeat('word ', cast(id % 50 * 20 + 1 as int)) text")
    found = op3_packing.pack_documents(docs, bucket=50).collect()
    assert len(found) == 600
    used = len({r["sequence_id"] for r in found})
    assert used <= -(-sum(r["length"] for r in found) // 2048) + 2


def test_op3_local_search_empties_bins():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        sizes = rnd.integers(1, 1400, 300).tolist()
        start = op3_packing.best_fit(sizes, 2048)
        after = op3_packing.swap_search(sizes, start, 2048)
        assert sorted(k for b in after for k in b) == list(range(300))
        assert all(sum(sizes[k] for k in b) <= 2048 for b in after)
        assert -(-sum(sizes) // 2048) <= len(after) <= len(start)
    # no bin of a kind that can't be emptied is tried for ever
    assert len(op3_packing.swap_search([6, 6, 6, 3], op3_packing.best_fit([6, 6, 6, 3], 10), 10)) == 3
    # a bin of many, each of which must be tried in pairs
    many = [97] * 3 + [1] * 17 + [2] * 1
    assert len(op3_packing.swap_search(many, op3_packing.best_fit(many, 100), 100)) == -(-sum(many) // 100)
    # three bins, where an exchange and a move find the two that are enough
    sizes = [7, 6, 4, 3]
    assert len(op3_packing.swap_search(sizes, [[0], [1], [2, 3]], 10)) == 2


def test_op9_counts(docs, clashing, no_docs, rows):
    def wanted(i, t):
        t = t or ""
        w = WORD.findall(t)
        full = [x for x in t.split("\n") if WORD.search(x)]
        triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(covered), failed)

    found = op9_rules.quality_rules(docs).collect()
    same([tuple(r)[:7] for r in found], [wanted(r[0], r[1]) for r in rows])
    assert all(not (r["base_failed"] and r["kept"]) for r in found)
    assert op9_rules.quality_rules(clashing).count() == len(rows)
    assert op9_rules.quality_rules(no_docs).count() == 0


def test_op9_order_is_the_same_in_every_run_and_ties_go_by_name(docs, no_docs):
    assert op9_rules.rule_order(docs) == op9_rules.rule_order(docs)
    assert op9_rules.rule_order(no_docs) == sorted(op9_rules.RULES)  # nothing rejected: all tied


def test_op9_rejecting_rule_is_the_first_in_order(docs):
    order = sorted(op9_rules.RULES)
    found = {(r["doc_id"], r["rejected_by"]) for r in op9_rules.quality_rules(docs, order).collect()}
    for r in docs.collect():
        data = (r["text"] or "").encode()
        one = op9_rules.Rows(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        by = "base" if op9_rules.base_failed(one)[0] else next((n for n in order if op9_rules.RULES[n](op9_rules.Rows(one.buf, one.offs))[0]), None)
        assert (r["doc_id"], by) in found


def test_op9_verdict_does_not_depend_on_order(docs):
    names = list(op9_rules.RULES)
    a = {r["doc_id"]: r["kept"] for r in op9_rules.quality_rules(docs, names).collect()}
    b = {r["doc_id"]: r["kept"] for r in op9_rules.quality_rules(docs, names[::-1]).collect()}
    assert a == b
    kept = {r["doc_id"] for r in op9_rules.accepted(docs).select("doc_id").collect()}
    assert kept == {i for i, k in a.items() if k}


def brute_simhash(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[b] < label[a] and linked(a, b):
                    label[a], changed = label[b], True
    return label


def test_op10_fingerprints_and_components(docs, clashing, no_docs, rows):
    prints = {}
    for r in rows:
        prints.setdefault(brute_simhash(r[1]), []).append(r[0])
    label = components_of(list(prints), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for fp, root in label.items():
        known = [i for i in prints[fp] if i is not None]
        least[root] = min([*known, *([least[root]] if root in least else [])])
    wanted = [(r[0], f"{brute_simhash(r[1]):016x}", least[label[brute_simhash(r[1])]]) for r in rows]
    same(op10_simhash.near_duplicates(docs).collect(), wanted)
    same(op10_simhash.near_duplicates(clashing).collect(), wanted)
    assert op10_simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("group", [4096, 8])
def test_op10_links_are_complete(spark, group):
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 63, 60, dtype=np.int64).tolist()
    fps = set(base)
    for x in base:
        for _ in range(3):
            y = x
            for b in rnd.choice(62, rnd.integers(1, 6), replace=False).tolist():
                y ^= 1 << b
            fps.add(y)
    nodes = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long")
    for blocks in (5, 6):
        edges = op10_simhash.links(op10_simhash.block_keys(nodes, 4, blocks), 4, group)
        roots = {r["node"]: r["root"] for r in op10_simhash.components(edges).collect()}
        wanted = components_of(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 4)
        assert {x: roots.get(x, x) for x in fps} == wanted


def test_op10_near_copies(docs, rows):
    found = {r["doc_id"]: r["component_id"] for r in op10_simhash.near_copies(docs).where("doc_id is not null").collect()}
    assert found[12] == found[14] == found[0] == 0 and found[13] == 1 and found[18] == 2
    assert all(found[i] == i for i in range(12))
    left = [r["doc_id"] for r in op10_simhash.one_of_each(docs).collect()]
    assert 12 not in left and 18 not in left and 2 in left


def brute_removed(rows, least=100):
    """Which bytes of each row are covered by a string that starts earlier."""
    out, seen = {}, {}
    texts = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})
    for i, t in texts:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - least + 1):
            if seen.setdefault(data[p : p + least], (i, p)) != (i, p):
                gone[p : p + least] = True
        out[i] = gone
    return out


def test_op1_against_brute_force(docs, clashing, no_docs, rows):
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    gone = brute_removed(rows)
    wanted = []
    for i, t in {(r[0], r[1] or "") for r in rows if r[0] is not None}:
        data, g = np.frombuffer(t.encode(), np.uint8), gone[i]
        runs = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        wanted.append((i, len(data), int(g.sum()), runs, hashlib.sha256(data[~g].tobytes()).hexdigest()))
    same(op1_repeats.removal_digests(once).collect(), wanted)
    both = op1_repeats.removal_digests(clashing).collect()
    assert len(both) == len(rows)
    assert all(r["n_removed"] == 0 for r in both if r["doc_id"] is None)
    assert sorted(r["n_removed"] for r in both if r["doc_id"] == 4)[-1] == len(rows[4][1])  # a repeated row goes but for its first place
    assert op1_repeats.removal_digests(no_docs).count() == 0


def test_op1_frequent_anchors_change_nothing(docs, monkeypatch):
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    plain = op1_repeats.removal_digests(once).collect()
    every = op1_repeats._anchors(op1_repeats._own_key(once, [])[0], 100, 32, np.zeros(0, np.int64)).select("h").distinct().collect()
    hot = np.array(sorted(r["h"] for r in every)[::2], np.int64)
    monkeypatch.setattr(op1_repeats, "frequent_anchors", lambda *a, **k: hot)
    same(op1_repeats.removal_digests(once).collect(), plain)
    monkeypatch.setattr(op1_repeats, "WIDE", 1)  # and no suffix array takes more than one context
    same(op1_repeats.removal_digests(once).collect(), plain)


def test_op1_cleaned_keeps_odd_columns(docs, no_docs):
    odd = docs.withColumnsRenamed({"lang": "my col-x", "source": "a`b.c"})
    found = op1_repeats.cleaned(odd)
    assert found.columns == ["doc_id", "text", "my col-x", "a`b.c", "n_chars"]
    assert {r["my col-x"] for r in found.collect()} == {"en", None}
    assert op1_repeats.cleaned(no_docs).count() == 0
    with pytest.raises(ValueError):
        op1_repeats.Repeats(docs, least=200)


def test_op1_groups_have_all_occurrences(spark):
    rnd = random.Random(3)
    shared = "".join(rnd.choice("ghijklmnopqrstuvwxyz") for _ in range(130))
    texts = [f"{c * 40}{shared}{d * 40}" for c, d in ("ab", "cd", "ef")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = op1_repeats.Repeats(docs, 100).groups().collect()
    starts = {(r["doc_id"], r["start"], r["start"] + r["length"]) for r in found}
    for i in range(3):
        spans = [(a, b) for d, a, b in starts if d == i]
        assert min(a for a, _ in spans) == 40 and max(b for _, b in spans) == 170
    sizes = collections.Counter((r["anchor"], r["length"], r["first_doc_id"], r["first_start"]) for r in found)
    assert set(sizes.values()) == {3}  # every group stands in all three


def test_op1_blocks_of_long_texts(monkeypatch):
    rnd = np.random.default_rng(1)
    text = rnd.integers(97, 101, 5000, dtype=np.uint8)
    offs = np.array([0, 3000, 5000])
    whole = op1_repeats.contexts(text, offs)
    monkeypatch.setattr(op1_repeats, "BLOCK", 257)
    for a, b in zip(whole, op1_repeats.contexts(text, offs), strict=True):
        assert (a == b).all()
