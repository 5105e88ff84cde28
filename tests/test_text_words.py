"""Words of whole texts against brute force."""

import re
from collections import Counter

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def words(spark):
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for tok, w in enumerate(x for x in re.split(r"[ \t\n\x0b\f\r]+", text or "") if x):
            yield doc_id, tok, w, doc_id + tok


def test_every_word_is_cleaned(spark):
    wanted = set()
    for doc_id, tok, text, at in words(spark):
        w, h, conf = at % 60, at % 40, at % 120
        if w and h and conf >= 35 and any(c.isalnum() or c == "/" for c in text):
            wanted.add((doc_id, tok, max(1, round(w / 2))))
    found = entry.queries()["clean_text_words"](spark, SF).collect()
    assert len(found) == len(wanted) and set(map(tuple, found)) == wanted
    assert max(tok for _, tok, _ in wanted) > 100  # far beyond the first words


def test_every_word_is_validated(spark):
    wanted = Counter()
    for _, _, _, at in words(spark):
        wanted["bbox"] += at % 60 == 0 or at % 40 == 0
        wanted["conf"] += at % 120 > 1
    assert dict(map(tuple, entry.queries()["validate_text_tokens"](spark, SF).collect())) == wanted
