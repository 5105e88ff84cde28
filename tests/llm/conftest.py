import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew potions behind the old stone mill at dawn every single day"


def make_documents():
    """Copies, near copies, shared passages, nulls, empty and odd texts, a very long one, repeated rows."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(120) for _ in range(12)]
    texts += [texts[0], texts[1], texts[0]]
    texts += [prose(40) + " " + PASSAGE + " " + prose(40) for _ in range(3)]
    edited = texts[2].split(" ")
    edited[60] = "changed"
    texts += [" ".join(edited)]
    texts += [None, "", " \n\t ", "one", "a b", "İstanbul ÀÉß don't 12a3 x|y 日本語 🙂 #$%", "same " * 300, "x" * 500, "Line a b c\nLine a b c\n\nLine a b c\n" * 3]
    texts += [prose(6000), texts[3]]
    rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, texts[5], None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["h", "c", "fp", "score", "bucket", "turn", "salt", "part", "k", "cuts", "places", "shard", "key", "rest"]
    return docs.withColumns({n: F.lit(n) for n in names})
