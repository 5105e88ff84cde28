"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features of a text are the n-grams (one and two words) of its words, and of the words' forms: a form says whether a
word has capitals only, a capital first, digits, symbols, and whether it equals the word before. Each n-gram is hashed
into 2**`BITS` places; its value is its count over the number of words, so length is no input. A score is the sparse
dot product with the weights, through the logistic function.

Training reads at most `TRAIN_ROWS` labelled documents (those with the smallest hashes of their ids), because
follow-the-regularised-leader is a sequential update; Spark tasks turn their texts into features, and one task makes
`EPOCHS` passes over that bounded sample. Scoring runs over every document in parallel. Rows whose crc32(doc_id) mod 5
is 0 are never learnt from.

Null and empty texts have no features and get the score of the intercept. A text of any length gives one score.
Repeated rows get equal scores; of several labels of a document the largest counts. Without usable labels all scores
are 0.5. A null doc_id is scored, and is not held out. An empty table gives no rows. Columns other than doc_id and
text are ignored, so they can't be inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelaudit.llm.common import batch, text_chunks, text_frame, tune
from labelaudit.llm.segments import RangeHash, mixed, row_bounds, words

BITS, TRAIN_ROWS, EPOCHS, THRESHOLD, FOLDS = 18, 6000, 3, 0.3, 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
CHUNK_BYTES = 1 << 20

_kinds = np.zeros(256, np.uint8)
_kinds[0x41:0x5B] = 1  # capitals
_kinds[0x61:0x7B] = 2
_kinds[0x30:0x3A] = 4
for _b in b"#*$%&|<>@^~{}[]\\/=+_!":
    _kinds[_b] = 8


def _any(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=total[1:])
    return total[ends] > total[starts]


def features(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: places of the features, and the row of each."""
    starts, ends = words(buf, offs)
    if not len(starts):
        return
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(row_bounds(starts, offs)))
    h, kinds = RangeHash(buf)(starts, ends), _kinds[buf]
    upper, lower = _any(kinds == 1, starts, ends), _any(kinds == 2, starts, ends)
    form = upper * 1 + lower * 2 + _any(kinds == 4, starts, ends) * 4 + _any(kinds == 8, starts, ends) * 8 + (ends - starts > 1) * 16
    same = np.zeros(len(h), bool)
    next_in_row = rows[1:] == rows[:-1]
    same[1:] = next_in_row & (h[1:] == h[:-1])
    f = mixed((form + same * 32).astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    pairs = np.flatnonzero(next_in_row)
    shift, m = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
    for one in (h, f):
        yield (one >> shift).astype(np.int64), rows
        yield (mixed(one[pairs] * m + one[pairs + 1]) >> shift).astype(np.int64), rows[pairs]


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the intercept last: FTRL-proximal over (places, values, label) in the given order."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for places, values, label in rows:
            zi, ni = z[places], n[places]
            wi = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(wi @ values, -35, 35)))
            g = (p - label) * values
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[places] = zi + g - sigma * wi
            n[places] = ni + g * g
    on = np.abs(z) > L1
    w[on] = -(z[on] - np.sign(z[on]) * L1) / ((BETA + np.sqrt(n[on])) / ALPHA + L2)
    return w


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", train_rows: int = TRAIN_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learnt from at most train_rows labelled documents that aren't held out."""
    tune(docs.sparkSession)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("label"))
    given = given.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # at most train_rows short rows, so their size is bounded
    texts = text_frame(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def featurise(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            n = np.maximum(np.diff(row_bounds(words(buf, offs)[0], offs)), 1)
            kinds = list(features(buf, offs, bits))
            place = np.concatenate([p for p, _ in kinds] or [np.zeros(0, np.int64)])
            row = np.concatenate([r for _, r in kinds] or [np.zeros(0, np.int64)])
            keys, counts = np.unique(row << (bits + 1) | place, return_counts=True)
            row, place = keys >> (bits + 1), keys & ((1 << (bits + 1)) - 1)
            cut = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("label"),
                    pa.ListArray.from_arrays(cut, pa.array(place, pa.int32())),
                    pa.ListArray.from_arrays(cut, pa.array(counts / n[row], pa.float32())),
                ],
                schema=schema,
            )

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        # of several texts of one id, the one with the first features in order
        frame = frame.assign(shape=[p.tobytes() + v.tobytes() for p, v in zip(frame["places"], frame["counts"], strict=True)])
        frame = frame.sort_values(["doc_id", "shape"]).drop_duplicates("doc_id").drop(columns=["all", "shape"])
        frame = frame.assign(order=mixed(frame["doc_id"].to_numpy().astype(np.uint64))).sort_values("order")
        rows = [
            (np.append(p, 1 << bits).astype(np.int64), np.append(v, 1.0), float(y > 0))
            for p, v, y in zip(frame["places"], frame["counts"], frame["label"], strict=True)
        ]
        w = train(rows, bits, epochs)
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": at, "weight": w[at]})

    made = texts.mapInArrow(featurise, "doc_id long, label double, places array<int>, counts array<float>")
    weights = np.zeros((1 << bits) + 1)
    for row in made.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "place long, weight double").collect():
        weights[row["place"]] = row["weight"]
    return weights


def scores(buf: np.ndarray, offs: np.ndarray, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    n = np.maximum(np.diff(row_bounds(words(buf, offs)[0], offs)), 1)
    total = np.zeros(len(n))
    for place, row in features(buf, offs, bits):
        total += np.bincount(row, weights[place], minlength=len(n))
    return 1 / (1 + np.exp(-np.clip(total / n + float(weights[-1]), -35, 35)))


def classify(docs: DataFrame, weights: np.ndarray, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    sent = weights.astype(np.float32)
    given = docs.sparkSession.sparkContext.broadcast(sent)  # 2**bits + 1 floats: 1 MB

    def run(batches):
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            yield batch(schema, rows.column("doc_id"), scores(buf, offs, given.value, bits))

    scored = text_frame(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """Fit on the labels, then score every row of docs."""
    return classify(docs, fit(docs, labels, target))


def accepted(docs: DataFrame, labels: DataFrame, target: str = "quality", bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole, that the classifier predicts to be good. Nothing is shuffled."""
    given = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, target, bits=bits).astype(np.float32))

    def run(batches):
        for rows, buf, offs in text_chunks(batches, CHUNK_BYTES):
            yield rows.filter(pa.array(scores(buf, offs, given.value, bits) >= threshold))

    return docs.mapInArrow(run, docs.schema)
