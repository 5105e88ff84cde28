"""The pipeline's stages against plain statements of what each must do."""

import re

import pytest

import corpus_pipeline
from labelaudit.llm import op9_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [d.toPandas() for d in out]


def test_columns_and_shrinking(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert list(after.columns) == list(before.columns)
        assert len(after) <= len(before) and set(after["doc_id"]) <= set(before["doc_id"])
    assert len(stages[1]) > 0.6 * len(stages[0])


def test_rules_stage_is_the_operator(spark, stages):
    kept = op9_rules.quality_rules(spark.createDataFrame(stages[1])).where("kept").toPandas()
    assert set(kept["doc_id"]) == set(stages[2]["doc_id"])


def test_near_copies_go(stages):
    def shingles(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    before = {i: shingles(t) for i, t in zip(stages[2]["doc_id"], stages[2]["text"], strict=True)}
    after = set(stages[3]["doc_id"])
    share = lambda a, b: len(before[a] & before[b]) / max(1, len(before[a] | before[b]))
    for i in before:
        for j in before:
            if i < j and share(i, j) >= 0.85:
                assert not (i in after and j in after)
    for i in set(before) - after:
        assert max(share(i, j) for j in before if j != i) >= 0.65


def test_repeats_go(stages):
    seen = set()
    for t in stages[4].sort_values("doc_id")["text"]:
        data = t.encode()
        assert data.decode() == t
        own = {data[p : p + 104] for p in range(len(data) - 103)}  # characters stay whole, so a few bytes may stay too
        assert len(own & seen) <= 4
        seen |= own
    assert (stages[4]["n_chars"] == stages[4]["text"].str.len()).all()


def test_packing_covers_everything(stages):
    assert set(stages[5]["doc_id"]) == set(stages[4]["doc_id"])
    assert stages[5].groupby("sequence_id")["length"].sum().max() <= 2048


def test_run_gives_the_same(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[5])
