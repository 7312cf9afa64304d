"""The pipeline against brute force, stage by stage and as a whole."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.helpers import clashing
from tests.llm.test_documents import all_matches, all_pairs, score_by_hand
from vellum.llm import bpe, decontaminate, secrets, sentencepieces, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for name, f in corpus_pipeline.STAGES:
        after = f(spark, docs, sf_dir).cache()
        out.append((name, docs, after))
        if name != "sentencepiece":
            assert after.columns == columns and after.dtypes == docs.dtypes
        docs = after
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_toxicity_stage(spark, sf_dir, stages):
    _, before, after = stages[0]
    m = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {i: r for i, r in by_id(before).items() if score_by_hand(m, r.text) < 0.5}
    assert by_id(after) == kept and 0 < before.count() - after.count() < before.count() / 2


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    root = {i: i for i in by_id(before)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, _ in sorted(all_pairs({i: r.text for i, r in by_id(before).items()})):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert by_id(after) == {i: r for i, r in by_id(before).items() if find(i) == i}


def test_decontamination_stage(spark, sf_dir, stages):
    _, before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {d for d, _ in all_matches({i: r.text for i, r in by_id(before).items()}, items)}
    assert by_id(after) == {i: r for i, r in by_id(before).items() if i not in leaks}


def test_secret_and_encoding_stages(stages):
    _, before, after = stages[3]
    path, was = bpe.vocabulary_path(), by_id(before)
    for i, r in by_id(after).items():
        text = was[i].text
        for _, x, _ in secrets.find(text, path):
            text = text.replace(x, "[SECRET]", 1)
        assert r.text == text and r.n_chars == len(text)
    assert set(by_id(after)) == set(was)
    m = sentencepieces.model(sentencepieces.model_path())
    final = by_id(stages[4][2])
    assert set(final) == set(was) and all(m.decode(np.array(r.ids, np.int64)) == t.text and r.round_trip for i, t in by_id(after).items() for r in [final[i]])


def test_run_is_its_stages(spark, sf_dir, stages):
    got = {r.doc_id: (r.ids, r.n_pieces, r.round_trip) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {r.doc_id: (r.ids, r.n_pieces, r.round_trip) for r in stages[-1][2].collect()}


def test_stages_take_odd_documents(spark, sf_dir):
    texts = [None, "", "x", "some clean words", None, "y " * 40_000]
    docs = clashing(spark, spark.createDataFrame([(i if i != 4 else None, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"))
    for name, f in corpus_pipeline.STAGES:
        after = f(spark, docs, sf_dir)
        assert after.count() == docs.count(), name
        docs = docs if name == "sentencepiece" else after
        empty = f(spark, docs.where("false"), sf_dir)
        assert empty.count() == 0
    assert decontaminate.SHINGLE == 3 and pa
