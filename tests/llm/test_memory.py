"""What Python workers hold: one for each running task, no table of an operator before, no large scratch tables."""

import numpy as np
import pyarrow as pa

from tests.llm.helpers import change, frame, words
from vellum import session
from vellum.llm import jaccard, sentencepieces, text_kernel


def test_no_stage_of_the_jaccard_join_has_two_kernels_a_task(spark, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return session.written(df, name)

    monkeypatch.setattr(jaccard, "written", kept)
    base = words(60, 1)
    assert jaccard.links(frame(spark, [base, change(base, 0.05, 2), words(60, 3)])).count() == 3
    assert any(p.count("MapInArrow") > 1 for p in plans)
    for plan in plans:
        for between in plan.split("MapInArrow")[1:-1]:
            assert "Exchange" in between.replace("BroadcastExchange", ""), plan


def test_long_texts_leave_no_large_tables_and_the_same_hashes():
    text = words(400_000, 5)
    hashes, _ = text_kernel.word_hashes(pa.array([text], pa.large_string()))
    assert len(text) > 1 << 21 and max(len(text_kernel._pow), len(text_kernel._inv)) <= 1 << 16
    part = text.split(" ")
    for i in (0, len(part) // 2, len(part) - 100):
        assert np.array_equal(hashes[i : i + 100], text_kernel.word_hashes(pa.array([" ".join(part[i : i + 100])], pa.large_string()))[0])


def test_a_worker_keeps_the_tables_of_its_operator_only():
    path = sentencepieces.model_path()

    def run(batches):
        sentencepieces.model(path)
        yield from batches

    def held():
        return sentencepieces.model.cache_info().currsize

    batch = pa.record_batch([pa.array([1, 2])], ["x"])
    own, other = session.tidy(run, sentencepieces.model), session.tidy(lambda batches: batches)
    assert list(own(iter([batch]))) == [batch] and held() == 1
    first = sentencepieces.model(path)
    assert list(own(iter([]))) == [] and sentencepieces.model(path) is first
    assert list(other(iter([batch]))) == [batch] and held() == 0
