"""What a Python worker of the quality classifier holds at most, at the bounds of the sample, and that blocks do not change scores."""

import tracemalloc

import numpy as np
import pyarrow as pa

from strandline.llm import quality_votes
from strandline.llm.quality_votes import DIMENSIONS, LABELLED, TERMS, Voters, _fitted, fit

MB = 1_000_000


def sample(n, seed=5, size=200):
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.choice(TERMS // (1 + k % 3), size, replace=False)) for k in range(n)]
    return [(t, rng.random(len(t)).astype(np.float32)) for t in rows], np.array([k % 3 == 0 for k in range(n)], float)


def peak(job):
    tracemalloc.start()
    try:
        got = job()
        return got, tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def test_fitting_the_largest_sample_holds_little():
    rows, labels = sample(LABELLED)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(labels[a : a + 500]), pa.array([t.astype(np.int32) for t, _ in rows[a : a + 500]]), pa.array([s for _, s in rows[a : a + 500]])], names=["label", "terms", "shares"])
        for a in range(0, LABELLED, 500)
    ]
    got, held = peak(lambda: list(_fitted(iter(batches))))
    assert len(got[0].column("labels")[0].as_py()) == 8 * LABELLED
    assert held < 70, held  # 16.8 of them the products of the decomposed rows, as much again their vectors


def test_scoring_against_the_largest_sample_holds_little():
    rng = np.random.default_rng(6)
    voters = Voters(rng.normal(size=(TERMS, DIMENSIONS)).astype(np.float32), rng.normal(size=(LABELLED, DIMENSIONS)).astype(np.float32), rng.random(LABELLED), 0.5)
    rows, _ = sample(500)
    scores, held = peak(lambda: voters.score(rows))
    assert len(scores) == 500 and held < 30, held


def test_blocks_do_not_change_scores(monkeypatch):
    rows, labels = sample(300, size=40)
    asked, _ = sample(90, seed=9, size=40)
    whole = fit(rows, labels).score(asked)
    monkeypatch.setattr(quality_votes, "GRAM_ROWS", 7)
    monkeypatch.setattr(quality_votes, "BLOCK_ROWS", 11)
    np.testing.assert_allclose(fit(rows, labels).score(asked), whole, atol=1e-4)
