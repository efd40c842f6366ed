"""Passages of several short lines in differing surroundings."""

import random

import pytest

from strandline.llm.line_chunks import line_dedup


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("n_lines", [2, 3, 4, 8, 20])
def test_a_passage_of_short_lines_stays_once(spark, n_lines):
    rng = random.Random(n_lines)
    def line(n):
        return " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    passage = [line(-(-50 // n_lines)) for _ in range(n_lines)]
    around = [([line(9) for _ in range(rng.randrange(1, 4))], [line(9) for _ in range(rng.randrange(1, 4))]) for _ in range(12)]
    texts = ["\n".join(a + passage + b) for a, b in around]
    got = {r.doc_id: (r.text, r.n_removed, r.removed_lines) for r in line_dedup(table(spark, texts)).collect()}
    assert got == {k: (texts[0], 0, 0) if k == 0 else ("\n".join(a + b), 1, n_lines) for k, (a, b) in enumerate(around)}
