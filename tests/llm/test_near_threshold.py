"""Near copies of similarity 0.80 to 0.85: apart in the query, together in the pipeline's stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm.near_dups import half_keys, halves_for, near_dup_components


def words(rng, n):
    return ["w%d" % rng.randrange(10**6) for _ in range(n)]


def pair(rng, replaced):
    """Two texts of 100 shingles; ``replaced`` words at the end differ, one shingle each."""
    a = words(rng, 104)
    return [" ".join(a), " ".join(a[: 104 - replaced] + words(rng, replaced))]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_the_stage_keeps_one_of_near_copies_of_0_8(spark):
    rng = random.Random(2)
    # (100 - r) / (100 + r): 0.818 for 10, 0.802 for 11, 0.786 for 12.
    texts = [t for r in (10, 11, 12) for t in pair(rng, r)]
    docs = table(spark, texts).withColumns({"lang": F.lit("en"), "source": F.lit("x"), "n_chars": F.length("text").cast("long")})
    assert sorted(r.doc_id for r in corpus_pipeline.near_dup_stage(spark, docs, "").collect()) == [0, 2, 4, 5]
    assert {r.doc_id for r in near_dup_components(docs).where("kept").collect()} == {0, 1, 2, 3, 4, 5}


@pytest.mark.parametrize("link", [80, 85])
def test_groups_match_brute_force(spark, link):
    """Members of one group about the threshold from each other, some linked only through others."""
    rng = random.Random(link)
    base = words(rng, 60)
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 2, 3, 4])):
            copy[at] = "y%d" % rng.randrange(10**6)
        texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= link * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert {r.doc_id: r.component_id for r in near_dup_components(table(spark, texts), link=link).collect()} == dict(enumerate(root))


def test_a_pair_at_the_threshold_is_missed_as_rarely():
    assert halves_for(85) == 12 and halves_for(80) == 16
    import numpy as np

    assert len(half_keys(np.arange(1, 50, dtype=np.uint64), halves_for(80))) == 32
