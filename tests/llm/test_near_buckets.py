"""What near-dedup sends through its buckets: rows within one small cluster and pairs that were compared before do not come again."""

import random

import pytest

from strandline.llm import near_dups
from strandline.llm.near_dups import near_dup_components


def loose_group(n):
    """Copies of one text of 56 shingles with 1 to 5 words changed, most of them below the threshold from each other, and brute-force components."""
    rng = random.Random(n)
    base = ["w%d" % rng.randrange(10**6) for _ in range(60)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(60), rng.choice([1, 1, 2, 3, 4, 5])):
            copy[at] = "y%d" % rng.randrange(10**6)
        texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    root = list(range(n))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return texts, dict(enumerate(root))


def kept_tables(spark, monkeypatch, texts):
    """Components, the number of rows that met their hubs in buckets, and the pairs compared."""
    seen, keep = {"rows": 0, "pairs": []}, near_dups.Workspace.keep

    def spy(self, df):
        back = keep(self, df)
        if {"key", "hub"} <= set(back.columns):
            seen["rows"] += back.count()
        if {"hub", "cls", "common"} <= set(back.columns):
            seen["pairs"] += [(bytes(r.hub), bytes(r.cls)) for r in back.select("hub", "cls").collect()]
        return back

    monkeypatch.setattr(near_dups.Workspace, "keep", spy)
    got = near_dup_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), link=80).collect()
    return {r.doc_id: r.component_id for r in got}, seen["rows"], seen["pairs"]


def test_buckets_of_a_small_cluster_are_done_early(spark, monkeypatch):
    texts, expected = loose_group(150)
    got, rows, pairs = kept_tables(spark, monkeypatch, texts)
    assert got == expected
    assert rows < 60 * len(texts)


@pytest.mark.parametrize("few", [0, 200_000])
def test_no_pair_is_compared_twice(spark, monkeypatch, few):
    monkeypatch.setattr(near_dups, "FEW_IDS", few)
    monkeypatch.setattr(near_dups, "CLUSTER_SHINGLES", 0, raising=False)  # no cluster is small: all goes by hubs
    texts, expected = loose_group(100)
    got, _, pairs = kept_tables(spark, monkeypatch, texts)
    assert got == expected
    assert len(pairs) == len(set(pairs))
