"""Overlap joins of short, long and endless intervals against all pairs."""

import random

from strandline.operators.intervals import interval_overlap_join, overlap_semi_join


def test_long_intervals_meet_on_their_level(spark):
    rng = random.Random(2)
    sides = []
    for side in range(2):
        rows = []
        for k in range(150):
            low = rng.randrange(5_000_000)
            rows.append((rng.choice("ab"), side * 1000 + k, low, low + rng.choice([0, 1, 15, 16, 4_000, 4_096, 4_097, 300_000, 2_000_000])))
        sides.append(rows)
    sides[1].append(("a", 9999, 0, 10**12))
    left = spark.createDataFrame(sides[0], "seq string, x long, a long, b long")
    right = spark.createDataFrame(sides[1], "seq string, y long, c long, d long")
    want = sorted((p[1], q[1]) for p in sides[0] for q in sides[1] if p[0] == q[0] and p[2] < q[3] and q[2] < p[3] and p[2] < p[3] and q[2] < q[3])
    for one, two in ((left, right), (left.where("b - a < 100"), right), (left.where("b - a < 100"), right.where("d - c < 100"))):
        some = {r.x for r in one.collect()}, {r.y for r in two.collect()}
        made = interval_overlap_join(one, two, ("a", "b"), ("c", "d"), width=16)
        assert sorted((r.x, r.y) for r in made.collect()) == [p for p in want if p[0] in some[0] and p[1] in some[1]]
        assert made.columns == ["seq", "x", "a", "b", "y", "c", "d"]
    assert interval_overlap_join(left.limit(0), right, ("a", "b"), ("c", "d")).collect() == []


def test_rows_that_overlap_any_are_found_without_pairs(spark):
    rng = random.Random(3)
    sides = []
    for side in range(2):
        lows = [(rng.choice(["a", "b", None]), rng.randrange(2_000), rng.choice([0, 1, 3, 40, 700])) for _ in range(60)]
        sides.append([(s, side * 1000 + k, low, low + size) for k, (s, low, size) in enumerate(lows)])
    left, right = (spark.createDataFrame(rows, "seq string, x long, low long, high long") for rows in sides)
    for one, two, frame, other in ((*sides, left, right), (sides[1], sides[0], right, left)):
        want = sorted(p[1] for p in one if any(p[0] == q[0] and p[2] < q[3] and q[2] < p[3] and p[2] < p[3] and q[2] < q[3] for q in two if q[0]))
        made = overlap_semi_join(frame, other, ["seq"], width=16)
        assert sorted(r.x for r in made.collect()) == want and made.columns == frame.columns
    # Every one of 40,000 overlaps every one of the others: 1.6 thousand million pairs.
    deep = spark.range(40_000).selectExpr("'a' AS seq", "id AS x", "id % 10 AS low", "1000 + id AS high")
    assert overlap_semi_join(deep, deep, ["seq"]).count() == 40_000
