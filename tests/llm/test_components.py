"""Components of links: against a plain union of sets, and how little a round asks of the driver."""

import random

from strandline.llm import components, near_dups
from strandline.llm.storage import Workspace


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components_match_brute_force(spark):
    rng, space = random.Random(3), Workspace(spark, "test")
    for n, nodes in ((0, 1), (200, 150), (60, 300)):
        edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)] + [(None, 3), (4, 4)] + [(1000 + k, 1001 + k) for k in range(n)]
        rows = components.connected_components(spark.createDataFrame(edges, "u long, v long"), space).collect()
        assert len(rows) == len({r.node for r in rows})
        assert {r.node: r.root for r in rows} == brute(edges)
    space.drop_all_but()


def test_stars_take_one_round_of_few_exchanges(spark):
    space = Workspace(spark, "test")
    star = spark.createDataFrame([(0, k) for k in range(1, 50)], "u long, v long")
    assert {(r.node, r.root) for r in components.connected_components(star, space).collect()} == {(k, 0) for k in range(50)}
    assert space.n == 2  # the edges and one round
    now = space.keep(star.selectExpr("v AS u", "u AS v"))
    plan = components._small_star(components._large_star(now))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4 and plan.count("BroadcastExchange") <= 1
    space.drop_all_but()


def test_two_tables_of_links_share_their_rounds(spark):
    rng, space = random.Random(5), Workspace(spark, "test")
    tables = [[(b"%d" % rng.randrange(50), b"%d" % rng.randrange(50)) for _ in range(n)] for n in (30, 15)]
    found = near_dups.components_of_both(*(spark.createDataFrame(x, "u binary, v binary") for x in tables), space)
    for rows, edges in zip(found, tables):
        assert {bytes(r.node): bytes(r.root) for r in rows.collect()} == brute(edges)
    space.drop_all_but()
