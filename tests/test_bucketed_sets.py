"""Set operations on tables in buckets: the results of the plain ones, without an exchange."""

import random

from strandline.operators import setops

TX = "seq string, strand string, tx long, gene long, cds array<struct<start:long,end:long>>"


def annotation(spark, rng, n, start):
    rows = []
    for k in range(n):
        low = rng.randrange(20)
        rows.append((rng.choice(["a", "b", "a|1"]), rng.choice("+-"), start + k, k, [(low, low + 3)] + ([(40, 43)] if rng.random() < 0.3 else [])))
    return spark.createDataFrame([*rows, ("a", "+", start + n, 0, [])], TX)


def test_operations_on_buckets(spark, tmp_path):
    rng = random.Random(4)
    a, b = annotation(spark, rng, 200, 0), annotation(spark, rng, 200, 1000)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x, y = (setops.write_bucketed(rows, name, 4, f"file://{tmp_path}/{name}") for rows, name in ((a, "bucketed_a"), (b, "bucketed_b")))
        for bucketed, plain in ((setops.intersection_bucketed, setops.intersection), (setops.difference_bucketed, setops.difference), (setops.union_bucketed, setops.union)):
            made = bucketed(x, y)
            assert sorted(r.tx for r in made.collect()) == sorted(r.tx for r in plain(a, b).collect())
            assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        for name in ("bucketed_a", "bucketed_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
