"""Reachability has no depth limit."""

from planline.operators import graph


def test_reachable_beyond_twenty_steps(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(30, 1), (5, 2), (40, 41), (3, None), (7, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = graph.reachable(spark, df, spark.createDataFrame([(1,)], "node long")).collect()
    want = {k: k - 1 for k in range(1, 31)} | {None: 3}
    assert len(got) == len(want) and {r.node: r.depth for r in got} == want
