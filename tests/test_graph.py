from genoloom.operators import graph


def test_all_mismatched_variants_are_dropped_however_many(spark):
    n = 30
    edges = spark.createDataFrame([(i, j, 0.0) for i in range(n) for j in range(i + 1, n)], "i int, j int, r double")
    stats = spark.createDataFrame([(i, 20.0 + i if i % 2 else 0.5) for i in range(n)], "i int, Z double")  # half of them
    assert sorted(r.i for r in graph.drop_mismatched(edges, stats, 500).collect()) == list(range(0, n, 2))
