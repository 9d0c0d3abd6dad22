"""Cosine search in blocks: many queries, ties, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from paysift.operators import vectors as V


def brute(ids, m, qids, q, k):
    unit = lambda x: x / np.where(np.sqrt((x * x).sum(axis=1)) == 0, 1, np.sqrt((x * x).sum(axis=1)))[:, None]
    score = np.round(unit(q.astype(float)) @ unit(m.astype(float)).T, 6)
    return {(qids[i], ids[j], float(score[i, j])) for i in range(len(qids)) for j in sorted(range(len(ids)), key=lambda j: (-score[i, j], ids[j]))[:k]}


def test_ten_thousand_queries_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m, q = rng.integers(-4, 5, (700, 6)).astype(np.float32), rng.integers(-4, 5, (10_000, 6)).astype(np.float32)
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(5)
    query = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, q array<float>").repartition(7)
    got = {(r.query_id, r.vec_id, r.score) for r in V.cosine_topk(emb, query, 3).collect()}
    assert got == brute(range(700), m, range(10_000), q, 3)


def test_odd_vectors(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "b"), (3, None, "c"), (4, [1.0], "d"), (5, [None, 1.0], "e"), (6, [2.0, 0.0], "f"), (7, [], "g")],
                                "vec_id long, embedding array<float>, label string")
    query = spark.createDataFrame([("x", [3.0, 0.0]), ("z", [0.0, 0.0]), ("one", [5.0]), ("none", None)], "query_id string, q array<float>")
    got = sorted((r.query_id, r.vec_id, r.label, r.score) for r in V.cosine_topk(emb, query, 2).collect())
    assert got == [("one", 4, "d", 1.0), ("x", 1, "a", 1.0), ("x", 6, "f", 1.0), ("z", 1, "a", 0.0), ("z", 2, "b", 0.0)]
    assert V.cosine_topk(emb.limit(0), query, 2).count() == V.cosine_topk(emb, query.limit(0), 2).count() == 0
    assert V.cosine_topk(emb.drop("label"), query.filter("query_id = 'x'"), 1).first().vec_id == 1


def test_neither_side_is_broadcast_or_collected(spark):
    emb = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = V.cosine_topk(emb, emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" in plan and "Broadcast" not in plan
