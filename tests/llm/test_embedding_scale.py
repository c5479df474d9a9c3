"""Vectors are dealt out a fixed number of times, however many blocks they make."""

import numpy as np

from strataq.llm import embedding_dedup


def _shuffled(spark):
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(x := stages.apply(i)).stageId(): x.shuffleWriteBytes() for i in range(stages.size())}


def test_shuffle_does_not_grow_with_tiles(spark):
    x = np.random.default_rng(3).normal(size=(3000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    was = _shuffled(spark)
    got = {r.key: r.n_links for r in embedding_dedup.embedding_dedup(df, block=64).collect()}
    sent = sum(n for k, n in _shuffled(spark).items() if k not in was)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.9).sum(axis=1) - 1).tolist()))
    assert sent < 20 * x.nbytes, (sent, x.nbytes)


def test_usable_and_parts(spark):
    """Decimals and whole numbers as components, zeros of either sign, a slice of a longer column, many tiles against one."""
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 2.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [-0.0, 1.0])]
    got = {}
    for kind in ("double", "float", "int", "decimal(9,2)"):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", f"cast(embedding as array<{kind}>) as embedding")
        got[kind] = {(r.key, r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df).collect()}
        assert got[kind] == {(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 2, 1)}, kind
