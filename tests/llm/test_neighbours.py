"""Nearest neighbours by a permutation index (operator 8)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm import neighbours

IS_QUERY = "vec_id % 100 = 0"


def exact(rows, k):
    """(query_id, rank, vec_id, score) by all distances."""
    good = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, v in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q)[:k]
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")) \
        .withColumn("entry", F.lit(1)).repartition(3)
    return sorted(map(tuple, neighbours.nearest(table, F.expr(IS_QUERY), **options).collect()))


def same(a, b):
    return [x[:3] for x in a] == [x[:3] for x in b] and all(math.isclose(x[3], y[3], abs_tol=1e-9) for x, y in zip(a, b))


def test_small_table_with_odd_rows_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(i, rows[3][1]) for i in range(100, 140)] + [(200, rows[5][1]), (201, rows[5][1])]
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 0.0, 0.0]), (400, [float("nan"), 1.0, 1.0, 1.0]),
             (500, [float("inf"), 1.0, 1.0, 1.0]), (600, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (700, [])]
    usable = [r for r in rows if r[1] is None or len(r[1]) == 4]
    assert same(found(spark, rows, share=1.0), exact(usable, 10))


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_fewer_candidates_than_asked_for(spark, n):
    rows = [(100 * i, [float(i + 1), 1.0]) for i in range(n)]
    assert same(found(spark, rows), exact(rows, 10))


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(table, F.expr(IS_QUERY)).collect()}
    true = {(q, i) for q, _, i, _ in exact([tuple(r) for r in table.select("vec_id", "embedding").collect()], 10)}
    assert len(got) == len(true) and len(got & true) / len(true) >= 0.95
