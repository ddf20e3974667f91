import math

import __spark_entry__ as entry
import numpy as np
import oracle
import pytest
from conftest import SF

from weekwatch.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_query_equals_its_sql(spark):
    problems, n, *_ = oracle.compare(spark, oracle.connect(SF), "op5_exact_top_k", entry.queries()["op5_exact_top_k"], K.ORACLE, SF)
    assert not problems and n > 0


def expected(rows, is_query, k):
    ok = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    queries = {}
    for i, v in ok:
        if is_query(i):
            queries[i] = min(queries.get(i, v), v)
    out = []
    for i, q in queries.items():
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize(("query_block", "row_block"), [(512, 8192), (7, 40)])
def test_all_queries_against_all_rows(spark, query_block, row_block):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 24)).astype(np.float32)
    v[50:120] = v[50]  # one very common vector
    v[200:230] = np.round(v[200:230])  # ties
    rows = [(int(i), [float(c) for c in x]) for i, x in enumerate(v)]
    rows += [(1000 + i, [float(c) for c in rng.normal(size=5)]) for i in range(30)]  # other lengths
    rows += [(2000, None), (2001, [1.0, None] * 12), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (None, rows[0][1]), (20, rows[21][1]), (3000, []), (3010, []), (3001, [])]
    rows += [(4000, [2e5, -1.5] * 12), (4010, [-2e5] * 24), (4001, [3e5, 0.25] * 12), (4002, [1e-30, 7e4] * 12)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).withColumnRenamed("label", "rank").repartition(6)
    vectors = K.integer_vectors(df)
    got = K.top_k(vectors, vectors.where("vec_id % 10 = 0"), query_block=query_block, row_block=row_block).collect()
    assert sorted(tuple(r) for r in got) == expected(rows, lambda i: i % 10 == 0, 10)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, r = rng.integers(-2000, 2000, (20, 37)).astype(float), rng.integers(-2000, 2000, (300, 37)).astype(float)
    exact = q @ r.T
    for s in K.SEGMENTS:
        (qm, qd, n), (rm, rd, _) = K._statistics(q, s), K._statistics(r, s)
        assert ((qm * n) @ rm.T + qd @ rd.T >= exact - 1e-3).all()


def test_a_score_beyond_64_bits_is_an_error(spark):
    vectors = K.integer_vectors(spark.createDataFrame([(0, [1e30], 0), (1, [1e30], 0)], SCHEMA))
    with pytest.raises(Exception, match="leaves 64 bits"):
        K.top_k(vectors, vectors).collect()


def test_empty_table(spark):
    vectors = K.integer_vectors(spark.createDataFrame([], SCHEMA))
    assert K.top_k(vectors, vectors).count() == 0
