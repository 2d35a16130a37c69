import random

import pytest

from roadpulse.llm.topk import top_k


def brute(rows, k, every):
    import math

    ok = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        own = min(v for i, v in ok if i == q)
        got = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in ok if i != q and len(v) == len(own)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(got)]
    return out


def check(spark, rows, kind="float", **kw):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, **kw).collect())
    assert got == sorted(brute(rows, kw.get("k", 5), kw.get("every", 50)))


def test_equals_brute_force_with_ties_and_odd_vectors(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(i, [1.0, 0.5, 0.5, 0.25]) for i in range(300, 420)]  # a group of copies
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("nan")] * 4), (503, [float("inf")] * 4), (None, [1.0] * 4), (504, []), (550, []), (600, [1.0, 2.0]), (605, [-1e30, 3e38]), (7, [9.0] * 4), (7, [9.0] * 4)]
    rows = [x for x in rows if x[0] != 605]
    check(spark, rows, block=3, bits=3)
    check(spark, rows, k=1000, every=100)


@pytest.mark.parametrize("large", [1e6, 1e7, 3e6])
def test_large_components_are_exact(spark, large):
    r = random.Random(5)
    rows = [(0, [1.0, 0.0]), (1, [2e6, 0.0]), (2, [3e6, 0.0])] + [(i, [r.uniform(-large, large), r.choice([0.25, -large])]) for i in range(3, 120)]
    check(spark, rows, "double", block=2, bits=4)
    check(spark, [(i, [x * 1e3 for x in v]) for i, v in rows[:2]], "double")  # scores near 2^57
    check(spark, [(0, [2.0**45, 0.0]), (1, [2.0, 5.0]), (2, [-3.0, 2.0**40])], "double", bits=3)  # a vector's square is beyond a long


def test_too_large(spark):
    frame = lambda rows: top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="beyond 2\\^62"):
        frame([(0, [1.0]), (1, [1e30])]).collect()
    with pytest.raises(Exception, match="beyond a long"):
        frame([(0, [2.0**40]), (1, [2.0**40])]).collect()


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i)], "x", 1, 2) for i in range(60)], "vec_id long, embedding array<float>, id string, v int, block int")
    out = top_k(df, block=1)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out.collect()) == [(0, k, k) for k in range(1, 6)] + [(50, k, 60 - k) for k in range(1, 6)]


def test_few_rows(spark):
    check(spark, [(0, [1.0]), (50, [2.0]), (3, [0.0])])
    check(spark, [(0, [0.0, 0.0])])
    check(spark, [])
