import random

from roadpulse.llm.common import Scratch, components


def roots(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 400)] + [(r.randint(500, 900), r.randint(500, 900)) for _ in range(250)]
    pairs = [(a, b) for a, b in pairs if a != b]
    r.shuffle(pairs)
    df = spark.createDataFrame([*pairs, *pairs[:50], (3, 3), (None, 5)], "a long, b long")
    got = components(Scratch(spark, "test"), df).collect()
    assert len(got) == len({x.node for x in got})
    assert {x.node: x.root for x in got} == roots(pairs)
    assert components(Scratch(spark, "test"), df.limit(0)).count() == 0
