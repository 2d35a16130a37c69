import random
import zlib
from collections import Counter, defaultdict

import pytest

from roadpulse.llm.mixing import Flight, mix, mixed, targets
from roadpulse.llm.sharding import Cells, minimax_cuts, shard_documents


def best_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, room = (low + high) // 2, 1, 0
        room = mid
        for s in sizes:
            if s > room:
                n, room = n + 1, mid
            room -= s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_minimax_is_exact(spark, seed):
    r = random.Random(seed)
    prefix = "0000" if seed % 2 else ""  # all groups in one cell, to be refined
    rows = sorted({prefix + "".join(r.choices("0123456789abcdef", k=32 - len(prefix))): r.choice([1, 5, 40, 300]) for _ in range(500)}.items())
    shards = r.choice([3, 7, 16])
    cuts, capacity = minimax_cuts(spark.createDataFrame(rows, "key string, size long"), shards)
    assert capacity == best_capacity([s for _, s in rows], shards)
    loads = Counter()
    for key, s in rows:
        loads[sum(key >= c for c in cuts)] += s
    assert max(loads.values()) == capacity and len(cuts) < shards


def test_cells_of_nothing():
    assert Cells([]).total == 0


def test_shard_documents(spark):
    r = random.Random(3)
    texts = [None, "", *("w" * r.randint(0, 50) + str(i) for i in range(600)), *["hot text é"] * 400]
    rows = [(None if i % 97 == 0 else i % 900, t, "clash") for i, t in enumerate(texts)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    where, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for x in got:
        where[x.text_crc32, x["size"]].add(x.shard)
        load[x.shard] += x["size"]
        slots[x.shard].append(x.slot)
    assert all(len(v) == 1 for v in where.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    hot = where[zlib.crc32("hot text é".encode()), 12].pop()
    others = [v for k, v in load.items() if k != hot]
    assert len(load) == 16 and max(others) - min(others) < 0.15 * max(others)
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_targets():
    assert targets({"a": 100, "b": 100, None: 100}) == {"a": 200, "b": 450 * 0 + 250 * 2 / 3, None: 250 / 3}
    assert targets({}) == {} and targets({"a": 0}) == {"a": 0}


def test_mix(spark):
    r = random.Random(1)
    rows = [(None if i % 101 == 0 else i, " ".join(["w"] * r.choice([0, 1, 5, 50, 400])) if i % 37 else None, "hot" if i % 3 == 0 else r.choice(["a", "b", "é", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, chunk_rows=200).collect()
    sizes, taken, goal = Counter(), Counter(), {}
    for x in got:
        sizes[x.source] += x["size"]
        taken[x.source] += x.taken
        goal[x.source] = x.target
        assert 0 <= x.taken <= 2 * x["size"] and x.taken == x.copies * x["size"] and 0 <= x.copies <= 2
    assert Counter((x.doc_id, x.source) for x in got) == Counter((d, s) for d, _, s in rows)
    assert {x.source: x.source_size for x in got} == dict(sizes)
    assert goal == pytest.approx(targets(sizes))
    assert all(abs(taken[s] - goal[s]) <= 400 for s in goal)
    frame = lambda x: sorted((str(r.doc_id), str(r.source), r["size"], r.taken) for r in x)
    assert frame(mix(df.repartition(7), chunk_rows=200).collect()) == frame(got)
    assert mix(df.limit(0)).count() == 0


def test_mix_of_more_sources_than_a_chunk_has_rows(spark):
    rows = [(i, "w " * (1 + i % 7), f"site{i % 150}") for i in range(450)] + [(1000 + i, "w w", "hot") for i in range(500)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), chunk_rows=50).collect()
    assert sorted(x.doc_id for x in got) == [r[0] for r in rows]
    taken, goal = Counter(), {}
    for x in got:
        taken[x.source] += x.taken
        goal[x.source] = x.target
        assert 0 <= x.copies <= 2
    assert len(goal) == 151 and all(abs(taken[s] - goal[s]) <= 7 for s in goal)


@pytest.mark.parametrize("seed", range(12))
def test_a_flight_keeps_both_totals(seed):
    """Brute force: the sums of fractions and of fraction times size stay what they were, decided rows included."""
    r = random.Random(seed)
    rows = [(r.choice([1, 5, 40, 300]), r.choice([0.5, 0.25, r.random()])) for _ in range(300)]
    flight, done = Flight(seed), []
    for k, (size, p) in enumerate(rows):
        done += flight.add(size, p, k)
        assert len(flight.open) <= 2
        held = [(rows[j][0], z) for j, z in done] + [(x[0], x[1]) for x in flight.open]
        assert sum(z for _, z in held) == pytest.approx(sum(p for _, p in rows[: k + 1]))
        assert sum(s * z for s, z in held) == pytest.approx(sum(s * p for s, p in rows[: k + 1]))
    assert sorted([j for j, _ in done] + [x[2] for x in flight.open]) == list(range(300)) and {z for _, z in done} <= {0, 1}
    exact = sum(x[0] * x[1] for x in flight.open)
    landed = sum(rows[j][0] * z for j, z in flight.land())
    assert abs(landed - exact) <= min(abs(sum(c) - exact) for c in ([], *([x[0]] for x in flight.open), [x[0] for x in flight.open])) + 1e-9


def test_mix_of_forty_sources_in_small_chunks_with_clashing_columns(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 40}", 1, 2.0, "x", 3, 4) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, fraction double, id string, base int, chunk int")
    got = mix(df, chunk_rows=20).collect()
    assert sorted(x.doc_id for x in got) == list(range(400))
    by = Counter()
    for x in got:
        by[x.source] += x.taken - x.target / sum(y.source == x.source for y in got)
    assert all(abs(v) <= 9 for v in by.values())


def test_mixed_rows(spark):
    """Null ids, an id with many texts, equal rows and very long texts; each row as often as it was taken."""
    rows = [(None if i % 3 else 7, f"text {i} " + "w " * (i % 50), "hot" if i % 2 else None, i) for i in range(900)] + [(1, "same words", "b", 0)] * 90 + [(2, "w " * 300_000, "c", 0), (3, None, "d", 1), (4, "", "d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(4)
    got = mixed(df)
    assert got.columns == df.columns
    got = Counter(map(tuple, got.collect()))
    assert set(got) <= set(rows) and all(n <= 2 * rows.count(x) for x, n in got.items())
    words = lambda t: len((t or "").split())
    sizes, taken = Counter(), Counter()
    for _, t, s, _ in rows:
        sizes[s] += words(t)
    for (_, t, s, _), n in got.items():
        taken[s] += n * words(t)
    assert all(abs(taken[s] - goal) <= (52 if s != "c" else 300_000) for s, goal in targets(sizes).items())
    assert Counter(map(tuple, mixed(df.repartition(2)).collect())) == got
    assert mixed(df.limit(0)).count() == 0
