import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from corpus_pipeline import NEAR
from roadpulse.llm import common, simhash
from roadpulse.llm.simhash import fingerprint, link_groups, one_of_each, pigeonhole, simhash_groups
from test_components import roots


def brute(text, n=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def texts():
    r = random.Random(3)
    words = ["Alpha", "beta", "ÉTÉ", "汉字", "x", "longer-word", "\x85", " "]
    out = [None, "", " \n", "One", "one", "a b c", "a b c d", "A B C D"]
    for _ in range(60):
        out.append(r.choice([" ", "\t", "\n"]).join(r.choices(words, k=r.randint(1, 40))))
    base = " ".join(f"w{i}" for i in range(700))
    for i in range(150):
        out.append(base.replace(f"w{i} ", "zz ", 1))
    return out + [base] * 20


@pytest.mark.parametrize("n", [1, 4, 5])
def test_fingerprint(n):
    for t in texts():
        assert int(fingerprint(t or "", n).hex(), 16) == brute(t, n)


@pytest.mark.parametrize("radius,width", [(4, 8), (3, 8), (12, 16), (0, 8)])
def test_link_groups(radius, width):
    r = np.random.default_rng(radius)
    size = r.choice([1, 2, 3, 9, 40, 70, 200], 60)
    group = np.repeat(np.arange(60), size)
    fps = r.integers(0, 256, (len(group), width), dtype=np.uint8)
    for i in range(1, len(fps)):
        if r.random() < 0.6:  # near an earlier one
            fps[i] = fps[max(0, i - r.integers(1, 5))]
            for b in r.choice(width * 8, r.integers(0, radius + 3), replace=False):
                fps[i, b // 8] ^= 1 << (b % 8)
    bits = np.unpackbits(fps, axis=1).astype(int)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i + 1, min(i + 200, len(fps))) if group[i] == group[j] and np.abs(bits[i] - bits[j]).sum() <= radius]
    label = link_groups(fps, group, radius)
    want = roots(pairs)
    assert [want.get(i, i) for i in range(len(fps))] == label.tolist()


def test_pigeonhole_misses_nothing():
    sets, r = pigeonhole(64, 4), random.Random(1)
    for _ in range(2000):
        changed = set(r.sample(range(64), 4))
        assert any(not changed & set(s.tolist()) for s in sets)


def test_groups_equal_brute_force(spark):
    rows = [(None if i == 9 else i, t, "clash") for i, t in enumerate(texts())]
    rows += [(5, "a b c", "clash")]
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)).collect()
    fps = {i: brute(t) for i, t, _ in rows}
    names = list(fps)
    root = roots([(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if a is not None and b is not None and bin(fps[a] ^ fps[b]).count("1") <= 4])
    assert len(got) == len(rows)
    for x in got:
        assert x.fingerprint == f"{fps[x.doc_id]:016x}"
        if x.doc_id is not None:
            assert x.component_id == root.get(x.doc_id, x.doc_id)
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_of_near_copies(spark):
    r = random.Random(8)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(b), "clash") for i, b in enumerate(base)]
    for i, b in enumerate(base[:30]):  # five words changed: Jaccard about 0.85
        c = list(b)
        for p in (20, 80, 140, 200, 260):
            c[p] = "changed"
        rows.append((100 + i, " ".join(c), "clash"))
    rows += [(0, rows[0][1], "clash"), (None, "w1", "clash"), (None, "w1", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)
    got = one_of_each(df, shingle=5, words=4, radius=45, recall=0.99)
    assert got.columns == df.columns
    ids = [x.doc_id for x in got.collect()]
    assert sorted(x for x in ids if x is not None and x < 100) == list(range(40)) and ids.count(None) == 2
    assert sum(x >= 100 for x in ids if x is not None) <= 1


def near_pairs(r, count, overlap, words=120):
    """Pairs of texts of ``words`` words that share their first ``overlap`` words and nothing else."""
    for _ in range(count):
        w = [f"w{r.getrandbits(40)}" for _ in range(2 * words - overlap)]
        yield " ".join(w[:words]), " ".join(w[:overlap] + w[words:])


def test_one_of_each_misses_no_copy_at_the_threshold(spark):
    r = random.Random(5)
    pairs = list(near_pairs(r, 400, 108))  # 104 of 128 shingles: 0.8125
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), **NEAR)
    assert sorted(x.doc_id for x in got.collect()) == list(range(0, 800, 2))


def test_one_of_each_keeps_what_is_no_copy(spark):
    r = random.Random(6)
    pairs = [p for overlap in (88, 96, 102) for p in near_pairs(r, 60, overlap)]  # at most 98 of 134 shingles: 0.73
    for _ in range(20):  # one line fifty times, and 100 shingles of each text's own
        line = " ".join(f"r{r.getrandbits(40)}" for _ in range(10)) + " "
        pairs.append(tuple(line * 50 + " ".join(f"w{r.getrandbits(40)}" for _ in range(100)) for _ in range(2)))
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), **NEAR)
    assert sorted(x.doc_id for x in got.collect()) == list(range(len(rows)))


def test_one_of_each_of_rows_that_share_an_id(spark):
    r = random.Random(7)
    a, b, c, d = (" ".join(f"w{r.getrandbits(40)}" for _ in range(100)) for _ in range(4))
    rows = [(1, a, 0), (1, b, 1), (2, c, 2), (5, a, 3), (5, d, 4), (5, d, 5), (6, b, 6)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3), **NEAR)
    assert sorted((x.doc_id, x.text) for x in got.collect()) == sorted([(1, a), (1, b), (2, c), (5, d)])


def test_one_of_each_of_rows_without_an_id(spark):
    r = random.Random(8)
    a, b, c = (" ".join(f"w{r.getrandbits(40)}" for _ in range(100)) for _ in range(3))
    rows = [(None, a), (None, a), (None, a + " more"), (None, b), (9, b), (9, c), (None, None), (None, "")]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **NEAR)
    kept = [(x.doc_id, (x.text or "")[:20]) for x in got.collect()]
    assert sorted(kept, key=str) == sorted([(None, a[:20]), (9, b[:20]), (9, c[:20]), (None, "")], key=str)


def family(r, count, words, changed):
    """Texts that differ from one base each in ``changed`` places of their own."""
    base = [f"w{r.getrandbits(40)}" for _ in range(words)]
    for _ in range(count):
        own = list(base)
        for p in r.sample(range(words), changed):
            own[p] = f"o{r.getrandbits(40)}"
        yield " ".join(own)


def sets_of(texts):
    return [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]


@pytest.mark.parametrize("part_shingles", [1 << 20, 4000])
def test_one_of_each_of_a_large_family(spark, monkeypatch, part_shingles):
    r = random.Random(9)
    texts = [*family(r, 160, 150, 2), *family(r, 60, 150, 3), *family(r, 30, 150, 4), *(t for p in near_pairs(r, 30, 108) for t in p)]
    sets = sets_of(texts)
    links = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)]
    root, written, put = roots(links), {}, common.Scratch.put

    def counted(self, df, name):
        out = put(self, df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(common.Scratch, "put", counted)
    got = simhash.near_copies(common.Scratch(spark, "family"), spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), seed=42, **{k: v for k, v in NEAR.items() if k != "null_ids"}, **({} if part_shingles == 1 << 20 else {"part_shingles": part_shingles}))
    found = {}
    for x in got[1].collect():
        found.setdefault(x.root, set()).add(x.first)
    want = {}
    for i in range(len(texts)):
        want.setdefault(root.get(i, i), set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    assert len(links) > 500 and len(want) > 100  # both linked and unlinked rows are many
    # No pair is a row: a group of n rows gives fewer than n, in 27 bands.
    assert written.get("pairs", 0) <= 4 * len(texts) and written["links"] <= 20 * len(texts)


def test_a_family_of_rows_that_are_no_copies_writes_no_pairs(spark, monkeypatch):
    r = random.Random(10)
    texts = list(family(r, 300, 150, 3))
    written, put = Counter(), common.Scratch.put

    def counted(self, df, name):
        out = put(self, df, name)
        written[name] = max(written[name], out.count())
        return out

    monkeypatch.setattr(common.Scratch, "put", counted)
    kept = one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), **NEAR).count()
    assert kept > 200
    assert max(written.values()) <= 27 * len(texts) / 2, written  # of 44,850 pairs
