import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from roadpulse.llm import suffix_dedup
from roadpulse.llm.suffix_dedup import anchors, common_prefixes, remove_repeats, repeated, repeated_in_shares, rolling, suffix_array, words


def brute(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array(seed):
    r = np.random.default_rng(seed)
    t = r.choice(np.frombuffer([b"ab", b"banana", b"a", b"\x00\xffz"][seed % 4], np.uint8), int(r.integers(1, 400)))
    depth = 400
    h = np.zeros(len(t), np.uint64)  # equal hashes would stand for equal texts
    h[:] = np.arange(len(t))
    got = suffix_array(t, words(t, depth + 8), h, depth + 8)
    b = t.tobytes()
    assert got.tolist() == sorted(range(len(t)), key=lambda i: b[i:])


@pytest.mark.parametrize("length", [1, 7, 8, 16, 21, 400])
def test_rolling_and_anchors(length):
    r = np.random.default_rng(length)
    t = np.tile(r.integers(97, 99, 700, dtype=np.uint8), 2)
    h, b = rolling(t, length), t.tobytes()
    assert len(h) == len(t) - length + 1
    assert len({(int(x), b[i : i + length]) for i, x in enumerate(h)}) == len(set(h.tolist())) == len({b[i : i + length] for i in range(len(h))})
    low, first, last, _ = anchors(t, length)
    assert first[0] == 0 and last[-1] == len(h) and (first[1:] == last[:-1]).all()
    of = {}
    for a, s, e in zip(low, first, last):
        for i in range(s, e):
            assert of.setdefault(b[i : i + length], a) == a
    assert len(rolling(t[:0], length)) == 0


@pytest.mark.parametrize("seed", range(20))
def test_repeated(seed):
    r = random.Random(seed)
    n = r.choice([8, 12, 17, 40])
    texts = list({bytes(r.choices(b"ab" if seed % 2 else b"abcdefgh", k=r.randint(n, 120))) for _ in range(8)})
    texts.append(texts[0][:n] + b"q" + texts[-1])
    owned = [len(x) - n + 1 for x in texts]
    seen = Counter(x[i : i + n] for x, k in zip(texts, owned) for i in range(k))
    want = [[seen[x[i : i + n]] > 1 for i in range(k)] for x, k in zip(texts, owned)]
    assert [x.tolist() for x in repeated(texts, owned, n)] == want
    assert [x.tolist() for x in repeated_in_shares(texts, owned, n, 10**6)] == want
    assert [x.tolist() for x in repeated_in_shares(texts, owned, n, 5 * n)] == want


@pytest.mark.parametrize("kind", ["passage", "pairs", "period"])
def test_shares_are_bounded(monkeypatch, kind):
    r, n, most = random.Random(kind), 40, 2_000
    word = lambda k: bytes(r.choices(b"abcdefgh", k=k))
    core, pairs = word(50), [word(30) for _ in range(60)]
    texts = {"passage": [word(r.randint(1, 20)) + core + word(r.randint(1, 20)) for _ in range(400)], "pairs": [r.choice(pairs) + core + r.choice(pairs) for _ in range(400)], "period": [word(3) + b"z" * k + word(3) for k in range(n, 300)]}[kind]
    texts = list(dict.fromkeys(texts))
    owned = [len(x) - n + 1 for x in texts]
    seen = Counter(x[i : i + n] for x, k in zip(texts, owned) for i in range(k))
    want = [[seen[x[i : i + n]] > 1 for i in range(k)] for x, k in zip(texts, owned)]
    sizes, plain = [], suffix_dedup.repeated
    monkeypatch.setattr(suffix_dedup, "repeated", lambda t, *more: sizes.append(sum(map(len, t))) or plain(t, *more))
    assert [x.tolist() for x in repeated_in_shares(texts, owned, n, most)] == want
    assert max(sizes) <= most


@pytest.mark.parametrize("seed", range(10))
def test_common_prefixes(seed):
    r = np.random.default_rng(seed)
    t = np.tile(r.integers(97, 97 + r.integers(1, 4), 60, dtype=np.uint8), 4)
    t[r.integers(0, len(t), 3)] = 110
    most, b = int(r.choice([5, 8, 17, 64])), t.tobytes()
    order = np.array(sorted(range(len(t)), key=lambda i: b[i:]))
    order = order[r.random(len(t)) < 0.8]
    p, q, n = common_prefixes(t, words(t, most + 8), order, most)
    same = lambda i, j: next((k for k in range(most) if b[i + k : i + k + 1] != b[j + k : j + k + 1] or i + k >= len(b)), most)
    inside = (p + most <= len(t)) & (q + most <= len(t))
    assert {(i, j) for i, j in zip(p.tolist(), q.tolist())} == {(j, i) for i, j in zip(order.tolist(), order[1:].tolist())}
    assert n[inside].tolist() == [same(i, j) for i, j in zip(p[inside].tolist(), q[inside].tolist())]


def corpus(n):
    r = random.Random(n)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 7)))
    passage = lambda k: " ".join(word() for _ in range(k))
    common = [passage(n) for _ in range(6)]
    out = [None, "", "short", "short", "z" * (3 * n), "ab" * n, "ab" * n + "c", common[0], common[0]]
    for _ in range(60):
        out.append(" ".join(r.choice(common)[r.randint(0, 20) :] if r.random() < 0.3 else passage(r.randint(1, n)) for _ in range(4)))
    out += [common[1] + "x" + passage(3) for _ in range(40)]
    return out


@pytest.mark.parametrize("n,how", [(32, {}), (400, {}), (32, {"batch_bytes": 500, "most_bytes": 900}), (32, {"hot_runs": 4}), (32, {"hot_runs": 0}), (400, {"hot_runs": 2}), (32, {"hot_runs": 1, "batch_bytes": 500, "most_bytes": 900}), (32, {"bitmap_bits": 1 << 10})])
def test_equals_brute_force(spark, n, how):
    texts = corpus(n)
    df = spark.createDataFrame([(None if i == 3 else i % 100, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    got = remove_repeats(df, length=n, with_text=True, **how).collect()
    want = Counter((None if i == 3 else i % 100, *x) for i, x in enumerate(brute(texts, n)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert any(r.n_removed for r in got) and any(not r.n_removed for r in got)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
