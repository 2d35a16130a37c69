import random
import zlib

import numpy as np
import pytest

from roadpulse.llm.language_id import identify, one_language, units, viterbi
from roadpulse.llm.toxicity import Model, segments, toxicity

VOCAB = {"aa": ["the", "of", "and", "house", "river", "green", "walk"], "bb": ["der", "und", "haus", "fluss", "grün", "gehen", "das"], "cc": ["дом", "река", "и", "что", "зелёный", "идти", "это"]}


def say(r, lang, n):
    return " ".join(r.choices(VOCAB[lang], k=n))


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language(spark):
    r = random.Random(1)
    rows = [(i, say(r, lang, r.randint(3, 60)), lang, "clash") for i, lang in ((i, r.choice("aa bb cc".split())) for i in range(400))]
    mixed = say(r, "aa", 60) + " " + say(r, "cc", 30) + ". " + say(r, "aa", 20)
    rows += [(1000, None, "aa", ""), (1001, "", "aa", ""), (1002, "12 34 ²!", "aa", ""), (None, say(r, "bb", 9), None, ""), (1003, mixed, None, ""), (1003, "汉字", None, ""), (1004, say(r, "bb", 300_000), "bb", "")]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3), with_spans=True).collect()
    assert len(got) == len(rows)
    want = {i: lang for i, _, lang, _ in rows[:400]}
    for x in got:
        assert x.held_out == (x.doc_id is not None and fold(x.doc_id, 4) == 2) and 0 <= x.score <= 1
        if x.doc_id in want:
            assert x.lang_pred == want[x.doc_id]
        if x.doc_id in (1000, 1001, 1002):
            assert x.lang_pred == "und" and x.score == 0
    long = next(x for x in got if x.doc_id == 1003 and x.spans[-1].last > 5)
    assert [(s.first, s.last, s.lang) for s in long.spans] == [(0, 60, "aa"), (60, 90, "cc"), (90, 110, "aa")] and long.lang_pred == "aa"
    assert next(x for x in got if x.doc_id is None).lang_pred == "bb"
    assert identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert {x.lang_pred for x in identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_every_letter_counts(spark):
    """Clauses without spaces whose letters after the 40th decide, words of mixed script, very long words."""
    r = random.Random(2)
    han = lambda a, n: "".join(chr(r.randint(a, a + 60)) for _ in range(n))
    rows = [(i, han(0x4E00, 40) + han(0x5000 if i % 2 else 0x6000, 260), "x" if i % 2 else "y") for i in range(200)]
    rows += [(1000 + i, "ab" * 20 + ("cd" if i % 2 else "fg") * 30, "p" if i % 2 else "q") for i in range(100)]
    want = {i: lang for i, _, lang in rows}
    rows += [(2000, "python" + han(0x5000, 50), None), (2001, han(0x6000, 50) + "python", None), (2002, "ab" * 20 + "cd" * 200_000, None)]
    got = {x.doc_id: x.lang_pred for x in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert {i: got[i] for i in want} == want and (got[2000], got[2001], got[2002]) == ("x", "y", "p")
    assert units("Python汉字 สวัสดีครับ " + "Z" * 90) == ["python", "汉", "字", *(u for w in ["สว", "สด", "คร", "บ"] for u in [w]), "z" * 40, "z" * 40, "z" * 10]


def test_many_languages(spark):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" * 3, f"l{i // 2:04}") for i in range(2400)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 2400 and all(x.lang_pred.startswith("l") for x in got)


@pytest.mark.parametrize("seed", range(40))
def test_sums_agree_with_viterbi(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 60, 8)
    s = -r.exponential(1.0, (sizes.sum(), 3)).astype(np.float32)
    start = np.cumsum([0, *sizes])[:-1]
    penalty = float(r.choice([2.0, 6.0, 12.0]))
    _, best, plain = one_language(s, start, penalty)
    paths = viterbi(s, start, sizes, penalty)
    for k, path in enumerate(paths):
        assert len(path) == sizes[k]
        if plain[k]:
            assert (path == best[k]).all()


def brute_path(s, penalty):
    from itertools import product

    return max(product(range(s.shape[1]), repeat=len(s)), key=lambda p: sum(s[i, l] for i, l in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])))


def test_viterbi_is_optimal():
    r = np.random.default_rng(0)
    for _ in range(20):
        sizes = r.integers(1, 7, 4)
        s, start = -r.exponential(1.0, (sizes.sum(), 3)), np.cumsum([0, *sizes])[:-1]
        for path, a, n in zip(viterbi(s, start, sizes, 1.0), start, sizes):
            assert tuple(path) == brute_path(s[a : a + n], 1.0)


def maximal(x):
    """By definition: the best segment first (the shortest of equal ones), then the same left and right of it."""
    if not len(x) or max(x) <= 0:
        return []
    c = np.r_[0, np.cumsum(x)]
    a, b = max(((i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), key=lambda p: (round(c[p[1]] - c[p[0]], 9), -(p[1] - p[0])))
    return [*maximal(x[:a]), (round(float(c[b] - c[a]), 9), a, b), *((s, i + b, j + b) for s, i, j in maximal(x[b:]))]


@pytest.mark.parametrize("seed", range(40))
def test_segments(seed):
    r = np.random.default_rng(seed)
    x = r.choice([0.0, 0.0, 1.0, 2.5, -0.7], int(r.integers(0, 30))) + r.random() * 0.01
    assert [(round(s, 9), a, b) for s, a, b in segments(x, 0.3)] == maximal(x - 0.3)


def test_toxicity(spark):
    r = random.Random(2)
    bad = ["idiot", "moron", "scum", "trash"]
    docs, labels = [], []
    for i in range(900):
        words, y = r.choices([f"w{k}" for k in range(300)], k=r.randint(20, 200)), i % 6 == 0
        if y:
            at = r.randrange(len(words))
            words[at:at] = r.choices(bad, k=4)
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, int(y)))
    docs += [(5000, None, ""), (5001, "", ""), (None, "idiot moron scum", ""), (6, "again", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), (8, 0)], "doc_id long, toxic int")
    got = toxicity(df, marks, with_passages=True).collect()
    assert len(got) == len(docs)
    held = [x for x in got if x.doc_id is not None and x.doc_id < 900 and fold(x.doc_id, 3) == 1 and x.doc_id != 6]
    assert all(x.held_out for x in held) and sum(x.held_out for x in got) >= len(held)
    assert np.mean([x.predicted == (x.doc_id % 6 == 0) for x in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    assert all(x.passages for x in held if x.doc_id % 6 == 0)
    assert next(x for x in got if x.doc_id is None).predicted == 1
    assert {x.predicted for x in got if x.doc_id in (5000, 5001)} == {0}
    assert toxicity(df, marks.limit(0)).where("predicted = 1").count() == 0
    assert toxicity(df.limit(0), marks).count() == 0


def test_very_long_words_and_texts_and_reruns(spark):
    r = random.Random(3)
    bad = ["q" * 90 + "a", "q" * 90 + "b"]  # told apart only after the 64th letter
    docs, labels = [], []
    for i in range(600):
        words, y = r.choices([f"w{k}" for k in range(200)], k=60), i % 5 == 0
        words[30:30] = [bad[1 - y]] * 3
        docs.append((i, " ".join(words)))
        labels.append((i, int(y)))
    docs += [(3001, "w1 " * 200_000 + bad[0] + " " + bad[0] + " " + bad[0]), (3002, "w1 " * 200_000)]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = lambda x: {t.doc_id: (t.score, t.predicted) for t in toxicity(x, marks).collect()}
    got = scores(df.repartition(2))
    assert scores(df.repartition(5)) == got
    held = [i for i, _ in labels if fold(i, 3) == 1]
    assert all(got[i][1] == (i % 5 == 0) for i in held) and got[3002][1] == 0
    assert got[3001][0] > got[3002][0]


def test_late_passage_of_words_used_before():
    m = Model({"idiot": 3.0, "moron": 3.0, "scum": 3.0}, 0.2)
    words = ["w"] * 100_000
    for at in (10, 20_000, 40_000, 90_000):
        words[at : at + 3] = ["idiot", "moron", "scum"]
    words[95_000:95_010] = ["idiot"] * 10
    m.log_k = -8.0
    found = m.features(m.scorer()(" ".join(words)))[2]
    assert [(a, b) for _, a, b in found] == [(10, 13), (20_000, 20_003), (40_000, 40_003), (90_000, 90_003), (95_000, 95_010)]


@pytest.mark.parametrize("seed", range(5))
def test_calibration_is_stable(seed):
    r = np.random.default_rng(seed)
    n = 4000
    label = r.random(n) < 0.1
    x = np.c_[np.where(label, 45, 0.5) + r.normal(0, 1, n), np.where(label, 4.5, 0.5) + r.normal(0, 0.05, n)]  # separable
    m = Model({}, 0.2)
    m.calibrate(x, label.astype(float))
    p = 1 / (1 + np.exp(-(np.c_[np.ones(n), x] @ m.coef)))
    assert ((p >= 0.7) == label).all() and (m.coef[1:] >= 0).all()
    few = np.r_[np.flatnonzero(label)[:40], np.flatnonzero(~label)[:400]]
    m.calibrate(x[few], label[few].astype(float))
    assert (1 / (1 + np.exp(-(np.c_[np.ones(n), x] @ m.coef))) >= 0.7)[label].all()
