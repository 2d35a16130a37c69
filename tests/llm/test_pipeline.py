import random
import re
from collections import Counter

import pytest

import corpus_pipeline as p

WORDS = [f"{a}{b}{c}" for a in "bcdfgklm" for b in ["a", "e", "é", "o"] for c in ["ta", "ne", "ril", "s"]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted toxic texts, near copies, a shared passage, nulls and repeated rows."""
    r = random.Random(7)
    say = lambda n: " ".join(r.choices(WORDS, k=n))
    passage = say(60)
    docs, labels = [], []
    for i in range(600):
        text, toxic = say(r.randint(60, 200)), i % 8 == 0
        if toxic:
            text += " " + " ".join(r.choices(["idiot", "moron", "scum"], k=4)) + " " + say(5)
        if i % 50 == 1:
            text = text + " " + passage + " " + say(20)
        docs.append((i, text, "en", "hot" if i % 3 else "b", len(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(1, 600, 40):
        words = docs[i][1].split()
        words[len(words) // 2] = "changed"
        docs.append((1000 + i, " ".join(words), "en", "hot", 1))
        docs.append((2000 + i, docs[i][1], "en", None, 1))
    docs += [(3000, None, None, None, None), (3001, "", "en", "b", 0), (docs[3][0], docs[3][1], "en", "hot", 1)]
    out = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out, docs, passage


def test_stages(spark, folder):
    out, docs, passage = folder
    df = spark.read.parquet(f"{out}/documents.parquet")
    first = p.toxicity_stage(spark, df, out)
    assert first.columns == p.COLUMNS
    rows = first.collect()
    bad = {d[0] for d in docs if "moron" in (d[1] or "") or "idiot" in (d[1] or "") or "scum" in (d[1] or "")}
    assert not bad & {x.doc_id for x in rows} and len(rows) == sum(d[0] not in bad for d in docs)

    second = p.near_dedup_stage(spark, first, out)
    assert second.columns == p.COLUMNS
    ids = Counter(x.doc_id for x in second.collect())
    assert set(ids) == {d[0] for d in docs if d[0] < 600 or d[0] >= 3000} - bad - ({3001} if 3001 not in ids else {3000}) and set(ids.values()) == {1}

    third = p.passage_dedup_stage(spark, second, out)
    assert third.columns == p.COLUMNS
    before, after = {x.doc_id: x.text for x in second.collect()}, {x.doc_id: x.text for x in third.collect()}
    assert set(before) == set(after)
    for i, text in after.items():
        if text is not None:
            assert passage not in text
            assert (text == before[i]) == (passage not in before[i])
    assert all(x.n_chars == len(x.text) for x in third.collect() if x.text is not None)

    fourth = p.mixing_stage(spark, third, out)
    assert fourth.columns == p.COLUMNS
    taken = Counter(x.doc_id for x in fourth.collect())
    assert max(taken.values()) <= 2
    size = {x.doc_id: (x.source, len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))) for x in third.collect()}
    got, whole = Counter(), Counter()
    for i, (s, n) in size.items():
        got[s] += n * taken[i]
        whole[s] += n
    from roadpulse.llm.mixing import targets

    assert all(abs(got[s] - t) <= 250 for s, t in targets(whole).items())
    last = p.packing_stage(spark, fourth, out).collect()
    assert sum(x.length for x in last if x.start == 0) and {x.doc_id for x in last} == set(taken)


def test_run(spark, folder):
    assert p.run(spark, folder[0]).count() > 0


def test_stages_of_nothing(spark, folder):
    out, *_ = folder
    df = spark.read.parquet(f"{out}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, df, out).count() == 0
