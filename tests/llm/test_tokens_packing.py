import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from roadpulse.llm.catalogue import TOKENIZER
from roadpulse.llm.packing import fill, pack
from roadpulse.llm.tokens import encoder, pieces, token_counts, windows

BITS = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\t\n ", "\x1c", " ", "a", "Word", "'s", "'re", "don't", "été", "汉字", "123", "!?", "\x85", "é́", "🙂", "_", "x" * 70]


def texts():
    r = random.Random(5)
    return [None, "", " ", "\n\n", *("".join(r.choices(BITS, k=r.randint(1, 30))) for _ in range(400)), "word " * 3000, "y" * 3000]


def docs(spark, rows=None):
    rows = [(i % 300 if i % 50 else None, t, "x") for i, t in enumerate(texts())] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_counts_equal_the_library(spark):
    tok = Tokenizer.from_file(TOKENIZER)
    want = sorted((i % 300 if i % 50 else -1, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts()))
    got = token_counts(docs(spark), TOKENIZER, sample_docs=50, table_size=20, cache_size=50).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_empty_tables(spark):
    assert token_counts(docs(spark, []), TOKENIZER).count() == 0
    assert pack(docs(spark, []), TOKENIZER).count() == 0


def test_windows_keep_the_text():
    for t in texts():
        parts = list(windows(t or "", 7))
        assert "".join(parts) == (t or "")
        for p in parts:
            first, rest = pieces(p)
            assert " ".join([first, *rest]) == p


def test_fast_path_equals_the_library():
    tok, fast = Tokenizer.from_file(TOKENIZER), encoder(TOKENIZER)
    r = random.Random(1)
    latin = [chr(c) for c in range(1, 0x250)]
    for _ in range(3000):
        x = "".join(r.choices(latin if r.random() < 0.5 else "abcdefgh  éàñ'.,\n", k=r.randint(1, 20)))
        assert fast(x) == tok.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_fill_is_optimal(seed):
    r = random.Random(seed)
    counts = [(x, r.randint(1, 4)) for x in r.sample(range(1, 40), 5)]
    room = r.randint(1, 90)
    sums = {0}
    for x, k in counts:
        sums = {s + x * j for s in sums for j in range(k + 1)}
    got = fill(counts, room)
    assert all(got[x] <= dict(counts)[x] for x in got)
    assert sum(x * k for x, k in got.items()) == max(s for s in sums if s <= room)


def test_pack_round_trip(spark):
    tok = Tokenizer.from_file(TOKENIZER)
    source = [(i, t, "") for i, t in enumerate(texts())]
    got = pack(docs(spark, source), TOKENIZER, pool=16, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
    for i, t, _ in source:
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == want
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert {r.doc_tokens for r in pieces} == {len(want)}
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        total = sum(r.length for r in rows)
        assert [r.offset for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist()
        assert total <= 1024 and total & (total - 1) == 0
