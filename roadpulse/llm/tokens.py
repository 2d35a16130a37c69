"""Token counts (operator 8): map-side lookup in two tiers, without a shuffle of pre-tokens.

A text is cut before spaces that follow something other than white space.  The tokenizer's pattern
always breaks there and its special string holds no white space, so each piece ("pre-token" below)
has the same tokens alone as in its text, and a document's tokens are those of its pieces.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadpulse.llm.common import sub_batches

#: The Unicode White_Space characters, which is what ``\\s`` means to the tokenizer.
#: Fixed values.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The pattern of byte-level BPE, as the files of this kind have it.
#: Fixed values.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SPACED = [chr(c) + " " for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c))]
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
SEAM = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")


def pieces(text: str) -> tuple[str, list[str]]:
    """The first pre-token and the others without the space that each begins with."""
    if text[:1] == " " or any(x in text for x in SPACED):
        found, out = PIECE.findall(text), []
        for x in found[1:]:  # those that begin with other white space stay with the one before
            if x[0] == " ":
                out.append(x[1:])
            elif out:
                out[-1] += x
            else:
                found[0] += x
        return found[0], out
    first, *rest = text.split(" ")
    return first, rest


def windows(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A long text in parts of about ``size`` characters, cut where pre-tokens can begin; nothing is lost."""
    at = 0
    while len(text) - at > size:
        cut = SEAM.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def worker_store() -> dict:
    """What a Python worker keeps from one task to the next."""
    name = "_roadpulse_worker"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE without options whose ids follow its merges, else None."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    m, pre = d["model"], d["pre_tokenizer"] or {}
    plain = m.get("type") == "BPE" and d["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not plain or any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocab, special = m["vocab"], {x["content"] for x in d["added_tokens"]}
    merged = [vocab["".join(x.split(" ") if isinstance(x, str) else x)] for x in m["merges"]]
    if merged != sorted(merged) or len(set(merged)) < len(merged):
        return None
    return {bytes(byte[c] for c in k): i for k, i in vocab.items() if k not in special}


def encoder(path: str) -> Callable[[str], list[int]]:
    """The tokenizer's ids of a piece, without special tokens around it.

    Pieces of Latin letters alone take a faster implementation of the same merges; others, and those
    that may hold a special string, go to the library itself.
    """
    store = worker_store()
    if ("encoder", path) not in store:
        tok, ranks = Tokenizer.from_file(path), byte_ranks(path)
        tok.no_truncation()
        tok.no_padding()
        fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None
        special = "<" if all(x.content.startswith("<") for x in tok.get_added_tokens_decoder().values()) else None

        def encode(piece: str) -> list[int]:
            if fast and special and special not in piece and (piece.isascii() or max(piece) < "\u0250"):
                return fast(piece)
            return tok.encode(piece, add_special_tokens=False).ids

        store["encoder", path] = encode
    return store["encoder", path]


class Lengths(dict):
    """Second tier: pre-token (without its space) -> value, filled by ``encode`` on a miss.  When it
    holds ``room`` entries it starts again from the first tier; those of over 64 characters are never kept."""

    def __init__(self, first: dict, encode: Callable, room: int) -> None:
        super().__init__(first)
        self.first, self.encode, self.room = first, encode, max(room, 2 * len(first))

    def __missing__(self, piece: str):
        value = self.encode(" " + piece)
        if len(piece) <= 64:
            if len(self) >= self.room:
                self.clear()
                self.update(self.first)
            self[piece] = value
        return value


def worker_cache(kind: str, path: str, first: dict, of: Callable, room: int) -> Lengths:
    """The worker's cache of ``of(ids)``; it outlives a task."""
    store, encode = worker_store(), encoder(path)
    if (kind, path, room) not in store:
        store[kind, path, room] = Lengths(first, lambda x: of(encode(x)), room)
    return store[kind, path, room]


def frequent(df: DataFrame, text_col: str, path: str, sample_docs: int, table_size: int) -> dict[str, int]:
    """First tier: the most frequent pre-tokens of at most ``sample_docs`` texts and their token counts.

    It holds at most ``table_size`` entries of at most 64 characters, so its broadcast has a fixed
    bound.  It only saves work: what is not in it is encoded, so counts do not depend on the sample.
    """
    sample = df.select(F.col(text_col).alias("t")).limit(sample_docs)

    def counts(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                for part in windows(text or ""):
                    seen.update(x for x in pieces(part)[1] if len(x) <= 64)
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_pydict({"p": pa.array([x for x, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    rows = sample.mapInArrow(counts, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(table_size).collect()
    encode = encoder(path)
    return {r.p: len(encode(" " + r.p)) for r in rows}


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, sample_docs: int = 1000, table_size: int = 20_000, cache_size: int = 300_000) -> DataFrame:
    """Tokens of every whole text: ``id_col``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    One narrow stage over (id, text): no shuffle.  Null and empty texts have 0 bytes and 0 tokens;
    ids may be null or repeat, every row yields a row; other columns are not carried.  Very long
    texts are cut at pre-token borders, so memory follows the longest white-space-free run.
    """
    table = df.sparkSession.sparkContext.broadcast(frequent(df, text_col, tokenizer_path, sample_docs, table_size))

    def count(batches):
        first, get = encoder(tokenizer_path), worker_cache("length", tokenizer_path, table.value, len, cache_size).__getitem__

        def total(text: str) -> int:
            n = 0
            for part in windows(text):
                head, rest = pieces(part)
                n += len(first(head)) + sum(map(get, rest))
            return n

        for whole in batches:
            for b in sub_batches([whole], "text"):
                n = [total(t) if t else 0 for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = base.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
