"""Packing (operator 9): minimum bin slack by bitset subset-sum dynamic programming."""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import give_back, sub_batches
from roadpulse.llm.tokens import encoder, pieces, windows, worker_cache


def fill(counts: list[tuple[int, int]], room: int) -> dict[int, int]:
    """The multiset out of ``counts`` [(length, copies)] whose sum comes closest to ``room`` from below.

    Bit s of an integer says whether the sum s can be reached.  Copies of a length enter in powers of
    two; each step keeps the bits before it, from which the counts are read back.  It stops as soon
    as ``room`` itself can be reached.
    """
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, copies in counts:
        if length > room:
            continue
        k = 1
        copies = min(copies, room // length)
        while copies > 0 and not bits >> room:
            k = min(k, copies)
            new = bits | (bits << (length * k)) & mask
            if new != bits:
                steps.append((length, k, bits))
                bits = new
            copies -= k
            k *= 2
        if bits >> room:
            break
    at, chosen = bits.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += k
            at -= length * k
    return dict(chosen)


class Packer:
    """Turns documents' ids into sequences.  Whole windows of a long document are sequences of their
    own; what remains of each document waits in a pool of at most ``pool`` remainders, from which the
    sequences are filled.  Gaps that no multiset fills are closed by cutting a remainder."""

    def __init__(self, capacity: int, pool: int, first_id: int, with_ids: bool) -> None:
        self.capacity, self.pool, self.next_id, self.with_ids = capacity, pool, first_id, with_ids
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.n, self.tokens, self.out = 0, 0, []

    def emit(self, doc, start: int, ids: bytes, total: int, offset: int) -> None:
        self.out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset, ids if self.with_ids else None))

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, self.capacity * 4
        for at in range(0, len(ids) - step + 1, step):
            self.emit(doc, at // 4, ids[at : at + step], total, 0)
            self.next_id += 1
        if rest := len(ids) % step:
            self.wait(doc, (len(ids) - rest) // 4, ids[-rest:], total)
        while self.n > self.pool and self.tokens >= self.capacity:
            self.bin(self.capacity)

    def wait(self, *item) -> None:
        self.waiting[len(item[2]) // 4].append(item)
        self.n += 1
        self.tokens += len(item[2]) // 4

    def take(self, length: int) -> tuple:
        item = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
        self.n -= 1
        self.tokens -= length
        return item

    def bin(self, capacity: int) -> None:
        """One sequence of exactly ``capacity`` ids; the pool holds as many at least."""
        longest = max((x for x in self.waiting if x <= capacity), default=0)
        items = [self.take(longest)] if longest else []
        room = capacity - longest
        if room:
            for length, k in fill([(x, len(q)) for x, q in self.waiting.items()], room).items():
                items += [self.take(length) for _ in range(k)]
                room -= length * k
        while room:  # nothing fits exactly: the longest remainder gives its first ids
            doc, start, ids, total = self.take(max(self.waiting))
            cut = min(room, len(ids) // 4)
            items.append((doc, start, ids[: 4 * cut], total))
            if rest := ids[4 * cut :]:
                self.wait(doc, start + cut, rest, total)
            room -= cut
        offset = 0
        for doc, start, ids, total in items:
            self.emit(doc, start, ids, total, offset)
            offset += len(ids) // 4
        self.next_id += 1

    def finish(self) -> None:
        """Whole sequences first, then one for each power of two in what is left: no padding at all."""
        while self.tokens:
            self.bin(self.capacity if self.tokens >= self.capacity else 1 << (self.tokens.bit_length() - 1))


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, pool: int = 256, cache_size: int = 120_000, with_ids: bool = False) -> DataFrame:
    """Pack the token ids of all documents (each followed by ``end_id``) into sequences.

    One row for each piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset (and
    ids, little-endian unsigned 32-bit, with ``with_ids``).  Every id lies in exactly one piece.  Each
    task packs what it reads, in one pass and with a bounded pool, so there is no shuffle; sequences
    hold exactly ``capacity`` ids, but for at most log2(capacity) of each task, whose sizes are
    powers of two.  sequence_id is unique: the task's number times 2^33 plus a counter.

    A null or empty text is the end id alone; ids may be null or repeat; other columns are not carried.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        raw = lambda ids: array("I", ids).tobytes()
        first, get = encoder(tokenizer_path), worker_cache("ids", tokenizer_path, {}, raw, cache_size).__getitem__

        def ids_of(text: str) -> Iterator[bytes]:
            for part in windows(text):
                head, rest = pieces(part)
                yield raw(first(head))
                yield from map(get, rest)

        packer, end = Packer(capacity, pool, TaskContext.get().partitionId() << 33, with_ids), raw([end_id])
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

        def rows():
            cols = list(zip(*packer.out, strict=True)) if packer.out else [()] * 8
            packer.out = []
            kinds = [kind, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        kind = pa.int64()
        for whole in batches:
            for b in sub_batches([whole], "text", 4 << 20):
                kind = b.column(0).type
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    packer.add(doc, b"".join([*ids_of(text), end]))
                if len(packer.out) > 5000:
                    yield rows()
        packer.finish()
        if packer.out:
            yield rows()
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = base.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
