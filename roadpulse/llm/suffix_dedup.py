"""Suffix-array dedup (operator 4): two-stage suffix sorting of passages that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import Scratch, bitmap_words, give_back, mark, sub_batches

MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def rolling(t: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each position of ``t`` on, where so many follow."""
    with np.errstate(over="ignore"):
        part, size, power = TURN[t], 1, np.full(1, MIX)
        done, have = None, 0
        left = length
        while True:
            if left & 1:
                if done is None:
                    done, have, done_power = part, size, power
                else:
                    n = len(t) - have - size + 1
                    done, have, done_power = done[:n] * power + part[have : have + n], have + size, done_power * power
            left >>= 1
            if not left or len(part) <= size:
                break
            part, size, power = part[:-size] * power + part[size:], 2 * size, power * power
        h = done[: max(0, len(t) - length + 1)] if done is not None and have == length else np.zeros(0, np.uint64)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def gram_length(length: int) -> int:
    return 1 << max(0, min(64, length // 6).bit_length() - 1)


def anchors(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts: (anchor, first, last + 1, whether it may repeat itself).  The anchor of a
    window of ``length`` bytes is the smallest hash of the grams in it, so equal windows have equal
    anchors, wherever they lie.  A run can only hold equal windows if its anchor occurs in it twice."""
    if len(t) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    gram = gram_length(length)
    grams = rolling(t, gram)
    low, size, span = grams, 1, length - gram + 1
    while 2 * size <= span:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if rest := span - size:
        low = np.minimum(low[:-rest], low[rest:])
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    anchor = low[first]
    small = np.flatnonzero(grams <= anchor.max())
    value = grams[small]
    o = np.argsort(value, kind="stable")
    twice = value[o[1:]][(value[o[1:]] == value[o[:-1]]) & (small[o[1:]] - small[o[:-1]] < length)]
    return anchor, first, np.r_[first[1:], len(low)], np.isin(anchor, twice) if len(twice) else np.zeros(len(anchor), bool)


def words(t: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros follow the end."""
    w = np.zeros(len(t) + pad + 8, np.uint64)
    w[: len(t)] = t
    for k in (1, 2, 4):
        w = w[:-k] << np.uint64(8 * k) | w[k:]
    return w


def direct_sort(pos: np.ndarray, w: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes, eight at a time; of suffixes whose hash of
    that many bytes is equal only one is compared and the others follow it."""
    key = w[pos]
    o = np.argsort(key, kind="stable")
    pos, key = pos[o], key[o]
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    tied = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    if not tied.any():
        return pos
    own, g = pos[tied], group[tied]
    o = np.lexsort((h[own], g))
    own, g = own[o], g[o]
    new = np.r_[True, (g[1:] != g[:-1]) | (h[own[1:]] != h[own[:-1]])]
    start = np.flatnonzero(new)
    count, rep, g, name = np.diff(np.r_[start, len(own)]), own[start], g[start], np.arange(len(start))
    g = np.cumsum(np.r_[False, g[1:] != g[:-1]])
    for d in range(8, depth, 8):
        at = np.flatnonzero(np.bincount(g)[g] > 1)
        if not len(at):
            break
        key = w[rep[at] + d]
        o = np.lexsort((key, g[at]))
        rep[at], name[at], key = rep[at][o], name[at][o], key[o]
        border = np.zeros(len(g), bool)
        border[1:] = g[1:] != g[:-1]
        border[at[1:]] |= key[1:] != key[:-1]
        g = np.cumsum(border)
    sizes = count[name]
    offset = np.repeat(start[name] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    pos = pos.copy()
    pos[tied] = own[np.arange(len(own)) + offset]
    return pos


def suffix_array(t: np.ndarray, w: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``t`` in order of ``depth`` bytes at least.

    Two stages: suffixes smaller than their successors are sorted directly; the others follow by
    scans of the buckets of first bytes from the smallest on, since what precedes a suffix in the text
    enters the front of its own bucket in the order in which the suffixes are met.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(t[1:] != t[:-1])
    after = np.r_[t[change + 1] > t[change], False]  # of each run of equal bytes; the end is smallest
    smaller = np.repeat(after, np.diff(np.r_[0, change + 1, n]))
    direct = direct_sort(np.flatnonzero(smaller).astype(np.int32), w, h, depth)
    border = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([n - 1], np.int32))
    out = []
    for c in range(256):
        front, wave = waiting[c], np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int32)
        front = [wave]
        while len(wave):  # runs of this byte
            wave = wave[wave > 0] - 1
            wave = wave[(t[wave] == c) & ~smaller[wave]]
            front.append(wave)
        bucket = np.concatenate([*front, direct[border[c] : border[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = t[before]
        keep = ~smaller[before] & (first > c)
        before, first = before[keep], first[keep]
        o = np.argsort(first, kind="stable")
        before, first = before[o], first[o]
        cut = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else []
        for part in np.split(before, cut[1:]) if len(first) else []:
            waiting[t[part[0]]].append(part)
    return np.concatenate(out)


def equal_bytes(w: np.ndarray, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """How many bytes from ``p`` and from ``q`` on are equal, ``most`` at most; eight at a time, while any go on."""
    n, live = np.full(len(p), most), np.arange(len(p))
    for d in range(0, most, 8):
        if not len(live):
            break
        x = w[p[live] + d] ^ w[q[live] + d]
        end = np.flatnonzero(x)
        n[live[end]] = d + sum((x[end] >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(1, 8))
        live = live[x == 0]
    return np.minimum(n, most)


def common_prefixes(t: np.ndarray, w: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, n): suffix p follows suffix q in ``order`` and n bytes of both are equal, ``most`` at most; p ascends.

    While p and q both step on by one, the first byte that differs stays where it is.  So bytes are compared at
    the end of each such chain only, and before that the next difference in the chain tells n.
    """
    phi = np.full(len(t) + 1, -1, np.int32)
    phi[order[1:]] = order[:-1]
    p = np.flatnonzero(phi >= 0)
    q = phi[p]
    del phi
    if not len(p):
        return p, q, p
    last = np.r_[(p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1), True]
    bound = len(t) + most + 1
    differ = np.where(t[p] != t[q], p, bound - 1)
    end = np.flatnonzero(last)
    differ[end] = p[end] + equal_bytes(w, p[end], q[end], most)
    shift = np.cumsum(np.r_[False, last[:-1]]) * bound  # keeps the minimum inside a chain
    differ += shift
    differ = np.minimum.accumulate(differ[::-1])[::-1]
    differ -= shift
    differ -= p
    return p, q, np.minimum(differ, most)


def repeated(texts: list[bytes], owned: list[int], length: int) -> list[np.ndarray]:
    """For each text, which of its first ``owned`` positions start ``length`` bytes that also start at an
    owned position elsewhere.  So many bytes follow every owned position in its text."""
    t = np.frombuffer(b"\xff".join(texts), np.uint8)
    w = words(t, length + 8)
    h = np.zeros(len(t), np.uint64)
    h[: max(0, len(t) - length + 1)] = rolling(t, length)
    begin = np.cumsum([0, *(len(x) + 1 for x in texts)])[:-1]
    mine = np.zeros(len(t), bool)
    for b, k in zip(begin.tolist(), owned, strict=True):
        mine[b : b + k] = True
    order = suffix_array(t, w, h, length)
    del h
    p, q, n = common_prefixes(t, w, order[mine[order]], length)
    hit = np.zeros(len(t), bool)
    hit[p[n >= length]] = True
    hit[q[n >= length]] = True
    return [hit[b : b + k] for b, k in zip(begin.tolist(), owned, strict=True)]


def runs_of(keep: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, keep, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeated_in_shares(texts: list[bytes], owned: list[int], length: int, most_bytes: int) -> list[np.ndarray]:
    """``repeated`` for texts of any total length, a suffix array of ``most_bytes`` at most at a time.

    Windows whose hash occurs once can't repeat and are left out first.  Of what is left, equal pieces are sorted as
    one, with a mark that there are several; a window that very many texts share would fill an array by itself.
    Pieces that are still too much are dealt out by the hashes of their windows, again and again: equal windows have
    equal hashes, so they stay together.  Where one hash is left, every window is a piece.
    """
    h = np.concatenate([rolling(np.frombuffer(x, np.uint8), length)[:k] for x, k in zip(texts, owned, strict=True)])
    value = np.sort(h)
    twice = np.unique(value[1:][value[1:] == value[:-1]])
    del value
    begin = np.cumsum([0, *owned])
    if not len(twice):
        return np.split(np.zeros(len(h), bool), begin[1:-1])
    edge, hit = np.zeros(len(h), bool), np.zeros(len(h), bool)
    edge[begin[:-1]] = True
    shares = [(np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h), 1)]  # windows, and the product of the shares before
    while shares:
        at, dealt = shares.pop()
        one = bool((h[at] == h[at[0]]).all())
        first = np.arange(len(at)) if one else np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | edge[at[1:]]])
        start, count = at[first], np.diff(np.r_[first, len(at)])
        text = np.searchsorted(begin, start, "right") - 1
        pieces: dict[bytes, list[int]] = {}
        for i, a, w, k in zip(text.tolist(), (start - begin[text]).tolist(), start.tolist(), count.tolist(), strict=True):
            pieces.setdefault(texts[i][a : a + k - 1 + length], []).append(w)
        size = sum(map(len, pieces))
        if size > most_bytes and not one:
            n = min(1 << 15, max(2, -(-size // most_bytes), -(-len(np.unique(h[at])) * length // most_bytes)))
            share = (h[at] // np.uint64(dealt) % np.uint64(n)).astype(np.uint16)
            o = np.argsort(share, kind="stable")
            shares += [(x, dealt * n) for x in np.split(at[o], np.flatnonzero(np.diff(share[o])) + 1)]
            continue
        found = repeated(list(pieces), [len(x) - length + 1 for x in pieces], length)
        for places, k in zip(pieces.values(), found, strict=True):
            for w in places:
                hit[w : w + len(k)] |= len(places) > 1 or k
    return np.split(hit, begin[1:-1])


def spans_of(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes covered by windows at the marked starts, as (from, to) of each run of starts."""
    return [(a, b - 1 + length) for a, b in runs_of(hit)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(texts: Iterator[pa.RecordBatch], length: int):
    """(key, bytes, *anchors()) of each text that the task has not met before."""
    seen: set[bytes] = set()
    for whole in texts:
        for b in sub_batches([whole], "text", 2 << 20):
            for text in b.column(0).to_pylist():
                data = text.encode() if isinstance(text, str) else text
                key = hashlib.sha256(data).digest()[:16]
                if key in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(key)
                yield key, data, *anchors(np.frombuffer(data, np.uint8), length)
    give_back()


def _first_scan(length: int):
    """(h, who): every run of windows with anchor h, and a hash of the text and place where it is."""

    def run(batches):
        hs, whos, n = [], [], 0
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(whos).view(np.int64))], ["h", "who"])
        for key, _, h, first, _, own in _scan(batches, length):
            if len(h):
                who = _places(key, first)
                whos += [who, ~who[own]]
                hs += [h, h[own]]
                n += len(h)
                if n > 50_000:
                    yield rows()
                    hs, whos, n = [], [], 0
        if n:
            yield rows()

    return run


def _inside(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h % np.uint64(len(bits) * 64)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _hot_windows(length: int, hot):
    """(h, who): a hash of every window of the runs whose anchor is in the bitmap, and of the text and place."""

    def run(batches):
        for key, data, h, first, last, _ in _scan(batches, length):
            runs = np.flatnonzero(_inside(hot.value, h))
            if len(runs):
                at = np.concatenate([np.arange(first[k], last[k]) for k in runs.tolist()])
                x = rolling(np.frombuffer(data, np.uint8), length)[at]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(_places(key, at).view(np.int64))], ["h", "who"])

    return run


def _places(key: bytes, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        who = (np.frombuffer(key[:8], np.uint64)[0] ^ at.astype(np.uint64) * MIX) * np.uint64(0xBF58476D1CE4E5B9)
        return who ^ (who >> np.uint64(31))


def _hot_pieces(length: int, hot, windows, step: int):
    """(h, who, key, start, seg): pieces of the runs whose anchor is in ``hot``, without windows that are not in ``windows``.

    Equal windows hold their anchor at the same distance d from their start.  A piece has windows of one text whose
    d // ``step`` is the same; all windows of that kind hold ``length`` - ``step`` + 1 bytes around the anchor in common,
    and h is a hash of these, of d // ``step`` and of the anchor: the anchor refined by further bytes.
    """
    gram = gram_length(length)

    def run(batches):
        out, size = [], 0

        def rows():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["h", "who", "key", "start", "seg"])

        for key, data, h, first, last, _ in _scan(batches, length):
            runs = np.flatnonzero(_inside(hot.value, h))
            if not len(runs):
                continue
            t = np.frombuffer(data, np.uint8)
            x, grams = rolling(t, length), rolling(t, gram)
            for k in runs.tolist():
                at = np.arange(first[k], last[k])
                places = first[k] + np.flatnonzero(grams[first[k] : last[k] + length - gram] == h[k])
                place = places[np.searchsorted(places, at)]
                kind = (place - at) // step
                keep = _inside(windows.value, x[at])
                cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (kind[1:] != kind[:-1]) | (keep[1:] != keep[:-1]), True])
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    if not keep[a]:
                        continue
                    begin = int(place[a] - kind[a] * step)
                    common = data[begin : begin + length - step + 1]
                    name = hashlib.sha256(b"%d %d " % (h[k], kind[a]) + common).digest()[:8]
                    seg = data[at[a] : at[b - 1] + length]
                    out.append((int.from_bytes(name, "big", signed=True), int(_places(key, at[a : a + 1])[0].view(np.int64)), key, int(at[a]), seg))
                    size += len(seg)
            if size > 4 << 20:
                yield rows()
                out, size = [], 0
        if out:
            yield rows()

    return run


def _second_scan(length: int, bitmap, hot):
    """(h, key, start, seg): runs whose anchor is in ``bitmap`` and not in ``hot``, with the bytes of their windows."""

    def run(batches):
        out, size = [], 0

        def rows():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["h", "key", "start", "seg"])

        for key, data, h, first, last, _ in _scan(batches, length):
            for k in np.flatnonzero(_inside(bitmap.value, h) & ~_inside(hot.value, h)).tolist():
                seg = data[first[k] : last[k] - 1 + length]
                out.append((int(h[k].view(np.int64)), key, int(first[k]), seg))
                size += len(seg)
            if size > 4 << 20:
                yield rows()
                out, size = [], 0
        if out:
            yield rows()

    return run


def _match(length: int, batch_bytes: int, most_bytes: int):
    """Over rows (h, key, start, seg, many) sorted by h: (key, a, b), bytes a to b - 1 of text key lie in repeated
    windows.  ``many``: the bytes stand at several places already."""

    def run(batches):
        waiting: list[tuple[bytes, tuple[bool, list]]] = []  # unique runs of whole anchor groups, and where they are
        size = 0

        def flush():
            nonlocal waiting, size
            texts, owned = [x for x, _ in waiting], [len(x) - length + 1 for x, _ in waiting]
            if not texts:
                return
            # Runs of different anchors share no window, so they may be sorted together.
            found = repeated(texts, owned, length) if size <= most_bytes else repeated_in_shares(texts, owned, length, most_bytes)
            out = []
            for (text, (many, places)), hit in zip(waiting, found, strict=True):
                for a, b in [(0, len(text))] if many else spans_of(hit, length):
                    out += [(key, start + a, start + b) for key, start in places]
            waiting, size = [], 0
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["key", "a", "b"])

        anchor, group, last = None, {}, None

        def itself(x: bytes) -> bool:
            h = np.sort(rolling(np.frombuffer(x, np.uint8), length))
            return bool((h[1:] == h[:-1]).any())

        def close():
            nonlocal group, size
            group = {x: (many or len(p) > 1, p) for x, (many, p) in group.items()}
            if len(group) > 1 or any(many or itself(x) for x, (many, _) in group.items()):
                waiting.extend(group.items())
                size += sum(map(len, group))
            group = {}

        for b in batches:
            for h, key, start, seg, many in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != anchor:
                    held = size
                    close()
                    if held and size > batch_bytes:
                        # What was held before this group goes alone if the group is large itself.
                        new = size - held
                        if new > batch_bytes:
                            tail, k = [], 0
                            while k < new:
                                tail.append(waiting.pop())
                                k += len(tail[-1][0])
                            size = held
                            yield from flush()
                            waiting, size = tail, new
                    if size > batch_bytes:
                        yield from flush()
                    anchor = h
                if (h, key, start) != last:
                    group.setdefault(seg, (many, []))[1].append((key, start))
                    last = (h, key, start)
        close()
        yield from flush()
        give_back()

    return run


def repeated_spans(df: DataFrame, text_col: str, length: int, scratch: Scratch, bitmap_bits: int = 1 << 26, hot_runs: int = 20_000, batch_bytes: int = 1 << 19, most_bytes: int = 3 << 19) -> DataFrame:
    """(key, spans): bytes of each distinct text (key: 16 bytes of its SHA-256) that lie in windows which
    also start elsewhere in the distinct texts.

    1. Texts are read where they lie.  Each run of windows sends its anchor; anchors met at two
       places, or twice in one run, are marked in a bitmap of fixed size.
    2. Texts are read again, and runs with a marked anchor go to the task of their anchor with their
       bytes.  Equal windows have equal anchors, so no match is lost; a false mark costs time only.
    3. There, runs of whole anchor groups fill a buffer, whose suffix array shows the repeats.

    An anchor of over ``hot_runs`` runs, as a passage that very many texts share has, would be too much for a
    task.  Such anchors are refined (``_hot_pieces``): windows whose hash is met at one place only are left out, the
    others are dealt out in pieces by the bytes around their anchor, and equal pieces are made one, with a mark that
    there are several, before the shuffle.  Pieces then meet in suffix arrays as runs do, and what is found goes
    back to the places by a join on the piece.
    """
    spark, sc = scratch.spark, scratch.spark.sparkContext
    texts = df.select(F.col(text_col).cast("binary").alias("text")).where(F.length("text") >= length)
    twice = lambda rows: rows.groupBy("h").agg(F.min("who").alias("x"), F.max("who").alias("y"), F.count("*").alias("n")).where("x <> y").select("h", "n")
    met = scratch.put(twice(texts.mapInArrow(_first_scan(length), "h long, who long")), "anchors")

    def bitmap(values: DataFrame):
        """Some 16 places for each value, ``bitmap_bits`` at most."""
        bits = min(bitmap_bits, 1 << max(10, (16 * values.count()).bit_length()))
        out = np.zeros(bits >> 6, np.uint64)
        rows = bitmap_words(values, "h", bits).toArrow()
        # The last bits of a negative number are those of the unsigned one.
        out[rows["word"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
        return sc.broadcast(out)

    many = met.where(F.col("n") > hot_runs)
    hot = bitmap(many)
    runs = texts.mapInArrow(_second_scan(length, bitmap(met), hot), "h long, key binary, start long, seg binary").withColumn("many", F.lit(False))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    match = lambda rows, name: scratch.put(rows.repartition(n, "h").sortWithinPartitions("h", "key", "start").mapInArrow(_match(length, batch_bytes, most_bytes), "key binary, a long, b long"), name)
    found = match(runs, "matches")
    if not many.isEmpty():
        windows = bitmap(scratch.put(twice(texts.mapInArrow(_hot_windows(length, hot), "h long, who long")), "windows"))
        pieces = scratch.put(texts.mapInArrow(_hot_pieces(length, hot, windows, max(1, length // 8)), "h long, who long, key binary, start long, seg binary"), "pieces")
        once = pieces.groupBy("h", "seg").agg(F.min("who").alias("x"), F.max("who").alias("y"))
        hits = match(once.select("h", F.col("seg").alias("key"), F.lit(0).cast("long").alias("start"), "seg", (F.col("x") != F.col("y")).alias("many")), "hits")
        back = pieces.select("key", "start", "seg").join(hits.withColumnRenamed("key", "seg"), "seg")
        found = found.unionByName(back.select("key", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")))
    return found.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_text: bool = False, decode: bool = False, carry: list[str] | None = None, least_words: int = 0, **how) -> DataFrame:
    """Remove each byte of a text that lies in ``length`` bytes which also start anywhere else; with ``least_words``
    only from maximal runs of such bytes that hold so many words.

    Texts are UTF-8 bytes (null: empty); matches never cross documents; repeats in the same document
    count and may overlap; all is judged on the input.  Rows with equal texts of ``length`` bytes or more
    repeat each other wholly.  Returns ``id_col``, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, with ``with_text`` kept (binary, as a cut may part a character; with ``decode`` a string
    without parted characters), and the columns of ``carry``.  Ids may be null or repeat; other columns are not carried; no rows give no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "suffix")
    spans = repeated_spans(df, text_col, length, scratch, **how)
    shape = "string" if decode else "binary"
    more = {f"c{k}": name for k, name in enumerate(carry or [])}
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *(F.col(name).alias(c) for c, name in more.items()))
    docs = docs.withColumn("sha", F.sha2("text", 256)).withColumn("key", F.unhex(F.substring("sha", 1, 32)))
    copies = docs.where(F.length("text") >= length).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("whole"))
    spans = scratch.put(spans.join(copies, "key", "full").select("key", "spans", F.coalesce("whole", F.lit(False)).alias("whole")), "spans")
    # Texts without a removed byte stay where they are.
    flagged = mark(scratch, docs, F.col("key"), spans.select("key"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    digest = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    some = flagged.where("_hit").join(spans, "key", "left").select("text", "sha", "spans", "whole", "id", *more)
    some = some.mapInArrow(_cut(with_text, decode, least_words), "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + f", kept {shape}" * with_text + "".join(f", {c} {kinds[c]}" for c in ("id", *more)))
    zero, whole = F.lit(0).cast("long"), F.col("text").cast(shape)
    rest = flagged.where(~F.col("_hit")).select(F.length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), *([whole.alias("kept")] if with_text else []), "id", *more)
    return some.unionByName(rest).select(F.col("id").alias(id_col), *digest, *(F.col(c).alias(name) for c, name in more.items()))


def _cut(with_text: bool, decode: bool, least_words: int):
    def run(batches):
        for whole in batches:
            for b in sub_batches([whole], "text"):
                out = []
                for text, sha, spans, all_ in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    spans = [(0, len(text))] if all_ and text else merged([(s["a"], s["b"]) for s in spans or []])
                    if least_words:
                        spans = [(a, e) for a, e in spans if len(text[a:e].split()) >= least_words]
                    if spans:
                        ends = [0, *(e for _, e in spans)]
                        kept = b"".join(text[a:s] for a, (s, _) in zip(ends, [*spans, (len(text), 0)], strict=True))
                        sha = hashlib.sha256(kept).hexdigest()
                    else:
                        kept = text
                    out.append((len(text), len(text) - len(kept), len(spans), sha, *([kept.decode(errors="ignore") if decode else kept] if with_text else [])))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if decode else pa.binary()]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols)]
                tail = b.schema.names[4:]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), *b.columns[4:]], [*names, *tail])
        give_back()

    return run
