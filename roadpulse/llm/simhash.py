"""SimHash near-dedup (operator 7): bit planes stored vertically, compared with carry-save counters."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import Scratch, components, give_back, mark, sub_batches, with_least

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bit k of a byte, in byte k of a word: sums of up to 255 such words count eight bits at once.
SPREAD = np.array([sum((v >> k & 1) << 8 * k for k in range(8)) for v in range(256)], np.uint64)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes, n: int) -> list[bytes]:
    """Shingles of ``n`` words of the text in lower case (A-Z only), repeats included; the whole
    sequence if it has fewer words, nothing if it has none."""
    words = text.translate(LOWER).split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [joined[a:b] for a, b in zip(starts[: -n + 1 or None].tolist(), ends[n - 1 :].tolist(), strict=True)]


def fingerprint(text: str, n: int, words: int = 1, seed: int = 42) -> bytes:
    """8 bytes, the most significant first: a bit is 1 if over half of the shingles' XXH64 have it.
    Each of further ``words`` takes the hashes mixed once more."""
    found = shingles(text.encode(), n)
    if not found:
        return bytes(8 * words)
    return majority(np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in found]), np.uint8).reshape(-1, 8), words)


def majority(h: np.ndarray, words: int) -> bytes:
    """The bits that over half of the hashes ``h`` (n, 8 bytes, the most significant first) have."""
    out = b""
    for _ in range(words):
        if out:
            with np.errstate(over="ignore"):
                z = h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
                z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                h = (z ^ z >> np.uint64(31)).view(np.uint8).reshape(-1, 8)
        count = np.add.reduceat(SPREAD[h], np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
        out += np.packbits(2 * count > len(h), bitorder="little").tobytes()
    return out


def pigeonhole(bits: int, radius: int) -> list[np.ndarray]:
    """Sets of bit positions: any two fingerprints at most ``radius`` apart agree on all bits of one set.
    Of radius + 2 blocks two stay untouched at least."""
    blocks = np.array_split(np.arange(bits), radius + 2)
    return [np.concatenate(x) for x in combinations(blocks, 2)]


def sampled(bits: int, n: int, radius: int, recall: float, seed: int) -> list[np.ndarray]:
    """Random sets of bit positions, for ``n`` fingerprints of which some 16 agree on one by chance, and
    so many that two fingerprints ``radius`` apart agree on all bits of one with probability ``recall``."""
    r, size = np.random.default_rng(seed), max(12, int(np.ceil(np.log2(max(1, n) / 16))))
    one = (1 - radius / bits) ** size
    return [np.sort(r.choice(bits, size, replace=False)) for _ in range(int(np.ceil(np.log(1 - recall) / np.log(1 - one))))]


def planes(fps: np.ndarray) -> np.ndarray:
    """(n, bytes) -> (bits, words): bit k of word w in plane j is bit j of fingerprint 64 w + k."""
    bits = np.unpackbits(fps, axis=1)
    lanes = np.zeros((bits.shape[1], -(-len(fps) // 64) * 64), np.uint8)
    lanes[:, : len(fps)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)


def carry_save(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def close(plane, n_planes: int, words: int, radius: int, live: np.ndarray) -> np.ndarray:
    """Lanes whose distance is at most ``radius``, as bits.  ``plane(j, cols)`` gives the differences in
    plane j for those words; ``live`` (..., words) has the lanes that matter.

    Eight planes at a time go through a tree of carry-save adders into bitwise counters; after each
    eight, words in which every live lane exceeds the radius are abandoned.
    """
    out = np.zeros(live.shape, np.uint64)
    cols = np.arange(words)
    alive = live.copy()
    counter = [np.zeros(live.shape, np.uint64) for _ in range(3 + max(0, radius.bit_length() - 3))]
    over = np.zeros(live.shape, np.uint64)
    for at in range(0, n_planes, 8):
        p = [plane(j, cols) for j in range(at, at + 8)]
        one, t = carry_save(counter[0], p[0], p[1])
        one, u = carry_save(one, p[2], p[3])
        two, f = carry_save(counter[1], t, u)
        one, t = carry_save(one, p[4], p[5])
        one, u = carry_save(one, p[6], p[7])
        two, g = carry_save(two, t, u)
        four, carry = carry_save(counter[2], f, g)
        counter[:3] = one, two, four
        for k in range(3, len(counter)):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        more, same = over.copy(), ~over
        for k in reversed(range(len(counter))):  # is the count above the radius?
            if radius >> k & 1:
                same &= counter[k]
            else:
                more |= same & counter[k]
                same &= ~counter[k]
        alive &= ~more
        keep = alive.any(axis=tuple(range(alive.ndim - 1))) if alive.ndim > 1 else alive != 0
        if not keep.any():
            return out
        if keep.sum() < 0.7 * len(keep):
            cols, alive, over = cols[keep], alive[..., keep], over[..., keep]
            counter = [c[..., keep] for c in counter]
    out[..., cols] = alive
    return out


def lanes(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Give the ends of every pair the smallest label of what they are joined to."""
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
    return label


def link_groups(fps: np.ndarray, group: np.ndarray, radius: int, small: int = 48) -> np.ndarray:
    """For each of the fingerprints (n, bytes), sorted by ``group``, the row that stands for it: rows of a
    group that are joined by links get the same one."""
    label, bits = np.arange(len(fps)), fps.shape[1] * 8
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    # Small groups all at once: every row against the one s rows further on, for s = 1, 2, ...
    rows = np.flatnonzero(np.repeat((size > 1) & (size <= small), size))
    g, s = group[rows], 0
    while len(rows):
        s += 1
        mate = np.zeros(len(rows), bool)
        mate[: len(rows) - s] = g[s:] == g[:-s] if s < len(rows) else False
        if not mate.any():
            break
        if s == 1:
            v = planes(fps[rows])
            v = np.concatenate([v, np.zeros((bits, small // 64 + 2), np.uint64)], axis=1)
        words = -(-len(rows) // 64)
        live = np.packbits(np.r_[mate, np.zeros(words * 64 - len(rows), bool)], bitorder="little").view(np.uint64)
        q, r = divmod(s, 64)
        used = np.flatnonzero(live)

        def plane(j, cols, q=q, r=r, v=v, used=used):
            c = used[cols]
            far = v[j, c + q] >> np.uint64(r)
            if r:
                far |= v[j, c + q + 1] << np.uint64(64 - r)
            return v[j, c] ^ far

        hit = np.zeros(words, np.uint64)
        hit[used] = close(plane, bits, len(used), radius, live[used])
        a = np.flatnonzero(lanes(hit, len(rows)))
        label = merge(label, rows[a], rows[a + s])
    # Large groups: 64 rows at a time against all that follow.
    for at, n in zip(start[size > small], size[size > small], strict=True):
        v, own = planes(fps[at : at + n]), np.unpackbits(fps[at : at + n], axis=1).astype(bool)
        for p in range(0, n, 64):
            w = v[:, p // 64 :]
            asked = np.where(own[p : p + 64].T[:, :, None], ALL, np.uint64(0))
            rest = np.arange(p, n)
            far = label[at + rest][None, :] != label[at + p : at + min(p + 64, n)][:, None]
            if not far.any():
                continue
            pad = np.zeros((len(far), w.shape[1] * 64), bool)
            pad[:, : n - p] = far
            live = np.packbits(pad, axis=1, bitorder="little").view(np.uint64)
            hit = close(lambda j, cols, w=w, asked=asked: w[j, cols][None, :] ^ asked[j], bits, w.shape[1], radius, live)
            a, b = np.nonzero(lanes(hit, n - p))
            label = merge(label, at + p + a, at + p + b)
    return label


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int, words: int, seed: int) -> DataFrame:
    """(id, fp) of every whole text."""

    def run(batches):
        for whole in batches:
            for b in sub_batches([whole], "text", 4 << 20):
                fps = [fingerprint(t or "", shingle, words, seed) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp binary")


def _candidates(distinct: DataFrame, sets: list[np.ndarray]) -> DataFrame:
    """(t, key, uid, fp): one row for each fingerprint and set of bit positions."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                fps = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                bits = np.unpackbits(fps, axis=1)
                for t, positions in enumerate(sets):
                    key = np.zeros((len(fps), 8), np.uint8)
                    packed = np.packbits(bits[:, positions], axis=1)
                    key[:, : packed.shape[1]] = packed
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), t, np.int32)), pa.array(key.view(np.int64).ravel()), b.column(0), b.column(1)], ["t", "key", "uid", "fp"])

    return distinct.mapInArrow(run, "t int, key long, uid long, fp binary")


def _linker(radius: int, flush: int = 1 << 17):
    """Over rows sorted by (t, key, part): links (a, b) that join all rows of a group that links join."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def link(rows: pa.Table):
            cols = [rows[c].to_numpy() for c in ("t", "key", "part")]
            change = np.zeros(len(cols[0]), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            group = np.cumsum(change)
            many = np.bincount(group)[group] > 1
            if not many.any():
                return
            uid = rows["uid"].to_numpy()[many]
            fps = np.frombuffer(b"".join(rows["fp"].filter(pa.array(many)).to_pylist()), np.uint8).reshape(len(uid), -1)
            label = link_groups(fps, group[many], radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(uid[moved]), pa.array(uid[label[moved]])], ["a", "b"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= flush:
                rows = pa.Table.from_batches(held)
                last = [rows[c][-1] for c in ("t", "key", "part")]
                same = np.ones(rows.num_rows, bool)
                for c, v in zip(("t", "key", "part"), last, strict=True):
                    same &= rows[c].to_numpy() == v.as_py()
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on
                if cut:
                    yield from link(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield from link(pa.Table.from_batches(held))

    return run


def groups(scratch: Scratch, prints: DataFrame, radius: int, bits: int, recall: float | None, seed: int, part_rows: int = 8192) -> DataFrame:
    """(fp, component_id) of the fingerprints of ``prints`` (id, fp): the smallest id of those that links join."""
    spark = scratch.spark
    distinct = scratch.put(prints.groupBy("fp").agg(F.min("id").alias("first")).withColumn("uid", F.monotonically_increasing_id()), "distinct")
    sets = pigeonhole(bits, radius) if recall is None else sampled(bits, distinct.count(), radius, recall, seed)
    rows = _candidates(distinct.select("uid", "fp"), sets)
    large = scratch.put(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * part_rows).select("t", "key", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")), "large")
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        # A large group is dealt out in parts, and every pair of parts meets in a task of its own.
        rows = rows.join(large, ["t", "key"], "left").withColumn("p", F.pmod(F.xxhash64("uid"), F.coalesce("parts", F.lit(1))).cast("int"))
        others = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda o: F.least(o, F.col("p")) * 65536 + F.greatest(o, F.col("p")))
        rows = rows.withColumn("part", F.explode(others)).drop("p", "parts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "t", "key", "part").sortWithinPartitions("t", "key", "part")
    edges = scratch.put(rows.mapInArrow(_linker(radius), "a long, b long"), "links")
    roots = components(scratch, edges)
    named = scratch.put(distinct.join(roots, distinct.uid == roots.node, "left").select("fp", "first", F.coalesce("root", "uid").alias("root")), "named")
    return with_least(scratch, named, "root", "first", "component_id").select("fp", "component_id")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, words: int = 1, recall: float | None = None, seed: int = 42) -> DataFrame:
    """Groups of documents whose SimHash fingerprints are joined by links of ``radius`` bits or less.

    A fingerprint has 64 * ``words`` bits, from the XXH64 (``seed``) of the shingles of ``shingle`` words.  Equal
    fingerprints are one node.  Nodes meet where they agree on a set of bits: without ``recall``, sets
    from the pigeonhole principle, which miss no link; else random sets, so many that a link of the full
    radius is found with that probability (a closer one more surely), for radii that blocks can't serve.
    Nodes that met are compared bit-sliced; a task reports no more links than it takes to join what
    is linked.  Groups of any size are dealt out in parts.

    Returns ``id_col``, fingerprint (hex digits, the most significant first), component_id (smallest
    id reachable, itself included).  Null and empty texts have fingerprint zero, linked like any other; null
    ids are passed over in the minimum; rows may repeat; other columns are not carried.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    prints = scratch.put(fingerprints(df, id_col, text_col, shingle, words, seed), "prints")
    found = groups(scratch, prints, radius, 64 * words, recall, seed)
    return prints.join(found, "fp").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str, n: int, seed: int) -> np.ndarray:
    """The XXH64 of the distinct shingles of ``n`` words, in order."""
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in shingles(text.encode(), n)]), ">u8").astype(np.uint64))


class Bands:
    """Min-wise hashes of a set of shingles: keys of bands of four minima each, on which sets of Jaccard similarity J
    agree with probability J^4 a band.  They tell which SimHash fingerprints are compared."""

    def __init__(self, bands: int, seed: int) -> None:
        r = np.random.default_rng(seed)
        self.bands = bands
        self.by = r.integers(0, 1 << 63, 4 * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.turn = r.integers(0, 1 << 63, (bands, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.zeros(0, np.int64)
        low = np.full(len(self.by), ALL)
        with np.errstate(over="ignore"):
            for at in range(0, len(found), 128):
                low = np.minimum(low, (found[at : at + 128, None] * self.by).min(0))
            low = (low ^ low >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
            key = ((low ^ low >> np.uint64(29)).reshape(-1, 4) * self.turn).sum(1)
            key = (key ^ key >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) + np.arange(self.bands, dtype=np.uint64)
        return key.view(np.int64)


def bands_for(jaccard: float, recall: float) -> int:
    """So many bands of four that sets of similarity ``jaccard`` agree on one with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - jaccard**4)))


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def within(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs of rows (a, b) of the fingerprints are at most ``radius`` apart, bit-sliced."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        far = planes(fps[x] ^ fps[y])
        live = np.packbits(np.r_[np.ones(len(x), bool), np.zeros(-len(x) % 64, bool)], bitorder="little").view(np.uint64)
        hit = close(lambda j, cols, far=far: far[j, cols], len(far), far.shape[1], radius, live)
        out[at : at + len(x)] = lanes(hit, len(x))
    return out


#: Sets of fewer shingles have fingerprints that differ more (halves of a few votes); they get a quarter more.
FEW = 16
#: Groups of up to so many rows are compared without planes of their own.
SMALL = 48


def _sized(x: np.ndarray, y: np.ndarray, jaccard: float) -> np.ndarray:
    """Whether sets of so many shingles can be as similar as ``jaccard``."""
    return np.minimum(x, y) >= jaccard * np.maximum(x, y) - 1e-9


def join_group(fps: np.ndarray, n: np.ndarray, jaccard: float, radius: int, same=None) -> np.ndarray:
    """For each row of one group, sets of ``n`` shingles with those fingerprints, the row that stands for it: rows that
    candidates join get the same one; with ``same`` (row, rows), which tells whose sets are alike, rows that links join.

    64 rows at a time meet all that follow, and rows that are joined already are not compared again.
    """
    m, bits = len(n), fps.shape[1] * 8
    label, v, own, few = np.arange(m), planes(fps), np.unpackbits(fps, axis=1).astype(bool), n < FEW
    for p in range(0, m, 64):
        q = min(p + 64, m)
        far = (label[p:][None, :] != label[p:q][:, None]) & _sized(n[p:][None, :], n[p:q][:, None], jaccard)
        far &= np.arange(m - p)[None, :] > np.arange(q - p)[:, None]
        w, asked, hit = v[:, p // 64 :], np.where(own[p:q].T[:, :, None], ALL, np.uint64(0)), np.zeros(far.shape, bool)
        any_few = few[p:][None, :] | few[p:q][:, None]
        for some, reach in ((far & any_few, radius + radius // 4), (far & ~any_few, radius)):
            if some.any():
                pad = np.zeros((q - p, w.shape[1] * 64), bool)
                pad[:, : m - p] = some
                live = np.packbits(pad, axis=1, bitorder="little").view(np.uint64)
                hit |= lanes(close(lambda j, cols, w=w, asked=asked: w[j, cols][None, :] ^ asked[j], bits, w.shape[1], reach, live), m - p)
        if same is None:
            a, b = np.nonzero(hit)
            label = merge(label, p + a, p + b)
            continue
        for a in np.flatnonzero(hit.any(1)):
            b = p + np.flatnonzero(hit[a])
            b = b[label[b] != label[p + a]]
            if len(b := b[same(p + a, b)]):
                label = merge(label, np.full(len(b), p + a), b)
    return label


def _whole_groups(batches, by: tuple[str, str], column: str, flush: int):
    """Tables of about ``flush`` bytes in ``column`` with whole groups of rows that agree on the two columns ``by``."""
    held: list[pa.RecordBatch] = []
    for b in sub_batches(batches, column, flush):
        held.append(b)
        if sum(x.column(column).nbytes for x in held) >= flush:
            rows = pa.Table.from_batches(held)
            same = np.logical_and(*((rows[c].to_numpy() == rows[c][-1].as_py()) for c in by))
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _starts(rows: pa.Table, by: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """The first row and the size of each group."""
    cols = [rows[c].to_numpy() for c in by]
    start = np.flatnonzero(np.r_[True, np.logical_or(*(c[1:] != c[:-1] for c in cols))])
    return start, np.diff(np.r_[start, rows.num_rows])


def _meeting(jaccard: float, radius: int, flush: int = 4 << 20):
    """Over rows sorted by (key, part): pairs (a, b) that join all rows of a group that candidates join, fewer than it
    has rows.  Candidates are pairs whose sizes and fingerprints allow the similarity."""

    def run(batches):
        for rows in _whole_groups(batches, ("key", "part"), "fp", flush):
            start, size = _starts(rows, ("key", "part"))
            after = np.repeat(start + size, size) - np.arange(rows.num_rows) - 1  # rows of the group that follow
            uid, n = rows["uid"].to_numpy(), rows["n"].to_numpy()
            fps = np.frombuffer(b"".join(rows["fp"].to_pylist()), np.uint8).reshape(len(uid), -1)
            label, a, s = np.arange(len(uid)), np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size)), 0
            while len(a := a[after[a] > s]):
                s += 1
                x = a[(label[a] != label[a + s]) & _sized(n[a], n[a + s], jaccard)]
                few, ok = np.minimum(n[x], n[x + s]) < FEW, np.zeros(len(x), bool)
                for some, reach in ((few, radius + radius // 4), (~few, radius)):
                    ok[some] = within(fps, x[some], x[some] + s, reach)
                if ok.any():
                    label = merge(label, x[ok], x[ok] + s)
            for at, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                label[at : at + m] = at + join_group(fps[at : at + m], n[at : at + m], jaccard, radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(uid[moved]), pa.array(uid[label[moved]])], ["a", "b"])
        give_back()

    return run


def _dealt(rows: DataFrame, parts: str) -> DataFrame:
    """``rows`` with the column ``part``: every pair of a group's ``parts`` meets (null: one part only)."""
    p, count = F.pmod(F.xxhash64("uid"), F.coalesce(parts, F.lit(1))).cast("int"), F.coalesce(parts, F.lit(1))
    others = F.transform(F.sequence(F.lit(0), count - 1), lambda o: F.least(o, F.col("_p")) * 65536 + F.greatest(o, F.col("_p")))
    others = F.filter(others, lambda x: (count == 1) | (F.floor(x / 65536) != F.pmod(x, F.lit(65536))))
    return rows.withColumn("_p", p).withColumn("part", F.explode(others)).drop("_p", parts)


def _met(scratch: Scratch, nodes: DataFrame, shared: DataFrame, jaccard: float, radius: int, part_rows: int = 8192) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (uid, n, fp, keys) that join what candidates join; ``shared``: (key, m), keys of several nodes."""
    rows = nodes.select("uid", "n", "fp", F.explode("keys").alias("key"))
    rows = mark(scratch, rows, F.col("key"), shared.select("key")).where("_hit").drop("_hit")  # others meet nobody
    large = shared.where(F.col("m") > 2 * part_rows).select("key", F.ceil(F.col("m") / part_rows).cast("int").alias("parts"))
    # As in ``groups``: a large group is dealt out in parts, and every pair of parts meets in a task of its own.
    rows = rows.withColumn("part", F.lit(0)) if large.isEmpty() else _dealt(rows.join(large, "key", "left"), "parts")
    rows = rows.select("key", "part", "uid", "n", "fp").repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), "key", "part")
    return rows.sortWithinPartitions("key", "part", "uid").mapInArrow(_meeting(jaccard, radius), "a long, b long").distinct()


def _linking(jaccard: float, radius: int, flush: int = 8 << 20):
    """Over rows (family, part, uid, fp, found) sorted by the first three: links (a, b) that join all rows of a family
    that links join, by the exact similarity of the sets ``found``."""

    def run(batches):
        for rows in _whole_groups(batches, ("family", "part"), "found", flush):
            new = np.r_[True, np.logical_or.reduce([(x := rows[c].to_numpy())[1:] != x[:-1] for c in ("family", "part", "uid")])]
            rows = rows.filter(pa.array(new))  # a set may come from several texts
            start, size = _starts(rows, ("family", "part"))
            uid, sets = rows["uid"].to_numpy(), rows["found"].to_pylist()
            n = np.fromiter((len(x) // 8 for x in sets), np.int64, len(sets))
            begin = np.cumsum(n) - n
            fps = np.frombuffer(b"".join(rows["fp"].to_pylist()), np.uint8).reshape(len(uid), -1)
            flat = np.frombuffer(b"".join(sets), np.uint64)
            del sets, rows
            names, flat = np.unique(flat, return_inverse=True)
            flat, mine = flat.astype(np.int32), np.zeros(len(names), bool)
            del names

            def same(a, b, n=n, begin=begin, flat=flat, mine=mine):
                if not len(b):
                    return np.zeros(0, bool)
                own, ends = flat[begin[a] : begin[a] + n[a]], np.cumsum(n[b])
                mine[own] = True
                both = np.add.reduceat(mine[flat[np.arange(ends[-1]) + np.repeat(begin[b] - ends + n[b], n[b])]], ends - n[b], dtype=np.int64)
                mine[own] = False
                return both >= jaccard * (n[a] + n[b] - both) - 1e-9

            label = np.arange(len(uid))
            for at, m in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                if m > SMALL:
                    label[at : at + m] = at + join_group(fps[at : at + m], n[at : at + m], jaccard, radius, lambda a, b, at=at: same(at + a, at + b))
                    continue
                for a in range(at, at + m - 1):
                    b = np.arange(a + 1, at + m)
                    b = b[(label[b] != label[a]) & _sized(n[b], n[a], jaccard)]
                    if len(b := b[same(a, b)]):
                        label[at : at + m] = at + merge(label[at : at + m] - at, np.full(len(b), a - at), b - at)
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(uid[moved]), pa.array(uid[label[moved]])], ["a", "b"])
        give_back()

    return run


def _linked(scratch: Scratch, df: DataFrame, nodes: DataFrame, met: DataFrame, shingle: int, jaccard: float, radius: int, seed: int, part_shingles: int) -> DataFrame:
    """Links (a, b) that join all ``nodes`` that sets of shingles as similar as ``jaccard`` join.

    What candidates join is a family, and links lie in families.  The sets of a family's nodes, taken anew from the texts
    of ``df`` (id, text), meet in one task, or in every pair of parts of some ``part_shingles``, and are compared
    there, so no pair is a row.
    """
    families = components(scratch, met)
    asked = scratch.put(nodes.join(families, nodes.uid == families.node).select("uid", "digest", "first", "n", "fp", F.col("root").alias("family")), "asked")
    large = asked.groupBy("family").agg(F.sum("n").alias("n")).where(F.col("n") > part_shingles // 8)
    large = scratch.put(large.select("family", F.greatest(F.lit(4), F.ceil(F.col("n") / part_shingles)).cast("int").alias("parts")), "large")

    def run(batches):
        seen: set[bytes] = set()
        for b in sub_batches(batches, "text", 1 << 20):
            found = [shingle_set(t or "", shingle, seed) for t in b.column(0).to_pylist()]
            out = {}
            for x in found:
                if (d := _digest(x)) not in seen:
                    out[d] = x.tobytes()
            if len(seen) < 1 << 18:
                seen.update(out)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["digest", "found"])
        give_back()

    sets = mark(scratch, df, F.col("id"), asked.select("first")).where("_hit").select("text").mapInArrow(run, "digest binary, found binary")
    to = asked.select("digest", "uid", "fp", "family")
    to = to.withColumn("part", F.lit(0)) if large.isEmpty() else _dealt(to.join(large, "family", "left"), "parts")
    rows = sets.join(to, "digest").select("family", "part", "uid", "fp", "found")
    rows = rows.repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), "family", "part").sortWithinPartitions("family", "part", "uid")
    links = scratch.put(rows.mapInArrow(_linking(jaccard, radius), "a long, b long"), "links")
    scratch.drop(asked, large)
    return links


def near_copies(scratch: Scratch, df: DataFrame, shingle: int, jaccard: float, words: int, radius: int, recall: float, seed: int, part_shingles: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Of ``df`` (id, text): prints (id, digest) of every row, and named (digest, first, root) of every distinct set
    of shingles; sets that links of Jaccard similarity ``jaccard`` or more join have the same root.

    Sets that agree on a band of min-wise hashes (probability ``recall`` at a similarity of ``jaccard``, more above it)
    meet, and their SimHash fingerprints, of 64 * ``words`` bits over the distinct shingles, are compared
    bit-sliced.  Those at most ``radius`` apart are candidates; what candidates join is a family, and in it sets are compared exactly (``_linked``).
    Tasks write no pairs but what joins a group, fewer rows than the group has.  What is not needed any more is deleted.
    """
    bands = Bands(bands_for(jaccard, recall), seed)

    def run(batches):
        for b in sub_batches(batches, "text", 4 << 20):
            found = [shingle_set(t or "", shingle, seed) for t in b.column(1).to_pylist()]
            keys = [bands(x) for x in found]
            fps = [majority(x.astype(">u8").view(np.uint8).reshape(-1, 8), words) if len(x) else bytes(8 * words) for x in found]
            ends = np.cumsum([0, *map(len, keys)])
            cols = [b.column(0), pa.array(list(map(_digest, found)), pa.binary()), pa.array(list(map(len, found)), pa.int32()), pa.array(fps, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "digest", "n", "fp", "keys"])
        give_back()

    whole = scratch.put(df.select("id", "text").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, digest binary, n int, fp binary, keys array<long>"), "prints")
    nodes = whole.groupBy("digest").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = scratch.put(nodes.withColumn("uid", F.monotonically_increasing_id()), "nodes")
    prints = scratch.put(whole.select("id", "digest"), "digests")
    scratch.drop(whole)
    keys = nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m"))
    shared = scratch.put(keys.where("m > 1"), "shared")
    met = scratch.put(_met(scratch, nodes, shared, jaccard, radius), "met")
    links = _linked(scratch, df, nodes, met, shingle, jaccard, radius, seed, part_shingles)
    roots = components(scratch, links)
    named = scratch.put(nodes.join(roots, nodes.uid == roots.node, "left").select("digest", "first", F.coalesce("root", "uid").alias("root")), "named")
    scratch.drop(nodes, shared, met, links)
    return prints, named


def _with_digest(df: DataFrame, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``df`` with the digest of each text's shingle set, as the column ``_digest``."""

    def run(batches):
        for b in sub_batches(batches, text_col, 4 << 20):
            found = [_digest(shingle_set(t or "", shingle, seed)) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], [*b.schema.names, "_digest"])

    return df.mapInArrow(run, df.select("*", F.lit(b"").alias("_digest")).schema)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, jaccard: float = 0.8, words: int = 8, radius: int = 122, recall: float = 1 - 1e-6, seed: int = 42, null_ids: bool = False) -> DataFrame:
    """The rows of ``df``, all columns, that have the smallest id of their group of near copies (``near_copies``).

    A row is told by its id and its set of shingles: of rows with the same id and unlike texts each counts for itself,
    of rows equal in both one stays, whichever.  Rows without an id are compared like others with
    ``null_ids`` (one with an id stays before them); else they are no one's copy and stay.  Only rows
    to be dropped, and a few others, take part in a join; the rest stay where they are.
    """
    scratch = Scratch(df.sparkSession, "first")
    asked = df if null_ids else df.where(F.col(id_col).isNotNull())
    prints, named = near_copies(scratch, asked.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle, jaccard, words, radius, recall, seed)
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest")).alias("w"))
    best = named.join(chosen, "root").select("digest", F.col("w.first").alias("first"), F.col("w.digest").alias("best"))
    found = prints.groupBy("id", "digest").agg(F.count("*").alias("_n")).join(best, "digest")
    found = found.select(F.col("id").alias("_id"), F.col("digest").alias("_d"), (F.col("id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("best"))).alias("_stays"), "_n")
    others = scratch.put(found.where("not _stays or _n > 1").select("_id", "_d", "_stays"), "others")
    scratch.drop(prints, named)
    rows = mark(scratch, asked, F.col(id_col), others.select("_id"))
    stay = rows.where(~F.col("_hit")).select(*df.columns)
    if not null_ids:
        stay = stay.unionByName(df.where(F.col(id_col).isNull()))
    hit = _with_digest(rows.where("_hit").select(*df.columns), text_col, shingle, seed)
    hit = hit.join(others, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d")), "left")
    once = hit.where("_stays is null").select(*df.columns)
    first = hit.where("_stays").dropDuplicates(["_id", "_d"]).select(*df.columns)
    return stay.unionByName(once).unionByName(first)
