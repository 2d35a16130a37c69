"""Mixing sources to target weights (operator 5): cube-method balanced sampling."""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import Scratch, mark, small

WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9
MASK = (1 << 64) - 1


def targets(sizes: dict, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Target of each source: ``share`` of all sizes by weight (sources in code-point order, None last,
    take the weights in turn), at most ``most`` times its size; the excess is shared out again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        each = left / sum(weight[s] for s in free)
        full = [s for s in free if each * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: each * weight[s] for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


class Flight:
    """The cube method's flight over a stream of (size, fraction, row): three open rows at a time move
    through the null space of the two balancing constraints, the sums of fractions and of fraction
    times size, until one of them reaches 0 or 1.  At most two rows stay open."""

    def __init__(self, seed: int) -> None:
        self.state, self.open = seed & MASK, []

    def random(self) -> float:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & MASK
        return ((z ^ z >> 31) >> 11) / (1 << 53)

    def add(self, size: int, fraction: float, row) -> list[tuple]:
        """Rows decided by this one: (row, 0 or 1)."""
        if not EPS < fraction < 1 - EPS:
            return [(row, round(fraction))]
        self.open.append([size, fraction, row])
        if len(self.open) < 3:
            return []
        (a, p, _), (b, q, _), (c, r, _) = self.open
        u = (b - c, c - a, a - b)
        if not any(u):
            u = (1, -1, 0)
        at = (p, q, r)
        ahead = min(((1 - x) if d > 0 else x) / abs(d) for x, d in zip(at, u, strict=True) if d)
        back = min((x if d > 0 else (1 - x)) / abs(d) for x, d in zip(at, u, strict=True) if d)
        step = ahead if self.random() * (ahead + back) < back else -back
        done, still = [], []
        for item, d in zip(self.open, u, strict=True):
            item[1] += step * d
            if EPS < item[1] < 1 - EPS:
                still.append(item)
            else:
                done.append((item[2], round(item[1])))
        self.open = still
        return done

    def land(self) -> list[tuple]:
        """The landing problem: of all roundings of the open rows, the one whose size, then count, is nearest."""
        if not self.open:
            return []
        size, count = sum(x[0] * x[1] for x in self.open), sum(x[1] for x in self.open)
        best = min(product((0, 1), repeat=len(self.open)), key=lambda z: (abs(sum(x[0] * k for x, k in zip(self.open, z, strict=True)) - size), abs(sum(z) - count), z))
        return [(x[2], k) for x, k in zip(self.open, best, strict=True)]


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, chunk_rows: int = 4096, most_sources: int = 1_000_000, seed: int = 42) -> DataFrame:
    """How much of each document a mix of the sources takes.

    Size: words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0).  A source's target over its size is the
    expected number of copies r of each of its documents: floor(r) are certain, the fraction is
    decided by balanced sampling on documents and words, so a source's words miss its target by less
    than about one document.

    Each source is cut into chunks of about ``chunk_rows`` documents by a hash of id and text; each chunk's flight
    leaves at most two documents open, which meet in the next flight, and the source lands in the flight in
    which it is one chunk, whatever the other sources need.  The decisions depend on the rows and
    ``seed`` only, so reruns agree.

    Returns ``id_col``, size, source_size, target, taken, copies, source.  ``source_size``/``target``
    are its source's.  Rows may repeat; null ids and sources are values like others; documents of size
    0 take 0 words and floor(r) copies; other columns are not carried; no rows give no rows.  The driver holds one
    number for each source (over ``most_sources`` raise ValueError).
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = scratch.put(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("hash")), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError("too many sources")
    goal = targets({r.source: r["size"] for r in found}, weights, share, most)
    kind, skind = df.schema[id_col].dataType.simpleString(), df.schema[source_col].dataType.simpleString()
    table = small(spark, [(r.source, r["size"], float(goal[r.source]), r.n) for r in found], f"s {skind}, source_size long, target double, m long")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.join(F.broadcast(table), rows.source.eqNullSafe(table.s)).drop("s").withColumn("ratio", F.least(ratio, F.lit(float(most))))
    base = F.floor(F.col("ratio") + EPS)
    state = rows.withColumn("base", base.cast("int")).withColumn("fraction", F.greatest(F.col("ratio") - base, F.lit(0.0))).drop("ratio").withColumn("decided", F.when((F.col("fraction") < EPS) | (F.col("size") == 0), F.lit(0)))
    schema = f"id {kind}, source {skind}, size long, source_size long, target double, base int, fraction double, hash long, decided int"
    columns = ["id", "source", "size", "source_size", "target", "base", "fraction", "hash", "decided"]
    done = [state.where("decided is not null").select(*columns)]
    state, level = state.where("decided is null"), 0
    while True:
        chunks = F.ceil(F.col("m") / max(4, chunk_rows))
        state = state.withColumn("chunk", F.pmod(F.xxhash64("hash", F.lit(level)), chunks).cast("int")).select(*columns, "chunk", (chunks == 1).alias("last"))
        state = state.repartition("source", "chunk").sortWithinPartitions("source", "chunk", "hash", "id", "size")
        flown = scratch.put(state.mapInArrow(_fly(seed + level), schema), f"flight{level}")
        done.append(flown.where("decided is not null"))
        state, level = flown.where("decided is null"), level + 1
        open_rows = scratch.put(state.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("m")), "open")  # of sources of several chunks only
        if open_rows.isEmpty():
            break
        state = state.join(F.broadcast(open_rows), state.source.eqNullSafe(open_rows.s))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = F.col("base") + F.col("decided")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), F.col("source").alias(source_col))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``df``, all columns, each as often as ``mix`` takes it: 0, 1 or 2 times.

    A row's key is a hash of 128 bits over all its columns, so rows without an id or with the same one are told
    apart; of equal rows any stand for all.  Rows that are taken as often as most of their source stay where they are;
    the others (``mark``) are joined with the decisions by key.  The key's name is ``_key``, the columns ``_usual``,
    ``_taken`` and ``_rows`` are used as well; ``df`` has none of these names.
    """
    scratch = Scratch(df.sparkSession, "mixed")
    half = lambda k: F.hex(F.xxhash64(F.lit(k), *(F.col(f"`{c}`") for c in df.columns)))
    keyed = df.withColumn("_key", F.concat_ws("-", half(1), half(2)))
    taken = mix(keyed, "_key", text_col, source_col, **how).select("_key", F.col(source_col).alias("_source"), "copies")
    taken = scratch.put(taken.groupBy("_key", "_source").agg(F.sum("copies").cast("int").alias("_taken"), F.count("*").alias("_rows")), "taken")
    usual = taken.where("_rows = 1").groupBy("_source", "_taken").agg(F.count("*").alias("n")).groupBy("_source").agg(F.max(F.struct("n", "_taken")).alias("w"))
    usual = F.broadcast(scratch.put(usual.select("_source", F.col("w._taken").alias("_usual")), "usual"))  # a row for each source
    other = taken.join(usual.withColumnRenamed("_source", "s"), F.col("_source").eqNullSafe(F.col("s")), "left").where("_rows > 1 or not (_taken <=> _usual)")
    other = scratch.put(other.select("_key", "_taken", "_rows"), "other")
    rows = keyed.join(usual, F.col(source_col).eqNullSafe(F.col("_source")), "left").drop("_source")
    rows = mark(scratch, rows, F.col("_key"), other.select("_key"))
    hit = rows.where("_hit").join(other.where("_rows = 1"), "_key", "left").join(other.where("_rows > 1").select("_key"), "_key", "left_anti")
    parts = [rows.where("not _hit").withColumn("_n", F.col("_usual")), hit.withColumn("_n", F.coalesce("_taken", "_usual"))]
    if not other.where("_rows > 1").isEmpty():
        again = rows.where("_hit").join(other.where("_rows > 1"), "_key").dropDuplicates(["_key"])
        parts.append(again.withColumn("_n", F.col("_taken")))
    out = None
    for x in parts:
        x = x.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_n"))).select(*df.columns)
        out = x if out is None else out.unionByName(x)
    return out


def _fly(seed: int):
    def run(batches):
        key, flight, at, landing = object(), None, 0, False

        def close():
            if flight is None:
                return []
            return flight.land() if landing else [((*x[2][:6], x[1], x[2][7]), None) for x in flight.open]

        schema = None
        for b in batches:
            schema = pa.schema([f for f in b.schema if f.name not in ("chunk", "last")])
            out = []
            for *row, chunk, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (row[1], chunk) != key:
                    out += close()
                    key, landing = (row[1], chunk), last
                    at = sum(ord(c) * 31**i for i, c in enumerate(str(row[1])[:50])) if row[1] is not None else 7
                    flight = Flight(seed * 1_000_003 + at * 7919 + chunk)
                out += flight.add(row[2], row[6], tuple(row))
            yield _rows(out, schema)
        if schema is not None:
            yield _rows(close(), schema)

    return run


def _rows(decided: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*((*row[:8], k) for row, k in decided), strict=True)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
