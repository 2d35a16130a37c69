"""Exact top-k search (operator 1): distributed histogram selection over integer scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadpulse.llm.common import Scratch, Shared

LONG = (1 << 63) - 1


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component, x as double.  Rows whose id or vector is null, or
    whose vector holds a null or non-finite component, are left out; a floor beyond +-2^62 is an error."""
    x = F.col("x")
    ok = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(c * F.lit(float(scale)))
    v = F.transform("x", lambda c: F.when(F.abs(c * F.lit(float(scale))) <= F.lit(float(1 << 62)), whole(c)).otherwise(F.raise_error(F.lit("a component times the scale is beyond 2^62")).cast("long")))
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return base.where(F.col("id").isNotNull() & x.isNotNull() & ok).select("id", v.alias("v"))


def matrices(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) for each length of vector in the batch, at most 1,024 rows each."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    offsets = lists.offsets.to_numpy()
    flat, lengths = lists.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    out = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for part in np.array_split(rows, -(-len(rows) // 1024)):
            out.append((ids[part], flat[offsets[part][:, None] + np.arange(n)] if n else np.zeros((len(part), 0), np.int64)))
    return out


class Block:
    """A block of queries, by length of vector, that scores candidates exactly."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]) -> None:
        self.ids, self.by_length = ids, {}
        for n in {len(v) for v in vectors}:
            rows = np.array([k for k, v in enumerate(vectors) if len(v) == n])
            m = np.array([vectors[k] for k in rows], np.int64).reshape(len(rows), n)
            self.by_length[n] = (rows, m, int(np.abs(m).max(initial=0)))

    def score(self, ids: np.ndarray, m: np.ndarray):
        """(rows of queries, scores (query, candidate), whether the pair counts).

        By candidate: in doubles where no sum can reach 2^53, in longs where none can reach 2^63, else in Python's
        integers, where a counted score beyond a long raises OverflowError.
        """
        if m.shape[1] not in self.by_length:
            return None
        rows, own, most = self.by_length[m.shape[1]]
        counted = self.ids[rows][:, None] != ids[None, :]
        bound = [most * x * m.shape[1] for x in np.abs(m).max(1, initial=0).tolist()]
        if max(bound, default=0) < 1 << 53:
            return rows, np.rint(own.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64), counted
        scores = np.zeros(counted.shape, np.int64)
        small = np.array([x < 1 << 63 for x in bound])
        scores[:, small] = own @ m[small].T
        for c in np.flatnonzero(~small).tolist():
            exact = np.where(counted[:, c], own.astype(object) @ m[c].astype(object), 0)
            if len(exact) and not -LONG <= min(exact) <= max(exact) <= LONG:
                raise OverflowError("an inner product is beyond a long")
            scores[:, c] = exact.astype(np.int64)
        return rows, scores, counted


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, bits: int = 8, at_once: int = 4) -> DataFrame:
    """The ``k`` candidates of highest integer inner product for each query, exactly.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with another id (and
    a vector of the same length; other lengths don't compare).  Queries are taken in blocks of some
    ``block`` rows, which is what is broadcast; ``at_once`` blocks share the jobs of a pass.  Candidates are scored
    where they lie, with matrix products, and are never shuffled:

    1. Every query has a range of scores that holds its kth highest.  A pass counts scores in 2^``bits``
       buckets of that range; a task reports buckets from the top until it has seen k scores, as the kth
       of all can't lie below.  The bucket with the kth score is the next range, until its width is 1.
    2. A last pass keeps scores above the kth, and those equal to it with the k smallest ids of a
       task.  Of these few rows ``row_number`` takes the first k, ties to the smaller id.

    Returns query_id, rank (from 1), ``id_col``, score; fewer than k rows where there are fewer
    candidates, none for empty tables.  Null ids or vectors, and vectors with null or non-finite
    components take no part; a component beyond +-2^62 / ``scale`` and a score beyond a long are errors.  Rows that
    repeat an id are candidates of their own; as queries the smallest of their vectors stands for them.  Other
    columns are not carried.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = scratch.put(integer_vectors(df, id_col, vector_col, scale), "vectors")
    queries = vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n = queries.count()
    dims = vectors.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    bound = min(LONG, int(dims[0] or 0) * int(dims[1] or 0) ** 2)
    blocks = max(1, -(-n // block))
    dealt = scratch.put(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "queries")
    found = []
    for b in range(0, blocks if n else 0, at_once):
        part = dealt.where(F.col("block").between(b, b + at_once - 1)).toArrow()
        search = [_Search(spark, p, k, bound, bits) for p in query_blocks(part, block)]
        while any(s.width for s in search):
            counts = None
            for j, s in enumerate(search):
                mine = vectors.mapInArrow(_histogram(s.block, s.ranges(), s.width, s.shift), "q int, bucket int, n long").withColumn("block", F.lit(j))
                counts = mine if counts is None else counts.unionByName(mine)
            counts = counts.groupBy("block", "q", "bucket").agg(F.sum("n").alias("n")).toArrow()
            of, q, bucket, m = (counts[c].to_numpy() for c in ("block", "q", "bucket", "n"))
            for j, s in enumerate(search):
                s.refine(q[of == j], bucket[of == j], m[of == j])
        rows = None
        for s in search:
            mine = vectors.mapInArrow(_select(s.block, s.last()), "query_id long, id long, score long")
            rows = mine if rows is None else rows.unionByName(mine)
        first = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
        rows = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        found.append(scratch.path("top"))
        rows.select("query_id", "rank", "id", "score").write.parquet(found[-1])
    kind = df.schema[id_col].dataType.simpleString()
    shape = "query_id long, rank int, id long, score long"
    out = spark.read.schema(shape).parquet(*found) if found else spark.createDataFrame([], shape)
    return out.select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("id").cast(kind).alias(id_col), "score")


def query_blocks(part: pa.Table, block: int) -> list[list]:
    """Queries (id, vector) by block; a block that the hash made much larger is cut."""
    of, ids, lists = part["block"].to_numpy(), part["id"].to_numpy(), part["v"].combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    out = []
    for b in np.unique(of).tolist():
        rows = np.flatnonzero(of == b)
        for own in np.array_split(rows, -(-len(rows) // (2 * block))):
            out.append([(int(ids[r]), flat[offsets[r] : offsets[r + 1]]) for r in own.tolist()])
    return out


class _Search:
    """The ranges of a block's queries: low <= score < low + 2^width holds the kth highest score."""

    def __init__(self, spark, queries: list, k: int, bound: int, bits: int) -> None:
        self.sc, self.k, self.bits = spark.sparkContext, k, bits
        ids = np.array([i for i, _ in queries], np.int64)
        self.block = Shared(spark, Block(ids, [v for _, v in queries]))
        self.least = -bound - 1
        self.low = np.full(len(ids), -bound, np.int64)
        self.width = max(1, (2 * bound + 1).bit_length())
        self.need = np.full(len(ids), k, np.int64)  # which of the scores in the range is the kth of all
        self.short = None  # queries with fewer than k candidates

    @property
    def shift(self) -> int:
        return max(0, self.width - self.bits)

    def ranges(self):
        return self.sc.broadcast((self.low, self.need))

    def last(self):
        return self.sc.broadcast((np.where(self.short, self.least, self.low), self.k))

    def refine(self, q: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> None:
        counts = np.zeros((len(self.low), 1 << (self.width - self.shift)), np.int64)
        counts[q, bucket] = n
        above = np.cumsum(counts[:, ::-1], axis=1)  # from the highest bucket down
        hit = above >= self.need[:, None]
        if self.short is None:
            self.short = ~hit.any(1)
        at = hit.argmax(1)
        self.need = self.need - np.where(at > 0, above[np.arange(len(at)), at - 1], 0)
        step = (counts.shape[1] - 1 - at).astype(np.uint64) << np.uint64(self.shift)
        self.low = (self.low.view(np.uint64) + step).view(np.int64)  # of no use for short queries
        self.width = self.shift


def _histogram(block, ranges, width: int, shift: int):
    def run(batches):
        low, need = ranges.value
        counts = np.zeros((len(low), 1 << (width - shift)), np.int64)
        for b in batches:
            for ids, m in matrices(b):
                if (got := block.value.score(ids, m)) is None:
                    continue
                rows, scores, counted = got
                counted &= scores >= low[rows][:, None]
                far = scores.view(np.uint64) - low[rows].view(np.uint64)[:, None]  # up to 2^64 - 1
                if width < 64:
                    counted &= far < np.uint64(1 << width)
                cell = (far >> np.uint64(shift)).astype(np.int64) + (np.arange(len(rows)) * counts.shape[1])[:, None]
                counts[rows] += np.bincount(cell[counted], minlength=len(rows) * counts.shape[1]).reshape(len(rows), -1)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # in higher buckets of this task
        q, bucket = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[q, bucket], pa.int64())], ["q", "bucket", "n"])

    return run


def _select(block, last):
    def run(batches):
        low, k = last.value
        best = [np.zeros(0, np.int64)] * 3
        for b in batches:
            for ids, m in matrices(b):
                if (got := block.value.score(ids, m)) is None:
                    continue
                rows, scores, counted = got
                q, c = np.nonzero(counted & (scores >= low[rows][:, None]))
                # As many as k of each query stay: the highest scores, then the smallest ids.
                best = [np.concatenate(x) for x in zip(best, (rows[q], ids[c].astype(np.int64), scores[q, c]), strict=True)]
                order = np.lexsort((best[1], -best[2], best[0]))
                best = [x[order] for x in best]
                start = np.searchsorted(best[0], best[0])
                best = [x[np.arange(len(start)) - start < k] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(block.value.ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "id", "score"])

    return run
