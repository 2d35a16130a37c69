"""Shared pieces of the operators: scratch tables, byte-bounded batches, connected components."""

from __future__ import annotations

import atexit
import ctypes
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import roadpulse

#: Functions travel to the workers with their code, so executors need no copy of this repository.
cloudpickle.register_pickle_by_value(roadpulse)


class Shared:
    """An object for all tasks: its attributes (arrays and plain containers) are broadcast, its class travels with
    the function that uses it, so that workers need no module of this package."""

    def __init__(self, spark: SparkSession, held) -> None:
        self.kind, self.state = type(held), spark.sparkContext.broadcast(vars(held))

    @property
    def value(self):
        out = object.__new__(self.kind)
        out.__dict__.update(self.state.value)
        return out


#: Scratch folders of this process that are not yet deleted.
OPEN: list[Scratch] = []


class Scratch:
    """Tables in the folder that the cluster shares (``spark.checkpoint.dir``).

    Reading such a table cuts the lineage: a lost executor costs only the tasks that it ran, and no
    stage is computed twice.  Only a local master may leave the setting out; /tmp/checkpoints serves there.
    An operator's result reads its folder, so the folder goes when the result is written: by ``close_scratch``, else
    at the end of the process.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        self.spark, self.root, self.n = spark, f"{(base or '/tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        OPEN.append(self)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def close(self) -> None:
        self._delete(self.root)
        OPEN.remove(self)


@atexit.register
def close_scratch(since: int = 0) -> None:
    """Delete the folders of operators whose results are written: those opened after the first ``since``."""
    for s in OPEN[since:]:
        try:
            s.close()
        except Py4JError:  # the session is gone, and its gateway with it
            OPEN.remove(s)


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's rows, through Arrow.  Lists given to createDataFrame are read by Python workers of another
    kind than those of mapInArrow; executors would keep a second daemon and its idle workers."""
    shape = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(shape)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape), schema)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose ``column`` holds about ``max_bytes`` at most (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        rows = max(1, int(b.num_rows * max_bytes / max(1, b.column(column).nbytes)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Return the worker's freed memory to the system at the end of a task with large buffers; else idle workers, which
    Spark keeps for later tasks, hold the most that they ever needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def bitmap_words(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """(word, bit): a bitmap with a place for each value modulo ``bits``, as at most bits / 64 words."""
    slot = F.pmod(F.col(column), F.lit(bits))
    return hashes.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))


def mark(scratch: Scratch, df: DataFrame, key: Column, keys: DataFrame, least: int = 16, most: int = 25) -> DataFrame:
    """``df`` with a column ``_hit``: true wherever ``key`` is in ``keys`` (one column), rarely elsewhere.

    Rows that are not hit need no join, so long texts stay where they are.  What is broadcast is a bitmap of some
    eight places for each key, 2^``most`` at most (2^19 rows); with more keys than that bears, more rows are hit.
    """
    bits = 1 << min(most, max(least, (8 * keys.count()).bit_length()))
    words = scratch.put(bitmap_words(keys.select(F.xxhash64(keys.columns[0]).alias("_k")), "_k", bits).select(F.col("word").alias("_word"), F.col("bit").alias("_bit")), "bitmap")
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    bit = F.call_function("shiftright", F.coalesce("_bit", F.lit(0).cast("long")), F.pmod(slot, F.lit(64)).cast("int")).bitwiseAND(F.lit(1))
    out = df.withColumn("_word", F.shiftright(slot, 6)).join(F.broadcast(words), "_word", "left")
    return out.withColumn("_hit", bit == 1).drop("_word", "_bit")


def with_least(scratch: Scratch, df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """``df`` with the least ``value`` of each ``by`` as ``name``.

    The minimum is combined map-side and written first, so that the join is one of two plain tables: AQE splits a
    ``by`` that very many rows share.
    """
    low = scratch.put(df.groupBy(by).agg(F.min(value).alias(name)), name)
    return df.join(low, by)


def components(scratch: Scratch, edges: DataFrame, kind: str = "long") -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) for each node of an edge, root
    being the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes.  A step takes the least neighbour of each
    node, combined map-side, and joins it back (``with_least``), so a hub's edges are split over tasks.
    No edge is held longer than two steps.  Edges with equal or null ends count for nothing;
    no edges give an empty table.
    """
    e = edges.select(F.col("a").cast(kind), F.col("b").cast(kind)).where("a <> b")
    e = scratch.put(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # Large star: every larger neighbour of a node goes to the node's smallest one.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = with_least(scratch, both, "a", "b", "m").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = scratch.put(low.where("a <> b").distinct(), "large")
        # Small star: a node and its smaller neighbours go to the smallest of these.
        small = with_least(scratch, large, "a", "b", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        new = scratch.put(small.where("a <> b").distinct(), "star")
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(e, large)
        e = new
        if tuple(sign) == before:
            break
        before = tuple(sign)
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
