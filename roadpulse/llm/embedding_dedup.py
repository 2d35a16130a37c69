"""Embedding near-dedup (operator 2): inverted lists with residual product quantisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import Scratch, Shared, components, with_least


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` nearest of ``c`` for each of ``x``, nearest first."""
    out = []
    for at in range(0, len(x), 4096):
        d = (c * c).sum(1)[None, :] - 2 * (x[at : at + 4096] @ c.T)
        k = min(k, d.shape[1])
        top = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(k), (len(d), 1))
        out.append(np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


class Index:
    """Coarse centroids, and for each of ``parts`` subspaces of the residuals 2^8 code words at most."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, seed: int) -> None:
        self.coarse = kmeans(sample, lists, seed)
        rest = sample - self.coarse[nearest(sample, self.coarse, 1)[:, 0]]
        self.cuts = [a for a in np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))]
        self.books = [kmeans(rest[:, a], 256, seed + 1 + j, 6) for j, a in enumerate(self.cuts)]
        codes = self.encode(rest)
        #: Quantisation error that 99.9 % of the sample stay below.
        self.error = float(np.quantile(np.sqrt(((rest - self.decode(codes)) ** 2).sum(1)), 0.999))

    def encode(self, rest: np.ndarray) -> np.ndarray:
        return np.stack([nearest(rest[:, a], b, 1)[:, 0] for a, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances (query, member) by table lookup: a query's exact residual to code words."""
        d = np.zeros((len(rest), len(codes)), np.float32)
        for j, (a, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            x = rest[:, a]
            table = ((x * x).sum(1)[:, None] - 2 * (x @ b.T) + (b * b).sum(1)[None, :]).astype(np.float32)
            d += table[:, codes[:, j]]
        return d


def unit_vectors(batch: pa.RecordBatch, column: str) -> list[tuple[np.ndarray, np.ndarray]]:
    lists = batch.column(batch.schema.get_field_index(column))
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        m = flat[offsets[rows][:, None] + np.arange(n)]
        # By the largest component first, so that squares neither overflow nor vanish.
        m = m / np.abs(m).max(1, keepdims=True)
        out.append((rows, m / np.sqrt((m * m).sum(1, keepdims=True))))
    return out


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, sample_rows: int = 16_384, rows_per_list: int = 200, max_lists: int = 4096, parts: int = 8, probes: int = 16, chunk: int = 2048, seed: int = 42
) -> DataFrame:
    """Vectors with a cosine of at least ``cosine`` to another, and the groups that such links form.

    Equal vectors are one class, which is looked up once and counts as many times as it has rows.  A
    class lies in the inverted list of its nearest centroid, as subspace codes of its residual, and looks
    for partners in its ``probes`` nearest lists (its own first).  There, table-lookup distances
    plus the quantisation error that 99.9 % of the sample stay below leave few candidates, whose exact
    cosine in double precision decides.  Centroids and code words are fitted on at most ``sample_rows``
    classes; every row is indexed.  No candidate is cut off: lists are compared in blocks of ``chunk``
    members by ``chunk`` probing classes, so a long list becomes many tasks and no pair leaves one.
    A block reports the number of links of each class and a spanning forest of them.

    Returns ``id_col``, n_links (other rows linked directly), component_id (smallest id reachable, itself
    included), kept (the id is its component's).  Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null id, link with nothing (component_id: their own id; kept: true,
    null for a null id).  Vectors of different lengths never link.  Rows that repeat an id are separate
    rows for n_links.  Other columns are not carried; no rows give no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup")
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    ok = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    base = base.withColumn("x", F.when(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)), F.transform("x", lambda c: c + F.lit(0.0))))
    # The class of a row: a hash of its vector's exact text, then its smallest id.
    rows = scratch.put(base.withColumn("key", F.when(F.col("x").isNotNull(), F.sha2(F.to_json("x"), 256))), "rows")
    classes = scratch.put(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("weight"), F.any_value("x").alias("x")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    links, edges = [], []
    lengths = [r[0] for r in classes.select(F.size("x")).distinct().collect()] if n else []
    for dim in sorted(lengths):
        own = classes.where(F.size("x") == dim) if len(lengths) > 1 else classes
        m = n if len(lengths) == 1 else own.count()
        sample = own.orderBy(F.xxhash64("key", F.lit(seed))).limit(sample_rows).select("x").toPandas()["x"]
        x = np.stack(sample.to_list()).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        index = Index(x, max(1, min(max_lists, len(x), -(-m // rows_per_list))), parts, seed)
        found = _probe(spark, Shared(spark, index), own, cosine, probes, chunk, scratch)
        links.append(found.where("b is null").select("a", "n"))
        edges.append(found.where("b is not null").select("a", "b"))
    empty = spark.createDataFrame([], "a long, n long, b long")
    count, forest = empty.select("a", "n"), empty.select("a", "b")
    for x, y in zip(links, edges, strict=True):
        count, forest = count.unionByName(x), forest.unionByName(y)
    # Classes of several rows have links among themselves even without another class.
    roots = components(scratch, forest)
    state = classes.select("cls", "key", "first", "weight").join(count.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n")), "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    state = scratch.put(state.select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"), "first"), "state")
    state = with_least(scratch, state, "root", "first", "component_id").select("key", "n_links", "component_id")
    kind = df.schema[id_col].dataType.simpleString()
    out = rows.select("id", "key").join(state, "key", "left")
    out = out.select(F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def _probe(spark, index, classes: DataFrame, cosine: float, probes: int, chunk: int, scratch: Scratch) -> DataFrame:
    """(a, null, n): links of class a to rows of other classes, to be summed; (a, b, null): links of a forest."""

    def assign(batches):
        for b in batches:
            for rows, u in unit_vectors(b, "x"):
                lists = nearest(u, index.value.coarse, probes)
                rest = u - index.value.coarse[lists[:, 0]]
                codes = index.value.encode(rest)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), u.shape[1]).cast(pa.list_(pa.float64())), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32()))],
                    ["cls", "weight", "u", "codes", "lists"],
                )

    placed = scratch.put(classes.select("cls", "weight", "x").mapInArrow(assign, "cls long, weight long, u array<double>, codes binary, lists array<int>"), "placed")
    spread = F.pmod(F.xxhash64("cls"), F.lit(1 << 20))
    members = placed.withColumn("list", F.col("lists")[0])
    askers = placed.withColumn("list", F.explode("lists"))
    sizes = askers.groupBy("list").agg(F.count("*").alias("asking"), F.count(F.when(F.col("list") == F.col("lists")[0], 1)).alias("held"))
    # One row for each list: at most as many as there are centroids.
    blocks = F.broadcast(scratch.put(sizes.select("list", F.ceil(F.col("held") / chunk).cast("int").alias("ms"), F.ceil(F.col("asking") / chunk).cast("int").alias("ps")).where("ms > 0"), "blocks"))
    m = members.join(blocks, "list").withColumn("m", F.pmod(spread, F.col("ms")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)))
    p = askers.join(blocks, "list").withColumn("p", F.pmod(spread, F.col("ps")).cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)))
    both = m.withColumn("member", F.lit(True)).unionByName(p.withColumn("member", F.lit(False))).drop("ms", "ps")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        member = table["member"].to_numpy()
        cls, weight = table["cls"].to_numpy(), table["weight"].to_numpy()
        u = table["u"].combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(cls), -1)
        lists = table["lists"].combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
        mi, pi = np.flatnonzero(member), np.flatnonzero(~member)
        center = index.value.coarse[key[0].as_py()]
        limit = (np.sqrt(2 - 2 * cosine) + index.value.error + 1e-6) ** 2
        names, at = np.unique(cls, return_inverse=True)
        label, links = np.arange(len(names)), np.zeros(len(cls))
        for s in range(0, len(pi), 256):
            q = pi[s : s + 256]
            near = (index.value.distances(u[q] - center, codes[mi]) <= limit) & (cls[q][:, None] != cls[mi][None, :])
            some = np.flatnonzero(near.any(0))
            if not len(some):
                continue
            a, b = np.nonzero(near[:, some] & (u[q] @ u[mi[some]].T >= cosine))
            x, y = q[a], mi[some[b]]
            links += np.bincount(x, weight[y], len(cls))
            # The member counts the link here only if it does not look into the asker's own list itself.
            one_way = ~(lists[y] == lists[x, 0][:, None]).any(1)
            links += np.bincount(y[one_way], weight[x[one_way]], len(cls))
            x, y = at[x], at[y]
            while (label[x] != label[y]).any():  # both ends take the smaller label
                least = np.minimum(label[x], label[y])
                np.minimum.at(label, label[x], least)
                np.minimum.at(label, label[y], least)
                label = label[label]
        some, moved = np.flatnonzero(links), np.flatnonzero(names[label] != names)
        none = lambda k: pa.nulls(k, pa.int64())
        whole = lambda v: pa.array(v.astype(np.int64))
        counts = pa.table([whole(cls[some]), none(len(some)), whole(np.rint(links[some]))], ["a", "b", "n"])
        return pa.concat_tables([counts, pa.table([whole(names[moved]), whole(names[label[moved]]), none(len(moved))], ["a", "b", "n"])])

    return scratch.put(both.select("list", "m", "p", "member", "cls", "weight", "u", "codes", "lists").groupBy("list", "m", "p").applyInArrow(compare, "a long, b long, n long"), "found")
