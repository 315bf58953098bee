"""Operator 4: approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-rotation - three rounds of random signs and a fast Hadamard transform -
and belongs to the nearest of the signed axes. `parts` such hashes make a bucket, and several tables of
buckets with rotations of their own make the index. A query looks into the buckets of its likeliest axes in
each table (multiprobe); what it finds there is ranked by cosine. Cosines are computed in extended precision and
rounded to double, pair by pair, so a pair has one score wherever it meets, and equal cosines are ties.

Fitting chooses parts, tables and probes for each length of vectors: of the settings that find at least `recall` of the
true neighbours within a sample of bounded bytes, the one of least cost, by copies of a query that are shipped and
vectors that it is compared with. Lengths of at most `few` vectors are searched whole, which only improves answers.
Every vector is indexed.

Scale. Vectors of exactly one direction are one class that keeps its `top` + 1 smallest ids, which is all that any
query can be told of them. Index and probes are packed into blocks of a bucket of at most BLOCK rows; pairs of blocks
are compared as matrices, and what may be among the best of a block but for rounding is scored. Each pair of blocks
passes on the first `top` + SPARE classes per query by (score, smallest id). That is the final order, and all but the
query's own class have an answer, so what is left out cannot be one. A crowded bucket is several blocks, so no task
holds a bucket whole.

Rows: vectors that are NULL, empty or zero, or hold NULL or non-finite components, and vectors of NULL id
take no part. Vectors are compared with those of their own length only. A repeated row of one id and vector is
one row. Queries with fewer candidates than `top` get those there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.llm.common import stored

BLOCK = 512
SAMPLE_BYTES = 8_000_000
SAMPLE_ROWS = 8_000
SAMPLE_QUERIES = 100
FEW = 200
SPARE = 3
#: More than what matrix products of unit vectors are off by, and pairs scored together.
MARGIN = 1e-10
PAIRS = 4096
#: Shipping a component to a bucket costs about as much as this many products of components.
SHIPPING = 100
#: (parts, tables, probes); the last looks at all vectors.
SETTINGS = [(2, 16, 16), (2, 16, 64), (2, 16, 256), *((1, 8, p) for p in (4, 6, 8, 12, 16, 24, 32, 48, 64, 96)), (1, 1, 1 << 30)]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


class Index:
    def __init__(self, dim: int, parts: int, tables: int, probes: int, seed: int = 11):
        self.dim, self.parts, self.tables = dim, parts, tables
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.probes = min(probes, (2 * self.width) ** parts)
        self.signs = np.random.Generator(np.random.PCG64([seed, dim])).choice([-1.0, 1.0], (tables, parts, 3, self.width))

    def axes(self, x: np.ndarray, table: int) -> np.ndarray:
        """How near each row is to each signed axis: rows, parts, 2 * width (positive axes first)."""
        padded = np.zeros((len(x), self.width))
        padded[:, : self.dim] = x
        out = []
        for part in range(self.parts):
            y = padded
            for signs in self.signs[table, part]:
                y = hadamard(y * signs)
            out.append(np.concatenate([y, -y], axis=1))
        return np.stack(out, axis=1)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        best = self.axes(x, table).argmax(axis=2)
        return self._number(best)

    def _number(self, axes: np.ndarray) -> np.ndarray:
        out = np.zeros(axes.shape[:-1], np.int64)
        for part in range(self.parts):
            out = out * (2 * self.width) + axes[..., part]
        return out

    def probed(self, x: np.ndarray, table: int) -> np.ndarray:
        """Buckets in order of the summed nearness of their axes: rows, probes."""
        near = self.axes(x, table)
        if self.parts == 1:
            return np.argsort(-near[:, 0], axis=1, kind="stable")[:, : self.probes]
        keep = min(2 * self.width, max(2, int(np.ceil(self.probes ** (1 / self.parts))) * 2))
        axes = np.argsort(-near, axis=2, kind="stable")[:, :, :keep]
        value = np.take_along_axis(near, axes, axis=2)
        total, chosen = value[:, 0], axes[:, 0, :, None]
        for part in range(1, self.parts):
            sums = (total[:, :, None] + value[:, part, None, :]).reshape(len(x), -1)
            order = np.argsort(-sums, axis=1, kind="stable")[:, : self.probes]
            before, own = order // keep, order % keep
            total = np.take_along_axis(sums, order, axis=1)
            chosen = np.concatenate([np.take_along_axis(chosen, before[:, :, None], axis=1), np.take_along_axis(axes[:, part], own, axis=1)[:, :, None]], axis=2)
        return self._number(chosen)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(rows: DataFrame) -> DataFrame:
    """(id, vec) with each vector replaced by the one that stands for its direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            lengths = np.diff(ends)
            out = raw.copy()
            for dim in np.unique(lengths):
                at = ends[:-1][lengths == dim][:, None] + np.arange(dim)
                out[at] = direction(raw[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(batch.column(1).offsets, pa.array(out))], ["id", "vec"])

    return rows.mapInArrow(run, "id bigint, vec array<double>")


def direction(x: np.ndarray) -> np.ndarray:
    """Each row without what all its components have in common: they are odd numbers times powers of two, and lose
    the greatest common divisor and a power of two. Exact but for components below 1e-300 of the largest."""
    fraction, exponent = np.frexp(x)
    whole = np.ldexp(fraction, 53).astype(np.int64)
    zeros = np.where(whole == 0, 1, whole & -whole)
    odd = whole // zeros
    odd //= np.gcd.reduce(odd, axis=1)[:, None]
    # The exponent of an odd number of its own size, less that of the largest component.
    exponent = exponent - 53 + np.round(np.log2(zeros)).astype(np.int64)
    size = np.where(odd == 0, -(1 << 20), exponent + np.frexp(odd.astype(float))[1])
    return np.ldexp(odd.astype(float), np.maximum(exponent - size.max(axis=1, keepdims=True), -2000).astype(np.int32)) + 0.0


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a and its row of b."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    dot = (a * b).sum(axis=1)
    return (dot / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))).astype(np.float64) + 0.0


def fitted(vectors: DataFrame, top: int, recall: float, few: int = FEW) -> dict[int, tuple[int, int, int]]:
    """The setting of each length of more than `few` vectors, from a sample of its own (the smallest hashes)."""
    size = F.size("vec").alias("size")
    settings = {}
    for dim, count in [tuple(r) for r in vectors.groupBy(size).count().where(F.col("count") > few).collect()]:
        rows = max(few, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
        sample = vectors.where(size == dim).orderBy(F.xxhash64("vec"), "vec").limit(rows).select("vec").collect()
        settings[dim] = cheapest(unit(np.array([r["vec"] for r in sample])), top, recall, count)
    return settings


def cheapest(x: np.ndarray, top: int, recall: float, count: int | None = None) -> tuple[int, int, int]:
    """The setting of least cost for `count` rows of one length that reaches the recall among a sample x of them."""
    queries, count = x[:SAMPLE_QUERIES], count or len(x)
    scores = queries @ x.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    true = np.argsort(-scores, axis=1)[:, : min(top, len(x) - 1)]
    best, least = SETTINGS[-1], np.inf
    if not true.size:
        return best
    for setting in SETTINGS:
        index = Index(x.shape[1], *setting)
        found, looked = np.zeros(true.shape, bool), 0.0
        for table in range(index.tables):
            own = index.buckets(x, table)
            probed = index.probed(queries, table)
            found |= (own[true][:, :, None] == probed[:, None, :]).any(axis=2)
            buckets, sizes = np.unique(own, return_counts=True)
            at = np.minimum(np.searchsorted(buckets, probed), len(buckets) - 1)
            looked += np.where(buckets[at] == probed, sizes[at], 0).sum() / probed.shape[0] / len(x)
        # Probes are of a query, the index of a row: each is shipped once a table and probe, and once a table.
        cost = SHIPPING * index.tables * (index.probes + 1) + looked * count
        if found.mean() >= recall and cost < least:
            best, least = setting, cost
    return best


def _valid(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def hashed(rows: DataFrame, settings: dict[int, tuple[int, int, int]], probing: bool) -> DataFrame:
    """(part, bucket, id, least, vec): the buckets of vectors, or those that queries probe. part: length and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Index] = {}
        for batch in batches:
            ids, least, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            raw, ends = vectors.values.to_numpy(), vectors.offsets.to_numpy()
            lengths = np.diff(ends)
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                x = raw[ends[own][:, None] + np.arange(dim)]
                index = made.setdefault(int(dim), Index(int(dim), *settings.get(int(dim), SETTINGS[-1])))
                for table in range(index.tables):
                    for k in range(0, len(own), 256):
                        part = x[k : k + 256]
                        buckets = index.probed(unit(part), table) if probing else index.buckets(unit(part), table)[:, None]
                        at = np.repeat(own[k : k + 256], buckets.shape[1])
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, dim * 4096 + table, np.int32)), pa.array(buckets.ravel()), pa.array(ids[at]), pa.array(least[at]), vectors.take(pa.array(at))],
                            ["part", "bucket", "id", "least", "vec"],
                        )

    return rows.mapInArrow(run, "part int, bucket bigint, id bigint, least bigint, vec array<double>")


def blocks(rows: DataFrame, name: str) -> DataFrame:
    """(part, bucket, ids, vectors): the rows of a bucket, BLOCK at most together, as packed numbers. ids: id, least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(vectors).tobytes()], pa.binary())],
                ["part", "bucket", f"{name}_ids", f"{name}_vectors"],
            )

        held = 0
        for batch in batches:
            part, bucket, own, least = (batch.column(k).to_numpy() for k in range(4))
            own = np.stack([own, least], axis=1)
            raw, ends = batch.column(4).values.to_numpy(), batch.column(4).offsets.to_numpy()
            cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1])])
            for start, end in zip(cuts, [*cuts[1:], len(part)], strict=True):
                for lo in range(start, end, BLOCK):
                    hi = min(lo + BLOCK, end)
                    here = (part[lo], bucket[lo])
                    if ids and (here != key or held + hi - lo > BLOCK):
                        yield packed()
                        ids, vectors, held = [], [], 0
                    key = here
                    ids.append(own[lo:hi])
                    vectors.append(raw[ends[lo] : ends[hi]])
                    held += hi - lo
        if ids:
            yield packed()

    dealt = rows.repartition("part", "bucket").sortWithinPartitions("part", "bucket")
    return dealt.mapInArrow(run, f"part int, bucket bigint, {name}_ids binary, {name}_vectors binary")


def best_of_blocks(pairs: DataFrame, most: int) -> DataFrame:
    """(q, c, least, score): for each query of a pair of blocks its first vectors of the other one by (score, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["q_ids"], np.int64).reshape(-1, 2)[:, 0]
                c, least = np.frombuffer(row["c_ids"], np.int64).reshape(-1, 2).T
                x, y = np.frombuffer(row["q_vectors"]).reshape(q.size, -1), np.frombuffer(row["c_vectors"]).reshape(c.size, -1)
                at, found, scores = best_of_block(x, y, c, least, most)
                yield pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(c[found]), pa.array(least[found]), pa.array(scores)], ["q", "c", "least", "score"])

    return pairs.mapInArrow(run, "q bigint, c bigint, least bigint, score double")


def best_of_block(x: np.ndarray, y: np.ndarray, c: np.ndarray, least: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of y and scores: the first `most` of y for each row of x."""
    near = unit(x) @ unit(y).T
    k = min(most, len(y))
    last = np.partition(near, len(y) - k, axis=1)[:, len(y) - k]
    at, found = np.nonzero(near >= last[:, None] - MARGIN)
    scores = np.concatenate([cosines(x[at[i : i + PAIRS]], y[found[i : i + PAIRS]]) for i in range(0, len(at), PAIRS)])
    order = np.lexsort((c[found], least[found], -scores, at))
    at, found, scores = at[order], found[order], scores[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], found[first], scores[first]


def nearest(vectors: DataFrame, every: int = 50, top: int = 5, recall: float = 0.95, few: int = FEW, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` its `top` nearest others."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & _valid(F.col("vec")))
    # -0.0 and 0.0 are one number.
    rows = rows.select("id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))
    queries = directions(rows.where(F.pmod(F.col("id"), F.lit(every)) == 0)).distinct()
    alike = Window.partitionBy("vec").orderBy("id")
    classes = stored(
        directions(rows).withColumn("place", F.dense_rank().over(alike))
        .where(F.col("place") <= top + 1)
        .groupBy("vec")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    asked = stored(queries.join(classes.select("vec", "class"), "vec").select("id", "class"), "asked")
    settings = fitted(classes, top, recall, few)
    known = classes.select("class", F.col("ids")[0].alias("least"), "vec")
    wanted = known.join(asked.select("class").distinct(), "class", "left_semi").select("class", "least", "vec")
    index = blocks(hashed(known, settings, probing=False), "c")
    probes = blocks(hashed(wanted, settings, probing=True), "q")
    # Blocks of several tables hold the same pairs, with the same scores.
    found = best_of_blocks(probes.join(index, ["part", "bucket"]), top + SPARE).groupBy("q", "c", "least").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "least", "c")
    best = stored(found.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= top + SPARE).select("q", "c", "score"), "best")
    scored = best.join(classes.select(F.col("class").alias("c"), "ids"), "c").select("q", "ids", "score")
    answers = asked.join(scored, asked["class"] == scored["q"]).select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
