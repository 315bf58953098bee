"""Operator 13: hard-negative mining over Hilbert-ordered blocks with zone maps.

Components are floored to integers on a grid of `scale`; the score of two vectors is their integer inner product. Rows
are sorted by (length, label, Hilbert key of their direction) over all partitions and cut into blocks of at most BLOCK
rows, written as rows of a Parquet table together with their zone maps: least and largest value of each dimension and of
the labels. An anchor asks for the first `top` rows, by (score, smaller id), of its own label (positives), or of other
labels with scores within a window below each positive's score (negatives).

Interval arithmetic bounds the scores of an anchor a in a block: at most sum(max(a_d * lo_d, a_d * hi_d)), at least the
sum of the minima. A block is read for an anchor if its labels can fit and its bounds meet one of the windows. For
positives the window starts at the `top`-th score within the anchor's own block. Where a block lies wholly in a window and
holds more than `top` fitting rows, its lower bound raises the window for the others. Nothing else is left out, so
results are exact.

Scale. Anchors and zone maps are packed and meet in a grid: an anchor pack goes once to each cell of ZONES * PACKS blocks, a
zone pack once to each slice of SLICE anchor packs, so a square of the grid is bounded at any size. What comes out is a pack of anchors for each block that must be read. It meets the block by a join on the block's number,
which splits when many anchors want one block. No task holds more than one pack and one block, however common a label or a
vector is, and each pair of them passes on `top` rows a window at most.

Rows: a NULL id, label or vector, an empty vector, and NULL or non-finite components (times `scale` as well) take no part. Only vectors
of one length are compared. A repeated row (id, label, vector) is one row; rows with the anchor's own id are never
found. Scores beyond a long count as the nearest long. Fewer rows than asked for are all there are; an anchor
without positives has no negatives. Columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.llm.common import stored

BLOCK_BITS = 9
BLOCK = 1 << BLOCK_BITS
#: A block ends with its label once it has so many rows.
LEAST_BLOCK = 128
ANCHORS = 128
ZONES = 64
#: Zone packs of a cell, and anchor packs of a slice.
PACKS = 32
SLICE = 256
KEY_BITS = 128
LONG = np.iinfo(np.int64)
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)


def hilbert_keys(x: np.ndarray) -> list[bytes]:
    """Places of rows' directions on a Hilbert curve: components in units of the row's root mean square, squashed."""
    dims = x.shape[1]
    bits = max(2, min(16, KEY_BITS // dims))
    largest = np.abs(x).max(axis=1, keepdims=True)
    y = x / np.where(largest == 0, 1, largest)
    spread = np.sqrt((y * y).mean(axis=1, keepdims=True))
    y = y / np.where(spread == 0, 1, spread)
    axes = ((y / np.sqrt(1 + y * y) + 1) * (1 << (bits - 1))).astype(np.int64).clip(0, (1 << bits) - 1)
    return [row[: KEY_BITS // 8].tobytes() for row in curve_places(axes, bits)]


def curve_places(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid points (rows) on the Hilbert curve, as bytes in order. Rotations are undone level by level, a Gray
    code gives the curve's index with its bits dealt over the axes (Skilling, 2004), and these are woven together."""
    axes = points.T.copy()
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for axis in axes:
            turned = axis >> b & 1 == 1
            swapped = np.where(turned, 0, (axes[0] ^ axis) & low)
            axes[0] ^= np.where(turned, low, swapped)
            axis ^= swapped
    for k in range(1, len(axes)):
        axes[k] ^= axes[k - 1]
    odd = np.zeros(len(points), np.int64)
    for b in range(bits - 1, 0, -1):
        odd ^= np.where(axes[-1] >> b & 1 == 1, (1 << b) - 1, 0)
    axes ^= odd
    woven = np.stack([axes >> b & 1 for b in range(bits - 1, -1, -1)]).astype(np.uint8)
    return np.packbits(woven.reshape(bits * len(axes), -1).T, axis=1)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in the least of 2, 4 or 8 bytes that holds them all."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64).tobytes()


def unpacked(raw: bytes, rows: int, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(raw) // (rows * dim)]
    return np.frombuffer(raw, kind).reshape(rows, dim).astype(np.float64)


def longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b as int64."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return whole(a).dot(whole(b).T).clip(int(LONG.min), int(LONG.max)).astype(np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest scores of anchors a in zones [lo, hi], wide enough for rounding; NaN where none is known."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    with np.errstate(all="ignore"):
        least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
        size = np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T
        margin = np.where(size < EXACT, 0, size * 1e-12)
        # Scores stop at the ends of a long, so bounds do.
        return np.clip(least - margin, float(LONG.min), float(LONG.max)), np.clip(most + margin, float(LONG.min), float(LONG.max))


def _valid(vec: Column) -> Column:
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _keyed(rows: DataFrame, scale: float) -> DataFrame:
    """(dim, label, key, id, anchor, q): whole numbers and the place on the curve of each vector."""
    names = ["dim", "label", "key", "id", "anchor", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, ids, anchor, vectors = (batch.column(k) for k in ("label", "id", "anchor", "vec"))
            raw, ends = vectors.values.to_numpy(), vectors.offsets.to_numpy()
            lengths = np.diff(ends)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                with np.errstate(over="ignore"):
                    q = np.floor(raw[ends[at][:, None] + np.arange(dim)] * scale)
                fit = np.isfinite(q).all(axis=1)
                at, q = pa.array(at[fit]), q[fit]
                if len(q):
                    made = [pa.array(np.full(len(q), dim, np.int32)), label.take(at), pa.array(hilbert_keys(q)), ids.take(at), anchor.take(at), pa.array([packed(r) for r in q])]
                    yield pa.RecordBatch.from_arrays(made, names)

    return rows.mapInArrow(run, "dim int, label bigint, key binary, id bigint, anchor boolean, q binary")


BLOCKS = "block bigint, dim int, n int, label_lo bigint, label_hi bigint, lo binary, hi binary, ids binary, labels binary, anchors binary, q binary"


def blocks(rows: DataFrame, scale: float) -> DataFrame:
    """The candidates' blocks in the order of the curve, stored; `rows` has id, label, anchor, vec."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, last = TaskContext.get().partitionId() << 20, [], None

        def block() -> pa.RecordBatch:
            nonlocal number
            dim = held[0]["dim"]
            q = np.concatenate([unpacked(r["q"], 1, dim) for r in held])
            labels = np.array([r["label"] for r in held], np.int64)
            row = {
                "block": number, "dim": dim, "n": len(held), "label_lo": int(labels.min()), "label_hi": int(labels.max()),
                "lo": q.min(axis=0).tobytes(), "hi": q.max(axis=0).tobytes(), "ids": np.array([r["id"] for r in held], np.int64).tobytes(),
                "labels": labels.tobytes(), "anchors": np.array([r["anchor"] for r in held], bool).tobytes(), "q": packed(q),
            }
            number += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row]).select(names).cast(schema)

        schema = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for n, c in zip(names, BLOCKS.split(", "), strict=True)])
        for batch in batches:
            for r in batch.to_pylist():
                # A repeated row stands beside its like.
                if last == r:
                    continue
                last = r
                if held and (len(held) == BLOCK or r["dim"] != held[0]["dim"] or (r["label"] != held[-1]["label"] and len(held) >= LEAST_BLOCK)):
                    yield block()
                held.append(r)
        if held:
            yield block()

    dealt = _keyed(rows, scale).repartitionByRange("dim", "label", "key", "id").sortWithinPartitions("dim", "label", "key", "id", "q")
    return stored(dealt.mapInArrow(run, BLOCKS), "blocks")


def first_of(at: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the first `top` of each `at` by (score, smaller id), in order."""
    order = np.lexsort((ids, -score, at))
    at = at[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at) < top]


ANCHOR_ROWS = "uid bigint, id bigint, label bigint, dim int, q binary, start bigint"


def _anchors(table: DataFrame, top: int) -> DataFrame:
    """A row for each anchor; start: the `top`-th score among rows of its label in its own block."""
    names = [c.split()[0] for c in ANCHOR_ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                own = np.flatnonzero(np.frombuffer(b["anchors"], bool))
                if not own.size:
                    continue
                q, ids, labels = unpacked(b["q"], b["n"], b["dim"]), longs(b["ids"]), longs(b["labels"])
                s = scores(q[own], q)
                fit = (labels[own][:, None] == labels) & (ids[own][:, None] != ids)
                start = [int(np.sort(s[k][fit[k]])[-top]) if fit[k].sum() >= top else int(LONG.min) for k in range(len(own))]
                uid = (b["block"] << BLOCK_BITS) + own
                made = [pa.array(uid), pa.array(ids[own]), pa.array(labels[own]), pa.array(np.full(own.size, b["dim"], np.int32)), pa.array([packed(r) for r in q[own]]), pa.array(start, pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names)

    return table.select("block", "dim", "n", "ids", "labels", "anchors", "q").mapInArrow(run, ANCHOR_ROWS)


PACK = "dim int, m int, uids binary, ids binary, labels binary, q binary, lo binary, hi binary"
PACK_SCHEMA = pa.schema([("dim", pa.int32()), ("m", pa.int32()), *((n, pa.binary()) for n in ("uids", "ids", "labels", "q", "lo", "hi"))])


def _packs(anchors: DataFrame, windows: int) -> DataFrame:
    """Anchors that are near each other on the curve, together with their windows: los and his are arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def pack() -> pa.RecordBatch:
            dim = held[0]["dim"]
            fill = lambda xs, value: [*xs, *[value] * (windows - len(xs))]
            row = {
                "dim": dim, "m": len(held), **{f"{n}s": np.array([r[n] for r in held], np.int64).tobytes() for n in ("uid", "id", "label")},
                "q": packed(np.concatenate([unpacked(r["q"], 1, dim) for r in held])),
                # A window from 0 to -1 is empty.
                "lo": np.array([fill(r["los"], 0) for r in held], np.int64).tobytes(), "hi": np.array([fill(r["his"], -1) for r in held], np.int64).tobytes(),
            }
            held.clear()
            return pa.RecordBatch.from_pylist([row], PACK_SCHEMA)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == ANCHORS or r["dim"] != held[0]["dim"]):
                    yield pack()
                held.append(r)
        if held:
            yield pack()

    rows = anchors.select("dim", "uid", "id", "label", "q", "los", "his")
    return rows.repartitionByRange("dim", "uid").sortWithinPartitions("dim", "uid").mapInArrow(run, PACK)


ZONE_PACK = "dim int, zones int, blocks binary, ns binary, label_lo binary, label_hi binary, lo binary, hi binary"
ZONE_SCHEMA = pa.schema([("dim", pa.int32()), ("zones", pa.int32()), *((n, pa.binary()) for n in ("blocks", "ns", "label_lo", "label_hi", "lo", "hi"))])


def _zones(table: DataFrame) -> DataFrame:
    """Zone maps of ZONES consecutive blocks each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def pack() -> pa.RecordBatch:
            row = {"dim": held[0]["dim"], "zones": len(held), "lo": b"".join(r["lo"] for r in held), "hi": b"".join(r["hi"] for r in held)}
            row |= {name: np.array([r[c] for r in held], np.int64).tobytes() for name, c in (("blocks", "block"), ("ns", "n"), ("label_lo", "label_lo"), ("label_hi", "label_hi"))}
            held.clear()
            return pa.RecordBatch.from_pylist([row], ZONE_SCHEMA)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == ZONES or r["dim"] != held[0]["dim"]):
                    yield pack()
                held.append(r)
        if held:
            yield pack()

    return table.select("block", "dim", "n", "label_lo", "label_hi", "lo", "hi").mapInArrow(run, ZONE_PACK)


def needed(a: dict, z: dict, same: bool, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, anchors of a pack that must read it) for the zones of a pack."""
    dim, labels = a["dim"], longs(a["labels"])[:, None]
    ns, label_lo, label_hi = longs(z["ns"]), longs(z["label_lo"]), longs(z["label_hi"])
    zone = [np.frombuffer(z[n]).reshape(-1, dim) for n in ("lo", "hi")]
    least, most = bounds(unpacked(a["q"], a["m"], dim), *zone)
    within = (label_lo <= labels) & (labels <= label_hi)
    single = label_lo == label_hi
    may, all_fit = (within, within & single) if same else (~(within & single), ~within)
    los, his = (longs(a[n]).reshape(a["m"], -1) for n in ("lo", "hi"))
    read = np.zeros(least.shape, bool)
    for lo, hi in zip(los.T[:, :, None], his.T[:, :, None], strict=True):
        inside = all_fit & (least >= lo) & (most <= hi) & (ns > top)
        raised = np.maximum(lo, np.where(inside, least, -np.inf).max(axis=1, keepdims=True))
        read |= may & (lo <= hi) & ~(most < raised) & ~(least > hi)
    for k in np.flatnonzero(read.any(axis=0)):
        yield int(longs(z["blocks"])[k]), np.flatnonzero(read[:, k])


def reads(packs: DataFrame, table: DataFrame, same: bool, top: int) -> DataFrame:
    """(block, a pack): which anchors must read which blocks."""
    schema = pa.schema([("block", pa.int64()), *PACK_SCHEMA])
    zone_packs = stored(_zones(table), "zones")
    anchor_packs = stored(packs, "packs")
    cells, slices = max(1, -(-zone_packs.count() // PACKS)), max(1, -(-anchor_packs.count() // SLICE))
    dealt = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = anchor_packs.withColumn("slice", dealt(slices, "uids")).withColumn("cell", every(cells))
    own = [F.col(c).alias(f"z_{c}") for c in zone_packs.columns]
    zones = zone_packs.select(*own, dealt(cells, "dim", "blocks").alias("z_cell"), every(slices).alias("z_slice"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One pair at a time: a pack is as large as a block.
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                q = unpacked(row["q"], row["m"], row["dim"])
                part = {n: longs(row[n]).reshape(row["m"], -1) for n in ("uids", "ids", "labels", "lo", "hi")}
                zone = {n[2:]: v for n, v in row.items() if n.startswith("z_")}
                for block, at in needed(row, zone, same, top):
                    made = {"block": block, "dim": row["dim"], "m": len(at), "q": packed(q[at]), **{n: v[at].tobytes() for n, v in part.items()}}
                    yield pa.RecordBatch.from_pylist([made], schema)

    met = anchors.join(zones, (anchors["cell"] == zones["z_cell"]) & (anchors["slice"] == zones["z_slice"]) & (anchors["dim"] == zones["z_dim"]))
    return met.mapInArrow(run, f"block bigint, {PACK}")


def searched(packs: DataFrame, table: DataFrame, same: bool, top: int) -> DataFrame:
    """(uid, window, rank, found, score): the first `top` rows of each window of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                ids, labels = longs(r["b_ids"]), longs(r["b_labels"])
                s = scores(unpacked(r["q"], r["m"], r["dim"]), unpacked(r["b_q"], r["n"], r["dim"]))
                fit = ((longs(r["labels"])[:, None] == labels) == same) & (longs(r["ids"])[:, None] != ids)
                los, his = (longs(r[n]).reshape(r["m"], -1) for n in ("lo", "hi"))
                for w, (lo, hi) in enumerate(zip(los.T[:, :, None], his.T[:, :, None], strict=True)):
                    at, found = np.nonzero(fit & (s >= lo) & (s <= hi))
                    score = s[at, found]
                    first = first_of(at, score, ids[found], top)
                    at, found, score = at[first], found[first], score[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(longs(r["uids"])[at]), pa.array(np.full(len(at), w, np.int32)), pa.array(ids[found]), pa.array(score)], ["uid", "window", "found", "score"]
                    )

    payload = table.select(F.col("block").alias("b_block"), "n", *(F.col(c).alias(f"b_{c}") for c in ("ids", "labels", "q")))
    pairs = reads(packs, table, same, top)
    met = pairs.join(payload, pairs["block"] == payload["b_block"]).select("dim", "m", "uids", "ids", "labels", "q", "lo", "hi", "n", "b_ids", "b_labels", "b_q")
    found = met.mapInArrow(run, "uid bigint, window int, found bigint, score bigint")
    order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mine(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    scale: float = 256.0,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Negatives of a positive of score p have
    scores from p * share[0] / share[1] to p."""
    part, whole = share
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vec")
    )
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _valid(F.col("vec")))
    table = blocks(rows, scale)
    anchors = stored(_anchors(table, positives), "anchors")
    near = anchors.withColumn("los", F.array("start")).withColumn("his", F.array(F.lit(int(LONG.max))))
    found = searched(_packs(near, 1), table, same=True, top=positives)
    own = stored(found.select("uid", F.col("rank").alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # The least whole number of at least score * part / whole.
    product = F.col("positive_score").cast("decimal(28,0)") * F.lit(part).cast("decimal(9,0)")
    over = F.pmod(product, F.lit(whole).cast("decimal(9,0)"))
    low = ((product - over) / F.lit(whole).cast("decimal(9,0)")).cast("bigint") + (over > 0).cast("bigint")
    ranges = own.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", low.alias("lo"), F.col("positive_score").alias("hi")))).alias("w"))
    asked = anchors.join(ranges, "uid").withColumn("los", F.col("w.lo")).withColumn("his", F.col("w.hi"))
    hard = searched(_packs(asked, positives), table, same=False, top=negatives)
    named = own.join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid").withColumn("window", F.col("place") - 1)
    return named.join(hard.select("uid", "window", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score")), ["uid", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
