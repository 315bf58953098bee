"""Operator 3: near duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set is that of its distinct word shingles. One permutation (sigma, a mixing of 64-bit hashes)
places each shingle on a circle of 2^20; a second one (pi, a shuffled table) gives every place a rank.
Coordinate k of the signature is the least rank of the set after turning the circle by k, so two
permutations serve for all coordinates, and all coordinates of a shingle are one slice of the table.

1. Documents of equal sets are one node. Signatures are cut into bands; nodes that agree in a band meet.
   With 48 bands of 6 coordinates two sets of similarity 0.8 miss each other with probability 5e-7.
2. Each bucket has a centre: the node that meets most others, which in a group of near copies is the text
   they are copies of. All nodes are compared with their centres on full sets: one pair a node and bucket.
   What is similar enough is linked, and links give components.
3. Two nodes of one bucket but different components may still be similar. Mostly both have been compared with
   the same main centre, the heaviest of their centres, and so share at most the smaller of what each has in
   common with it, plus what they share outside it. So they can be linked only if they share some of their
   rarest shingles outside the centre (a prefix, in order of hash), or if the two counts alone allow it. Joins on
   those find the pairs; copies changed in different places do not meet.
4. Nodes of a bucket without a common main centre are compared directly. Few are left for that.
5. Pairs of 3 and 4 are verified on full sets; components of all links; every document gets the smallest id
   of its component.

Nothing is capped: each pair that meets in a bucket is compared, or linked through others, or excluded by the
bound. Sets are compared as 64-bit shingle hashes made from the texts, fetched for candidates only.

Rows: NULL texts and texts without words have an empty set, are linked with nothing and stand for
themselves. Rows of equal ids are documents of one id. A NULL id is never the smallest; a component without
any id has a NULL component_id and its rows are kept. Other columns pass through; those called like results
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlake.llm.common import arrow_append, stored, text_key, worker_state
from hostlake.llm.components import connected_components
from hostlake.llm.wordhash import STEP, WordHashes, grams, mix

CIRCLE = 1 << 20
BANDS, ROWS = 48, 6
BROADCAST_ROWS = 1_000_000


class Circulant:
    """Signatures by two permutations, one of them turned."""

    def __init__(self, coordinates: int, seed: int = 7):
        table = np.random.Generator(np.random.PCG64(seed)).permutation(CIRCLE).astype(np.uint32)
        ring = np.concatenate([table, table[:coordinates]])
        self.turned = np.lib.stride_tricks.sliding_window_view(ring, coordinates)
        self.coordinates = coordinates

    def signature(self, shingles: np.ndarray, block: int = 1024) -> np.ndarray:
        at = np.unique((mix(shingles) & np.uint64(CIRCLE - 1)).astype(np.int64))
        out = np.full(self.coordinates, CIRCLE, np.uint32)
        for k in range(0, at.size, block):
            np.minimum(out, self.turned[at[k : k + block]].min(axis=0), out=out)
        return out


def shingle_set(hashes: WordHashes, text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence is one shingle if it is shorter."""
    # bytes.lower() and bytes.split() know A-Z and the ASCII blanks only, which is what is wanted.
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = hashes.of(words)
    return np.unique(grams(codes, min(size, codes.size)) + np.uint64(min(size, codes.size)))


def _tools(coordinates: int) -> tuple[WordHashes, Circulant]:
    return worker_state(("near", coordinates), lambda: (WordHashes(), Circulant(coordinates)))


def _band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(-1, bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
        for k in range(rows):
            out = mix(out * STEP + parts[:, :, k])
    return out.view(np.int64)


def signed(docs: DataFrame, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """docs, without the text, with n_shingles, set_id (16 bytes; NULL without shingles) and bands (hashes)."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        hashes, circulant = _tools(bands * rows)
        counts, ids, found = [], [], []
        for t in batch.column(text).to_pylist():
            shingles = shingle_set(hashes, t, size)
            counts.append(shingles.size)
            ids.append(xxhash.xxh3_128_digest(shingles.tobytes()) if shingles.size else None)
            if shingles.size:
                found.append(circulant.signature(shingles))
        codes = _band_hashes(np.array(found, np.uint32), bands, rows).ravel() if found else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) > 0) * bands]).astype(np.int32)
        return [pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes))]

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return arrow_append(docs, fields, compute, [text])


def _allowed(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def with_texts(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """pairs (a, b, ...) of nodes with a text of each, ta and tb."""
    wanted = stored(
        pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "key"), "node"), "wanted"
    )
    keys = wanted.select(F.col("key").alias("k"))
    if wanted.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    # Equal keys mean equal texts, so any one of them will do.
    texts = docs.select(text_key(F.col(text)).alias("k"), F.col(text).alias("t")).join(keys, "k", "left_semi").dropDuplicates(["k"])
    texts = stored(texts.join(wanted, texts["k"] == wanted["key"]).select("node", "t"), "texts")
    left = texts.select(F.col("node").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    return pairs.join(left, "a").join(right, "b")


class Pairs:
    """Shingle sets of pairs of texts; the set of the first text is kept while it stays the same."""

    def __init__(self, size: int):
        self.hashes, self.size = WordHashes(), size
        self.text, self.set = None, None

    def sets(self, ta: str, tb: str) -> tuple[np.ndarray, np.ndarray]:
        if ta != self.text:
            self.text, self.set = ta, shingle_set(self.hashes, ta, self.size)
        return self.set, shingle_set(self.hashes, tb, self.size)


def compared(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """(a, b, common, linked): how many shingles the full sets share, and whether that is enough."""
    pairs = stored(pairs.select("a", "b"), "pairs")
    both = with_texts(pairs, nodes, docs, text).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Pairs(size)
        for batch in batches:
            common, linked = [], []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one, two = tools.sets(ta, tb)
                common.append(np.intersect1d(one, two, assume_unique=True).size)
                linked.append(100 * common[-1] >= percent * (one.size + two.size - common[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "common", "linked"])

    return stored(both.mapInArrow(run, "a bigint, b bigint, common bigint, linked boolean"), "compared")


def meetings(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, size): nodes that share a bucket with others, and how many nodes it has."""
    exploded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    counted = exploded.withColumn("size", F.count("*").over(Window.partitionBy("bucket")))
    return counted.where("size > 1").select("bucket", "node", "n", "size")


def with_centres(met: DataFrame) -> DataFrame:
    """met with the weight of each node (how many it meets) and the centre of each bucket, its heaviest node."""
    weights = met.groupBy("node").agg(F.sum("size").alias("weight"))
    weighted = stored(met.join(weights, "node").select("bucket", "node", "n", "weight"), "weighted")
    heaviest = F.max(F.struct("weight", (-F.col("node")).alias("node")))
    centres = weighted.groupBy("bucket").agg(heaviest.alias("c")).select("bucket", (-F.col("c.node")).alias("centre"), F.col("c.weight").alias("centre_weight"))
    return weighted.join(centres, "bucket")


def main_centres(met: DataFrame) -> DataFrame:
    """(node, main): the heaviest of a node's centres and itself."""
    own = F.struct(F.col("weight"), (-F.col("node")).alias("node"))
    centre = F.struct(F.col("centre_weight").alias("weight"), (-F.col("centre")).alias("node"))
    return met.groupBy("node").agg(F.max(F.greatest(own, centre)).alias("m")).select("node", (-F.col("m.node")).alias("main"))


def _enough(both: Column, shared: Column, percent: int) -> Column:
    """Whether sets of together `both` shingles that share `shared` are similar enough."""
    return shared * (100 + percent) >= both * percent


def pairs_around_centres(members: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components with the same main centre that can still be linked.
    members: (main, node, n, component, common), common with the main centre."""
    groups = members.groupBy("main").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least")).where("lo < hi")
    mixed = members.join(groups.select("main", "least"), "main").withColumnsRenamed({"main": "a", "node": "b"})
    mixed = stored(mixed, "mixed")
    both = with_texts(mixed, nodes, docs, text).select("a", "b", "n", "component", "common", "least", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Pairs(size)
        for batch in batches:
            rows, outside = [], []
            n, common, least = (batch.column(k).to_numpy() for k in (2, 4, 5))
            for k, (ta, tb) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)):
                centre, own = tools.sets(ta, tb)
                out = np.setdiff1d(own, centre, assume_unique=True)
                # A partner is no smaller than this, so at least `need` shingles are shared outside the centre.
                partner = max(least[k], -(-percent * n[k] // 100))
                need = -(-percent * (n[k] + partner) // (100 + percent)) - common[k]
                found = out[: max(0, out.size - max(need, 1) + 1)].view(np.int64)
                outside.append(found)
                rows.append(np.full(found.size, k))
                if need <= 0:
                    outside.append(np.zeros(1, np.int64))  # counts alone may allow it
                    rows.append(np.array([-k - 1]))
            at = np.concatenate(rows) if rows else np.empty(0, np.int64)
            token = np.concatenate(outside) if outside else np.empty(0, np.int64)
            take = pa.array(np.where(at < 0, -at - 1, at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(batch.column(k).take(take) for k in (2, 3, 4)), pa.array(token), pa.array(at < 0)],
                ["main", "node", "n", "component", "common", "token", "bare"],
            )

    tokens = stored(both.mapInArrow(run, "main bigint, node bigint, n bigint, component bigint, common bigint, token bigint, bare boolean"), "outside")
    other = tokens.select("main", "token", "bare", *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "component", "common")])
    return (
        tokens.join(other, ["main", "token", "bare"])
        .where((F.col("node") < F.col("node_2")) & (F.col("component") != F.col("component_2")) & _allowed(F.col("n"), F.col("n_2"), percent))
        .where(~F.col("bare") | _enough(F.col("n") + F.col("n_2"), F.least("common", "common_2"), percent))
        .select(F.col("node").alias("a"), F.col("node_2").alias("b"))
        .distinct()
    )


def pairs_across_centres(met: DataFrame, labels: DataFrame, mains: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket, of different components and different main centres. The nodes of a bucket
    that have the main centre of its own centre, as most have, are not compared with each other."""
    labelled = met.select("bucket", "node", "n", "centre").join(mains, "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heaviest = labelled.groupBy("bucket").agg(
        F.min("main").alias("lo"), F.max("main").alias("hi"), F.min("component").alias("c_lo"), F.max("component").alias("c_hi"),
        F.max(F.when(F.col("node") == F.col("centre"), F.col("main"))).alias("usual"),
    )
    mixed = heaviest.where("lo < hi and c_lo < c_hi").select("bucket", "usual")
    left = stored(labelled.join(mixed, "bucket"), "across")
    right = left.select("bucket", *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "component", "main")])
    unlike = (F.col("main") != F.col("main_2")) & (F.col("component") != F.col("component_2")) & (F.col("node") != F.col("node_2"))
    return (
        left.where(F.col("main") != F.col("usual"))
        .join(right, "bucket")
        .where(unlike & _allowed(F.col("n"), F.col("n_2"), percent))
        .select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with n_shingles, component_id and kept. Linked: intersection >= percent/100 of the union."""
    names = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    sets = stored(signed(narrow, "text", size, bands, rows), "sets")
    nodes = stored(
        sets.where(F.col("set_id").isNotNull())
        .groupBy("set_id")
        .agg(F.min("doc").alias("least_doc"), F.first("n_shingles").alias("n"), F.min("key").alias("key"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    met = stored(with_centres(stored(meetings(nodes), "met")), "centred")
    tried = met.where("centre <> node").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tried = compared(tried, nodes, docs, text, size, percent)
    links = tried.where("linked").select("a", "b")
    labels = connected_components(links)
    mains = stored(main_centres(met), "mains")
    to_main = mains.join(tried, (mains["main"] == tried["a"]) & (mains["node"] == tried["b"])).select("main", "node", "common")
    members = (
        to_main.join(nodes.select("node", "n"), "node")
        .join(labels, "node", "left")
        .select("main", "node", "n", F.coalesce("component", "node").alias("component"), "common")
    )
    open_pairs = (
        pairs_around_centres(members, nodes, docs, text, size, percent)
        .union(pairs_across_centres(met, labels, mains, percent))
        .distinct()
        .join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    )
    more = compared(open_pairs, nodes, docs, text, size, percent).where("linked").select("a", "b")
    if more.limit(1).count():
        labels = connected_components(links.union(more))
    least = labels.join(nodes.select("node", "least_doc"), "node").groupBy("component").agg(F.min("least_doc").alias("component_id"))
    of_set = (
        nodes.select("node", "set_id", "least_doc")
        .join(labels.join(least, "component").select("node", F.lit(True).alias("linked"), "component_id"), "node", "left")
        .select("set_id", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_doc")).alias("component_id"))
    )
    return _answer(docs, names, sets, of_set, doc_id, text)


def _answer(docs: DataFrame, names: list[str], sets: DataFrame, of_set: DataFrame, doc_id: str, text: str) -> DataFrame:
    of_key = (
        sets.select("key", "set_id", "n_shingles")
        .dropDuplicates(["key"])
        .join(of_set, "set_id", "left")
        .select(F.col("key").alias("_key"), F.col("n_shingles").alias("n_shingles"), F.col("set_id").isNotNull().alias("_any"), "component_id")
    )
    base = docs.select(*names, text_key(F.col(text)).alias("_text_key"))
    component = F.when(F.col("_any"), F.col("component_id")).otherwise(F.col(doc_id).cast("bigint"))
    kept = F.coalesce(F.col(doc_id).cast("bigint") == component, component.isNull())
    return base.join(of_key, base["_text_key"] == of_key["_key"]).select(*names, "n_shingles", component.alias("component_id"), kept.alias("kept"))
