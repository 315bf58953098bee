"""Operator 10: line dedup over a sharded minimal perfect hash.

The key of a line is the line without white space at its ends and with A-Z in lower case. Keys of at least
`min_chars` characters that several documents hold stay only in the document of smallest id.

1. Lines become 128-bit hashes, once, in a working table of numbers. Grouping them gives for each distinct
   hash the smallest and largest id and the number of lines; those found in two documents or more are kept.
2. The hashes are cut into shards of bounded size. Each shard is a minimal perfect hash - levels of bit
   arrays; a key belongs to the first level where it is alone on its bit, and the rank of the bit is its
   place - with an array of 64-bit fingerprints, one of counts and one of keeping ids at those places.
3. The lines' hashes are sent to the shards, and probe the arrays as they stream by: nothing is joined and no
   group is collected. All shards get the copies that an even share of all lines calls for, so a corpus with
   few repeated lines is probed by many tasks too; one that holds hot lines gets more. How many copies a shard
   has is one small row for 65,536 repeated keys, which is broadcast; a shard without keys is not asked.
4. Numbers of dropped lines come back to the documents, by broadcast if they were counted to be few.

Rows: a NULL or empty text is one empty line. A NULL id counts as larger than all ids, and all rows of NULL
id are one document in this respect, as are rows of one id. Other columns pass through, those called like
results are replaced.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlake.llm.common import broadcast_if_small, let, stored, text_key

BLANKS = " \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 1 << 16
#: Lines that one copy of a shard serves.
LINES_PER_COPY = 1 << 18
#: Documents and lines to drop that may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000
NO_ID = (1 << 63) - 1
LEVELS = 64


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A hash of both halves for each level (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = a ^ (b + np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit numbers."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - 1)
            base += int(bits.sum())

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        for level in range(LEVELS):
            if not a.size:
                break
            size = 2 * a.size + 64
            at = (_mix(a, b, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            a, b = a[~alone[at]], b[~alone[at]]
        if a.size:
            raise ValueError("keys are not distinct")
        return cls(levels)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for some of those that are not in the set, any place for the others."""
        out = np.full(a.size, -1, np.int64)
        left = np.arange(a.size)
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not left.size:
                break
            at = (_mix(a[left], b[left], level) % np.uint64(bits.size)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out


def pack_shard(a: np.ndarray, b: np.ndarray, keeper: np.ndarray, count: np.ndarray) -> bytes:
    made = PerfectHash.build(a, b)
    order = made.places(a, b)
    prints, ids, counts = np.empty_like(b), np.empty_like(keeper), np.empty(count.size, np.uint32)
    prints[order], ids[order], counts[order] = b, keeper, np.minimum(count, np.iinfo(np.uint32).max)
    out = io.BytesIO()
    np.savez(out, prints=prints, ids=ids, counts=counts, sizes=[x.size for x in made.levels], **{f"level{k}": np.packbits(x) for k, x in enumerate(made.levels)})
    return out.getvalue()


class Shard:
    def __init__(self, packed: bytes):
        with np.load(io.BytesIO(packed)) as f:
            self.prints, self.ids, self.counts = f["prints"], f["ids"], f["counts"]
            self.hash = PerfectHash([np.unpackbits(f[f"level{k}"], count=int(n)).astype(bool) for k, n in enumerate(f["sizes"])])

    def dropped(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether each line is held by several documents and kept in another one."""
        at = self.hash.places(a, b)
        found = at >= 0
        found[found] = self.prints[at[found]] == b[found]
        found[found] = self.ids[at[found]] != doc[found]
        return found


def line_key(line: str, min_chars: int) -> bytes | None:
    line = line.strip(BLANKS)
    return line.encode().lower() if len(line) >= min_chars else None


def _ids(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID))


def hashed_lines(docs: DataFrame, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """(doc, key, line, a, b): long lines of all documents as hashes; line counts from 0."""
    source = docs.select(_ids(doc_id).alias("doc"), text_key(F.col(text)).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, line, digests = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for n, each in enumerate(text.split("\n")):
                    found = line_key(each, min_chars)
                    if found is not None:
                        row.append(k)
                        line.append(n)
                        digests.append(xxhash.xxh3_128_digest(found))
            halves = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                ["doc", "key", "line", "a", "b"],
            )

    return source.mapInArrow(run, "doc bigint, key binary, line int, a bigint, b bigint")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(a, b, keeper, n): hashes of lines that at least two documents hold. Counts are summed before the
    shuffle, so a hot line costs each task one row."""
    grouped = lines.groupBy("a", "b").agg(F.min("doc").alias("keeper"), F.max("doc").alias("_last"), F.count("*").alias("n"))
    return grouped.where(F.col("keeper") < F.col("_last")).drop("_last")


def build_shards(repeated: DataFrame, shards: int, n_lines: int) -> DataFrame:
    """(shard, copies, packed): the arrays of each shard; hashes spread evenly, so a shard's size is bounded."""
    even = 1 + n_lines // shards // LINES_PER_COPY

    def build(group):
        u = lambda name: group[name].to_numpy().view(np.uint64)
        packed = pack_shard(u("a"), u("b"), group["keeper"].to_numpy(), group["n"].to_numpy())
        copies = even + int(group["n"].sum()) // LINES_PER_COPY
        return type(group)({"shard": [group["shard"].iloc[0]], "copies": [copies], "packed": [packed]})

    return repeated.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, copies int, packed binary")


def _shard(shards: int) -> Column:
    return F.pmod(F.col("a"), F.lit(shards)).cast("int")


def dealt(lines: DataFrame, shards: DataFrame, n_shards: int) -> DataFrame:
    """Lines with their shard and the copy of it that they ask."""
    copies = F.broadcast(shards.select("shard", "copies"))
    return lines.withColumn("shard", _shard(n_shards)).join(copies, "shard").withColumn("salt", F.pmod(F.xxhash64("key", "line", "doc"), "copies").cast("int")).drop("copies")


def probe(lines: DataFrame, shards: DataFrame, n_shards: int) -> DataFrame:
    """(doc, key, line) of the lines to drop. Arrays and lines of a shard stream through one sorted partition,
    the arrays first."""
    asking = dealt(lines, shards, n_shards).select("shard", "salt", F.lit(1).alias("asks"), "doc", "key", "line", "a", "b", F.lit(None).cast("binary").alias("packed"))
    null = F.lit(None)
    arrays = shards.select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("asks"),
        null.cast("bigint").alias("doc"), null.cast("binary").alias("key"), null.cast("int").alias("line"), null.cast("bigint").alias("a"), null.cast("bigint").alias("b"), "packed",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard = None, None
        for batch in batches:
            part = (batch.column(0).to_numpy().astype(np.int64) << 32) | batch.column(1).to_numpy()
            asks = batch.column(2).to_numpy()
            a, b, doc = (batch.column(k).fill_null(0).to_numpy() for k in (6, 7, 3))
            drop = np.zeros(len(part), bool)
            cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])])
            for start, end in zip(cuts, [*cuts[1:], len(part)], strict=True):
                if asks[start] == 0:
                    known, shard = part[start], Shard(batch.column(8)[int(start)].as_py())
                elif part[start] == known:
                    drop[start:end] = shard.dropped(a[start:end].view(np.uint64), b[start:end].view(np.uint64), doc[start:end])
            kept = pa.array(np.flatnonzero(drop))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(kept) for k in (3, 4, 5)], ["doc", "key", "line"])

    together = asking.unionByName(arrays).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "asks")
    return together.mapInArrow(run, "doc bigint, key binary, line int")


def dedup_lines(docs: DataFrame, min_chars: int = 10, doc_id: str = "doc_id", text: str = "text", out: str = "kept_text") -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and the kept lines joined by line feeds."""
    lines = stored(hashed_lines(docs, min_chars, doc_id, text), "lines")
    repeated = stored(repeated_lines(lines), "repeated")
    n_shards = max(1, -(-repeated.count() // KEYS_PER_SHARD))
    shards = stored(build_shards(repeated, n_shards, lines.count()), "shards")
    dropped = stored(
        probe(lines, shards, n_shards).groupBy("doc", "key").agg(F.collect_set("line").alias("_lines")), "dropped"
    ).select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), "_lines")
    dropped = broadcast_if_small(dropped, "_lines", BROADCAST_ROWS)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", out)]
    base = docs.select(*names, _ids(doc_id).alias("_id"), text_key(F.col(text)).alias("_text_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    joined = base.join(dropped, (base["_id"] == dropped["_doc"]) & (base["_text_key"] == dropped["_key"]), "left")

    def kept(each: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(each) - 1), F.col("_lines"))
        return F.array_join(F.transform(stay, lambda i: F.element_at(each, i + 1)), "\n")

    each = F.split("_text", "\n", -1)
    return joined.select(
        *names,
        F.size(each).cast("bigint").alias("n_lines"),
        F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("bigint").alias("n_dropped"),
        F.when(F.col("_lines").isNull(), F.col("_text")).otherwise(let(each, kept)).alias(out),
    )
