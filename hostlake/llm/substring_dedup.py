"""Operator 9: substring dedup by super-k-mer partitioning.

A window is `width` consecutive words. Its minimiser is the least hash among its short word runs. Consecutive
windows of a text mostly share their minimiser; they travel together as one packed string (a super-k-mer)
to the bucket of that minimiser. Equal windows have equal minimisers, so they meet in one bucket, where
sorting the windows counts them exactly.

1. Each text gives its minimisers as 64-bit numbers. Counting them tells which occur twice or more; a window
   whose minimiser occurs once occurs once itself, so only super-k-mers of repeated minimisers travel.
2. Texts that hold such minimisers are read in blocks of some MB. Words become numbers of the block; equal
   super-k-mers of a block travel once (that their windows repeat is then known). What a block sends to a
   bucket is one row: its super-k-mers as numbers, their words once, both compressed. Words travel as words,
   not as hashes.
3. A bucket sorts 128-bit hashes of its windows. Buckets are as many as the repeated windows call for. The count
   of a minimiser is known by then: one that many texts share is split into parts, and its super-k-mers are cut
   into windows, each of which goes to the part that its own hash names. Equal windows still meet, and no bucket
   holds more than its share and one row a block of a window that is in all blocks.
4. Runs of removed words come back by text key, and every text is cut by them. Copies of a text share the key:
   their windows occur twice, so they have the same runs. Both joins with texts are sort-merge joins at every
   size, as what they bring has no bound; adaptive execution splits the partition of a text with many copies.

Rows: NULL is a text without words. Texts shorter than a window lose nothing. Repeated rows are documents of
their own, so their windows repeat. Other columns pass through; those called like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlake.llm.common import arrow_append, stored, text_key
from hostlake.llm.wordhash import WordHashes, grams, mix

#: Words of a run. Shorter ones make longer super-k-mers, longer ones are seldom shared by chance.
RUN_WORDS = 12
#: Bytes of text in a block, and super-k-mers for each bucket.
BLOCK_BYTES = 12_000_000
BUCKET_PIECES = 100_000
#: Occurrences of a minimiser for each part that its windows are split into.
PART_PIECES = 50_000
#: Windows counted at once in a bucket; a larger bucket is counted in several passes over its rows.
PASS_WINDOWS = 2_000_000
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def window_hashes(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window of words."""
    return grams(codes, width), grams(mix(codes ^ SECOND), width)


def minimisers(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Run hashes of a text, and the minimiser of each of its windows."""
    runs = grams(codes, RUN_WORDS)
    return runs, sliding_least(runs, width - RUN_WORDS + 1)


class Block:
    """Texts of a block: word numbers, super-k-mers that travel, and what to send. Each text comes with the
    minimisers that are repeated somewhere, in order, and the parts of each."""

    def __init__(self, texts: list[tuple[bytes, bytes, np.ndarray, np.ndarray]], width: int, buckets: int, hashes: WordHashes):
        self.width, self.buckets = width, buckets
        numbers: dict[bytes, int] = {}
        number = numbers.setdefault
        words: list[int] = []
        ends = [0]
        self.keys, self.repeated = [], []
        for key, text, least, parts in texts:
            split = text.split()
            if len(split) >= width:
                words.extend([number(w, len(numbers)) for w in split])
                ends.append(len(words))
                self.keys.append(key)
                self.repeated.append((least, parts))
        self.words = list(numbers)
        self.ids = np.array(words, np.uint32)
        self.ends = np.array(ends, np.int64)
        self.codes = hashes.of(self.words)

    def super_kmers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """doc, start (in words of the block), windows, and the number that decides upon the bucket."""
        codes = self.codes[self.ids]
        found = []
        for d, (known, parts) in enumerate(self.repeated):
            lo, hi = self.ends[d], self.ends[d + 1]
            _, least = minimisers(codes[lo:hi], self.width)
            cut = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
            count = np.diff(np.r_[cut, least.size])
            place = np.minimum(np.searchsorted(known, least[cut]), max(known.size - 1, 0))
            goes = known[place] == least[cut] if known.size else np.zeros(cut.size, bool)
            cut, count, place = cut[goes], count[goes], place[goes]
            split = parts[place] > 1
            if split.any():
                # Single windows of a split minimiser, each with its own number.
                each, n = cut[split], count[split]
                at = np.repeat(each - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                part = grams(codes[lo:hi], self.width)[at] % np.repeat(parts[place[split]], n).astype(np.uint64)
                cut, count = np.r_[cut[~split], at], np.r_[count[~split], np.ones(at.size, count.dtype)]
                aim = np.r_[mix(least[cut[: cut.size - at.size]]), mix(least[at] ^ mix(part + np.uint64(1)))]
            else:
                aim = mix(least[cut])
            found.append((np.full(cut.size, d), cut + lo, count, aim))
        if not found:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
        return tuple(np.concatenate([p[k] for p in found]) for k in range(4))

    def rows(self) -> Iterator[tuple]:
        """(bucket, keys, docs, offsets, windows, known, ids, words) of each bucket that gets anything."""
        doc, start, count, aim = self.super_kmers()
        if not doc.size:
            return
        size = count + self.width - 1
        raw = self.ids.tobytes()
        # Equal super-k-mers: the content decides, not the place.
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[4 * s : 4 * (s + n)]) for s, n in zip(start.tolist(), size.tolist(), strict=True)), "u8").reshape(-1, 2)
        _, first, back, times = np.unique(digest[:, 0] ^ mix(digest[:, 1]), return_index=True, return_inverse=True, return_counts=True)
        known = times[back] > 1
        repeats = np.flatnonzero(known)
        yield int(aim[0] % np.uint64(self.buckets)), self.keys, doc[repeats], start[repeats] - self.ends[doc[repeats]], count[repeats], None, None, None
        bucket = (aim[first] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            pick = first[order[lo:hi]]
            spans = np.repeat(start[pick] - np.r_[0, np.cumsum(size[pick])[:-1]], size[pick]) + np.arange(size[pick].sum())
            used, ids = np.unique(self.ids[spans], return_inverse=True)
            yield int(bucket[order[lo]]), self.keys, doc[pick], start[pick] - self.ends[doc[pick]], count[pick], known[pick], ids, [self.words[w] for w in used]


def _packed(values: np.ndarray, kind: str, squeeze) -> bytes:
    return squeeze(np.ascontiguousarray(values, dtype=kind).tobytes())


def pieces(texts: DataFrame, width: int) -> DataFrame:
    """(doc, least, n): the minimisers of each text and how often their runs are in it. A text is known by the
    first 60 bits of its key: should two share them, they only share what travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            docs, least, counts, sizes = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.encode().split()
                if len(words) >= width:
                    runs, windows = minimisers(hashes.of(words), width)
                    own = np.unique(windows[np.flatnonzero(np.r_[True, windows[1:] != windows[:-1]])])
                    runs.sort()
                    docs.append(doc)
                    sizes.append(own.size)
                    least.append(own)
                    counts.append(np.searchsorted(runs, own, "right") - np.searchsorted(runs, own))
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(docs, np.int64), sizes)), pa.array(np.concatenate(least).view(np.int64)), pa.array(np.concatenate(counts), pa.int64())], ["doc", "least", "n"]
                )

    return texts.select("doc", "text").mapInArrow(run, "doc bigint, least bigint, n bigint")


def repeated_minimisers(found: DataFrame) -> DataFrame:
    """(least, n) of the minimisers that occur twice or more. Counts are summed before the shuffle."""
    return found.groupBy("least").agg(F.sum("n").alias("n")).where(F.col("n") > 1)


def sent(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """One row for each block and bucket, and one without words for the runs that a block settles by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def rows(texts: list) -> Iterator[pa.RecordBatch]:
            for bucket, keys, doc, offset, count, known, ids, words in Block(texts, width, buckets, hashes).rows():
                used, local = np.unique(doc, return_inverse=True)
                small = ids is None or not ids.size or len(words) < 1 << 16
                made = {
                    "bucket": [bucket],
                    "keys": [b"".join(keys[d] for d in used)],
                    "doc": [_packed(local, "<u4", squeeze)],
                    "start": [_packed(offset, "<u4", squeeze)],
                    "windows": [_packed(count, "<u4", squeeze)],
                    "known": [None if known is None else _packed(known, "u1", squeeze)],
                    "small": [small],
                    "ids": [None if ids is None else _packed(ids, "<u2" if small else "<u4", squeeze)],
                    "words": [None if words is None else squeeze(b"\n".join(words))],
                }
                yield pa.RecordBatch.from_pydict(made, schema=_SENT)

        texts, held = [], 0
        for batch in batches:
            for key, text, repeated in zip(*(batch.column(k).to_pylist() for k in ("key", "text", "repeated")), strict=True):
                raw = text.encode()
                least = np.array([r["least"] for r in repeated], np.int64).view(np.uint64)
                order = np.argsort(least)
                texts.append((key, raw, least[order], np.array([r["parts"] for r in repeated], np.int64)[order]))
                held += len(raw)
                if held >= BLOCK_BYTES:
                    yield from rows(texts)
                    texts, held = [], 0
        yield from rows(texts)

    return docs.mapInArrow(run, "bucket int, keys binary, doc binary, start binary, windows binary, known binary, small boolean, ids binary, words binary")


_SENT = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("keys", "doc", "start", "windows", "known")), ("small", pa.bool_()), ("ids", pa.binary()), ("words", pa.binary())])


class Parcel:
    """What one block sent to one bucket."""

    def __init__(self, row: dict):
        open_ = zstandard.ZstdDecompressor().decompress
        self.row, self.open = row, open_
        self.doc = np.frombuffer(open_(row["doc"]), "<u4")
        self.start = np.frombuffer(open_(row["start"]), "<u4").astype(np.int64)
        self.windows = np.frombuffer(open_(row["windows"]), "<u4").astype(np.int64)

    def hashes(self, words: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes for each window, super-k-mer after super-k-mer."""
        codes = words.of(self.open(self.row["words"]).split(b"\n"))
        ids = np.frombuffer(self.open(self.row["ids"]), "<u2" if self.row["small"] else "<u4")
        one, two = window_hashes(codes[ids], width)
        # Windows that would run from one super-k-mer into the next are left out.
        size = self.windows + width - 1
        at = np.repeat(np.r_[0, np.cumsum(size)[:-1]] - np.r_[0, np.cumsum(self.windows)[:-1]], self.windows) + np.arange(self.windows.sum())
        return one[at], two[at]

    def runs(self, again: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, first word, end) of each run of windows that occur again."""
        doc = np.repeat(self.doc, self.windows)
        at = np.repeat(self.start - np.r_[0, np.cumsum(self.windows)[:-1]], self.windows) + np.arange(self.windows.sum())
        doc, at = doc[again], at[again]
        if not doc.size:
            return doc, at, at
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])
        last = np.r_[new[1:] - 1, doc.size - 1]
        return doc[new], at[new], at[last] + width

    def output(self, again: np.ndarray, width: int) -> pa.RecordBatch:
        doc, start, end = self.runs(again, width)
        keys = self.row["keys"]
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[16 * d : 16 * d + 16] for d in doc.tolist()], pa.binary()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["key", "start", "end"]
        )


def counted(rows: DataFrame, width: int) -> DataFrame:
    """Runs of windows found more than once, from partitions that hold whole buckets. Compressed parcels are
    kept; windows are opened and sorted by ranges of their hash, as many ranges as their number calls for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        bucket, parcels = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is None:
                    parcel = Parcel(row)
                    yield parcel.output(np.ones(int(parcel.windows.sum()), bool), width)
                    continue
                if row["bucket"] != bucket and parcels:
                    yield from _count_bucket(parcels, words, width)
                    parcels = []
                bucket = row["bucket"]
                parcels.append(Parcel(row))
        if parcels:
            yield from _count_bucket(parcels, words, width)

    return rows.mapInArrow(run, "key binary, start int, end int")


def _count_bucket(parcels: list[Parcel], words: WordHashes, width: int) -> Iterator[pa.RecordBatch]:
    total = sum(int(p.windows.sum()) for p in parcels)
    again = [np.zeros(int(p.windows.sum()), bool) for p in parcels]
    passes = np.uint64(-(-total // PASS_WINDOWS))
    for turn in range(int(passes)):
        held = []
        for p in parcels:
            one, two = p.hashes(words, width)
            mine = np.flatnonzero(one % passes == np.uint64(turn)) if passes > 1 else np.arange(one.size)
            seen = np.frombuffer(p.open(p.row["known"]), "u1").astype(bool)
            held.append((one[mine], two[mine], mine, np.repeat(seen, p.windows)[mine]))
        one, two, seen = (np.concatenate([h[k] for h in held]) for k in (0, 1, 3))
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        group = np.cumsum(np.r_[False, ~same]) if order.size else np.empty(0, np.int64)
        many = np.bincount(group, weights=1 + seen[order]) > 1 if order.size else np.empty(0, bool)
        flags = np.empty(order.size, bool)
        flags[order] = many[group]
        at = 0
        for mark, h in zip(again, held, strict=True):
            mark[h[2]] = flags[at : at + h[2].size]
            at += h[2].size
    for p, mark in zip(parcels, again, strict=True):
        if mark.any():
            yield p.output(mark, width)


def repeated_runs(docs: DataFrame, width: int, text: str) -> DataFrame:
    """(key, runs): for each text with repeated windows its runs of words to remove, as (start, end), from 0.
    They may overlap."""
    key = text_key(F.col(text))
    source = docs.select(key.alias("key"), F.conv(F.substring(F.hex(key), 1, 15), 16, 10).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found = stored(pieces(source, width), "pieces")
    repeated = stored(repeated_minimisers(found), "minimisers")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_PIECES))
    parts = F.ceil(F.col("n") / PART_PIECES).cast("int")
    held = found.drop("n").join(repeated.select("least", parts.alias("parts")).hint("merge"), "least")
    held = held.groupBy("doc").agg(F.collect_set(F.struct("least", "parts")).alias("repeated"))
    candidates = source.join(held.hint("merge"), "doc").select("key", "text", "repeated")
    travelling = sent(candidates, width, buckets).repartition("bucket").sortWithinPartitions("bucket")
    runs = counted(travelling, width)
    return stored(runs.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs")), "runs")


def dedup_substrings(docs: DataFrame, width: int = 35, text: str = "text", out: str = "kept_text", without: Sequence[str] = ()) -> DataFrame:
    """docs with n_words, n_removed and the kept words joined by one blank."""
    runs = repeated_runs(docs, width, text)
    runs = runs.select(F.col("key").alias("_runs_key"), F.col("runs").alias("_runs")).hint("merge")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed") and (c == text or c != out)]
    source = docs.select(*names, text_key(F.col(text)).alias("_text_key"))
    joined = source.join(runs, source["_text_key"] == runs["_runs_key"], "left").drop("_runs_key", "_text_key")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, removed, kept = [], [], []
        texts, cuts = batch.column(text).to_pylist(), batch.column("_runs").to_pylist()
        for each, cut in zip(texts, cuts, strict=True):
            words = (each or "").encode().split()
            counts.append(len(words))
            parts, at = [], 0
            for run in cut or ():
                parts += words[at : max(at, run["start"])]
                at = max(at, run["end"])
            parts += words[at:]
            removed.append(len(words) - len(parts))
            kept.append(b" ".join(parts).decode())
        return [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(out, T.StringType())]
    return arrow_append(joined, fields, compute, ["_runs", *without])
