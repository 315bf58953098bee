"""Operator 5: language-model scores by the likelihood of subword lattices.

A text is its words and an end token. The lattice of a word has an arc for the word itself, if the training
texts have it, and arcs for all pieces of an existing vocabulary (and for bytes of letters without a piece)
between its letters. Each arc has a weight; the probability of a word is the sum over all paths, computed
by a forward recursion in log space. A text is written in one of a few languages, each with weights of its
own; its probability is the sum over languages of prior times product over tokens, so a text need not say
what it is written in.

Learning. Words of all training texts are counted for each language (the most frequent ones; all others and
NULL are one more). The arc of a word gets its count in the language less a discount (n1 / (n1 + 2 n2), from
counts of counts); the mass so freed goes to the counts of all languages, discounted likewise, and from
there to the spelling paths. Piece weights begin with the vocabulary's own order and are re-estimated by
expectation over all distinct training words of the language, each counting once, since what spelling
must explain is new words. Word-initial pieces, the other pieces and the end of a word share out their own
probability, so that all words together have probability 1.

Scale. Distinct words are scored once each, in a table sharded by word. Documents take the most frequent
words (a fixed number) from a broadcast; their other words are joined to the table and summed by row.

Rows: NULL is an empty text: one end token. A NULL id counts as an empty text in the split, which puts it in
training. Repeated rows are learnt and scored each. Other columns pass through, except the text; those called
like results are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlake.llm.common import arrow_append, stored
from hostlake.llm.wordhash import STEP

BLANK = "▁"
HELD_WORDS = 300_000
HEAD_WORDS = 1 << 17
ROUNDS = 2
MOST_LANGUAGES = 8
SLOT_BITS = 18
#: Uses that every piece has besides those found.
ADDED = 0.01


def read_vocabulary(path: str) -> dict[str, float]:
    """Pieces in the vocabulary's order of preference, with Zipf weights; A-Z does not occur in the texts."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {p: 1 / (r + 1) for r, p in enumerate(p for p in pieces if not any("A" <= c <= "Z" for c in p))}


class Pieces:
    """Numbers of the pieces; two more stand for a byte and for the end of a word."""

    def __init__(self, vocabulary: dict[str, float]):
        self.names = [*dict.fromkeys([BLANK, *vocabulary])]
        self.number = {p: k for k, p in enumerate(self.names)}
        self.byte, self.stop = len(self.names), len(self.names) + 1
        self.first = np.array([p.startswith(BLANK) for p in self.names] + [False, False])
        self.longest = max(map(len, self.names))
        zipf = np.array([vocabulary.get(p, 1e-6) for p in self.names])
        #: First counts: the vocabulary's order, on a scale on which the added uses are small.
        self.start = np.r_[1e6 * zipf / zipf.sum(), 1e3, 4e5]
        # Pieces are looked up by a hash of their letters, many at a time: a few tables of places, each for
        # those that found theirs taken in the ones before.
        self.hashes = np.array([self._hash(p) for p in self.names], np.uint64)
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(len(self.names))
        while left.size:
            factor = np.uint64((2 * len(self.tables) + 1) * int(STEP) % (1 << 64))
            table = np.full(1 << SLOT_BITS, -1, np.int32)
            slots = (self.hashes[left] * factor) >> np.uint64(64 - SLOT_BITS)
            table[slots[::-1]] = left[::-1]
            self.tables.append((factor, table))
            left = left[table[slots] != left]

    @staticmethod
    def _hash(piece: str) -> int:
        """Letters from the right, so that hashes grow to the left."""
        return sum((ord(c) + 1) * pow(int(STEP), k, 1 << 64) for k, c in enumerate(reversed(piece))) % (1 << 64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int32)
        for factor, table in self.tables:
            at = table[(hashes * factor) >> np.uint64(64 - SLOT_BITS)]
            np.copyto(out, at, where=(at >= 0) & (self.hashes[at] == hashes))
        return out

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """Log probabilities: initial pieces share out the first step of a word; the other pieces, bytes and
        the end share out every later one."""
        counts = counts + ADDED
        logs = np.log(counts) - np.where(self.first, np.log(counts[self.first].sum()), np.log(counts[~self.first].sum()))
        logs[self.byte] -= math.log(256)  # a byte piece is any of the bytes
        return logs


def by_length(words: list[str], most: int = 1 << 16) -> Iterator[list[int]]:
    """Places of words of equal length, in groups of bounded size."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        length = len(words[order[at]])
        end = at
        while end < len(order) and len(words[order[end]]) == length and (end - at) * length < most:
            end += 1
        yield order[at:end]
        at = end


class Lattice:
    """Lattices of words of one length, side by side. logs: weights of pieces, one column for each language."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.pieces = pieces
        size = len(words[0]) + 1
        self.size, self.reach = size, min(pieces.longest, size)
        letters = np.frombuffer("".join(BLANK + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), size)
        codes = letters.astype(np.uint64) + np.uint64(1)
        self.ids = np.full((len(words), size, self.reach), -1, np.int32)
        hashes, power = np.zeros(codes.shape, np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for back in range(self.reach):  # pieces of back + 1 letters, at all places at once
                hashes[:, back:] += codes[:, : size - back] * power
                self.ids[:, back:, back] = pieces.find(hashes[:, back:])
                power = power * STEP
        escaped = (letters >= 0xDC80) & (letters <= 0xDCFF)  # bytes that are no UTF-8
        self.bytes = np.where(escaped, 1.0, 1.0 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000))[:, 1:]

    def arcs(self, end: int, logs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(start, words, weights, piece numbers) of the arcs to a place; no numbers for the letter spelt in
        bytes."""
        for back in range(min(end, self.reach)):
            ids = self.ids[:, end - 1, back]
            rows = np.flatnonzero(ids >= 0)
            if rows.size:
                yield end - 1 - back, rows, logs[ids[rows]], ids[rows]
        if end > 1:
            yield end - 1, np.arange(len(ids)), self.bytes[:, end - 2, None] * logs[self.pieces.byte], None

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all paths to each place: places, words, languages."""
        shape = (self.ids.shape[0], logs.shape[1])
        alpha = np.full((self.size + 1, *shape), -np.inf)
        alpha[0] = 0
        for end in range(1, self.size + 1):
            top, terms = np.full(shape, -np.inf), []
            for start, rows, weight, _ in self.arcs(end, logs):
                term = alpha[start, rows] + weight
                top[rows] = np.maximum(top[rows], term)
                terms.append((rows, term))
            total = np.zeros(shape)
            for rows, term in terms:
                total[rows] += np.exp(term - top[rows])
            alpha[end] = top + np.log(total)
        return alpha

    def expected(self, logs: np.ndarray) -> np.ndarray:
        """Expected uses of the pieces, for one language. The share of paths that go through a place is handed
        back along the arcs that lead to it, each taking its part of the place's forward weight."""
        alpha = self.forward(logs)[:, :, 0]
        through = np.zeros(alpha.shape)
        through[-1] = 1
        uses = np.zeros(len(logs))
        for end in range(self.size, 0, -1):
            for start, rows, weight, ids in self.arcs(end, logs):
                share = np.exp(alpha[start, rows] + weight[:, 0] - alpha[end, rows]) * through[end, rows]
                through[start, rows] += share
                if ids is None:
                    uses[self.pieces.byte] += float((share * self.bytes[:, end - 2]).sum())
                else:
                    np.add.at(uses, ids, share)
        uses[self.pieces.stop] += self.ids.shape[0]
        return uses


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Batches put together: lattices of many words of one length cost little more than those of a few."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def words_of(text: str | None) -> list[bytes]:
    # bytes.lower() and bytes.split() know A-Z and the ASCII blanks only, which is what is wanted.
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, text: str, languages: int) -> DataFrame:
    """(word, c, n): how often training texts of each language, and all texts, have a word. Summed in the
    tasks first."""
    source = docs.select(F.when(F.col("_train"), F.col("_lang")).otherwise(-1).alias("lang"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def rows(held: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counter), pa.binary()), pa.array([lang] * len(counter), pa.int32()), pa.array(list(counter.values()), pa.int64())], ["word", "lang", "n"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) >= HELD_WORDS:
                yield from rows(held)
                held = {}
        yield from rows(held)

    found = source.mapInArrow(run, "word binary, lang int, n bigint")
    each = F.array(*[F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)) for k in range(languages)])
    return found.groupBy("word").agg(each.alias("c"), F.sum("n").alias("n"))


def piece_weights(counts: DataFrame, pieces: Pieces, languages: int, rounds: int = ROUNDS) -> np.ndarray:
    """Re-estimated weights, one column for each language. What tasks send and the driver gets is a number
    for each piece and language."""
    context = counts.sparkSession.sparkContext
    logs = np.repeat(pieces.weights(pieces.start)[:, None], languages, axis=1)
    for _ in range(rounds):
        current = context.broadcast((pieces, logs))

        def run(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            own, weights = current.value
            uses = np.zeros((len(weights), languages))
            for batch in gathered(batches):
                c = np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, languages)
                words = [w.decode("utf-8", "surrogateescape") for w in batch.column(0).to_pylist()]
                for k in range(languages):
                    mine = [words[j] for j in np.flatnonzero(c[:, k])]
                    for group in by_length(mine):
                        uses[:, k] += Lattice(own, [mine[j] for j in group]).expected(weights[:, k : k + 1])
            piece, lang = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(uses[piece, lang])], ["piece", "lang", "uses"])

        found = counts.select("word", "c").mapInArrow(run, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        uses = np.zeros_like(logs)
        for r in found.collect():
            uses[r[0], r[1]] = r[2]
        logs = np.stack([pieces.weights(uses[:, k]) for k in range(languages)], axis=1)
    return logs


class Mixture:
    """Discounted counts of a language, of all languages, and spelling, each giving what it can spare."""

    def __init__(self, sums: np.ndarray, ends: np.ndarray):
        """sums: for each language and, last, for all: tokens without ends, distinct words, n1, n2."""
        self.ends = np.r_[ends, ends.sum()].astype(float)
        self.tokens = sums[:, 0] + self.ends
        self.distinct = sums[:, 1] + (self.ends > 0)
        self.discount = np.where(sums[:, 2] > 0, sums[:, 2] / np.maximum(sums[:, 2] + 2 * sums[:, 3], 1), 0.5)
        self.spared = np.where(self.tokens > 0, self.discount * self.distinct / np.maximum(self.tokens, 1), 1.0)
        self.floor = self.tokens[-1] + 0.5 * (self.distinct[-1] + 1)
        self.prior = np.log10((ends + 0.5) / (ends + 0.5).sum())

    def log10(self, c: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """c: counts by language and, last, of all; spelt: natural logs by language."""
        own = np.maximum(c - self.discount, 0) / np.maximum(self.tokens, 1)
        counted = own[:, :-1] + self.spared[:-1] * own[:, -1:]
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(counted), np.log(self.spared[:-1] * self.spared[-1]) + spelt) / math.log(10)

    def end(self) -> np.ndarray:
        """The end token is counted like a word, but not spelt."""
        return self.log10(self.ends[None, :], np.full((1, self.ends.size - 1), -np.inf if self.ends[-1] else 0.0))[0]


def token_scores(counts: DataFrame, pieces: Pieces, logs: np.ndarray, mixture: Mixture) -> DataFrame:
    """(word, n, known, base, score): log10 probabilities of each distinct word, score for each language."""
    model = counts.sparkSession.sparkContext.broadcast((pieces, logs, mixture))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights, mix = model.value
        languages = weights.shape[1]
        for batch in gathered(batches):
            c = np.array(batch.column(1).to_pylist(), float).reshape(-1, languages)
            c = np.concatenate([c, c.sum(axis=1, keepdims=True)], axis=1)
            words = [w.decode("utf-8", "surrogateescape") for w in batch.column(0).to_pylist()]
            spelt = np.empty((len(words), languages))
            for group in by_length(words):
                spelt[group] = Lattice(own, [words[j] for j in group]).forward(weights)[-1] + weights[own.stop]
            scores = mix.log10(c, spelt)
            ends = np.arange(len(words) + 1, dtype=np.int32) * languages
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).chunk(0), batch.column(2).chunk(0), pa.array(c[:, -1] > 0), pa.array(np.log10((c[:, -1] + 0.5) / mix.floor)), pa.ListArray.from_arrays(pa.array(ends), pa.array(scores.ravel()))],
                ["word", "n", "known", "base", "score"],
            )

    return counts.select("word", "c", "n").mapInArrow(run, "word binary, n bigint, known boolean, base double, score array<double>")


def learn(docs: DataFrame, counts: DataFrame, languages: int) -> Mixture:
    parts = [F.col("c")[k] for k in range(languages)]
    total = sum(parts[1:], parts[0])
    cells = []
    for c in [*parts, total]:
        cells += [F.coalesce(F.sum(c), F.lit(0)), *(F.count(F.when(test, 1)) for test in (c > 0, c == 1, c == 2))]
    sums = np.array(list(counts.agg(*[x.alias(f"x{k}") for k, x in enumerate(cells)]).first()), float).reshape(-1, 4)
    ends = np.zeros(languages)
    for r in docs.where("_train").groupBy("_lang").count().collect():
        ends[r[0]] = r[1]
    return Mixture(sums, ends)


def frequent(scores: DataFrame, most: int, languages: int) -> tuple[dict[bytes, int], np.ndarray]:
    """The words of at least 2^k occurrences, with the least k for which they are no more than `most`: their
    rows in a table of known, base and scores."""
    counts = scores.agg(*[F.count(F.when(F.col("n") >= (1 << k), 1)).alias(f"k{k}") for k in range(62)]).first()
    k = next((k for k in range(62) if counts[k] <= most), 62)
    head = scores.where(F.col("n") >= (1 << k)).select("word", "known", "base", "score").toArrow()
    words = {w: k for k, w in enumerate(head.column("word").to_pylist())}
    rows = [head.column(c).to_numpy().astype(float)[:, None] for c in ("known", "base")]
    each = np.array(head.column("score").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, languages)
    return words, np.concatenate([*rows, each], axis=1)


def with_language(docs: DataFrame, lang: str, most: int = MOST_LANGUAGES) -> tuple[DataFrame, int]:
    """docs with _lang: the number of a frequent training language, or the last number for all else."""
    if lang not in docs.columns:
        return docs.withColumn("_lang", F.lit(0)), 1
    known = docs.where(F.col("_train") & F.col(lang).isNotNull()).groupBy(lang).count().orderBy(F.desc("count"), lang).limit(most).collect()
    number = F.lit(len(known))
    for k, r in enumerate(known):
        number = F.when(F.col(lang) == r[0], F.lit(k)).otherwise(number)
    return docs.withColumn("_lang", number), len(known) + 1


def score_texts(
    docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", head_words: int = HEAD_WORDS
) -> DataFrame:
    """docs without the text, with held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    split = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))
    docs, languages = with_language(docs.withColumn("_train", split != 1), lang)
    counts = stored(word_counts(docs, text, languages), "words")
    mixture = learn(docs, counts, languages)
    pieces = Pieces(read_vocabulary(vocabulary_path))
    logs = piece_weights(counts, pieces, languages)
    scores = stored(token_scores(counts, pieces, logs, mixture), "scores")
    shared = docs.sparkSession.sparkContext.broadcast(frequent(scores, head_words, languages))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        get, values = shared.value[0].get, shared.value[1]
        n, sums, tails = [], [], []
        for t in batch.column(text).to_pylist():
            found = words_of(t)
            at = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
            inside = at >= 0
            n.append(len(found) + 1)
            sums.append(values[at[inside]].sum(axis=0))
            tails.append([found[k] for k in np.flatnonzero(~inside)])
        total = np.array(sums).reshape(-1, values.shape[1])
        ends = np.arange(len(n) + 1, dtype=np.int32) * values.shape[1]
        return [pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel())), pa.array(tails, pa.list_(pa.binary()))]

    fields = [T.StructField("_n", T.LongType()), T.StructField("_sums", T.ArrayType(T.DoubleType())), T.StructField("_tail", T.ArrayType(T.BinaryType()))]
    made = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", text)
    names = [c for c in docs.columns if c not in made and c not in ("_train", "_lang")]
    # Rows are numbered as they are written, so that the numbers stay what they are.
    headed = stored(arrow_append(docs, fields, compute, [text]).select(*names, "_train", *(f.name for f in fields), F.monotonically_increasing_id().alias("_row")), "headed")
    cells = [F.col("known").cast("double"), F.col("base"), *(F.col("score")[k] for k in range(languages))]
    tail = (
        headed.select("_row", F.explode("_tail").alias("word"))
        .join(scores.select("word", "known", "base", "score"), "word")
        .groupBy("_row")
        .agg(*[F.sum(c).alias(f"_t{k}") for k, c in enumerate(cells)])
    )
    whole = [F.col("_sums")[k] + F.coalesce(F.col(f"_t{k}"), F.lit(0.0)) for k in range(len(cells))]
    ends = mixture.ends[-1] > 0
    by_lang = [whole[2 + k] + float(mixture.end()[k] + mixture.prior[k]) for k in range(languages)]
    best = F.greatest(*by_lang) if languages > 1 else by_lang[0]
    rest = [F.pow(F.lit(10.0), x - F.col("_best")) for x in by_lang]
    return (
        headed.join(tail, "_row", "left")
        .withColumn("_best", best)
        .select(
            *names,
            (~F.col("_train")).alias("held_out"),
            F.col("_n").alias("n_tokens"),
            (F.round(whole[0]) + int(ends)).cast("bigint").alias("n_known"),
            F.lit(int(mixture.tokens[-1])).cast("bigint").alias("train_tokens"),
            (whole[1] + float(np.log10((mixture.ends[-1] + 0.5) / mixture.floor))).alias("base_score"),
            (F.col("_best") + F.log10(sum(rest[1:], rest[0]))).alias("score"),
        )
    )
