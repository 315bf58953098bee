"""Operator 7: quality classifier by interpolated modified Kneser-Ney models of trusted text.

Fitting. Trusted documents are those labelled of good quality and not toxic; the models see all of them.
Their words are counted for each language and cut into letter n-grams with marks for both ends. Counts,
continuation counts (distinct letters before a gram), counts of counts with the three discounts, context masses
and the interpolation with the next lower order are joins and groupings of tables sharded by model, language and
gram. The finished table is counted: up to MODEL_CELLS it is broadcast, above that it stays a table, and words meet it
in joins (`score_joined`), with the same results.

There are FOLDS + 1 models: one of all trusted documents, and for each fold of them one of the other folds. Trusted
documents are scored by the model that has not seen them, all others by the model of all. So the scores of trusted
documents, which set the limits, are those of unseen text.

Scoring. A word takes the likeliest of the languages' models, so that quotations in another language are no
fault. A document has four perplexities per letter: of all its words, of its three most surprising distinct
words of 4 to 16 letters (peak), of the one most surprising of them (worst), and of the most surprising of all
other words: short or long ones, and those with digits or signs inside (odd). The first rises with noise, the
others with foul or foreign matter that a long text would otherwise hide.

Decision. Limits are quantiles over all trusted documents, for each language and class of length (powers of two of the
number of distinct words). A class counts its own documents in full, those of other classes less by a power of 16 for
each step between, and, as so many documents as PRIOR_DOCS, all languages' documents weighted likewise: few
documents lean on the others smoothly, there is no least number. A document above any limit is rejected. Languages
without trusted documents, NULL among them, have the limits of all languages. Without any trusted document
nothing is rejected.

Rows: NULL or empty texts have no words, perplexity 1 and are kept. Repeated rows are scored each. Labels of
NULL id or NULL values are not trusted; an id labelled both ways is not trusted. Other columns pass through;
those called like results are replaced. Scored documents are written to the shared folder once, as limits come from
their scores.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlake.llm.common import arrow_append, stored, worker_state
from hostlake.llm.wordhash import STEP, mix

ORDER = 4
START, END = "\x02", "\x03"
PEAK_WORDS = 3
QUANTILE = 0.995
FOLDS = 2
#: Weight of all languages' documents in the limits of one language, and how many times less a class next to one counts.
PRIOR_DOCS = 100
STEP_WEIGHT = 16
#: Limits are read off counts by steps of a hundredth of a power of ten, upwards.
BINS = 100
EDGES = ".,;:!?\"'()"
#: Words remembered, and words of texts taken together.
MAX_WORDS = 130_000
BLOCK_WORDS = 40_000
#: Grams of a model looked up together while it is made.
FILL_GRAMS = 100_000
BROADCAST_ROWS = 1_000_000
#: Grams times languages of all models that may be broadcast: some 100 MB.
MODEL_CELLS = 12_000_000


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(good).alias("good")).where("good").select("doc_id")


def few(rows: DataFrame) -> DataFrame:
    """A stored table, for broadcast if its rows are counted to be few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def grams_of(cut: DataFrame, order: int) -> DataFrame:
    """(model, lang, k, gram, c) for each order k: counts of the highest order; below it, the number of different
    letters before a gram, and plain counts of grams at the start of a word. `cut`: grams of all places, with n."""
    raw = stored(cut.groupBy("model", "lang", "gram").agg(F.sum("n").alias("c")), "grams")
    tables = [raw.where(F.length("gram") == order)]
    for k in range(order - 1, 0, -1):
        before = tables[0].groupBy("model", "lang", F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("c"))
        starting = raw.where((F.length("gram") == k) & F.col("gram").startswith(START)) if k > 1 else None
        tables.insert(0, before if starting is None else before.unionByName(starting))
    leveled = [t.select("model", "lang", F.lit(k).alias("k"), "gram", "c") for k, t in enumerate(tables, 1)]
    return stored(functools.reduce(DataFrame.unionByName, leveled), "counts")


def _discounts(counts: DataFrame) -> DataFrame:
    """(model, lang, k, d1, d2, d3) of modified Kneser-Ney from the counts of counts."""
    n = [F.greatest(F.sum((F.col("c") == k).cast("int")), F.lit(1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.01)), F.lit(float(k))).alias(f"d{k}") for k in (1, 2, 3)]
    return counts.groupBy("model", "lang", "k").agg(*n).select("model", "lang", "k", *d)


def training_sample(labels: DataFrame) -> DataFrame:
    """(doc_id, fold) of all trusted documents."""
    return stored(trusted_ids(labels).select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")), "sample")


def models(docs: DataFrame, sample: DataFrame, order: int = ORDER) -> DataFrame:
    """(model, lang, gram, p, back): interpolated probability of the last letter of a gram, and the mass that a gram
    as a context leaves to lower orders (NULL if it never is one). The gram '' has the uniform probability. Model FOLDS is
    that of all trusted documents; model k has not seen fold k."""
    texts = docs.select("doc_id", "lang", "text").join(few(sample), "doc_id").select("fold", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    words = (
        texts.select("fold", "lang", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")).alias("word"))
        .where("word != ''")
        .groupBy("fold", "lang", "word")
        .agg(F.count("*").alias("n"))
    )
    seen_by = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda m: m != F.col("fold"))
    marked = words.select("fold", "lang", "n", F.concat(F.lit(START), "word", F.lit(END)).alias("w"))
    cut = marked.select("fold", "lang", "n", "w", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("end")).select(
        "fold", "lang", "n", F.expr(f"substring(w, greatest(end - {order - 1}, 1), least(end, {order}))").alias("gram")
    )
    counts = grams_of(cut.groupBy("fold", "lang", "gram").agg(F.sum("n").alias("n")).withColumn("model", F.explode(seen_by)), order)
    of_count = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    # A row for each model, language and order.
    spread = counts.join(few(stored(_discounts(counts), "discounts")), ["model", "lang", "k"]).select(
        "model", "lang", "k", "gram", "c", F.expr("substring(gram, 1, length(gram) - 1)").alias("context"), of_count.alias("d")
    )
    mass = stored(spread.groupBy("model", "lang", "k", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("back")), "mass")
    own = stored(
        spread.join(mass, ["model", "lang", "k", "context"]).select(
            "model", "lang", "k", "gram", F.substring("gram", 2, order).alias("shorter"), ((F.col("c") - F.col("d")) / F.col("total")).alias("a"), "back"
        ),
        "own",
    )
    lower = counts.where("k = 1").groupBy("model", "lang").agg((1 / (F.count("*") + 1)).alias("p")).select("model", "lang", F.lit("").alias("gram"), "p")
    probabilities = [lower]
    for k in range(1, order + 1):
        below = lower.select("model", "lang", F.col("gram").alias("shorter"), F.col("p").alias("below"))
        joined = own.where(F.col("k") == k).join(below, ["model", "lang", "shorter"])
        lower = stored(joined.select("model", "lang", "gram", (F.col("a") + F.col("back") * F.col("below")).alias("p")), "order")
        probabilities.append(lower)
    p = functools.reduce(DataFrame.unionByName, probabilities)
    return stored(p.join(mass.select("model", "lang", F.col("context").alias("gram"), "back"), ["model", "lang", "gram"], "full"), "model")


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, p, back) of the model of all trusted documents."""
    return models(docs, training_sample(labels), order).where(F.col("model") == FOLDS).drop("model")


class Letters:
    """The models of all languages. Grams are found by a hash of their letters, many at a time."""

    def __init__(self, rows: list[tuple[str, str, float | None, float | None]], order: int):
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        self.fill(*(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)), order)

    @classmethod
    def of(cls, model: pa.Table, order: int) -> Letters:
        """From columns lang, gram, p, back."""
        made = cls.__new__(cls)
        made.fill(*(model.column(c).combine_chunks() for c in ("lang", "gram", "p", "back")), order)
        return made

    def fill(self, lang: pa.Array, gram: pa.Array, p: pa.Array, back: pa.Array, order: int) -> None:
        self.order = order
        lang, gram = lang.dictionary_encode(), gram.dictionary_encode()
        self.langs, grams = lang.dictionary.to_pylist(), gram.dictionary.to_pylist()
        at = gram.indices.to_numpy(), lang.indices.to_numpy()
        #: log10 of the last letter of a gram, and of what it leaves to lower orders; the last row is no gram.
        self.p = np.full((len(grams) + 1, len(self.langs)), np.nan)
        self.back = np.zeros((len(grams) + 1, len(self.langs)))
        for table, values in ((self.p, p), (self.back, back)):
            known = values.is_valid().to_numpy(zero_copy_only=False)
            table[at[0][known], at[1][known]] = np.log10(values.drop_null().to_numpy())
        self.empty = grams.index("") if "" in grams else len(grams)
        sizes = np.array([len(g) for g in grams])
        of_size = {size: np.flatnonzero(sizes == size) for size in range(1, order + 1)}
        letters = {size: _letters("".join([grams[k] for k in held])) for size, held in of_size.items()}
        hashes = np.zeros(len(grams), np.uint64)
        for size, held in of_size.items():
            hashes[held] = self.hashes(letters[size], size)[size - 1 :: size]
        self.sorted, self.sorting = self._order(hashes)
        self.short, self.short_sorting = self.sorted, self.sorting
        #: log10 of the last letter of a word's letters so far, or of its last ones, where these are a gram.
        self.full = np.zeros(self.p.shape)
        for size, held in of_size.items():
            for k in range(0, held.size, FILL_GRAMS):
                part, own = letters[size][k * size : (k + FILL_GRAMS) * size], held[k : k + FILL_GRAMS]
                depth = np.tile(np.arange(1, size + 1), own.size)
                self.full[own] = self._backed_off([self.hashes(part, n) for n in range(1, order + 1)], depth, np.arange(size - 1, part.size, size))
        # What has the full order is looked up as a whole only.
        low = np.flatnonzero(sizes < order)
        self.short, self.short_sorting = self._order(hashes[low])
        self.empty = int(np.searchsorted(low, self.empty))
        self.p, self.back = (table[np.r_[low, len(grams)]] for table in (self.p, self.back))

    @staticmethod
    def _order(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sorting = np.argsort(hashes)
        return hashes[sorting], sorting

    @staticmethod
    def hashes(letters: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the last `size` letters at each place; where there are fewer, of no use."""
        out, power = np.zeros(letters.shape, np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for back in range(size):
                out[back:] += (letters[: letters.size - back] + np.uint64(1)) * power
                power = power * STEP
        return mix(out)

    @staticmethod
    def find(hashes: np.ndarray, held: np.ndarray, sorting: np.ndarray) -> np.ndarray:
        """Rows of hashes among those held; len(held) if a hash is not there."""
        if not held.size:
            return np.zeros(hashes.size, np.int64)
        at = np.minimum(np.searchsorted(held, hashes), held.size - 1)
        return np.where(held[at] == hashes, sorting[at], held.size)

    def letter_logs(self, letters: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """log10 of each letter after those before it, a column for each language. depth: how many letters of
        its word, the start mark included, end at a letter."""
        hashes = [self.hashes(letters, size) for size in range(1, self.order + 1)]
        whole = self.find(np.choose(np.minimum(depth, self.order) - 1, hashes), self.sorted, self.sorting)
        out = self.full[whole]
        rare = np.flatnonzero(whole == self.sorted.size)
        if rare.size:
            out[rare] = self._backed_off(hashes, depth, rare)
        return out

    def _backed_off(self, hashes: list[np.ndarray], depth: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The same for the letters at some places, by grams of all sizes. hashes: of each size, at all places."""
        out = np.zeros((at.size, len(self.langs)))
        known = np.zeros(out.shape, bool)
        none = len(self.p) - 1
        for size in range(self.order, 0, -1):
            enough = depth[at] >= size
            p = self.p[np.where(enough, self.find(hashes[size - 1][at], self.short, self.short_sorting), none)]
            now = ~known & ~np.isnan(p)
            out[now] += p[now]
            known |= now
            if size > 1:
                back = self.back[np.where(enough, self.find(hashes[size - 2][at - 1], self.short, self.short_sorting), none)]
            else:
                back = np.broadcast_to(self.back[self.empty], out.shape)
            out += np.where(known, 0.0, back)
        return out + np.where(known, 0.0, self.p[self.empty])

    def words(self, words: list[str], block: int = 8192) -> np.ndarray:
        """log10 of each word in the likeliest language; a block of words at a time bounds the memory."""
        return np.concatenate([self._block(words[k : k + block]) for k in range(0, len(words), block)])

    def _block(self, words: list[str]) -> np.ndarray:
        letters = _letters(START + (END + START).join(words) + END)
        sizes = lengths(words) + 2
        starts = np.cumsum(sizes) - sizes
        depth = np.arange(letters.size) - np.repeat(starts, sizes) + 1
        logs = self.letter_logs(letters, depth)
        logs[starts] = 0  # the start mark is given
        return np.add.reduceat(logs, starts, axis=0).max(axis=1)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Scorer(dict):
    """Numbers of words, under which arrays hold what is known about them."""

    def __init__(self, letters: Letters):
        super().__init__()
        self.letters = letters
        self.log, self.length, self.plain = np.zeros(MAX_WORDS), np.zeros(MAX_WORDS, np.int64), np.zeros(MAX_WORDS, bool)
        self.each, self.uses = np.zeros(MAX_WORDS), np.zeros(MAX_WORDS, np.int64)

    def learn(self, words: list[str]) -> None:
        """Gives numbers to all words of a list; new ones are scored together."""
        asked = set(words)
        new = list(asked - self.keys())
        if len(self) + len(new) > MAX_WORDS:
            self.forget(min(MAX_WORDS // 2, MAX_WORDS - len(asked)))
            new = list(asked - self.keys())
        if not new:
            return
        at = len(self)
        self.log[at : at + len(new)] = self.letters.words(new)
        self.length[at : at + len(new)] = lengths(new) + 1
        self.each[at : at + len(new)] = self.log[at : at + len(new)] / self.length[at : at + len(new)]
        self.plain[at : at + len(new)] = plain(new)
        self.uses[at : at + len(new)] = 0
        self.update(zip(new, range(at, at + len(new)), strict=True))

    def forget(self, most: int) -> None:
        """Keeps at most so many words, those that came in most documents, and never those of one."""
        known = list(self)
        often = np.argsort(-self.uses[: len(known)], kind="stable")[:most]
        often = often[self.uses[often] > 1]
        for held in (self.log, self.length, self.plain, self.each, self.uses):
            held[: often.size] = held[often]
        self.uses[: often.size] //= 2
        self.clear()
        self.update((known[k], at) for at, k in enumerate(often.tolist()))

    def documents(self, texts: list[str]) -> list[tuple]:
        """RESULTS of each text."""
        out, held, size = [], [], 0
        for text in texts:
            words = text.lower().split()
            if len(words) > BLOCK_WORDS:
                out += self._together(held)
                held, size = [], 0
                out.append(self._long(words))
                continue
            if size + len(words) > BLOCK_WORDS:
                out += self._together(held)
                held, size = [], 0
            held.append(words)
            size += len(words)
        return out + self._together(held)

    def _together(self, held: list[list[str]]) -> list[tuple]:
        self.learn([w for words in held for w in words])
        out = []
        for words in held:
            at, own = self._part(words)
            self.uses[own] += 1
            is_plain = self.plain[own]
            each = self.each[own]
            out.append(self._sum(len(words), own.size, float(self.log[at].sum()), int(self.length[at].sum()), each[is_plain], each[~is_plain]))
        return out

    def _long(self, words: list[str]) -> tuple:
        log, letters, peaks, odd = 0.0, 0, {}, np.empty(0)
        for k in range(0, len(words), BLOCK_WORDS):
            part = words[k : k + BLOCK_WORDS]
            self.learn(part)
            at, own = self._part(part)
            log, letters = log + float(self.log[at].sum()), letters + int(self.length[at].sum())
            # The same word may come again in a later block.
            peaks |= {w: self.each[self[w]] for w in set(part) if self.plain[self[w]]}
            peaks = dict(sorted(peaks.items(), key=lambda p: p[1])[:PEAK_WORDS])
            odd = np.r_[odd, self.each[own[~self.plain[own]]]]
            odd = odd[np.argsort(odd)[:1]]
        return self._sum(len(words), len(set(words)), log, letters, np.array(list(peaks.values())), odd)

    def _part(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return at, np.unique(at)

    @staticmethod
    def _sum(n: int, distinct: int, log: float, letters: int, each: np.ndarray, odd: np.ndarray) -> tuple:
        if not n:
            return NO_WORDS
        most = np.partition(each, PEAK_WORDS - 1)[:PEAK_WORDS] if each.size > PEAK_WORDS else each
        peak, worst, oddest = (10 ** -float(x) if each_.size else 1.0 for x, each_ in ((most.mean() if most.size else 0, most), (most.min(initial=0), most), (odd.min(initial=0), odd)))
        return n, 10 ** (-log / letters), peak, worst, oddest, distinct


NO_WORDS = (0, 1.0, 1.0, 1.0, 1.0, 0)
PERPLEXITIES = {"perplexity": "perplexity_limit", "peak_perplexity": "peak_limit", "worst_perplexity": "worst_limit", "odd_perplexity": "odd_limit"}
RESULTS = [T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in PERPLEXITIES), T.StructField("n_distinct", T.LongType())]


def score(docs: DataFrame, model: DataFrame, order: int = ORDER, without: Sequence[str] = (), by: str | None = None) -> DataFrame:
    """docs with n_tokens, four perplexities and n_distinct of each whole text. `by` names the column that says which
    of the models scores a document; without it, `model` is one model."""
    of_one = [F.col("model")] if by else []
    cells = model.groupBy(*of_one).agg((F.count_distinct("gram") * F.count_distinct("lang")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return (score_broadcast if cells <= MODEL_CELLS else score_joined)(docs, model, order, without, by)


def score_broadcast(docs: DataFrame, model: DataFrame, order: int = ORDER, without: Sequence[str] = (), by: str | None = None) -> DataFrame:
    """score() for a model that was counted to be small enough for every worker."""
    table = model.toArrow()  # counted by score()
    parts = {m: table.filter(pc.equal(table["model"], m)) for m in pc.unique(table["model"]).to_pylist()} if by else {None: table}
    made = {m: Letters.of(part, order) for m, part in parts.items() if part.num_rows}
    name = uuid.uuid4().hex
    letters = docs.sparkSession.sparkContext.broadcast(made)
    del table, parts, made

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        scorers = worker_state(("quality", name), dict)
        which = batch.column(by).to_pylist() if by else [None] * len(texts)
        found: list[tuple] = [()] * len(texts)
        for m in set(which):
            at = [k for k, w in enumerate(which) if w == m]
            if m in letters.value:
                scorer = scorers.get(m) or scorers.setdefault(m, Scorer(letters.value[m]))
                own = scorer.documents([texts[k] for k in at])
            else:
                own = [(len(words), *NO_WORDS[1:-1], len(set(words))) for words in (texts[k].lower().split() for k in at)]
            for k, result in zip(at, own, strict=True):
                found[k] = result
        return [pa.array([f[k] for f in found], pa.float64() if r.dataType == T.DoubleType() else pa.int64()) for k, r in enumerate(RESULTS)]

    return arrow_append(docs, RESULTS, compute, [*without, *([by] if by else [])])


def score_joined(docs: DataFrame, model: DataFrame, order: int = ORDER, without: Sequence[str] = (), by: str | None = None) -> DataFrame:
    """score() for a model of any size. Each distinct word is cut into its letters with those before them; these
    meet the model, of all sizes of grams; sums of letters are the words' logs, and documents meet these word by word."""
    which = F.col(by).cast("int") if by else F.lit(0)
    model = model.withColumn("model", F.col("model").cast("int") if by else F.lit(0))
    numbered = stored(docs.withColumns({"_row": F.monotonically_increasing_id(), "_which": which}), "numbered")
    words = stored(numbered.select("_row", "_which", "text").mapInArrow(_words_of, "_row long, model int, word string, n long, length long, plain boolean"), "words")
    marked = words.select("model", "word", F.concat(F.lit(START), "word", F.lit(END)).alias("w")).distinct()
    cut = marked.select("model", "word", "w", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("end"))
    ends = cut.select("model", "word", F.expr(f"substring(w, greatest(end - {order - 1}, 1), least(end, {order}))").alias("letters"))
    ends = stored(ends, "letters")
    asked = ends.select("model", "letters").distinct().join(model.select("model", "lang").distinct(), "model")
    log = F.lit(0.0)
    for size in range(order + 1):
        gram = F.when(F.length("letters") >= size, F.expr(f"right(letters, {size})"))
        asked = asked.withColumn("_gram", gram).withColumn("_context", F.expr(f"left(_gram, {max(size - 1, 0)})"))
        for held, key in (("p", "_gram"), ("back", "_context"))[: 2 if size else 1]:
            values = model.where(F.col(held).isNotNull()).select("model", "lang", F.col("gram").alias(key), F.log10(held).alias(f"_{held}{size}"))
            asked = asked.join(values, ["model", "lang", key], "left")
        if size:
            shorter = F.coalesce(f"_back{size}", F.lit(0.0)) + log
            log = F.when(F.length("letters") < size, log).otherwise(F.coalesce(f"_p{size}", shorter))
        else:
            log = F.col("_p0")
    logs = stored(asked.select("model", "lang", "letters", log.alias("log")), "letter-logs")
    by_lang = ends.join(logs, ["model", "letters"]).groupBy("model", "word", "lang").agg(F.sum("log").alias("log"))
    of_word = stored(by_lang.groupBy("model", "word").agg(F.max("log").alias("log")), "word-logs")
    each = words.join(of_word, ["model", "word"], "left").withColumn("each", F.col("log") / F.col("length"))
    sums = each.groupBy("_row").agg(
        F.sum("n").alias("_n"),
        F.sum(F.col("n") * F.col("log")).alias("_log"),
        F.sum(F.col("n") * F.col("length")).alias("_letters"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("plain"), F.col("each")))), 1, PEAK_WORDS).alias("_most"),
        F.min(F.when(~F.col("plain"), F.col("each"))).alias("_odd"),
        F.count("*").alias("_distinct"),
    )
    mean = F.aggregate("_most", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_most"), F.lit(0))
    logs_of = [F.col("_log") / F.col("_letters"), mean, F.least(F.array_min("_most"), F.lit(0.0)), F.least("_odd", F.lit(0.0))]
    made = [F.coalesce("_n", F.lit(0).cast("bigint")), *(F.coalesce(F.pow(F.lit(10.0), -x), F.lit(1.0)) for x in logs_of), F.coalesce("_distinct", F.lit(0).cast("bigint"))]
    gone = {r.name for r in RESULTS} | {*without, by}
    kept = [F.col(c) for c in docs.columns if c not in gone]
    return numbered.join(sums, "_row", "left").select(*kept, *(x.alias(r.name) for x, r in zip(made, RESULTS, strict=True)))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text, as the scorer knows them."""
    for batch in batches:
        for row, which, text in zip(*(batch.column(c).to_pylist() for c in ("_row", "_which", "text")), strict=True):
            counts = Counter((text or "").lower().split())
            words = list(counts)
            for k in range(0, len(words), BLOCK_WORDS):
                part = words[k : k + BLOCK_WORDS]
                columns = {
                    "_row": pa.array([row] * len(part), pa.int64()),
                    "model": pa.array([which] * len(part), pa.int32()),
                    "word": pa.array(part, pa.string()),
                    "n": pa.array([counts[w] for w in part], pa.int64()),
                    "length": pa.array(lengths(part) + 1),
                    "plain": pa.array(plain(part)),
                }
                yield pa.RecordBatch.from_pydict(columns)


def lengths(words: list[str]) -> np.ndarray:
    return np.fromiter(map(len, words), np.int64, len(words))


def plain(words: list[str]) -> np.ndarray:
    """Which words have 4 to 16 letters and nothing else inside."""
    bare = list(map(str.strip, words, repeat(EDGES)))
    size = lengths(bare)
    return np.fromiter(map(str.isalpha, bare), bool, len(bare)) & (size >= 4) & (size <= 16)


def length_class() -> Column:
    return F.floor(F.log2(F.greatest("n_distinct", F.lit(1)).cast("double"))).cast("int")


def thresholds(trusted: DataFrame, langs: Sequence[str], quantile: float) -> list[tuple]:
    """(lang, class, the four limits); lang None stands for all others, and for all languages together. What is sent to
    the driver are counts by language, class and step of a perplexity."""
    step = lambda c: F.ceil(F.log10(c) * BINS).cast("int")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("m"), step(c).alias("bin")) for k, c in enumerate(PERPLEXITIES)))).alias("x")
    known = F.when(F.col("lang").isin(*langs), F.col("lang"))
    counts = trusted.select(known.alias("lang"), length_class().alias("class"), each).groupBy("lang", "class", "x.m", "x.bin").agg(F.count("*").alias("n")).collect()
    if not counts:
        return []
    classes = max(r["class"] for r in counts) + 1
    bins = max(r["bin"] for r in counts) + 1
    held = {lang: np.zeros((classes, len(PERPLEXITIES), bins)) for lang in {r["lang"] for r in counts}}
    for r in counts:
        held[r["lang"]][r["class"], r["m"], r["bin"]] += r["n"]
    steps = np.abs(np.subtract.outer(np.arange(classes), np.arange(classes)))
    near = float(STEP_WEIGHT) ** -steps
    together = np.einsum("cd,dmb->cmb", near, sum(held.values()))
    prior = together / together.sum(axis=2, keepdims=True)
    out = []
    for lang in {*held, None}:
        own = np.einsum("cd,dmb->cmb", near, held[lang]) + PRIOR_DOCS * prior if lang is not None else together
        reached = own.cumsum(axis=2) >= quantile * own.sum(axis=2, keepdims=True)
        limits = 10 ** (reached.argmax(axis=2) / BINS)
        out += [(lang, c, *map(float, limits[c])) for c in range(classes)]
    return out


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, without: Sequence[str] = ()) -> DataFrame:
    """docs (doc_id, text, lang, ...) with n_tokens, four perplexities, n_distinct, four limits and accepted."""
    spark = docs.sparkSession
    sample = training_sample(labels)
    model = models(docs, sample)
    folds = few(sample).select(F.col("doc_id").alias("_sample_id"), F.col("fold").alias("_fold"))
    asked = docs.join(folds, docs["doc_id"] == F.col("_sample_id"), "left").withColumn("_model", F.coalesce("_fold", F.lit(FOLDS))).drop("_sample_id", "_fold")
    scored = stored(score(asked, model, without=without, by="_model"), "scored")
    langs = [r[0] for r in model.select("lang").distinct().collect()]  # of trusted documents: as many as there are languages
    trusted = scored.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "n_distinct", *PERPLEXITIES).join(few(sample), "doc_id", "left_semi")
    found = thresholds(trusted, langs, quantile)
    names = ", ".join(f"{c} double" for c in PERPLEXITIES.values())
    limits = F.broadcast(spark.createDataFrame(found, f"_lang string, _class int, {names}"))
    general = limits.where("_lang is null").select("_class", *(F.col(c).alias(f"_{c}") for c in PERPLEXITIES.values()))
    # Longer texts than any trusted one are of the last class.
    last = max((r[1] for r in found), default=0)
    placed = scored.drop(*(c for c in PERPLEXITIES.values() if c in scored.columns)).withColumns(
        {"_lang": F.coalesce("lang", F.lit("")), "_class": F.least(length_class(), F.lit(last))}
    )
    joined = placed.join(limits.where("_lang is not null"), ["_lang", "_class"], "left").join(general, "_class", "left")
    joined = joined.withColumns({c: F.coalesce(c, f"_{c}", F.lit(float("inf"))) for c in PERPLEXITIES.values()})
    accepted = functools.reduce(lambda a, b: a & b, [F.col(c) <= F.col(to) for c, to in PERPLEXITIES.items()])
    return joined.withColumn("accepted", accepted).drop("_lang", "_class", *(f"_{c}" for c in PERPLEXITIES.values()))
