"""Operator 1: benchmark decontamination by winnowing, in DataFrame operations only.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. A window is `span`
consecutive words of an item; an item of fewer words is one window. Windows of t words are found by
fingerprints: of every w consecutive k-gram hashes, with w + k - 1 = t, the least one is kept (the first of
equals). Two texts that share t words share the fingerprints of those words, whatever surrounds them, so
none is missed. Shorter items take k = t, which keeps all k-grams of their length.

1. Fingerprints of all texts meet the fingerprints of the items in a semi-join.
2. Each hit is extended: all windows of the text that contain it are compared word for word with the windows
   of the items. Extending to windows, not to pairs of positions, keeps repetitive texts linear.
3. Overlapping windows are merged into hit words, per distinct text; copies share the result.

Items and their windows are broadcast only if they were counted to be below a bound, else they are
shuffled by hash. Texts are never shuffled whole unless too many of them are hit to broadcast their keys.

Rows: a NULL or empty text has no words and no hits. An item that is NULL or has no words has no window;
repeated items count once per item id, items of NULL id hit words but are not counted or listed. Repeated
documents get a result each. Other columns pass through; those called like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlake.llm.common import ascii_lower, let, stored, text_key

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What is between the same words before lower-casing.
SPLIT_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fingerprints or keys that may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def word_count(text: Column) -> Column:
    """Number of words(). Only the first and the last part of a split text can be empty; an empty text has one part."""

    def parts(found: Column) -> Column:
        first, last = (F.element_at(found, k) == "" for k in (1, -1))
        return (F.size(found) - first.cast("int") - (last & (F.size(found) > 1)).cast("int")).cast("bigint")

    return let(F.split(F.coalesce(text, F.lit("")), SPLIT_ANY_CASE), parts)


def gram_hashes(tokens: Column, k: int) -> Column:
    """Hashes of all k-grams, in order; empty if there are fewer words."""
    return F.when(
        F.size(tokens) >= k,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.xxhash64(F.slice(tokens, i, k))),
    ).otherwise(F.array().cast("array<bigint>"))


def fingerprints(tokens: Column, span: int, k: int) -> Column:
    """Array of (at, print): at is the place, from 1, of the first word of a kept k-gram. The words must be
    a stored column or a variable of let()."""
    width = span - k + 1

    def kept(hashes: Column) -> Column:
        def least(i: Column) -> Column:
            return let(F.slice(hashes, i, width), lambda near: i + F.array_position(near, F.array_min(near)).cast("int") - 1)

        places = F.when(
            F.size(hashes) >= width, F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), least)
        ).otherwise(F.array().cast("array<int>"))
        if width == 1:
            places = F.when(F.size(hashes) > 0, F.sequence(F.lit(1), F.size(hashes))).otherwise(F.array().cast("array<int>"))
        return let(
            F.array_distinct(places),
            lambda p: F.transform(p, lambda at: F.struct(at.alias("at"), F.element_at(hashes, at).alias("print"))),
        )

    return let(gram_hashes(tokens, k), kept)


def gram_size(span: int, full: int) -> int:
    """k of a span of words: half of a full one; a shorter one is a single gram."""
    return span // 2 if span == full else span


def item_windows(items: DataFrame, span: int, item_id: str, text: str) -> DataFrame:
    """(item, length, window): the distinct windows of each item; their words are joined by blanks."""
    tokens = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(span))
    return (
        tokens.withColumn("length", length)
        .select(
            "item",
            "length",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("w") - F.col("length") + 1),
                    lambda i: F.array_join(F.slice(F.col("w"), i, F.col("length")), " "),
                )
            ).alias("window"),
        )
        .distinct()
    )


def find(docs: DataFrame, items: DataFrame, span: int = 10, item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(key, start, length, window): every occurrence of an item's window in a distinct text; start from 1.
    key is text_key() of the text."""
    windows = stored(item_windows(items, span, item_id, item_text), "windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most `span` values
    found = None
    keyed = docs.select(text_key(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    for length in lengths:
        part = _find_length(keyed, windows.where(F.col("length") == length), length, gram_size(length, span))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = keyed.sparkSession.createDataFrame([], "key binary, start int, length int, window string")
    return found


def _find_length(keyed: DataFrame, windows: DataFrame, length: int, k: int) -> DataFrame:
    of_window = fingerprints(F.split("window", " "), length, k)
    prints = windows.select("window").distinct().select(F.explode(of_window).alias("f")).select("f.print").distinct()
    prints = stored(prints, "prints")
    if prints.count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)
    # A text of fewer words than the window is skipped before its words are hashed.
    hits = (
        keyed.select("key", F.explode(let(words(F.col("t")), lambda w: fingerprints(w, length, k))).alias("f"))
        .select("key", "f.at", "f.print")
        .join(prints, "print", "left_semi")
        .groupBy("key")
        .agg(F.collect_set("at").alias("places"))
    )
    hits = stored(hits, "hits")
    candidates = keyed.join(F.broadcast(hits.select("key")) if hits.count() <= BROADCAST_ROWS else hits.select("key"), "key", "left_semi")

    def extended(w: Column) -> Column:
        last = F.size(w) - (length - 1)

        def around(at: Column) -> Column:
            return F.sequence(F.greatest(at - (length - k), F.lit(1)), F.least(at, last))

        starts = F.array_distinct(F.flatten(F.transform(F.col("places"), around)))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice(w, s, length), " ").alias("window")))

    spans = (
        candidates.join(hits, "key")
        .select("key", F.explode(let(words(F.col("t")), extended)).alias("s"))
        .select("key", "s.start", F.lit(length).alias("length"), "s.window")
    )
    exact = windows.select("window").distinct()
    return spans.join(exact, "window", "left_semi").select("key", "start", "length", "window")


def covered(starts: Column) -> Column:
    """Number of words inside any of the (start, length) structs."""

    def step(done: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        new = F.greatest(end - F.greatest(s["start"], done["end"]), F.lit(0))
        return F.struct((done["n"] + new).cast("bigint").alias("n"), F.greatest(done["end"], end).alias("end"))

    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(starts), zero, step, lambda done: done["n"])


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 10, item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, hits (array of start, length), items (sorted ids as strings), n_items and
    contaminated."""
    found = stored(find(docs, items, span, item_id, text, item_text).distinct(), "found")
    spans = found.groupBy("key").agg(F.collect_set(F.struct("start", "length")).alias("hits"))
    window_items = item_windows(items, span, item_id, item_text).where(F.col("item").isNotNull())
    of_text = (
        found.select("key", "window")
        .distinct()
        .join(window_items.select("item", "window"), "window")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    results = spans.join(of_text, "key", "left").select("key", F.array_sort("hits").alias("hits"), "items", covered(F.col("hits")).alias("n_hit"))
    results = stored(results, "contaminated").withColumnRenamed("key", "_key")
    made = ["n_words", "n_hit", "hits", "items", "n_items", "contaminated"]
    names = [c for c in docs.columns if c not in made]
    base = docs.select(
        *names,
        word_count(F.col(text)).alias("n_words"),
        text_key(F.col(text)).alias("_text_key"),
    )
    joined = base.join(results, base["_text_key"] == results["_key"], "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *names,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("hits", F.array().cast("array<struct<start:int,length:int>>")).alias("hits"),
        F.coalesce("items", none).alias("items"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
