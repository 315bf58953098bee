"""Small tables with every awkward kind of row, and plain Python versions of what the operators return."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from hostlake.llm.common import prepare

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def awkward_texts() -> list:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "er", "on", "é", "ß", "日本", "A", "x1"]) for _ in range(rng.randint(1, 4)))
    base = [word() for _ in range(120)]
    passage = " ".join(base[:60])
    near = base[:]
    near[100] = "changed"
    line = "A Line that several documents HOLD"
    return [
        None, "", " ", "\n", "one", "one two three", "\x00\x1c\u0085  odd spaces",
        passage, passage, f"before {passage} after", f"{' '.join(word() for _ in range(40))} {passage}",
        " ".join(base), " ".join(near), " ".join(base).upper(),
        f"{line}\nown line of one\n  {line.lower()}\t\n\n", f"x\n{line}", line, "short\nshort", "short",
        "the " * 90, "the " * 50, "İıſK ärger 😀 é 👩‍👩‍👧", "a" * 3000, " ".join(word() for _ in range(30_000)),
    ]


#: Columns called like results and like working columns of the operators.
EXTRA = ["n_words", "hits", "ids", "key", "shard", "kept", "n_tokens", "score", "rank", "line", "bucket", "node", "part", "word", "runs", "size", "p"]


@pytest.fixture(scope="session")
def engine(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): all kinds of texts, each id once."""
    return [(3 * k + 1, t) for k, t in enumerate(awkward_texts())]


def frame(spark, rows, extra=()):
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in extra]
    )
    langs = [None, "en", "de"]
    full = [(d, t, langs[k % 3], None if k % 4 else "s", None if t is None else len(t), *("?" for _ in extra)) for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, schema).repartition(4)


def contamination(docs, items, span=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for d, text in docs:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    found |= windows[k]
                    hit.update(range(i, i + n))
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def components(docs, size, percent=80):
    sets = []
    for _, text in docs:
        w = BLANK_WORD.findall((text or "").translate(LOWER))
        n = min(size, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset())
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for k, (d, _) in enumerate(docs):
        least[find(k)].append(d)
    return [(d, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (d, _) in enumerate(docs)]


def substrings(docs, width):
    words = [BLANK_WORD.findall(t or "") for _, t in docs]
    seen = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = {p for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for p in range(i, i + width)}
        out.append((d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def lines(docs, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    order = lambda d: (d is None, d)
    held = collections.defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(d)
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < least or len(held[key(x)]) < 2 or min(held[key(x)], key=order) == d]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return out
