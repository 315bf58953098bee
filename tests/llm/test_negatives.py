"""Hard negatives against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlake.llm import hard_negatives as negatives

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("block", T.StringType())])


def brute(rows, every=10):
    seen, vectors = set(), []
    for i, vec, label, _ in rows:
        if i is None or label is None or not vec or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in vec):
            continue
        q = tuple(math.floor(256 * x) for x in vec)
        if (i, label, q) not in seen:
            seen.add((i, label, q))
            vectors.append((i, label, q))
    out = collections.Counter()
    for a, label, q in vectors:
        if a % every:
            continue
        near = [(-max(min(sum(x * y for x, y in zip(q, r)), 2**63 - 1), -(2**63)), b, other) for b, other, r in vectors if b != a and len(r) == len(q)]
        for p, positive, _ in sorted(x for x in near if x[2] == label)[:5]:
            hard = sorted(x for x in near if x[2] != label and -80 * p <= -100 * x[0] <= -100 * p)[:5]
            for rank, (n, b, _) in enumerate(hard, 1):
                out[a, positive, rank, b, -p, -n] += 1
    return out


def got(df):
    return collections.Counter(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def mined(engine, rows, every=10):
    rows = [(i, vec and [None if x is None else float(x) for x in vec], label, extra) for i, vec, label, extra in rows]
    return got(negatives.mine(engine.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") % every == 0))


def clustered(n, dim=8, labels=3, seed=1):
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = rng.normal(size=(labels * 2, dim))
    kind = rng.integers(0, labels * 2, n)
    return [(k, (centres[kind[k]] + 0.4 * rng.normal(size=dim)).tolist(), int(kind[k] % labels), None) for k in range(n)]


@pytest.mark.parametrize("sizes", [(2, 2, 3, 1, 1), (9, 128, 64, 32, 256)])
def test_equals_brute_force(engine, monkeypatch, sizes):
    for name, value in zip(("BLOCK_BITS", "LEAST_BLOCK", "ZONES", "PACKS", "SLICE"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, value)
    monkeypatch.setattr(negatives, "BLOCK", 1 << sizes[0])
    rows = clustered(400)
    assert mined(engine, rows) == brute(rows)


def test_awkward_rows(engine):
    rng = random.Random(2)
    near = lambda: [rng.choice([0.0, 0.25, 0.5, -0.25]) for _ in range(4)]
    rows = [(k, near(), rng.randrange(3), None) for k in range(300)]
    hot = [(1000 + k, [0.5, 0.5, 0.5, 0.5], k % 2, None) for k in range(700)]
    odd = [
        (None, [1.0, 0, 0, 0], 1, None), (2001, None, 1, None), (2002, [], 1, None), (2003, [1.0, None, 0, 0], 1, None), (2004, [float("nan"), 0, 0, 0], 1, None),
        (2005, [float("inf"), 0, 0, 0], 1, None), (2006, [1.0, 1, 1, 1], None, None), (2010, [1e307, 0.0, 0.0, 0.0], 1, None), (2020, [0.0] * 4, 1, None),
        (3000, [0.5], 1, None), (3001, [0.25], 1, None), (3002, [0.45], 2, None), (3010, [1.0, 2.0], 5, None), (2000, [0.5, 0.5, 0.5, 0.5], 2, None),
        (4000, [1e12, 1e12, -1.0, 3.0, 1.0], 1, None), (4001, [1e12, 1e11, 1.0, 3.0, 1.0], 1, None), (4002, [1e6, 3e12, 1.0, 3.0, 1.0], 1, None), (4003, [9e11, 1e11, 1.0, 3.0, 2.0], 2, None), (4004, [1e3, 1e3, 1.0, 3.0, 2.0], 2, None), (4005, [1e4, 1e3, 1.0, 3.0, 2.0], 1, None),
    ]
    rows += hot + odd + [rows[0], rows[0], rows[10], (10, [0.5, 0.5, 0.0, 0.0], 1, None), (-20, [0.5, 0.5, 0.25, 0.0], 1, None)]
    found = mined(engine, rows)
    want = brute(rows)
    assert {k: v for k, v in found.items() if k[0] not in (10,)} == {k: v for k, v in want.items() if k[0] not in (10,)}
    assert sum(v for k, v in found.items() if k[0] == 10) == sum(v for k, v in want.items() if k[0] == 10)


def test_empty_and_lonely(engine):
    assert mined(engine, []) == {}
    assert mined(engine, [(0, [1.0], 1, None)]) == {}
    assert mined(engine, [(0, [1.0], 1, None), (1, [1.0], 2, None)]) == {}


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_steps_to_neighbours(dims, bits):
    """The curve visits each point of a grid once, and goes on to a neighbour."""
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    places = [p.tobytes() for p in negatives.curve_places(points, bits)]
    order = sorted(range(len(points)), key=places.__getitem__)
    assert len(set(places)) == len(points)
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_prune():
    rng = np.random.Generator(np.random.PCG64(3))
    q = np.floor(256 * np.array([v for _, v, _, _ in clustered(600, dim=4)]))
    keys = negatives.hilbert_keys(q)
    q = q[sorted(range(len(q)), key=keys.__getitem__)]
    lo, hi = (np.stack([f(q[k : k + 20], axis=0) for k in range(0, 600, 20)]) for f in (np.min, np.max))
    a = q[rng.integers(0, 600, 50)]
    least, most = negatives.bounds(a, lo, hi)
    s = negatives.scores(a, q).reshape(50, 30, 20)
    assert (s >= least[:, :, None]).all() and (s <= most[:, :, None]).all()
    best = np.sort(s.reshape(50, -1), axis=1)[:, -5]
    assert (most < best[:, None]).mean() > 0.5
