"""Laws of keyed writes and of the interval join, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostlake.operators import keyed
from hostlake.operators.interval_join import disjoint_pieces, hot_keys, interval_join

SCHEMA = "k int, g string, v int, inserted_at timestamp_ntz"
T0 = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(k, g, v, T0 + timedelta(seconds=s)) for k, g, v, s in rows], SCHEMA)


def values(df):
    return sorted(((r.k, r.g, r.v, int((r.inserted_at - T0).total_seconds())) for r in df.collect()), key=str)


OLD = [(1, "a", 10, 0), (None, "a", 11, 0), (2, None, 12, 0)]
NEW = [(1, "a", 20, 5), (1, "a", 19, 9), (None, "a", 21, 5), (2, None, 22, 5), (3, "c", 23, 5), (3, "c", None, 6)]
KEYS = ["k", "g"]


def test_ignore_keeps_stored_rows_and_null_keys_match(spark):
    once = keyed.upsert_ignore(frame(spark, OLD), frame(spark, NEW), KEYS, ["v"])
    assert values(once) == sorted([*OLD, (3, "c", 23, 5)], key=str)
    assert values(keyed.upsert_ignore(once, frame(spark, NEW), KEYS, ["v"])) == values(once)


def test_replace_takes_the_new_row_whole(spark):
    once = keyed.upsert_replace(frame(spark, OLD), frame(spark, NEW), KEYS, ["v"])
    expected = [(1, "a", 19, 9), (None, "a", 21, 5), (2, None, 22, 5), (3, "c", 23, 5)]
    assert values(once) == sorted(expected, key=str)
    assert values(keyed.upsert_replace(once, frame(spark, NEW), KEYS, ["v"])) == values(once)


def test_touch_changes_the_last_seen_time_only(spark):
    once = keyed.upsert_touch(frame(spark, OLD), frame(spark, NEW), KEYS, ["v"])
    expected = [(1, "a", 10, 9), (None, "a", 11, 5), (2, None, 12, 5), (3, "c", 23, 6)]
    assert values(once) == sorted(expected, key=str)
    assert values(keyed.upsert_touch(once, frame(spark, NEW), KEYS, ["v"])) == values(once)


def test_touch_leaves_keys_that_do_not_come_again(spark):
    kept = keyed.upsert_touch(frame(spark, OLD), frame(spark, [(9, "z", 1, 7)]), KEYS)
    assert (1, "a", 10, 0) in values(kept)


def test_combine_is_monotone(spark):
    options = dict(greatest=["v"], least=[], latest=["inserted_at"])
    once = keyed.upsert_combine(frame(spark, OLD), frame(spark, [(1, "a", 3, 5), (2, None, 99, 5)]), KEYS, **options)
    assert values(once) == sorted([(1, "a", 10, 5), (None, "a", 11, 0), (2, None, 99, 5)], key=str)


def test_first_per_key_puts_nulls_last(spark):
    first = keyed.first_per_key(frame(spark, [(1, "a", None, 1), (1, "a", 7, 2)]), KEYS, ["v"])
    assert values(first) == [(1, "a", 7, 2)]


def test_delete_matching_keeps_null_keys(spark):
    rows = frame(spark, OLD)
    left = keyed.delete_matching(rows, frame(spark, [(1, "a", 0, 0), (None, "x", 0, 0)]), F.col("k"), F.col("k"))
    assert values(left) == sorted([(None, "a", 11, 0), (2, None, 12, 0)], key=str)


def random_case(seed):
    rng = random.Random(seed)
    # One key holds most of the points.
    points = [(i, 443 if rng.random() < 0.6 else rng.randrange(5), rng.randrange(400)) for i in range(300)]
    spans = []
    for _ in range(120):
        start = rng.randrange(400)
        spans.append((rng.randrange(6), 443 if rng.random() < 0.6 else rng.randrange(5), start, start + rng.choice([-1, 0, 3, 50, 300])))
    return points, spans


@pytest.mark.parametrize("seed,bucket,salts", [(1, 1, 1), (2, 7, 1), (3, 60, 4), (4, 1000, 3)])
def test_interval_join_against_brute_force(spark, seed, bucket, salts):
    points, spans = random_case(seed)
    p = spark.createDataFrame([(i, k, T0 + timedelta(seconds=t)) for i, k, t in points], "id int, port int, at timestamp_ntz")
    s = spark.createDataFrame(
        [(o, k, T0 + timedelta(seconds=a), T0 + timedelta(seconds=b)) for o, k, a, b in spans],
        "pid int, port int, first timestamp_ntz, last timestamp_ntz",
    )
    joined = interval_join(p, s, ["port"], ["pid"], "at", "first", "last", bucket_seconds=bucket, salts=salts, hot_share=0.2)
    got = [(r.id, r.pid) for r in joined.collect()]
    expected = {(i, o) for i, k, t in points for o, key, a, b in spans if k == key and a <= t <= b}
    assert len(got) == len(set(got)), "a pair came out twice"
    assert set(got) == expected


def test_pieces_do_not_overlap(spark):
    _, spans = random_case(5)
    s = spark.createDataFrame(
        [(o, k, T0 + timedelta(seconds=a), T0 + timedelta(seconds=b)) for o, k, a, b in spans],
        "pid int, port int, first timestamp_ntz, last timestamp_ntz",
    )
    pieces = disjoint_pieces(s, ["port"], ["pid"], "first", "last", 20).collect()
    spots = sorted((r.pid, r.port, r._from, r._to) for r in pieces)
    for one, two in zip(spots, spots[1:]):
        if one[:2] == two[:2]:
            assert one[3] < two[2]
    micros = 20 * 1_000_000
    assert all(r._block << r._level == r._from // micros >> r._level << r._level and r._from // micros >> r._level == r._to // micros >> r._level for r in pieces)


@pytest.mark.parametrize("base", [1, 3600])
def test_pieces_grow_with_the_logarithm_of_the_interval(spark, base):
    """Whatever an interval's length, also from before 1970."""
    lengths = [0, 1, base, 3 * base, 1000 * base, 86400 * 400 * base // 3600 + 7]
    s = spark.createDataFrame(
        [(i, 1, T0 - timedelta(days=days), T0 - timedelta(days=days) + timedelta(seconds=n)) for days in (0, 20_000) for i, n in enumerate(lengths)],
        "pid int, port int, first timestamp_ntz, last timestamp_ntz",
    ).withColumn("pid", F.monotonically_increasing_id())
    pieces = disjoint_pieces(s, ["port"], ["pid"], "first", "last", base)
    rows = pieces.groupBy("pid").agg(F.count("*").alias("n"), F.sum(F.col("_to") - F.col("_from") + 1).alias("held")).join(s, "pid").collect()
    assert len(rows) == 2 * len(lengths)
    for r in rows:
        seconds = (r["last"] - r["first"]).total_seconds()
        assert r["held"] == seconds * 1_000_000 + 1
        assert r["n"] <= 2 + 2 * max(1, (int(seconds) // base + 1).bit_length())


def test_a_process_with_many_intervals_is_cut_by_their_starts(spark):
    """Nested, repeated and touching intervals of one process on one port."""
    spans = [(1, 1, T0 + timedelta(seconds=a), T0 + timedelta(seconds=b)) for k in range(300) for a, b in ((k, k), (k, k + 1), (10 * k, 10 * k + 500), (0, 5))]
    s = spark.createDataFrame(spans, "pid int, port int, first timestamp_ntz, last timestamp_ntz")
    p = spark.createDataFrame([(t, 1, T0 + timedelta(seconds=t)) for t in range(-5, 4000, 3)], "id int, port int, at timestamp_ntz")
    joined = interval_join(p, s, ["port"], ["pid"], "at", "first", "last", bucket_seconds=7)
    assert sorted(r.id for r in joined.collect()) == [t for t in range(-5, 4000, 3) if 0 <= t <= 3490]


def test_hot_keys_are_few(spark):
    frame_ = spark.range(1000).selectExpr("if(id < 700, 443, id) as port")
    assert [r.port for r in hot_keys(frame_, ["port"], 0.01).collect()] == [443]
