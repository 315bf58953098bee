"""Equality + interval join for many points and many intervals.

Time is cut into blocks of a base width and of its multiples by powers of two. The intervals of an owner are made
disjoint, and each is covered by the least set of aligned blocks: two blocks a width at most, and the base
blocks at its ends, which are clipped. So pieces grow with the logarithm of an interval's length, whatever the base
width is. A point lies in one block of each width, and probes one a width up to that of the longest interval;
(keys, width, block) is an equi-join key. A point is in one piece of an owner at most, so no pair is found twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.functions.clock import epoch_micros

_BUCKET, _LEVEL, _FROM, _TO = "_bucket", "_level", "_from", "_to"
# Aligned blocks of the base blocks _lo.._hi-1, from narrow to wide: on each level what sticks out at either side.
_BLOCKS = """
filter(flatten(transform(sequence(0, length(bin(_hi - _lo)) - 1), k -> array(
  named_struct('level', k, 'block', -shiftright(-_lo, k), 'out', -shiftright(-_lo, k) < shiftright(_hi, k) AND shiftright(-_lo, k) & 1 = 1),
  named_struct('level', k, 'block', shiftright(_hi, k) - 1, 'out', -shiftright(-_lo, k) < shiftright(_hi, k) AND shiftright(_hi, k) & 1 = 1)
))), b -> b.out)"""


def _bucket_of(micros: str, width: int) -> Column:
    """Number of the bucket that holds a time; integers only, rounding down before 1970 too."""
    return F.expr(f"({micros} - pmod({micros}, {width}L)) div {width}L")


def disjoint(intervals: DataFrame, group: Sequence[str], width: int) -> DataFrame:
    """Intervals (_s, _e) without what earlier ones of their group hold.

    How far earlier ones reach is known bucket by bucket of their starts first, then within a bucket, so no task
    has to order more than the different starts of a group inside one bucket.
    """
    longest = intervals.groupBy(*group, "_s").agg(F.max("_e").alias("_e")).withColumn(_BUCKET, _bucket_of("_s", width))
    earlier = Window.partitionBy(*group).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    reaches = longest.groupBy(*group, _BUCKET).agg(F.max("_e").alias("_top")).withColumn("_before", F.max("_top").over(earlier)).drop("_top")
    within = Window.partitionBy(*group, _BUCKET).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    # Greatest passes NULL over: the first interval of all has nothing before it.
    earlier_reach = reaches.select(*[F.col(c).alias(f"_of_{c}") for c in (*group, _BUCKET)], "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, _BUCKET)])
    reached = longest.join(earlier_reach, same).withColumn("_reach", F.greatest("_before", F.max("_e").over(within)))
    start = F.greatest("_s", F.col("_reach") + 1)
    return reached.select(*group, start.alias("_s"), "_e").where("_s <= _e")


def uncovered(intervals: DataFrame, others: DataFrame, group: Sequence[str], start: str, end: str) -> DataFrame:
    """(group, start, end): the times that intervals of a group hold and none of ``others`` does, disjoint.

    Starts and ends of a group are run through in order, with counts of the intervals open.
    """

    def turns(rows: DataFrame, open_: str) -> DataFrame:
        both = rows.select(*group, epoch_micros(F.col(start)).alias("_s"), epoch_micros(F.col(end)).alias("_e")).where("_s <= _e")
        counts = [F.col("_d").alias(c) if c == open_ else F.lit(0).alias(c) for c in ("_own", "_other")]
        return both.select(*group, F.inline(F.expr("array(struct(_s as _t, 1 as _d), struct(_e + 1 as _t, -1 as _d))"))).select(*group, "_t", *counts)

    moments = turns(intervals, "_own").unionByName(turns(others, "_other")).groupBy(*group, "_t").agg(F.sum("_own").alias("_own"), F.sum("_other").alias("_other"))
    order = Window.partitionBy(*group).orderBy("_t")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    spans = moments.select(*group, "_t", F.lead("_t").over(order).alias("_next"), F.sum("_own").over(so_far).alias("_own"), F.sum("_other").over(so_far).alias("_other"))
    time = lambda micros: F.timestamp_micros(micros).cast("timestamp_ntz")
    return spans.where("_own > 0 AND _other = 0").select(*group, time(F.col("_t")).alias(start), time(F.col("_next") - 1).alias(end))


def disjoint_pieces(intervals: DataFrame, keys: Sequence[str], owner: Sequence[str], start: str, end: str, base_seconds: int) -> DataFrame:
    """(owner, keys, _level, _block, _from, _to): pieces that do not overlap, each within its block."""
    width = base_seconds * 1_000_000
    group = [*owner, *keys]
    micros = intervals.select(*group, epoch_micros(F.col(start)).alias("_s"), epoch_micros(F.col(end)).alias("_e")).where("_s <= _e")
    ends = disjoint(micros, group, width).withColumns({"_lo": _bucket_of("_s", width) + 1, "_hi": _bucket_of("_e", width)})
    first, last = "array(named_struct('level', 0, 'block', _lo - 1, 'out', true))", "array(named_struct('level', 0, 'block', _hi, 'out', true))"
    blocks = F.expr(f"CASE WHEN _hi < _lo THEN {first} WHEN _hi = _lo THEN concat({first}, {last}) ELSE concat({first}, {_BLOCKS}, {last}) END")
    pieces = ends.withColumn("_b", F.explode(blocks)).select(*group, "_s", "_e", F.col("_b.level").alias(_LEVEL), F.col("_b.block").alias("_block"))
    block_start = F.expr(f"shiftleft(_block, {_LEVEL}) * {width}L")
    block_end = F.expr(f"shiftleft(_block + 1, {_LEVEL}) * {width}L - 1")
    return pieces.select(*group, _LEVEL, "_block", F.greatest("_s", block_start).alias(_FROM), F.least("_e", block_end).alias(_TO))


def probes(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, base_seconds: int) -> DataFrame:
    """Points with `_at` and their block of each width that pieces of these intervals can have."""
    width = base_seconds * 1_000_000
    longest = intervals.select((epoch_micros(F.col(end)) - epoch_micros(F.col(start))).alias("_length")).agg(F.max("_length")).scalar()
    blocks = F.floor(F.greatest(F.coalesce(longest, F.lit(0)) / width, F.lit(1)))
    widest = F.length(F.bin(blocks)) - 1
    located = points.withColumn("_at", epoch_micros(F.col(point))).withColumn(_BUCKET, _bucket_of("_at", width))
    return located.withColumn(_LEVEL, F.explode(F.sequence(F.lit(0), widest))).withColumn("_block", F.expr(f"shiftright({_BUCKET}, {_LEVEL})")).drop(_BUCKET)


def hot_keys(points: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Keys that hold more than ``share`` of all points: at most 1/share rows."""
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where(F.col("_n") > total * share).select(*keys)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    owner: Sequence[str],
    point: str,
    start: str,
    end: str,
    bucket_seconds: int = 3600,
    salts: int = 1,
    hot_share: float = 0.01,
) -> DataFrame:
    """Points joined with the owners that have an interval over them; both bounds count.

    Result: all point columns plus the owner columns, each (point, owner) once. ``bucket_seconds`` is the base
    width. Hot keys spread over their blocks, and Spark splits what is left of them (AQE); with ``salts`` > 1 the
    points of keys above ``hot_share`` are also spread over that many parts and the pieces of those keys are repeated
    for each part.
    """
    pieces = disjoint_pieces(intervals, keys, owner, start, end, bucket_seconds)
    located = probes(points, intervals, point, start, end, bucket_seconds)
    on = [*keys, _LEVEL, "_block"]
    if salts > 1:
        # At most 1/hot_share rows, which is what makes this broadcast safe at any size of the data.
        hot = F.broadcast(hot_keys(points, keys, hot_share).withColumn("_hot", F.lit(True)))
        spread = F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int")
        located = located.join(hot, list(keys), "left").withColumn(
            "_salt", F.when(F.col("_hot"), spread).otherwise(0)
        )
        copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        pieces = pieces.join(hot, list(keys), "left").withColumn("_salt", F.explode(copies)).drop("_hot")
        on.append("_salt")
    matched = located.join(pieces, on, "inner").where(F.col("_at").between(F.col(_FROM), F.col(_TO)))
    return matched.select(*points.columns, *owner)
