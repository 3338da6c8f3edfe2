"""Building blocks that keep a plan balanced when one key holds a large share of all rows.

* ``salted_join`` splits the rows of a hot key over several tasks; the other side is repeated.
* ``skewed_join`` is for a wide other side: adaptive execution splits the hot partitions instead.
* ``top_k`` ranks with ``row_number() <= k``, which Spark limits per partition before the shuffle.
* ``running_sum`` / ``previous_value`` give ordered results per key without putting a whole key
  into one task: rows are cut into ordered slices of even size, each slice is summed on its own,
  and the (small) slice summaries carry the totals from one slice to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpointed, slice_count

SALTS = 8


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi join whose hot keys on the ``big`` side are spread over ``salts`` tasks.

    ``small`` must be much narrower than ``big`` (a summary or an index): each of its rows is
    repeated ``salts`` times. No row is dropped. ``how`` is inner, left, left_semi or left_anti.
    """
    cols = [F.col(c) for c in (spread_by or [c for c in big.columns if c not in on])]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def skewed_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", shuffled: bool = False
) -> DataFrame:
    """Equi join of a possibly hot ``big`` side with a wide ``small`` side (unique keys).

    Repeating a wide side for salting would multiply its bytes, so hot keys are left to adaptive
    execution: it splits an oversized shuffle partition of ``big`` and reads the matching partition
    of ``small`` once per split. The result must not be grouped by the same keys right away (that
    would forbid the split); callers here go on with projections or other keys. ``shuffled`` is for a ``small`` that
    grows with the input: columns of a well compressed file look small to the planner, and a broadcast of them would
    lie in the driver's memory as a whole.
    """
    if shuffled:
        small = small.hint("merge")
    return big.join(small, list(on), how)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for an expensive expression that filters and later columns must not repeat.

    A plain column is copied into every filter pushed below it. A one-element explode is a generator,
    which the optimizer neither copies nor moves filters through.
    """
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows per key. Planned as a partial limit per partition, then a window."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order``; a plain aggregate, so combined map-side.

    One aggregate per column, not one of whole rows: a column that the caller drops is never read, carried or sorted.
    All of them compare the same ``order`` in the same pass, so they pick the same row.
    """
    first = F.struct(*order)
    rest = [F.min_by(c, first).alias(c) for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*rest).select(*df.columns)


def ordered_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with a ``_slice`` number: rows sorted by ``keys + order`` and cut into even ranges.

    The cut comes from a range shuffle whose bounds are sampled, so the result is checkpointed:
    every later use sees the same slices, also after a task is run again.
    """
    n = slice_count(df.sparkSession)
    ranged = df.repartitionByRange(n, *keys, *order)
    return checkpointed(ranged.withColumn("_slice", F.spark_partition_id()))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Exclusive running sum of ``value`` per key in ``order`` (0 for the first row)."""
    sliced = ordered_slices(df, keys, order)
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        sliced.join(offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_slice", "_offset")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """``lag(value)`` per key in ``order``; the last value of each slice crosses to the next."""
    sliced = ordered_slices(df, keys, order)
    lasts = sliced.groupBy(*keys, "_slice").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last")
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    carried = lasts.select(*keys, "_slice", F.lag("_last").over(by_slice).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.join(carried, [*keys, "_slice"])
        .withColumn("_in", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
        .withColumn(out, F.coalesce(F.col("_in"), F.col("_carry"))["v"])
        .drop("_slice", "_carry", "_in")
    )
