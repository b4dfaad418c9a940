"""Running values over long ordered groups, without gathering a group in one task.

A group (a cache, a key) may hold a third of all rows, so none of these orders a whole group in one window.  Rows are cut into
blocks of the order column; a small table of block totals is scanned per group, and each block is finished on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of a block in units of the order column.
BLOCK = 1 << 16


def running_sum(df: DataFrame, value: Column, by: list[str], order: str, name: str, block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``by`` up to this one (without it if not ``inclusive``).

    ``order`` must be a unique integer within a group.  Null ``by`` values form a group like any other.
    """
    d = _running(df, value, F.sum, by, order, block, inclusive)
    return d.withColumn(name, F.coalesce("_before", F.lit(0)) + F.coalesce("_in", F.lit(0))).drop("_before", "_in")


def running_max(df: DataFrame, value: Column, by: list[str], order: str, name: str, block: int = BLOCK, inclusive: bool = False) -> DataFrame:
    """``df`` with the greatest non-null ``value`` of the earlier rows of the same ``by`` (with this one if ``inclusive``); null if there is none."""
    return _running(df, value, F.max, by, order, block, inclusive).withColumn(name, F.greatest("_before", "_in")).drop("_before", "_in")


def _running(df: DataFrame, value: Column, total, by: list[str], order: str, block: int, inclusive: bool) -> DataFrame:
    """``df`` with ``_before`` over earlier blocks and ``_in`` over this one, null where there are no rows."""
    d = df.withColumns({"_blk": F.floor(F.col(order) / block).cast("long"), "_val": value.cast("long")})
    totals = d.groupBy(*by, "_blk").agg(total("_val").alias("_tot"))
    before = totals.withColumn("_before", total("_tot").over(Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate([*by, "_blk"])], "_before")
    inside = Window.partitionBy(*by, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = d.withColumn("_in", total("_val").over(inside))
    match = None
    for i, c in enumerate([*by, "_blk"]):
        same = d[c].eqNullSafe(before[f"_g{i}"])
        match = same if match is None else match & same
    return d.join(before, match).drop("_blk", "_val", *[f"_g{i}" for i in range(len(by) + 1)])


def position(df: DataFrame, by: list[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with each row's 1-based position within its group."""
    return running_sum(df, F.lit(1), by, order, name, block)


def last_before(df: DataFrame, when: Column, what: Column, by: list[str], order: str, name: str, block: int = BLOCK, inclusive: bool = False) -> DataFrame:
    """``df`` with ``what`` of the last earlier row of the same group for which ``when`` holds; null if none.

    ``what`` must not be null where ``when`` holds (give a struct).
    """
    d = df.withColumns({"_blk": F.floor(F.col(order) / block).cast("long"), "_what": F.when(when, what)})
    # every block of a group, so that what is carried passes blocks without such rows
    blocks = d.groupBy(*by, "_blk").agg(F.max_by("_what", F.when(F.col("_what").isNotNull(), F.col(order))).alias("_end"))
    carry = blocks.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)))
    carry = carry.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate([*by, "_blk"])], "_carry")
    inside = Window.partitionBy(*by, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = d.withColumn("_in", F.last("_what", ignorenulls=True).over(inside))
    match = None
    for i, c in enumerate([*by, "_blk"]):
        same = d[c].eqNullSafe(carry[f"_g{i}"])
        match = same if match is None else match & same
    return d.join(carry, match).withColumn(name, F.coalesce("_in", "_carry")).drop("_blk", "_what", "_in", "_carry", *[f"_g{i}" for i in range(len(by) + 1)])


def first_after(df: DataFrame, when: Column, what: Column, by: list[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``what`` of the first later row of the same group for which ``when`` holds; null if none."""
    d = df.withColumn("_back", -F.col(order))
    return last_before(d, when, what, by, "_back", name, block).drop("_back")
