"""Costs: external and internal cost, bounds, budgets as of an operation, and use without eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.operators.running import last_before, running_sum
from cachelens.operators.state import write_outcomes


def effective(log: DataFrame, coster: Column, item_size: int = 0) -> DataFrame:
    """Writes with ``total_cost``: the given cost, or the coster's where it is 0, plus the internal cost of a row."""
    external = F.when(F.col("cost") == 0, coster).otherwise(F.col("cost"))
    return log.where("op = 'insert'").withColumns({"external_cost": external, "total_cost": external + F.lit(item_size).cast("long")})


def prechecked(writes: DataFrame, max_cost: int) -> DataFrame:
    """Writes whose cost lies between 0 and the budget; the others are rejected before they reach the policy."""
    return writes.where((F.col("cost") >= 0) & (F.col("cost") <= max_cost))


def budget_as_of(log: DataFrame, initial: int) -> DataFrame:
    """``log`` with ``max_cost``: the last budget set before each operation."""
    d = last_before(log, F.col("op") == "update_max_cost", F.struct("new_max_cost"), ["cache_id"], "seq", "_b")
    return d.withColumn("max_cost", F.coalesce(F.col("_b.new_max_cost"), F.lit(initial).cast("long"))).drop("_b")


def used_without_eviction(log: DataFrame) -> DataFrame:
    """Writes with ``used``: the cost that the cache holds after each, if nothing is evicted or expires."""
    d = write_outcomes(log.withColumn("ttl_us", F.lit(0).cast("long")))
    delta = F.when(F.col("outcome") == "insert", F.col("cost")).when(F.col("outcome") == "update", F.col("cost") - F.col("prev.cost")).when(F.col("outcome") == "remove", -F.col("prev.cost")).otherwise(0)
    return running_sum(d.withColumn("delta", delta), F.col("delta"), ["cache_id", "generation"], "seq", "used")
