"""Change feed: which values leave the cache, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.operators.state import write_outcomes
from cachelens.operators.ttl import sweeps


def exits(log: DataFrame) -> DataFrame:
    """``cache_id, seq, kind, key_index, value, cost``: the former value of every update and remove (exit), and of every sweep (evict)."""
    d = write_outcomes(log).where("outcome IN ('update', 'remove')")
    out = d.select("cache_id", "seq", F.lit("exit").alias("kind"), "key_index", F.col("prev.value").alias("value"), F.col("prev.cost").alias("cost"))
    return out.unionByName(sweeps(log).select("cache_id", "seq", F.lit("evict").alias("kind"), "key_index", "value", "cost"))
