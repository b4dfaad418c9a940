"""Read and insert buffers: stripes, full batches, drain ticks and barriers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.functions.keys import stripe
from cachelens.operators.running import position
from cachelens.operators.state import with_start


def get_batches(log: DataFrame, buffer_items: int = 64) -> DataFrame:
    """Reads with ``stripe, batch`` and ``kept``: only reads of full batches reach the policy."""
    d = position(log.where("op = 'get'").withColumn("stripe", stripe(F.col("client_id"))), ["cache_id", "stripe"], "seq", "_pos")
    d = d.withColumn("batch", F.floor((F.col("_pos") - 1) / buffer_items).cast("long")).drop("_pos")
    full = d.groupBy("cache_id", "stripe").agg(F.count("*").alias("_n"))
    return d.join(full, ["cache_id", "stripe"]).withColumn("kept", (F.col("batch") + 1) * buffer_items <= F.col("_n")).drop("_n")


def insert_batches(log: DataFrame, high_water: int = 64, drain_us: int = 500_000, barriers: bool = True) -> DataFrame:
    """Inserts with the batch they ship in: a batch closes when it is full, at a drain tick, or at a barrier (wait or clear)."""
    from cachelens.operators.running import running_sum

    d = with_start(log).withColumn("tick", F.floor((F.col("ts_us") - F.col("start_us")) / drain_us).cast("long"))
    if barriers:
        d = running_sum(d, F.when(F.col("op").isin("wait", "clear"), 1).otherwise(0), ["cache_id"], "seq", "barrier")
    else:
        d = d.withColumn("barrier", F.lit(0).cast("long"))
    d = position(d.where("op = 'insert'").withColumn("stripe", stripe(F.col("client_id"))), ["cache_id", "stripe", "tick", "barrier"], "seq", "_pos")
    return d.withColumn("batch", F.floor((F.col("_pos") - 1) / high_water).cast("long")).drop("_pos")


def shipped(batches: DataFrame) -> DataFrame:
    """One row per batch: its size and the operation after which it ships."""
    return batches.groupBy("cache_id", "stripe", "tick", "barrier", "batch").agg(F.count("*").alias("n"), F.max("seq").alias("flush_seq"))
