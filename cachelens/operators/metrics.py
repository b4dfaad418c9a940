"""Exact counters of a cache, ratios, and their renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.functions.keys import SHARDS
from cachelens.operators.batching import get_batches
from cachelens.operators.state import row_hit, row_present, with_generation, with_previous, with_start, write_outcome
from cachelens.operators.ttl import sweeps

#: Fixed values of the report format: the names of its counters, in their order.
COUNTERS = ("hit", "miss", "keys-added", "keys-updated", "keys-evicted", "cost-added", "cost-evicted", "sets-dropped", "sets-rejected", "gets-dropped", "gets-kept")
NAMES = tuple(c.replace("-", "_") for c in COUNTERS)


def counters(log: DataFrame, buffer_items: int = 64) -> DataFrame:
    """One row per cache with the counters of an infinite budget, over the whole log.

    Without pressure no set is dropped or rejected; an update that raises a cost adds the difference, one that lowers it
    evicts the difference; removals and sweeps evict their row's cost.
    """
    # one pass: reads and writes look at the same previous write
    d = with_previous(with_generation(with_start(log)))
    d = d.withColumns({"present": row_present(), "_hit": row_hit()}).withColumn("outcome", write_outcome())
    writes = d.groupBy("cache_id").agg(
        F.count_if(F.col("op").isin("get", "get_mut") & F.col("_hit")).alias("hit"),
        F.count_if(F.col("op").isin("get", "get_mut") & ~F.col("_hit")).alias("miss"),
        F.count_if(F.col("outcome") == "insert").alias("keys_added"),
        F.count_if(F.col("outcome") == "update").alias("keys_updated"),
        F.count_if(F.col("outcome") == "remove").alias("_removed"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "insert", F.col("cost")).when(F.col("outcome") == "update", F.greatest(F.lit(0), F.col("cost") - F.col("prev.cost")))), F.lit(0)).alias("cost_added"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "remove", F.col("prev.cost")).when(F.col("outcome") == "update", F.greatest(F.lit(0), F.col("prev.cost") - F.col("cost")))), F.lit(0)).alias("_removed_cost"),
    )
    swept = sweeps(log).groupBy("cache_id").agg(F.count("*").alias("_swept"), F.sum("cost").alias("_swept_cost"))
    kept = get_batches(log, buffer_items).groupBy("cache_id").agg(F.count_if("kept").alias("gets_kept"))
    all_ = writes.join(swept, "cache_id", "left").join(kept, "cache_id", "left").na.fill(0)
    zero = F.lit(0).cast("long")
    return all_.select(
        "cache_id", "hit", "miss", "keys_added", "keys_updated", (F.col("_removed") + F.col("_swept")).alias("keys_evicted"), "cost_added", (F.col("_removed_cost") + F.col("_swept_cost")).alias("cost_evicted"),
        zero.alias("sets_dropped"), zero.alias("sets_rejected"), zero.alias("gets_dropped"), "gets_kept",
    )


def with_ratio(df: DataFrame) -> DataFrame:
    """``gets_total`` and ``hit_ratio`` (0.0 without reads)."""
    total = F.col("hit") + F.col("miss")
    return df.withColumns({"gets_total": total, "hit_ratio": F.coalesce(F.try_divide(F.col("hit").cast("double"), total.cast("double")), F.lit(0.0))})


def without_metrics(df: DataFrame) -> DataFrame:
    """The same columns, all null: what a cache reports that keeps no metrics."""
    return df.select(*[F.col(c) if c == "cache_id" else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])


def since_clear(log: DataFrame) -> DataFrame:
    """The log without what each cache's last clear has wiped."""
    d = with_generation(log)
    last = d.groupBy("cache_id").agg(F.max("generation").alias("generation"))
    return d.join(last, ["cache_id", "generation"]).where("op <> 'clear'").drop("generation")


def as_json(df: DataFrame) -> DataFrame:
    """``cache_id, json``: counters, total and ratio under their report names."""
    d = with_ratio(df)
    fields = [F.format_string(f'"{c}":%d', F.col(n)) for c, n in zip(COUNTERS, NAMES)] + [F.format_string('"gets-total":%d', F.col("gets_total")), F.concat(F.lit('"hit-ratio":'), F.round("hit_ratio", 6).cast("decimal(10,6)").cast("string"))]
    return d.select("cache_id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("json"))


def as_text(df: DataFrame) -> DataFrame:
    """``cache_id, report``: one line per counter, total and ratio with two decimals."""
    d = with_ratio(df)
    lines = [F.format_string(f"{c}: %d", F.col(n)) for c, n in zip(COUNTERS, NAMES)] + [F.format_string("gets-total: %d", F.col("gets_total")), F.format_string("hit-ratio: %.2f", F.col("hit_ratio"))]
    return d.select("cache_id", F.concat_ws("\n", *lines).alias("report"))


def sharded_sum(log: DataFrame) -> DataFrame:
    """Costs added in 256 shards by key and summed per cache: both steps of a sharded counter."""
    shards = log.where("op = 'insert'").groupBy("cache_id", F.pmod("key_index", F.lit(SHARDS)).alias("shard")).agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))
    return shards.groupBy("cache_id").agg(F.count("*").alias("shards"), F.sum("cost").alias("cost_sum"), F.sum("n").alias("inserts"))
