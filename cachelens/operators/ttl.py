"""Expiration: remaining time, buckets, sweeps by cleanup ticks, and lifetimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.operators.running import first_after, last_before
from cachelens.operators.state import CLEANUP_US, KEY, expiry_bucket, row_exists, swept_at, unexpired, with_generation, with_previous, with_start


def remaining(log: DataFrame) -> DataFrame:
    """Reads with ``present``, ``found`` (the value read, null without a live row) and ``remaining_us``: null without a time to live or a live row."""
    d = with_previous(with_generation(log)).where("op IN ('get', 'get_mut')")
    present = row_exists() & unexpired()
    left = F.greatest(F.lit(0), F.col("prev.ttl_us") - (F.col("ts_us") - F.col("prev.ts_us")))
    return d.withColumns({"present": F.coalesce(present, F.lit(False)), "found": F.when(present, F.col("prev.value")), "remaining_us": F.when(present & (F.col("prev.ttl_us") > 0), left)})


def buckets(log: DataFrame) -> DataFrame:
    """Inserts with a time to live by expiration bucket."""
    d = log.where("op = 'insert' AND ttl_us > 0").withColumn("bucket", expiry_bucket(F.col("ts_us"), F.col("ttl_us")))
    return d.groupBy("cache_id", "bucket").agg(F.count("*").alias("n"), F.min("key_index").alias("least_key"))


def segments(log: DataFrame, cleanup_us: int = CLEANUP_US) -> DataFrame:
    """Inserts with when their row is swept (``swept_us``), replaced (``next_us``) and cleared away (``clear_us``), null if never."""
    d = with_generation(with_start(log))
    cleared = d.where("op = 'clear'").select("cache_id", (F.col("generation") - 1).alias("generation"), F.col("ts_us").alias("clear_us"))
    d = first_after(d, F.col("op").isin("insert", "remove"), F.struct("seq", "op", "ts_us"), KEY, "seq", "next").where("op = 'insert'")
    d = d.join(cleared, ["cache_id", "generation"], "left")
    return d.withColumns({"swept_us": swept_at(F.col("ts_us"), F.col("ttl_us"), F.col("start_us"), cleanup_us), "next_us": F.col("next.ts_us")})


def sweeps(log: DataFrame, cleanup_us: int = CLEANUP_US) -> DataFrame:
    """Rows that a cleanup tick removes: their tick comes before any other write, clear or the end of the log."""
    d = segments(log, cleanup_us)
    by_then = F.coalesce(F.col("next_us") >= F.col("swept_us"), F.lit(True)) & F.coalesce(F.col("clear_us") >= F.col("swept_us"), F.lit(True)) & (F.col("swept_us") <= F.col("end_us"))
    return d.where((F.col("ttl_us") > 0) & by_then).withColumn("exp_us", F.col("ts_us") + F.col("ttl_us"))


def lifetimes(log: DataFrame, cleanup_us: int = CLEANUP_US) -> DataFrame:
    """Swept rows with ``life_s``: whole seconds from the insert that began the row's residence (updates go on with it) to its sweep."""
    d = with_previous(with_generation(with_start(log)))
    swept = swept_at(F.col("prev.ts_us"), F.col("prev.ttl_us"), F.col("start_us"), cleanup_us)
    fresh = (F.col("op") == "insert") & ~(row_exists() & F.coalesce(swept > F.col("ts_us"), F.lit(True)))
    d = last_before(d.withColumn("_fresh", fresh), F.col("_fresh"), F.struct("ts_us"), KEY, "seq", "born", inclusive=True)
    born = d.where("op = 'insert'").select("cache_id", "seq", F.col("born.ts_us").alias("born_us"))
    return sweeps(log, cleanup_us).join(born, ["cache_id", "seq"]).withColumn("life_s", F.floor((F.col("swept_us") - F.col("born_us")) / 1_000_000).cast("long"))
