"""The store as of every operation: generations, versions, lookups, and what each write does.

These set-based forms are exact when an index has one conflict value, the update validator is constant, and nothing is evicted for want of
room; elsewhere the policy kernel applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.operators.running import last_before, position, running_max, running_sum

SECOND_US, CLEANUP_US = 1_000_000, 2_000_000
KEY = ["cache_id", "generation", "key_index"]


def with_generation(log: DataFrame) -> DataFrame:
    """``generation``: the clears of the same cache so far; a clear belongs to the generation that it begins."""
    return running_sum(log, F.when(F.col("op") == "clear", 1).otherwise(0), ["cache_id"], "seq", "generation")


def with_previous(log: DataFrame, by: list[str] = KEY) -> DataFrame:
    """``prev``: the last earlier insert or remove of the same key in the same generation, as a struct."""
    what = F.struct("seq", "op", "ts_us", "value", "cost", "ttl_us", "key_conflict")
    return last_before(log, F.col("op").isin("insert", "remove"), what, by, "seq", "prev")


def row_exists() -> Column:
    """A row was there before this operation, swept or not."""
    return F.coalesce(F.col("prev.op") == "insert", F.lit(False))


def unexpired(now: str = "ts_us", row: str = "prev") -> Column:
    """Not expired: no time to live, or less than it has passed."""
    return (F.col(f"{row}.ttl_us") == 0) | (F.col(now) - F.col(f"{row}.ts_us") < F.col(f"{row}.ttl_us"))


def conflict_matches(given: Column, row: Column) -> Column:
    """A conflict of 0 matches any row."""
    return (given == 0) | (given == row)


def row_hit() -> Column:
    """A row is there, unexpired, of a matching conflict."""
    return F.coalesce(row_exists() & unexpired() & conflict_matches(F.col("key_conflict"), F.col("prev.key_conflict")), F.lit(False))


def row_present(cleanup_us: int = CLEANUP_US) -> Column:
    """A row still stands, expired or not: no tick has swept it yet."""
    swept = swept_at(F.col("prev.ts_us"), F.col("prev.ttl_us"), F.col("start_us"), cleanup_us)
    return row_exists() & F.coalesce(swept > F.col("ts_us"), F.lit(True))


def write_outcome() -> Column:
    """insert, update, remove or absent, by ``op`` and ``present``; null for other operations."""
    inserts = F.when(F.col("op") == "insert", F.when(F.col("present"), "update").otherwise("insert"))
    return inserts.when(F.col("op") == "remove", F.when(F.col("present"), "remove").otherwise("absent"))


def hits(log: DataFrame) -> DataFrame:
    """Reads with ``hit``, as ``row_hit`` tells."""
    return with_previous(with_generation(log)).where(F.col("op").isin("get", "get_mut")).withColumn("hit", row_hit())


def with_start(log: DataFrame) -> DataFrame:
    """``start_us``: the time of the cache's first operation, from which cleanup ticks count."""
    first = log.groupBy("cache_id").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    return log.join(first, "cache_id")


def expiry_bucket(created: Column, ttl: Column) -> Column:
    """The one-second bucket of an expiration: its second plus one."""
    return F.floor((created + ttl) / SECOND_US).cast("long") + 1


def swept_at(created: Column, ttl: Column, start: Column, cleanup_us: int = CLEANUP_US) -> Column:
    """The first cleanup tick that sweeps a row: the first at or after its bucket; null without a time to live."""
    bucket_us = expiry_bucket(created, ttl) * SECOND_US
    ticks = F.ceil((bucket_us - start) / cleanup_us).cast("long")
    return F.when(ttl > 0, start + ticks * cleanup_us)


def write_outcomes(log: DataFrame, cleanup_us: int = CLEANUP_US) -> DataFrame:
    """Inserts and removes with ``present`` (a row still stands, expired or not) and ``outcome`` (insert, update, remove, absent)."""
    d = with_previous(with_generation(with_start(log))).where(F.col("op").isin("insert", "remove"))
    return d.withColumn("present", row_present(cleanup_us)).withColumn("outcome", write_outcome())


def conditional_inserts(log: DataFrame, cleanup_us: int = CLEANUP_US) -> DataFrame:
    """Conditional inserts (``insert_if_present``) with ``updated``: whether a row still stands, expired or not.

    Such a write ends the row's time to live, so of those on one row the first decides: it comes before the sweep and the row then stays for the
    others, or it comes after and none finds a row.  Times must not fall along ``seq``.
    """
    d = with_previous(with_generation(with_start(log))).where("op = 'insert_if_present'")
    row = [*KEY, "row_seq"]
    d = d.withColumn("row_seq", F.col("prev.seq"))
    first = d.where("row_seq IS NOT NULL").groupBy(*row).agg(F.min_by("ts_us", "seq").alias("first_us"))
    d = d.join(first, row, "left")
    swept = swept_at(F.col("prev.ts_us"), F.col("prev.ttl_us"), F.col("start_us"), cleanup_us)
    return d.withColumn("updated", row_exists() & F.coalesce(swept > F.col("first_us"), F.lit(True))).drop("row_seq", "first_us")


def versioned_removals(log: DataFrame, by: list[str]) -> DataFrame:
    """Removals with ``removed``, each asking for the version that the last read of its key saw: a compare-and-delete.

    A row goes with the first removal that follows both its insert and a read of it; any other finds another version or no row.
    """
    d = running_max(log, F.when(F.col("op") == "insert", F.col("seq")), by, "seq", "made")
    d = running_max(d, F.when(F.col("op") == "get", F.col("seq")), by, "seq", "seen").where("op = 'remove'")
    winner = d.where("seen > made").groupBy(*by, "made").agg(F.min("seq").alias("winner"))
    return d.join(winner, [*by, "made"], "left").withColumn("removed", F.coalesce(F.col("seq") == F.col("winner"), F.lit(False))).drop("winner")


def versions(log: DataFrame) -> DataFrame:
    """Successful writes with ``version``, counting from 1 in each cache across clears."""
    return position(log.where("op = 'insert'"), ["cache_id"], "seq", "version")


def entries(log: DataFrame, cleanup_us: int = CLEANUP_US) -> DataFrame:
    """The rows at the end of the log, with ``expired`` and ``swept`` as of each cache's last operation."""
    d = with_generation(with_start(log))
    last = d.groupBy("cache_id").agg(F.max("generation").alias("generation"))
    d = d.where(F.col("op").isin("insert", "remove")).join(last, ["cache_id", "generation"])
    row = d.groupBy("cache_id", "key_index", "start_us", "end_us").agg(F.max_by(F.struct("op", "seq", "ts_us", "value", "cost", "ttl_us"), "seq").alias("r")).where("r.op = 'insert'")
    expired = (F.col("r.ttl_us") > 0) & (F.col("end_us") - F.col("r.ts_us") >= F.col("r.ttl_us"))
    swept = F.coalesce(swept_at(F.col("r.ts_us"), F.col("r.ttl_us"), F.col("start_us"), cleanup_us) <= F.col("end_us"), F.lit(False))
    return row.select("cache_id", "key_index", F.col("r.seq").alias("seq"), F.col("r.value").alias("value"), F.col("r.cost").alias("cost"), F.col("r.ts_us").alias("created_us"), F.col("r.ttl_us").alias("ttl_us"), expired.alias("expired"), swept.alias("swept"))
