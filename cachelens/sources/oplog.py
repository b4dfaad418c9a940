"""Op logs: one row per cache operation, built from tables or streams.

Columns: ``cache_id, seq, ts_us, client_id, op, key_index, key_conflict, value, cost, ttl_us, new_max_cost``.  ``seq`` is the total order within a
cache.  ``op`` is one of get, get_mut, get_ttl, insert, insert_if_present, remove, clear, wait, update_max_cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cachelens.errors import MissingColumn
from cachelens.functions.keys import md5_conflict, md5_index

COLUMNS = ("cache_id", "seq", "ts_us", "client_id", "op", "key_index", "key_conflict", "value", "cost", "ttl_us", "new_max_cost")
DAY_US = 86_400_000_000
#: Every so many events one is a clear.
CLEAR_EVERY = 997


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column) -> Column:
    """Microseconds since the epoch; zone-free timestamps are taken as UTC."""
    return F.unix_micros(c.cast("timestamp"))


def from_events(events: DataFrame, caches: int = 4, clears: bool = True) -> DataFrame:
    """Views and clicks read, purchases and signups insert (signups with a day to live), errors remove; if ``clears``, some events clear their cache."""
    clear = (F.col("event_id") % CLEAR_EVERY == CLEAR_EVERY - 1) if clears else F.lit(False)
    op = (
        F.when(clear, "clear")
        .when(F.col("event_type").isin("view", "click"), "get")
        .when(F.col("event_type").isin("purchase", "signup"), "insert")
        .when(F.col("event_type") == "error", "remove")
    )
    return events.select(
        F.concat(F.lit("c"), (F.col("user_id") % caches).cast("string")).alias("cache_id"),
        F.col("event_id").alias("seq"),
        micros(F.col("ts")).alias("ts_us"),
        (F.col("user_id") % 8).alias("client_id"),
        op.alias("op"),
        F.when(~clear, F.col("user_id")).alias("key_index"),
        F.when(~clear, F.lit(0).cast("long")).alias("key_conflict"),
        F.col("props").alias("value"),
        F.ceil("value").cast("long").alias("cost"),
        F.when(F.col("event_type") == "signup", F.lit(DAY_US)).otherwise(F.lit(0)).cast("long").alias("ttl_us"),
        F.lit(None).cast("long").alias("new_max_cost"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """A get-or-insert trace on the content hash: every document reads its key, then inserts it with its length as cost."""
    ops = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("get").alias("op")), F.struct(F.lit(1).alias("k"), F.lit("insert").alias("op"))))
    d = docs.select("doc_id", "text", "source", "n_chars", ops.alias("o"))
    return d.select(
        F.lit("docs").alias("cache_id"),
        (F.col("doc_id") * 2 + F.col("o.k")).alias("seq"),
        (F.col("doc_id") * 1000).alias("ts_us"),
        (F.col("doc_id") % 16).alias("client_id"),
        F.col("o.op").alias("op"),
        md5_index(F.col("text")).alias("key_index"),
        md5_conflict(F.col("text")).alias("key_conflict"),
        F.lit(None).cast("string").alias("value"),
        F.col("n_chars").alias("cost"),
        F.lit(0).cast("long").alias("ttl_us"),
        F.lit(None).cast("long").alias("new_max_cost"),
    )


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """A pure read trace by part key.  ``seq`` is made of order and line numbers; lines that share both come in the order of their other
    columns, by a rank within that pair alone."""
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    tie = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*rest))
    return lineitem.select(
        F.lit("parts").alias("cache_id"),
        (F.col("l_orderkey") * 1024 + F.col("l_linenumber") * 64 + tie).cast("long").alias("seq"),
        micros(F.col("l_shipdate")).alias("ts_us"),
        (F.col("l_suppkey") % 16).alias("client_id"),
        F.lit("get").alias("op"),
        F.col("l_partkey").alias("key_index"),
        F.lit(0).cast("long").alias("key_conflict"),
        F.lit(None).cast("string").alias("value"),
        F.lit(1).cast("long").alias("cost"),
        F.lit(0).cast("long").alias("ttl_us"),
        F.lit(None).cast("long").alias("new_max_cost"),
    )


def checked(log: DataFrame, *needed: str) -> DataFrame:
    """``log`` if it has the columns that an operator needs."""
    missing = [c for c in needed or COLUMNS if c not in log.columns]
    if missing:
        raise MissingColumn(", ".join(missing))
    return log
