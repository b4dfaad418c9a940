"""Generated traces: seeded xorshift keys, unique inserts, reads of preloaded keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.functions.keys import md5_index

#: Shifts of the 64-bit xorshift generator.
SHIFTS = (13, 7, 17)


def xorshift(x: int) -> int:
    """The next state of the generator."""
    a, b, c = SHIFTS
    x ^= x << a & (2**64 - 1)
    x ^= x >> b
    return x ^ x << c & (2**64 - 1)


def xorshift_keys(spark: SparkSession, clients: int, ops: int, capacity: int, percent: int = 125) -> DataFrame:
    """``client_id, n, key``: each client's own sequence of ``ops`` keys below ``capacity * percent / 100``.

    Clients run in parallel; a client's sequence is made in one stream, in batches of bounded size.
    """
    space = max(1, capacity * percent // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for client in b.column("id").to_pylist():
                x = (client + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)
                for a in range(0, ops, 65536):
                    keys = np.empty(min(65536, ops - a), np.int64)
                    for i in range(len(keys)):
                        x = xorshift(x)
                        keys[i] = x % space
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), client)), pa.array(np.arange(a, a + len(keys))), pa.array(keys)], names=["client_id", "n", "key"])

    return spark.range(clients).repartition(clients).mapInArrow(run, "client_id long, n long, key long")


def unique_inserts(spark: SparkSession, clients: int, per_client: int) -> DataFrame:
    """``client_id, n, key``: every key once."""
    return spark.range(clients * per_client).select(F.expr(f"id div {per_client}").alias("client_id"), (F.col("id") % per_client).alias("n"), F.col("id").alias("key"))


def uniform_reads(spark: SparkSession, clients: int, per_client: int, capacity: int, seed: int = 1) -> DataFrame:
    """``client_id, n, key``: reads of preloaded keys 0 .. capacity - 1, uniform by the md5 of seed and number."""
    key = F.pmod(md5_index(F.concat_ws(":", F.lit(seed), F.col("id"))), F.lit(capacity))
    return unique_inserts(spark, clients, per_client).select("client_id", "n", F.col("key").alias("id")).select("client_id", "n", key.alias("key"))
