"""Bloom filters, count-min sketches and the aged frequency estimate, as relational plans.

The rows of the sketch are isomorphic (a seed only permutes cells), so the estimate is the saturated count of a cell; ageing halves cells
and empties the filter after every ``num_counters`` reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from cachelens.functions.sizing import bloom_shape, sketch_mask
from cachelens.operators.policy import runs
from cachelens.operators.running import position

HASH_BITS = 60
MOST = 15


def bit_positions(hashed: Column, exponent: int, probes: int, hash_bits: int = HASH_BITS) -> Column:
    """The probed bits of a hash: its high bits plus multiples of its low bits, modulo the size."""
    size = 1 << exponent
    high, low = F.shiftrightunsigned(hashed, hash_bits - exponent), hashed.bitwiseAND(F.lit(size - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: (high + i * low).bitwiseAND(F.lit(size - 1)))


def bloom_bits(keys: DataFrame, key: str, exponent: int, probes: int) -> DataFrame:
    """The set bits of the filter that holds ``keys``."""
    return keys.select(F.explode(bit_positions(F.col(key), exponent, probes)).alias("bit")).distinct()


def bloom_words(bits: DataFrame) -> DataFrame:
    """The filter as 64-bit words, those that are not zero."""
    return bits.groupBy(F.floor(F.col("bit") / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS INT)))").alias("bits"))


def bloom_contains(probes_: DataFrame, key: str, bits: DataFrame, exponent: int, probes: int) -> DataFrame:
    """Distinct probe keys with ``contained``.  The filter has at most 2**exponent rows; the join is planned by its size."""
    asked = probes_.select(key).distinct().withColumn("bit", F.explode(F.array_distinct(bit_positions(F.col(key), exponent, probes))))
    found = asked.join(bits.withColumn("_set", F.lit(1)), "bit", "left")
    return found.groupBy(key).agg((F.count("*") == F.count("_set")).alias("contained"))


def cells(reads: DataFrame, key: str, counters: int) -> DataFrame:
    """``cell, n``: how often each cell was incremented, saturated."""
    return reads.groupBy(F.col(key).bitwiseAND(F.lit(sketch_mask(counters))).alias("cell")).agg(F.least(F.lit(MOST), F.count("*")).cast("long").alias("n"))


def estimates(reads: DataFrame, key: str, counters: int) -> DataFrame:
    """Each key's true count and its estimate by the sketch."""
    true = reads.groupBy(key).agg(F.count("*").alias("true_n"))
    return true.withColumn("cell", F.col(key).bitwiseAND(F.lit(sketch_mask(counters)))).join(cells(reads, key, counters), "cell").select(key, "cell", "true_n", F.col("n").alias("estimate"))


def aged(per_epoch: DataFrame, by: list[str], epoch: Column, n: Column, now: Column) -> DataFrame:
    """``carry`` of each group at the start of epoch ``now``: after every earlier epoch its saturated sum is halved.

    Halving rounds down, so an old count can live on in a last bit: the fold goes through every epoch in which the group was incremented, and
    through the empty ones between by shifts.  A group's list has at most one entry per epoch.
    """
    past = per_epoch.where(epoch < now).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(epoch.cast("long").alias("e"), n.cast("long").alias("n")))).alias("_l"), F.max(now).alias("_now"))
    most = F.lit(MOST).cast("long")

    def shifted(c: Column, gap: Column) -> Column:
        steps = F.least(gap, F.lit(5).cast("long"))
        return F.floor(c / F.pow(F.lit(2.0), steps)).cast("long")

    def add(acc: Column, x: Column) -> Column:
        carried = shifted(acc["c"], x["e"] - acc["e"])
        return F.struct((x["e"] + 1).alias("e"), F.shiftright(F.least(most, carried + x["n"]), 1).alias("c"))

    start = F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("c"))
    end = F.aggregate("_l", start, add)
    folded = past.select(*by, "_now", end.alias("_a"))
    return folded.select(*by, shifted(F.col("_a.c"), F.col("_now") - F.col("_a.e")).alias("carry"))


class TinyLfu:
    """The frequency state of one set of reads, numbered by position within each cache."""

    def __init__(self, reads: DataFrame, key: str, counters: int, by: list[str], order: str = "seq", hash_bits: int = HASH_BITS, ratio: float = 0.01):
        self.key, self.counters, self.by = key, counters, by
        self.exponent, self.probes = bloom_shape(counters, ratio)
        self.mask, self.hash_bits = sketch_mask(counters), hash_bits
        d = position(reads, by, order, "pos")
        self.reads = d.withColumns({"epoch": F.floor((F.col("pos") - 1) / counters).cast("long"), "cell": F.col(key).bitwiseAND(F.lit(self.mask))})

    def _positions(self) -> Column:
        return F.array_distinct(bit_positions(F.col(self.key), self.exponent, self.probes, self.hash_bits))

    def keys(self) -> DataFrame:
        """The distinct keys of each epoch: where each was ``first`` read, ``n`` reads, and ``known``, whether the filter had its bits before that.

        Later reads of a key find its bits, and only first reads set any.  An epoch is streamed through one filter in the order of first reads, so no
        read is multiplied by its bits and memory is that of a filter.
        """
        by, key, exponent, probes, hash_bits = [*self.by, "epoch"], self.key, self.exponent, self.probes, self.hash_bits
        first = self.reads.where(F.col(key).isNotNull()).groupBy(*by, key, "cell").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
        first = first.repartition(*by).sortWithinPartitions(*by, "first")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, door, low = None, set(), (1 << exponent) - 1
            for b in batches:
                known = []
                for g, part in runs(b, tuple(by)):
                    if g != group:
                        group, door = g, set()
                    k = part.column(key).to_numpy().astype(np.int64).view(np.uint64)
                    bits = (k >> np.uint64(hash_bits - exponent))[:, None] + (k & np.uint64(low))[:, None] * np.arange(probes, dtype=np.uint64)
                    for row in (bits & np.uint64(low)).tolist():
                        known.append(door.issuperset(row))
                        if not known[-1]:
                            door.update(row)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(known, pa.bool_())], names=[*b.schema.names, "known"])

        return first.mapInArrow(run, StructType([*first.schema.fields, StructField("known", BooleanType())]))

    def door_hits(self) -> DataFrame:
        """Reads with ``door_hit``: all bits of the key had been set earlier in the epoch."""
        return self.reads.join(self.keys(), [*self.by, "epoch", self.key, "cell"]).select(*self.by, "epoch", "pos", self.key, "cell", ((F.col("pos") > F.col("first")) | F.col("known")).alias("door_hit"))

    def epoch_hits(self) -> DataFrame:
        """``reads`` and ``door_hits`` of each epoch."""
        return self.keys().groupBy(*self.by, "epoch").agg(F.sum("n").alias("reads"), F.sum(self._hits()).alias("door_hits"))

    def _hits(self) -> Column:
        """Hits of a key in an epoch: all its reads, but for the first if that set bits."""
        return F.col("n") - 1 + F.col("known").cast("long")

    def epoch_cells(self) -> DataFrame:
        """Increments of each cell in each epoch."""
        return self.keys().groupBy(*self.by, "epoch", "cell").agg(F.sum(self._hits()).alias("n")).where("n > 0")

    def last_epoch(self) -> DataFrame:
        """The current epoch of each cache, possibly still empty."""
        return self.reads.groupBy(*self.by).agg(F.floor(F.max("pos") / self.counters).cast("long").alias("now"))

    def estimates(self) -> DataFrame:
        """The estimate of every key that was read: its cell's aged count, plus one if the current filter has it."""
        now = self.last_epoch()
        counted = self.epoch_cells().join(now, self.by)
        carry = aged(counted, [*self.by, "cell"], F.col("epoch"), F.col("n"), F.col("now"))
        current = counted.where("epoch = now").select(*self.by, "cell", F.col("n").alias("fresh"))
        keys = self.reads.select(*self.by, F.col(self.key), "cell").distinct()
        cms = keys.join(carry, [*self.by, "cell"], "left").join(current, [*self.by, "cell"], "left")
        cms = cms.withColumn("cms", F.least(F.lit(MOST).cast("long"), F.coalesce("carry", F.lit(0)) + F.coalesce("fresh", F.lit(0))))
        live = self.reads.join(now, self.by).where("epoch = now").select(*self.by, self.key).distinct()
        live = live.select(*self.by, F.explode(self._positions()).alias("bit")).distinct()
        asked = keys.withColumn("bit", F.explode(self._positions())).join(live.withColumn("_set", F.lit(1)), [*self.by, "bit"], "left")
        door = asked.groupBy(*self.by, self.key).agg((F.count("*") == F.count("_set")).alias("door"))
        return cms.join(door, [*self.by, self.key]).select(*self.by, self.key, "cell", "cms", "door", (F.col("cms") + F.col("door").cast("long")).alias("estimate"))
