"""Key expressions: hashes, identity keys, and routing to shards, metric shards and stripes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS, STRIPES = 256, 64


def md5_index(c: Column) -> Column:
    """A 60-bit non-negative hash that every SQL engine can repeat: the first 15 hex digits of the md5."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def md5_conflict(c: Column) -> Column:
    """The next 15 hex digits, as the second hash that tells colliding keys apart."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 16, 15), 16, 10).cast("long")


def xx_index(*c: Column) -> Column:
    """A fast 63-bit non-negative hash inside Spark."""
    return F.xxhash64(*c).bitwiseAND(F.lit(2**63 - 1))


def transparent(c: Column) -> Column:
    """Integers and booleans stand for themselves."""
    return c.cast("long")


def shard(index: Column) -> Column:
    """The store shard of a key."""
    return F.pmod(index, F.lit(SHARDS))


def stripe(client: Column) -> Column:
    """The stripe of a client."""
    return client.bitwiseAND(F.lit(STRIPES - 1))


@dataclass(frozen=True)
class KeyBuilder:
    """Two expressions over a log's columns; the conflict is 0, a wildcard, unless given."""

    index: Callable[[Column], Column]
    conflict: Callable[[Column], Column] | None = None

    def build(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with ``key_index`` and ``key_conflict``."""
        return df.withColumns({"key_index": self.index(F.col(key)), "key_conflict": self.conflict(F.col(key)) if self.conflict else F.lit(0).cast("long")})


HASHED, TRANSPARENT = KeyBuilder(md5_index, md5_conflict), KeyBuilder(transparent)
