"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Distinct fingerprints are sorted into tiles by the population counts of their two halves.  Two fingerprints within the radius
differ by at most the radius in those counts taken together, so all other pairs of tiles are skipped unseen; the remaining pairs are
compared in full with numpy's exclusive-or and bit counts.  Tiles hold a bounded number of fingerprints: a cell of
population counts that has more is split by hash.  A pair of tiles emits a spanning forest of its links, not the links, so a
group of thousands of near copies gives no more edges than members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import dropped, handfuls, release, scope, whole, workspace, written
from cachelens.llm.components import components, smallest_of


@dataclass(frozen=True)
class Near:
    """Words of a shingle, most differing bits of a link, hash seed, and bounds of a tile's size."""

    shingle: int = 4
    radius: int = 4
    seed: int = 42
    least_tile: int = 8192
    most_tile: int = 65536


def _fingerprints(shingle: int, seed: int):
    def one(text: bytes | None) -> int:
        import xxhash

        # bytes.split() splits at space and \x09-\x0D alone; bytes.lower() changes A-Z alone
        words = (text or b"").lower().split()
        if not words:
            return 0
        flat, n = b" ".join(words), len(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = min(shingle, n)
        h, out = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
        pairs = list(zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()))
        for a in range(0, len(pairs), 65536):
            got = np.array([h(flat[s:e], seed) for s, e in pairs[a : a + 65536]], dtype="<u8")
            out += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = (2 * out > len(pairs)).astype(np.uint8)
        return int(np.packbits(bits, bitorder="little").view("<i8")[0])

    @F.arrow_udf("long")
    def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([one(t) for part in handfuls(batch) for t in part], pa.int64())

    return fingerprints


def fingerprint(text: Column, near: Near = Near()) -> Column:
    """The signed 64 bits of a text's SimHash: a bit is set if over half its shingles' XXH64 have it.  0 without words."""
    return _fingerprints(near.shingle, near.seed)(text.cast("binary"))


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A star forest of the links between two tiles (the same array twice: within one)."""
    both = np.concatenate([a, b]) if a is not b else a
    shift = len(a) if a is not b else 0
    parent = np.arange(len(both))
    step = max(1, 1_000_000 // max(1, len(b)))
    for s in range(0, len(a), step):
        near = np.bitwise_count(a[s : s + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = i + s, j + shift
        while len(i):  # hook each link's larger root below the smaller one, then halve the paths
            ri, rj = parent[i], parent[j]
            open_ = ri != rj
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            if not len(i):
                break
            np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    child = np.flatnonzero(parent != np.arange(len(both)))
    return both[child], both[parent[child]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for k in range(t.num_rows):
                a = t.column("a")[k].values.to_numpy().view(np.uint64)
                b = a if t.column("same")[k].as_py() else t.column("b")[k].values.to_numpy().view(np.uint64)
                u, v = _forest(a, b, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return run


def links(distinct: DataFrame, near: Near = Near()) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints ``fp`` that span every group of links within the radius."""
    half = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    cells = distinct.select("fp", F.bit_count(half[0]).alias("x"), F.bit_count(half[1]).alias("y"))
    # at most 33 * 33 cells, so this table and the map below have a bound whatever the input
    sizes = cells.groupBy("x", "y").count().collect()
    total = sum(r["count"] for r in sizes)
    if not total:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("false")
    tile = min(near.most_tile, max(near.least_tile, total // 400))
    parts = {(r["x"], r["y"]): -(-r["count"] // tile) for r in sizes}
    table = F.create_map(*[F.lit(z) for (x, y), n in sorted(parts.items()) for z in (x * 64 + y, n)])
    n_parts = table[F.col("x") * 64 + F.col("y")]
    tiles = cells.withColumn("k", F.pmod(F.xxhash64("fp"), n_parts).cast("int")).groupBy("x", "y", "k").agg(F.collect_list("fp").alias("fps"))
    spark = distinct.sparkSession
    tiles = written(tiles, workspace(spark, "tiles"))
    # partners of a tile: cells at most `radius` away, each pair of tiles once
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(near.radius + 1) for dy in range(-near.radius, near.radius + 1) if dx + abs(dy) <= near.radius and (dx, dy) >= (0, 0)])
    left = tiles.select("x", "y", "k", F.col("fps").alias("a"), F.explode(around).alias("d")).withColumns({"bx": F.col("x") + F.col("d.dx"), "by": F.col("y") + F.col("d.dy")})
    pair_parts = table[F.col("bx") * 64 + F.col("by")]
    left = left.withColumn("np", pair_parts).where(F.col("np").isNotNull()).withColumn("bk", F.explode(F.sequence(F.lit(0), F.col("np").cast("int") - 1)))
    own = (F.col("bx") == F.col("x")) & (F.col("by") == F.col("y"))
    left = left.where(~own | (F.col("bk") >= F.col("k"))).withColumn("same", own & (F.col("bk") == F.col("k")))
    right = tiles.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("k").alias("bk"), F.col("fps").alias("b"))
    pairs = left.select("bx", "by", "bk", "a", "same").join(right, ["bx", "by", "bk"])
    return pairs.select("same", "a", "b").mapInArrow(_compare(near.radius), "u long, v long")


def simhash_groups(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    A null text has no words, hence fingerprint zero, which links like any other.  A null id is never the smallest of its group: its
    row gets the group's smallest id, null if there is none.  Repeated rows each get one; equal fingerprints are compared once.  Empty
    tables give empty results; other columns are ignored.
    """
    spark, home = docs.sparkSession, workspace(docs.sparkSession, "simhash")
    prints = written(docs.select("doc_id", fingerprint(F.col("text"), near).alias("fp")), f"{home}/prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{home}/distinct")
    with scope(spark):
        groups = components(links(distinct.select("fp"), near))
        named = written(smallest_of(distinct, groups, "fp", "component_id"), f"{home}/named")
    dropped(spark, f"{home}/distinct")
    release(spark)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_near_dedup(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` for every row; cases as in ``simhash_groups``."""
    return simhash_groups(docs, near).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of ``docs`` whose id is their group's smallest, with all their columns, whatever their names; null and empty texts are one group.

    Rows without an id stay, as nothing tells which of a group they are.  Of rows that repeat one id all stay if that id is kept.
    """
    keep = simhash_groups(docs.where(F.col("doc_id").isNotNull()), near).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select("doc_id", whole(docs).alias("row"))
    return rows.join(keep, "doc_id", "left_semi").select("row.*").unionByName(rows.where(F.col("doc_id").isNull()).select("row.*"))
