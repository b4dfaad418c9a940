"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Bins are filled greedily, largest document first and then the largest that still fits; then a bin's smallest document is replaced by the
two unpacked documents that fill its expanded gap best, if they fit more tightly, as long as that helps.

Only lengths matter for the choice, and there are at most ``capacity`` of them, so the plan is made on the histogram of lengths:
as long as no length runs out, the next bin is filled alike, so a filling is planned once with its number of bins.  The plan's size is
bounded by the capacity, not by the input.  Every piece then finds its place from its length and its rank among pieces of that
length; ranks come from counts per (length, bucket) and never gather a length in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cachelens.llm.common import handfuls, release, slices, workspace, written
from cachelens.llm.token_counts import resolve
from cachelens.llm.wordbpe import encoder

#: Characters of text encoded at a time.
BLOCK = 1_000_000


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Slots for ``counts[n]`` pieces of each length n: arrays ``length, first, bin, copies, offset``.

    The pieces of a length with ranks ``first ..`` up to the next slot's ``first`` lie in bins from ``bin`` on, ``copies`` in each from ``offset`` on.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    used_before = np.zeros_like(left)
    every = np.arange(len(left))
    slots: list[tuple[int, int, int, int, int]] = []
    bins = 0
    while left.any():
        fill: dict[int, int] = {}
        free = left.copy()

        def largest(room: int) -> int:
            at = np.flatnonzero(free[: room + 1])
            return int(at[-1]) if len(at) else 0

        room, n = capacity, largest(capacity)
        while n:
            k = 1 if not fill else min(room // n, int(free[n]))
            fill[n] = fill.get(n, 0) + k
            free[n] -= k
            room -= k * n
            n = largest(room) if room else 0
        while room and sum(fill.values()) > 1:
            s = min(fill)
            free[s] += 1
            below = np.maximum.accumulate(np.where(free > 0, every, 0))
            gap = room + s
            a = np.flatnonzero(free[:gap])
            b = below[gap - a]
            once = (b == a) & (free[a] < 2)
            b[once] = below[a[once] - 1]
            total = np.where(b > 0, a + b, 0)
            best = int(total.argmax()) if len(total) else 0
            if not len(total) or total[best] <= s:
                free[s] -= 1
                break
            fill[s] -= 1
            if not fill[s]:
                del fill[s]
            for n in (int(a[best]), int(b[best])):
                fill[n] = fill.get(n, 0) + 1
                free[n] -= 1
            room = gap - int(total[best])
        times = min(int(left[n]) // k for n, k in fill.items())
        offset = 0
        for n in sorted(fill, reverse=True):
            k = fill[n]
            slots.append((n, int(used_before[n]), bins, k, offset))
            used_before[n] += k * times
            left[n] -= k * times
            offset += k * n
        bins += times
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "bin", "copies", "offset"), table.T))


def _cut(ids: np.ndarray, ends: np.ndarray, capacity: int, end_id: int, fields: list) -> pa.ListArray:
    """The pieces of each text, from the ids of all texts in a row and their ends."""
    ids = np.insert(ids, ends[1:], np.uint32(end_id)).astype("<u4", copy=False)
    ends = ends + np.arange(len(ends))
    size = np.diff(ends)
    n = -(-size // capacity)
    lists = np.concatenate([[0], np.cumsum(n)])
    start = (np.arange(lists[-1]) - np.repeat(lists[:-1], n)) * capacity
    length = np.minimum(capacity, np.repeat(size, n) - start)
    at = np.repeat(ends[:-1], n) + start
    view = memoryview(ids).cast("B") if len(ids) else b""
    crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(at.tolist(), (at + length).tolist())]
    cols = [pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
    if len(fields) > 3:
        cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]), pa.int32()), pa.array(ids.view("<i4"))))
    return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(cols, names=[f for f, _ in fields]))


def _pieces(tokenizer: str, capacity: int, end_id: int, with_ids: bool):
    kind = "array<struct<start:long,length:long,crc:long" + (",ids:array<int>" if with_ids else "") + ">>"
    fields = [("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])

    @F.arrow_udf(kind)
    def pieces(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(resolve(tokenizer)).encode_batch
        for batch in texts:
            parts = [_cut(*encode(part[a:z]), capacity, end_id, fields) for part in ([t or "" for t in some] for some in handfuls(batch)) for a, z in slices(part, BLOCK)]
            yield pa.concat_arrays(parts or [pa.array([], pa.list_(pa.struct(fields)))])

    return pieces


def _placed(slots: dict[str, np.ndarray]):
    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        key = (slots["length"] << 44) | slots["first"]
        for length, rank in batches:
            n, r = length.to_numpy(), rank.to_numpy()
            s = np.searchsorted(key, (n << 44) | r, side="right") - 1
            q = r - slots["first"][s]
            copies = slots["copies"][s]
            yield pa.StructArray.from_arrays([pa.array(slots["bin"][s] + q // copies), pa.array(slots["offset"][s] + q % copies * n)], names=["sequence_id", "offset"])

    return place


def best_two_fit(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) for every piece of ``docs`` (``doc_id``, ``text``).

    A document is its token ids and then ``end_id``; one longer than ``capacity`` is cut into pieces of ``capacity``, the last as long as it comes.
    A null text is empty and so has ``end_id`` alone; a null id keeps its row; repeated rows are packed one by one; an empty table
    gives an empty result; other columns are ignored.  Which of several pieces of one length goes where is left open.
    """
    spark = docs.sparkSession
    cut = docs.select("doc_id", _pieces(tokenizer, capacity, end_id, with_ids)("text").alias("p")).select("doc_id", F.posexplode("p").alias("piece", "p"))
    # numbered once for all as they are written, so that no two rows are alike, whatever repeats
    cut = written(cut.select("doc_id", "piece", "p.*", F.monotonically_increasing_id().alias("row")).withColumnRenamed("crc", "ids_crc32"), workspace(spark, "pieces"))
    # at most `capacity` rows, whatever the input
    histogram = cut.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    slots = plan(counts, capacity)
    total = int(counts.sum())
    buckets = int(min(65536, max(64, total // 1000)))
    keyed = cut.withColumn("_b", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    per = keyed.groupBy("length", "_b").count()
    before = per.select("length", "_b", (F.sum("count").over(Window.partitionBy("length").orderBy("_b")) - F.col("count")).alias("_before"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("row")))
    ranked = ranked.join(before, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.col("_r") - 1)
    release(spark)
    out = ranked.withColumn("_at", _placed(slots)("length", "_rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset", *(["ids"] if with_ids else []))
