"""Exact removal of long passages that repeat across documents, found by difference-cover anchors.

A window is ``window`` consecutive words.  With a difference cover D modulo ``period`` any two places i and j have an offset below the period that
takes both into D; so two equal windows contain, at the same offset, anchors of ``window - period + 1`` words that both start at cover
positions.  Only anchors are hashed and gathered from every document (6 of 31 places here).  Anchors that two documents share
are then extended: the windows around them, and only those, are hashed with 128 bits and compared in full.

Anchors are pre-aggregated by hash before the shuffle, and joins are by hash with a unique small side, so a passage that
a third of all documents hold meets as one row per map task, or is split by Spark's skew handling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import dropped, release, slices, whole, workspace, written
from cachelens.llm.wordhash import Lane, Words

#: A perfect difference set: every residue modulo 31 is a difference of two members.
COVER, PERIOD = (1, 5, 11, 24, 25, 27), 31
#: Bytes of text hashed at a time.
BLOCK = 1_000_000


@dataclass(frozen=True)
class Cover:
    """Window in words, period and difference cover, and passes over window hashes; anchors have ``window - period + 1`` words."""

    window: int = 50
    period: int = PERIOD
    cover: tuple[int, ...] = COVER
    passes: int = 4

    def __post_init__(self):
        if {(a - b) % self.period for a in self.cover for b in self.cover} != set(range(self.period)):
            raise ValueError("not a difference cover")
        if self.window < self.period:
            raise ValueError("the window must not be shorter than the period")

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


_lanes: list[Lane] = []


def lanes() -> list[Lane]:
    if not _lanes:
        _lanes.extend([Lane(7), Lane(11)])
    return _lanes


def _places(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every start of a window of ``size`` words: the text and the place in it."""
    n = np.maximum(counts - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)


def _anchors(cover: Cover):
    """(doc_id, tie, text) to (h, doc_id, tie, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = lanes()[0]
        member = np.zeros(cover.period, bool)
        member[list(cover.cover)] = True
        for b in batches:
            texts = b.column("text").to_pylist()
            ids, ties = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("tie").to_numpy(zero_copy_only=False)
            for a, z in slices(texts, BLOCK):
                w = Words(texts[a:z])
                doc, pos = _places(w.counts, cover.anchor)
                keep = member[pos % cover.period] & (w.counts >= cover.window)[doc]
                doc, pos = doc[keep], pos[keep]
                h = lane.windows(lane.prefix(lane.words(w)), w.first[doc] + pos, cover.anchor)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[a:z][doc], pa.int64()), pa.array(ties[a:z][doc], pa.int64()), pa.array(pos.astype(np.int32))], names=["h", "doc_id", "tie", "pos"])

    return run


def _extended(cover: Cover):
    """(doc_id, tie, text, anchors) to one row each: finished if it has no shared anchor, else its candidate windows and its text."""
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("pos", pa.list_(pa.int32())), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hits = b.column("text").to_pylist(), b.column("hits")
            for a, z in slices(texts, BLOCK):
                part, found = texts[a:z], hits.slice(a, z - a)
                has = found.is_valid().to_numpy(zero_copy_only=False)
                n_words, sha = [], []
                for t, h in zip(part, has):
                    words = t.split()
                    n_words.append(len(words))
                    sha.append(None if h else hashlib.sha256(b" ".join(words)).hexdigest())
                pos, h1, h2 = [None] * len(part), [None] * len(part), [None] * len(part)
                if has.any():
                    mine = np.flatnonzero(has)
                    w = Words([part[i] for i in mine])
                    sums = [(lane, lane.prefix(lane.words(w))) for lane in lanes()]
                    for d, i in enumerate(mine):
                        p = _candidates(found[int(i)].values.to_numpy(), int(w.counts[d]), cover)
                        at = w.first[d] + p
                        pos[i], h1[i], h2[i] = (p.astype(np.int32), *(lane.windows(s, at, cover.window).view(np.int64) for lane, s in sums))
                body = [t if h else None for t, h in zip(part, has)]
                cols = [b.column("doc_id").slice(a, z - a), b.column("tie").slice(a, z - a), n_words, sha, body, pos, h1, h2]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)

    return run


def _candidates(anchors: np.ndarray, n: int, cover: Cover) -> np.ndarray:
    """Starts of the windows that hold one of these anchors at an offset below the period."""
    mark = np.zeros(n + 2, np.int32)
    np.add.at(mark, np.maximum(anchors - cover.period + 1, 0), 1)
    np.add.at(mark, anchors + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: n - cover.window + 1] > 0)


def _without(window: int):
    """(doc_id, tie, n_words, body, gone) to (doc_id, tie, n_words, n_removed, sha, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, sha, kept = [], [], []
            for body, gone in zip(b.column("body"), b.column("gone")):
                words = body.as_py().split()
                if gone.is_valid:
                    p = gone.values.to_numpy()
                    mark = np.zeros(len(words) + 1, np.int32)
                    np.add.at(mark, p, 1)
                    np.add.at(mark, p + window, -1)
                    stay = np.flatnonzero(np.cumsum(mark[:-1]) == 0)
                    removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "tie", "n_words", "n_removed", "sha", "kept"])

    return run


def tie_breaker(docs: DataFrame) -> Column:
    """Tells rows of one id with different texts apart; a constant where ids are unique."""
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    return F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("text")


def gathered(parts: list[DataFrame], name: str) -> DataFrame:
    """``doc_id, tie`` and all places ``at`` of the passes as one array; a document has at most as many places as words."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc_id", "tie").agg(F.flatten(F.collect_list("at")).alias(name))


def removals(docs: DataFrame, tie: Column, cover: Cover = Cover()) -> tuple[DataFrame, DataFrame]:
    """Rows that lose nothing for want of a shared anchor (``doc_id, tie, n_words, sha``), and the others with what is
    left (``doc_id, tie, n_words, n_removed, sha, kept`` as bytes)."""
    spark, home = docs.sparkSession, workspace(docs.sparkSession, "substring")
    base = docs.select("doc_id", tie.alias("tie"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    anchors = written(base.where(F.col("doc_id").isNotNull()).mapInArrow(_anchors(cover), "h long, doc_id long, tie long, pos int"), f"{home}/anchors")
    # Anchors and later windows are compared in passes over slices of their hashes, so that only a slice is in shuffle files at any time.
    found = []
    for k in range(cover.passes):
        some = anchors.where(F.pmod("h", F.lit(cover.passes)) == k)
        # written first, so that the join has a plain exchange on either side and Spark can split hashes that very many documents hold
        shared = written(some.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"), f"{home}/shared-{k}")
        release(spark)
        found.append(written(some.join(shared, "h").groupBy("doc_id", "tie").agg(F.collect_set("pos").alias("at")), f"{home}/hits-{k}"))
        del some, shared
        dropped(spark, f"{home}/shared-{k}")
        release(spark)
    hits = gathered(found, "hits")
    del anchors
    dropped(spark, f"{home}/anchors")

    joined = base.join(hits, ["doc_id", "tie"], "left").select("doc_id", "tie", "text", "hits")
    rows = written(joined.mapInArrow(_extended(cover), "doc_id long, tie long, n_words long, sha string, body binary, pos array<int>, h1 array<long>, h2 array<long>"), f"{home}/rows")
    del joined, hits
    dropped(spark, *[f"{home}/hits-{k}" for k in range(cover.passes)])
    release(spark)

    found = []
    for k in range(cover.passes):
        windows = rows.where(F.col("pos").isNotNull()).select("doc_id", "tie", F.explode(F.arrays_zip("pos", "h1", "h2")).alias("w")).select("doc_id", "tie", "w.*")
        windows = windows.where(F.pmod("h1", F.lit(cover.passes)) == k)
        firsts = written(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo"), f"{home}/firsts-{k}")
        release(spark)
        gone = windows.join(firsts, ["h1", "h2"]).where("lo < doc_id").groupBy("doc_id", "tie").agg(F.collect_set("pos").alias("at"))
        found.append(written(gone, f"{home}/gone-{k}"))
        del firsts, windows, gone
        dropped(spark, f"{home}/firsts-{k}")
        release(spark)
    gone = gathered(found, "gone")
    changed = rows.where(F.col("body").isNotNull()).select("doc_id", "tie", "n_words", "body").join(gone, ["doc_id", "tie"], "left")
    changed = changed.mapInArrow(_without(cover.window), "doc_id long, tie long, n_words long, n_removed long, sha string, kept binary")
    return rows.where(F.col("sha").isNotNull()).select("doc_id", "tie", "n_words", "sha"), changed


def substring_dedup(docs: DataFrame, cover: Cover = Cover()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for the rows of ``docs`` (``doc_id``, ``text``).

    Every word under a window whose words also start in a document of a smaller id is removed; windows are judged on the input.
    A null text has no words.  A null id neither lends nor loses passages.  Rows that repeat an id are not smaller than each other, so they
    keep what they share; every row gives one row in the result.  Texts shorter than a window keep all words.  An empty table gives an empty result; other columns are ignored.  Two windows are taken as equal on 128 bits.
    """
    same, changed = removals(docs, tie_breaker(docs), cover)
    return same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")).unionByName(changed.select("doc_id", "n_words", "n_removed", F.col("sha").alias("kept_sha256")))


def dedup_texts(docs: DataFrame, cover: Cover = Cover()) -> DataFrame:
    """``docs`` with removed passages cut out of ``text``; rows that lose nothing keep their text as it was.

    Columns stay as they are, whatever their names; ``n_chars``, where there is one, follows a changed text.  Cases are as in
    ``substring_dedup``: null texts and ids stay null, every row stays, an empty table gives an empty result.
    """
    tie = tie_breaker(docs)
    _, changed = removals(docs, tie, cover)
    cut = changed.where("n_removed > 0").select("doc_id", "tie", F.decode("kept", "UTF-8").alias("kept")).dropDuplicates(["doc_id", "tie"])
    d = docs.select(whole(docs).alias("row"), "doc_id", tie.alias("tie")).join(cut, ["doc_id", "tie"], "left")
    cols = []
    for f in docs.schema:
        old = F.col("row").getField(f.name)
        new = {"text": F.coalesce("kept", old), "n_chars": F.when(F.col("kept").isNotNull(), F.char_length("kept").cast(f.dataType)).otherwise(old)}
        cols.append(new.get(f.name, old).alias(f.name))
    return d.select(*cols)
