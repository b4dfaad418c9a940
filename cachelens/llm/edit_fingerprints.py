"""Document fingerprints by a randomised edit embedding.

A text is read by a random walk: at step t the reader looks at its current character, a hash of (t, character), shared by all texts, decides
whether it moves on, and the pair (t, character) is one place of the embedding.  Two texts with few edits read the same characters at the same
steps nearly everywhere, since walks that an edit has shifted apart meet again; so their edit distance becomes a Hamming
distance of embeddings.  Texts are read in segments whose walks start afresh.  A segment begins where a hash of the ``WINDOW`` characters before
it says so, about every ``SEGMENT`` characters, whatever their place in the text; so an edit moves the segment it lies in and no other.  A
segment's places are told from those of others by the window that it begins after, and by how often that came before.

The embedding is sampled by bins: each step belongs to one of ``BINS`` bins by a hash of t, and the least hash in a bin, cut to
four bits, is kept.  The share of equal bins estimates the share of common places.  Banding over sampled bins finds candidate pairs, which are
verified on whole fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import dropped, release, scope, slices, workspace, written
from cachelens.llm.components import components, smallest_of

SEGMENT, WINDOW, BINS = 1024, 16, 128
BLOCK = 3_000_000
PAIRS = 1 << 16  # compared at once
EMPTY = np.uint32(0xFFFFFFFF)
FEW = 16  # readers that are finished one by one
_walk: list[np.ndarray] = []
_listed: list[tuple[int, int, int]] = []


def _mix32(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)).astype(np.uint32)


def walk(steps: int) -> list[np.ndarray]:
    """Multiplier, addend and bin of at least the first ``steps`` steps."""
    if not _walk or len(_walk[0]) < steps:
        t = np.arange(max(steps, 16 * SEGMENT), dtype=np.uint64)
        _walk[:] = [_mix32(3 * t + 1) | np.uint32(1), _mix32(3 * t + 2), (_mix32(3 * t + 3) % BINS).astype(np.int64)]
    return _walk


def borders(chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, text and seed of every segment of the texts of these sizes, which follow each other in ``chars``, in order.

    A border whose window equals that of the text's border before it is none, so a run of one repeated passage is not cut into pieces.
    """
    first = np.cumsum(sizes) - sizes
    owner = np.flatnonzero(sizes)
    start, seed = first[owner], np.zeros(len(owner), np.uint32)
    if len(chars) > WINDOW:
        with np.errstate(over="ignore"):
            h, mul, width = chars * np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), 1
            h ^= h >> np.uint32(15)
            while width < WINDOW:  # h[i] is over the ``width`` characters from i
                h = h[:-width] * mul + h[width:]
                mul, width = mul * mul, 2 * width
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x7FEB352D)
            h ^= h >> np.uint32(15)
        at = np.flatnonzero(h % np.uint32(SEGMENT) == 0)
        text = np.searchsorted(np.cumsum(sizes), at, side="right")
        inside = at + WINDOW < first[text] + sizes[text]
        at, text = at[inside], text[inside]
        new = np.ones(len(at), bool)
        new[1:] = (h[at[1:]] != h[at[:-1]]) | (text[1:] != text[:-1])
        at, text = at[new], text[new]
        window = h[at]
        order = np.lexsort((at, window, text))
        fresh = np.ones(len(at), bool)
        fresh[1:] = (window[order][1:] != window[order][:-1]) | (text[order][1:] != text[order][:-1])
        place = np.arange(len(at))
        before = np.empty(len(at), np.int64)
        before[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
        start = np.concatenate([start, at + WINDOW])
        owner = np.concatenate([owner, text])
        seed = np.concatenate([seed, _mix32(window.astype(np.uint64) + (before.astype(np.uint64) << np.uint64(32)))])
        order = np.argsort(start, kind="stable")
        start, owner, seed = start[order], owner[order], seed[order]
    return start, owner, seed


def sketches(texts: list[str]) -> np.ndarray:
    """The nibbles (0-14, 15 for an empty bin) of each text's fingerprint, of shape (texts, BINS)."""
    least = np.full((len(texts), BINS), EMPTY)
    sizes = np.array([len(t) for t in texts], np.int64)
    if sizes.sum():
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        start, owner, seed = borders(chars, sizes)
        end = np.append(start[1:], len(chars))
        with np.errstate(over="ignore"):  # a segment's seed enters every hash through its characters
            buf = chars + np.repeat(seed, end - start)
        order = np.argsort(start - end, kind="stable")
        for a in range(0, len(order), 4096):
            some = order[a : a + 4096]
            mins = _walked(buf, start[some], end[some])
            np.minimum.at(least, owner[some], mins)
    return np.where(least == EMPTY, 15, (least >> np.uint32(4)) % np.uint32(15)).astype(np.uint8)


def _walked(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least hash of each bin for the walks over ``buf[start:end]``."""
    mul, add, bins = walk(0)
    out = np.full((len(start), BINS), EMPTY)
    who, at, stop, t = np.arange(len(start)), start.copy(), end.copy(), 0
    mins = np.full((BINS, len(start)), EMPTY)
    with np.errstate(over="ignore"):
        while len(who) > FEW:
            room = int((stop - at).min())
            masked = room < 16
            until = t + (32 if masked else room)
            if until > len(mul):
                mul, add, bins = walk(2 * until)
            for t in range(t, until):  # noqa: B020
                if masked:
                    done = at >= stop
                    c = buf[np.minimum(at, len(buf) - 1)]
                else:
                    c = buf[at]
                x = c * mul[t]
                x += add[t]
                x ^= x >> np.uint32(16)
                x *= np.uint32(0x7FEB352D)
                x ^= x >> np.uint32(15)
                step = x >> np.uint32(31)
                if masked:
                    x[done] = EMPTY
                    step[done] = 0
                row = mins[bins[t]]
                np.minimum(row, x, out=row)
                at += step
            t += 1
            alive = at < stop
            if not alive.all():
                out[who[~alive]] = mins[:, ~alive].T
                who, at, stop, mins = who[alive], at[alive], stop[alive], np.ascontiguousarray(mins[:, alive])
    for k in range(len(who)):
        out[who[k]] = _alone(buf[at[k] : stop[k]].tolist(), t, mins[:, k].tolist())
    return out


def _alone(chars: list[int], t: int, least: list[int]) -> list[int]:
    """The same walk for one reader, from step ``t``; for a few long ones this is faster than arrays of their number."""
    steps, k = _steps(t + 2 * len(chars)), 0
    while k < len(chars):
        c, reads = chars[k], True
        while reads:
            if t == len(steps):
                steps = _steps(2 * t)
            mul, add, b = steps[t]
            x = (c * mul + add) & 0xFFFFFFFF
            x = ((x ^ x >> 16) * 0x7FEB352D) & 0xFFFFFFFF
            x ^= x >> 15
            if x < least[b]:
                least[b] = x
            t += 1
            reads = x < 0x80000000
        k += 1
    return least


def _steps(n: int) -> list[tuple[int, int, int]]:
    """``walk`` as a list."""
    if len(_listed) < n:
        _listed[:] = list(zip(*[x.tolist() for x in walk(n)]))
    return _listed


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def as_text(nibbles: np.ndarray) -> list[str]:
    flat = _HEX[nibbles].tobytes()
    return [flat[a : a + BINS].decode() for a in range(0, len(flat), BINS)]


def as_nibbles(prints: list[str]) -> np.ndarray:
    x = np.frombuffer("".join(prints).encode(), np.uint8).reshape(-1, BINS)
    return np.where(x > 57, x - 87, x - 48).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of places that two embeddings have in common, 0 to 1; 1 for equal fingerprints."""
    used = (a != 15) | (b != 15)
    same = ((a == b) & used).sum(1)
    n = used.sum(1)
    j = np.clip((same / np.maximum(n, 1) - 1 / 15) / (1 - 1 / 15), 0, 1)
    return np.where(same == n, 1.0, 2 * j / (1 + j))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _rows(texts: list[str], nexts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    new = [edited(t, n) for t, n in zip(texts, nexts)]
    return sketches(texts), sketches(new), [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new]


_SCHEMA = pa.schema([("b", pa.int64()), ("role", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
_DDL = "b long, role int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order within each bucket to finished rows (role 0), and the first (1) and last (2) of each bucket with its text."""
    held: tuple | None = None  # the row whose next one has not come yet
    for batch in batches:
        texts = batch.column("text").to_pylist()
        buckets, ids = batch.column("b").to_pylist(), batch.column("doc_id").to_pylist()
        for a, z in slices(texts, BLOCK):
            rows = list(zip(buckets[a:z], ids[a:z], texts[a:z]))
            yield _finished(rows, held)
            held = rows[-1]
    if held is not None:
        yield _edge([held], 2)


def _finished(rows: list[tuple], held: tuple | None) -> pa.RecordBatch:
    every = ([held] if held else []) + rows
    pairs = [(r, n) for r, n in zip(every, every[1:]) if r[0] == n[0]]
    last = [r for r, n in zip(every, every[1:]) if r[0] != n[0]]
    first = [n for r, n in zip(every, every[1:]) if r[0] != n[0]] + ([] if held else rows[:1])
    new = [edited(r[2], n[2]) for r, n in pairs]
    both = sketches([r[2] for r in every] + new)  # in one call, as the last steps of the longest walks are slow
    at = {id(r): k for k, r in enumerate(every)}
    mine, nexts, other = both[[at[id(r)] for r, _ in pairs]], both[[at[id(n)] for _, n in pairs]], both[len(every) :]
    done = pa.RecordBatch.from_arrays(
        [pa.array(x, f.type) for x, f in zip([[r[0] for r, _ in pairs], [0] * len(pairs), [r[1] for r, _ in pairs], [len(r[2]) for r, _ in pairs], [hashlib.sha256(x.encode()).hexdigest() for x in new], as_text(mine), as_text(other), likeness(mine, other), likeness(mine, nexts), [None] * len(pairs)], _SCHEMA)],
        schema=_SCHEMA,
    )
    table = pa.Table.from_batches([done, _edge(last, 2), _edge(first, 1)])
    return table.combine_chunks().to_batches()[0] if table.num_rows else done


def _edge(rows: list[tuple], role: int) -> pa.RecordBatch:
    n = len(rows)
    cols = [[r[0] for r in rows], [role] * n, [r[1] for r in rows], [len(r[2]) for r in rows], [None] * n, as_text(sketches([r[2] for r in rows])), [None] * n, [None] * n, [None] * n, [r[2] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _across(text: pa.Array, following: pa.Array, mine: pa.Array, other: pa.Array) -> pa.Array:
    new = [edited(t, n) for t, n in zip(text.to_pylist(), following.to_pylist())]
    a, b, c = as_nibbles(mine.to_pylist()), sketches(new), as_nibbles(other.to_pylist())
    return pa.StructArray.from_arrays([pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()), pa.array(as_text(b), pa.string()), pa.array(likeness(a, b), pa.float64()), pa.array(likeness(a, c), pa.float64())], names=["edited_sha256", "edited_fingerprint", "near_edited", "near_next"])


def fingerprint(text):
    """The fingerprint of a text column, without the comparison with other rows; null text counts as empty."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            t = [v or "" for v in x.to_pylist()]
            yield pa.array([p for a, z in slices(t, BLOCK) for p in as_text(sketches(t[a:z]))], pa.string())

    return run(text)


def edit_fingerprints(docs: DataFrame, rows_per_bucket: int = 4000, most_buckets: int = 100_000) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row of ``docs`` (``doc_id``, ``text``).

    The edited text takes its last half from the next row by descending ``doc_id``; the last row is followed by the first.  Null texts are
    empty.  Rows that share an id follow each other by a hash of the text and then the text; rows without an id come last, likewise.  Empty texts have the fingerprint without any bin,
    and are wholly alike.  A single row is its own next one; an empty table gives an empty result; other columns are ignored.

    Rows are dealt over partitions by ranges of (id, hash of the text), so that neither rows without an id nor those of one id need share
    one; a partition's rows are sorted in its task and read in a stream, and only its two edge rows are joined across partitions.
    """
    spark, home = docs.sparkSession, workspace(docs.sparkSession, "edits")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = max(1, min(most_buckets, base.count() // rows_per_bucket))
    order = F.desc_nulls_last("doc_id"), F.asc("h")
    ranged = base.withColumn("h", F.xxhash64("text")).repartitionByRange(k, *order)
    ordered = ranged.sortWithinPartitions(*order, "text").select(F.spark_partition_id().cast("long").alias("b"), "doc_id", "text")
    rows = written(ordered.mapInArrow(_along, _DDL), f"{home}/rows")
    del ranged, ordered
    release(spark)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    # one row per bucket, bounded by most_buckets + 1
    present = sorted((r["b"] for r in rows.where("role = 2").select("b").collect()))
    after = spark.createDataFrame(list(zip(present, present[1:] + present[:1])), "b long, nb long")
    first = rows.where("role = 1").select(F.col("b").alias("nb"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    edge = rows.where("role = 2").select("b", "doc_id", "n_chars", "fingerprint", "text").join(after, "b").join(first, "nb")
    edge = edge.withColumn("_x", F.arrow_udf(_across, "struct<edited_sha256:string,edited_fingerprint:string,near_edited:double,near_next:double>")("text", "next_text", "fingerprint", "next_print")).select("doc_id", "n_chars", "fingerprint", "_x.*")
    return rows.where("role = 0").select(*names).unionByName(edge.select(*names))


def _planes(prints: np.ndarray) -> np.ndarray:
    """Fingerprints of ``BINS / 2`` bytes as the four bit planes of their nibbles, of shape (4, 2, prints)."""
    bits = np.unpackbits(prints, axis=1).reshape(-1, BINS, 4).transpose(2, 0, 1)
    return np.ascontiguousarray(np.packbits(bits, axis=2).view(np.uint64).transpose(0, 2, 1))


def _passes(threshold: float) -> np.ndarray:
    """Whether ``likeness`` reaches the threshold, by the number of equal used bins and ``BINS + 1`` times that of used ones."""
    n, same = np.divmod(np.arange((BINS + 1) ** 2), BINS + 1)
    j = np.clip((same / np.maximum(n, 1) - 1 / 15) / (1 - 1 / 15), 0, 1)
    return np.where(same == n, 1.0, 2 * j / (1 + j)) >= threshold


def _forest(a: np.ndarray, b: np.ndarray, passes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest of the links between two tiles' planes (the same array twice: within one), by places in both together."""
    m, n = a.shape[2], b.shape[2]
    shift = m if a is not b else 0
    parent = np.arange(m + n if a is not b else m)
    void = [x[0] & x[1] & x[2] & x[3] for x in (a, b)]  # nibble 15 is an empty bin
    step = max(1, PAIRS // max(1, n))
    for s in range(0, m, step):
        differ, unused = np.zeros((min(step, m - s), n), np.uint8), np.zeros((min(step, m - s), n), np.uint8)
        for w in range(a.shape[1]):
            d = a[0, w, s : s + step, None] ^ b[0, w]
            for p in range(1, 4):
                d |= a[p, w, s : s + step, None] ^ b[p, w]
            differ += np.bitwise_count(d)
            unused += np.bitwise_count(void[0][w, s : s + step, None] & void[1][w])
        used = BINS - unused.astype(np.int64)
        i, j = np.nonzero(passes[used * (BINS + 1) + used - differ])
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
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return child, parent[child]


def _compare(threshold: float):
    """Rows of tiles ``a`` and ``b`` (null: within ``a``) to the edges ``u, v`` of their links' forest."""
    passes = _passes(threshold)

    def tile(x: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        rows = x.values
        return rows.field("id").to_numpy(), _planes(np.frombuffer(b"".join(rows.field("print").to_pylist()), np.uint8).reshape(-1, BINS // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(t.num_rows):
                ids, a = tile(t.column("a")[k])
                b = a
                if t.column("b")[k].is_valid:
                    more, b = tile(t.column("b")[k])
                    ids = np.concatenate([ids, more])
                u, v = _forest(a, b, passes)
                us.append(ids[u])
                vs.append(ids[v])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def fingerprint_groups(prints: DataFrame, bands: int = 32, width: int = 6, threshold: float = 0.8, tile: int = 2048, at_once: int = 8) -> DataFrame:
    """``fingerprint, group_id`` for every distinct fingerprint of ``prints`` (``doc_id, fingerprint``); see ``near_groups``.

    ``at_once`` bands are shuffled in one pass, which bounds the disk and not the pairs.
    """
    spark, home, kept = prints.sparkSession, workspace(prints.sparkSession, "edit-groups"), workspace(prints.sparkSession, "edit-named")
    rng = np.random.default_rng(9)
    places = [rng.choice(BINS, width, replace=False).tolist() for _ in range(bands)]
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()), f"{home}/distinct")
    release(spark)
    edges = None
    for k in range(0, bands, at_once):
        keys = F.array(*[F.xxhash64(F.lit(i), *[F.substring("fingerprint", p + 1, 1) for p in places[i]]) for i in range(k, min(bands, k + at_once))])
        banded = distinct.select("id", F.explode(keys).alias("band"))
        crowds = written(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), f"{home}/crowds-{k}")
        held = banded.join(crowds, "band").withColumn("parts", F.ceil(F.col("n") / tile).cast("int")).select("id", "band", "parts", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("tile"))
        shown = held.join(distinct.select("id", F.unhex("fingerprint").alias("print")), "id")
        tiles = written(shown.groupBy("band", "parts", "tile").agg(F.collect_list(F.struct("id", "print")).alias("a")), f"{home}/tiles-{k}")
        later = tiles.where("tile < parts - 1").withColumn("tile", F.explode(F.sequence(F.col("tile") + 1, F.col("parts") - 1)))
        across = later.join(tiles.select("band", "tile", F.col("a").alias("b")), ["band", "tile"]).select("a", "b")
        within = tiles.select("a", F.lit(None).cast(tiles.schema["a"].dataType).alias("b"))
        found = written(within.unionByName(across).mapInArrow(_compare(threshold), "u long, v long"), f"{home}/edges-{k}")
        edges = found if edges is None else edges.unionByName(found)
        dropped(spark, f"{home}/crowds-{k}", f"{home}/tiles-{k}")
        del banded, crowds, held, shown, tiles, later, across, within
        release(spark)
    with scope(spark):
        groups = components(edges)
        members = distinct.select("id", "least")
        named = smallest_of(members, groups, "id", "group_id").join(distinct.select("id", "fingerprint"), "id").select("fingerprint", "group_id")
        out = written(named, kept)
    dropped(spark, home)
    release(spark)
    return out


def near_groups(prints: DataFrame, bands: int = 32, width: int = 6, threshold: float = 0.8) -> DataFrame:
    """``doc_id, group_id`` from ``doc_id, fingerprint``: groups of rows linked by verified likeness of at least ``threshold``.

    Bands sample ``width`` bins each.  Distinct fingerprints that agree in a band are all compared with each other, on whole fingerprints, in
    tiles of bounded size; a pair of tiles gives a spanning forest of its links.  Rows are in proportion to members, comparisons to pairs
    within a band's group.  ``group_id`` is the smallest id of the group; rows without an id have it too.  At likeness 0.8 places are shared by
    j = 2/3, a bin agrees with probability 1/15 + 14/15 j = 0.689, a band of 6 with 0.107, and some one of 32 bands with 0.97.
    """
    return prints.join(fingerprint_groups(prints, bands, width, threshold), "fingerprint").select("doc_id", "group_id")
