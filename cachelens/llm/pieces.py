"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

The text is led by the white-space marker and its spaces become markers; of all ways to cut it into pieces the one with the greatest sum of scores is taken,
ties going to the earliest start.  A character that is no piece costs less than any piece and becomes its UTF-8 bytes' pieces.  Decoding joins
pieces, turns markers into spaces, puts bytes together and drops the leading space.

No piece has a marker after another character, nor a line feed, so the best cut of a text is made of the best cuts of its chunks: markers and
what follows them up to the next marker, and line feeds.  Chunks repeat far more than texts, so their ids are kept in a bounded memory; the
chunks that a batch needs anew are cut together, one place of all of them at a time.  (Where a model has such pieces, texts are cut whole.)
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import handfuls
from cachelens.llm.token_counts import resolve

MARK = chr(0x2581)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
LONG = 160  # bytes; longer chunks are cut one by one
LEAST = -(2**62)


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id, from the protocol buffer of a ``.model`` file."""

    def number(b: bytes, i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return value, i

    def fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
        i = 0
        while i < len(b):
            tag, i = number(b, i)
            if tag & 7 == 0:
                value, i = number(b, i)
            else:
                size = {1: 8, 5: 4}.get(tag & 7)
                if size is None:
                    size, i = number(b, i)
                value, i = b[i : i + size], i + size
            yield tag >> 3, value

    out = []
    for k, v in fields(open(path, "rb").read()):
        if k == 1:
            piece = dict(fields(v))
            out.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
    return out


@dataclass
class Trie:
    """A double array: state s goes by byte b to ``base[s] + b`` if ``check`` there is s; ``value`` is the piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, keys: dict[bytes, int]) -> Trie:
        root: dict = {}
        for key, i in keys.items():
            at = root
            for b in key:
                at = at.setdefault(b, {})
            at[-1] = i
        size = 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        queue, low, dense = [(root, 0)], 257, 257
        for node, state in queue:
            value[state] = node.pop(-1, -1)
            if not node:
                continue
            kids = sorted(node)
            while check[low] >= 0:
                low += 1
                if low + 512 >= size:
                    base, check, value, size = base + [0] * size, check + [-1] * size, value + [-1] * size, 2 * size
            b = max(1, (low if len(kids) == 1 else dense) - kids[0])
            tried = 0
            while any(check[b + k] >= 0 for k in kids):
                b, tried = b + 1, tried + 1
                if b + 512 >= size:
                    base, check, value, size = base + [0] * size, check + [-1] * size, value + [-1] * size, 2 * size
            if tried > 64:  # the array is crowded here: wide states look further on from now
                dense = b + kids[0]
            base[state] = b
            for k in kids:
                check[b + k] = state
                queue.append((node[k], b + k))
        return cls(np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32))


class Model:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, memory: int = 200_000):
        pieces = read_model(path)
        self.surface = []
        self.byte_id = {}
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(p[1:-1], 16)] = i
                self.surface.append(bytes([int(p[1:-1], 16)]))
            else:
                self.surface.append(b"" if kind == CONTROL else (" " + chr(0x2047) + " ").encode() if kind == UNKNOWN else p.replace(MARK, " ").encode())
        self.unknown = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
        usable = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER, UNUSED)}
        # scores in thousandths as whole numbers, so that sums are exact whatever the text's length
        self.score = np.array([round(1000 * s) for _, s, _ in pieces], np.int64)
        self.unk_score = int(self.score[list(usable.values())].min()) - 10_000
        self.trie = Trie.of({p.encode(): i for p, i in usable.items()})
        self.longest = max(len(p.encode()) for p in usable)
        crossing = any(a != MARK and b == MARK for p in usable for a, b in zip(p, p[1:]))
        lines = any("\n" in p for p in usable)
        self.chunks = None if crossing else re.compile(" *[^ ]+| +" if lines else " *[^ \n]+|\n| +")
        self.memory, self.young, self.old = memory, {}, {}
        self._lists = None

    # --- encoding

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [(self.chunks.findall(" " + t) if self.chunks else [" " + t]) if t else [] for t in texts]
        new: dict[str, None] = {}
        young, old = self.young, self.old
        if len(young) > self.memory:
            self.old, self.young = old, young = young, {}
        for c in cut:
            for x in c:
                if x not in young:
                    if x in old:
                        young[x] = old[x]
                    else:
                        new[x] = None
        if new:
            keys = list(new)
            raw = [x.replace(" ", MARK).encode() for x in keys]
            young.update(zip(keys, self.best(raw)))
        return [b"".join([young[x] for x in c]) for c in cut]

    def best(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk, cut together in groups of like length."""
        out: list[bytes] = [b""] * len(chunks)
        order = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))
        a = 0
        while a < len(order) and len(chunks[order[a]]) <= LONG:
            n = len(chunks[order[a]])
            z = a
            while z < len(order) and len(chunks[order[z]]) <= min(LONG, n + 3) and z - a < 20_000:
                z += 1
            for i, ids in zip(order[a:z], self._together([chunks[i] for i in order[a:z]])):
                out[i] = ids
            a = z
        for i in order[a:]:
            out[i] = self.alone(chunks[i])
        return out

    def _together(self, chunks: list[bytes]) -> list[bytes]:
        n, sizes = len(chunks), np.array([len(c) for c in chunks])
        width = int(sizes.max())
        text = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in chunks), np.uint8).reshape(n, width)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = np.full((width + 1, n), LEAST, np.int64)
        best[0] = 0
        came, by = np.zeros((width + 1, n), np.int32), np.zeros((width + 1, n), np.int32)
        lead = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        columns = np.ascontiguousarray(text.T)
        for i in range(width):
            rows = np.flatnonzero((best[i] > LEAST) & (sizes > i))
            if not len(rows):
                continue
            have = best[i][rows]
            char = lead[rows, i]
            single = np.zeros(len(rows), bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for j in range(i, min(width, i + self.longest)):
                r = rows[live]
                following = base[state] + columns[j][r]
                ok = (check[following] == state) & (sizes[r] > j)
                live, state, r = live[ok], following[ok], r[ok]
                if not len(live):
                    break
                ids = value[state]
                hit = ids >= 0
                if hit.any():
                    l, r, ids = live[hit], r[hit], ids[hit]
                    single[l[char[l] == j + 1 - i]] = True
                    self._reach(best, came, by, r, i, j + 1 - i, have[l] + self.score[ids], ids)
            left = np.flatnonzero(~single)
            for size in np.unique(char[left]):
                l = left[char[left] == size]
                self._reach(best, came, by, rows[l], i, int(size), have[l] + self.unk_score, np.full(len(l), -1, np.int32))
        at, every = sizes.copy(), np.arange(n)
        steps, spans = [], []
        while at.any():
            steps.append(np.where(at > 0, by[at, every], -2))
            spans.append(at.copy())
            at = at - np.where(at > 0, came[at, every], 0)
        ids = np.array(steps, np.int32).T if steps else np.zeros((n, 0), np.int32)
        counts = (ids != -2).sum(1)
        out = []
        unknown = (ids == -1).any(1)
        flat = np.ascontiguousarray(ids[:, ::-1])
        width_ = flat.shape[1]
        for k in range(n):
            if unknown[k]:
                out.append(self._bytes_for(chunks[k], ids[k, : counts[k]][::-1].tolist(), [int(s[k]) for s in spans[: counts[k]]][::-1]))
            else:
                out.append(flat[k, width_ - counts[k] :].tobytes())
        return out

    @staticmethod
    def _reach(best, came, by, rows, start, size, total, ids) -> None:
        end = start + size
        better = total > best[end][rows]
        r = rows[better]
        best[end][r] = total[better]
        came[end][r] = size
        by[end][r] = ids[better]

    def _bytes_for(self, chunk: bytes, ids: list[int], ends: list[int]) -> bytes:
        """Replace unknown characters by their bytes' pieces, or the unknown id where the model has none."""
        out, start = [], 0
        for i, end in zip(ids, ends):
            if i >= 0:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in chunk[start:end]]
            else:
                out.append(self.unknown)
            start = end
        return np.array(out, "<u4").tobytes()

    def alone(self, chunk: bytes) -> bytes:
        """Ids of one chunk, place by place."""
        if self._lists is None:
            self._lists = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.score)]
        base, check, value, score = self._lists
        n = len(chunk)
        best, came, by = [None] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0
        for i in range(n):
            if best[i] is None:
                continue
            b = chunk[i]
            char = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            single, state = False, 0
            for j in range(i, n):
                following = base[state] + chunk[j]
                if check[following] != state:
                    break
                state = following
                if (k := value[state]) >= 0:
                    single |= j + 1 - i == char
                    total = best[i] + score[k]
                    if best[j + 1] is None or total > best[j + 1]:
                        best[j + 1], came[j + 1], by[j + 1] = total, j + 1 - i, k
            if not single and (best[i + char] is None or best[i] + self.unk_score > best[i + char]):
                best[i + char], came[i + char], by[i + char] = best[i] + self.unk_score, char, -1
        ids, ends = [], []
        while n:
            ids.append(by[n])
            ends.append(n)
            n -= came[n]
        return self._bytes_for(chunk, ids[::-1], ends[::-1])

    # --- decoding

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids."""
        surface = self.surface
        raw = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_loaded: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model of a file, kept for the life of a Python worker."""
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def encode(text: Column, name: str = "piece_bpe_32k.model") -> Column:
    """``array<int>`` of a text's piece ids; null for null."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(resolve(name))
        for batch in batches:
            texts = batch.to_pylist()
            ids = m.encode_batch([t or "" for t in texts])
            yield pa.array([None if t is None else np.frombuffer(i, "<i4") for t, i in zip(texts, ids)], pa.list_(pa.int32()))

    return run(text)


def decode(ids: Column, name: str = "piece_bpe_32k.model") -> Column:
    """The text of an ``array<int>`` of piece ids; null for null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(resolve(name))
        for batch in batches:
            yield pa.array([None if x is None else m.decode(np.array(x, "<u4").tobytes()) for x in batch.to_pylist()], pa.string())

    return run(ids)


def encode_decode(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256, round_trip`` for every row of ``docs`` (``doc_id``, ``text``).

    ``ids_crc32`` is over little-endian unsigned 32-bit ids; ``round_trip`` tells whether the decoded ids give the text again (a text with
    a literal marker character does not).  A null text is empty and has no pieces; repeated rows are encoded one by one; an empty table gives
    an empty result; other columns are ignored.  Texts are encoded whole.
    """

    @F.arrow_udf("struct<n_pieces:long,n_byte_pieces:long,ids_crc32:long,decoded_sha256:string,round_trip:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(resolve(name))
        is_byte = np.zeros(len(m.surface), bool)
        is_byte[list(m.byte_id.values())] = True
        for batch in batches:
            rows = []
            for some in handfuls(batch):
                part = [t or "" for t in some]
                for t, ids in zip(part, m.encode_batch(part)):
                    back = m.decode(ids)
                    rows.append((len(ids) // 4, int(is_byte[np.frombuffer(ids, "<u4")].sum()), zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == t))
            kinds = [("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return docs.select("doc_id", run("text").alias("p")).select("doc_id", "p.*")
