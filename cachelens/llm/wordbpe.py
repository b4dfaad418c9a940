"""Token ids of a word-level BPE ``.json`` file (word ends marked, white space dropped, lower case), by words.

The pre-tokenizer of such files never joins what white space separates, so a text's ids are its words' ids in a row.  Words
repeat far more than texts; their ids are kept in a bounded table, in which all words of many texts are looked up at once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np

from cachelens.llm.token_counts import byte_of_symbol
from cachelens.llm.wordhash import U, Words, mix

#: Characters of the Unicode property White_Space.
WHITE = r"\t-\r " + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Beyond these code points, character classes may differ between versions of Unicode; words with such go to the tokenizers library.
UNSURE_CHAR = re.compile(f"[^{chr(0)}-{chr(0x52F)}]")
UNSURE = re.compile(f"[^ \\t-\\r]*[^{chr(0)}-{chr(0x52F)}][^ \\t-\\r]*")
LIBRARY, SPECIAL = 0xFF, 0xFE  # in no UTF-8 text; stand before a word for the library and a special string
END_TEXT, END = chr(1), b"\x01"  # stands for the end of a word; words that hold it go to the library
MARKS, LETTER = np.zeros(256, bool), np.zeros(256, bool)
MARKS[list(b".,;:!?")] = True
LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True


class Table:
    """Ids of words by a 64-bit hash of their bytes and length: open addressing over a flat array of all ids.

    ``make`` gives the ids of many words in a row and where each word's begin.  Two of ``most`` words agree by chance with
    probability below most^2 / 2^65.  A table that is full begins anew.
    """

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int):
        self.make, self.most = make, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.ends, self.flat = np.zeros(0, U), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.bits, self.slots = 12, np.full(1 << 12, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is absent."""
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        at = self.slots[slot]
        if not len(self.keys):
            return at
        away = np.flatnonzero((self.keys[at] != h) & (at >= 0))
        while len(away):
            slot[away] = (slot[away] + 1) & (len(self.slots) - 1)
            at[away] = self.slots[slot[away]]
            away = away[(self.keys[at[away]] != h[away]) & (at[away] >= 0)]
        return at

    def _put(self, places: np.ndarray) -> None:
        slot = (self.keys[places] >> U(64 - self.bits)).astype(np.int64)
        while len(places):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = places[free]  # of several that want one slot the last gets it
            open_ = self.slots[slot] != places
            places, slot = places[open_], (slot[open_] + 1) & (len(self.slots) - 1)

    def add(self, keys: np.ndarray, words: list[bytes]) -> None:
        n = len(self.keys)
        for a in range(0, len(words), 50_000):
            ids, ends = self.make(words[a : a + 50_000])
            self.ends = np.concatenate([self.ends, self.ends[-1] + ends[1:]])
            self.flat = np.concatenate([self.flat, ids])
        self.keys = np.concatenate([self.keys, keys])
        if 4 * len(self.keys) > len(self.slots):
            while 4 * len(self.keys) > len(self.slots) >> 1:
                self.bits += 1
                self.slots = np.full(1 << self.bits, -1, np.int32)
            n = 0
        self._put(np.arange(n, len(self.keys), dtype=np.int32))

    def places(self, h: np.ndarray, w: Words) -> np.ndarray:
        """Places of the words ``w`` with hashes ``h``; absent ones are made and added once."""
        at = self.find(h)
        absent = np.flatnonzero(at < 0)
        if len(absent):
            fresh, where = np.unique(h[absent], return_index=True)
            if len(self.keys) and len(self.keys) + len(fresh) > self.most:
                self.clear()
                return self.places(h, w)
            raw, where = w.buf.tobytes(), absent[where]
            self.add(fresh, [raw[a:z] for a, z in zip(w.start[where].tolist(), w.end[where].tolist())])
            at[absent] = self.find(h[absent])
        return at


def without_marks(w: Words) -> None:
    """Makes a last mark after a letter a word of its own: few marks follow many words, and no file joins the two."""
    last = np.maximum(w.end - 1, 0)
    split = MARKS[w.buf[last]] & (w.start < last) & LETTER[w.buf[last - 1]]
    before = np.concatenate([[0], np.cumsum(split)])
    at = np.arange(len(split)) + before[:-1]
    start, end = np.empty(len(split) + before[-1], np.int64), np.empty(len(split) + before[-1], np.int64)
    start[at], end[at] = w.start, np.where(split, last, w.end)
    start[at[split] + 1], end[at[split] + 1] = last[split], w.end[split]
    w.start, w.end, w.first = start, end, w.first + before[w.first]


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, by its eight-byte blocks."""
    buf = np.concatenate([w.buf, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
    size = w.end - w.start
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
    with np.errstate(over="ignore"):
        h = mix((blocks[w.start] & keep[np.minimum(size, 8)]) ^ (size.astype(U) * U(0x9E3779B97F4A7C15)))
        more, done = np.flatnonzero(size > 8), 8
        while len(more):
            left = size[more] - done
            h[more] = mix(h[more] * U(0xD6E8FEB86659FD93) + (blocks[w.start[more] + done] & keep[np.minimum(left, 8)]))
            more, done = more[left > 8], done + 8
    return h


class WordBpe:
    """Encoder of one file.  ``encode_batch`` gives unsigned 32-bit ids of many texts at once."""

    def __init__(self, path: str, memory: int = 400_000):
        import regex
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a lower-case BPE file with word ends")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        to_byte, ranks = byte_of_symbol(), {}
        for tok, i in model["vocab"].items():
            if tok in self.special:
                continue
            end = tok.endswith("</w>") and tok != "</w>"
            ranks[bytes(to_byte[c] for c in (tok[:-4] if end else tok)) + (END if end else b"")] = i
        # ids are the order of merges, so they serve as ranks; a word's last letter joins its end before anything else
        self.core = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", WHITE)
        self.parts, self.line = regex.compile("\n|" + pattern), ranks[b"\n" + END]
        self.table = Table(self._ids, memory)
        self.path, self.library = path, None

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's begin: all plain ones in one call, told apart by line ends."""
        odd = {i: w for i, w in enumerate(words) if w[0] >= 0xFE or END in w}
        text = b"\n".join([b"" if i in odd else w for i, w in enumerate(words)] if odd else words).decode()
        ids = np.array(self.core.encode_ordinary((END_TEXT + " ").join(self.parts.findall(text + "\n")) + END_TEXT), np.uint32)
        at = np.flatnonzero(ids == self.line)
        ends = np.concatenate([[0], at - np.arange(len(at))])
        ids = np.delete(ids, at)
        if odd:
            own = {i: np.array(self._odd(w), np.uint32) for i, w in odd.items()}
            rows = [own[i] if i in own else ids[a:z] for i, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))]
            ids, ends = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        return ids, ends

    def _odd(self, word: bytes) -> list[int]:
        """A special string, a word for the library, or one that holds the stand-in of a word's end."""
        if word[0] == SPECIAL:
            return [self.special[word[1:].decode()]]
        if self.library is None:
            self.library = AnyWords(self.path)
        return self.library.model.encode((word[1:] if word[0] == LIBRARY else word).decode(), add_special_tokens=False).ids

    def _normal(self, text: str) -> bytes:
        """The text as words between white space: lower case, those for the library as they stand after a leading mark."""
        if text.isascii():
            return text.lower().encode()
        out, a = [], 0
        for m in UNSURE.finditer(text) if UNSURE_CHAR.search(text) else ():
            out += [_lower(text[a : m.start()]), bytes([LIBRARY]) + m[0].encode()]
            a = m.end()
        return b"".join([*out, _lower(text[a:])])

    def _marked(self, text: str) -> bytes:
        if self.split is None or "<|" not in text:
            return self._normal(text)
        return b" ".join(bytes([SPECIAL]) + p.encode() if p in self.special else self._normal(p) for p in self.split.split(text))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last one's end)."""
        w = Words([self._marked(t) for t in texts])
        without_marks(w)
        at = self.table.places(word_hashes(w), w)
        first = self.table.ends[at]
        count = self.table.ends[at + 1] - first
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.table.flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], count)]
        return ids, ends[w.first]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0].tobytes()


def _lower(text: str) -> bytes:
    """Lower case by characters, as the file asks: Python alone would look at a final sigma's neighbours."""
    return unicodedata.normalize("NFC", text).replace(chr(0x3A3), chr(0x3C3)).lower().encode()


class AnyWords:
    """Any other file, by the tokenizers library itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.cumsum([0, *map(len, ids)])


_loaded: dict[str, WordBpe | AnyWords] = {}


def encoder(path: str) -> WordBpe | AnyWords:
    """The encoder of a file, kept for the life of a Python worker."""
    if path not in _loaded:
        try:
            _loaded[path] = WordBpe(path)
        except (ValueError, KeyError, TypeError, IndexError):
            _loaded[path] = AnyWords(path)
    return _loaded[path]
