import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from cachelens.llm import queries
from cachelens.llm.components import components
from cachelens.llm.packing import best_two_fit, plan
from cachelens.llm.simhash import Near, _forest, one_per_group, simhash_near_dedup
from cachelens.llm.substring_dedup import Cover, dedup_texts, substring_dedup
from cachelens.llm.wordbpe import WordBpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- substring dedup


def brute_removed(rows, window=50):
    """rows: (id, text); the words left of each row."""
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for s in range(len(w) - window + 1):
                key = tuple(w[s : s + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        if i is not None:
            for s in range(len(w) - window + 1):
                if least[tuple(w[s : s + window])] < i:
                    gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(spark, sf, documents):
    got = sorted(map(tuple, queries.op3_substring_dedup(spark, sf).collect()), key=str)
    assert got == brute_removed(list(zip(documents.doc_id.tolist(), documents.text)))
    assert sum(r[2] for r in got) > 0


def test_substring_dedup_of_planted_passages(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 63, 90)]
    rows = []
    for i in range(60):
        w = text(rng.randrange(0, 150))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(3, rows[5][1]), (3, rows[5][1]), (None, rows[5][1]), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup(df).collect()), key=str) == brute_removed(rows)


def test_substring_dedup_of_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, substring_dedup(odd).collect()), key=str) == brute_removed(rows)
    assert substring_dedup(empty).collect() == []
    cut = dedup_texts(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert {r.doc_id: r.text for r in cut.collect()}[6] == ""
    with pytest.raises(ValueError):
        Cover(cover=(0, 1, 2))


# --- simhash


def brute_print(text):
    words = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = WORD.findall(words)
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    arr = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least[r] is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, f"{prints[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def test_simhash_equals_brute_force(spark, sf, documents):
    got = sorted(map(tuple, queries.op4_simhash_near_dedup(spark, sf).collect()), key=str)
    assert got == brute_groups(list(zip(documents.doc_id.tolist(), documents.text)))


def test_simhash_of_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, simhash_near_dedup(odd).collect()), key=str) == brute_groups(rows)
    assert simhash_near_dedup(empty).collect() == []
    kept = one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "4", "5", "7", "8", "9", "10", "None"])


def test_small_tiles_lose_no_link(spark):
    """Chains of fingerprints at the radius, over tiles far smaller than in production."""
    from cachelens.llm.simhash import links

    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            prints.add(x)
            for b in rng.sample(range(64), rng.randrange(3, 6)):
                x ^= 1 << b
    prints = sorted(prints)
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    near = Near(least_tile=2, most_tile=3)
    got = {r.node: r.component for r in components(links(df, near)).collect()}
    arr = np.array(prints, np.uint64)
    root = list(range(len(arr)))
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4):
            a, b = root[i], root[j]
            if a != b:
                root = [min(a, b) if r in (a, b) else r for r in root]
    for i in range(len(arr)):
        for j in range(i):
            assert (root[i] == root[j]) == (got.get(signed[i], i) == got.get(signed[j], j))


def test_forest_spans_its_links():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 50, dtype=np.uint64)
    a = np.concatenate([a, a ^ np.uint64(1), a ^ np.uint64(3)])
    u, v = _forest(a, a, 4)
    assert len(u) == 100 and (u != v).all()
    assert len(_forest(a[:50], a[50:], 4)[0]) == 100


def test_components_of_a_long_chain(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7), (5, 4)], "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components(df.limit(0)).collect() == []


# --- packing


@pytest.fixture(scope="module")
def hf():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_packing(rows, docs, hf, capacity=4096):
    want = []
    for i, t in docs:
        ids = [*hf.encode(t or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            want.append((i, p, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


def test_packing_is_right_and_tight(spark, sf, hf, documents):
    rows = queries.op5_best_fit_packing(spark, sf).collect()
    bins, tokens = check_packing(rows, list(zip(documents.doc_id.tolist(), documents.text)), hf)
    assert bins <= -(-tokens // 4096) + 1


def test_packing_of_odd_rows(spark, odd, empty, hf):
    rows = best_two_fit(odd, with_ids=True).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()], hf)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert best_two_fit(empty).collect() == []
    check_packing(best_two_fit(odd, capacity=16).collect(), [(r.doc_id, r.text) for r in odd.collect()], hf, 16)


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(2)
    for capacity in (10, 100, 500):
        n = np.bincount(rng.integers(1, capacity + 1, 3000), minlength=capacity + 1)
        s = plan(n, capacity)
        fill = defaultdict(int)
        for length in range(1, capacity + 1):
            mine = [dict(zip(s, r)) for r in zip(*s.values()) if r[0] == length]
            for rank in range(n[length]):
                slot = [m for m in mine if m["first"] <= rank][-1]
                fill[slot["bin"] + (rank - slot["first"]) // slot["copies"]] += length
        assert max(fill.values()) <= capacity and sum(fill.values()) == (n * np.arange(capacity + 1)).sum()
        assert sorted(fill) == list(range(len(fill)))
        assert len(fill) <= 1.02 * max(sum(fill.values()) / capacity, n[capacity // 2 + 1 :].sum()) + 1


def test_two_documents_replace_the_smallest():
    # greedy: 6 + 3 leaves 1 of 10; 2 + 2 fill the expanded gap of 4
    s = plan(np.bincount([6, 3, 2, 2], minlength=11), 10)
    where = {int(n): int(b) for n, b in zip(s["length"], s["bin"])}
    assert where == {6: 0, 2: 0, 3: 1}


def test_word_ids_equal_the_library(hf, documents):
    import public_tokenizers

    mine = WordBpe(public_tokenizers.path("word_bpe_49k.json"), memory=500)
    for t in documents.text:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == hf.encode(t, add_special_tokens=False).ids
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + list(range(0x3100, 0x110000, 997))
    for c in points:
        if 0xD800 <= c < 0xE000:
            continue
        t = f"a{chr(c)}b Q{chr(c)} {chr(c)}x {chr(c)}{chr(c)} e{chr(c)}'s 12<|endoftext|>{chr(c)}"
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == hf.encode(t, add_special_tokens=False).ids, hex(c)
