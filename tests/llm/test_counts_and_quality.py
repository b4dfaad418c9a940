import math
import re
from collections import Counter

import pytest

from cachelens.llm import queries
from cachelens.llm.quality_rules import Rules, binomial_tail, cutoffs, keep_good, quality_rules
from cachelens.llm.token_counts import clear_cache, token_counts, tokenizer_digest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(wins)
    covered = {j for i, w in enumerate(wins) if n[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    k = len(words)
    return k, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), k < 20 or 100 * len(covered) > 30 * k


@pytest.fixture(scope="module")
def hf():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark, sf, hf, documents):
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, sf).collect()}
    assert len(got) == len(documents)
    for d in documents.itertuples():
        n = len(hf.encode(d.text, add_special_tokens=False).ids)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (n, len(d.text.encode()), n > 512)


def test_token_counts_of_odd_rows(spark, odd, empty, hf):
    rows = token_counts(odd).collect()
    assert len(rows) == odd.count()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(hf.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert token_counts(empty).collect() == []


def test_cache_is_used_and_appended(spark, odd, tmp_path):
    home = f"file://{tmp_path}/cache"
    first = sorted(map(tuple, token_counts(odd, cache=home).collect()), key=str)
    stored = spark.read.parquet(home)
    n = stored.count()
    assert n == odd.selectExpr("coalesce(text, '') t").distinct().count()
    assert sorted(map(tuple, token_counts(odd, cache=home).collect()), key=str) == first
    assert spark.read.parquet(home).count() == n
    more = odd.limit(1).selectExpr("99L AS doc_id", "'a new text' AS text")
    token_counts(more, cache=home).collect()
    assert spark.read.parquet(home).count() == n + 1
    clear_cache(spark, home)


def test_cache_with_repeated_digests(spark, odd, tmp_path):
    """Two runs that append the same digests at once leave every document one row."""
    home = f"file://{tmp_path}/cache"
    first = sorted(map(tuple, token_counts(odd, cache=home).collect()), key=str)
    at = f"{home}/tokenizer={tokenizer_digest('byte_bpe_50k.json')}"
    spark.createDataFrame(spark.read.parquet(at).collect(), "digest string, n_bytes long, n_tokens long").write.mode("append").parquet(at)
    assert sorted(map(tuple, token_counts(odd, cache=home).collect()), key=str) == first


def test_rows_without_ids(spark, hf):
    """Half the rows lack an id; many of them share a text."""
    rows = [(None if i % 2 else i, "shared words" if i % 3 else f"own words {i}") for i in range(400)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter((i, len(t.encode()), len(hf.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_certified_cutoffs_reject_junk(spark, sf):
    """On the larger table some rows go by certified cutoffs alone, and hardly any labelled good one among them."""
    big = sf.replace("sf0.001", "sf0.1")
    rows = queries.op2_quality_rules(spark, big).join(spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "quality"), "doc_id", "left")
    gone = Counter(r.quality for r in rows.where("NOT base_failed AND NOT kept").collect())
    good = rows.where("quality = 1 AND NOT base_failed").count()
    assert gone[0] > 50 and gone[1] <= 0.02 * good


def test_a_sequence_stops_at_its_first_failure(spark):
    """Good holdout rows lose nothing to the loosest cutoffs and too much to stricter ones; junk asks for the strictest."""
    rows = [("a", True, i % 2 == 0, 0 if i % 10 < 8 or i % 2 else 4) for i in range(4000)] + [("a", False, False, 4)] * 60 + [("a", False, False, 15)] * 60
    df = spark.createDataFrame([(s, g, h, (100, 500, k, 10, 0, 0)) for s, g, h, k in rows], "stratum string, good boolean, held_out boolean, _q struct<n_words:long,word_chars:long,n_symbols:long,n_lines:long,n_dup_lines:long,n_repeat_words:long>")
    assert [r.symbol_ratio for r in cutoffs(df, Rules()).collect()] == [0.05]


def test_quality_counts_equal_brute_force(spark, sf, documents):
    got = {r.doc_id: r for r in queries.op2_quality_rules(spark, sf).collect()}
    assert len(got) == len(documents)
    for d in documents.itertuples():
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(d.text), d.doc_id
        assert not (r.base_failed and r.kept)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 1), (5, 0)], "doc_id long, quality int")
    rows = quality_rules(odd, labels).collect()
    want = sorted((str(r.doc_id), *brute_quality(r.text)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert quality_rules(empty, labels).collect() == []
    kept = keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["10"]


def test_binomial_tail_is_exact(spark):
    for k, n, p in [(0, 50, 0.1), (3, 80, 0.1), (7, 100, 0.2), (30, 100, 0.2), (0, 0, 0.1)]:
        got = spark.range(1).select(binomial_tail(*[__import__("pyspark.sql.functions", fromlist=["lit"]).lit(x).cast(t) for x, t in ((k, "long"), (n, "long"), (p, "double"))]).alias("t")).first().t
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k <= n * p else 1.0
        assert abs(got - want) < 1e-9


def test_cutoffs_hold_the_risk(spark):
    """A stratum with enough labels gets a cutoff that splits junk off; one with few labels gets none."""
    rows = [("a", True, i % 2 == 0, 0) for i in range(6000)] + [("a", False, i % 2 == 0, 60) for i in range(400)] + [("b", True, i % 2 == 0, 0) for i in range(50)] + [("b", False, False, 60)] * 20
    df = spark.createDataFrame([(s, g, h, (100, 500, k, 10, 0, 0)) for s, g, h, k in rows], "stratum string, good boolean, held_out boolean, _q struct<n_words:long,word_chars:long,n_symbols:long,n_lines:long,n_dup_lines:long,n_repeat_words:long>")
    got = {r.stratum: r for r in cutoffs(df, Rules()).collect()}
    assert set(got) == {"a"} and got["a"].symbol_ratio == 0.5 and got["a"].word_length is None
