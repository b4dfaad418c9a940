import os
from collections import Counter

import corpus_pipeline
from cachelens.llm.common import _made, scope, workspace, written
from tests.llm.test_counts_and_quality import brute_quality
from tests.llm.test_dedup_and_packing import brute_groups, brute_removed, check_packing


def test_stages_do_their_work(spark, sf, documents):
    """Each stage against brute force on what its predecessor kept."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, home = spark.read.parquet(f"{sf}/documents.parquet"), workspace(spark, "test")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == columns
        docs = written(out, f"{home}/{k}")
        kept[name] = docs.toPandas()
    language, quality, near, cut, packed = kept.values()
    text = dict(zip(documents.doc_id, documents.text))
    assert set(language.doc_id) == set(documents.doc_id)
    good = {i for i in language.doc_id if not brute_quality(text[i])[5]}
    assert set(quality.doc_id) <= good and len(quality) >= 0.8 * len(good)
    groups = brute_groups([(i, text[i]) for i in sorted(quality.doc_id)])
    assert sorted(near.doc_id) == sorted({c for _, _, c in groups})
    left = {i: (n, gone) for i, n, gone, _ in brute_removed([(i, text[i]) for i in sorted(near.doc_id)])}
    assert set(cut.doc_id) == set(near.doc_id)
    for r in cut.itertuples():
        n, gone = left[r.doc_id]
        assert len(r.text.encode().split()) == n - gone and (gone or r.text == text[r.doc_id]) and r.n_chars == (len(r.text) if gone else r.n_chars)
    hf = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check_packing(list(packed.itertuples()), list(zip(cut.doc_id.tolist(), cut.text)), hf)


def test_run_gives_the_last_stage(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and max(Counter((r.doc_id, r.piece) for r in rows).values()) == 1


def test_callers_columns_stay_as_they_are(spark, clashing, sf):
    """A column of any name that operators use inside passes through the filtering and cutting stages unchanged."""
    docs, home = clashing, workspace(spark, "test")
    own = [c for c in clashing.columns if c not in ("text", "n_chars")]
    rows = {str(r.doc_id): {c: r[c] for c in own} for r in clashing.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, sf), f"{home}/{name}")
        assert docs.columns == clashing.columns
        assert all({c: r[c] for c in own} == rows[str(r.doc_id)] for r in docs.collect()), name
    assert corpus_pipeline.STAGES[4][1](spark, clashing, sf).count() >= clashing.count()
    cut = corpus_pipeline.STAGES[3][1](spark, clashing, sf)  # every row, also those that earlier stages drop
    assert sorted(str(r.doc_id) for r in cut.collect()) == sorted(str(r.doc_id) for r in clashing.collect())
    assert all({c: r[c] for c in own} == rows[str(r.doc_id)] for r in cut.collect())


def test_stages_leave_only_results(spark, sf):
    """After the run only the tables of the stages and the pieces that the result reads are left."""
    before = set(_made)
    corpus_pipeline.run(spark, sf).collect()
    left = [p for p in set(_made) - before if os.path.isdir(p.removeprefix("file://"))]
    assert sorted(os.path.basename(p).rsplit("-", 1)[0] for p in left) == ["pieces", "pipeline"]
    with scope(spark):
        path = workspace(spark, "gone")
        written(spark.range(3), path)
    assert not os.path.exists(path.removeprefix("file://"))


def test_odd_and_empty_documents(spark, odd, empty, sf):
    for docs in (odd, empty):
        base = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            base = stage(spark, base, sf)
            base.count()
