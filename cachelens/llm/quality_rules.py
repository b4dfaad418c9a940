"""Quality rules with risk-controlled thresholds, on DataFrame expressions alone.

Every text gives five counts.  Fixed base rules reject the worst; for the other signals cutoffs are certified on labelled rows.  One half of them
chooses, for each stratum and signal, the cutoff that rejects most junk less a price for good rows.  From the loosest cutoffs to the chosen
ones leads a fixed sequence of combined rules, each stricter than the one before.  They are tested in this order on the other half, the holdout, until
one fails: a combination is certified when the exact (Clopper-Pearson) binomial upper bound of its false rejection rate among good rows stays at
or below the allowed risk.  A fixed sequence needs no correction for its own length; over strata the confidence is split
evenly (Bonferroni), so that with probability ``1 - delta`` no stratum loses more than ``risk`` of its good documents to these rules.  A stratum
without a certified combination rejects nothing by them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import SPACE_CLASS, fold, release, workspace, written

#: Signals in which larger is worse, from the counts, and their sequences of cutoffs, loosest first.  A cutoff rejects values above it.
SIGNALS: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbol_ratio": ("n_symbols / n_words", (1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02)),
    "word_length": ("word_chars / n_words", (24.0, 16.0, 12.0, 10.0, 9.0, 8.0, 7.5)),
    "dup_line_ratio": ("n_dup_lines / n_lines", (0.8, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeat_ratio": ("n_repeat_words / n_words", (0.25, 0.2, 0.15, 0.1)),
}


@dataclass(frozen=True)
class Rules:
    """Parameters: allowed false rejection of good rows, failure probability, price of a good row in junk rows, words of a window."""

    risk: float = 0.02
    delta: float = 0.05
    price: float = 5.0
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_strata: int = 1000


def with_counts(df: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """``df`` and a struct column ``_q`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    A null text counts as empty.  All work stays inside the row: words become 64-bit hashes, doubling steps turn them into
    hashes of windows, and only texts in which two windows agree are sorted to find the words under repeated windows.
    Two different windows of one text agree by chance with probability below n^2 / 2^65.
    """
    if window != 8:
        raise ValueError("windows are built by doubling to 8 words")
    text_col = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(text_col, F.lit(" \t\n\x0b\f\r"))
    lines = F.filter(F.split(text_col, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = df.withColumns({"_w": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+", -1)), "_l": lines})
    d = d.withColumns(
        {
            "_n": F.size("_w").cast("long"),
            "_c": F.char_length(F.array_join("_w", "")).cast("long"),
            "_s": F.regexp_count(text_col, F.lit(r"[#*$%&|<>]")).cast("long"),
            "_nl": F.size("_l").cast("long"),
            "_dl": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.when(F.size("_w") > window, F.transform("_w", lambda x: F.xxhash64(x))),
        }
    ).drop("_w", "_l")
    for step in (1, 2, 4):  # hashes of 2, 4, 8 words
        left, right = F.slice("_h", 1, F.size("_h") - step), F.slice("_h", step + 1, F.size("_h") - step)
        d = d.withColumn("_h", F.zip_with(left, right, lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("_rep", F.coalesce(F.size(F.array_distinct("_h")) < F.size("_h"), F.lit(False)))
    sorted_ = F.when(F.col("_rep"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.withColumn("_p", sorted_).drop("_h")
    m = F.size("_p")
    same = F.zip_with(F.slice("_p", 1, m - 1), F.slice("_p", 2, m - 1), lambda a, b: a["h"] == b["h"])
    d = d.withColumn("_e", same)
    no = F.array(F.lit(False))
    marked = F.zip_with(F.concat(no, "_e"), F.concat("_e", no), lambda a, b: a | b)
    at = F.sort_array(F.array_compact(F.zip_with("_p", marked, lambda p, f: F.when(f, p["i"]))))
    d = d.withColumn("_p", at).drop("_e")
    k = F.size("_p")
    gaps = F.zip_with(F.slice("_p", 1, k - 1), F.slice("_p", 2, k - 1), lambda a, b: F.least(F.lit(window), b - a))
    covered = F.when(F.col("_rep"), F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x) + window).otherwise(F.lit(0).cast("long"))
    q = F.struct(F.col("_n").alias("n_words"), F.col("_c").alias("word_chars"), F.col("_s").alias("n_symbols"), F.col("_nl").alias("n_lines"), F.col("_dl").alias("n_dup_lines"), covered.alias("n_repeat_words"))
    return d.withColumn("_q", q).drop("_n", "_c", "_s", "_nl", "_dl", "_rep", "_p")


def base_failed(q: str, rules: Rules) -> Column:
    """The fixed rules: too few words, or too many of them under repeated windows."""
    return (F.col(f"{q}.n_words") < rules.min_words) | (100 * F.col(f"{q}.n_repeat_words") > rules.max_repeat_percent * F.col(f"{q}.n_words"))


def signal(q: str, name: str) -> Column:
    """A signal's value; 0 where its denominator is 0."""
    over, under = SIGNALS[name][0].split(" / ")
    return F.coalesce(F.try_divide(F.col(f"{q}.{over}").cast("double"), F.col(f"{q}.{under}").cast("double")), F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) by summing its terms; 1 where k > n p, as no bound below p can follow then."""
    log_first = n * F.log1p(-p)
    odds = F.log(p) - F.log1p(-p)
    start = F.struct(log_first.alias("t"), F.exp(log_first).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(steps, start, add, lambda acc: F.least(F.lit(1.0), acc["s"])))


def _strictness(name: str) -> Column:
    """Place of the first cutoff in a signal's sequence, loosest first, that rejects a row; the sequence's length if none does."""
    cuts, value = SIGNALS[name][1], signal("_q", name)
    first = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        first = F.when(value > cuts[i], F.lit(i)).otherwise(first)
    return first


def cutoffs(labelled: DataFrame, rules: Rules) -> DataFrame:
    """``stratum`` and one certified cutoff per signal (null where none is) from ``stratum, good boolean, held_out boolean, _q``.

    Rows that fail the base rules take no part.  The result has a row per stratum for which a combination is certified.
    """
    firsts = {s: f"first_{s}" for s in SIGNALS}
    passed = labelled.where(~base_failed("_q", rules)).select("stratum", "good", "held_out", *[_strictness(s).alias(n) for s, n in firsts.items()])
    # at most the product of the sequences' lengths of rows for each stratum, counted on the map side
    cells = written(passed.groupBy("stratum", "good", "held_out", *firsts.values()).count(), workspace(labelled.sparkSession, "quality-cells"))
    strata = cells.select("stratum").distinct().count()
    steps = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(i).alias("place"), F.col(firsts[s]) <= i) for s, (_, cuts) in SIGNALS.items() for i in range(len(cuts))])
    tuned = cells.where(~F.col("held_out")).select("stratum", "good", "count", F.explode(steps).alias("g")).select("stratum", "good", "count", "g.signal", "g.place", F.col("g.col3").alias("over"))
    gains = tuned.where("over").groupBy("stratum", "signal", "place").agg(F.sum(F.when(F.col("good"), -rules.price * F.col("count")).otherwise(F.col("count"))).alias("gain"))
    best = gains.where("gain > 0").groupBy("stratum", "signal").agg(F.max(F.struct("gain", (-F.col("place")).alias("loose"))).alias("b"))
    chosen = best.groupBy("stratum").agg(*[F.max(F.when(F.col("signal") == s, -F.col("b.loose"))).alias(f"at_{s}") for s in SIGNALS])
    # step t of the fixed sequence lets every chosen signal be as strict as its place t, or as chosen
    most = max(len(c) for _, c in SIGNALS.values())
    good = cells.where(F.col("held_out") & F.col("good"))
    met = good.join(chosen.withColumnRenamed("stratum", "mine"), F.col("stratum").eqNullSafe(F.col("mine")))
    hit = lambda t: F.greatest(*[F.coalesce((F.col(n) <= t) & (F.col(n) <= F.col(f"at_{s}")), F.lit(False)) for s, n in firsts.items()])
    tests = met.groupBy("stratum", *[f"at_{s}" for s in SIGNALS]).agg(F.sum("count").alias("n"), *[F.sum(F.when(hit(t), F.col("count")).otherwise(0)).alias(f"k{t}") for t in range(most)])
    certified = F.lit(None).cast("int")
    for t in range(most):  # losses never fall along the sequence, so the last step that holds comes before the first that fails
        certified = F.when(binomial_tail(F.col(f"k{t}"), F.col("n"), F.lit(rules.risk)) <= F.lit(rules.delta) / max(strata, 1), F.lit(t)).otherwise(certified)
    sure = tests.withColumn("certified", certified).where(F.col("certified").isNotNull())
    cut = lambda s: F.when(F.col(f"at_{s}").isNotNull(), F.array(*[F.lit(float(c)) for c in SIGNALS[s][1]])[F.least("certified", f"at_{s}")])
    return sure.select("stratum", *[cut(s).alias(s) for s in SIGNALS])


def judged(counted: DataFrame, cuts: DataFrame, rules: Rules, stratum: Column) -> DataFrame:
    """``counted`` with ``_base_failed`` and ``_kept``.

    The table of cutoffs is broadcast only after a count has shown at most ``max_strata`` rows; else it is joined with salt.
    """
    names = {s: f"_cut_{s}" for s in SIGNALS}
    small = cuts.select(F.coalesce(F.col("stratum"), F.lit("\x00null")).alias("_stratum"), *[F.col(s).alias(n) for s, n in names.items()])
    d = counted.withColumn("_stratum", F.coalesce(stratum, F.lit("\x00null")))
    if small.limit(rules.max_strata + 1).count() <= rules.max_strata:
        d = d.join(F.broadcast(small), "_stratum", "left")
    else:
        salts = 64
        d = d.withColumn("_salt", F.pmod(F.xxhash64("_q"), F.lit(salts))).join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["_stratum", "_salt"], "left").drop("_salt")
    bad = F.lit(False)
    for s, n in names.items():
        bad = bad | F.coalesce(signal("_q", s) > F.col(n), F.lit(False))
    d = d.withColumn("_base_failed", base_failed("_q", rules))
    return d.withColumn("_kept", ~F.col("_base_failed") & ~bad).drop("_stratum", *names.values())


def calibrated(counted: DataFrame, labels: DataFrame, rules: Rules, stratum: Column) -> DataFrame:
    """Cutoffs from counted rows (``doc_id``, ``_q``) and labels (``doc_id``, ``quality`` 1 good, 0 junk, null unknown)."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = counted.select("doc_id", stratum.alias("stratum"), "_q").join(known, "doc_id")
    return cutoffs(rows.select("stratum", (F.col("quality") == 1).alias("good"), (fold(F.col("doc_id"), 2) == 1).alias("held_out"), "_q"), rules)


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """Counts and verdict per row of ``docs`` (``doc_id``, ``text``, the stratum column).

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed``, ``kept`` (boolean).
    A null or empty text has no words and fails the base rules; a null stratum is a stratum of its own; rows with a null id or without a
    label are judged but calibrate nothing; contradicting labels of one id count as junk; repeated rows are judged one by
    one; empty tables give empty results, and empty labels certify nothing.  Other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text")
    counted = written(with_counts(src).drop("text"), workspace(spark, "quality-counts"))
    cuts = written(calibrated(counted, labels, rules, F.col("stratum")), workspace(spark, "quality-cutoffs"))
    release(spark)
    out = judged(counted, cuts, rules, F.col("stratum"))
    return out.select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names: the operator as a filter.

    Null and empty texts go, as they fail the base rules; other cases are as in ``quality_rules``; an empty table gives an empty result.
    Each text is counted once: rows are written with their counts, the cutoffs are fitted on the counts, and the rows are read again.
    """
    spark = docs.sparkSession
    name = {c: f"own{i}" for i, c in enumerate(docs.columns)}  # so no column can clash with those of the counts
    counted = written(with_counts(docs.toDF(*name.values()), name["text"]), workspace(spark, "quality-rows"))
    own = F.col(name[stratum]).cast("string")
    cuts = written(calibrated(counted.select(F.col(name["doc_id"]).alias("doc_id"), "_q", own.alias("stratum")), labels, rules, F.col("stratum")), workspace(spark, "quality-cutoffs"))
    release(spark)
    return judged(counted, cuts, rules, own).where("_kept").select(*[F.col(n).alias(c) for c, n in name.items()])
