"""Language identification by interpolated Kneser-Ney character models.

One model per language, of order ``order``, over lower-cased letters with every run of other characters as one space.  All models share sorted
arrays of 64-bit n-gram hashes with a row of fully interpolated log probabilities per language, so a text is scored for all languages by one binary
search per character; characters whose n-gram no language has seen back off through the arrays of lower orders with the
back-off weights of their contexts.  The language with the lowest cross-entropy per character wins.

Confidence is a logistic function of the log likelihood ratio of the two best languages, fitted on snippets of held-aside rows.  A text is rejected
when its cross-entropy lies further above its language's usual value than nearly all held-aside texts', by a documented margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import dropped, fold, handfuls, hot_hash, slices, tidy, whole, workspace, written

U = np.uint64
BLOCK = 500_000
_PRIME = U(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Fit:
    """Order of the models; rows of a language's sample (expected; twice as many times the languages are the most of all), bytes
    of text of all samples; most languages; quantile of held-aside deviations and the margin above it from which a text is rejected."""

    order: int = 4
    sample_rows: int = 400
    sample_bytes: int = 64_000_000
    most_languages: int = 1000
    quantile: float = 0.98
    slack: float = 3.0
    snippets: tuple[int, ...] = (4, 8, 16, 32, 64)


_table: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Each code point's lower-case letter, or a space for what is no letter."""
    if not _table:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _table.append(t)
    return _table[0]


def letters(texts: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' normalised characters in a row, each text led by ``pad`` spaces, and where each begins (and the end).

    ``texts`` are UTF-32-LE.
    """
    lead = np.full(pad, 32, np.uint32).tobytes()
    x = letter_table()[np.frombuffer(lead.join([b"", *texts]), np.uint32)]
    starts = np.cumsum([0, *[len(t) // 4 + pad for t in texts]])[:-1]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    for j in range(pad):
        keep[starts + j] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return x[keep], np.concatenate([at[starts], at[-1:]])


def grams(x: np.ndarray, pos: np.ndarray | slice, k: int) -> np.ndarray:
    """The hashes of the ``k`` characters up to and with each place ``pos``, all of which lie at least ``k - 1`` after the start."""
    with np.errstate(over="ignore"):
        h = np.zeros(pos.stop - pos.start if isinstance(pos, slice) else len(pos), U)
        for back in range(k - 1, -1, -1):
            h ^= x[slice(pos.start - back, pos.stop - back)] if isinstance(pos, slice) else x[pos - back]
            h *= _PRIME
            h ^= h >> U(29)
        return h


@dataclass
class Model:
    """``keys[k]``, ``logp[k]``: n-grams of order k + 1; ``ctx[k]``, ``gamma[k]``: contexts of order k and their back-off log weights."""

    langs: list[str]
    order: int
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    ctx: list[np.ndarray] = field(default_factory=list)
    gamma: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None
    usual: np.ndarray | None = None
    spread: np.ndarray | None = None
    wander: np.ndarray | None = None
    limit: np.ndarray | None = None
    slope: tuple[float, float] = (0.0, 1.0)

    def entropies(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character and language of each text, and the number of its characters; each is led by ``order`` spaces."""
        pad = self.order
        n = np.diff(first) - pad
        total = np.zeros((len(n), len(self.langs)))
        if n.any():
            scored = np.ones(len(x), bool)
            for j in range(pad):
                scored[first[:-1] + j] = False
            doc = np.repeat(np.arange(len(n), dtype=np.int32), np.diff(first))
            open_, every = np.flatnonzero(scored), True
            for k in range(pad, 0, -1):
                h = grams(x, slice(pad, len(x)), k)[scored[pad:]] if every else grams(x, open_, k)
                keys = self.keys[k - 1]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                self._add(total, doc, open_[hit], self.logp[k - 1], at[hit])
                open_, every = open_[~hit], False
                if not len(open_):
                    break
                c = grams(x, open_ - 1, k - 1)
                ctx = self.ctx[k - 1]
                at = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
                known = ctx[at] == c
                self._add(total, doc, open_[known], self.gamma[k - 1], at[known])
            if len(open_):
                self._add(total, doc, open_, self.unseen[None, :], np.zeros(len(open_), np.int64))
        return -total / np.maximum(n, 1)[:, None], n

    @staticmethod
    def _add(total: np.ndarray, doc: np.ndarray, where: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """Add the rows ``at`` to the texts that the characters ``where`` (ascending) belong to."""
        if not len(where):
            return
        d = doc[where]
        cut = np.flatnonzero(np.diff(d, prepend=-1))
        for a in range(0, rows.shape[1], 16):
            total[d[cut], a : a + 16] += np.add.reduceat(rows[at, a : a + 16], cut, axis=0, dtype=np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether rejected, for each text."""
        lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.langs:
            return lang, score, out
        x, first = letters([(t or "").encode("utf-32-le", "surrogatepass") for t in texts], self.order)
        n_letters = np.add.reduceat((x != 32).astype(np.int64), first[:-1]) if len(texts) else np.zeros(0)
        h, n = self.entropies(x, first)
        order = np.argsort(h, axis=1, kind="stable")
        best = order[:, 0]
        rows = np.arange(len(texts))
        second = h[rows, order[:, 1]] if len(self.langs) > 1 else h[rows, best] + 1
        p = self.confidence((second - h[rows, best]) * n)
        z = (h[rows, best] - self.usual[best]) / (self.wander[best] + self.spread[best] / np.sqrt(np.maximum(n, 1)))
        for i in range(len(texts)):
            if n_letters[i] > 0:
                lang[i], score[i], out[i] = self.langs[best[i]], p[i], z[i] > self.limit[best[i]]
        return lang, score, out

    def confidence(self, ratio: np.ndarray) -> np.ndarray:
        a, b = self.slope
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(np.maximum(ratio, 0)), -30, 30)))


def train(rows: list[tuple[str, str]], held: list[tuple[str, str]], fit: Fit = Fit()) -> Model:
    """A model from (language, text) pairs, calibrated on other pairs."""
    langs = sorted({l for l, _ in rows})
    m = Model(langs, fit.order)
    if not langs:
        return m
    data = []
    for l in langs:
        x, first = letters([t.encode("utf-32-le", "surrogatepass") for k, t in rows if k == l], fit.order)
        scored = np.ones(len(x), bool)
        for j in range(fit.order):
            scored[first[:-1] + j] = False
        data.append((x, np.flatnonzero(scored)))
    below_rows, below_keys = None, None
    n_char = 1 << 16
    for k in range(1, fit.order + 1):
        # an n-gram, its suffix, its context; every one seen in any language, sorted by hash
        parts = []
        for x, at in data:  # hashes are made anew for each order, as those of all orders together would fill the driver
            if k < fit.order:  # continuation: distinct longer n-grams that end in this one
                _, i = np.unique(grams(x, at, k + 1), return_index=True)
                at = at[i]
            g, i, c = np.unique(grams(x, at, k), return_index=True, return_counts=True)
            at = at[i]
            parts.append((g, grams(x, at, k - 1), grams(x, at - 1, k - 1), c))
        keys, pick = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        suffix = np.concatenate([p[1] for p in parts])[pick]
        context = np.concatenate([p[2] for p in parts])[pick]
        ctx = np.unique(np.concatenate([p[2] for p in parts]))
        prob = np.zeros((len(keys), len(langs)))
        gamma = np.ones((len(ctx), len(langs)))
        lower = np.full((len(keys), len(langs)), 1 / n_char) if k == 1 else np.exp(below_rows[np.searchsorted(below_keys, suffix)])
        for j, (g, _, c_hash, c) in enumerate(parts):
            if not len(g):
                continue
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            at = np.searchsorted(ctx, c_hash)
            total = np.bincount(at, c, len(ctx))
            kinds = np.bincount(at, minlength=len(ctx))
            seen = total > 0
            gamma[seen, j] = discount * kinds[seen] / total[seen]
            prob[np.searchsorted(keys, g), j] = (c - discount) / total[at]
        prob += gamma[np.searchsorted(ctx, context)] * lower
        m.keys.append(keys)
        m.logp.append(np.log(prob).astype(np.float32))
        m.ctx.append(ctx)
        m.gamma.append(np.log(gamma).astype(np.float32))
        below_keys, below_rows = keys, np.log(prob)
    m.unseen = np.full(len(langs), np.log(1 / n_char), np.float32)
    calibrate(m, held or rows, fit)
    return m


def calibrate(m: Model, held: list[tuple[str, str]], fit: Fit) -> None:
    """Usual cross-entropies, limits of rejection, and the confidence curve, from rows that the models have not seen."""
    n = len(m.langs)
    m.usual, m.spread, m.wander, m.limit = np.full(n, 3.0), np.full(n, 3.0), np.full(n, 0.25), np.full(n, 4.0)
    place = {l: i for i, l in enumerate(m.langs)}
    held = [(l, t) for l, t in held if l in place]
    x, first = letters([t.encode("utf-32-le", "surrogatepass") for _, t in held], m.order)
    h, size = m.entropies(x, first)
    true = np.array([place[l] for l, _ in held], np.int64)
    for j in range(n):
        mine = (true == j) & (size > 20)
        if mine.sum() < 5:
            continue
        v, s = h[mine, j], size[mine]
        m.usual[j] = np.median(v)
        m.wander[j] = max(0.1, 1.4826 * np.median(np.abs(v - m.usual[j])))
        z = (v - m.usual[j]) / (m.wander[j] + m.spread[j] / np.sqrt(s))
        m.limit[j] = np.quantile(z, fit.quantile) + fit.slack
    # snippets of every length, cut from whole texts at every length's step, give right and wrong decisions to fit on
    ratio, right = [], []
    for size_ in fit.snippets:
        parts, owner = [], []
        for i in range(len(held)):
            a, z = first[i] + m.order, first[i + 1]
            at = np.arange(a, max(a, z - size_), max(size_, (z - a) // 8 + 1))
            parts += [x[p : p + size_] for p in at]
            owner += [true[i]] * len(at)
        if not parts:
            continue
        lead = np.full(m.order, 32, np.uint32)
        bounds = np.cumsum([0, *[len(p) + m.order for p in parts]])
        e, _ = m.entropies(np.concatenate([y for p in parts for y in (lead, p)]), bounds)
        o = np.sort(e, axis=1)
        ratio.append(((o[:, 1] - o[:, 0]) if n > 1 else np.ones(len(e))) * size_)
        right.append(e.argmin(axis=1) == np.array(owner))
    if ratio:
        m.slope = logistic(np.log1p(np.concatenate(ratio)), np.concatenate(right))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with Platt's smoothed targets and a small ridge."""
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2)
    t, a = np.where(y, up, down), np.zeros(2)
    f = np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ a, -30, 30)))
        grad = f.T @ (p - t) + 1e-3 * a
        hess = (f * (p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(max(a[1], 0.0))


def fit_model(docs: DataFrame, fit: Fit = Fit(), skip: Column | None = None) -> Model:
    """Fit on a bounded sample of the rows of ``docs`` that have a text, a language and an id, leaving out ``skip``.

    The sample takes each language's rows by a hash of the id, ``fit.sample_rows`` of them expected; a quarter calibrates.  Of rows that share id and
    language the least text stands for all.  Should the sample still pass its bounds on rows or bytes, those of the least hashes stay.
    """
    use = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if skip is not None:
        use = use.where(~skip)
    counts = {r["lang"]: r["n"] for r in use.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(fit.most_languages + 1).collect()}
    if len(counts) > fit.most_languages:
        raise ValueError(f"more than {fit.most_languages} languages")
    if not counts:
        return train([], [], fit)
    rate = F.create_map(*[v for l, n in sorted(counts.items()) for v in (F.lit(l), F.lit(min(1.0, fit.sample_rows / n)))])
    key = hot_hash(F.col("doc_id"), F.lit("language sample"))
    home = workspace(docs.sparkSession, "language-sample")
    sample = written(use.where(key < rate[F.col("lang")] * F.lit(float(2**62))).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).withColumn("hash", key), home)
    sizes = sample.select("hash", F.octet_length("text").alias("n")).orderBy("hash", "n").limit(2 * fit.sample_rows * len(counts) + 1).collect()
    sums = np.cumsum([r["n"] for r in sizes])
    over = [r["hash"] for i, r in enumerate(sizes) if i and (sums[i] > fit.sample_bytes or i == 2 * fit.sample_rows * len(counts))]
    if over:
        sample = sample.where(F.col("hash") < max(over[0], sizes[0]["hash"] + 1))
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in sample.select("doc_id", "lang", "text").collect())
    dropped(docs.sparkSession, home)
    mine = [(l, t) for k, (_, l, t) in enumerate(rows) if k % 4]
    held = [(l, t) for k, (_, l, t) in enumerate(rows) if k % 4 == 0]
    return train(mine or held, held, fit)


def predictor(model: Model):
    """An Arrow UDF from a text to ``struct<lang_pred, score, rejected>``."""

    def judged(batch: pa.Array) -> pa.Array:
        lang, score, out = [], [], []
        for texts in handfuls(batch):
            for a, z in slices([t or "" for t in texts], BLOCK):
                l, s, r = model.predict(texts[a:z])
                lang += l
                score.append(s)
                out.append(r)
        cols = [pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64()), pa.array(np.concatenate(out) if out else [], pa.bool_())]
        return pa.StructArray.from_arrays(cols, names=["lang_pred", "score", "rejected"])

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(judged, batches)
        tidy()

    return predict


def identify(docs: DataFrame, fit: Fit = Fit(), held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row of ``docs`` (``doc_id``, ``text``, ``lang``).

    Rows whose crc32(doc_id) modulo 4 is ``held_out`` teach nothing.  A text that is null or has no letter gives ``und`` with score 0, as do all texts
    when no row has a language.  A row without an id is not held out but teaches nothing either.  Ties go to the first language by
    name; repeated rows are judged one by one; an empty table gives an empty result; other columns are ignored.
    """
    out = F.coalesce(fold(F.col("doc_id"), 4) == held_out, F.lit(False))
    model = fit_model(docs, fit, out)
    d = docs.select("doc_id", out.alias("held_out"), predictor(model)("text").alias("p"))
    return d.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def keep_known(docs: DataFrame, fit: Fit = Fit(), held_out: int = 2) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with all their columns, whatever their names.

    Null, empty and letterless texts go.  Rows without an id or a language are judged like any other; repeated rows are judged one by one; an empty table
    gives an empty result, and without any language to learn from no row stays.
    """
    out = F.coalesce(fold(F.col("doc_id"), 4) == held_out, F.lit(False))
    model = fit_model(docs, fit, out)
    judged = docs.select(whole(docs).alias("row"), predictor(model)("text").alias("p"))
    return judged.where("NOT p.rejected AND p.lang_pred <> 'und'").select("row.*")
