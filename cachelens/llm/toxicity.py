"""Toxicity by weak supervision.

Voters look at a text and say toxic, clean, or nothing: one for every entry of a mined lexicon (words and word beginnings that
labelled toxic texts hold and clean ones do not), some for families of entries, and patterns of style.  They vote on all rows, on the executors;
equal votes are counted, and a generative label model with one latent class estimates from those counts every voter's accuracy by expectation
maximisation.  A known label is one more piece of evidence and does not decide alone.  Correlations of voters within a class are estimated from
the same counts and discount voters that repeat each other.  A linear classifier over words and word beginnings is trained on the posterior
labels of a bounded sample of labelled rows, and its scale is set on scores of rows that it was not trained on.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import dropped, fold, handfuls, hot_hash, release, workspace, written

#: Runs of letters.
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)
ADDRESSED = re.compile(r"\b(?:you|du|tu|usted)\b[^.\n]{0,20}\b(?:are|bist|es|eres)\b[^.\n]{0,20}!", re.I)
STYLES = 4
#: Partial sums of the label model's statistics that reach the driver in each round.
PARTS = 64
_upper: list[np.ndarray] = []


@dataclass(frozen=True)
class Fit:
    """Bounds of the labelled sample (rows of each class, bytes of text), size of the lexicon, least support, strengths of priors, and the
    probability that a given label is right."""

    toxic_rows: int = 1500
    clean_rows: int = 3000
    sample_bytes: int = 32 << 20
    lexicon: int = 120
    least_support: int = 4
    least_purity: float = 0.8
    features: int = 4000
    rounds: int = 30
    ridge: float = 0.03
    trust: float = 0.98


def units(text: str) -> set[str]:
    """The lower-cased words of a text and, marked by ``^``, the beginnings of those that are long enough."""
    words = set(LETTERS.findall(text.lower()))
    out = set(words)
    for n in PREFIXES:
        out.update(["^" + w[:n] for w in words if len(w) >= n])
    return out


def found_of(text: str, table) -> list[str]:
    """The units of a text that are in ``table``; only those are looked up, so the cost is that of finding words."""
    words = set(LETTERS.findall(text.lower()))
    found = [u for u in words if u in table]
    for n in PREFIXES:
        found += [u for u in {"^" + x[:n] for x in words if len(x) >= n} if u in table]
    return found


def capitals(text: str) -> float:
    """Share of upper-case characters in a whole text."""
    if not _upper:
        _upper.append(np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000))
    return float(_upper[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].mean()) if text else 0.0


def patterns(text: str) -> list[int]:
    """Votes of the style patterns: 1 toxic, 0 clean, -1 nothing."""
    n = max(1, len(text))
    shouts = text.count("!")
    return [
        1 if shouts > 0.05 * n else -1,
        1 if n > 40 and capitals(text) > 0.5 else -1,
        1 if shouts and ADDRESSED.search(text) else -1,
        1 if shouts and ("!?" in text or "?!" in text) else -1,
    ]


@dataclass
class Model:
    """Log-odds by unit, intercept, and the calibrated line from them to a score; what the label model found, for inspection."""

    weights: dict[str, float]
    bias: float
    line: tuple[float, float]
    accuracy: dict[str, float]
    correlation: np.ndarray

    def raw(self, found: list[str]) -> float:
        return self.bias + math.fsum(self.weights[u] for u in found)

    def score(self, text: str | None) -> float:
        """The score of one text; null counts as empty."""
        a, b = self.line
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, a + b * self.raw(found_of(text or "", self.weights))))))


class Sample:
    """Texts and labels to learn from, and which units each text holds as ``row, unit`` pairs of whole numbers.

    Of near copies, whose two least word hashes agree, only the first stays, as copies make any of their words look telling.  Units are
    held as 64-bit hashes, so memory follows the number of pairs and not the words' lengths; units of fewer than ``least_support`` rows tell
    nothing and are left out.
    """

    def __init__(self, rows: list[tuple[str, int]], fit: Fit):
        self.fit, self.texts, y, seen, keys = fit, [], [], set(), []
        for t, label in rows:
            u = units(t)
            h = [zlib.crc32(x.encode()) for x in u if x[:1] != "^"]
            key = (min(h, default=-1), min(((x * 2654435761 + 97) & 0xFFFFFFFF for x in h), default=-1))
            if key not in seen:
                seen.add(key)
                self.texts.append(t)
                y.append(label)
                keys.append(np.fromiter(map(hash, u), np.int64, len(u)))
        self.y = np.array(y, np.int64)
        row = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
        key, unit, count = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
        del keys
        use = count >= fit.least_support
        place = np.cumsum(use) - 1
        keep = use[unit]
        self.row, self.unit, self.key = row[keep], place[unit[keep]].astype(np.int32), key[use]

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """For each unit, the weights of the rows that hold it, summed."""
        return np.bincount(self.unit, weight[self.row], len(self.key))

    def names(self, places: np.ndarray) -> dict[int, str]:
        """The units at these places by reading the texts once more; the least of those that share a hash."""
        wanted, out = {int(self.key[p]): int(p) for p in places}, {}
        for t in self.texts:
            for u in units(t):
                if (p := wanted.get(hash(u))) is not None:
                    out[p] = min(u, out.get(p, u))
        return out


def mine(s: Sample) -> list[str]:
    """Lexicon entries: units far commoner in toxic rows, each adding rows that the entries before it miss or confirm."""
    fit, n_t, n_c = s.fit, int((s.y == 1).sum()), int((s.y == 0).sum())
    toxic, clean = s.counts((s.y == 1) * 1.0), s.counts((s.y == 0) * 1.0)
    rate_t, rate_c = (toxic + 0.5) / n_t, (clean + 0.5) / (n_c + 1)
    good = np.flatnonzero((toxic >= fit.least_support) & (rate_t / (rate_t + rate_c) >= fit.least_purity) & (clean <= 0.002 * n_c + 1))
    gain = toxic[good] * np.log(toxic[good] / n_t / rate_c[good])
    name = s.names(good)
    order = sorted(range(len(good)), key=lambda i: (-gain[i], name[int(good[i])]))[: 40 * fit.lexicon]
    among = np.isin(s.unit, good[order]) & (s.y[s.row] == 1)
    where: dict[int, list[int]] = {}
    for r, u in zip(s.row[among].tolist(), s.unit[among].tolist()):
        where.setdefault(u, []).append(r)
    kept, covered = [], np.zeros(len(s.y))
    for i in order:
        at = where[int(good[i])]
        if (1 / (1 + covered[at])).sum() >= 0.15 * len(at):
            kept.append(name[int(good[i])])
            covered[at] += 1
        if len(kept) >= fit.lexicon:
            break
    return kept


def votes(texts: list[str], lexicon: list[str]) -> np.ndarray:
    """Rows by voters; the last two say toxic for two entries or more, and clean for none."""
    place = {u: j for j, u in enumerate(lexicon)}
    v = np.full((len(texts), len(lexicon) + STYLES + 2), -1, np.int8)
    for i, t in enumerate(texts):
        hits = [place[x] for x in found_of(t, place)]
        v[i, hits] = 1
        v[i, len(lexicon) : len(lexicon) + STYLES] = patterns(t)
        if len(hits) >= 2:
            v[i, -2] = 1
        if not hits:
            v[i, -1] = 0
    return v


@dataclass
class Beliefs:
    """What the label model believes: outcomes (1, 0, nothing) of each voter per class, class shares, each voter's discount, trust in labels."""

    theta: np.ndarray
    prior: np.ndarray
    share: np.ndarray
    trust: float

    def posterior(self, v: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Probability of class 1 per row from its votes and, where it is known (not -1), its label."""
        odds = (np.log(self.theta[1]) - np.log(self.theta[0])) * self.share[:, None]
        x = (v == 1) @ odds[:, 0] + (v == 0) @ odds[:, 1] + (v == -1) @ odds[:, 2] + np.log(self.prior[1]) - np.log(self.prior[0])
        x += np.where(y < 0, 0, 2 * y - 1) * (math.log(self.trust) - math.log(1 - self.trust))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def statistics(v: np.ndarray, y: np.ndarray, n: np.ndarray, beliefs: Beliefs | None, pairs: bool) -> np.ndarray:
    """Flat sums over rows that stand ``n`` times each: weight, outcome counts and, if asked for, products of votes, per class.

    Sums of parts add up to those of the whole.  Without beliefs, labels and any vote for toxic stand in for them.
    """
    post = beliefs.posterior(v, y) if beliefs else np.where(y >= 0, 0.05 + 0.9 * y, np.where((v == 1).any(1), 0.7, 0.05))
    w = np.stack([1 - post, post]) * n
    out = [w.sum(1), *[(w @ (v == o)).ravel() for o in (1, 0, -1)]]
    if pairs:
        on = np.where(v == 1, 1.0, np.where(v == 0, -1.0, 0.0))
        out += [((on * c[:, None]).T @ on).ravel() for c in w]
    return np.concatenate(out)


def expectation(step: Callable[[Beliefs | None, bool], np.ndarray], k: int, fit: Fit) -> tuple[Beliefs, np.ndarray, np.ndarray]:
    """Beliefs, accuracy per voter and correlation between voters by expectation maximisation.

    ``step`` gives ``statistics`` of all rows under beliefs.  A voter's evidence is divided by one plus its summed correlations with others,
    once the classes have taken shape.
    """
    beliefs, share, corr = None, np.ones(k), np.eye(k)
    for r in range(fit.rounds):
        pairs = r == fit.rounds // 3
        s = step(beliefs, pairs)
        weight, counts = s[:2], s[2 : 2 + 6 * k].reshape(3, 2, k).transpose(1, 2, 0)
        if pairs:
            corr = correlations(weight, counts, s[2 + 6 * k :].reshape(2, k, k))
            share = 1 / np.maximum(1.0, np.clip(corr, 0, 1).sum(1))
        theta = (counts + 0.5) / (weight[:, None, None] + 1.5)
        settled = beliefs is not None and r > fit.rounds // 3 + 1 and np.abs(np.log(theta / beliefs.theta)).max() < 1e-3
        beliefs = Beliefs(theta, (weight + 1) / (weight.sum() + 2), share, fit.trust)
        if settled:
            break
    right = counts[1, :, 0] + counts[0, :, 1]
    return beliefs, (right + 1) / (counts[:, :, :2].sum((0, 2)) + 2), corr


def label_model(v: np.ndarray, y: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 per row, accuracy per voter and correlation between voters, for votes ``v`` and labels ``y`` (-1 unknown) at hand."""
    beliefs, accuracy, corr = expectation(lambda beliefs, pairs: statistics(v, y, np.ones(len(v)), beliefs, pairs), v.shape[1], fit)
    return beliefs.posterior(v, y), accuracy, corr


def correlations(weight: np.ndarray, counts: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Correlation of votes (1 toxic, -1 clean, 0 nothing) given the class, averaged over classes by weight."""
    out = np.zeros(products.shape[1:])
    for w, c, p in zip(weight, counts, products):
        mean = (c[:, 0] - c[:, 1]) / max(w, 1e-9)
        cov = p / max(w, 1e-9) - np.outer(mean, mean)
        d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        out += cov / d / d[:, None] * (w / weight.sum())
    np.fill_diagonal(out, 1.0)
    return out


def linear(s: Sample, post: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Places of units, their weights and an intercept: ridge logistic regression on the soft labels of the rows ``use``, by Adam."""
    fit, hot = s.fit, (post > 0.5) & use
    n_t = max(1.0, float(hot.sum()))
    n_c = max(1.0, float(use.sum()) - n_t)
    toxic, every = s.counts(hot * 1.0), s.counts(use * 1.0)
    ratio = (toxic + 0.5) / n_t / ((every - toxic + 0.5) / n_c)
    gain = np.where((toxic >= fit.least_support) & (ratio >= 3), toxic * np.log(ratio), 0)
    chosen = np.sort(np.argsort(-gain, kind="stable")[: fit.features])
    chosen = chosen[gain[chosen] > 0]
    place = np.full(len(s.key), -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    at = np.flatnonzero((place[s.unit] >= 0) & use[s.row])
    rows, cols = s.row[at], place[s.unit[at]]
    w, b = np.zeros(len(chosen)), 0.0
    m_w, m_b, s_w, s_b = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen)), 0.0
    for t in range(1, 401):
        z = b + np.bincount(rows, w[cols], len(post))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - post) * use
        g_w = np.bincount(cols, g[rows], len(chosen)) + fit.ridge * w
        g_b = g.sum()
        m_w, m_b = 0.9 * m_w + 0.1 * g_w, 0.9 * m_b + 0.1 * g_b
        s_w, s_b = 0.99 * s_w + 0.01 * g_w**2, 0.99 * s_b + 0.01 * g_b**2
        rate = 0.1 / (1 + t / 100)
        w -= rate * (m_w / (1 - 0.9**t)) / (np.sqrt(s_w / (1 - 0.99**t)) + 1e-8)
        b -= rate * (m_b / (1 - 0.9**t)) / (math.sqrt(s_b / (1 - 0.99**t)) + 1e-8)
    return chosen, w, float(b)


def train(rows: list[tuple[str, int]], fit: Fit = Fit(), steps: Callable[[list[str]], Callable] | None = None) -> Model:
    """A model from (text, label) pairs; label 1 toxic, 0 clean.  Without both labels every text scores the base rate.

    ``steps`` gives, for a lexicon, the label model's step over all rows; without it the pairs are all rows.  The scale is set on scores of every row
    by a classifier that was trained on the four fifths of the rows it is not in.
    """
    y = np.array([r[1] for r in rows], np.int64)
    if not (y == 1).any() or not (y == 0).any():
        base = float((y == 1).mean()) if len(rows) else 0.0
        return Model({}, 0.0, (math.log(max(base, 1e-6) / max(1 - base, 1e-6)), 1.0), {}, np.zeros((0, 0)))
    s = Sample(rows, fit)
    lexicon = mine(s)
    v = votes(s.texts, lexicon)
    step = steps(lexicon) if steps else lambda beliefs, pairs: statistics(v, s.y, np.ones(len(v)), beliefs, pairs)
    beliefs, accuracy, corr = expectation(step, v.shape[1], fit)
    post = beliefs.posterior(v, s.y)
    fold_of, raw = np.arange(len(s.y)) % 5, np.zeros(len(s.y))
    for k in range(6):
        use = fold_of != k  # the last is all of them
        chosen, w, b = linear(s, post, use)
        if k < 5:
            every = np.zeros(len(s.key))
            every[chosen] = w
            raw += np.where(use, 0, b + np.bincount(s.row, every[s.unit], len(s.y)))
    name = s.names(chosen)
    weights = {name[int(p)]: float(x) for p, x in zip(chosen, w) if abs(x) > 1e-3}
    return Model(weights, b, platt(raw, s.y), dict(zip(lexicon, accuracy)), corr)


def platt(x: np.ndarray, y: np.ndarray, threshold: float = 0.7, precision: float = 0.9) -> tuple[float, float]:
    """The line through which raw scores become scores: its slope by Newton's method on Platt's smoothed targets, and its place so
    that ``threshold`` is the best cut of these rows."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    centre, scale = x.mean(), x.std() or 1.0
    f = np.stack([np.ones(len(x)), (x - centre) / scale], 1)
    a = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(f @ a, -30, 30)))
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(2), f.T @ (p - t) + 1e-2 * a)
        a -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(a[1]) / scale, 1e-6)
    # the cut of best F1 among those of good precision, half way to the next value below it, gets the threshold's score
    order = np.argsort(-x, kind="stable")
    hits, taken = np.cumsum(y[order] == 1), np.arange(1, len(x) + 1)
    f1 = np.where(hits >= precision * taken, 2 * hits / (taken + (y == 1).sum()), 0)
    f1[~np.append(np.diff(x[order]) < 0, True)] = 0
    k = int(np.argmax(f1))
    if f1[k] == 0:
        cut = x.max() + 1 / slope
    else:
        cut = (x[order][k] + x[order][k + 1]) / 2 if k + 1 < len(x) else x[order][k] - 1 / slope
    return math.log(threshold / (1 - threshold)) - slope * float(cut), slope


def fit_model(docs: DataFrame, labels: DataFrame, skip: Column, fit: Fit = Fit()) -> Model:
    """A model from ``docs`` and ``labels``, leaving out ``skip`` (a condition on ``doc_id``).

    The labelled sample takes the rows of each class with the least hashes of their ids, up to the bounds of ``fit`` on rows and bytes; of rows
    that share an id the least text stands for it.  Lexicon and classifier are learned from it on the driver.  The label model's
    statistics are of all rows that have a text, labelled or not: votes are cast, joined with labels and counted on the executors, and each round sends
    ``PARTS`` partial sums to the driver.
    """
    spark, home = docs.sparkSession, workspace(docs.sparkSession, "toxicity")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~skip).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    key = hot_hash(F.col("doc_id"), F.lit("toxicity sample"))
    mine_ = docs.where(F.col("text").isNotNull() & ~skip)
    picked: list[tuple[int, int]] = []
    for toxic, most in ((1, fit.toxic_rows), (0, fit.clean_rows)):
        picked += [(r["doc_id"], toxic) for r in known.where(F.col("toxic") == toxic).orderBy(key, "doc_id").limit(most).collect()]
    small = spark.createDataFrame(picked, "doc_id long, toxic int")  # at most toxic_rows + clean_rows ids
    texts = written(mine_.join(F.broadcast(small), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), f"{home}/texts")
    within, total = [], 0
    for r in sorted(texts.select("doc_id", F.octet_length("text").alias("n")).collect(), key=lambda r: hash_order(r["doc_id"])):
        total += r["n"]
        if total > fit.sample_bytes and within:
            break
        within.append((r["doc_id"],))
    rows = texts.join(F.broadcast(spark.createDataFrame(within, "doc_id long")), "doc_id").collect()
    rows = [(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: hash_order(r["doc_id"]))]

    def steps(lexicon: list[str]) -> Callable[[Beliefs | None, bool], np.ndarray]:
        cast = mine_.select("doc_id", ballot(lexicon)("text").alias("votes")).groupBy("doc_id", "votes").count()
        counted = cast.join(known, "doc_id", "left").groupBy("votes", "toxic").agg(F.sum("count").alias("n"))
        table = written(counted, f"{home}/votes").coalesce(PARTS)
        release(spark)

        def step(beliefs: Beliefs | None, pairs: bool) -> np.ndarray:
            parts = table.mapInArrow(_summed(beliefs, pairs, len(lexicon) + STYLES + 2), "s binary").collect()
            return np.sum([np.frombuffer(p["s"]) for p in parts], axis=0)

        return step

    model = train(rows, fit, steps)
    dropped(spark, home)
    return model


def ballot(lexicon: list[str]):
    """An Arrow UDF from a text to its votes, one byte for each voter."""

    @F.arrow_udf("binary")
    def cast(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([row.tobytes() for texts in handfuls(batch) for row in votes(texts, lexicon)], pa.binary())

    return cast


def _summed(beliefs: Beliefs | None, pairs: bool, k: int):
    """Rows ``votes, toxic, n`` to the flat sums of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            v = np.frombuffer(b"".join(b.column("votes").to_pylist()), np.int8).reshape(-1, k)
            y = b.column("toxic").fill_null(-1).to_numpy().astype(np.int64)
            part = statistics(v, y, b.column("n").to_numpy().astype(float), beliefs, pairs)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    return run


def hash_order(doc_id: int) -> int:
    """A fixed shuffle of ids, so that held-aside rows are not bound to any order of the input."""
    return (doc_id * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1)


def scorer(model: Model):
    """An Arrow UDF from a text to its score."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.score(t) for texts in handfuls(batch) for t in texts], pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id``, ``text``); ``labels`` has ``doc_id``, ``toxic``.

    Rows whose crc32(doc_id) modulo 3 is ``held_out`` teach nothing.  A null text is empty and scores as a text without words.  A row
    without an id is scored but teaches nothing and is not held out; null labels are unknown; an id with contradicting labels counts as toxic;
    repeated rows are scored one by one.  Without labels of both classes every text gets the base rate.  An empty table gives an empty result; other columns are ignored.
    """
    skip = F.coalesce(fold(F.col("doc_id"), 3) == held_out, F.lit(False))
    model = fit_model(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), skip, fit)
    d = docs.select("doc_id", skip.alias("held_out"), scorer(model)("text").alias("score"))
    return d.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
