"""URL filters: listed rules, and for all other urls a path-template tree with labelled purity.

Per host, paths form a tree of segments.  Numbers and hexadecimal names are generalised at once; then level by level, a node with too many children takes its
rare ones together as wildcards, as far as their labels are alike, and children whose shares of rejected labels do not differ significantly are merged into one branch.  A
template is rejected when its share of rejected labels, shrunk towards its ancestors' and that of the same template on other hosts, reaches a threshold.

Only counts per (host, lexical template) are shuffled, pre-aggregated on the map side; a node's rare children are counted by their labels before they
are gathered, so a host with a third of all pages costs one group no more than any other.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import dropped, release, workspace, written

#: (host, path, verdict) of the rules that hold before any template.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Tree:
    """Levels that are always told apart (deeper ones as long as labels differ), children of a node before wildcards, z of a significant difference,
    pseudo-labels on either side, and the share from which a template is rejected."""

    depth: int = 6
    most_children: int = 32
    z: float = 2.0
    smoothing: float = 1.0
    threshold: float = 0.8


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host + path``, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def lexical(path: Column) -> Column:
    """A path's segments with numbers as ``{n}`` and long hexadecimal names as ``{x}``."""
    return F.transform(
        F.filter(F.split(path, "/", -1), lambda s: s != ""),
        lambda s: F.when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$") & s.rlike("[a-fA-F]"), F.lit("{x}")).otherwise(F.regexp_replace(s, r"[0-9]+", "{n}")),
    )


def _branches(z: float):
    """Children (segment, how many such, rejected, accepted of each) to (segment, merged branch), alike ones under one name.

    A rare child comes without a name of its own, once for all that have the same counts; its ``seg`` starts with a slash.  Labelled rare children stay
    in one pool unless they differ from the pool significantly; those that do are compared like named ones.  Unlabelled ones are never mixed with labelled.
    """

    def merged(kids: list[dict]) -> list[tuple[str, str]]:
        units: list[tuple[int, int, list[str]]] = [(k["bad"], k["good"], [k["seg"]]) for k in kids if k["seg"][0] != "/"]
        rare = [k for k in kids if k["seg"][0] == "/"]
        bad, good = (sum(k["kids"] * k[c] for k in rare) for c in ("bad", "good"))
        pool: tuple[int, int, list[str]] = (0, 0, [])
        for k in rare:
            n = k["bad"] + k["good"]
            unit = (k["kids"] * k["bad"], k["kids"] * k["good"], [k["seg"]])
            if n and _alike(k["bad"], n, bad, bad + good, z):
                pool = (pool[0] + unit[0], pool[1] + unit[1], pool[2] + unit[2])
            else:
                units.append(unit)
        if pool[2]:
            units.append(pool)
        groups: list[tuple[int, int, list[str]]] = []
        for b, g, segs in sorted(units, key=lambda u: ((u[0] + 1) / (u[0] + u[1] + 2), u[2])):
            if groups:
                bad, good, names = groups[-1]
                n, m = b + g, bad + good
                if (n == 0) == (m == 0) and (n == 0 or _alike(b, n, bad, m, z)):
                    groups[-1] = (bad + b, good + g, names + segs)
                    continue
            groups.append((b, g, list(segs)))
        out = []
        for i, (b, g, names) in enumerate(groups):  # digits are no part of lexical segments
            told = sorted(s for s in names if s[0] != "/") + ([f"*{i + 1}" if b + g else "*"] if any(s[0] == "/" for s in names) else [])
            out += [(s, told[0] if len(told) == 1 else "(" + "|".join(told) + ")") for s in names]
        return out

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [[{"seg": s, "into": i} for s, i in merged(kids)] for kids in batch.to_pylist()]
            yield pa.array(rows, pa.list_(pa.struct([("seg", pa.string()), ("into", pa.string())])))

    return run


def _alike(a: int, n: int, b: int, m: int, z: float) -> bool:
    """Whether two shares a/n and b/m do not differ significantly, by the pooled two-proportion test."""
    p = (a + b) / (n + m)
    return abs(a / n - b / m) <= z * math.sqrt(p * (1 - p) * (1 / n + 1 / m)) + 1e-12


def _stopped(m: DataFrame, d: int, tree: Tree, home: str) -> DataFrame:
    """Templates cut to ``d - 1`` segments and ``**`` below nodes whose labels are all the same or too few to differ significantly."""
    deep = m.where(F.size("t") >= d).withColumn("up", F.slice("t", 1, d - 1))
    nodes = written(deep.groupBy("host", "up").agg(F.sum("bad").alias("b"), F.sum("good").alias("g")), f"{home}/{d}-nodes")
    # b rejected against g accepted ones, the widest difference there can be, has z = sqrt(b + g)
    open_ = (F.col("b") > 0) & (F.col("g") > 0) & (F.col("b") + F.col("g") > tree.z**2)
    cut = deep.join(nodes, ["host", "up"]).select(*m.columns[:-1], F.when(open_, F.col("t")).otherwise(F.concat("up", F.array(F.lit("**")))).alias("t"))
    return written(m.where(F.size("t") < d).unionByName(cut), f"{home}/{d}-stopped")


def templates(urls: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """``host, t0`` (a lexical template) with its ``template`` and ``purity`` from rows ``host, t0, label`` (1 rejected, 0 accepted, null unknown)."""
    spark, home = urls.sparkSession, workspace(urls.sparkSession, "templates")
    counts = urls.groupBy("host", "t0").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good"))
    m = written(counts.withColumn("t", F.col("t0")), f"{home}/0")
    for d in itertools.count(1):
        if d > tree.depth:
            m = _stopped(m, d, tree, home)
        if m.where((F.size("t") >= d) & (F.col("t")[F.least(F.lit(d), F.size("t")) - 1] != "**")).isEmpty():
            break
        here = m.where(F.size("t") >= d).select("host", F.slice("t", 1, d - 1).alias("up"), F.col("t")[d - 1].alias("seg"), "n", "bad", "good")
        kids = here.groupBy("host", "up", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
        kids = written(kids, f"{home}/{d}-counts")  # both sides of the next join are then plain tables, and Spark can split a host's level
        nodes = written(kids.groupBy("host", "up").agg(F.count("*").alias("kids"), F.sum("n").alias("all")), f"{home}/{d}-sizes")
        rare = (F.col("kids") > tree.most_children) & (F.col("n") * tree.most_children < F.col("all"))
        named = kids.join(nodes, ["host", "up"]).withColumn("wild", F.when(rare, F.concat_ws("/", F.lit(""), "bad", "good")).otherwise(F.col("seg")))
        named = written(named.select("host", "up", "seg", "wild", "bad", "good"), f"{home}/{d}-kids")
        few = named.groupBy("host", "up", "wild").agg(F.count("*").alias("kids"), F.first("bad").alias("bad"), F.first("good").alias("good"))  # alike within "wild"
        sets = few.groupBy("host", "up").agg(F.collect_list(F.struct(F.col("wild").alias("seg"), "kids", "bad", "good")).alias("k"))
        into = sets.select("host", "up", F.explode(F.arrow_udf(_branches(tree.z), "array<struct<seg:string,into:string>>")("k")).alias("b")).select("host", "up", F.col("b.seg").alias("wild"), "b.into")
        moves = named.join(into, ["host", "up", "wild"]).select("host", "up", "seg", "into")
        keyed = m.withColumns({"up": F.when(F.size("t") >= d, F.slice("t", 1, d - 1)), "seg": F.when(F.size("t") >= d, F.col("t")[d - 1])})
        moved = keyed.join(moves, ["host", "up", "seg"], "left")
        t = F.when(F.col("into").isNotNull(), F.concat(F.slice("t", 1, d - 1), F.array("into"), F.slice("t", d + 1, F.size("t")))).otherwise(F.col("t"))
        m = written(moved.select("host", "t0", "n", "bad", "good", t.alias("t")), f"{home}/{d}")
    found = m.join(_above(m, tree, home), ["host", "t"]).join(_elsewhere(m, home), "t0").select("host", "t0", F.concat(F.lit("/"), F.array_join("t", "/")).alias("template"), _purity(tree).alias("purity"))
    found = written(found, workspace(spark, "purities"))
    dropped(spark, home)
    release(spark)
    return found


def _elsewhere(m: DataFrame, home: str) -> DataFrame:
    """``t0, b_all, g_all``: the labels of a lexical template over all hosts."""
    return written(m.groupBy("t0").agg(F.sum("bad").alias("b_all"), F.sum("good").alias("g_all")), f"{home}/over-hosts")


def _above(m: DataFrame, tree: Tree, home: str) -> DataFrame:
    """``host, t, b, g, above, told``: a template's labels, the share of its ancestors, each shrunk towards its own parent, and whether the host has a label."""
    s = 2 * tree.smoothing
    leaf = written(m.groupBy("host", "t").agg(F.sum("bad").alias("b"), F.sum("good").alias("g")), f"{home}/leaves")
    up = leaf.select("host", "t", "b", "g", F.explode(F.sequence(F.lit(0), F.greatest(F.size("t") - 1, F.lit(0)))).alias("d")).withColumn("up", F.slice("t", 1, F.col("d")))
    nodes = written(up.groupBy("host", "up").agg(F.sum("b").alias("up_b"), F.sum("g").alias("up_g")), f"{home}/nodes")
    chain = up.join(nodes, ["host", "up"]).groupBy("host", "t").agg(F.array_sort(F.collect_list(F.struct("d", "up_b", "up_g"))).alias("chain"))
    above = F.aggregate("chain", F.lit(0.5), lambda p, x: (x["up_b"] + s * p) / (x["up_b"] + x["up_g"] + s))
    told = F.col("chain")[0]["up_b"] + F.col("chain")[0]["up_g"] > 0
    return written(leaf.join(chain.select("host", "t", above.alias("above"), told.alias("told")), ["host", "t"]), f"{home}/above")


def _purity(tree: Tree) -> Column:
    """A template's share of rejected labels, shrunk towards a prior with the weight of the pseudo-labels.

    The prior is the mean of its ancestors' share and that of the same lexical template on all other hosts; if the host has no label, the latter alone.
    Unlabelled siblings are one template, so the latter is looked up for each lexical template.
    """
    s = 2 * tree.smoothing
    bad, good = F.col("b_all") - F.col("bad"), F.col("g_all") - F.col("good")
    elsewhere = (bad + tree.smoothing) / (bad + good + s)
    prior = F.when(F.col("told"), (F.col("above") + elsewhere) / 2).otherwise(elsewhere)
    return (F.col("b") + s * prior) / (F.col("b") + F.col("g") + s)


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, tree: Tree = Tree()) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages`` (``page_id``, ``url``).

    Args:
        labels: ``page_id, label`` (1 to reject, 0 to accept); rows that a rule decides are labelled by it as well, and a label given here comes first.

    The verdict is the rule's, else ``block`` where the template's purity reaches the threshold, else ``allow``; a template with few
    labels or none stands between its ancestors on the host and the same template on other hosts, at one half where none of them has a label.
    A null url, or one without ``://``, has an empty host and path; null or repeated ids are judged row by row; contradicting labels of an id count
    as a rejection; an empty table gives an empty result; other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = d.withColumns({"rule": name, "said": verdict, "t0": lexical(F.col("path"))})
    label = F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0)
    if labels is not None:
        known = labels.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("label").alias("given"))
        counted = d.join(known, "page_id", "left").withColumn("label", F.coalesce("given", label))
    else:
        counted = d.withColumn("label", label)
    found = templates(counted.select("host", "t0", "label"), tree)
    out = d.join(found, ["host", "t0"], "left")
    decided = F.coalesce("said", F.when(F.col("purity") >= tree.threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", decided.alias("verdict"), "template", "purity")
