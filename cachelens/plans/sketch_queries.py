"""Queries on Bloom filters, count-min sketches and the aged frequency estimate, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cachelens.functions.keys import md5_index
from cachelens.functions.sizing import bloom_shape
from cachelens.operators import sketch
from cachelens.operators.state import with_generation
from cachelens.sources.oplog import table

QUERIES, ORACLE = {}, {}
CAPACITY, COUNTERS = 100, 1000
EXP, PROBES = bloom_shape(CAPACITY, 0.01)
E2, P2 = bloom_shape(COUNTERS, 0.01)


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


def hashed_users(spark, sf_dir, kinds):
    """Distinct users of some event types with a hashed key."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds))
    return e.select("user_id").distinct().withColumn("key", md5_index(F.col("user_id")))


def skewed_reads(spark, sf_dir):
    """Reads with skewed keys in two caches: cubes of a pseudo-random residue, in whole numbers."""
    exact = F.expr("(((event_id * 7919) % 10007) * ((event_id * 7919) % 10007) * ((event_id * 7919) % 10007) * 1000) div (10007L * 10007 * 10007)")
    return table(spark, sf_dir, "events").select((F.col("event_id") % 2).alias("cache_id"), F.col("event_id").alias("seq"), exact.alias("user"), F.conv(F.substring(F.md5(exact.cast("string").cast("binary")), 1, 15), 16, 10).cast("long").alias("key"))


HASH = "('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 15))::BIGINT"
BITS = """
WITH u AS (SELECT DISTINCT user_id, {hash} AS key, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id) AS bought, bool_or(event_type = 'view') OVER (PARTITION BY user_id) AS asked FROM events),
p AS (SELECT user_id, bought, asked, ((key >> {shift}) + i * (key & {mask})) & {mask} AS bit FROM u, (SELECT unnest(range({probes})) AS i)),
bits AS (SELECT DISTINCT bit FROM p WHERE bought)
""".format(hash=HASH.format("user_id"), shift=60 - EXP, mask=(1 << EXP) - 1, probes=PROBES)  # fmt: skip


@query(BITS + "SELECT bit FROM bits")
def bloom_bits(spark, sf_dir):
    """Bits set by the users who bought."""
    return sketch.bloom_bits(hashed_users(spark, sf_dir, ["purchase"]), "key", EXP, PROBES)


@query(BITS + "SELECT bit // 64 AS word, CAST(bit_or(CASE WHEN bit % 64 = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << CAST(bit % 64 AS INTEGER) END) AS BIGINT) AS bits FROM bits GROUP BY 1")
def bloom_words(spark, sf_dir):
    """The filter as 64-bit words."""
    return sketch.bloom_words(sketch.bloom_bits(hashed_users(spark, sf_dir, ["purchase"]), "key", EXP, PROBES))


CONTAINS = BITS + ", c AS (SELECT user_id, bought, bool_and(bit IN (SELECT bit FROM bits)) AS contained FROM p WHERE asked GROUP BY 1, 2) "


@query(CONTAINS + "SELECT user_id, contained FROM c")
def bloom_contains(spark, sf_dir):
    """Membership of the users who viewed."""
    bits = sketch.bloom_bits(hashed_users(spark, sf_dir, ["purchase"]), "key", EXP, PROBES)
    asked = hashed_users(spark, sf_dir, ["view"])
    return asked.join(sketch.bloom_contains(asked, "key", bits, EXP, PROBES), "key").select("user_id", "contained")


@query(CONTAINS + "SELECT count(*) AS asked, count(*) FILTER (WHERE contained) AS positive, count(*) FILTER (WHERE contained AND NOT bought) AS false_positive, count(*) FILTER (WHERE bought AND NOT contained) AS false_negative FROM c")
def bloom_false_positives(spark, sf_dir):
    """True and false positives; there are no false negatives."""
    c = bloom_contains(spark, sf_dir)
    bought = hashed_users(spark, sf_dir, ["purchase"]).select("user_id", F.lit(True).alias("bought"))
    d = c.join(bought, "user_id", "left").withColumn("bought", F.coalesce("bought", F.lit(False)))
    return d.agg(F.count("*").alias("asked"), F.count_if("contained").alias("positive"), F.count_if(F.col("contained") & ~F.col("bought")).alias("false_positive"), F.count_if(F.col("bought") & ~F.col("contained")).alias("false_negative"))


@query("SELECT l_partkey & 1023 AS cell, CAST(least(15, count(*)) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def cms_cells(spark, sf_dir):
    """Saturated cells of a sketch of 1000 counters."""
    return sketch.cells(table(spark, sf_dir, "lineitem"), "l_partkey", COUNTERS)


CMS = "WITH t AS (SELECT l_partkey, count(*) AS true_n FROM lineitem GROUP BY 1), c AS (SELECT l_partkey & 1023 AS cell, CAST(least(15, count(*)) AS BIGINT) AS n FROM lineitem GROUP BY 1), e AS (SELECT l_partkey, true_n, n AS estimate FROM t JOIN c ON l_partkey & 1023 = cell) "


@query(CMS + "SELECT l_partkey, estimate FROM e")
def cms_estimate(spark, sf_dir):
    """Estimates by part."""
    return sketch.estimates(table(spark, sf_dir, "lineitem"), "l_partkey", COUNTERS).select("l_partkey", "estimate")


@query(CMS + "SELECT estimate - least(15, true_n) AS error, count(*) AS keys FROM e GROUP BY 1")
def cms_error(spark, sf_dir):
    """How far estimates lie above saturated counts."""
    d = sketch.estimates(table(spark, sf_dir, "lineitem"), "l_partkey", COUNTERS)
    return d.groupBy((F.col("estimate") - F.least(F.lit(15), F.col("true_n"))).alias("error")).agg(F.count("*").alias("keys"))


AGED = """
WITH d AS (SELECT (l_partkey & 1023) AS cell, ((l_orderkey - 1) * 8 + l_linenumber) // 2000 AS epoch FROM lineitem),
n AS (SELECT cell, epoch, count(*) AS n FROM d GROUP BY 1, 2), e AS (SELECT max(epoch) AS now FROM d),
g AS (SELECT c.cell, x.epoch, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT cell FROM n) c CROSS JOIN (SELECT unnest(range((SELECT now FROM e))) AS epoch) x LEFT JOIN n ON n.cell = c.cell AND n.epoch = x.epoch),
f AS (SELECT cell, list_reduce(list(n ORDER BY epoch), lambda acc, x: least(15, acc + x) // 2, 0) AS carry FROM g GROUP BY 1)
SELECT cell, CAST(carry AS BIGINT) AS carry FROM f WHERE cell IN (SELECT cell FROM n, e WHERE epoch < now)
"""


@query(AGED)
def cms_aging(spark, sf_dir):
    """C4, T4: cells carried over epochs, halved after each."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").bitwiseAND(F.lit(1023)).alias("cell"), F.expr("((l_orderkey - 1) * 8 + l_linenumber) div 2000").alias("epoch"))
    n = d.groupBy("cell", "epoch").agg(F.count("*").alias("n"))
    return sketch.aged(n.join(d.agg(F.max("epoch").alias("now"))), ["cell"], F.col("epoch"), F.col("n"), F.col("now"))


TINY = """
WITH r AS (SELECT event_id % 2 AS cache_id, event_id AS seq, (((event_id * 7919) % 10007) * ((event_id * 7919) % 10007) * ((event_id * 7919) % 10007) * 1000) // (CAST(10007 AS BIGINT) * 10007 * 10007) AS user FROM events),
k AS (SELECT *, {hash} AS key, row_number() OVER (PARTITION BY cache_id ORDER BY seq) AS pos FROM r),
x AS (SELECT *, (pos - 1) // {n} AS epoch, key & {cmask} AS cell FROM k),
b AS (SELECT DISTINCT cache_id, epoch, pos, key, cell, ((key >> {shift}) + i * (key & {mask})) & {mask} AS bit FROM x, (SELECT unnest(range({probes})) AS i)),
f AS (SELECT cache_id, epoch, bit, min(pos) AS first_pos FROM b GROUP BY ALL),
h AS (SELECT b.cache_id, b.epoch, b.pos, b.key, b.cell, max(first_pos) < b.pos AS door_hit FROM b JOIN f ON b.cache_id = f.cache_id AND b.epoch = f.epoch AND b.bit = f.bit GROUP BY b.cache_id, b.epoch, b.pos, b.key, b.cell),
c AS (SELECT cache_id, epoch, cell, count(*) AS n FROM h WHERE door_hit GROUP BY ALL),
e AS (SELECT cache_id, max(pos) // {n} AS now FROM x GROUP BY 1),
g AS (SELECT d.cache_id, d.cell, t.epoch, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT cache_id, cell FROM c) d JOIN e ON d.cache_id = e.cache_id JOIN (SELECT unnest(range(100000)) AS epoch) t ON t.epoch < e.now
  LEFT JOIN c ON c.cache_id = d.cache_id AND c.cell = d.cell AND c.epoch = t.epoch),
y AS (SELECT cache_id, cell, list_reduce(list(n ORDER BY epoch), lambda acc, v: least(15, acc + v) // 2, 0) AS carry FROM g GROUP BY ALL),
z AS (SELECT q.cache_id, q.key, q.cell, CAST(least(15, coalesce(y.carry, 0) + coalesce(c.n, 0)) AS BIGINT) AS cms,
    (SELECT bool_and(EXISTS (SELECT 1 FROM f WHERE f.cache_id = q.cache_id AND f.epoch = e.now AND f.bit = ((q.key >> {shift}) + i * (q.key & {mask})) & {mask})) FROM (SELECT unnest(range({probes})) AS i)) AS door
  FROM (SELECT DISTINCT cache_id, key, cell FROM x) q JOIN e ON e.cache_id = q.cache_id LEFT JOIN y ON y.cache_id = q.cache_id AND y.cell = q.cell LEFT JOIN c ON c.cache_id = q.cache_id AND c.cell = q.cell AND c.epoch = e.now)
""".format(hash=HASH.format("r.user"), n=COUNTERS, cmask=1023, shift=60 - E2, mask=(1 << E2) - 1, probes=P2)  # fmt: skip


def tiny(spark, sf_dir) -> sketch.TinyLfu:
    return sketch.TinyLfu(skewed_reads(spark, sf_dir), "key", COUNTERS, ["cache_id"])


@query(TINY + "SELECT cache_id, epoch, count(*) AS reads, count(*) FILTER (WHERE door_hit) AS door_hits FROM h GROUP BY ALL")
def tinylfu_door_hits(spark, sf_dir):
    """Reads whose key the filter had seen before in the epoch."""
    return tiny(spark, sf_dir).epoch_hits()


@query(TINY + "SELECT cache_id, epoch, count(*) AS cells, CAST(sum(n) AS BIGINT) AS increments, max(n) AS most FROM c GROUP BY ALL")
def tinylfu_epochs(spark, sf_dir):
    """Increments of each epoch."""
    return tiny(spark, sf_dir).epoch_cells().groupBy("cache_id", "epoch").agg(F.count("*").alias("cells"), F.sum("n").alias("increments"), F.max("n").alias("most"))


@query(TINY + "SELECT cache_id, key, cell, cms, door, cms + CAST(door AS BIGINT) AS estimate FROM z")
def tinylfu_estimate(spark, sf_dir):
    """The estimate of every key at the end of the log."""
    return tiny(spark, sf_dir).estimates()


#: The same with clears, each of which begins a generation of its cache: caches and generations share one number.
CLEARED = TINY.replace("WITH r AS (SELECT event_id % 2 AS cache_id,", """WITH s AS (SELECT event_id, event_id % 7000 IN (300, 301) AS clears,
  CAST(sum(CASE WHEN event_id % 7000 IN (300, 301) THEN 1 ELSE 0 END) OVER (PARTITION BY event_id % 2 ORDER BY event_id) AS BIGINT) AS generation FROM events),
r AS (SELECT generation * 2 + event_id % 2 AS cache_id,""").replace("AS user FROM events)", "AS user FROM s WHERE NOT clears)")


@query(CLEARED + "SELECT cache_id % 2 AS cache_id, cache_id // 2 AS generation, key, cms, door, cms + CAST(door AS BIGINT) AS estimate FROM z")
def tinylfu_cleared(spark, sf_dir):
    """A clear empties sketch and filter, and positions start again: estimates at the end of every generation."""
    log = skewed_reads(spark, sf_dir).withColumn("op", F.when(F.expr("seq % 7000 IN (300, 301)"), "clear").otherwise("get"))
    reads = with_generation(log).where("op = 'get'")
    d = sketch.TinyLfu(reads, "key", COUNTERS, ["cache_id", "generation"]).estimates()
    return d.select("cache_id", "generation", "key", "cms", "door", "estimate")
