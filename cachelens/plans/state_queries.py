"""Queries on op logs, keys, store state, expiration, metrics and histograms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.functions import keys
from cachelens.operators import batching, cost, feed, histogram, metrics, state, ttl
from cachelens.operators.running import last_before, running_max, running_sum
from cachelens.sources.oplog import from_documents, from_events, from_lineitem, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


#: The op log of ``events`` in SQL, with generations, start and end.
LOG = """
WITH raw AS (
  SELECT 'c' || (user_id % 4) AS cache_id, event_id AS seq, epoch_us(ts) AS ts_us, user_id % 8 AS client_id,
    CASE WHEN event_id % 997 = 996 THEN 'clear' WHEN event_type IN ('view', 'click') THEN 'get'
         WHEN event_type IN ('purchase', 'signup') THEN 'insert' WHEN event_type = 'error' THEN 'remove' END AS op,
    CASE WHEN event_id % 997 <> 996 THEN user_id END AS key_index,
    props AS value, CAST(ceil(value) AS BIGINT) AS cost,
    CASE WHEN event_type = 'signup' THEN 86400000000 ELSE 0 END AS ttl_us
  FROM events),
log AS (
  SELECT *, CAST(sum(CASE WHEN op = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY cache_id ORDER BY seq) AS BIGINT) AS generation,
    min(ts_us) OVER (PARTITION BY cache_id) AS start_us, max(ts_us) OVER (PARTITION BY cache_id) AS end_us
  FROM raw),
prev AS (
  SELECT *, last_value(CASE WHEN op IN ('insert', 'remove') THEN {'op': op, 'seq': seq, 'ts_us': ts_us, 'value': value, 'cost': cost, 'ttl_us': ttl_us} END IGNORE NULLS)
      OVER (PARTITION BY cache_id, generation, key_index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM log),
look AS (
  SELECT *, coalesce(p.op = 'insert', false) AS row_exists,
    coalesce(p.op = 'insert' AND (p.ttl_us = 0 OR ts_us - p.ts_us < p.ttl_us), false) AS live,
    coalesce(p.op = 'insert', false) AND coalesce(CASE WHEN p.ttl_us > 0 THEN
      start_us + CAST(ceil((((p.ts_us + p.ttl_us) // 1000000 + 1) * 1000000 - start_us) / 2000000.0) AS BIGINT) * 2000000 END > ts_us, true) AS present
  FROM prev)
"""
SWEPT = """
, seg AS (
  SELECT *, first_value(CASE WHEN op IN ('insert', 'remove') THEN ts_us END IGNORE NULLS)
      OVER (PARTITION BY cache_id, generation, key_index ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_us,
    CASE WHEN ttl_us > 0 THEN start_us + CAST(ceil((((ts_us + ttl_us) // 1000000 + 1) * 1000000 - start_us) / 2000000.0) AS BIGINT) * 2000000 END AS swept_us
  FROM log),
clears AS (SELECT cache_id, generation - 1 AS generation, ts_us AS clear_us FROM log WHERE op = 'clear'),
swept AS (
  SELECT seg.*, clear_us, ts_us + ttl_us AS exp_us FROM seg LEFT JOIN clears USING (cache_id, generation)
  WHERE op = 'insert' AND ttl_us > 0 AND coalesce(next_us >= swept_us, true) AND coalesce(clear_us >= swept_us, true) AND swept_us <= end_us)
"""


@query(LOG + "SELECT cache_id, seq, ts_us, client_id, op, key_index, value, cost, ttl_us FROM raw")
def op_log(spark, sf_dir):
    """The op log of the events table."""
    return events(spark, sf_dir).select("cache_id", "seq", "ts_us", "client_id", "op", "key_index", "value", "cost", "ttl_us")


@query("""
SELECT 'docs' AS cache_id, doc_id * 2 + k AS seq, CASE WHEN k = 0 THEN 'get' ELSE 'insert' END AS op,
  ('0x' || substr(md5(text), 1, 15))::BIGINT AS key_index, ('0x' || substr(md5(text), 16, 15))::BIGINT AS key_conflict, n_chars AS cost
FROM documents, (SELECT unnest([0, 1]) AS k)""")
def op_log_documents(spark, sf_dir):
    """Get-or-insert trace on content hashes."""
    return from_documents(table(spark, sf_dir, "documents")).select("cache_id", "seq", "op", "key_index", "key_conflict", "cost")


@query("""
SELECT l_orderkey * 1024 + l_linenumber * 64 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq,
  l_partkey AS key_index, l_suppkey % 16 AS client_id, 'get' AS op FROM lineitem""")
def op_log_lineitem(spark, sf_dir):
    """Read trace by part key."""
    return from_lineitem(table(spark, sf_dir, "lineitem")).select("seq", "key_index", "client_id", "op")


@query(LOG + """SELECT cache_id, count(*) FILTER (WHERE live) AS hit, count(*) FILTER (WHERE NOT live) AS miss,
  count(*) AS gets_total, count(*) FILTER (WHERE live) / CAST(count(*) AS DOUBLE) AS hit_ratio FROM look WHERE op = 'get' GROUP BY cache_id""")
def hit_ratio_ttl(spark, sf_dir):
    """ST1, P1, P2, M1, M3: hits of reads under time to live."""
    d = state.hits(events(spark, sf_dir)).groupBy("cache_id").agg(F.count_if("hit").alias("hit"), F.count_if(~F.col("hit")).alias("miss"))
    return metrics.with_ratio(d)


COUNTERS = LOG + SWEPT + """
, r AS (SELECT cache_id, count(*) FILTER (WHERE live) AS hit, count(*) FILTER (WHERE NOT live) AS miss FROM look WHERE op = 'get' GROUP BY cache_id),
w AS (SELECT cache_id, count(*) FILTER (WHERE op = 'insert' AND NOT present) AS keys_added, count(*) FILTER (WHERE op = 'insert' AND present) AS keys_updated,
    count(*) FILTER (WHERE op = 'remove' AND present) AS removed,
    CAST(sum(CASE WHEN op = 'insert' AND present THEN greatest(0, cost - p.cost) WHEN op = 'insert' THEN cost ELSE 0 END) AS BIGINT) AS cost_added,
    CAST(sum(CASE WHEN op = 'remove' AND present THEN p.cost WHEN op = 'insert' AND present THEN greatest(0, p.cost - cost) ELSE 0 END) AS BIGINT) AS removed_cost
  FROM look WHERE op IN ('insert', 'remove') GROUP BY cache_id),
s AS (SELECT cache_id, count(*) AS swept_n, CAST(sum(cost) AS BIGINT) AS swept_cost FROM swept GROUP BY cache_id),
k AS (SELECT cache_id, CAST(sum(n // 64 * 64) AS BIGINT) AS gets_kept FROM (SELECT cache_id, client_id & 63 AS stripe, count(*) AS n FROM log WHERE op = 'get' GROUP BY ALL) GROUP BY cache_id),
m AS (SELECT cache_id, coalesce(hit, 0) AS hit, coalesce(miss, 0) AS miss, coalesce(keys_added, 0) AS keys_added, coalesce(keys_updated, 0) AS keys_updated,
    coalesce(removed, 0) + coalesce(swept_n, 0) AS keys_evicted, coalesce(cost_added, 0) AS cost_added, coalesce(removed_cost, 0) + coalesce(swept_cost, 0) AS cost_evicted,
    CAST(0 AS BIGINT) AS sets_dropped, CAST(0 AS BIGINT) AS sets_rejected, CAST(0 AS BIGINT) AS gets_dropped, coalesce(gets_kept, 0) AS gets_kept
  FROM (SELECT DISTINCT cache_id FROM log) LEFT JOIN r USING (cache_id) LEFT JOIN w USING (cache_id) LEFT JOIN s USING (cache_id) LEFT JOIN k USING (cache_id)),
t AS (SELECT *, hit + miss AS gets_total, CASE WHEN hit + miss = 0 THEN 0.0 ELSE hit / CAST(hit + miss AS DOUBLE) END AS hit_ratio FROM m)
"""


@query(COUNTERS + "SELECT * FROM t")
def metrics_counters(spark, sf_dir):
    """M1, M3, M4, M7: the eleven counters, total and ratio."""
    return metrics.with_ratio(metrics.counters(events(spark, sf_dir)))


@query(COUNTERS + """SELECT cache_id, '{"hit":' || hit || ',"miss":' || miss || ',"keys-added":' || keys_added || ',"keys-updated":' || keys_updated || ',"keys-evicted":' || keys_evicted
  || ',"cost-added":' || cost_added || ',"cost-evicted":' || cost_evicted || ',"sets-dropped":' || sets_dropped || ',"sets-rejected":' || sets_rejected || ',"gets-dropped":' || gets_dropped
  || ',"gets-kept":' || gets_kept || ',"gets-total":' || gets_total || ',"hit-ratio":' || CAST(round(hit_ratio, 6) AS DECIMAL(10, 6)) || '}' AS json FROM t""")
def metrics_json(spark, sf_dir):
    """Counters as JSON."""
    return metrics.as_json(metrics.counters(events(spark, sf_dir)))


@query(COUNTERS + """SELECT cache_id, 'hit: ' || hit || chr(10) || 'miss: ' || miss || chr(10) || 'keys-added: ' || keys_added || chr(10) || 'keys-updated: ' || keys_updated || chr(10) || 'keys-evicted: ' || keys_evicted || chr(10)
  || 'cost-added: ' || cost_added || chr(10) || 'cost-evicted: ' || cost_evicted || chr(10) || 'sets-dropped: ' || sets_dropped || chr(10) || 'sets-rejected: ' || sets_rejected || chr(10) || 'gets-dropped: ' || gets_dropped || chr(10)
  || 'gets-kept: ' || gets_kept || chr(10) || 'gets-total: ' || gets_total || chr(10) || 'hit-ratio: ' || printf('%.2f', hit_ratio) AS report FROM t""")
def metrics_text(spark, sf_dir):
    """Counters as text."""
    return metrics.as_text(metrics.counters(events(spark, sf_dir)))


@query(LOG + """, last AS (SELECT cache_id, max(generation) AS generation FROM log GROUP BY cache_id)
SELECT cache_id, op, count(*) AS n, CAST(sum(cost) AS BIGINT) AS cost_sum FROM log JOIN last USING (cache_id, generation) WHERE op <> 'clear' GROUP BY cache_id, op""")
def metrics_since_clear(spark, sf_dir):
    """M6: operations that count after each cache's last clear."""
    return metrics.since_clear(events(spark, sf_dir)).groupBy("cache_id", "op").agg(F.count("*").alias("n"), F.sum("cost").alias("cost_sum"))


@query(LOG + "SELECT DISTINCT cache_id, CAST(NULL AS BIGINT) AS hit, CAST(NULL AS BIGINT) AS miss, CAST(NULL AS BIGINT) AS gets_total, CAST(NULL AS DOUBLE) AS hit_ratio FROM log")
def metrics_disabled(spark, sf_dir):
    """M5: a cache without metrics reports nulls."""
    return metrics.without_metrics(hit_ratio_ttl(spark, sf_dir))


@query("SELECT doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS key_index, ('0x' || substr(md5(text), 16, 15))::BIGINT AS key_conflict FROM documents")
def key_hash_md5(spark, sf_dir):
    """K2, K3, K4: hashed key pairs."""
    return keys.HASHED.build(table(spark, sf_dir, "documents"), "text").select("doc_id", "key_index", "key_conflict")


@query("SELECT event_id, user_id AS key_index, CAST(0 AS BIGINT) AS key_conflict FROM events")
def key_transparent(spark, sf_dir):
    """K5: integers as keys."""
    return keys.TRANSPARENT.build(table(spark, sf_dir, "events"), "user_id").select("event_id", "key_index", "key_conflict")


@query("SELECT l_partkey % 256 AS shard, count(*) AS n, count(DISTINCT l_partkey) AS keys FROM lineitem GROUP BY 1")
def shard_routing(spark, sf_dir):
    """K7: store shards."""
    return from_lineitem(table(spark, sf_dir, "lineitem")).groupBy(keys.shard(F.col("key_index")).alias("shard")).agg(F.count("*").alias("n"), F.count_distinct("key_index").alias("keys"))


@query(LOG + "SELECT cache_id, client_id & 63 AS stripe, count(*) AS n FROM log GROUP BY 1, 2")
def stripe_routing(spark, sf_dir):
    """K9: stripes by client."""
    return events(spark, sf_dir).groupBy("cache_id", keys.stripe(F.col("client_id")).alias("stripe")).agg(F.count("*").alias("n"))


@query(LOG + "SELECT cache_id, count(DISTINCT key_index % 256) AS shards, CAST(sum(cost) AS BIGINT) AS cost_sum, count(*) AS inserts FROM log WHERE op = 'insert' GROUP BY 1")
def metric_sharded_sum(spark, sf_dir):
    """K8, M2: partial sums by metric shard, then totals."""
    return metrics.sharded_sum(events(spark, sf_dir))


@query(LOG + "SELECT cache_id, seq, generation FROM log")
def generation_assign(spark, sf_dir):
    """ST8, P3, R5: generations by clears."""
    return state.with_generation(events(spark, sf_dir)).select("cache_id", "seq", "generation")


ENTRIES = LOG + """, last AS (SELECT cache_id, max(generation) AS generation FROM log GROUP BY cache_id),
e AS (SELECT cache_id, key_index, start_us, end_us, max_by({'op': op, 'seq': seq, 'ts_us': ts_us, 'value': value, 'cost': cost, 'ttl_us': ttl_us}, seq) AS r
  FROM log JOIN last USING (cache_id, generation) WHERE op IN ('insert', 'remove') GROUP BY ALL),
rows_ AS (SELECT cache_id, key_index, r.seq AS seq, r.value AS value, r.cost AS cost, r.ts_us AS created_us, r.ttl_us AS ttl_us,
    r.ttl_us > 0 AND end_us - r.ts_us >= r.ttl_us AS expired,
    coalesce(CASE WHEN r.ttl_us > 0 THEN start_us + CAST(ceil((((r.ts_us + r.ttl_us) // 1000000 + 1) * 1000000 - start_us) / 2000000.0) AS BIGINT) * 2000000 END <= end_us, false) AS swept
  FROM e WHERE r.op = 'insert')
"""


@query(ENTRIES + "SELECT cache_id, key_index, seq, value, cost, created_us, ttl_us FROM rows_ WHERE NOT expired")
def state_live(spark, sf_dir):
    """ST3, ST5, ST8: entries at the end of the log that a read would find."""
    return state.entries(events(spark, sf_dir)).where("NOT expired").select("cache_id", "key_index", "seq", "value", "cost", "created_us", "ttl_us")


@query(ENTRIES + "SELECT cache_id, key_index, seq, cost, expired FROM rows_ WHERE NOT swept")
def state_live_physical(spark, sf_dir):
    """ST9, P5: rows that still stand, expired or not."""
    return state.entries(events(spark, sf_dir)).where("NOT swept").select("cache_id", "key_index", "seq", "cost", "expired")


@query(ENTRIES + "SELECT cache_id, count(*) FILTER (WHERE NOT swept) AS len, count(*) FILTER (WHERE NOT expired) AS live, CAST(coalesce(sum(cost) FILTER (WHERE NOT swept), 0) AS BIGINT) AS used FROM rows_ GROUP BY cache_id")
def store_len(spark, sf_dir):
    """ST9: length with and without expired rows, and cost held."""
    return state.entries(events(spark, sf_dir)).groupBy("cache_id").agg(F.count_if(~F.col("swept")).alias("len"), F.count_if(~F.col("expired")).alias("live"), F.coalesce(F.sum(F.when(~F.col("swept"), F.col("cost"))), F.lit(0)).alias("used"))


@query(LOG + "SELECT cache_id, seq, key_index, row_number() OVER (PARTITION BY cache_id ORDER BY seq) AS version FROM log WHERE op = 'insert'")
def versions(spark, sf_dir):
    """ST11: version numbers of writes."""
    return state.versions(events(spark, sf_dir)).select("cache_id", "seq", "key_index", "version")


@query(LOG + """, v AS (SELECT *, row_number() OVER (PARTITION BY cache_id ORDER BY seq) AS version FROM log WHERE op = 'insert'),
last AS (SELECT cache_id, max(generation) AS generation FROM log GROUP BY cache_id)
SELECT cache_id, key_index, max(version) AS version, count(*) AS writes FROM v JOIN last USING (cache_id, generation) GROUP BY ALL""")
def version_match(spark, sf_dir):
    """The version that a compare-and-delete of each key must name."""
    v = state.with_generation(events(spark, sf_dir))
    last = v.groupBy("cache_id").agg(F.max("generation").alias("generation"))
    n = state.versions(events(spark, sf_dir)).select("cache_id", "seq", "version")
    return v.where("op = 'insert'").join(last, ["cache_id", "generation"]).join(n, ["cache_id", "seq"]).groupBy("cache_id", "key_index").agg(F.max("version").alias("version"), F.count("*").alias("writes"))


@query(LOG + "SELECT cache_id, seq, key_index, CASE WHEN op = 'insert' THEN CASE WHEN present THEN 'update' ELSE 'insert' END ELSE CASE WHEN present THEN 'remove' ELSE 'absent' END END AS outcome FROM look WHERE op IN ('insert', 'remove')")
def upsert_outcome(spark, sf_dir):
    """ST3, ST4, R1-R3 (outcomes): what each write does to the store."""
    return state.write_outcomes(events(spark, sf_dir)).select("cache_id", "seq", "key_index", "outcome")


@query(LOG + "SELECT cache_id, seq, key_index, p.value AS removed_value FROM look WHERE op = 'remove' AND present")
def remove_effective(spark, sf_dir):
    """ST5, ST6, R11: removes that found a row, and what they removed."""
    return state.write_outcomes(events(spark, sf_dir)).where("outcome = 'remove'").select("cache_id", "seq", "key_index", F.col("prev.value").alias("removed_value"))


@query("""
WITH l AS (SELECT event_id AS seq, user_id AS k, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'insert_if_present' WHEN 'error' THEN 'remove' END AS op FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
p AS (SELECT *, last_value(CASE WHEN op IN ('insert', 'remove') THEN op END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
SELECT seq, k AS key_index, coalesce(before = 'insert', false) AS updated FROM p WHERE op = 'insert_if_present'""")
def insert_if_present(spark, sf_dir):
    """Conditional inserts, which update a standing row and never make one."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "purchase", "insert_if_present").when(F.col("event_type") == "error", "remove")
    d = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key_index"), op.alias("op")).where("op IS NOT NULL")
    d = last_before(d, F.col("op").isin("insert", "remove"), F.struct("op"), ["key_index"], "seq", "prev")
    return d.where("op = 'insert_if_present'").select("seq", "key_index", F.coalesce(F.col("prev.op") == "insert", F.lit(False)).alias("updated"))


@query("""
WITH a AS (SELECT event_id AS seq, user_id AS key_index, epoch_us(ts) AS ts_us, min(epoch_us(ts)) OVER () AS start_us,
    CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'insert_if_present' WHEN 'error' THEN 'remove' END AS op FROM events),
p AS (SELECT *, last_value(CASE WHEN op IN ('insert', 'remove') THEN {'op': op, 'seq': seq, 'ts_us': ts_us} END IGNORE NULLS) OVER (PARTITION BY key_index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stood FROM a WHERE op IS NOT NULL),
f AS (SELECT *, first_value(ts_us) OVER (PARTITION BY key_index, stood.seq ORDER BY seq) AS first_us FROM p WHERE op = 'insert_if_present')
SELECT seq, key_index, coalesce(stood.op = 'insert' AND first_us < start_us + CAST(ceil((((stood.ts_us + 86400000000) // 1000000 + 1) * 1000000 - start_us) / 2000000.0) AS BIGINT) * 2000000, false) AS updated FROM f""")
def insert_if_present_ttl(spark, sf_dir):
    """Conditional inserts of rows with a day to live, by a clock that does not run back."""
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "purchase", "insert_if_present").when(F.col("event_type") == "error", "remove")
    d = events(spark, sf_dir).drop("op", "ttl_us", "key_index", "cache_id").join(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key_index"), op.alias("op")), "seq")
    d = d.withColumns({"cache_id": F.lit("all"), "ttl_us": F.when(F.col("op") == "insert", F.lit(86_400_000_000)).otherwise(F.lit(0)).cast("long")})
    return state.conditional_inserts(d).select("seq", "key_index", "updated")


@query("""
WITH l AS (SELECT event_id AS seq, user_id AS key_index, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'insert' WHEN 'view' THEN 'get' WHEN 'error' THEN 'remove' END AS op FROM events WHERE event_type <> 'click'),
p AS (SELECT *, max(CASE WHEN op = 'insert' THEN seq END) OVER w AS made, max(CASE WHEN op = 'get' THEN seq END) OVER w AS seen FROM l WINDOW w AS (PARTITION BY key_index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, min(CASE WHEN seen > made THEN seq END) OVER (PARTITION BY key_index, made) AS winner FROM p WHERE op = 'remove')
SELECT seq, key_index, coalesce(seq = winner, false) AS removed FROM r""")
def remove_if_version(spark, sf_dir):
    """Removals that ask for the version which the key's last read saw; the first to match takes the row."""
    op = F.when(F.col("event_type").isin("signup", "purchase"), "insert").when(F.col("event_type") == "view", "get").when(F.col("event_type") == "error", "remove")
    d = table(spark, sf_dir, "events").where("event_type <> 'click'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key_index"), op.alias("op"))
    return state.versioned_removals(d, ["key_index"]).select("seq", "key_index", "removed")


@query("""
WITH l AS (SELECT event_id AS seq, user_id >> 1 AS key_index, (user_id & 1) + 2 AS conflict, CASE WHEN event_type IN ('view', 'click') THEN 'get' ELSE 'insert' END AS op FROM events WHERE event_type <> 'error'),
o AS (SELECT key_index, min_by(conflict, seq) AS owner, min(seq) AS since FROM l WHERE op = 'insert' GROUP BY 1)
SELECT op, count(*) AS n, count(*) FILTER (WHERE since < seq AND (conflict = owner)) AS matched, count(*) FILTER (WHERE since < seq AND conflict <> owner) AS refused
FROM l LEFT JOIN o USING (key_index) GROUP BY op""")
def conflict_lookup(spark, sf_dir):
    """Two keys on one index; the first to insert owns it, reads and writes of the other are refused."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    d = e.select(F.col("event_id").alias("seq"), F.shiftright("user_id", 1).alias("key_index"), (F.col("user_id").bitwiseAND(F.lit(1)) + 2).alias("conflict"), F.when(F.col("event_type").isin("view", "click"), "get").otherwise("insert").alias("op"))
    owner = d.where("op = 'insert'").groupBy("key_index").agg(F.min_by("conflict", "seq").alias("owner"), F.min("seq").alias("since"))
    match = state.conflict_matches(F.col("conflict"), F.col("owner"))
    return d.join(owner, "key_index", "left").groupBy("op").agg(F.count("*").alias("n"), F.count_if((F.col("since") < F.col("seq")) & match).alias("matched"), F.count_if((F.col("since") < F.col("seq")) & ~match).alias("refused"))


@query("""
WITH l AS (SELECT event_id AS seq, user_id >> 1 AS key_index, (user_id & 1) + 2 AS conflict, CAST(floor(value) AS BIGINT) AS cost, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'insert' END AS op FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
g AS (SELECT *, count(*) FILTER (WHERE op = 'remove') OVER (PARTITION BY key_index ORDER BY seq) AS life FROM l),
o AS (SELECT key_index, life, min_by(conflict, seq) AS owner, min(seq) AS since FROM g WHERE op = 'insert' GROUP BY ALL),
j AS (SELECT g.*, owner, since FROM g JOIN o USING (key_index, life) WHERE op = 'insert'),
r AS (SELECT *, max(CASE WHEN conflict = owner THEN cost END) OVER (PARTITION BY key_index, life ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS standing FROM j)
SELECT seq, key_index, CASE WHEN seq = since THEN 'NotExist' WHEN conflict <> owner THEN 'Conflict' WHEN cost <= standing THEN 'Reject' ELSE 'Update' END AS outcome, CASE WHEN seq > since THEN standing END AS standing FROM r""")
def update_validator(spark, sf_dir):
    """P6, U4, ST4: what each write finds if an update must cost more than the value that stands.

    A refused update leaves the standing value, so that value's cost is the greatest of its owner's since the row was made; the first writer owns a
    row until a removal.
    """
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase", "error"))
    op = F.when(F.col("event_type") == "error", "remove").otherwise("insert")
    d = e.select(F.col("event_id").alias("seq"), F.shiftright("user_id", 1).alias("key_index"), (F.col("user_id").bitwiseAND(F.lit(1)) + 2).alias("conflict"), F.floor("value").cast("long").alias("cost"), op.alias("op"))
    d = running_sum(d, F.when(F.col("op") == "remove", 1).otherwise(0), ["key_index"], "seq", "life").where("op = 'insert'")
    owner = d.groupBy("key_index", "life").agg(F.min_by("conflict", "seq").alias("owner"), F.min("seq").alias("since"))
    d = running_max(d.join(owner, ["key_index", "life"]), F.when(F.col("conflict") == F.col("owner"), F.col("cost")), ["key_index", "life"], "seq", "standing")
    outcome = F.when(F.col("seq") == F.col("since"), "NotExist").when(F.col("conflict") != F.col("owner"), "Conflict").when(F.col("cost") <= F.col("standing"), "Reject").otherwise("Update")
    return d.select("seq", "key_index", outcome.alias("outcome"), "standing")


@query("""
WITH l AS (SELECT event_id AS seq, user_id AS key_index, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'get_mut' WHEN 'view' THEN 'get' WHEN 'error' THEN 'remove' END AS op FROM events WHERE event_type <> 'click'),
p AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('insert', 'remove') THEN op END IGNORE NULLS) OVER (PARTITION BY key_index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'insert', false) AS present FROM l),
v AS (SELECT *, last_value(CASE WHEN op = 'insert' OR op = 'get_mut' AND present THEN seq END IGNORE NULLS) OVER (PARTITION BY key_index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS written FROM p)
SELECT seq, key_index, present AS hit, CASE WHEN present THEN 'v' || written END AS value FROM v WHERE op = 'get'""")
def get_mut_values(spark, sf_dir):
    """ST2, L6, L7: values that reads see where mutable reads write in place; a write to no row is lost."""
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "purchase", "get_mut").when(F.col("event_type") == "view", "get").otherwise("remove")
    d = table(spark, sf_dir, "events").where("event_type <> 'click'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key_index"), op.alias("op"))
    d = last_before(d, F.col("op").isin("insert", "remove"), F.struct("op"), ["key_index"], "seq", "prev").withColumn("present", F.coalesce(F.col("prev.op") == "insert", F.lit(False)))
    d = last_before(d, (F.col("op") == "insert") | ((F.col("op") == "get_mut") & F.col("present")), F.struct("seq"), ["key_index"], "seq", "written").where("op = 'get'")
    return d.select("seq", "key_index", F.col("present").alias("hit"), F.when(F.col("present"), F.concat(F.lit("v"), F.col("written.seq"))).alias("value"))


@query(LOG + "SELECT cache_id, seq, live AS present, CASE WHEN live AND p.ttl_us > 0 THEN greatest(0, p.ttl_us - (ts_us - p.ts_us)) END AS remaining_us FROM look WHERE op = 'get'")
def ttl_remaining(spark, sf_dir):
    """ST10, W10: remaining time to live of reads."""
    return ttl.remaining(events(spark, sf_dir)).select("cache_id", "seq", "present", "remaining_us")


@query(LOG + "SELECT cache_id, seq, key_index, CASE WHEN live THEN p.value END AS value, CASE WHEN live AND p.ttl_us > 0 THEN greatest(0, p.ttl_us - (ts_us - p.ts_us)) END AS remaining_us FROM look WHERE op = 'get'")
def read_results(spark, sf_dir):
    """What a read returns: the value and its remaining time to live, nulls for a miss."""
    return ttl.remaining(events(spark, sf_dir)).select("cache_id", "seq", "key_index", F.col("found").alias("value"), "remaining_us")


@query(LOG + "SELECT cache_id, (ts_us + ttl_us) // 1000000 + 1 AS bucket, count(*) AS n, min(key_index) AS least_key FROM log WHERE op = 'insert' AND ttl_us > 0 GROUP BY 1, 2")
def ttl_buckets(spark, sf_dir):
    """Expiration buckets."""
    return ttl.buckets(events(spark, sf_dir))


@query(LOG + SWEPT + "SELECT cache_id, seq, key_index, exp_us, swept_us, cost FROM swept")
def ttl_sweep(spark, sf_dir):
    """Rows removed by cleanup ticks, and when."""
    return ttl.sweeps(events(spark, sf_dir)).select("cache_id", "seq", "key_index", "exp_us", "swept_us", "cost")


@query(LOG + "SELECT cache_id, seq, key_index FROM look WHERE op = 'get' AND present AND NOT live")
def ttl_expired_unswept(spark, sf_dir):
    """P2 against W8: reads that miss although their row still stands."""
    d = state.with_previous(state.with_generation(state.with_start(events(spark, sf_dir)))).where("op = 'get'")
    swept = state.swept_at(F.col("prev.ts_us"), F.col("prev.ttl_us"), F.col("start_us"))
    return d.where(state.row_exists() & ~state.unexpired() & (swept > F.col("ts_us"))).select("cache_id", "seq", "key_index")


@query(LOG + """SELECT cache_id, seq, key_index, p.ttl_us AS old_ttl_us, ttl_us AS new_ttl_us, CASE WHEN p.ttl_us > 0 THEN (p.ts_us + p.ttl_us) // 1000000 + 1 END AS old_bucket,
  CASE WHEN ttl_us > 0 THEN (ts_us + ttl_us) // 1000000 + 1 END AS new_bucket FROM look WHERE op = 'insert' AND present AND (p.ttl_us > 0 OR ttl_us > 0)""")
def ttl_overwrite(spark, sf_dir):
    """Overwrites that move, add or end an expiration."""
    d = state.write_outcomes(events(spark, sf_dir)).where("outcome = 'update' AND (prev.ttl_us > 0 OR ttl_us > 0)")
    old = F.when(F.col("prev.ttl_us") > 0, state.expiry_bucket(F.col("prev.ts_us"), F.col("prev.ttl_us")))
    new = F.when(F.col("ttl_us") > 0, state.expiry_bucket(F.col("ts_us"), F.col("ttl_us")))
    return d.select("cache_id", "seq", "key_index", F.col("prev.ttl_us").alias("old_ttl_us"), F.col("ttl_us").alias("new_ttl_us"), old.alias("old_bucket"), new.alias("new_bucket"))


@query(LOG + SWEPT + """SELECT cache_id, seq, 'exit' AS kind, key_index, p.value AS value, p.cost AS cost FROM look WHERE op IN ('insert', 'remove') AND present
UNION ALL SELECT cache_id, seq, 'evict', key_index, value, cost FROM swept""")
def change_feed_exit(spark, sf_dir):
    """Values that leave by update, removal or sweep."""
    return feed.exits(events(spark, sf_dir))


LIVES = LOG + SWEPT + """
, born AS (SELECT cache_id, seq, last_value(CASE WHEN op = 'insert' AND NOT present THEN ts_us END IGNORE NULLS)
    OVER (PARTITION BY cache_id, generation, key_index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS born_us FROM look),
lives AS (SELECT s.cache_id, s.seq, (s.swept_us - b.born_us) // 1000000 AS life_s FROM swept s JOIN born b ON s.cache_id = b.cache_id AND s.seq = b.seq)
"""


@query(LIVES + "SELECT cache_id, seq, life_s FROM lives")
def lifetimes(spark, sf_dir):
    """Seconds that swept rows lived."""
    return ttl.lifetimes(events(spark, sf_dir)).select("cache_id", "seq", "life_s")


def _bucketed(source: str, value: str) -> str:
    ladder = " ".join(f"WHEN {value} < {b} THEN {i}" for i, b in enumerate(histogram.LIFE_BOUNDS))
    return f"""b AS (SELECT CAST(CASE {ladder} ELSE {len(histogram.LIFE_BOUNDS)} END AS INTEGER) AS bucket, count(*) AS n FROM {source} GROUP BY 1),
h AS (SELECT bucket, CAST(CASE WHEN bucket = 0 THEN 0 ELSE 2 ** bucket END AS BIGINT) AS lo, CASE WHEN bucket < 16 THEN CAST(2 ** (bucket + 1) AS BIGINT) END AS hi, n,
  CAST(n AS DOUBLE) * 100.0 / CAST(sum(n) OVER () AS DOUBLE) AS pct, CAST(sum(n) OVER (ORDER BY bucket) AS DOUBLE) * 100.0 / CAST(sum(n) OVER () AS DOUBLE) AS cum_pct FROM b)"""


@query(LIVES + ", " + _bucketed("lives", "life_s") + " SELECT bucket, lo, hi, n FROM h")
def lifetimes_histogram(spark, sf_dir):
    """Lifetimes by powers of two."""
    return histogram.buckets(ttl.lifetimes(events(spark, sf_dir)), "life_s").select("bucket", "lo", "hi", "n")


@query("WITH " + _bucketed("documents", "n_chars") + " SELECT bucket, lo, hi, n, pct, cum_pct FROM h")
def histogram_buckets(spark, sf_dir):
    """H1: document lengths by powers of two."""
    return histogram.buckets(table(spark, sf_dir, "documents"), "n_chars")


@query("WITH " + _bucketed("documents", "n_chars") + """, g AS (SELECT g.i AS bucket, coalesce(b.n, 0) AS n FROM (SELECT unnest(range(17)) AS i) g LEFT JOIN b ON b.bucket = g.i),
c AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS cum, sum(n) OVER () AS total FROM g), p AS (SELECT unnest([0.0, 0.5, 0.75, 0.9, 0.99, 1.0])::DOUBLE AS p)
SELECT p, CAST(2 ** least(min(bucket) + 1, 16) AS BIGINT) AS bound FROM c, p WHERE cum >= floor(total * p) GROUP BY p""")
def histogram_percentiles(spark, sf_dir):
    """H3: percentiles by upper bounds."""
    return histogram.percentiles(table(spark, sf_dir, "documents"), "n_chars", (0.0, 0.5, 0.75, 0.9, 0.99, 1.0))


@query("SELECT count(n_chars) AS count, CAST(sum(n_chars) AS BIGINT) AS sum, min(n_chars) AS min, greatest(0, max(n_chars)) AS max, CAST(sum(n_chars) AS DOUBLE) / CAST(count(n_chars) AS DOUBLE) AS mean FROM documents")
def histogram_summary(spark, sf_dir):
    """H2, H5: count, sum, least, greatest and mean."""
    return histogram.summary(table(spark, sf_dir, "documents"), "n_chars")


@query("WITH " + _bucketed("documents", "n_chars") + """, g AS (SELECT g.i AS bucket, coalesce(b.n, 0) AS n FROM (SELECT unnest(range(17)) AS i) g LEFT JOIN b ON b.bucket = g.i),
c AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS cum, sum(n) OVER () AS total FROM g),
q AS (SELECT p.k, CAST(2 ** least(min(bucket) + 1, 16) AS BIGINT) AS bound FROM c, (VALUES (50, 0.5), (75, 0.75), (90, 0.9)) p(k, p) WHERE cum >= floor(total * p.p) GROUP BY p.k)
SELECT 0 AS line_no, 'min: ' || min(n_chars) AS line FROM documents UNION ALL SELECT 1, 'max: ' || max(n_chars) FROM documents UNION ALL SELECT 2, 'count: ' || count(*) FROM documents
UNION ALL SELECT CASE k WHEN 50 THEN 3 WHEN 75 THEN 4 ELSE 5 END, 'p' || k || ': ' || bound FROM q
UNION ALL SELECT bucket + 6, '[' || lo || ', ' || coalesce(CAST(hi AS VARCHAR), 'infinity') || ') ' || n || printf(' %.2f%% %.2f%%', pct, cum_pct) FROM h""")
def histogram_report(spark, sf_dir):
    """The histogram as text."""
    return histogram.report(table(spark, sf_dir, "documents"), "n_chars")


@query(LOG + """, b AS (SELECT cache_id, client_id & 63 AS stripe, seq, (row_number() OVER (PARTITION BY cache_id, client_id & 63 ORDER BY seq) - 1) // 64 AS batch,
  count(*) OVER (PARTITION BY cache_id, client_id & 63) AS n FROM log WHERE op = 'get') SELECT cache_id, stripe, seq, batch, (batch + 1) * 64 <= n AS kept FROM b""")
def get_batches(spark, sf_dir):
    """Q1, A10: reads in batches of 64 per stripe; only full ones are consumed."""
    return batching.get_batches(events(spark, sf_dir)).select("cache_id", "stripe", "seq", "batch", "kept")


@query(LOG + "SELECT cache_id, CAST(sum(n // 64 * 64) AS BIGINT) AS gets_kept, CAST(sum(n % 64) AS BIGINT) AS pending FROM (SELECT cache_id, client_id & 63 AS s, count(*) AS n FROM log WHERE op = 'get' GROUP BY ALL) GROUP BY 1")
def gets_kept(spark, sf_dir):
    """A10, Q8: reads that reach the policy, and those left in buffers."""
    return batching.get_batches(events(spark, sf_dir)).groupBy("cache_id").agg(F.count_if("kept").alias("gets_kept"), F.count_if(~F.col("kept")).alias("pending"))


@query(LOG + """, b AS (SELECT cache_id, client_id & 63 AS stripe, seq, (row_number() OVER (PARTITION BY cache_id, client_id & 63 ORDER BY seq) - 1) // 16 AS batch FROM log WHERE op = 'insert')
SELECT cache_id, stripe, batch, count(*) AS n, max(seq) AS flush_seq FROM b GROUP BY ALL""")
def insert_batches(spark, sf_dir):
    """Q2: insert batches by size alone."""
    d = batching.insert_batches(events(spark, sf_dir), 16, 2**62, barriers=False)
    return batching.shipped(d).select("cache_id", "stripe", "batch", "n", "flush_seq")


@query(LOG + """, b AS (SELECT cache_id, client_id & 63 AS stripe, (ts_us - start_us) // 3600000000 AS tick, seq,
  (row_number() OVER (PARTITION BY cache_id, client_id & 63, (ts_us - start_us) // 3600000000 ORDER BY seq) - 1) // 2 AS batch FROM log WHERE op = 'insert')
SELECT cache_id, stripe, tick, batch, count(*) AS n, max(seq) AS flush_seq FROM b GROUP BY ALL""")
def drain_ticks(spark, sf_dir):
    """Batches that a drain tick closes (hourly here, two inserts at most)."""
    d = batching.insert_batches(events(spark, sf_dir), 2, 3_600_000_000, barriers=False)
    return batching.shipped(d).select("cache_id", "stripe", "tick", "batch", "n", "flush_seq")


@query(LOG + """, b AS (SELECT cache_id, client_id & 63 AS stripe, generation AS barrier, seq,
  (row_number() OVER (PARTITION BY cache_id, client_id & 63, generation ORDER BY seq) - 1) // 16 AS batch FROM log WHERE op = 'insert')
SELECT cache_id, stripe, barrier, batch, count(*) AS n, max(seq) AS flush_seq FROM b GROUP BY ALL""")
def barrier_flush(spark, sf_dir):
    """Barriers close every open batch."""
    d = batching.insert_batches(events(spark, sf_dir), 16, 2**62)
    return batching.shipped(d).select("cache_id", "stripe", "barrier", "batch", "n", "flush_seq")


@query(LOG + "SELECT cache_id, seq, CASE WHEN c = 0 THEN length(value) ELSE c END AS external_cost, CASE WHEN c = 0 THEN length(value) ELSE c END AS total_cost FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN 0 ELSE cost END AS c FROM log WHERE op = 'insert')")
def cost_effective(spark, sf_dir):
    """The coster answers where no cost is given."""
    log = events(spark, sf_dir).withColumn("cost", F.when(F.col("seq") % 3 == 0, F.lit(0)).otherwise(F.col("cost")).cast("long"))
    return cost.effective(log, F.length("value").cast("long")).select("cache_id", "seq", "external_cost", "total_cost")


@query(LOG + "SELECT cache_id, CAST(sum(cost + 56) AS BIGINT) AS total_cost, CAST(sum(cost) AS BIGINT) AS external_cost FROM log WHERE op = 'insert' GROUP BY 1")
def cost_internal(spark, sf_dir):
    """A13, ST12: rows cost their bookkeeping too."""
    return cost.effective(events(spark, sf_dir), F.lit(0).cast("long"), 56).groupBy("cache_id").agg(F.sum("total_cost").alias("total_cost"), F.sum("external_cost").alias("external_cost"))


@query(LOG + "SELECT cache_id, seq, cost FROM log WHERE op = 'insert' AND cost >= 0 AND cost <= 50")
def cost_precheck(spark, sf_dir):
    """Writes within the budget's bounds."""
    return cost.prechecked(events(spark, sf_dir).where("op = 'insert'"), 50).select("cache_id", "seq", "cost")


@query(LOG + """, u AS (SELECT cache_id, seq, op, CASE WHEN seq % 500 = 499 THEN 1000 + seq END AS n FROM log)
SELECT cache_id, seq, coalesce(last_value(n IGNORE NULLS) OVER (PARTITION BY cache_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1000) AS max_cost FROM u""")
def max_cost_asof(spark, sf_dir):
    """ST13: the budget as of every operation."""
    change = F.col("seq") % 500 == 499
    log = events(spark, sf_dir).withColumns({"op": F.when(change, "update_max_cost").otherwise(F.col("op")), "new_max_cost": F.when(change, F.col("seq") + 1000)})
    return cost.budget_as_of(log, 1000).select("cache_id", "seq", "max_cost")


@query(LOG + """, d AS (SELECT cache_id, generation, seq, CASE WHEN op = 'insert' THEN cost - CASE WHEN row_exists THEN p.cost ELSE 0 END WHEN row_exists THEN -p.cost ELSE 0 END AS delta FROM look WHERE op IN ('insert', 'remove'))
SELECT cache_id, seq, CAST(sum(delta) OVER (PARTITION BY cache_id, generation ORDER BY seq) AS BIGINT) AS used FROM d""")
def used_no_evict(spark, sf_dir):
    """The cost held after each write when nothing is evicted."""
    return cost.used_without_eviction(events(spark, sf_dir)).select("cache_id", "seq", "used")


@query("SELECT source, count(*) AS gets, count(*) FILTER (WHERE n > 1) AS hits FROM (SELECT source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) GROUP BY source")
def content_hits(spark, sf_dir):
    """A11 on documents: an infinite cache hits exactly on repeated texts (by source)."""
    log = from_documents(table(spark, sf_dir, "documents"))
    first = log.where("op = 'insert'").groupBy("key_index", "key_conflict").agg(F.min("seq").alias("since"))
    d = log.where("op = 'get'").join(first, ["key_index", "key_conflict"]).select((F.col("seq") / 2).cast("long").alias("doc_id"), (F.col("since") < F.col("seq")).alias("hit"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(d, "doc_id").groupBy("source").agg(F.count("*").alias("gets"), F.count_if("hit").alias("hits"))


@query("SELECT i % 8 AS client, count(*) AS n, min(i) AS lo, max(i) AS hi FROM (SELECT unnest(range(8000)) AS i) GROUP BY 1")
def unique_inserts(spark, sf_dir):
    """S3: every key inserted once."""
    from cachelens.sources.synthetic import unique_inserts as source

    return source(spark, 8, 1000).groupBy((F.col("key") % 8).alias("client")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))


@query("""
WITH RECURSIVE m AS (SELECT 18446744073709551615::UHUGEINT AS ones),
x AS (SELECT c AS client_id, 0 AS i, ((c + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) & ones AS s FROM range(4) t(c), m
  UNION ALL SELECT client_id, i + 1, xor(z, (z << 17) & ones) FROM (SELECT client_id, i, ones, xor(y, y >> 7) AS z FROM (SELECT client_id, i, ones, xor(s, (s << 13) & ones) AS y FROM x, m WHERE i < 1000)))
SELECT client_id, count(*) AS n, count(DISTINCT s % 500) AS keys, CAST(max(s % 500) AS BIGINT) AS hi, CAST(sum(i * (s % 500)) AS BIGINT) AS mark FROM x WHERE i > 0 GROUP BY client_id""")
def xorshift_trace(spark, sf_dir):
    """Seeded xorshift keys per client."""
    from cachelens.sources.synthetic import xorshift_keys

    return xorshift_keys(spark, 4, 1000, 400).groupBy("client_id").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.max("key").alias("hi"), F.sum((F.col("n") + 1) * F.col("key")).alias("mark"))


@query("SELECT i // 1000 AS client_id, count(*) AS n, max(k) AS hi, CAST(sum(k * (i % 1000)) AS BIGINT) AS mark FROM (SELECT i, ('0x' || substr(md5('1:' || i), 1, 15))::BIGINT % 500 AS k FROM range(4000) t(i)) GROUP BY 1")
def uniform_reads(spark, sf_dir):
    """Uniform reads of preloaded keys."""
    from cachelens.sources.synthetic import uniform_reads as source

    return source(spark, 4, 1000, 500).groupBy("client_id").agg(F.count("*").alias("n"), F.max("key").alias("hi"), F.sum(F.col("key") * F.col("n")).alias("mark"))


@query(LOG + "SELECT cache_id, op, count(*) AS n FROM log GROUP BY ROLLUP (cache_id, op)")
def ops_rollup(spark, sf_dir):
    """Extension: operations by cache and kind with totals."""
    return events(spark, sf_dir).rollup("cache_id", "op").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS key_index, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, key_index LIMIT 20")
def hot_keys(spark, sf_dir):
    """Extension: the twenty keys read most."""
    return from_lineitem(table(spark, sf_dir, "lineitem")).groupBy("key_index").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key_index").limit(20)


@query("SELECT c_mktsegment AS segment, count(*) AS reads, count(*) FILTER (WHERE n > 1) AS hits FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def hits_by_segment(spark, sf_dir):
    """Extension: repeat reads of customers by market segment."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return first.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("n").alias("reads"), F.sum(F.col("n") - 1).alias("hits"))
