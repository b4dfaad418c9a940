"""Queries that replay the admission policy, in batch and as a stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from cachelens.config import CacheConfig
from cachelens.functions.keys import md5_index
from cachelens.functions.sizing import bloom_shape, sketch_mask
from cachelens.operators import metrics, policy
from cachelens.plans import state_queries
from cachelens.plans.state_queries import COUNTERS, events
from cachelens.sources.oplog import from_events, table
from cachelens.streaming import replay as streaming

QUERIES, ORACLE = {}, {}
CONFIG = CacheConfig(num_counters=1000, max_cost=400)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def without_clears(sql: str) -> str:
    return sql.replace("event_id % 997 = 996", "false").replace("event_id % 997 <> 996", "true")


SMALL = CacheConfig(num_counters=100, max_cost=300, ignore_internal_cost=True)
E1, P1 = bloom_shape(SMALL.num_counters, 0.01)

#: The policy as a recursion over the operations of each cache: residents (res), sketch cells, the filter's bits (door) and reads are carried along.
STEPS = """
WITH RECURSIVE log AS (SELECT cache_id, seq, op, k, cost AS c, list_transform(range({probes}), lambda i: ((k >> {shift}) + i * (k & {bits})) & {bits}) AS b, row_number() OVER (PARTITION BY cache_id ORDER BY seq) AS pos
  FROM (SELECT 'c' || (user_id % 4) AS cache_id, event_id AS seq, CAST(ceil(value) AS BIGINT) AS cost, ('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 15))::BIGINT AS k,
    CASE WHEN event_id % 997 = 996 THEN 'clear' WHEN event_type IN ('view', 'click') THEN 'get' WHEN event_type IN ('purchase', 'signup') THEN 'insert' ELSE 'remove' END AS op FROM events)),
st AS (
  SELECT DISTINCT cache_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS key_index, CAST(NULL AS VARCHAR) AS outcome, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS inc_hits, CAST(0 AS BIGINT) AS victims, CAST(0 AS BIGINT) AS used,
    CAST([] AS STRUCT(k BIGINT, c BIGINT)[]) AS res, list_transform(range({cells}), lambda i: CAST(0 AS BIGINT)) AS cells, CAST([] AS BIGINT[]) AS door, CAST(0 AS BIGINT) AS reads FROM log
  UNION ALL
  SELECT cache_id, pos, seq, k, outcome, c, CASE WHEN outcome IN ('Admitted', 'RejectedBySampling') THEN mine ELSE 0 END, CASE WHEN fresh THEN least(needed, allowed) ELSE 0 END,
    CAST(CASE WHEN outcome = 'RejectedByCost' THEN used ELSE coalesce(list_sum(list_transform(after, lambda r: r.c)), 0) END AS BIGINT), after,
    CASE WHEN op = 'clear' THEN list_transform(cells, lambda x: CAST(0 AS BIGINT)) WHEN ages THEN list_transform(counted, lambda x: x // 2) ELSE counted END,
    CASE WHEN op = 'clear' OR ages THEN CAST([] AS BIGINT[]) WHEN op = 'get' AND NOT known THEN list_distinct(list_concat(door, b)) ELSE door END,
    CASE WHEN op = 'clear' OR ages THEN 0 WHEN op = 'get' THEN reads + 1 ELSE reads END
  FROM (SELECT *, CASE WHEN op = 'clear' THEN CAST([] AS STRUCT(k BIGINT, c BIGINT)[])
        WHEN op = 'remove' OR outcome = 'RejectedByCost' THEN list_filter(res, lambda r: r.k <> k)
        WHEN outcome = 'UpdatedExisting' THEN list_transform(res, lambda r: {{'k': r.k, 'c': CASE WHEN r.k = k THEN c ELSE r.c END}})
        WHEN fresh THEN list_concat(list_transform(ranked[least(needed, allowed) + 1:], lambda r: {{'k': r.k, 'c': r.c}}), CASE WHEN outcome = 'Admitted' THEN [{{'k': k, 'c': c}}] ELSE CAST([] AS STRUCT(k BIGINT, c BIGINT)[]) END)
        ELSE res END AS after
    FROM (SELECT *, CASE WHEN op <> 'insert' THEN NULL WHEN c > {budget} THEN 'RejectedByCost' WHEN NOT fresh THEN 'UpdatedExisting' WHEN needed <= allowed THEN 'Admitted' ELSE 'RejectedBySampling' END AS outcome
      FROM (SELECT *, len(list_filter(ranked, lambda r: r.e <= mine)) AS allowed,
          len(list_filter(range(len(ranked)), lambda i: used - coalesce(list_sum(list_transform(ranked[1:i], lambda r: r.c)), 0) + c > {budget})) AS needed
        FROM (SELECT *, cells[(k & {mask}) + 1] + CAST(known AS BIGINT) AS mine, op = 'get' AND reads + 1 >= {counters} AS ages,
            CASE WHEN op = 'get' AND known THEN list_transform(cells, lambda x, i: CASE WHEN i = (k & {mask}) + 1 THEN least(15, x + 1) ELSE x END) ELSE cells END AS counted,
            CASE WHEN fresh THEN list_sort(list_transform(res, lambda r: {{'e': cells[(r.k & {mask}) + 1] + CAST(list_has_all(door, list_transform(range({probes}), lambda i: ((r.k >> {shift}) + i * (r.k & {bits})) & {bits})) AS BIGINT), 'k': r.k, 'c': r.c}})) END AS ranked
          FROM (SELECT l.*, res, cells, door, reads, list_has_all(door, b) AS known, coalesce(list_sum(list_transform(res, lambda r: r.c)), 0) AS used,
              op = 'insert' AND c <= {budget} AND len(list_filter(res, lambda r: r.k = l.k)) = 0 AS fresh
            FROM st JOIN log l ON l.cache_id = st.cache_id AND l.pos = st.pos + 1)))))
)
""".format(probes=P1, shift=60 - E1, bits=(1 << E1) - 1, cells=sketch_mask(SMALL.num_counters) + 1, mask=sketch_mask(SMALL.num_counters), counters=SMALL.num_counters, budget=SMALL.max_cost)  # fmt: skip


def log_of(spark, sf_dir):
    """The event log with hashed keys, so that estimates spread over cells."""
    return events(spark, sf_dir).withColumn("key_index", md5_index(F.col("key_index")))


@query()
def policy_replay(spark, sf_dir):
    """Counters of every cache under a tight budget."""
    return metrics.with_ratio(policy.replay(log_of(spark, sf_dir), CONFIG).drop("config_id"))


@query()
def policy_decisions(spark, sf_dir):
    """The outcome of every write."""
    return policy.replay(log_of(spark, sf_dir), CONFIG, "decisions").drop("config_id")


@query(STEPS + "SELECT cache_id, seq, key_index, outcome, cost, inc_hits, victims, used FROM st WHERE outcome IS NOT NULL")
def policy_steps(spark, sf_dir):
    """Every decision of the policy on the event log without times to live, with a small sketch that ages often."""
    d = policy.replay(log_of(spark, sf_dir).withColumn("ttl_us", F.lit(0).cast("long")), SMALL, "decisions")
    return d.select("cache_id", "seq", "key_index", "outcome", "cost", "inc_hits", F.size("victims").cast("long").alias("victims"), "used")


@query(STEPS + "SELECT cache_id, r.k AS key_index, r.c AS cost, true AS stored FROM (SELECT cache_id, unnest(res) AS r FROM (SELECT cache_id, arg_max(res, pos) AS res FROM st GROUP BY cache_id))")
def policy_residents(spark, sf_dir):
    """Who is resident after the last of these decisions, each with a stored row."""
    log = log_of(spark, sf_dir).withColumn("ttl_us", F.lit(0).cast("long"))
    return policy.replay(log, SMALL, "ledger").select("cache_id", "key_index", "cost", "stored")


@query()
def policy_victims(spark, sf_dir):
    """Evicted keys by the write that evicted them."""
    d = policy.replay(log_of(spark, sf_dir), CONFIG, "decisions")
    return d.select("cache_id", "seq", F.explode("victims").alias("v")).select("cache_id", "seq", "v.key", "v.cost")


@query()
def policy_ledger(spark, sf_dir):
    """Residents at the end of the log."""
    return policy.replay(log_of(spark, sf_dir), CONFIG, "ledger").drop("config_id")


@query()
def policy_feed(spark, sf_dir):
    """What left the cache and why."""
    return policy.replay(log_of(spark, sf_dir), CONFIG, "feed").drop("config_id")


@query("SELECT 'over budget after a decision' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'costs added less evicted differ from use', 0 UNION ALL SELECT 'resident without a stored row', 0 UNION ALL SELECT 'caches checked', 4")
def policy_invariants(spark, sf_dir):
    """The budget, the sum of costs (since the last clear, which empties counters and ledger) and the ledger's rows hold."""
    log = log_of(spark, sf_dir)
    differs = F.count_if(F.col("cost_added") - F.col("cost_evicted") != F.col("used"))
    m = policy.replay(log, CONFIG).agg(F.array(F.struct(F.lit("costs added less evicted differ from use").alias("rule"), differs.alias("violations")), F.struct(F.lit("caches checked").alias("rule"), F.count("*").alias("violations"))).alias("r"))
    over = policy.replay(log, CONFIG, "decisions").agg(F.count_if((F.col("outcome") == "Admitted") & (F.col("used") > F.col("max_cost"))).alias("violations"))
    ghosts = policy.replay(log, CONFIG, "ledger").agg(F.count_if(~F.col("stored")).alias("violations"))
    out = m.select(F.inline("r"))  # two rules of one replay
    for name, d in (("over budget after a decision", over), ("resident without a stored row", ghosts)):
        out = out.unionByName(d.select(F.lit(name).alias("rule"), "violations"))
    return out


@query(without_clears(COUNTERS) + "SELECT cache_id, hit, miss, keys_added, keys_updated, keys_evicted, cost_added - cost_evicted AS used FROM t")
def policy_infinite(spark, sf_dir):
    """With room for everything the kernel and the set-based plans agree (no clears)."""
    log = from_events(table(spark, sf_dir, "events"), clears=False)
    return policy.replay(log, CacheConfig(num_counters=1000, max_cost=2**50)).select("cache_id", "hit", "miss", "keys_added", "keys_updated", "keys_evicted", "used")


@query()
def policy_hit_ratio(spark, sf_dir):
    """M3 by configuration: sampled and exact victims, with and without lags."""
    from dataclasses import replace

    configs = {"exact": CONFIG, "sampled": replace(CONFIG, victim="sampled", seed=7), "batched": replace(CONFIG, admission_lag="batch", freq_lag="batch", buffer_items=8, insert_stripe_high_water=8)}
    return metrics.with_ratio(policy.replay(log_of(spark, sf_dir), configs)).select("config_id", "cache_id", "hit", "miss", "hit_ratio")


@query()
def policy_sweep(spark, sf_dir):
    """U8: budgets and policies side by side."""
    d = policy.replay(log_of(spark, sf_dir), policy.sweep(CONFIG, [100, 400, 1600]))
    return metrics.with_ratio(d.groupBy("config_id").agg(*[F.sum(c).alias(c) for c in ("hit", "miss", "keys_evicted", "sets_rejected")]))


def home(spark) -> str:
    """A new folder below the shared one, for stream checkpoints and sinks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="cachelens-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query()
def stream_policy(spark, sf_dir):
    """The kernel as streaming state; its counters at the end equal those of the batch."""
    d = streaming.run_to_end(streaming.cache_metrics(streaming.events_stream(spark, sf_dir), CONFIG), "metrics", home(spark))
    last = d.groupBy("cache_id").agg(F.max_by(F.struct(*[c for c in d.columns if c not in ("cache_id", "epoch")]), "epoch").alias("r"))
    return last.select("cache_id", "r.*")


@query("SELECT 'c' || (user_id % 4) AS cache_id, CASE WHEN event_id % 997 = 996 THEN 'clear' WHEN event_type IN ('view', 'click') THEN 'get' WHEN event_type IN ('purchase', 'signup') THEN 'insert' ELSE 'remove' END AS op, count(*) AS n FROM events GROUP BY ALL")
def stream_op_counts(spark, sf_dir):
    """S1 as a stream: operations by cache and kind, from streaming aggregation."""
    counts = streaming.events_stream(spark, sf_dir).groupBy("cache_id", "op").agg(F.count("*").alias("n"))
    d = streaming.run_to_end(counts, "counts", home(spark))
    return d.groupBy("cache_id", "op").agg(F.max_by("n", "epoch").alias("n"))


@query("SELECT cache_id, CASE WHEN kind = 'exit' THEN seq END AS seq, kind, key_index, value, cost FROM (" + without_clears(state_queries.ORACLE["change_feed_exit"]) + ")")
def stream_feed(spark, sf_dir):
    """Callbacks of a stream write what left the caches (with room for everything; no clears), each kind to its own table."""
    log, base = streaming.events_stream(spark, sf_dir, clears=False), home(spark)
    feed = streaming.cache_feed(log, CacheConfig(num_counters=1000, max_cost=2**50, ignore_internal_cost=True))
    streaming.deliver(feed, f"{base}/checkpoint", exit=streaming.to_parquet(f"{base}/exit"), evict=streaming.to_parquet(f"{base}/evict")).awaitTermination()
    return spark.read.parquet(f"{base}/exit").unionByName(spark.read.parquet(f"{base}/evict")).select("cache_id", "seq", "kind", "key_index", "value", "cost")
