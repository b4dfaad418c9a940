"""Golden values and step models."""

import os
import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.errors import StreamingQueryException

from cachelens import errors
from cachelens.config import CacheConfig
from cachelens.functions.sizing import bloom_bytes, bloom_shape, sketch_mask
from cachelens.operators import histogram, metrics, policy, state
from cachelens.operators.policy import Frequency, Kernel
from cachelens.operators.running import first_after, last_before, position, running_sum
from cachelens.operators.sketch import TinyLfu
from cachelens.sources.oplog import COLUMNS, checked
from cachelens.sources.synthetic import xorshift, xorshift_keys

LOG = "cache_id string, seq long, ts_us long, client_id long, op string, key_index long, key_conflict long, value string, cost long, ttl_us long, new_max_cost long"


def log_of(spark, rows):
    """rows: (seq, ts_us, op, key, value, cost, ttl_us)."""
    return spark.createDataFrame([("c", s, t, 0, op, k, 0, v, c, ttl, None) for s, t, op, k, v, c, ttl in rows], LOG)


# --- sizing and configuration


def test_bloom_sizes():
    assert bloom_shape(10, 7)[0] == 9 and bloom_bytes(9) == 96
    assert [1 << bloom_shape(n, 0.01)[0] for n in (16, 100, 1000)] == [512, 1024, 16384]
    assert bloom_shape(0, 0.01)[1] > 0
    for bad in (0.0, float("nan"), -0.5):
        with pytest.raises(errors.InvalidFalsePositiveRatio, match="finite"):
            bloom_shape(10, bad)
    with pytest.raises(errors.InvalidFalsePositiveRatio, match="entries out of range"):
        bloom_shape(2**63, 1e-300)
    with pytest.raises(errors.InvalidFalsePositiveRatio, match="probes out of range"):
        bloom_shape(10, 1e15)


def test_sketch_width():
    assert sketch_mask(5) == 7
    with pytest.raises(errors.InvalidCountMinWidth):
        sketch_mask(0)


def test_configuration():
    c = CacheConfig(num_counters=10, max_cost=5, drain_interval_us=0, cleanup_us=0)
    assert (c.drain_interval_us, c.cleanup_us, c.buffer_items) == (500_000, 2_000_000, 64)
    for bad, error in (({"num_counters": 0}, errors.InvalidNumCounters), ({"max_cost": 0}, errors.InvalidMaxCost), ({"insert_stripe_high_water": 0}, errors.InvalidBufferSize), ({"samples": 0}, errors.InvalidSamples), ({"victim": "any"}, errors.CacheError), ({"cleanup_us": -1}, errors.InvalidInterval)):
        with pytest.raises(error):
            CacheConfig(**{"num_counters": 1, "max_cost": 1} | bad)


def test_missing_column(spark):
    with pytest.raises(errors.MissingColumn):
        checked(spark.range(1), *COLUMNS)


# --- frequency


def test_frequency_ages_after_its_counters():
    f = Frequency(4)
    for _ in range(3):
        f.increment(1)
    assert f.estimate(1) == 3 and f.cells == {1: 2}
    f.increment(1)
    assert f.cells == {1: 1} and not f.door and f.estimate(1) == 1
    f = Frequency(16)
    for k in (1, 2, 2, 3, 3, 3):
        f.increment(k << 50 | k)
    assert [f.estimate(k << 50 | k) for k in (1, 2, 3)] == [1, 2, 3] and f.reads == 6
    f.clear()
    assert f.estimate(3 << 50 | 3) == 0 and f.reads == 0
    f = Frequency(1000)
    for _ in range(40):
        f.increment(7 << 40)
    assert f.estimate(7 << 40) == 16


@pytest.mark.parametrize("counters,reads", [(16, 100), (5, 73), (64, 400), (8, 64)])
def test_relational_estimates_equal_the_step_model(spark, counters, reads):
    rng = random.Random(counters)
    keys = [rng.randrange(2**60) for _ in range(12)]
    trace = [keys[min(int(rng.expovariate(0.4)), 11)] for _ in range(reads)]
    model = Frequency(counters)
    for k in trace:
        model.increment(k)
    df = spark.createDataFrame([("c", i, k) for i, k in enumerate(trace)], "cache_id string, seq long, key long")
    got = {r.key: r.estimate for r in TinyLfu(df, "key", counters, ["cache_id"]).estimates().collect()}
    assert got == {k: model.estimate(k) for k in set(trace)}


def test_door_hits_without_multiplying_reads(spark):
    rng = random.Random(5)
    keys = [rng.randrange(2**60) for _ in range(30)]
    trace = [(rng.choice("ab"), i, rng.choice(keys)) for i in range(400)]
    d = TinyLfu(spark.createDataFrame(trace, "cache_id string, seq long, key long"), "key", 16, ["cache_id"])
    want = []
    for cache in "ab":
        model = Frequency(16)
        for pos, key in enumerate([k for c, _, k in trace if c == cache]):
            want.append((cache, pos // 16, pos + 1, key, model.door.issuperset(policy._bits(key, d.exponent, d.probes))))
            model.increment(key)
    assert sorted((r.cache_id, r.epoch, r.pos, r.key, r.door_hit) for r in d.door_hits().collect()) == sorted(want)
    got = {(r.cache_id, r.epoch): (r.reads, r.door_hits) for r in d.epoch_hits().collect()}
    assert got == {g: (len(hits), sum(hits)) for g in {w[:2] for w in want} for hits in [[w[4] for w in want if w[:2] == g]]}
    assert "Generate" not in d.epoch_cells()._jdf.queryExecution().toString()  # no row per bit of a read


# --- running values


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_running_values_at_any_block_size(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(-5, 6), rng.random() < 0.3) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, n long, v long, f boolean")
    d = running_sum(df, df["v"], ["g"], "n", "s", block)
    d = position(d, ["g"], "n", "p", block)
    from pyspark.sql import functions as F

    d = last_before(d, F.col("f"), F.struct("n"), ["g"], "n", "last", block)
    d = first_after(d, F.col("f"), F.struct("n"), ["g"], "n", "next", block)
    for r in d.collect():
        mine = [x for x in rows if x[0] == r.g]
        assert r.s == sum(x[2] for x in mine if x[1] <= r.n)
        assert r.p == sum(1 for x in mine if x[1] <= r.n)
        assert (r.last.n if r["last"] else None) == max((x[1] for x in mine if x[1] < r.n and x[3]), default=None)
        assert (r.next.n if r["next"] else None) == min((x[1] for x in mine if x[1] > r.n and x[3]), default=None)


# --- histogram


def test_histogram_percentiles(spark):
    bounds = tuple(range(32, 515, 4))
    df = spark.createDataFrame([(4 * i,) for i in range(256)], "v long")
    p = {r.p: r.bound for r in histogram.percentiles(df, "v", (0.0, 1.0), tuple(b for b in bounds if b <= 512) + (514,)).collect()}
    assert p == {0.0: 32, 1.0: 514}
    df = spark.createDataFrame([(v,) for v in (0, 4, 8, 12, 16)], "v long")
    five = (4, 8, 12, 16)
    assert [(r.bucket, r.lo, r.hi, r.n) for r in histogram.buckets(df, "v", five).orderBy("bucket").collect()][:1][0][3] == 1
    s = histogram.summary(df, "v").first()
    assert (s["count"], s["min"], s["max"], s["mean"]) == (5, 0, 16, 8.0)
    nothing = histogram.summary(df.limit(0), "v").first()
    assert (nothing["count"], nothing["min"], nothing["max"], nothing["mean"]) == (0, 2**63 - 1, 0, 0.0)
    assert [r.bound for r in histogram.percentiles(df.limit(0), "v", (0.5,), five).collect()] == [4]
    with pytest.raises(errors.InvalidHistogramBounds):
        histogram.bucket_of(df["v"], (3, 2))


# --- store


def test_reads_expire_at_their_time_to_live(spark):
    rows = [(0, 0, "insert", 1, "a", 1, 1_000_000), (1, 999_999, "get", 1, None, 0, 0), (2, 1_000_000, "get", 1, None, 0, 0), (3, 2_000_000, "insert", 1, "b", 1, 0), (4, 9_000_000, "get", 1, None, 0, 0), (5, 9_000_001, "clear", None, None, 0, 0), (6, 9_000_002, "get", 1, None, 0, 0)]
    got = {r.seq: r.hit for r in state.hits(log_of(spark, rows)).collect()}
    assert got == {1: True, 2: False, 4: True, 6: False}


def test_ratio_of_one_hit_and_one_miss(spark):
    rows = [(0, 0, "insert", 1, "a", 1, 0), (1, 1, "get", 1, None, 0, 0), (2, 2, "get", 2, None, 0, 0)]
    assert metrics.with_ratio(metrics.counters(log_of(spark, rows))).first().hit_ratio == 0.5


# --- kernel


def kernel(max_cost=100, counters=1000, **more):
    return Kernel(CacheConfig(num_counters=counters, max_cost=max_cost, **more))


def put(k, seq, key, cost, value="v", ttl=0, op="insert"):
    k.step(op, seq, seq, 0, key, 0, value, cost, ttl, None)


def outcomes(k):
    return [d[2] for d in k.decisions]


def test_admission_outcomes():
    k = kernel(100)
    put(k, 0, 1, 101)
    assert outcomes(k) == ["RejectedByCost"] and 1 not in k.store
    for key in (1, 2, 3):
        k.step("get", 0, 0, 0, key << 50, 0, None, 0, 0, None)
    put(k, 1, 1 << 50, 1)
    put(k, 2, 2 << 50, 20)
    put(k, 3, 3 << 50, 90)
    put(k, 4, 4 << 50, 20)
    assert outcomes(k)[1:] == ["Admitted", "Admitted", "Admitted", "RejectedBySampling"]
    assert k.decisions[3][5] and 4 << 50 not in k.store
    put(k, 5, 3 << 50, 95)
    assert outcomes(k)[-1] == "UpdatedExisting" and k.ledger.used == sum(k.ledger.costs.values())


def test_update_may_exceed_until_the_next_insert():
    k = kernel(5)
    put(k, 0, 1, 1)
    put(k, 1, 2, 2)
    put(k, 2, 1, 4)
    assert k.ledger.used == 6 and outcomes(k)[-1] == "UpdatedExisting"
    put(k, 3, 3, 1)
    assert k.ledger.used <= 5


def test_internal_cost_counts():
    k = kernel(10, ignore_internal_cost=False)
    put(k, 0, 1, 1)
    assert outcomes(k) == ["RejectedByCost"]
    k.step("update_max_cost", 1, 1, 0, None, None, None, None, None, 1000)
    put(k, 2, 1, 1)
    assert outcomes(k)[-1] == "Admitted" and k.ledger.cost(1) == 57


def test_conflicting_key_is_refused():
    k = kernel()
    k.step("insert", 0, 0, 0, 1, 5, "a", 1, 0, None)
    k.step("insert", 1, 1, 0, 1, 6, "b", 1, 0, None)
    k.step("remove", 2, 2, 0, 1, 6, None, 0, 0, None)
    assert k.store[1].value == "a" and not k.step("get", 3, 3, 0, 1, 6, None, 0, 0, None) and k.step("get", 4, 4, 0, 1, 0, None, 0, 0, None)


def test_sweep_waits_for_its_bucket():
    k = kernel()
    put(k, 0, 1, 1, ttl=1_000_000)
    put(k, 1, 2, 1, ttl=60_000_000)
    k.step("get", 2, 1_500_000, 0, 1, 0, None, 0, 0, None)
    assert 1 in k.store and k.counts["miss"] == 1
    k.step("get", 3, 4_000_001, 0, 2, 0, None, 0, 0, None)
    assert 1 not in k.store and 2 in k.store and k.events[-1][1] == "evict"


def test_conditional_insert_ends_a_time_to_live_and_makes_no_row():
    k = kernel()
    put(k, 0, 1, 1, op="insert_if_present")
    assert not k.store
    put(k, 1, 1, 1, ttl=1_000_000)
    put(k, 2, 1, 1, op="insert_if_present")
    assert k.store[1].ttl_us == 0


def test_end_of_log_processes_or_rolls_back():
    for policy_, stored in (("process", 3), ("rollback", 0)):
        k = kernel(admission_lag="batch", end_policy=policy_, drain_interval_us=10**9)
        for i in range(3):
            put(k, i, i, 1)
        k.finish()
        assert len(k.store) == stored and k.counts["sets_dropped"] == (0 if stored else 3)


def test_clear_wipes_and_begins_a_generation():
    k = kernel()
    for i in range(10):
        put(k, i, i, 1)
    assert k.counts["keys_added"] == 10
    k.step("clear", 10, 10, 0, None, None, None, None, None, None)
    assert not k.store and k.counts["keys_added"] == 0 and k.generation == 1 and not k.ledger.costs


@pytest.mark.parametrize("victim", ["exact", "sampled"])
def test_random_logs_keep_the_invariants(victim):
    rng = random.Random(11)
    for _ in range(20):
        k = kernel(50, counters=64, victim=victim, seed=3)
        for seq in range(400):
            op = rng.choices(["get", "insert", "remove", "insert_if_present", "wait"], [5, 4, 1, 1, 0.1])[0]
            k.step(op, seq, seq * 50_000, rng.randrange(4), rng.randrange(40) << 50, 0, "v", rng.randrange(0, 20), rng.choice([0, 0, 3_000_000]), None)
            assert k.ledger.used == sum(k.ledger.costs.values()) == k.counts["cost_added"] - k.counts["cost_evicted"]
            assert set(k.ledger.costs) <= set(k.store)
        assert all(d[6] <= 50 for d in k.decisions if d[2] == "Admitted")


def test_samples_take_distinct_residents():
    """FX17: a sample of three is filled to five from two residents; with one left it reaches four."""
    k = kernel(100, victim="sampled")
    put(k, 0, 4, 4)
    put(k, 1, 5, 5)
    sample = [1, 2, 3]
    k._victim(sample)
    assert len(sample) == 4 and len(set(sample)) == 4
    k.ledger.take(5)
    sample = [1, 2, 3]
    k._victim(sample)
    assert len(sample) == 3


def test_a_victim_sampled_twice_is_listed_twice_and_evicted_once():
    k = kernel(10, victim="sampled", samples=5)
    put(k, 0, 1 << 50, 5)
    put(k, 1, 2 << 50, 5)
    put(k, 2, 3 << 50, 10)
    listed = [v["key"] for v in k.decisions[-1][5]]
    assert set(listed) == {1 << 50, 2 << 50} and k.counts["keys_evicted"] == 2 and k.ledger.used == 10
    assert sorted(e[2] for e in k.events if e[1] == "evict") == [1 << 50, 2 << 50]


def test_exact_victims_equal_a_search_of_all_residents():
    rng = random.Random(6)
    k = kernel(60, counters=32)
    for seq in range(3000):
        k.step(rng.choice(["get", "insert", "remove"]), seq, seq, 0, rng.randrange(60) << 50, 0, "v", rng.randrange(1, 9), 0, None)
        if k.ledger.costs:
            assert k._coldest() == min(k.ledger.costs, key=lambda x: (k.frequency.estimate(x), x))
        assert sorted(k.ledger.keys) == sorted(k.ledger.costs)


def test_a_tick_looks_at_due_buckets_only():
    searches = []

    class Watched(defaultdict):
        def __iter__(self):
            searches.append(len(self))
            return super().__iter__()

    k = kernel(10**6)
    k.buckets = Watched(set)
    for i in range(300):
        k.step("insert", i, i * 3_000_000, 0, i, 0, "v", 1, 900_000_000 + i, None)
        k.step("remove", i, i * 3_000_000, 0, i - 3, 0, None, 0, 0, None)
    assert len(k.store) == 3 and len(k.buckets) == 3 and len(k.due) < 100 and len(searches) < 10
    k.step("get", 300, 10**10, 0, 0, 0, None, 0, 0, None)
    assert not k.store and not k.buckets and not k.due and k.ledger.used == 0


@pytest.mark.parametrize("admission", ["tinylfu", "lru", "infinite"])
def test_a_kernel_that_notes_nothing_counts_the_same(admission):
    rng = random.Random(9)
    config = CacheConfig(num_counters=32, max_cost=60, admission=admission)
    full, bare = Kernel(config), Kernel(config, keep=())
    for seq in range(3000):
        step = (rng.choice(["get", "insert", "remove"]), seq, seq * 500_000, 0, rng.randrange(60) << 50, 0, "v", rng.randrange(1, 9), rng.choice([0, 3_000_000]), None)
        full.step(*step)
        bare.step(*step)
    assert full.decisions and full.events and not (bare.decisions or bare.events or bare.born)
    assert full.counts == bare.counts and full.ledger.costs == bare.ledger.costs and set(full.store) == set(bare.store)


def test_a_full_line_drops_batches():
    k = kernel(admission_lag="batch", insert_stripe_high_water=1, queue_batches=1, service_us=10, drain_interval_us=10**9)
    put(k, 0, 1, 3)  # done at 10
    put(k, 1, 2, 3)  # finds the line full: the row goes again
    assert set(k.store) == {1} and k.counts["sets_dropped"] == 1 and k.events[-1][1:3] == ("reject", 2)
    put(k, 11, 3, 3)  # the first is done
    assert set(k.ledger.costs) == {1} and k.counts["sets_dropped"] == 1
    put(k, 12, 1, 5, value="w")  # dropped, but an update's value stays; its cost is not settled
    assert k.store[1].value == "w" and k.ledger.cost(1) == 3 and k.counts["sets_dropped"] == 2
    k.step("wait", 13, 13, 0, None, None, None, None, None, None)
    assert set(k.ledger.costs) == {1, 3}
    plain = kernel(admission_lag="batch", insert_stripe_high_water=1, drain_interval_us=10**9)
    for seq in range(50):
        put(plain, seq, seq, 1)
    assert plain.counts["sets_dropped"] == 0


def test_full_read_lines_drop_reads():
    k = kernel(freq_lag="batch", buffer_items=2, read_queue_batches=1, service_us=10, drain_interval_us=10**9)
    for seq in range(6):
        k.step("get", seq, seq, 0, 7, 0, None, 0, 0, None)
    assert (k.counts["gets_kept"], k.counts["gets_dropped"], k.frequency.reads) == (2, 4, 0)
    k.step("get", 20, 20, 0, 7, 0, None, 0, 0, None)
    assert k.frequency.reads == 2


def test_queued_removals_leave_the_ledger_in_their_turn():
    k = kernel(admission_lag="batch", insert_stripe_high_water=1, queue_batches=9, service_us=10, drain_interval_us=10**9)
    put(k, 0, 1, 3)
    put(k, 20, 2, 4)
    k.step("remove", 21, 21, 0, 1, 0, None, 0, 0, None)
    assert 1 not in k.store and k.ledger.cost(1) == 3  # until 40
    k.step("get", 45, 45, 0, 1, 0, None, 0, 0, None)
    assert set(k.ledger.costs) == {2}
    k.step("remove", 46, 46, 0, 2, 0, None, 0, 0, None)
    put(k, 47, 2, 6)  # takes the index over before the removal's turn
    k.finish()
    assert k.ledger.costs == {2: 6} and set(k.store) == {2}


def test_lines_keep_the_sums():
    rng = random.Random(5)
    k = kernel(60, admission_lag="batch", insert_stripe_high_water=3, queue_batches=2, service_us=40, drain_interval_us=5_000)
    for seq in range(3000):
        k.step(rng.choice(["get", "insert", "insert", "remove"]), seq, seq * 10, rng.randrange(3), rng.randrange(50) << 50, 0, "v", rng.randrange(1, 9), 0, None)
        assert k.ledger.used == sum(k.ledger.costs.values()) == k.counts["cost_added"] - k.counts["cost_evicted"]
    k.finish()
    assert k.counts["sets_dropped"] > 0 and set(k.ledger.costs) <= set(k.store)


def test_conditional_inserts_equal_the_kernel(spark):
    from cachelens.operators.state import conditional_inserts
    from cachelens.sources.oplog import COLUMNS

    rng, k, rows, want = random.Random(8), kernel(10**6), [], []
    for seq in range(600):
        op, key, now = rng.choice(["insert", "insert_if_present", "insert_if_present", "remove", "clear"][: 4 + (rng.random() < 0.03)]), rng.randrange(12), seq * 300_000
        ttl = rng.choice([0, 2_000_000, 9_000_000]) if op == "insert" else 0
        rows.append(("c", seq, now, 0, op, key, 0, "v", 1, ttl, None))
        before = k.version
        k.step(*[rows[-1][COLUMNS.index(c)] for c in ("op", "seq", "ts_us", "client_id", "key_index", "key_conflict", "value", "cost", "ttl_us", "new_max_cost")])
        if op == "insert_if_present":
            want.append((seq, k.version > before))
    log = spark.createDataFrame(rows, "cache_id string, seq long, ts_us long, client_id long, op string, key_index long, key_conflict long, value string, cost long, ttl_us long, new_max_cost long")
    got = sorted((r.seq, r.updated) for r in conditional_inserts(log).collect())
    assert got == want and 0 < sum(u for _, u in want) < len(want)


def test_mutable_reads_write_in_place():
    k = kernel()
    k.step("get_mut", 0, 0, 0, 1, 0, "lost", 0, 0, None)
    assert not k.store
    put(k, 1, 1, 3, ttl=5_000_000)
    version = k.store[1].version
    assert k.step("get_mut", 2, 2, 0, 1, 0, "w", 0, 0, None)
    row = k.store[1]
    assert (row.value, row.cost, row.ttl_us, row.version, len(k.decisions)) == ("w", 3, 5_000_000, version, 1)


def test_a_refused_update_leaves_the_accepted_value():
    k = Kernel(CacheConfig(num_counters=1000, max_cost=100), accepts=lambda old, old_cost, new, cost: cost > old_cost)
    for seq, cost in enumerate((5, 3, 4, 6)):
        put(k, seq, 1, cost, value=f"v{cost}")
    assert (k.store[1].value, k.ledger.cost(1), k.counts["keys_updated"]) == ("v6", 6, 1)  # 4 is more than the refused 3 but less than the accepted 5


def test_costs_by_value_and_eviction():
    """FX28: cost is the value where it is given as 0."""
    k = Kernel(CacheConfig(num_counters=1000, max_cost=10), coster=int)
    put(k, 0, 1, 0, value="1")
    assert k.ledger.cost(1) == 1
    put(k, 1, 1, 0, value="2")
    assert k.ledger.cost(1) == 2
    k.step("remove", 2, 2, 0, 1, 0, None, 0, 0, None)
    assert k.ledger.cost(1) == -1
    for seq, (key, cost) in enumerate(((2, 3), (3, 3), (4, 3), (5, 5))):
        put(k, 3 + seq, key, cost, value="x")
    assert any(e[1] in ("evict", "reject") for e in k.events)


def test_lifetimes_end_with_evictions_and_sweeps_only():
    k = kernel(10)
    put(k, 0, 1, 6)
    k.step("insert", 1, 2_500_000, 0, 2, 0, "v", 6, 0, None)
    assert [(e[1], e[2], e[5]) for e in k.events] == [("evict", 1, 2)]
    k.step("remove", 2, 3_000_000, 0, 2, 0, None, 0, 0, None)
    assert k.events[-1][1] == "exit" and k.events[-1][5] is None
    k.step("insert", 3, 3_000_000, 0, 3, 0, "v", 1, 1_000_000, None)
    k.step("get", 4, 9_000_000, 0, 9, 0, None, 0, 0, None)
    assert k.events[-1][1] == "evict" and k.events[-1][5] in (3, 4, 5)


def test_sampled_victims_vary():
    k = kernel(200, victim="sampled", counters=10_000)
    for i in range(200):
        put(k, i, i << 45, 1)
    seen = set()
    for i in range(64):
        put(k, 1000 + i, (500 + i) << 45, 1)
        seen.update(v["key"] for v in k.decisions[-1][5])
    assert len(seen) > 20


def test_admission_beats_recency_under_pressure(spark):
    """The policy's claim: when the working set is far larger than the budget, admission by frequency hits more than recency."""
    rng = random.Random(4)
    rows, seq = [], 0
    for _ in range(4000):
        key = (int(rng.paretovariate(0.6)) % 2000 * 0x9E3779B97F4A7C15) % 2**60
        rows += [("c", seq, seq, 0, "get", key, 0, None, 0, 0, None), ("c", seq + 1, seq + 1, 0, "insert", key, 0, "v", 1, 0, None)]
        seq += 2
    df = spark.createDataFrame(rows, LOG)
    got = {r.config_id: r.hit for r in policy.replay(df, policy.sweep(CacheConfig(num_counters=2000, max_cost=1), [25])).collect()}
    assert got["infinite-25"] > got["tinylfu-25"] > got["lru-25"]


def test_replays_are_not_put_together_in_one_task(spark):
    df = spark.createDataFrame([("c", 0, 0, 0, "get", 1, 0, "v", 0, 0, 0)], LOG)
    d = policy.replay(df, policy.sweep(CacheConfig(num_counters=2000, max_cost=1), [25, 50]))
    assert "REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString() and d.count() == 6


def test_replays_without_what_clears_wiped_equal_whole_ones(spark):
    """Times that go back, budgets that change, sweeps after the clear, a cache without a clear, and configurations that carry something across."""
    rng = random.Random(12)
    logs = {}
    for cache, clears in (("a", (500, 900)), ("b", (0,)), ("c", ()), (None, (300,)), ("d", (1199,))):
        rows, base = [], rng.randrange(10**7)
        for seq in range(1200):
            ts = base + (seq % 700) * 450_000 + rng.randrange(3_000_000)
            op = "clear" if seq in clears else rng.choices(["get", "insert", "remove", "insert_if_present", "update_max_cost", "wait"], [5, 5, 1, 1, 0.02, 0.1])[0]
            keyed = op not in ("clear", "wait", "update_max_cost")
            rows.append((cache, seq, ts, rng.randrange(4), op, rng.randrange(60) << 50 if keyed else None, 0 if keyed else None, "v", rng.randrange(1, 9), rng.choice([0, 2_000_000, 40_000_000]), rng.randrange(40, 90) if op == "update_max_cost" else None))
        logs[cache] = rows
    small = CacheConfig(num_counters=32, max_cost=60)
    configs = policy.sweep(small, [30, 60]) | {
        "sampled": replace(small, victim="sampled"),
        "reads": replace(small, freq_lag="batch", buffer_items=7),
        "lagged": replace(small, admission_lag="batch", insert_stripe_high_water=3, queue_batches=2, service_us=900_000, end_policy="rollback"),
    }
    df = spark.createDataFrame([r for rows in logs.values() for r in rows], LOG)
    metrics_, residents = {}, set()
    for name, config in configs.items():
        for cache, rows in logs.items():
            k = Kernel(config, keep=())
            for c, seq, ts, client, op, *rest in rows:
                k.step(op, seq, ts, client, *rest)
            k.finish()
            metrics_[name, cache] = (*[k.counts[n] for n in metrics.NAMES], k.ledger.used, k.ledger.budget)
            residents |= {(name, cache, key, cost, key in k.store) for key, cost in k.ledger.costs.items()}
    assert {(r[0], r[1]): tuple(r)[2:] for r in policy.replay(df, configs).collect()} == metrics_
    assert {tuple(r) for r in policy.replay(df, configs, "ledger").collect()} == residents
    # of the caches a and d few operations are left; b and those without a cache's name or a clear keep theirs
    left = {r.cache_id: r["count"] for r in policy.unwiped(df).groupBy("cache_id").count().collect()}
    assert left["b"] == left["c"] == left[None] == 1200 and left["a"] < 320 and left["d"] < 50


def test_caches_beyond_the_bound_of_a_broadcast_replay_whole(spark, monkeypatch):
    monkeypatch.setattr(policy, "CUTS", 1)
    ops = [("insert", 1), ("clear", None), ("insert", 1), ("clear", None), ("insert", 2), ("get", 2)]
    rows = [(cache, seq, seq, 0, op, key, 0, None, 1, 0, None) for cache, some in (("a", ops[2:]), ("b", ops)) for seq, (op, key) in enumerate(some)]
    df = spark.createDataFrame(rows, LOG)
    assert {r.cache_id: r["count"] for r in policy.unwiped(df).groupBy("cache_id").count().collect()} == {"a": 4, "b": 5}
    got = policy.replay(df, CacheConfig(num_counters=10, max_cost=10)).collect()
    assert sorted((r.cache_id, r.hit, r.keys_added, r.used) for r in got) == [("a", 1, 1, 1), ("b", 1, 1, 1)]


def test_a_replay_does_not_look_at_what_a_clear_has_wiped(spark):
    def accepts(before, *_):
        assert before != "wiped"
        return True

    steps = [(0, 0, "insert", 1, "wiped", 1, 0), (1, 1, "insert", 1, "wiped", 1, 0), (2, 2, "clear", None, None, None, None), (3, 3, "insert", 1, "kept", 1, 0), (4, 4, "insert", 1, "kept", 1, 0)]
    (got,) = policy.replay(log_of(spark, steps), CacheConfig(num_counters=10, max_cost=10), accepts=accepts).collect()
    assert (got.keys_added, got.keys_updated, got.used) == (1, 1, 1)


def test_stream_equals_batch(spark, sf):
    from cachelens.plans import policy_queries as q

    batch = {r.cache_id: r for r in q.policy_replay(spark, sf).collect()}
    from cachelens.operators.policy import replay
    from cachelens.plans.state_queries import events

    batch = {r.cache_id: r for r in replay(events(spark, sf), q.CONFIG).collect()}
    stream = {r.cache_id: r for r in q.stream_policy(spark, sf).collect()}
    assert {c: (r.hit, r.miss, r.keys_added, r.used) for c, r in stream.items()} == {c: (r.hit, r.miss, r.keys_added, r.used) for c, r in batch.items()}


def test_stream_of_several_files(spark, sf, tmp_path):
    from cachelens.operators.policy import replay
    from cachelens.plans import policy_queries as q
    from cachelens.streaming import replay as streaming

    config = CacheConfig(num_counters=100, max_cost=250)
    events = spark.read.parquet(f"{sf}/events.parquet")
    at = events.approxQuantile("event_id", [0.5], 0.0)[0]
    events.where(events.event_id <= at).coalesce(1).write.parquet(f"{tmp_path}/one")
    events.where(events.event_id > at).coalesce(1).write.parquet(f"{tmp_path}/two")

    def feed(order):
        home = tmp_path / "-".join(order)
        home.mkdir()
        for n, part in enumerate(order):  # the source takes files by their time
            (file,) = (tmp_path / part).glob("*.parquet")
            copy = home / f"events-{n}.parquet"
            copy.write_bytes(file.read_bytes())
            os.utime(copy, (1_000_000 + n, 1_000_000 + n))
        stream = streaming.from_events(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(home)))
        return streaming.cache_feed(stream.withColumn("key_index", q.md5_index(stream.key_index)), config)

    got = {k: streaming.to_parquet(f"{tmp_path}/out/{k}") for k in ("exit", "evict", "reject")}
    streaming.deliver(feed(["one", "two"]), f"{tmp_path}/checkpoint", **got).awaitTermination()
    rows = [tuple(r)[:6] for k in got for r in spark.read.parquet(f"{tmp_path}/out/{k}").select("cache_id", "seq", "kind", "key_index", "value", "cost").collect()]
    want = [tuple(r) for r in replay(q.log_of(spark, sf), config, "feed").select("cache_id", "seq", "kind", "key_index", "value", "cost").collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr) and {r[2] for r in rows} == set(got)

    with pytest.raises(StreamingQueryException, match="LateOperation"):
        streaming.deliver(feed(["two", "one"]), f"{tmp_path}/late", **got).awaitTermination()
    with pytest.raises(ValueError, match="no such kind: gone"):
        streaming.deliver(events, f"{tmp_path}/none", gone=print)


def test_a_sorter_merges_what_it_wrote():
    import pyarrow as pa

    from cachelens.streaming.replay import OPERATIONS, Sorter

    rng = random.Random(8)
    seqs = rng.sample(range(10**6), 5000)
    for most, files in ((2_000, True), (1 << 30, False)):
        s = Sorter(most, rows=7)
        for at in range(0, 5000, 100):
            part = seqs[at : at + 100]
            s.add(pa.RecordBatch.from_pylist([{"op": "get", "seq": n, "value": str(n) if n % 3 else None} for n in part], OPERATIONS))
        assert bool(s.files) == files and s.size <= max(most, 1 << 20)
        got = list(s.batches())
        assert max(len(b) for b in got) <= 7 * max(1, len(s.files))
        got = [(r["seq"], r["value"]) for b in got for r in b.to_pylist()]
        assert got == [(n, str(n) if n % 3 else None) for n in sorted(seqs)]


def test_read_results(spark):
    from cachelens.operators.ttl import remaining

    log = log_of(spark, [(1, 0, "get", 1, None, 0, 0), (2, 0, "insert", 1, "a", 1, 5_000_000), (3, 2_000_000, "get", 1, None, 0, 0), (4, 9_000_000, "get", 1, None, 0, 0), (5, 9_000_000, "insert", 1, None, 1, 0), (6, 9_000_001, "get", 1, None, 0, 0)])
    got = {r.seq: (r.present, r.found, r.remaining_us) for r in remaining(log).collect()}
    assert got == {1: (False, None, None), 3: (True, "a", 3_000_000), 4: (False, None, None), 6: (True, None, None)}


# --- sources


def test_xorshift_keys(spark):
    got = sorted((r.client_id, r.n, r.key) for r in xorshift_keys(spark, 2, 5, 100).collect())
    want = []
    for client in range(2):
        x = (client + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)
        for n in range(5):
            x = xorshift(x)
            want.append((client, n, x % 125))
    assert got == want
