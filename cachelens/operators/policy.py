"""The admission and eviction policy: a sequential replay of one cache's log.

Admission depends on everything before it, so each cache (and configuration) is replayed by one kernel in the order of ``seq``.  Caches and
configurations run in parallel; a cache's log is sorted within its partition and streamed through its kernel in Arrow batches, so memory is that of
the simulated cache, not of its log.
"""

from __future__ import annotations

import heapq
import random
from collections import Counter, OrderedDict, defaultdict, deque
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.config import CacheConfig
from cachelens.functions.keys import STRIPES
from cachelens.functions.sizing import bloom_shape, sketch_mask
from cachelens.operators.metrics import NAMES

HASH_BITS = 60
#: Most rows of a batch that goes back to Spark.
ROWS = 10_000
#: Most caches whose last clear is broadcast.
CUTS = 1 << 17


@lru_cache(maxsize=1 << 16)
def _bits(key: int, exponent: int, probes: int) -> tuple[int, ...]:
    size = (1 << exponent) - 1
    high, low = key >> (HASH_BITS - exponent), key & size
    return tuple([(high + i * low) & size for i in range(probes)])


class Frequency:
    """The aged frequency estimate: a filter for first sights, saturated cells, halving after ``counters`` reads."""

    def __init__(self, counters: int, ratio: float = 0.01):
        self.age = 0  # how often estimates may have fallen
        self.counters, self.mask = counters, sketch_mask(counters)
        self.exponent, self.probes = bloom_shape(counters, ratio)
        self.clear()

    def clear(self) -> None:
        self.door, self.cells, self.reads = set(), {}, 0
        self.known: set[int] = set()  # keys read since the filter was emptied, so it holds their bits
        self.age += 1

    def _seen(self, key: int) -> bool:
        return key in self.known or self.door.issuperset(_bits(key, self.exponent, self.probes))

    def increment(self, key: int) -> None:
        if self._seen(key):
            cell = key & self.mask
            self.cells[cell] = min(15, self.cells.get(cell, 0) + 1)
        else:
            self.door.update(_bits(key, self.exponent, self.probes))
        self.known.add(key)
        self.reads += 1
        if self.reads >= self.counters:
            self.reads = 0
            self.age += 1
            self.door.clear()
            self.known.clear()
            self.cells = {c: n >> 1 for c, n in self.cells.items() if n > 1}

    def estimate(self, key: int) -> int:
        return self.cells.get(key & self.mask, 0) + self._seen(key)


@dataclass(slots=True)
class Row:
    """A stored value."""

    conflict: int
    version: int
    generation: int
    value: str | None
    cost: int
    created_us: int
    ttl_us: int

    def expired(self, now: int) -> bool:
        return self.ttl_us > 0 and now - self.created_us >= self.ttl_us

    @property
    def bucket(self) -> int:
        return (self.created_us + self.ttl_us) // 1_000_000 + 1


@dataclass(slots=True)
class Item:
    """A queued admission: a new row or an update."""

    kind: str
    seq: int
    key: int
    conflict: int
    version: int
    generation: int
    cost: int


@dataclass
class Ledger:
    """The policy's view: costs by key, their sum, the order of last use (under the ``lru`` policy), and the keys by number (for samples, under ``tinylfu``)."""

    config: CacheConfig
    budget: int
    costs: dict[int, int] = field(default_factory=dict)
    used: int = 0
    keys: list[int] = field(default_factory=list)
    place: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.ordered, self.numbered = self.config.admission == "lru", self.config.admission == "tinylfu"
        if self.ordered:
            self.costs = OrderedDict()

    def room(self, cost: int) -> int:
        return self.budget - (self.used + cost)

    def put(self, key: int, cost: int) -> None:
        self.costs[key] = cost
        self.used += cost
        if self.numbered:
            self.place[key] = len(self.keys)
            self.keys.append(key)

    def take(self, key: int) -> int | None:
        cost = self.costs.pop(key, None)
        if cost is not None:
            self.used -= cost
            if self.numbered:
                at, last = self.place.pop(key), self.keys.pop()
                if last != key:  # the last one takes its place
                    self.keys[at], self.place[last] = last, at
        return cost

    def clear(self) -> None:
        self.costs.clear()
        self.keys.clear()
        self.place.clear()
        self.used = 0

    def cost(self, key: int) -> int:
        return self.costs.get(key, -1)


class Line:
    """Batches that wait for one processor, each with the time at which it is done."""

    def __init__(self, most: int, service_us: int):
        self.most, self.service_us = most, service_us
        self.waiting: deque[tuple[int, list]] = deque()
        self.free_us = 0

    def full(self) -> bool:
        return len(self.waiting) >= self.most

    def send(self, batch: list, now: int) -> None:
        self.free_us = max(self.free_us, now) + self.service_us
        self.waiting.append((self.free_us, batch))

    def done(self, now: int | None = None) -> Iterator[list]:
        """Take the batches that are done by ``now``, or all of them."""
        while self.waiting and (now is None or self.waiting[0][0] <= now):
            yield self.waiting.popleft()[1]
        if now is None:
            self.free_us = 0


class Kernel:
    """One cache.  ``step`` takes an operation and returns decisions and events; ``finish`` ends the log.

    Args:
        accepts: whether an update may replace ``(old value, old cost)`` by ``(new value, new cost)``; a refused one leaves the row as it was.
        coster: the cost of a value that is written with cost 0.
        keep: what is noted, of ``decisions`` and ``events``.  Whoever asks for them empties the lists.  Frequencies are counted where something depends on
            them: decisions, or admission by them.
    """

    def __init__(self, config: CacheConfig, accepts: Callable[[str | None, int, str | None, int], bool] | None = None, coster: Callable[[str | None], int] | None = None, keep: tuple[str, ...] = ("decisions", "events")):
        self.config, self.accepts, self.coster = config, accepts, coster
        self.keeps_decisions, self.keeps_events = "decisions" in keep, "events" in keep
        self.by_frequency = self.keeps_decisions or config.admission == "tinylfu"
        self.lagged = config.admission_lag != "none" or config.freq_lag != "none"
        self.born: dict[int, int] = {}
        self.coldest: list[tuple[int, int]] = []
        self.coldest_age = -1
        self.now = 0
        self.random = random.Random(config.seed)
        self.store: dict[int, Row] = {}
        self.ledger = Ledger(config, config.max_cost)
        self.frequency = Frequency(config.num_counters)
        self.reads: dict[int, list[int]] = defaultdict(list)
        self.queue: dict[int, list[Item]] = defaultdict(list)
        self.line = Line(config.queue_batches, config.service_us)
        self.read_line = Line(config.read_queue_batches, config.service_us)
        self.buckets: dict[int, set[int]] = {}
        self.due: list[int] = []  # a heap of the buckets' numbers, and of some that are gone
        self.counts = Counter()
        self.version = self.generation = 0
        self.start: int | None = None
        self.next_clean = self.next_drain = 0
        self.decisions: list[tuple] = []
        self.events: list[tuple] = []

    # --- the log

    def step(self, op: str, seq: int, now: int, client: int, key: int | None, conflict: int | None, value, cost: int | None, ttl: int | None, budget: int | None) -> bool | None:
        """Carry out one operation; for reads, whether it hit."""
        if self.lagged or self.start is None or now >= self.next_clean:
            self._tick(now)
        self.now = now
        if op == "get" or op == "get_mut":
            hit = self._read(now, client, key, conflict or 0)
            if hit and op == "get_mut" and value is not None:
                self.store[key].value = value  # in place: cost, time to live and version stay
            return hit
        if op == "insert":
            self._write(seq, now, client, key, conflict or 0, value, cost or 0, ttl or 0, only_present=False)
        elif op == "insert_if_present":
            self._write(seq, now, client, key, conflict or 0, value, cost or 0, 0, only_present=True)
        elif op == "remove":
            self._remove(seq, key, conflict or 0)
        elif op == "wait":
            self._flush()
        elif op == "clear":
            self._clear(seq)
        elif op == "update_max_cost":
            self.ledger.budget = budget
        return None

    def finish(self) -> None:
        """Process what is queued, or roll it back, as the configuration says."""
        if self.config.end_policy == "process":
            self._flush()
            return
        for items in [*self.line.done(), *self.queue.values()]:
            self._lose(items)
        self.queue.clear()

    # --- operations

    def _read(self, now: int, client: int, key: int, conflict: int) -> bool:
        if self.config.freq_lag == "none":
            if self.by_frequency:
                self.frequency.increment(key)
            self.counts["gets_kept"] += 1
        else:
            batch = self.reads[client & (STRIPES - 1)]
            batch.append(key)
            if len(batch) >= self.config.buffer_items:
                self.reads[client & (STRIPES - 1)] = []
                self._send_reads(batch, now)
        row = self.store.get(key)
        hit = row is not None and conflict in (0, row.conflict) and not row.expired(now)
        self.counts["hit" if hit else "miss"] += 1
        if hit and self.ledger.ordered and key in self.ledger.costs:
            self.ledger.costs.move_to_end(key)
        return hit

    def _write(self, seq, now, client, key, conflict, value, cost, ttl, only_present) -> None:
        row = self.store.get(key)
        if not cost and self.coster:
            cost = self.coster(value)
        cost += 0 if self.config.ignore_internal_cost else self.config.item_size
        if row is None:
            if only_present:
                return
            kind = "new"
        elif conflict in (0, row.conflict):
            if self.accepts and not self.accepts(row.value, row.cost, value, cost):
                return
            kind = "update"
            self._unbucket(key, row)
            if self.keeps_events:
                self.events.append((seq, "exit", key, row.value, row.cost, None))
        else:
            return
        self.version += 1
        self.store[key] = row = Row(conflict, self.version, self.generation, value, cost, now, ttl)
        if ttl:
            self._bucket(key, row)
        if self.config.admission_lag == "none":
            self._admit(kind, seq, key, cost)
            return
        batch = self.queue[client & (STRIPES - 1)]
        batch.append(Item(kind, seq, key, conflict, self.version, self.generation, cost))
        if len(batch) >= self.config.insert_stripe_high_water:
            self.queue[client & (STRIPES - 1)] = []
            self._send(batch, now)

    def _send_reads(self, batch: list[int], now: int) -> None:
        if not self.config.read_queue_batches:
            self._count_reads(batch)
        elif self.read_line.full():
            self.counts["gets_dropped"] += len(batch)
            return
        else:
            self.read_line.send(batch, now)
        self.counts["gets_kept"] += len(batch)

    def _count_reads(self, batch: list[int]) -> None:
        if self.by_frequency:
            for k in batch:
                self.frequency.increment(k)

    def _send(self, batch: list[Item], now: int) -> None:
        if not self.config.queue_batches:
            for i in batch:
                self._process(i)
        elif self.line.full():
            self._lose(batch)
        else:
            self.line.send(batch, now)

    def _lose(self, items: list[Item]) -> None:
        """Items that no processor will see: a new row goes again, an update's value stays, a removal leaves the ledger."""
        for i in items:
            row = self.store.get(i.key)
            if i.kind == "new" and row is not None and row.version == i.version:
                self._drop(i.key, i.seq, "reject")
            if i.kind != "update" and i.key not in self.store:
                self._unledger(i.key)
            self.counts["sets_dropped"] += i.kind != "delete"

    def _remove(self, seq: int, key: int, conflict: int) -> None:
        row = self.store.get(key)
        if row is None or conflict not in (0, row.conflict):
            return
        self._drop(key, seq, "exit")
        if self.config.queue_batches and self.config.admission_lag == "batch":  # waits its turn even in a full line
            self.line.send([Item("delete", seq, key, conflict, row.version, self.generation, 0)], self.now)
        else:
            self._unledger(key)

    def _clear(self, seq: int) -> None:
        self._flush()
        for batch in self.read_line.done():
            self._count_reads(batch)
        for key in list(self.store):
            self._drop(key, seq, "exit")
        self.ledger.clear()
        self.born.clear()
        self.frequency.clear()
        self.buckets.clear()
        self.due.clear()
        self.counts.clear()
        self.generation += 1

    def _tick(self, now: int) -> None:
        if self.start is None:
            self.start, self.next_clean, self.next_drain = now, now + self.config.cleanup_us, now + self.config.drain_interval_us
        if self.lagged:  # else nothing waits
            for batch in self.line.done(now):
                for i in batch:
                    self._process(i)
            for batch in self.read_line.done(now):
                self._count_reads(batch)
            if now >= self.next_drain:
                self._flush()
                self.next_drain += ((now - self.next_drain) // self.config.drain_interval_us + 1) * self.config.drain_interval_us
        if now >= self.next_clean:
            # all ticks up to now at once: the last of them sweeps what the earlier ones would have
            last = now - (now - self.next_clean) % self.config.cleanup_us
            while self.due and self.due[0] <= last // 1_000_000:
                for key in sorted(self.buckets.pop(heapq.heappop(self.due), ())):
                    row = self.store.get(key)
                    if row is not None and row.expired(last):
                        self._drop(key, None, "evict", last)
                        self._unledger(key)
            self.next_clean = last + self.config.cleanup_us

    # --- admission

    def _flush(self) -> None:
        for batch in self.line.done():
            for i in batch:
                self._process(i)
        for stripe in sorted(self.queue):
            items, self.queue[stripe] = self.queue[stripe], []
            for i in items:
                self._process(i)

    def _process(self, item: Item) -> None:
        row = self.store.get(item.key)
        if item.kind == "delete":
            if row is None:  # else a later write has taken the index over, and its own item settles the ledger
                self._unledger(item.key)
            return
        if item.generation != self.generation or row is None or row.version != item.version:
            return
        self._admit(item.kind, item.seq, item.key, item.cost)

    def _admit(self, kind: str, seq: int, key: int, cost: int) -> None:
        if kind == "update" and self._updated(key, cost):
            self._decide(seq, key, cost, "UpdatedExisting", 0, [])
            return
        outcome, estimate, victims = self._add(key, cost)
        self._decide(seq, key, cost, outcome, estimate, victims)
        for victim, _ in victims:
            if victim in self.store:  # a key that was sampled twice is gone by its second time
                self._drop(victim, seq, "evict", self.now)
        if outcome.startswith("Rejected"):
            self._drop(key, seq, "reject")
            self._unledger(key)

    def _updated(self, key: int, cost: int) -> bool:
        before = self.ledger.cost(key)
        if before < 0 or cost < 0 or cost > self.ledger.budget:
            return False
        self.counts["keys_updated"] += 1
        self.counts["cost_added"] += max(0, cost - before)
        self.counts["cost_evicted"] += max(0, before - cost)
        self.ledger.costs[key] = cost
        self.ledger.used += cost - before
        return True

    def _add(self, key: int, cost: int) -> tuple[str, int, list[tuple[int, int]]]:
        if cost < 0 or cost > self.ledger.budget and self.config.admission != "infinite":
            return "RejectedByCost", 0, []
        if key in self.ledger.costs:
            before, self.ledger.costs[key] = self.ledger.costs[key], cost
            self.ledger.used += cost - before
            self.counts["keys_updated"] += 1
            self.counts["cost_added"] += max(0, cost - before)
            self.counts["cost_evicted"] += max(0, before - cost)
            return "UpdatedExisting", 0, []
        mine, victims, sample = self.frequency.estimate(key) if self.by_frequency else 0, [], []
        while self.config.admission != "infinite" and self.ledger.room(cost) < 0 and self.ledger.costs:
            victim = self._victim(sample)
            if self.config.admission == "tinylfu" and mine < self.frequency.estimate(victim):
                self.counts["sets_rejected"] += 1
                return "RejectedBySampling", mine, victims
            victims.append((victim, self._unledger(victim)))  # no cost for one that is gone
        self.ledger.put(key, cost)
        if self.keeps_events:
            self.born[key] = self.now
        if self.coldest_age == self.frequency.age:
            if len(self.coldest) > 2 * len(self.ledger.costs) + 64:
                self.coldest_age = -1  # mostly stale: made anew when next asked for
            else:
                heapq.heappush(self.coldest, (mine, key))
        self.counts["keys_added"] += 1
        self.counts["cost_added"] += cost
        return "Admitted", mine, victims

    def _victim(self, sample: list[int]) -> int:
        costs = self.ledger.costs
        if self.config.admission == "lru":
            return next(iter(costs))
        if self.config.victim == "exact":
            return self._coldest()
        keys = self.ledger.keys
        missing = min(self.config.samples - len(sample), len(keys))
        if missing > 0:  # distinct residents, though one may be in the sample already
            sample += [keys[i] for i in self.random.sample(range(len(keys)), missing)]
        best = min(range(len(sample)), key=lambda i: self.frequency.estimate(sample[i]))
        victim = sample[best]
        sample[best] = sample[-1]
        sample.pop()
        return victim

    def _coldest(self) -> int:
        """The resident of least estimate, then of least key, from a heap.  Between ages estimates only grow, so a stale entry is never too high."""
        if self.coldest_age != self.frequency.age:
            self.coldest = [(self.frequency.estimate(k), k) for k in self.ledger.costs]
            heapq.heapify(self.coldest)
            self.coldest_age = self.frequency.age
        while True:
            noted, key = self.coldest[0]
            if key not in self.ledger.costs:
                heapq.heappop(self.coldest)
            elif (now := self.frequency.estimate(key)) != noted:
                heapq.heapreplace(self.coldest, (now, key))
            else:
                return key

    # --- bookkeeping

    def _unledger(self, key: int) -> int | None:
        cost = self.ledger.take(key)
        if cost is not None:
            self.counts["keys_evicted"] += 1
            self.counts["cost_evicted"] += cost
        return cost

    def _bucket(self, key: int, row: Row) -> None:
        keys = self.buckets.get(row.bucket)
        if keys is not None:
            keys.add(key)
            return
        self.buckets[row.bucket] = {key}
        heapq.heappush(self.due, row.bucket)
        if len(self.due) > 2 * len(self.buckets) + 64:
            self.due = sorted(self.buckets)

    def _unbucket(self, key: int, row: Row) -> None:
        if row.ttl_us and (keys := self.buckets.get(row.bucket)) is not None:
            keys.discard(key)
            if not keys:
                del self.buckets[row.bucket]

    def _drop(self, key: int, seq: int | None, kind: str, now: int | None = None) -> None:
        """``now`` is given for evictions and sweeps alone, which end a life: whole seconds since admission."""
        row = self.store.pop(key)
        self._unbucket(key, row)
        if not self.keeps_events:
            return
        born = self.born.pop(key, None)
        life = (now - born) // 1_000_000 if now is not None and born is not None else None
        self.events.append((seq, kind, key, row.value, row.cost, life))

    def _decide(self, seq: int, key: int, cost: int, outcome: str, estimate: int, victims: list[tuple[int, int]]) -> None:
        if self.keeps_decisions:
            self.decisions.append((seq, key, outcome, cost, estimate, [{"key": k, "cost": c or 0} for k, c in victims], self.ledger.used, self.ledger.budget))


FIELDS = ("op", "seq", "ts_us", "client_id", "key_index", "key_conflict", "value", "cost", "ttl_us", "new_max_cost")
DECISIONS = "config_id string, cache_id string, seq long, key_index long, outcome string, cost long, inc_hits long, victims array<struct<key:long,cost:long>>, used long, max_cost long"
FEED = "config_id string, cache_id string, seq long, kind string, key_index long, value string, cost long, life_s long"
LEDGER = "config_id string, cache_id string, key_index long, cost long, stored boolean"
METRICS = "config_id string, cache_id string, " + ", ".join(f"{n} long" for n in NAMES) + ", used long, max_cost long"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The arguments of ``Kernel.step`` for each row."""

    def values(c: pa.Array) -> list:
        if c.null_count == len(c):
            return [None] * len(c)
        if pa.types.is_integer(c.type) and not c.null_count:
            return c.to_numpy().tolist()
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            d = c.dictionary_encode()
            words = [*d.dictionary.to_pylist(), None]
            return [words[i] for i in d.indices.fill_null(-1).to_numpy().tolist()]
        return c.to_pylist()

    return zip(*[values(batch.column(f)) for f in FIELDS])


def runs(batch: pa.RecordBatch, by: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The stretches of a sorted batch that are equal in ``by``, each with its values."""
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in by:
        codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy()
        change |= codes[1:] != codes[:-1]
    starts = [0, *(np.flatnonzero(change) + 1).tolist()] if batch.num_rows else []
    for a, z in zip(starts, [*starts[1:], batch.num_rows]):
        yield tuple(batch.column(c)[a].as_py() for c in by), batch.slice(a, z - a)


def _forgets(config: CacheConfig) -> bool:
    """Whether a clear leaves nothing of what came before but the budget and the ticks: no half-filled batch of reads, no state of a random sequence."""
    return config.freq_lag == "none" and (config.admission != "tinylfu" or config.victim == "exact")


def unwiped(log: DataFrame) -> DataFrame:
    """The log without what cannot reach the end of a replay (see ``_forgets``): the operations before each cache's last clear, which empties store,
    ledger, frequencies and counters.

    The last clears of at most ``CUTS`` caches, those with the most clears, are broadcast; the logs of further ones stay whole, which gives the same.
    Changes of the budget stay.  The others leave the times from which ticks go on, as two operations that do nothing else: the first of all and the
    latest one.
    """
    cuts = log.where("op = 'clear'").groupBy("cache_id").agg(F.max("seq").alias("_cut"), F.count("*").alias("_clears"))
    cuts = cuts.orderBy(F.desc("_clears"), "cache_id").limit(CUTS).drop("_clears")
    d = log.join(F.broadcast(cuts), "cache_id", "left")
    wiped = F.coalesce(F.col("seq") < F.col("_cut"), F.lit(False))
    times = d.where(wiped).groupBy("cache_id").agg(F.min("seq").alias("seq"), F.min_by("ts_us", "seq").alias("ts_us"), F.max_by("seq", "ts_us").alias("seq2"), F.max("ts_us").alias("ts2"))
    ticks = times.select("cache_id", F.expr("stack(2, seq, ts_us, seq2, ts2) AS (seq, ts_us)")).withColumn("op", F.lit("wait"))
    return d.where(~wiped | (F.col("op") == "update_max_cost")).drop("_cut").unionByName(ticks, allowMissingColumns=True)


def replay(log: DataFrame, configs: dict[str, CacheConfig] | CacheConfig, what: str = "metrics", accepts: Callable | None = None, coster: Callable | None = None) -> DataFrame:
    """Replay every cache of ``log`` under every configuration.

    Args:
        what: ``metrics`` (a row per cache), ``decisions``, ``feed`` or ``ledger`` (the residents at the end).
        accepts, coster: as in ``Kernel``.

    The log is given once per configuration, each (configuration, cache) is one group, and groups are sorted and streamed in their partition.  Metrics
    and residents depend on nothing that a clear has wiped, so what precedes a cache's last clear is not replayed for them.
    """
    if isinstance(configs, CacheConfig):
        configs = {"c": configs}
    short = {n: c for n, c in configs.items() if what in ("metrics", "ledger") and _forgets(c)}
    whole = {n: c for n, c in configs.items() if n not in short}
    if not short:
        return _replay(log, whole, what, accepts, coster)
    out = _replay(unwiped(log), short, what, accepts, coster)
    return out.unionByName(_replay(log, whole, what, accepts, coster)) if whole else out


def _replay(log: DataFrame, configs: dict[str, CacheConfig], what: str, accepts: Callable | None, coster: Callable | None) -> DataFrame:
    ddl = {"metrics": METRICS, "decisions": DECISIONS, "feed": FEED, "ledger": LEDGER}[what]
    schema, plain = _arrow(ddl), {k: asdict(c) for k, c in configs.items()}
    keep = {"decisions": ("decisions",), "feed": ("events",)}.get(what, ())
    if not (accepts or coster or what == "feed"):
        log = log.withColumn("value", F.lit(None).cast("string"))  # nothing looks at values
    names = F.array(*[F.lit(k) for k in sorted(configs)])
    # a number of partitions is given because else small groups, which are long work, are put together in one task
    parts = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * len(configs))
    groups = log.select(F.explode(names).alias("config_id"), "cache_id", *FIELDS).repartition(parts, "config_id", "cache_id").sortWithinPartitions("config_id", "cache_id", "seq")

    def rows_of(group: tuple[str, str], k: Kernel, last: bool) -> list[tuple]:
        if what == "decisions":
            out, k.decisions = [(*group, *d) for d in k.decisions], []
        elif what == "feed":
            out, k.events = [(*group, *e) for e in k.events], []
        elif not last:
            return []
        elif what == "ledger":
            out = [(*group, key, cost, key in k.store) for key, cost in k.ledger.costs.items()]
        else:
            out = [(*group, *[k.counts[n] for n in NAMES], k.ledger.used, k.ledger.budget)]
        return out

    def batches_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + ROWS]), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kernel = None, None
        for b in batches:
            for key, run_ in runs(b, ("config_id", "cache_id")):
                if key != group:
                    if kernel is not None:
                        kernel.finish()
                        yield from batches_of(rows_of(group, kernel, True))
                    group, kernel = key, Kernel(CacheConfig(**plain[key[0]]), accepts, coster, keep)
                for r in rows(run_):
                    kernel.step(*r)
                yield from batches_of(rows_of(group, kernel, False))
        if kernel is not None:
            kernel.finish()
            yield from batches_of(rows_of(group, kernel, True))

    return groups.mapInArrow(run, ddl)


def sweep(base: CacheConfig, budgets: list[int], policies: tuple[str, ...] = ("infinite", "lru", "tinylfu")) -> dict[str, CacheConfig]:
    """Configurations for every budget and policy, named by both."""
    return {f"{p}-{b}": replace(base, max_cost=b, admission=p) for p in policies for b in budgets}
