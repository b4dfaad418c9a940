"""Configuration of a simulated cache."""

from __future__ import annotations

from dataclasses import dataclass

from cachelens import errors

DEFAULT_DRAIN_US, DEFAULT_CLEANUP_US = 500_000, 2_000_000


@dataclass(frozen=True)
class CacheConfig:
    """Budget, sketch width, buffers, tickers and modes of one cache.

    A zero interval takes its default.  ``victim`` is ``sampled`` (seeded) or ``exact`` (least estimate, then least key);
    lags are ``none`` or ``batch``; ``end_policy`` says whether batches still queued at the end of the log are processed.
    With ``queue_batches`` (writes) or ``read_queue_batches`` (reads) above 0, full batches of a lagged cache wait in a line of so many for a
    processor that takes ``service_us`` for each; a batch that finds the line full is dropped.  At 0, the default, nothing is dropped.
    """

    num_counters: int
    max_cost: int
    buffer_items: int = 64
    insert_stripe_high_water: int = 64
    drain_interval_us: int = DEFAULT_DRAIN_US
    cleanup_us: int = DEFAULT_CLEANUP_US
    ignore_internal_cost: bool = True
    item_size: int = 56
    samples: int = 5
    seed: int = 0
    metrics: bool = True
    victim: str = "exact"
    admission: str = "tinylfu"
    admission_lag: str = "none"
    freq_lag: str = "none"
    end_policy: str = "process"
    queue_batches: int = 0
    read_queue_batches: int = 0
    service_us: int = 0

    def __post_init__(self):
        if self.num_counters <= 0:
            raise errors.InvalidNumCounters(f"num_counters must be positive, not {self.num_counters}")
        if self.max_cost <= 0:
            raise errors.InvalidMaxCost(f"max_cost must be positive, not {self.max_cost}")
        if self.buffer_items <= 0 or self.insert_stripe_high_water <= 0:
            raise errors.InvalidBufferSize("buffers must hold at least one item")
        if self.samples <= 0:
            raise errors.InvalidSamples("samples must be positive")
        if self.queue_batches < 0 or self.read_queue_batches < 0:
            raise errors.InvalidBufferSize("lines must not be of negative length")
        if min(self.drain_interval_us, self.cleanup_us, self.service_us) < 0:
            raise errors.InvalidInterval("intervals must not be negative")
        for name, allowed in (("victim", ("sampled", "exact")), ("admission", ("tinylfu", "lru", "infinite")), ("admission_lag", ("none", "batch")), ("freq_lag", ("none", "batch")), ("end_policy", ("process", "rollback"))):
            if getattr(self, name) not in allowed:
                raise errors.CacheError(f"{name} must be one of {allowed}")
        if not self.drain_interval_us:
            object.__setattr__(self, "drain_interval_us", DEFAULT_DRAIN_US)
        if not self.cleanup_us:
            object.__setattr__(self, "cleanup_us", DEFAULT_CLEANUP_US)
