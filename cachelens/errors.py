"""Errors raised while a plan is built."""


class CacheError(ValueError):
    """Base of all configuration and input errors."""


class InvalidNumCounters(CacheError):
    """The number of counters must be positive."""


class InvalidMaxCost(CacheError):
    """The cost budget must be positive."""


class InvalidBufferSize(CacheError):
    """Read and insert buffers must hold at least one item."""


class InvalidCountMinWidth(CacheError):
    """A count-min sketch needs at least one counter."""


class InvalidSamples(CacheError):
    """An eviction sample needs at least one entry."""


class InvalidFalsePositiveRatio(CacheError):
    """A Bloom filter's ratio must be finite and positive."""


class InvalidInterval(CacheError):
    """Intervals must not be negative."""


class MissingColumn(CacheError):
    """An op log lacks a column that the operator needs."""


class InvalidHistogramBounds(CacheError):
    """Histogram bounds must rise."""


class LateOperation(CacheError):
    """A stream brought an operation after a later one of its cache had been carried out."""
