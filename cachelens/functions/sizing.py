"""Sizes of sketches, computed on the driver."""

from __future__ import annotations

import math

from cachelens.errors import InvalidCountMinWidth, InvalidFalsePositiveRatio

MOST_BITS, MOST_PROBES, LEAST_BITS = 1 << 40, 64, 512


def next_power_of_two(n: int) -> int:
    """The least power of two that is at least n."""
    return 1 << max(0, n - 1).bit_length()


def bloom_shape(capacity: int, ratio: float) -> tuple[int, int]:
    """(exponent of the number of bits, number of probes) for a capacity and a false positive ratio; a ratio of 1 or more is a literal number of probes."""
    if not math.isfinite(ratio) or ratio <= 0:
        raise InvalidFalsePositiveRatio("the ratio must be finite and positive")
    n = max(1, capacity)
    if ratio >= 1:
        if ratio > MOST_PROBES:
            raise InvalidFalsePositiveRatio("probes out of range")
        bits, probes = n * ratio, int(ratio)
    else:
        bits = -n * math.log(ratio) / math.log(2) ** 2
        probes = math.ceil(math.log(2) * bits / n)
    if bits > MOST_BITS:
        raise InvalidFalsePositiveRatio("entries out of range")
    size = next_power_of_two(max(LEAST_BITS, math.ceil(bits)))
    return size.bit_length() - 1, max(1, min(MOST_PROBES, probes))


def bloom_bytes(exponent: int) -> int:
    """Memory of a filter: its 64-bit words and a fixed head of 32 bytes."""
    return (1 << exponent) // 64 * 8 + 32


def sketch_mask(counters: int) -> int:
    """The mask that takes a hash to its cell."""
    if counters < 1:
        raise InvalidCountMinWidth("a sketch needs at least one counter")
    return next_power_of_two(counters) - 1
