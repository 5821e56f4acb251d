"""Bounds: inclusive by default, exclusive where said."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EmptyRangeError

MAX_TIME = 8_640_000_000_000_000


@dataclass(frozen=True)
class Bound:
    value: float | int
    exclusive: bool = False


def exclusive(value) -> Bound:
    return Bound(value, True)


def to_bound(value) -> Bound | None:
    return value if value is None or isinstance(value, Bound) else Bound(value)


def epoch_ms(value) -> int:
    if isinstance(value, datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        delta = aware - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return (delta.days * 86_400_000_000 + delta.seconds * 1_000_000 + delta.microseconds) // 1000
    return int(value)


def epoch_bound(value) -> Bound | None:
    b = to_bound(value)
    return None if b is None else Bound(epoch_ms(b.value), b.exclusive)


def effective_discrete(low: Bound, high: Bound) -> tuple[int, int]:
    """The least and the greatest whole number within."""
    a, b = math.ceil(low.value), math.floor(high.value)
    return a + (low.exclusive and a == low.value), b - (high.exclusive and b == high.value)


def assert_discrete(low: Bound, high: Bound) -> tuple[int, int]:
    a, b = effective_discrete(low, high)
    if a > b:
        raise EmptyRangeError(f"no whole number from {low} to {high}", minimum=low, maximum=high)
    return a, b


def assert_continuous(low: Bound, high: Bound) -> None:
    if low.value > high.value or (low.value == high.value and (low.exclusive or high.exclusive)):
        raise EmptyRangeError(f"nothing lies from {low} to {high}", minimum=low, maximum=high)
    if low.exclusive and high.exclusive and math.nextafter(low.value, math.inf) >= high.value:
        raise EmptyRangeError(f"nothing lies from {low} to {high}", minimum=low, maximum=high)


def constrain_continuous(x: Column, low: Bound, high: Bound) -> Column:
    """A draw on an excluded end moves one step inwards."""
    if low.exclusive:
        x = F.when(x <= F.lit(float(low.value)), F.lit(math.nextafter(low.value, math.inf))).otherwise(x)
    if high.exclusive:
        x = F.when(x >= F.lit(float(high.value)), F.lit(math.nextafter(high.value, -math.inf))).otherwise(x)
    return x


def length_range(length) -> tuple[int, int]:
    """N, or (min, max), or {"min": .., "max": ..}."""
    if isinstance(length, int):
        low = high = length
    elif isinstance(length, dict):
        low, high = length.get("min", 0), length["max"]
    else:
        low, high = length
    if low < 0 or low > high:
        raise EmptyRangeError(f"no length from {low} to {high}", minimum=low, maximum=high)
    return low, high
