"""Counter-based uniform draws: each is a pure function of (trace, row ordinal, draw index).

A draw hashes `prefix#ordinal#k`, so a value never depends on partitions, on other
fields or on how many draws came before. 32 bits: `u * total < total` holds after rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296.0


@dataclass(frozen=True)
class Algorithm:
    """digest(key) is one hash, from which lane(hash, i) takes `lanes` independent draws.

    Of hashes that sort as their draw 0 does, cut(k, n) is what sorts after exactly those whose draw times n is below k, for 0 < k <= n.
    """

    digest: Callable[[Column], Column]
    lane: Callable[[Column, int | Column], Column]
    lanes: int = 1
    cut: Callable[[int, int], str] | None = None

    def __call__(self, key: Column) -> Column:
        return self.lane(self.digest(key), 0)


def to_algorithm(given) -> Algorithm:
    """A name, an Algorithm, or a function from key to a draw in [0, 1)."""
    if isinstance(given, str):
        return ALGORITHMS[given]
    return given if isinstance(given, Algorithm) else Algorithm(given, lambda u, i: u)


def _eight_digits(digest: Column, i: int | Column) -> Column:
    place = F.lit(8 * i + 1) if isinstance(i, int) else (i * 8 + 1).cast("int")
    return F.conv(F.substring(digest, place, F.lit(8)), 16, 10).cast("long").cast("double") / F.lit(SPAN)


def _digits_cut(k: int, n: int) -> str:
    """A digest with the same eight digits is the longer text, so it sorts after them; g after all digits."""
    return f"{-(-k * 2**32 // n):08x}" if k < n else "g"


def _half(digest: Column, i: int | Column) -> Column:
    high = F.shiftrightunsigned(digest, 32)
    low = digest.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return (F.when(i == 0, high).otherwise(low) if isinstance(i, Column) else (low if i else high)).cast("double") / F.lit(SPAN)


md5_draw = Algorithm(lambda key: F.md5(key.cast("binary")), _eight_digits, 4, _digits_cut)  # the default: also computable, bit by bit, by other SQL engines
xxhash_draw = Algorithm(lambda key: F.xxhash64(key), _half, 2)  # the fast path
ALGORITHMS: dict[str, Algorithm] = {"md5": md5_draw, "xxhash64": xxhash_draw}


def driver_draw(key: str) -> float:
    """md5_draw on the driver, for what is decided once: clocks and permutations."""
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / SPAN


class Stream:
    """Draws of one leaf. `key(k)` names a draw; `next()` is for producers and numbers them itself."""

    def __init__(self, prefix: str | Column, ordinal: Column, algorithm: Algorithm = md5_draw, sub: str | None = None):
        self.prefix, self.ordinal, self.algorithm, self.iterations = prefix, ordinal, algorithm, 0
        self.sub = sub

    def key(self, k: str | int | Column) -> Column:
        before = "#" if self.sub is None else f"#{self.sub}."
        end = [F.lit(before), k.cast("string")] if isinstance(k, Column) else [F.lit(f"{before}{k}")]
        start = [self.prefix, F.lit("#")] if isinstance(self.prefix, Column) else [F.lit(self.prefix + "#")]
        return F.concat(*start, self.ordinal, *end)

    def u(self, k: str | int | Column = 0) -> Column:
        return self.algorithm(self.key(k))

    def digest(self, k: str | int | Column) -> Column:
        """For several draws: lanes of algorithm.lane()."""
        return self.algorithm.digest(self.key(k))

    def under(self, sub: str) -> Stream:
        return Stream(self.prefix, self.ordinal, self.algorithm, sub if self.sub is None else f"{self.sub}.{sub}")

    def next(self) -> Column:
        self.iterations += 1
        return self.u(self.iterations - 1)


class DriverStream:
    """The same draws on the driver, in sequence."""

    def __init__(self, prefix: str):
        self.prefix, self.iterations = prefix, 0

    def next(self) -> float:
        self.iterations += 1
        return driver_draw(f"{self.prefix}#0#{self.iterations - 1}")


def shuffled(items: list, stream: DriverStream) -> list:
    """Fisher-Yates from the front: one draw for each place but the last."""
    out = list(items)
    for i in range(len(out) - 1):
        j = i + int(stream.next() * (len(out) - i))
        out[i], out[j] = out[j], out[i]
    return out


def shuffle_column(array: Column, stream: Stream) -> Column:
    """The array in the order of one draw for each element, ties by place."""
    tagged = F.transform(array, lambda x, i: F.struct(stream.u(i).alias("u"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda s: s["x"])


def sample_column(array: Column, stream: Stream) -> Column:
    return F.get(array, F.floor(stream.u() * F.size(array)).cast("int"))
