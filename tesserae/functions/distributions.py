"""Distributions over [low, high] by inverse CDF, as column expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidDistributionBoundError, InvalidWeightError, NoDrawableOutcomesError
from .draws import Stream


@dataclass(frozen=True)
class Uniform:
    pass


@dataclass(frozen=True)
class Skew:
    exponent: float


@dataclass(frozen=True)
class Triangular:
    mode: float | None = None


@dataclass(frozen=True)
class Normal:
    mean: float | None = None
    spread: float | None = None


@dataclass(frozen=True)
class Logarithmic:
    pass


@dataclass(frozen=True)
class Multi:
    components: tuple  # of (weight, distribution)


@dataclass(frozen=True)
class Custom:
    shape: Callable[[Column], Column]


def check_weights(weights, label: str = "") -> None:
    """Every weight finite and not negative, one positive at least."""
    for w in weights:
        if isinstance(w, bool) or not isinstance(w, (int, float)) or not math.isfinite(w) or w < 0:
            raise InvalidWeightError(f"{label}: {w!r} isn't a finite weight of at least 0", weight=w, label=label)
    if not any(w > 0 for w in weights):
        raise NoDrawableOutcomesError(f"{label}: no weight is above 0", label=label)


MANY = 16  # constants beyond which a pick is a look-up instead of a chain of cases


def weighted(outcomes: list[tuple[float, Column]], u: Column) -> Column:
    """Drops weights of zero; the first cumulative weight above u * total wins."""
    live = [(w, c) for w, c in outcomes if w > 0]
    total, run, out = float(sum(w for w, _ in live)), 0.0, None
    if len(live) == 1:
        return live[0][1]
    for w, c in live[:-1]:
        run += w
        when = u * F.lit(total) < F.lit(run)
        out = F.when(when, c) if out is None else out.when(when, c)
    return out.otherwise(live[-1][1])


def weighted_index(weights: list[float], u: Column) -> Column:
    """The number of the outcome that weighted() picks, for weights above 0, by halving an array of cumulative weights."""
    total = float(sum(weights))
    if all(w == weights[0] for w in weights):
        return F.least(F.lit(len(weights) - 1), F.floor(u * F.lit(float(len(weights)))).cast("int"))
    ends, run = [], 0.0
    for w in weights[:-1]:
        run += w
        ends.append(run)
    return bounds_below(u * F.lit(total), ends, True)


def bounds_below(value: Column, bounds: list, or_equal: bool = False) -> Column:
    """How many of the sorted bounds are below value (or equal to it; 0 for null), by halving: an expression as short for many bounds as for few."""
    if not bounds:
        return F.lit(0)
    array = constant_array(bounds)
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    middle = lambda s: ((s["low"] + s["high"]) / 2).cast("int")
    under = (lambda x: x <= value) if or_equal else (lambda x: x < value)
    below = lambda s: (s["low"] < s["high"]) & F.coalesce(under(F.get(array, middle(s))), F.lit(False))
    halved = lambda s, _: F.struct(F.when(below(s), middle(s) + 1).otherwise(s["low"]).alias("low"), F.when(below(s), s["high"]).otherwise(middle(s)).alias("high"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halved, lambda s: s["low"])


def constant_array(values: list) -> Column:
    """One literal for many plain values: text that constant folding parses once."""
    kind = {str: "string", int: "bigint", float: "double", bool: "boolean"}.get(type(values[0]))
    if kind is None or len(values) <= MANY or any(type(v) is not type(values[0]) for v in values):
        return F.lit(list(values))
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), f"array<{kind}>")


def one_of(words: list, u: Column) -> Column:
    return F.get(constant_array(words), F.floor(u * F.lit(float(len(words)))).cast("int"))


def at(u: Column, low: float, high: float) -> Column:
    """Never forms high - low, which could overflow."""
    return (F.lit(1.0) - u) * F.lit(float(low)) + u * F.lit(float(high))


def unit_position(x: float, low: float, high: float) -> float:
    if low == high:
        return 0.0
    half = high / 2 - low / 2
    return min(1.0, max(0.0, (x / 2 - low / 2) / half))


# fixed values: Abramowitz and Stegun 7.1.26
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
# fixed values: Acklam's approximation of the normal quantile
CENTRE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
CENTRE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
TAIL_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
TAIL = 0.02425


def normal_cdf(z: float) -> float:
    x = abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    poly = 0.0
    for c in reversed(ERF):
        poly = (poly + c) * t
    erf = 1 - poly * math.exp(-x * x)
    return 0.5 * (1 + math.copysign(erf, z))


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    q_low = F.sqrt(F.lit(-2.0) * F.log(p))
    q_high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    tail = lambda q: _horner(TAIL_C, q) / _horner((*TAIL_D, 1.0), q)
    q = p - F.lit(0.5)
    r = q * q
    centre = _horner(CENTRE_A, r) * q / _horner((*CENTRE_B, 1.0), r)
    return F.when(p < F.lit(TAIL), tail(q_low)).when(p > F.lit(1 - TAIL), -tail(q_high)).otherwise(centre)


def sampler(distribution, low: float, high: float, stream: Stream, k: str = "0") -> Column:
    """A draw from the distribution over [low, high]."""
    d = distribution or Uniform()
    low, high = float(low), float(high)
    if isinstance(d, Multi):
        check_weights([w for w, _ in d.components], "multi")
        return weighted([(w, sampler(c, low, high, stream, f"{k}.{i}.1")) for i, (w, c) in enumerate(d.components)], stream.u(k))
    u = stream.u(k)
    if isinstance(d, Uniform):
        return at(u, low, high)
    if isinstance(d, Skew):
        return at(F.pow(u, F.lit(float(d.exponent))), low, high)
    if isinstance(d, Triangular):
        split = 0.5 if d.mode is None else unit_position(d.mode, low, high)
        left = F.sqrt(u * F.lit(split))
        right = F.lit(1.0) - F.sqrt((F.lit(1.0) - u) * F.lit(1.0 - split))
        return at(F.when(u < F.lit(split), left).otherwise(right), low, high)
    if isinstance(d, Normal):
        mean = low / 2 + high / 2 if d.mean is None else d.mean
        spread = (high - low) / 6 if d.spread is None else d.spread
        if not spread > 0:
            return F.lit(min(high, max(low, mean)))
        a, b = normal_cdf((low - mean) / spread), normal_cdf((high - mean) / spread)
        if not a < b:
            return F.lit(low if mean < low else high)
        p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), at(u, a, b)))
        return F.least(F.lit(high), F.greatest(F.lit(low), F.lit(float(mean)) + F.lit(float(spread)) * normal_quantile(p)))
    if isinstance(d, Logarithmic):
        if not low > 0:
            raise InvalidDistributionBoundError("a logarithmic distribution needs a minimum above 0", minimum=low)
        return F.least(F.lit(high), F.lit(low) * F.pow(F.lit(high / low), u))
    if isinstance(d, Custom):
        return at(F.least(F.lit(1.0), F.greatest(F.lit(0.0), d.shape(u))), low, high)
    raise InvalidDistributionBoundError(f"unknown distribution {d!r}")
