"""Enumeration of a schema's finite choices: widths on the driver, decoding as column expressions.

A node's axis is a product or cycle of its children's, or a sum over its outcomes.
`spark.range(width)` replaces the cartesian product: each row decodes its number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EnumerationIndexError, UnpinnableKindError
from ..functions.distributions import constant_array
from .kinds import OUTCOMES, Schema


@dataclass
class Axis:
    """width: how many values; names: outcomes of weighted nodes; starts: where each option's range begins."""

    width: int
    names: list[str] = field(default_factory=list)
    kids: dict = field(default_factory=dict)
    starts: list[int] = field(default_factory=list)
    mode: str = "leaf"
    order: list[int] | None = None  # a permutation of range(width), in cycles

    def at(self, i: int) -> int:
        """The place that row i takes on this axis."""
        if not 0 <= i < self.width:
            raise EnumerationIndexError(f"{i} isn't below {self.width}", index=i, width=self.width)
        return self.order[i] if self.order is not None else i

    def decode(self, index: Column) -> Decoder | None:
        return Decoder(self, index) if self.mode != "drawn" else None


class Decoder:
    """An axis at a column of indices, as the compiler asks for it."""

    def __init__(self, axis: Axis, index: Column):
        self.axis = axis
        if axis.order is not None:
            index = F.get(constant_array(axis.order), (index % F.lit(axis.width)).cast("int"))
        self.index, self.names = index, axis.names

    def pick(self, values: list[Column]) -> Column:
        starts = self.axis.starts
        if len(values) != len(starts):
            raise UnpinnableKindError(f"{len(values)} values for {len(starts)} options")
        out = None
        for k in range(len(values) - 1):
            when = self.index < F.lit(starts[k + 1])
            out = F.when(when, values[k]) if out is None else out.when(when, values[k])
        return values[-1] if out is None else out.otherwise(values[-1])

    def child(self, key) -> Decoder | None:
        kid = self.axis.kids.get(key)
        if kid is None:
            return None
        axis, at = kid
        if self.axis.mode == "product":
            return axis.decode((F.floor(self.index / F.lit(at))).cast("long") % F.lit(axis.width) if at > 1 else self.index % F.lit(axis.width))
        if self.axis.mode == "sum":
            return axis.decode(self.index - F.lit(at))
        return axis.decode(self.index)


def plan(s: Schema, cycle: bool = False, permute: Callable[[int], list[int]] | None = None) -> Axis:
    """Children first, so that permutations are drawn from the leaves up."""
    axis = _axis(s, cycle, permute)
    if cycle and axis.width > 1 and permute is not None and axis.mode != "drawn":
        axis.order = permute(axis.width)
    return axis


def _sum(options: list[tuple[str | int, Axis | None]], names: list[str]) -> Axis:
    starts, kids, run = [], {}, 0
    for key, axis in options:
        starts.append(run)
        if axis is not None:
            kids[key] = (axis, run)
        run += axis.width if axis is not None else 1
    return Axis(run, names, kids, starts, "sum")


def _axis(s: Schema, cycle: bool, permute) -> Axis:
    m = s.meta
    if s.produce is not None:
        return Axis(1, mode="drawn")
    if s.kind == "enum":
        live = sum(w > 0 for w, _ in m["items"])
        return Axis(live, starts=list(range(live)))
    if s.kind == "boolean":
        names = [n for n in OUTCOMES["boolean"] if m["weights"][n] > 0]
        return Axis(len(names), names, starts=list(range(len(names))))
    if s.kind == "choice":
        return _sum([(i, plan(c, cycle, permute)) for i, (w, c) in enumerate(m["items"]) if w > 0], [])
    if s.kind in OUTCOMES:
        names = [n for n in OUTCOMES[s.kind] if m["weights"][n] > 0]
        return _sum([(n, plan(m["inner"], cycle, permute) if n == "value" else None) for n in names], names)
    if s.kind in ("tuple", "object"):
        named = list(enumerate(m["slots"])) if s.kind == "tuple" else [(k, c) for k, c in m["fields"].items() if c.kind != "compute" and k not in m.get("fixed", {})]
        kids = [(k, plan(c, cycle, permute)) for k, c in named]
        if cycle:
            return Axis(max([1, *(a.width for _, a in kids)]), kids={k: (a, 0) for k, a in kids}, mode="cycle")
        out, stride = {}, 1
        for k, a in reversed(kids):  # the last child runs fastest
            out[k] = (a, stride)
            stride *= a.width
        return Axis(stride, kids=out, mode="product")
    return Axis(1, mode="drawn")
