"""Schemas: inert trees of typed builders. Building one draws nothing and checks weights, ranges and items at once."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import EmptyItemsError, EmptyRangeError, IllegalOmittedOverrideError, InvalidOverrideValueError, PrototypePollutionError, UnknownKindError, UnknownOverrideFieldError, UnterminableRecursiveError
from ..functions.distributions import check_weights
from .bounds import MAX_TIME, Bound, assert_continuous, assert_discrete, epoch_bound, length_range, to_bound

MAX_NUMBER = 1.7976931348623157e308
MAX_SAFE = 2**53 - 1
RESERVED = ("__proto__", "constructor", "prototype")


class _Omitted:
    def __repr__(self) -> str:
        return "OMITTED"


OMITTED = _Omitted()


@dataclass(frozen=True)
class Schema:
    kind: str
    meta: dict = field(default_factory=dict, compare=False)
    produce: Callable | None = None
    returns: Any = None
    hints: dict = field(default_factory=dict)
    adaptations: dict = field(default_factory=dict)

    def as_(self, produce: Callable, returns=None, **hints) -> Schema:
        """A producer takes the node's place: called with a context, it returns a Column."""
        if self.kind in ("always", "null", "undefined", "opaque", "recursive", "self"):
            raise UnknownKindError(f"{self.kind} has no producer", kind=self.kind)
        return replace(self, produce=produce, returns=returns or self.returns, hints={**self.hints, **hints})

    def adapt(self, adapter, convert: Callable) -> Schema:
        """Replaces what `adapter` makes of this node; convert(schema, meta, before) gets the layer that it replaces."""
        return replace(self, adaptations={**self.adaptations, adapter.key: (*self.adaptations.get(adapter.key, ()), convert)})

    def weighted(self, **weights: float) -> Schema:
        """Merges weights of outcomes with the earlier ones."""
        names = OUTCOMES.get(self.kind)
        if names is None:
            raise UnknownKindError(f"{self.kind} has no outcomes", kind=self.kind)
        if unknown := set(weights) - set(names):
            raise UnknownKindError(f"{self.kind} has no outcome {sorted(unknown)}", kind=self.kind)
        merged = {**self.meta["weights"], **weights}
        check_weights([merged[n] for n in names], self.kind)
        return replace(self, meta={**self.meta, "weights": merged})

    # objects
    def extend(self, more) -> Schema:
        """Shallow: a field of the same name is replaced whole."""
        fields = more(self.meta["fields"]) if callable(more) else more
        return replace(self, meta={**self.meta, "fields": {**self.meta["fields"], **check_fields({k: to_schema(v) for k, v in fields.items()})}}, produce=None)

    def refine(self, more) -> Schema:
        """Adds fields computed from the object's own."""
        fields = more(self.meta["fields"]) if callable(more) else more
        return replace(self, meta={**self.meta, "fields": {**self.meta["fields"], **check_fields(fields)}}, produce=None)

    def override(self, values: dict) -> Schema:
        """Pins fields to values; nested objects merge."""
        check_overrides(self, values)
        return replace(self, meta={**self.meta, "fixed": deep_merge(self.meta.get("fixed", {}), values)}, produce=None)


OUTCOMES = {
    "boolean": ("true", "false"), "nullable": ("null", "value"), "undefinable": ("undefined", "value"), "nullish": ("null", "undefined", "value"),
    "omittable": ("omitted", "value"), "optional": ("omitted", "undefined", "value"),
}


def check_fields(fields: dict) -> dict:
    for name in fields:
        if name in RESERVED:
            raise PrototypePollutionError(f"{name} is reserved", field=name)
    return fields


@dataclass(frozen=True)
class Whole:
    value: dict


def whole_value(value: dict) -> Whole:
    """Marks a value that takes its place whole where dictionaries are merged."""
    return Whole(value)


def deep_merge(a: dict, b: dict) -> dict:
    def merged(k, v):
        if isinstance(v, Whole):
            return v.value
        return deep_merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v

    return {**a, **{k: merged(k, v) for k, v in b.items()}}


def to_schema(x) -> Schema:
    """A schema, builder or built maker as inert data."""
    if isinstance(x, Schema):
        return x
    inner = getattr(x, "schema", None)
    if isinstance(inner, Schema):
        return inner
    raise UnknownKindError(f"{x!r} is no schema", kind=repr(x))


_SHAPES: dict[str, Callable[[Any], bool]] = {
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "sequence": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "bigint": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "string": lambda v: isinstance(v, str), "symbol": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool),
    "date": lambda v: hasattr(v, "year") or (isinstance(v, int) and abs(v) <= MAX_TIME),
    "null": lambda v: v is None, "undefined": lambda v: v is None,
    "array": lambda v: isinstance(v, (list, tuple)), "tuple": lambda v: isinstance(v, (list, tuple)),
    "object": lambda v: isinstance(v, dict), "record": lambda v: isinstance(v, dict),
}


def violates_kind(kind: str, value) -> bool:
    """A coarse check of shape; kinds that may hold anything never violate."""
    from pyspark.sql import Column

    return not isinstance(value, Column) and kind in _SHAPES and not _SHAPES[kind](value)


def check_overrides(schema: Schema, values: dict) -> None:
    for name, value in values.items():
        if name in RESERVED:
            raise PrototypePollutionError(f"{name} is reserved", field=name)
        if name not in schema.meta["fields"]:
            raise UnknownOverrideFieldError(f"there is no field {name}", field=name)
        check_override(name, schema.meta["fields"][name], value)


def check_override(name: str, s: Schema, value) -> None:
    bad = InvalidOverrideValueError(f"{name}: {value!r} isn't a {s.kind}", field=name, kind=s.kind)
    if s.kind == "object":
        if violates_kind("object", value) or value is OMITTED:
            raise bad
        if isinstance(value, dict):
            check_overrides(s, value)
    elif s.kind in ("omittable", "optional"):
        if value is not OMITTED and not (s.kind == "optional" and value is None):
            check_override(name, s.meta["inner"], value)
    elif s.kind in ("undefinable", "nullable", "nullish"):
        if value is OMITTED:
            if s.meta["inner"].kind in _SHAPES:
                raise bad
        elif value is not None:
            check_override(name, s.meta["inner"], value)
    elif value is OMITTED:
        raise IllegalOmittedOverrideError(f"{name} can't be omitted", field=name)
    elif violates_kind(s.kind, value):
        raise bad


# ---- builders


class _Number:
    def __call__(self) -> Schema:
        return Schema("number", {"low": Bound(-MAX_NUMBER), "high": Bound(MAX_NUMBER), "distribution": None})

    def whereby(self, min=None, max=None, distribution=None) -> Schema:
        low, high = to_bound(-MAX_NUMBER if min is None else min), to_bound(MAX_NUMBER if max is None else max)
        assert_continuous(low, high)
        return Schema("number", {"low": low, "high": high, "distribution": distribution})

    @property
    def integer(self) -> _Integer:
        return _Integer()


class _Integer:
    def __call__(self) -> Schema:
        return self.whereby()

    def whereby(self, min=None, max=None, distribution=None) -> Schema:
        low, high = assert_discrete(to_bound(-MAX_SAFE if min is None else min), to_bound(MAX_SAFE if max is None else max))
        return Schema("integer", {"low": low, "high": high, "distribution": distribution})

    def sequence(self) -> Schema:
        return Schema("sequence")

    @property
    def big(self) -> _BigInt:
        return _BigInt()


class _BigInt:
    def whereby(self, max, min=None) -> Schema:
        high = to_bound(max)
        low, high = assert_discrete(to_bound(-high.value if min is None else min), high)
        return Schema("bigint", {"low": low, "high": high})

    def as_(self, produce, returns=None) -> Schema:
        return Schema("bigint", {"low": 0, "high": 0}, produce, returns)


class _Date:
    def __call__(self) -> Schema:
        return Schema("date", {"form": "any"})

    def whereby(self, min, max, distribution=None) -> Schema:
        low, high = assert_discrete(epoch_bound(min), epoch_bound(max))
        return Schema("date", {"form": "range", "low": low, "high": high, "distribution": distribution})

    def past(self, min=None) -> Schema:
        return Schema("date", {"form": "past", "low": epoch_bound(min)})

    def future(self, max=None) -> Schema:
        return Schema("date", {"form": "future", "high": epoch_bound(max)})


# fixed values: code point ranges of the character classes
LOWERCASE, UPPERCASE, DIGIT = ((97, 122),), ((65, 90),), ((48, 57),)
SYMBOL, SPACE = ((33, 47), (58, 64), (91, 96), (123, 126)), ((32, 32),)
SCALARS = ((0, 0xD7FF), (0xE000, 0x10FFFF))
BMP = ((0, 0xD7FF), (0xE000, 0xFFFF))
ASCII = ((0, 127),)
CLASSES = {"lowercase": LOWERCASE, "uppercase": UPPERCASE, "digit": DIGIT, "symbol": SYMBOL, "space": SPACE, "scalars": SCALARS, "bmp": BMP, "ascii": ASCII}


class _String:
    def whereby(self, length, composition=None) -> Schema:
        """composition: weights by class name or by tuple of (from, to) ranges; unset: all Unicode scalars."""
        low, high = length_range(length)
        parts = [(1.0, SCALARS)]
        if composition is not None:
            check_weights(list(composition.values()), "composition")
            parts = [(w, CLASSES[c] if isinstance(c, str) else tuple(c if isinstance(c[0], tuple) else (c,))) for c, w in composition.items() if w > 0]
        for _, ranges in parts:
            for a, b in ranges:
                if a > b:
                    raise EmptyRangeError("an empty range of characters", minimum=a, maximum=b)
                if a <= 0xDFFF and b >= 0xD800:
                    raise EmptyRangeError("lone surrogates can't be stored in a string", minimum=a, maximum=b)
        return Schema("string", {"low": low, "high": high, "parts": parts})

    def as_(self, produce, returns=None, **hints) -> Schema:
        return Schema("string", {"low": 0, "high": 0, "parts": []}, produce, returns, hints)


class _Boolean:
    def __call__(self) -> Schema:
        return Schema("boolean", {"weights": {"true": 1, "false": 1}})

    def weighted(self, **weights) -> Schema:
        return self().weighted(**weights)


class _Symbol:
    def __call__(self) -> Schema:
        return Schema("symbol", {"key": ""})

    def keyed(self, key: str) -> Schema:
        return Schema("symbol", {"key": key})


class _Pick:
    def __init__(self, kind: str):
        self.kind = kind

    def uniform(self, items) -> Schema:
        return self.weighted([(1, v) for v in items])

    def weighted(self, items) -> Schema:
        items = list(items)
        if not items:
            raise EmptyItemsError(f"{self.kind} has no items", kind=self.kind)
        check_weights([w for w, _ in items], self.kind)
        return Schema(self.kind, {"items": [(w, to_schema(v) if self.kind == "choice" else v) for w, v in items]})


class _Array:
    def __init__(self, inner):
        self.inner = to_schema(inner)

    def whereby(self, length) -> Schema:
        low, high = length_range(length)
        return Schema("array", {"inner": self.inner, "low": low, "high": high})

    def as_(self, produce, returns=None) -> Schema:
        return Schema("array", {"inner": self.inner, "low": 0, "high": 0}, produce, returns)


class _Record:
    def __init__(self, key, value):
        self.key, self.value = to_schema(key), to_schema(value)
        if self.key.kind not in ("string", "symbol", "enum", "always", "choice", "opaque"):
            raise UnknownKindError("a record's keys are strings or symbols", kind=self.key.kind)

    def whereby(self, size) -> Schema:
        low, high = length_range({"min": size.get("min_tried", size.get("min", 0)), "max": size["max"]} if isinstance(size, dict) else size)
        return Schema("record", {"key": self.key, "value": self.value, "low": low, "high": high})

    def as_(self, produce, returns=None) -> Schema:
        return Schema("record", {"key": self.key, "value": self.value, "low": 0, "high": 0}, produce, returns)


class _Recursive:
    def __init__(self, body: Callable[[Schema], Schema]):
        self.token = object()
        self.body = to_schema(body(Schema("self", {"token": self.token})))

    def whereby(self, depth, terminal=None) -> Schema:
        most = depth["max"] if isinstance(depth, dict) else depth
        if most < 0:
            raise EmptyRangeError("no depth below 0", maximum=most)
        end = to_schema(terminal) if terminal is not None else terminate(self.body)
        return Schema("recursive", {"body": self.body, "depth": most, "terminal": end, "token": self.token})


def contains_self(s: Schema) -> bool:
    return s.kind == "self" or (s.kind != "recursive" and any(contains_self(c) for c in children(s)))


def children(s: Schema) -> list[Schema]:
    m = s.meta
    if s.kind == "choice":
        return [c for _, c in m["items"]]
    if s.kind == "tuple":
        return list(m["slots"])
    if s.kind == "object":
        return list(m["fields"].values())
    return [m[k] for k in ("inner", "key", "value", "body", "source") if isinstance(m.get(k), Schema)]


def terminate(s: Schema) -> Schema:
    """The body with every self reference rewritten away."""
    if not contains_self(s):
        return s
    m = s.meta
    if s.kind in ("array", "record"):
        return replace(s, meta={**m, "low": 0, "high": 0})
    if s.kind == "choice":
        left = [(w, c) for w, c in m["items"] if not contains_self(c)]
        if not any(w > 0 for w, _ in left):
            raise UnterminableRecursiveError("every option refers to self")
        return replace(s, meta={**m, "items": left})
    if s.kind in ("nullable", "nullish"):
        return Schema("null")
    if s.kind == "undefinable":
        return Schema("undefined")
    if s.kind in ("omittable", "optional"):
        return replace(s, meta={**m, "weights": {**{n: 0 for n in OUTCOMES[s.kind]}, "omitted": 1}, "inner": Schema("null")})
    if s.kind == "object":
        return replace(s, meta={**m, "fields": {k: terminate(v) for k, v in m["fields"].items()}})
    if s.kind == "tuple":
        return replace(s, meta={**m, "slots": [terminate(v) for v in m["slots"]]})
    raise UnterminableRecursiveError(f"a {s.kind} that refers to self has no terminal form")


class _Compute:
    def __init__(self, source):
        self.source = to_schema(source)

    def as_(self, resolve: Callable) -> Schema:
        """resolve(fields) gets the columns of the fields made so far."""
        return Schema("compute", {"source": self.source, "resolve": resolve})


def _wrapper(kind: str) -> Callable[[Any], Schema]:
    return lambda inner: Schema(kind, {"inner": to_schema(inner), "weights": dict.fromkeys(OUTCOMES[kind], 1)})


def _object(fields: dict) -> Schema:
    return Schema("object", {"fields": check_fields({k: to_schema(v) for k, v in fields.items()}), "fixed": {}})


def _always(value) -> Schema:
    if isinstance(value, float) and math.isnan(value):
        raise UnknownKindError("NaN isn't a constant here", kind="always")
    return Schema("always", {"value": value})


def _opaque(produce: Callable, returns=None) -> Schema:
    return Schema("opaque", {}, produce, returns)


class Registry:
    """The namespace of builders; extend() adds to a copy, merging deeply."""

    def __init__(self, entries: dict):
        self._entries = entries

    def __getattr__(self, name: str):
        try:
            value = self.__dict__["_entries"][name]
        except KeyError:
            raise AttributeError(name) from None
        return Registry(value) if isinstance(value, dict) else value

    def __dir__(self):
        return sorted(self._entries)

    def extend(self, more) -> Registry:
        return Registry(deep_merge(self._entries, more(self) if callable(more) else more))


registry = Registry({
    "always": _always, "array": _Array, "bigint": _BigInt(), "boolean": _Boolean(), "choice": _Pick("choice"), "date": _Date(), "enum": _Pick("enum"),
    "null": Schema("null"), "nullable": _wrapper("nullable"), "nullish": _wrapper("nullish"), "number": _Number(), "object": _object, "omittable": _wrapper("omittable"),
    "optional": _wrapper("optional"), "opaque": _opaque, "record": _Record, "recursive": _Recursive, "string": _String(), "symbol": _Symbol(),
    "tuple": lambda slots: Schema("tuple", {"slots": [to_schema(s) for s in slots]}), "undefinable": _wrapper("undefinable"), "undefined": Schema("undefined"), "compute": _Compute,
})
