"""Adapters turn a schema into another description: Spark types, check constraints, JSON Schema."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DetachedSelfError, UnknownKindError, UnrepresentableRecordKeyError
from ..plans.bounds import MAX_TIME, Bound, epoch_ms
from ..plans.compiler import YEAR_1, YEAR_9999, Context, Trace, common_type, compile_node, literal
from ..plans.kinds import MAX_NUMBER, MAX_SAFE, Schema, contains_self, to_schema


class Adapter(Protocol):
    key: str

    def convert(self, schema: Schema, recurse, context: dict) -> Any: ...


def drive(adapter: Adapter, schema, context: dict | None = None) -> Any:
    """Adaptations of a node come before the adapter's own conversion; the last one wins and may ask for the layer below."""
    s, context = to_schema(schema), context or {}
    recurse = lambda c, ctx=None: drive(adapter, c, ctx if ctx is not None else context)
    layers = s.adaptations.get(adapter.key, ())

    def at(k: int):
        return layers[k - 1](s, s.meta, lambda: at(k - 1)) if k else adapter.convert(s, recurse, context)

    return at(len(layers))


OPEN = (-MAX_NUMBER, MAX_NUMBER, -MAX_SAFE, MAX_SAFE)  # ends that stand for none
UNDEFINED = {"not": {}, "$comment": "undefined"}  # no JSON value: the property is left out


def numeric_bound(b: Bound | None, low: bool, suffix: str = "") -> dict:
    if b is None or b.value in OPEN:
        return {}
    side = ("minimum" if low else "maximum") + suffix
    return {"exclusive" + side[0].upper() + side[1:] if b.exclusive else side: b.value}


def to_const(value) -> dict:
    if isinstance(value, dict):
        return {"type": "object", "properties": {k: to_const(v) for k, v in value.items()}, "required": list(value), "additionalProperties": False}
    if isinstance(value, (list, tuple)):
        return {"type": "array", "prefixItems": [to_const(v) for v in value], "minItems": len(value), "maxItems": len(value)}
    if hasattr(value, "year"):
        return {"const": datetime.fromtimestamp(epoch_ms(value) / 1000, timezone.utc).isoformat().replace("+00:00", "Z")}
    if value is not None and not isinstance(value, (bool, int, float, str)):
        return {"const": str(value)}
    return {"const": value}


@dataclass
class JsonSchema:
    """JSON Schema, draft 2020-12."""

    key: str = "json-schema"

    def convert(self, s: Schema, recurse, context: dict) -> dict:
        m = s.meta
        match s.kind:
            case "object":
                plain = {k: (c.meta["source"] if c.kind == "compute" else c) for k, c in m["fields"].items()}
                required = [k for k, c in plain.items() if c.kind not in ("omittable", "optional")]
                return {"type": "object", "properties": {k: recurse(c) for k, c in plain.items()}, "required": required, "additionalProperties": False}
            case "array":
                return {"type": "array", "items": recurse(m["inner"]), **({} if s.produce else {"minItems": m["low"], "maxItems": m["high"]})}
            case "tuple":
                return {"type": "array", "prefixItems": [recurse(c) for c in m["slots"]], "minItems": len(m["slots"]), "maxItems": len(m["slots"])}
            case "record":
                if m["key"].kind == "symbol":
                    raise UnrepresentableRecordKeyError("keys that are symbols have no JSON Schema")
                return {"type": "object", "propertyNames": recurse(m["key"]), "additionalProperties": recurse(m["value"]), **({} if s.produce else {"maxProperties": m["high"]})}
            case "recursive":
                name = f"r{len(context.get('defs', {}))}"
                inner = {**context, "self": {**context.get("self", {}), m["token"]: name}, "defs": {**context.get("defs", {}), name: 1}}
                return {"$defs": {name: recurse(m["body"], inner)}, "$ref": f"#/$defs/{name}"}
            case "self":
                if m["token"] not in context.get("self", {}):
                    raise DetachedSelfError("self outside of its recursion")
                return {"$ref": f"#/$defs/{context['self'][m['token']]}"}
            case "compute":
                return recurse(m["source"])
            case "omittable":
                return recurse(m["inner"])
            case "optional" | "undefinable":
                return {"anyOf": [recurse(m["inner"]), UNDEFINED]}
            case "nullable":
                return {"anyOf": [recurse(m["inner"]), {"type": "null"}]}
            case "nullish":
                return {"anyOf": [recurse(m["inner"]), {"type": "null"}, UNDEFINED]}
            case "always":
                return to_const(m["value"])
            case "enum":
                return {"anyOf": [to_const(v) for w, v in m["items"] if w > 0]}
            case "choice":
                return {"anyOf": [recurse(c) for w, c in m["items"] if w > 0]}
            case "number":
                return {"type": "number", **s.hints, **({} if s.produce else {**numeric_bound(m["low"], True), **numeric_bound(m["high"], False)})}
            case "integer" | "sequence" | "bigint":
                return {"type": "integer", **s.hints, **({} if s.produce or s.kind == "sequence" else {**numeric_bound(Bound(m["low"]), True), **numeric_bound(Bound(m["high"]), False)})}
            case "string":
                return {"type": "string", **s.hints, **({} if s.produce else {"minLength": m["low"], "maxLength": m["high"]})}
            case "date":
                low, high = (Bound(m["low"]), Bound(m["high"])) if m["form"] == "range" else (m.get("low"), m.get("high"))
                ends = {} if s.produce else {**numeric_bound(low, True, "Timestamp"), **numeric_bound(high, False, "Timestamp")}
                return {"type": "string", "format": "date-time", **ends}  # epoch milliseconds, as keywords of their own
            case "boolean":
                return {"type": "boolean"}
            case "symbol":
                return {"type": "string"}
            case "null":
                return {"type": "null"}
            case "undefined":
                return UNDEFINED
            case "opaque":
                return {}
        raise UnknownKindError(f"unknown kind {s.kind}", kind=s.kind)


def to_json_schema(schema) -> dict:
    return drive(JsonSchema(), schema)


@dataclass
class Constraints:
    """Predicates over columns that hold a made object: V(column) -> list of (name, Column). `clock` bounds past and future dates.

    Below an array or record the rules of its items are one predicate; a recursion is followed for as many levels as it has.
    """

    key: str = "constraints"

    def convert(self, s: Schema, recurse, context: dict) -> list[tuple[str, Column]]:
        m, c, name = s.meta, context["column"], context["name"]
        if s.produce is not None and s.kind != "object":
            return []
        here = lambda rule, ok: (f"{name}:{rule}", ok)

        def bounds(low: Bound, high: Bound, x: Column) -> list[tuple[str, Column]]:
            return [here("minimum", x > F.lit(low.value) if low.exclusive else x >= F.lit(low.value)), here("maximum", x < F.lit(high.value) if high.exclusive else x <= F.lit(high.value))]

        match s.kind:
            case "object":
                found = []
                for k, child in m["fields"].items():
                    child = child.meta["source"] if child.kind == "compute" else child
                    column = context["column"].getField(k) if context["column"] is not None else F.col(k)
                    if k in m.get("fixed", {}) and not isinstance(m["fixed"][k], dict):
                        found.append((f"{k}:const", column.eqNullSafe(literal(m["fixed"][k]))))
                        continue
                    if child.kind not in ("nullable", "undefinable", "nullish", "omittable", "optional", "null", "undefined", "opaque"):
                        found.append((f"{k}:present", column.isNotNull()))
                    found += recurse(child, {**context, "column": column, "name": k})
                return found
            case "nullable" | "undefinable" | "nullish" | "omittable" | "optional":
                return [(n, c.isNull() | ok) for n, ok in recurse(m["inner"], context)]
            case "number":
                return bounds(m["low"], m["high"], c)
            case "integer" | "bigint":
                rules = bounds(Bound(m["low"]), Bound(m["high"]), c)
                return rules + [here("integer", c == F.floor(c))] if s.kind == "integer" else rules
            case "date":
                low, high = (Bound(m["low"]), Bound(m["high"])) if m["form"] == "range" else (m.get("low") or Bound(-MAX_TIME), m.get("high") or Bound(MAX_TIME))
                clock = context.get("clock")
                if clock is not None and m["form"] in ("past", "future"):
                    low, high = (low, Bound(clock)) if m["form"] == "past" else (Bound(clock), high)
                first = low.value if m["form"] != "future" else YEAR_1
                last = high.value if m["form"] != "past" else YEAR_9999
                return bounds(low, high, F.unix_millis(c.cast("timestamp")) if first >= YEAR_1 and last <= YEAR_9999 else c)
            case "boolean":
                return [here("boolean", c.isin([n == "true" for n, w in m["weights"].items() if w > 0]))]
            case "symbol":
                return [here("symbol", c.startswith(f"Symbol({m['key']})"))]
            case "choice":
                if contains_self(s):
                    return []
                types = [compile_node(x, Context(Trace((), 0), F.lit("0"), F.lit(1))).dtype for _, x in m["items"]]
                mixed = common_type(types) is None  # kept as JSON text, of which each option reads its own type
                text = F.concat(F.lit('{"v":'), c, F.lit("}")) if mixed else None
                of = [F.from_json(text, T.StructType([T.StructField("v", t if not isinstance(t, T.NullType) else T.StringType())]))["v"] if mixed else c for t in types]
                options = [_all(recurse(x, {**context, "column": of[i]})) for i, (w, x) in enumerate(m["items"]) if w > 0]
                found = options[0]
                for o in options[1:]:
                    found = F.coalesce(found, F.lit(False)) | F.coalesce(o, F.lit(False))
                return [here("anyOf", found)]
            case "string":
                units = F.octet_length(F.encode(c, "UTF-16BE")) / 2
                return [here("minLength", units >= m["low"]), here("maxLength", units <= m["high"])]
            case "enum":
                return [here("enum", c.isin([v for w, v in m["items"] if w > 0]))]
            case "always":
                return [here("const", c.eqNullSafe(literal(m["value"])))]
            case "array":
                size = here("items", (F.size(c) >= m["low"]) & (F.size(c) <= m["high"]))
                return [size] if not m["high"] else [size, here("each", _each(c, m["inner"], recurse, context))]
            case "record":
                if not m["high"]:
                    return [here("size", F.size(c) == 0)]
                keys, values = _each(F.map_keys(c), m["key"], recurse, context), _each(F.map_values(c), m["value"], recurse, context)
                return [here("size", F.size(c) <= m["high"]), here("keys", keys), here("values", values)]
            case "recursive":
                return recurse(m["body"] if m["depth"] > 0 else m["terminal"], {**context, "self": {**context.get("self", {}), m["token"]: (s, 0)}})
            case "self":
                of, depth = context.get("self", {})[m["token"]] if m["token"] in context.get("self", {}) else _detached()
                body = of.meta["body"] if depth + 1 < of.meta["depth"] else of.meta["terminal"]
                return recurse(body, {**context, "self": {**context["self"], m["token"]: (of, depth + 1)}})
            case "tuple":
                return [r for i, x in enumerate(m["slots"]) for r in recurse(x, {**context, "column": c.getField(f"_{i}"), "name": f"{name}._{i}"})]
            case "null" | "undefined":
                return [here("null", c.isNull())]
        return []


def _all(rules: list[tuple[str, Column]]) -> Column:
    out = F.lit(True)
    for _, ok in rules:
        out = out & F.coalesce(ok, F.lit(False))
    return out


def _detached():
    raise DetachedSelfError("self outside of its recursion")


def _may_be_absent(s: Schema) -> bool:
    return s.kind in ("nullable", "undefinable", "nullish", "null", "undefined", "opaque", "compute") or (s.kind == "choice" and any(_may_be_absent(c) for _, c in s.meta["items"]))


def _tagged(s: Schema) -> bool:
    """Whether elements of this kind are stored with their presence."""
    return s.kind in ("undefinable", "nullish", "undefined", "omittable", "optional") or (s.kind == "nullable" and _tagged(s.meta["inner"])) or (s.kind == "choice" and any(_tagged(c) for _, c in s.meta["items"]))


def _each(array: Column, inner: Schema, recurse, context: dict) -> Column:
    """All elements conform; one that may not be null isn't."""

    def holds(x: Column) -> Column:
        x = x["value"] if _tagged(inner) else x
        ok = _all(recurse(inner, {**context, "column": x, "name": "element"}))
        return ok if _may_be_absent(inner) else ok & x.isNotNull()

    return F.forall(array, holds)


def to_constraints(schema, column: Column | None = None, clock=None) -> list[tuple[str, Column]]:
    """Named predicates over the columns of a frame (or a struct column); all hold for what the schema makes. With a clock, past and future dates (epoch milliseconds) are bounded by it."""
    return drive(Constraints(), schema, {"column": column, "name": "value", "clock": None if clock is None else epoch_ms(clock)})


def conforms(schema, column: Column | None = None, clock=None) -> Column:
    return _all(to_constraints(schema, column, clock))


def to_struct_type(maker) -> T.StructType:
    """The types of the columns that a maker makes."""
    return maker.data_type()


__all__ = ["MAX_SAFE", "MAX_TIME", "Adapter", "Constraints", "JsonSchema", "conforms", "drive", "numeric_bound", "to_const", "to_constraints", "to_json_schema", "to_struct_type"]
