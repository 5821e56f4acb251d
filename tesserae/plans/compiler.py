"""From a schema tree to Catalyst column expressions over a row ordinal.

Every leaf draws from its own stream, whose prefix is the JSON of its trace: seed,
clock, root, file, path, kind and ordinal. Elements of arrays extend the row ordinal by
their index, so nested values depend on their place alone. Where a value may be absent,
a presence column says how: value, null, undefined or omitted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ComputeResultMismatchError, DetachedComputeError, DetachedSelfError, EmptyRangeError, MissingOrdinalError, PlanTooLargeError, UnknownKindError
from ..functions.distributions import MANY, constant_array, one_of, sampler, weighted, weighted_index
from ..functions.draws import Algorithm, Stream, md5_draw
from .bounds import MAX_TIME, constrain_continuous, epoch_ms
from .kinds import OMITTED, OUTCOMES, Schema, children, contains_self

MAX_NODES = 20_000
YEAR_1, YEAR_9999 = -62_135_596_800_000, 253_402_300_799_999


@dataclass(frozen=True)
class Trace:
    """The identity of a stream."""

    seed: tuple[str, ...]
    clock: int
    root: str = "unattributed"
    file: str | None = None
    path: tuple[str, ...] = ()
    kind: str | None = None
    ordinal: int | None = None

    def encode(self) -> str:
        return json.dumps([list(self.seed), self.clock, self.root, self.file, list(self.path), self.kind, self.ordinal], separators=(",", ":"), ensure_ascii=False)


@dataclass
class Out:
    value: Column
    dtype: T.DataType
    presence: Column | None = None
    fields: list[tuple[str, Out]] | None = None  # of objects
    undefined: bool = False  # whether it may be undefined or omitted, which a null alone can't tell


@dataclass
class ProduceContext:
    random: Stream
    clock: int


@dataclass(frozen=True)
class WordProducer:
    """Produces one of the words, all alike, by the stream's first draw."""

    words: tuple[str, ...]

    def __call__(self, context: ProduceContext) -> Column:
        return one_of(list(self.words), context.random.u())


@dataclass
class Context:
    trace: Trace
    ordinal: Column
    sequence: Column | None = None  # a dense number from 1, where one is known
    algorithm: Algorithm = md5_draw
    expansions: dict = field(default_factory=dict)
    raw: bool = False  # computed fields keep the type that their resolver gives

    def at(self, *path: str) -> Context:
        return replace(self, trace=replace(self.trace, path=(*self.trace.path, *path)))

    def stream(self, kind: str) -> Stream:
        return Stream(replace(self.trace, kind=kind).encode(), self.ordinal, self.algorithm)


def literal(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("long")
    return F.lit(value)


def type_of(value) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if hasattr(value, "year"):
        return T.TimestampType()
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, type_of(v)) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return T.ArrayType(type_of(value[0]) if value else T.NullType())
    raise UnknownKindError(f"no column type for {value!r}", kind=type(value).__name__)


def common_type(types: list[T.DataType]) -> T.DataType | None:
    """One type for all, or None: then values are kept as JSON text."""
    known = [t for t in types if not isinstance(t, T.NullType)]
    if not known:
        return T.NullType()
    if all(t == known[0] for t in known):
        return known[0]
    if all(isinstance(t, (T.LongType, T.DoubleType)) for t in known):
        return T.DoubleType()
    return None


def as_json(x: Column, dtype: T.DataType) -> Column:
    """JSON text of a value: the form of unions that have no common type."""
    if isinstance(dtype, T.NullType):
        return F.lit("null")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(x)
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r"^\{\"v\":(?s)(.*)\}$", 1)


def unify(outs: list[Out]) -> tuple[list[Column], T.DataType]:
    dtype = common_type([o.dtype for o in outs])
    if dtype is None:
        return [as_json(o.value, o.dtype) for o in outs], T.StringType()
    if isinstance(dtype, T.NullType):
        return [F.lit(None) for _ in outs], dtype
    return [o.value.cast(dtype) if o.dtype != dtype else o.value for o in outs], dtype


def plan_size(s: Schema) -> int:
    """How many nodes a schema unrolls to, without unrolling it: an expansion is counted once for each depth."""
    known: dict[tuple[int, int], int] = {}

    def expansion(of: Schema, depth: int, inside: dict) -> int:
        at = (id(of.meta["token"]), depth)
        if at not in known:
            body = of.meta["terminal"] if depth >= of.meta["depth"] else of.meta["body"]
            known[at] = size(body, {**inside, of.meta["token"]: (of, depth)})
        return known[at]

    def size(n: Schema, inside: dict) -> int:
        if n.kind == "recursive":
            return 1 + expansion(n, 0, inside)
        if n.kind == "self":
            of, depth = inside.get(n.meta["token"], (None, 0))
            return 1 if of is None else 1 + expansion(of, depth + 1, inside)
        if n.kind in ("array", "record") and not n.meta["high"]:
            return 1
        return 1 + sum(size(c, inside) for c in children(n))

    return size(s, {})


def check_size(s: Schema) -> None:
    if plan_size(s) > MAX_NODES:
        raise PlanTooLargeError(f"the schema unrolls to more than {MAX_NODES} nodes; lower its depth")


def compile_node(s: Schema, ctx: Context, pin=None) -> Out:
    """pin: an axis decoder (see enumeration) or None where the node is drawn."""
    if s.produce is not None and s.kind != "object":
        return _produced(s, ctx)
    try:
        make = _KINDS[s.kind]
    except KeyError:
        raise UnknownKindError(f"unknown kind {s.kind}", kind=s.kind) from None
    return make(s, ctx, pin)


def _produced(s: Schema, ctx: Context) -> Out:
    column = s.produce(ProduceContext(ctx.stream(s.kind), ctx.trace.clock))
    dtype = s.returns if s.returns is not None else _own_type(s)
    return Out(literal(column), T._parse_datatype_string(dtype) if isinstance(dtype, str) else dtype)


def _own_type(s: Schema) -> T.DataType:
    simple = {"number": T.DoubleType(), "integer": T.LongType(), "sequence": T.LongType(), "string": T.StringType(), "symbol": T.StringType(), "boolean": T.BooleanType(), "date": T.TimestampType(), "bigint": T.DecimalType(38, 0)}
    if s.kind in simple:
        return simple[s.kind]
    if s.kind == "opaque":
        raise UnknownKindError("an opaque producer needs returns=", kind="opaque")
    return compile_node(replace(s, produce=None), Context(Trace((), 0), F.lit("0"), F.lit(1))).dtype


def _number(s, ctx, pin):
    low, high = s.meta["low"], s.meta["high"]
    x = sampler(s.meta["distribution"], low.value, high.value, ctx.stream("number"))
    return Out(constrain_continuous(x, low, high), T.DoubleType())


def whole(distribution, low: int, high: int, stream: Stream) -> Column:
    x = F.floor(sampler(distribution, low, high + 1, stream))
    return F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), x.cast("long")))


def _integer(s, ctx, pin):
    return Out(whole(s.meta["distribution"], s.meta["low"], s.meta["high"], ctx.stream("number.integer")), T.LongType())


def _sequence(s, ctx, pin):
    if ctx.sequence is None:
        raise MissingOrdinalError("a sequence needs a dense ordinal: make(n), make_onto() a key, or a stream whose key is dense; and arrays and records around it need one length")
    return Out(ctx.sequence.cast("long"), T.LongType())


BIG = T.DecimalType(38, 0)
WIDE_TRIES = 16


def _bigint(s, ctx, pin):
    """Whole numbers of as many random bits as the span needs, drawn again while they are too great; those beyond a decimal are text."""
    low, high = s.meta["low"], s.meta["high"]
    span, stream = high - low + 1, ctx.stream("bigint")
    bits = (span - 1).bit_length()
    wide = bits > 120 or max(abs(low), abs(high)) >= 10**37
    sizes = [32] * (bits // 32) + ([bits % 32] if bits % 32 else [])  # of the chunks, the lowest first
    lanes = ctx.algorithm.lanes

    def chunks(attempt: Column) -> list[Column]:
        key = F.concat(F.lit("a"), attempt.cast("string"), F.lit("."))
        return [F.floor(ctx.algorithm.lane(stream.digest(F.concat(key, F.lit(str(i // lanes)))), i % lanes) * F.lit(float(1 << n))).cast("long") for i, n in enumerate(sizes)]

    if wide:
        @F.udf("string", useArrow=True)
        def add_up(tries):
            found = [sum(c << (32 * i) for i, c in enumerate(t)) for t in tries]
            return str(low + next((v for v in found if v < span), found[-1] % span))

        return Out(add_up(F.array(*[F.array(*chunks(F.lit(k))) for k in range(WIDE_TRIES)])), T.StringType())
    if not bits:
        return Out(F.lit(str(low)).cast(BIG), BIG)
    if bits <= 62:
        value = lambda a: sum((c * F.lit(1 << (32 * i)).cast("long") for i, c in enumerate(chunks(a))), F.lit(0).cast("long"))
        limit, none = F.lit(span).cast("long"), F.lit(None).cast("long")
    else:
        value = lambda a: sum((c.cast(T.DecimalType(10, 0)) * F.lit(str(1 << (32 * i))).cast(T.DecimalType(len(str(1 << (32 * i))), 0)) for i, c in enumerate(chunks(a))), F.lit(0).cast(BIG)).cast(BIG)
        limit, none = F.lit(str(span)).cast(BIG), F.lit(None).cast(BIG)
    if span == 1 << bits:
        found = value(F.lit(0))
    else:  # coalesce() stops at the first attempt that is small enough
        below = lambda x: F.get(F.transform(F.array(x), lambda v: F.when(v < limit, v)), F.lit(0))
        found = F.aggregate(F.sequence(F.lit(0), F.lit(63)), none, lambda acc, a: F.coalesce(acc, below(value(a))))
        found = F.coalesce(found, limit - limit)
    return Out((found.cast(BIG) + F.lit(str(low)).cast(BIG)).cast(BIG), BIG)


def _boolean(s, ctx, pin):
    w = s.meta["weights"]
    if pin is not None:
        return Out(pin.pick([F.lit(n == "true") for n in pin.names]), T.BooleanType())
    return Out(weighted([(w["true"], F.lit(True)), (w["false"], F.lit(False))], ctx.stream("boolean").u()), T.BooleanType())


def _date(s, ctx, pin):
    stream, m, clock = ctx.stream("date"), s.meta, ctx.trace.clock
    if m["form"] == "range":
        low, high = m["low"], m["high"]
        ms = whole(m["distribution"], low, high, stream)
    else:
        low, high = {"any": (-MAX_TIME, MAX_TIME), "past": (-MAX_TIME, clock), "future": (clock, MAX_TIME)}[m["form"]]
        if m["form"] == "past" and m["low"] is not None:
            low = m["low"].value + m["low"].exclusive
        if m["form"] == "future" and m["high"] is not None:
            high = m["high"].value - m["high"].exclusive
        if low > high:
            raise EmptyRangeError("no time lies in the range", minimum=low, maximum=high)
        u = stream.u()
        if m["form"] == "past" and m["low"] is None:
            ms = (F.lit(float(clock)) - u * F.lit(float(clock + MAX_TIME))).cast("long")
        elif m["form"] == "future" and m["high"] is None:
            ms = (F.lit(float(clock)) + u * F.lit(float(MAX_TIME - clock))).cast("long")
        elif m["form"] == "any":
            ms = ((F.lit(2.0) * u - F.lit(1.0)) * F.lit(float(MAX_TIME))).cast("long")
        else:
            ms = whole(None, low, high, stream)
    if low < YEAR_1 or high > YEAR_9999:
        return Out(ms, T.LongType())  # epoch milliseconds: such years have no timestamp outside of the JVM
    return Out(F.timestamp_millis(ms), T.TimestampType())


def code_point(x: Column, ascii_only: bool) -> Column:
    if ascii_only:
        return F.char(x)
    # a first U+FEFF is a byte order mark, which decoding drops; a second one is a character
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(x), 8, "0"))), "UTF-32")


def _from_ranges(ranges, u: Column) -> Column:
    """A code point, every one of the ranges alike."""
    total = sum(b - a + 1 for a, b in ranges)
    index = F.floor(u * F.lit(float(total))).cast("long")
    out, run = None, 0
    for a, b in ranges[:-1]:
        size = b - a + 1
        piece = index + F.lit(a - run)
        out = F.when(index < F.lit(run + size), piece) if out is None else out.when(index < F.lit(run + size), piece)
        run += size
    last = index + F.lit(ranges[-1][0] - run)
    return last if out is None else out.otherwise(last)


def _string(s, ctx, pin):
    low, high, parts, stream = s.meta["low"], s.meta["high"], s.meta["parts"], ctx.stream("string")
    length = whole(None, low, high, stream) if low < high else F.lit(low).cast("long")
    top = max((b for _, r in parts for _, b in r), default=0)
    indices = F.when(length > 0, F.sequence(F.lit(0).cast("long"), length - 1)).otherwise(F.array().cast("array<bigint>"))

    lane, lanes, need = ctx.algorithm.lane, ctx.algorithm.lanes, 1 if len(parts) == 1 else 2  # draws a character

    def character(which: Column | None, place: Column) -> Column:
        if which is None:
            return _from_ranges(parts[0][1], place)
        return weighted([(w, _from_ranges(r, place)) for w, r in parts], which)

    if top <= 0xFFFF:
        # a digest serves as many characters as it has draws for
        each = max(1, lanes // need)
        indices = F.when(length > 0, F.sequence(F.lit(0).cast("long"), F.floor((length - 1) / each).cast("long"))).otherwise(F.array().cast("array<bigint>"))

        def block(b: Column) -> Column:
            k = F.concat(F.lit("c"), b.cast("string"))
            if lanes < need:
                return code_point(character(stream.u(F.concat(k, F.lit(".s"))), stream.u(F.concat(k, F.lit(".r")))), top < 128)
            chars = lambda d: F.concat(*[code_point(character(None if need == 1 else lane(d, j * need), lane(d, j * need + need - 1)), top < 128) for j in range(each)])
            return F.get(F.transform(F.array(stream.digest(k)), chars), F.lit(0))

        return Out(F.substring(F.array_join(F.transform(indices, block), ""), F.lit(1), length.cast("int")), T.StringType())

    def point(i: Column) -> Column:
        k = F.concat(F.lit("c"), i.cast("string"))
        return character(None if need == 1 else stream.u(F.concat(k, F.lit(".s"))), stream.u(F.concat(k, F.lit(".r"))))

    # the length counts UTF-16 units: a character of two that doesn't fit the last one gives way to one of the BMP at a random place
    empty = F.struct(F.array().cast("array<string>").alias("t"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, i: Column) -> Column:
        cp = point(i)
        two = cp > F.lit(0xFFFF)
        k = F.concat(F.lit("c"), i.cast("string"))
        filler = code_point(_from_ranges(((0, 0xD7FF), (0xE000, 0xFFFF)), stream.u(F.concat(k, F.lit(".f")))), False)
        place = F.floor(stream.u(F.concat(k, F.lit(".p"))) * (F.size(a["t"]) + 1)).cast("int")
        spliced = F.concat(F.slice(a["t"], F.lit(1), place), F.array(filler), F.slice(a["t"], place + 1, F.size(a["t"])))
        appended = F.concat(a["t"], F.array(code_point(cp, False)))
        fits = ~two | (a["n"] + 2 <= length)
        return F.when(a["n"] >= length, a).otherwise(
            F.struct(F.when(fits, appended).otherwise(spliced).alias("t"), (a["n"] + F.when(two & fits, F.lit(2)).otherwise(F.lit(1))).cast("long").alias("n"))
        )

    return Out(F.aggregate(indices, empty, step, lambda a: F.array_join(a["t"], "")), T.StringType())


def _symbol(s, ctx, pin):
    path = ".".join(ctx.trace.path)
    return Out(F.concat(F.lit(f"Symbol({s.meta['key']})#{path}#"), ctx.ordinal), T.StringType())


def _null(s, ctx, pin):
    return Out(F.lit(None), T.NullType(), F.lit("null"))


def _undefined(s, ctx, pin):
    return Out(F.lit(None), T.NullType(), F.lit("undefined"), undefined=True)


def _always(s, ctx, pin):
    return Out(literal(s.meta["value"]), type_of(s.meta["value"]))


def _enum(s, ctx, pin):
    live = [(w, v) for w, v in s.meta["items"] if w > 0]
    plain = {type(v) for _, v in live}
    if len(live) > MANY and len(plain) == 1 and plain < {str, int, float, bool}:
        index = pin.index.cast("int") if pin is not None else weighted_index([w for w, _ in live], ctx.stream("enum").u())
        return Out(F.get(constant_array([v for _, v in live]), index), type_of(live[0][1]))
    values, dtype = unify([Out(literal(v), type_of(v)) for _, v in s.meta["items"]])
    if pin is not None:
        return Out(pin.pick([v for (w, _), v in zip(s.meta["items"], values, strict=True) if w > 0]), dtype)
    return Out(weighted([(w, v) for (w, _), v in zip(s.meta["items"], values, strict=True)], ctx.stream("enum").u()), dtype)


def _choice(s, ctx, pin):
    items = s.meta["items"]
    outs = [compile_node(c, ctx.at(str(i)), pin.child(i) if pin is not None else None) for i, (_, c) in enumerate(items)]
    values, dtype = unify(outs)
    pick = (lambda cs: pin.pick([c for c, (w, _) in zip(cs, items, strict=True) if w > 0])) if pin is not None else (lambda cs: weighted([(w, c) for (w, _), c in zip(items, cs, strict=True)], ctx.stream("choice").u()))
    presence = pick([o.presence if o.presence is not None else F.lit("value") for o in outs]) if any(o.presence is not None for o in outs) else None
    return Out(pick(values), dtype, presence, undefined=any(o.undefined for o in outs))


def _absent(s, ctx, pin):
    names, w = OUTCOMES[s.kind], s.meta["weights"]
    inner = compile_node(s.meta["inner"], ctx.at("definition"), pin.child("value") if pin is not None else None)
    none = F.lit(None) if isinstance(inner.dtype, T.NullType) else F.lit(None).cast(inner.dtype)
    if pin is not None:
        pick = lambda of: pin.pick([of(n) for n in pin.names])
    else:
        u = ctx.stream(s.kind).u()
        pick = lambda of: weighted([(w[n], of(n)) for n in names], u)
    value = pick(lambda n: inner.value if n == "value" else none)
    own = inner.presence if inner.presence is not None else F.lit("value")
    return Out(value, inner.dtype, pick(lambda n: own if n == "value" else F.lit(n)), undefined=s.kind != "nullable" or inner.undefined)


def _deeper(ctx: Context, suffix: Column, each: int | None = None) -> Context:
    """The context of an element; where every row has `each` of them, elements are numbered on from row to row."""
    sequence = None if ctx.sequence is None or each is None else (ctx.sequence.cast("long") - 1) * F.lit(each) + suffix + F.lit(1)
    return replace(ctx, ordinal=F.concat(ctx.ordinal, F.lit("."), suffix.cast("string")), sequence=sequence)


def _element(out: Out) -> tuple[Column, T.DataType]:
    """What stands in an array or map: where it may be undefined, a struct of the value and its presence."""
    value, dtype = (out.value.cast("string"), T.StringType()) if isinstance(out.dtype, T.NullType) else (out.value, out.dtype)
    if not out.undefined:
        return value, dtype
    return F.struct(value.alias("value"), out.presence.alias("presence")), T.StructType([T.StructField("value", dtype), T.StructField("presence", T.StringType())])


def _array(s, ctx, pin):
    low, high = s.meta["low"], s.meta["high"]
    if high == 0 and contains_self(s.meta["inner"]):
        return Out(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
    length = whole(None, low, high, ctx.stream("array")) if low < high else F.lit(low).cast("long")
    types: list[T.DataType] = []

    def element(i: Column) -> Column:
        value, dtype = _element(compile_node(s.meta["inner"], _deeper(ctx.at("element"), i, low if low == high else None)))
        types.append(dtype)
        return value

    indices = F.when(length > 0, F.sequence(F.lit(0).cast("long"), length - 1)).otherwise(F.array().cast("array<bigint>"))
    return Out(F.transform(indices, element), T.ArrayType(types[0]) if types else T.ArrayType(T.NullType()))


def _tuple(s, ctx, pin):
    outs = [(f"_{i}", compile_node(c, ctx.at(str(i)), pin.child(i) if pin is not None else None)) for i, c in enumerate(s.meta["slots"])]
    return _struct(outs)


def _struct(outs: list[tuple[str, Out]]) -> Out:
    columns, fields = [], []
    for name, o in outs:
        value = o.value.cast("string") if isinstance(o.dtype, T.NullType) else o.value
        columns.append(value.alias(name))
        fields.append(T.StructField(name, T.StringType() if isinstance(o.dtype, T.NullType) else o.dtype))
        if o.presence is not None:
            columns.append(o.presence.alias(f"{name}__presence"))
            fields.append(T.StructField(f"{name}__presence", T.StringType()))
    return Out(F.struct(*columns) if columns else F.struct(F.lit(None).alias("_")), T.StructType(fields), None, outs)


def _record(s, ctx, pin):
    low, high = s.meta["low"], s.meta["high"]
    if high == 0 and (contains_self(s.meta["key"]) or contains_self(s.meta["value"])):
        empty = T.MapType(T.StringType(), T.StringType())
        return Out(F.create_map().cast("map<string,string>"), empty)
    size = whole(None, low, high, ctx.stream("record")) if low < high else F.lit(low).cast("long")
    types: list[T.DataType] = []

    def pair(i: Column) -> Column:
        key = compile_node(s.meta["key"], _deeper(ctx.at("key"), i, low if low == high else None))
        value, dtype = _element(compile_node(s.meta["value"], _deeper(ctx.at("value"), i, low if low == high else None)))
        types.append(dtype)
        return F.struct(key.value.cast("string").alias("k"), i.alias("i"), value.alias("v"))

    indices = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1)).otherwise(F.array().cast("array<bigint>"))
    tries = F.transform(indices, pair)
    # of equal keys the last try stays; the tries are bound to a name, so that they are drawn once
    last = lambda t: F.filter(t, lambda x: ~F.exists(t, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    entries = F.get(F.transform(F.array(tries), lambda t: F.transform(last(t), lambda x: F.struct(x["k"], x["v"]))), F.lit(0))
    return Out(F.map_from_entries(entries), T.MapType(T.StringType(), types[0]))


def _recursive(s, ctx, pin):
    return _expand(s, ctx, 0)


def _expand(s: Schema, ctx: Context, depth: int) -> Out:
    body = s.meta["terminal"] if depth >= s.meta["depth"] else s.meta["body"]
    inside = replace(ctx, expansions={**ctx.expansions, s.meta["token"]: (s, depth)})
    return compile_node(body, inside.at(f"@{depth}"))


def _self(s, ctx, pin):
    if s.meta["token"] not in ctx.expansions:
        raise DetachedSelfError("self outside of its recursion")
    schema, depth = ctx.expansions[s.meta["token"]]
    return _expand(schema, ctx, depth + 1)


def _compute(s, ctx, pin):
    raise DetachedComputeError("a computed field needs an object around it")


def _object(s, ctx, pin, overrides: dict | None = None) -> Out:
    values = {**s.meta.get("fixed", {}), **(overrides or {})}
    for k, v in (overrides or {}).items():
        fixed = s.meta.get("fixed", {}).get(k)
        values[k] = {**fixed, **v} if isinstance(fixed, dict) and isinstance(v, dict) else v
    if s.produce is not None:
        made = _produced(s, ctx)
        outs = [(f.name, Out(made.value.getField(f.name), f.dataType)) for f in made.dtype.fields]
        return _struct([(n, _fixed(s.meta["fields"].get(n), o, values[n], ctx) if n in values else o) for n, o in outs])
    made: dict[str, Out] = {}
    later = []
    for name, c in s.meta["fields"].items():
        if c.kind == "compute" and name not in values:
            later.append((name, c))
            made[name] = None
        elif name in values:
            made[name] = _override(c, ctx.at(name), values[name])
        else:
            made[name] = compile_node(c, ctx.at(name), pin.child(name) if pin is not None else None)
    for name, c in later:
        value = c.meta["resolve"]({k: o.value for k, o in made.items() if o is not None})
        source = compile_node(c.meta["source"], ctx.at(name))
        if not isinstance(value, Column):
            check_computed(name, c, type_of(value), source.dtype)
            value = literal(value)
        made[name] = Out(value if ctx.raw else value.cast("string" if isinstance(source.dtype, T.NullType) else source.dtype), source.dtype)
    return _struct(list(made.items()))


def _shape(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    return "time" if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)) else dtype.typeName().partition("(")[0]


def check_computed(name: str, c: Schema, got: T.DataType, wanted: T.DataType) -> None:
    """A resolver's result has the shape of its source's kind; null fits any."""
    if not isinstance(got, T.NullType) and not isinstance(wanted, T.NullType) and _shape(got) != _shape(wanted):
        raise ComputeResultMismatchError(f"{name} is a {got.simpleString()}, not a {c.meta['source'].kind}", field=name, kind=c.meta["source"].kind)


def has_computed(s: Schema) -> bool:
    return s.kind == "compute" or any(has_computed(c) for c in children(s))


def check_types(s: Schema, got: T.DataType, wanted: T.DataType) -> None:
    """Compares what the computed fields of an analysed plan are with what they have to be; both types are of the schema's own tree."""
    if s.produce is not None:
        return
    if s.kind == "object" and isinstance(got, T.StructType):
        for name, c in s.meta["fields"].items():
            if name in got.names and name in wanted.names:
                if c.kind == "compute" and name not in s.meta.get("fixed", {}):
                    check_computed(name, c, got[name].dataType, wanted[name].dataType)
                elif c.kind != "compute":
                    check_types(c, got[name].dataType, wanted[name].dataType)
    elif s.kind == "tuple" and isinstance(got, T.StructType):
        for i, c in enumerate(s.meta["slots"]):
            check_types(c, got[f"_{i}"].dataType, wanted[f"_{i}"].dataType)
    elif s.kind == "array" and isinstance(got, T.ArrayType):
        check_types(s.meta["inner"], got.elementType, wanted.elementType)
    elif s.kind == "record" and isinstance(got, T.MapType):
        check_types(s.meta["value"], got.valueType, wanted.valueType)
    elif s.kind in OUTCOMES and "inner" in s.meta:
        check_types(s.meta["inner"], got, wanted)


def _override(c: Schema, ctx: Context, value) -> Out:
    if c.kind == "object" and isinstance(value, dict):
        return _object(c, ctx, None, value)
    return _fixed(c, compile_node(c.meta["source"] if c.kind == "compute" else c, ctx), value, ctx)


def _fixed(c: Schema | None, drawn: Out, value, ctx: Context) -> Out:
    shown = None
    if drawn.presence is not None:
        absent = "omitted" if value is OMITTED else "value" if value is not None or isinstance(value, Column) else {"undefinable": "undefined", "optional": "undefined"}.get(c.kind if c else "", "null")
        shown = F.lit(absent)
    if value is OMITTED or value is None:
        return Out(F.lit(None) if isinstance(drawn.dtype, T.NullType) else F.lit(None).cast(drawn.dtype), drawn.dtype, shown)
    if isinstance(value, Column):
        given = value.cast(drawn.dtype)
        shown = None if shown is None else F.when(given.isNotNull(), F.lit("value")).otherwise(drawn.presence)
        return Out(F.coalesce(given, drawn.value), drawn.dtype, shown, undefined=drawn.undefined)
    if isinstance(drawn.dtype, T.TimestampType) and isinstance(value, int):
        return Out(F.timestamp_millis(F.lit(epoch_ms(value))), drawn.dtype, shown)
    if isinstance(drawn.dtype, T.MapType):
        pairs = [x for k, v in value.items() for x in (F.lit(k), literal(v))]
        return Out(F.create_map(*pairs).cast(drawn.dtype), drawn.dtype, shown)
    return Out(literal(value).cast(drawn.dtype), drawn.dtype, shown)


_KINDS = {
    "number": _number, "integer": _integer, "sequence": _sequence, "bigint": _bigint, "boolean": _boolean, "date": _date, "string": _string, "symbol": _symbol,
    "null": _null, "undefined": _undefined, "always": _always, "enum": _enum, "choice": _choice, "nullable": _absent, "undefinable": _absent, "nullish": _absent,
    "omittable": _absent, "optional": _absent, "array": _array, "tuple": _tuple, "record": _record, "recursive": _recursive, "self": _self, "object": _object, "compute": _compute,
    "opaque": lambda s, ctx, pin: _produced(s, ctx),
}
