"""Instances: seed, clock, algorithm, attribution and limits; fork, wrap, make, enumerate."""

from __future__ import annotations

import json
import math
import os
import posixpath
import re
import secrets
import sys
import time
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import ClashingNameError, CombinatorialLimitExceededError, InvalidAttributionRootError, InvalidClockError, InvalidCombinatorialLimitError, TraceKindMismatchError, UnknownKindError
from ..functions.distributions import MANY, bounds_below, constant_array
from ..functions.draws import Algorithm, DriverStream, Stream, driver_draw, md5_draw, shuffled, to_algorithm
from ..plans.bounds import MAX_TIME, epoch_ms
from ..plans.compiler import Context, Out, Trace, WordProducer, check_size, check_types, compile_node, has_computed
from ..plans.enumeration import plan
from ..plans.kinds import MAX_SAFE, RESERVED, Schema, check_overrides, children, registry, to_schema

LIMIT = 1024
NULL_KEY = "\u2205"  # stands for a null key in a draw's name, so that null keys draw like any other
SEED_VARIABLES = ("TESSERAE_SEED", "SEED", "RANDOM_SEED")


@dataclass(frozen=True)
class Layered:
    """A seed that is appended to the one it meets."""

    parts: tuple[str, ...]


def layer(seed) -> Layered:
    return Layered(normalize_seed(seed))


def env_seed() -> str | None:
    return next((os.environ[v] for v in SEED_VARIABLES if os.environ.get(v)), None)


def random_seed() -> str:
    return str(secrets.randbits(32))


def normalize_seed(seed) -> tuple[str, ...]:
    if seed is None:
        found = env_seed()
        return (found,) if found else ()
    return (seed,) if isinstance(seed, str) else tuple(map(str, seed))


def derive_clock(seed: tuple[str, ...]) -> int:
    u = driver_draw(json.dumps([list(seed), "clock"], separators=(",", ":"), ensure_ascii=False))
    return math.trunc((u * 2 - 1) * MAX_TIME)


def resolve_clock(clock, seed: tuple[str, ...]) -> int:
    if clock is None:
        return int(time.time() * 1000)
    if clock == "seeded":
        return derive_clock(seed)
    ms = epoch_ms(clock)
    if abs(ms) > MAX_TIME:
        raise InvalidClockError("a clock beyond the range of dates", clock=ms)
    return ms


def normalize_location(path: str) -> str:
    path = (unquote(path[7:]) if path.startswith("file://") else path).replace("\\", "/")
    return path[0].upper() + path[1:] if re.match(r"^[a-z]:/", path) else path


def relativize(root: str, file: str) -> str:
    """The file as seen from root, with .. where it lies outside."""
    return posixpath.relpath(normalize_location(file), normalize_location(root))


def caller_file() -> str:
    """The nearest file on the stack outside of this package."""
    home, frame = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), sys._getframe(1)
    while frame.f_back and os.path.abspath(frame.f_code.co_filename).startswith(home + os.sep):
        frame = frame.f_back
    return os.path.abspath(frame.f_code.co_filename)


@dataclass(frozen=True)
class Config:
    seed: tuple[str, ...]
    clock: int
    algorithm: Algorithm
    root: str | None  # attribution: None for none, else the folder that files are relative to
    limit: int


_UNSET = object()


def _limit(limits) -> int:
    n = (limits or {}).get("combinatorial", LIMIT)
    if isinstance(n, bool) or not isinstance(n, int) or not 0 < n <= MAX_SAFE:
        raise InvalidCombinatorialLimitError(f"{n!r} isn't a positive whole number", limit=n)
    return n


def overlay(base: Config | None, seed=_UNSET, clock=_UNSET, algorithm=_UNSET, attribution=_UNSET, limits=_UNSET) -> Config:
    """Field by field: given, else inherited, else default."""
    if isinstance(seed, Layered):
        parts = (base.seed if base else ()) + seed.parts
    else:
        parts = base.seed if seed is _UNSET and base else normalize_seed(None if seed is _UNSET else seed)
    now = base.clock if clock is _UNSET and base else resolve_clock(None if clock is _UNSET else clock, parts)
    if algorithm is _UNSET:
        draw = base.algorithm if base else md5_draw
    else:
        draw = to_algorithm(algorithm)
    if attribution is _UNSET and base:
        root = base.root
    elif attribution in (None, "none"):
        root = None
    elif attribution in (_UNSET, "call site"):
        root = os.path.dirname(caller_file())
    else:
        root = normalize_location(attribution)
        if not posixpath.isabs(root) and not re.match(r"^[A-Z]:/", root):
            raise InvalidAttributionRootError(f"{attribution!r} isn't absolute", root=attribution)
    return Config(parts, now, draw, root, base.limit if limits is _UNSET and base else _limit(None if limits is _UNSET else limits))


class _Source:
    """A configuration and the numbers of constructions, by file."""

    def __init__(self, config: Config):
        self.config, self.counts = config, {}

    def ordinal(self, file: str | None) -> int:
        self.counts[file] = n = self.counts.get(file, -1) + 1
        return n


_frames: ContextVar[tuple[tuple[object, _Source], ...]] = ContextVar("tesserae_frames", default=())


class Maker:
    """A built schema: make(n), make_onto(df, key).

    A construction's stream is that of its file and its number among the file's constructions, unless a seed is given.
    Pins take the place of what would be found: file (which keeps its own count), ordinal, clock, path; with root, file and ordinal are
    taken as they stand. kind must be the schema's. A trace pins all.
    """

    def __init__(self, instance: Instance, schema, seed=None, clock=None, trace: Trace | None = None, *, root: str | None = None, file: str | None = None, path=(), kind: str | None = None, ordinal: int | None = None):
        self.schema = to_schema(schema)
        self.instance = instance
        if trace is not None:
            seed, clock, root, file, path, kind, ordinal = trace.seed, trace.clock, trace.root, trace.file, trace.path, trace.kind, trace.ordinal
        if kind not in (None, self.schema.kind):
            raise TraceKindMismatchError(f"the trace is of a {kind}, the schema a {self.schema.kind}", expected=self.schema.kind, received=kind)
        source = instance._active()
        config = source.config
        if isinstance(seed, Layered):
            parts = config.seed + seed.parts
        else:
            parts = normalize_seed(seed) if seed or trace is not None else config.seed or (random_seed(),)
        now = config.clock if clock is None else resolve_clock(clock, parts)
        place = root or ("unattributed" if seed else "attributed")
        if root is None and file is None and place == "attributed" and config.root is not None:
            file = relativize(config.root, caller_file())
        if root is None and ordinal is None and place == "attributed":
            ordinal = source.ordinal(file)
        self.trace = Trace(parts, now, place, file, tuple(path), self.schema.kind, ordinal)
        self.algorithm = config.algorithm

    @property
    def meta(self) -> dict:
        return self.schema.meta

    @property
    def children(self) -> dict[str, Maker]:
        """Makers of the nodes below, each by its step of the path. What stands in an array or record draws by the row's ordinal, a dot and its index."""
        m = self.schema.meta
        steps = {"array": {"element": "inner"}, "record": {"key": "key", "value": "value"}}.get(self.schema.kind, {"definition": "inner"} if "inner" in m else {})
        named = m["fields"].items() if self.schema.kind == "object" else [(step, m[name]) for step, name in steps.items()]
        if self.schema.kind in ("choice", "tuple"):
            named = [(str(i), c) for i, c in enumerate(children(self.schema))]
        return {k: Maker(self.instance, c, trace=replace(self.trace, path=(*self.trace.path, k), kind=c.kind)) for k, c in named}

    def compile(self, ordinal: Column, sequence: Column | None = None, overrides: dict | None = None, pin=None, validate: bool = True, raw: bool = False) -> Out:
        schema = self.schema
        if overrides:
            if schema.kind != "object":
                raise UnknownKindError("only objects take overrides", kind=schema.kind)
            if validate:
                check_overrides(schema, {k: v for k, v in overrides.items() if not isinstance(v, Column)})
            known = {k: v for k, v in overrides.items() if k in schema.meta["fields"] and k not in RESERVED}
            schema = replace(schema, meta={**schema.meta, "fixed": {**schema.meta.get("fixed", {}), **known}}, produce=schema.produce)
        check_size(schema)
        return compile_node(schema, Context(replace(self.trace, kind=None), _ordinal_text(ordinal), sequence, self.algorithm, raw=raw), pin)

    def _select(self, df: DataFrame, kept: list[str], compiled) -> DataFrame:
        """df with its kept columns and those that compiled(raw) makes; the types of computed fields are checked on the analysed plan."""
        out = compiled(False)
        columns = self.columns(out)
        made = df.select(*[F.col(f"`{c}`") for c in kept], *columns)
        names = made.columns
        if twice := sorted({c for c in names if names.count(c) > 1}):
            raise ClashingNameError(f"two columns of the name {', '.join(twice)}; rename the key or leave it out with keep=[]", names=twice)
        if has_computed(self.schema) and self.schema.produce is None:
            raw = df.select(*self.columns(compiled(True))).schema
            wanted = T.StructType(made.schema.fields[len(kept) :])
            inside = (raw, wanted) if self.schema.kind == "object" else (raw["value"].dataType, wanted["value"].dataType)
            check_types(self.schema, *inside)
        return made

    def columns(self, out: Out) -> list[Column]:
        if out.fields is None:
            extra = [out.presence.alias("value__presence")] if out.presence is not None else []
            return [(out.value.cast("string") if isinstance(out.dtype, T.NullType) else out.value).alias("value"), *extra]
        columns = []
        for name, o in out.fields:
            columns.append((o.value.cast("string") if isinstance(o.dtype, T.NullType) else o.value).alias(name))
            if o.presence is not None:
                columns.append(o.presence.alias(f"{name}__presence"))
        return columns

    def data_type(self) -> T.StructType:
        return self.make(0).schema

    def make(self, n: int = 1, overrides: dict | None = None, partitions: int | None = None, validate: bool = True) -> DataFrame:
        """n rows, without a shuffle: row i is a function of i alone. With validate=False overrides go unchecked, and those of no field are ignored."""
        rows = self.instance.spark.range(0, n, 1, partitions) if partitions else self.instance.spark.range(n)
        return self.over(rows, "id", overrides, validate=validate)

    def over(self, rows: DataFrame, ordinal: str, overrides: dict | None = None, pin=None, validate: bool = True) -> DataFrame:
        """A row for each row of a frame whose only column is a dense ordinal from 0."""
        name = _fresh(["_row"], [ordinal, *self.names()])  # an alias of the same name would be read instead of the row's number
        row = F.col(name)
        return self._select(rows.toDF(name), [], lambda raw: self.compile(row, row + 1, overrides, pin, validate, raw))

    def make_onto(self, df: DataFrame, key: str, overrides: dict | None = None, keep: list[str] | None = None, validate: bool = True) -> DataFrame:
        """A row for each row of df, drawn by its key, which should be unique: rows of one key are alike, null keys too. `keep` names columns to keep, the key if unset.

        Rows are dealt over all cores first: a table of keys may be one small file, which one task would read, while making its rows is long work.
        """
        taken = [*df.columns, *self.names()]
        row, rank = _fresh(["_row", "_rank"], taken)
        sequence = None
        if _has_sequence(self.schema):
            df = with_dense_rank(df, key, rank)
            sequence = F.col(rank)
        df = dealt(df.withColumn(row, _ordinal_text(F.col(f"`{key}`"))))  # a column of its own, as every draw reads it
        kept = keep if keep is not None else [key]
        return self._select(df, kept, lambda raw: self.compile(F.col(row), sequence, overrides, None, validate, raw))

    def words_onto(self, df: DataFrame, key: str, field: str = "field", value: str = "value") -> DataFrame:
        """What make_onto() makes of an object whose fields are words of lists, turned: a row for each row of df and each field.

        The names of streams and the lists are data that one expression draws from; an expression for each field is more code than the JVM compiles well.
        """
        fields, fixed = self.schema.meta.get("fields", {}), self.schema.meta.get("fixed", {})
        if other := [k for k, s in fields.items() if not isinstance(s.produce, WordProducer) or k in fixed]:
            raise UnknownKindError(f"not drawn from a list of words: {', '.join(other)}", kind=fields[other[0]].kind)
        if not fields or self.schema.produce is not None:
            raise UnknownKindError("only objects that have fields can be turned", kind=self.schema.kind)
        row, list_ = _fresh(["_row", "_list"], [key, field, value])
        most, cut = max(len(s.produce.words) for s in fields.values()), self.algorithm.cut
        lists = [
            {"field": k, "prefix": replace(self.trace, path=(*self.trace.path, k), kind=s.kind).encode(), "words": list(s.produce.words), "cuts": [cut(i + 1, len(s.produce.words)) for i in range(len(s.produce.words))] if cut else []}
            for k, s in fields.items()
        ]
        table = F.from_json(F.lit(json.dumps(lists, ensure_ascii=False)), "array<struct<field:string,prefix:string,words:array<string>,cuts:array<string>>>")
        rows = dealt(df.select(F.col(f"`{key}`"), _ordinal_text(F.col(f"`{key}`")).alias(row)))
        each = rows.select(f"`{key}`", row, F.explode(table).alias(list_))
        at = F.col(list_)
        stream = Stream(at["prefix"], F.col(row), self.algorithm)
        if cut and most <= MANY:  # told from the digest as it is; of each list, the last cut is above all
            digest, word = stream.digest(0), F
            for i in range(most):
                word = word.when(digest < F.get(at["cuts"], F.lit(i)), F.get(at["words"], F.lit(i)))
        else:
            word = F.get(at["words"], F.floor(stream.u() * F.size(at["words"])).cast("int"))
        return each.select(f"`{key}`", at["field"].alias(field), word.alias(value))

    def names(self) -> list[str]:
        return [*self.schema.meta.get("fields", {})] if self.schema.kind == "object" else ["value"]


def _fresh(names: list[str], taken: list[str]):
    """The names, lengthened until none is taken; one alone as itself."""
    low = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n += "_"
        out.append(n)
    return out[0] if len(out) == 1 else out


def _ordinal_text(ordinal: Column) -> Column:
    return F.coalesce(ordinal.cast("string"), F.lit(NULL_KEY))


def dealt(df: DataFrame) -> DataFrame:
    """The rows in turn over at least two partitions a core; those of a stream as they come."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _has_sequence(s: Schema) -> bool:
    return s.kind == "sequence" or any(_has_sequence(c) for c in children(s))


ROWS_PER_BUCKET, MOST_BUCKETS, SAMPLED_PER_BUCKET = 1_000_000, 16_384, 16


def with_dense_rank(df: DataFrame, key: str, name: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds the row's number from 1 in the order of key (null first), of any type that sorts, without sorting everything in one task.

    A sample of keys, taken by their hash, cuts the rows into buckets of similar size, whose number follows the number of rows;
    at most MOST_BUCKETS * SAMPLED_PER_BUCKET keys or so and a count for each bucket come to the driver. Equal keys are numbered in any order.
    """
    value = F.hex(f"`{key}`") if df.schema[key].dataType == T.BinaryType() else F.col(f"`{key}`")
    rows = df.select(value.alias("k")).count()
    buckets = min(MOST_BUCKETS, max(8, -(-rows // rows_per_bucket)))
    share = max(1, rows // (buckets * SAMPLED_PER_BUCKET))
    picked = df.select(value.alias("k")).filter((F.pmod(F.xxhash64("k"), F.lit(share)) == 0) & F.col("k").isNotNull()).distinct()
    keys = sorted(r["k"] for r in picked.collect())
    bounds = sorted({keys[len(keys) * k // buckets] for k in range(1, buckets)}) if keys else []
    bucket, start = _fresh(["_bucket", "_start"], [*df.columns, name])
    dealt = df.withColumn(bucket, bounds_below(value, bounds))
    counts = {r[bucket]: r["count"] for r in dealt.groupBy(bucket).count().collect()}
    starts, run = [], 0
    for k in range(len(bounds) + 1):
        starts.append(run)
        run += counts.get(k, 0)
    offset = F.get(constant_array(starts), F.col(bucket)).cast("long")
    return dealt.withColumn(name, F.row_number().over(Window.partitionBy(bucket).orderBy(value)) + offset).drop(bucket)


class Instance:
    """An isolated world of builders and makers. Instances forked from one another share a stack of frames."""

    def __init__(self, spark: SparkSession, config: Config, types=None, lineage: object | None = None, source: _Source | None = None):
        self.spark, self._source = spark, source if source is not None else _Source(config)
        self.T = types if types is not None else registry
        self._lineage = lineage if lineage is not None else object()

    def _active(self) -> _Source:
        """The innermost frame of the lineage, or the instance's own."""
        return next((s for of, s in reversed(_frames.get()) if of is self._lineage), self._source)

    @property
    def seed(self) -> tuple[str, ...]:
        return self._source.config.seed

    @property
    def context(self) -> Config:
        return self._active().config

    def fork(self, types=None, **over) -> Instance:
        """An instance of its own, laid over this one's configuration, whatever frame is active."""
        return Instance(self.spark, overlay(self._source.config, **over), types if types is not None else self.T, self._lineage)

    @contextmanager
    def wrap(self, types=None, **over):
        """Within the block, all instances of the lineage build by the overlay, which lies over the innermost frame; yields an instance of the frame."""
        source = _Source(overlay(self._active().config, **over))
        token = _frames.set((*_frames.get(), (self._lineage, source)))
        try:
            yield Instance(self.spark, source.config, types if types is not None else self.T, self._lineage, source)
        finally:
            _frames.reset(token)

    def Maker(self, schema, **options) -> Maker:  # noqa: N802  the public name
        return Maker(self, schema, **options)

    def combinatorial(self, schema) -> DataFrame:
        """Every combination of the schema's finite choices, in mixed radix, the last field fastest."""
        schema, config = to_schema(schema), self._active().config
        axis = plan(schema)
        if axis.width > config.limit:
            raise CombinatorialLimitExceededError(f"{axis.width} combinations; the limit is {config.limit}", width=axis.width, limit=config.limit)
        return self._rows(schema, axis, "combinatorial")

    def coverage(self, schema) -> DataFrame:
        """As many rows as the widest axis; each axis in its own shuffled order, shorter ones repeated."""
        schema, config = to_schema(schema), self._active().config
        stream = DriverStream(Trace((*config.seed, "coverage", "order"), config.clock).encode())
        return self._rows(schema, plan(schema, True, lambda w: shuffled(list(range(w)), stream)), "coverage")

    def _rows(self, schema: Schema, axis, name: str) -> DataFrame:
        config = self._active().config
        made = Maker(self, schema, trace=Trace((*config.seed, name), config.clock, kind=schema.kind))
        row = _fresh(["_row"], made.names())
        return made._select(self.spark.range(axis.width).toDF(row), [], lambda raw: made.compile(F.col(row), F.col(row) + 1, pin=axis.decode(F.col(row)), raw=raw))


def initialize(spark: SparkSession, seed=None, clock=None, algorithm="md5", attribution="call site", limits=None, types=None) -> Instance:
    return Instance(spark, overlay(None, seed=seed, clock=clock, algorithm=algorithm, attribution=attribution, limits=limits), types)
