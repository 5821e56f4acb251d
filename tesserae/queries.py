"""Queries over the test tables for every operator, and the same in SQL for another engine.

The SQL side repeats no compiled expression: it states each draw by its key,
`prefix#ordinal#index`, and each operator's rule by hand.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distributions import Custom, Logarithmic, Multi, Normal, Skew, Triangular, constant_array
from .functions.draws import Stream, shuffle_column
from .functions.vocabulary import builder, head_of, names, vocabulary, words_of
from .operators.adapters import conforms
from .operators.instance import Instance, initialize
from .plans.bounds import exclusive
from .plans.kinds import OMITTED, registry
from .sources.tables import read_table

CLOCK = 1_704_067_200_000  # 2024-01-01
ALGORITHM = "md5"
T = registry
V = registry.extend(vocabulary).vocab


def world(spark: SparkSession) -> Instance:
    return initialize(spark, seed="world", clock=CLOCK, algorithm=ALGORITHM)


def on(table: str, key: str, schema, overrides=None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = schema() if callable(schema) else schema
        return world(spark).Maker(s, seed="q").make_onto(read_table(spark, sf_dir, table), key, overrides)

    return run


def then(query, *columns: str):
    return lambda spark, sf_dir: query(spark, sf_dir).selectExpr(*columns)


# ---- the SQL side


def prefix(kind: str, *path: str, seed=("q",)) -> str:
    return json.dumps([list(seed), CLOCK, "unattributed", None, list(path), kind, None], separators=(",", ":"), ensure_ascii=False).replace("'", "''")


def u(kind: str, *path: str, key: str, k: str = "'0'", seed=("q",)) -> str:
    return f"(('0x' || substr(md5('{prefix(kind, *path, seed=seed)}#' || {key} || '#' || {k}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def at(x: str, low: float, high: float) -> str:
    return f"((1.0::DOUBLE - {x}) * {float(low)!r}::DOUBLE + {x} * {float(high)!r}::DOUBLE)"


def whole(x: str, low: int, high: int) -> str:
    return f"greatest({low}, least({high}, floor({at(x, low, high + 1)})::BIGINT))"


def pick(x: str, *cases: tuple[float, str]) -> str:
    live = [(w, c) for w, c in cases if w > 0]
    total, run, out = float(sum(w for w, _ in live)), 0.0, "CASE"
    for w, c in live[:-1]:
        run += w
        out += f" WHEN {x} * {total}::DOUBLE < {run}::DOUBLE THEN {c}"
    return f"{out} ELSE {live[-1][1]} END" if len(live) > 1 else live[0][1]


def words(name: str, x: str) -> str:
    return among(words_of(name), x)


def among(values: list, x: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[floor({x} * {len(values)}::DOUBLE)::INT + 1]"


def lane(kind: str, *path: str, key: str, k: str, i: str, seed=("q",)) -> str:
    """Draw number i of the digest that k names."""
    return f"(('0x' || substr(md5('{prefix(kind, *path, seed=seed)}#' || {key} || '#' || {k}), 1 + 8 * ({i}), 8))::BIGINT / 4294967296.0::DOUBLE)"


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TYPES = ["click", "error", "purchase", "signup", "view"]
O, C, P, E = "o_orderkey", "c_custkey", "p_partkey", "event_id"
ms = lambda y, m=1, d=1: int(datetime(y, m, d).timestamp() - datetime(1970, 1, 1).timestamp()) * 1000
DAY_A, DAY_B = 1_577_836_800_000, 1_609_459_200_000  # 2020-01-01, 2021-01-01

NUM_SKEW, NUM_TRI, NUM_NORMAL, NUM_LOG = Skew(3), Triangular(20), Normal(50, 12), Logarithmic()


def _distribution(d, low=1, high=100):
    return lambda: T.object({"x": T.number.whereby(low, high, d)})


def _orders(schema) -> Callable:
    return on("orders", O, schema)


def entry_schema():
    return T.object({
        "name": T.string.whereby((1, 25), {"lowercase": 9, "space": 1}), "price": T.number.whereby(1, 500), "in_stock": T.boolean(),
        "created_ms": T.date.past(), "tags": T.array(T.string.whereby((0, 15), {"lowercase": 1})).whereby((0, 5)),
    })


def _shuffle(spark, sf_dir):
    s = Stream(prefix("shuffle"), F.col(C).cast("string"))
    return read_table(spark, sf_dir, "customer").select(C, F.array_join(shuffle_column(F.array(*[F.lit(x) for x in SEGMENTS]), s), ",").alias("shuffled"))


def _combinatorial(spark, sf_dir):
    schema = T.object({"segment": T.enum.uniform(SEGMENTS), "status": T.enum.uniform(["F", "O", "P"]), "flag": T.boolean(), "note": T.optional(T.always("x"))})
    return world(spark).combinatorial(schema)


def _coverage(spark, sf_dir):
    schema = T.object({"segment": T.enum.uniform(SEGMENTS), "type": T.enum.uniform(TYPES[:3]), "flag": T.boolean()})
    return world(spark).coverage(schema)


def _sum_axis(spark, sf_dir):
    return world(spark).combinatorial(T.object({"v": T.choice.uniform([T.enum.uniform(["x", "y", "z"]), T.nullable(T.enum.weighted([(1, "p"), (0, "never"), (2, "q")]))])}))


def _override_from_table(spark, sf_dir):
    schema = T.object({"price": T.number.integer.whereby(1, 100), "status": T.enum.uniform(["new", "old"])})
    return world(spark).Maker(schema, seed="q").make_onto(read_table(spark, sf_dir, "orders"), O, {"status": F.when(F.col("o_orderstatus") == "F", F.lit("final"))})


def _constraints(spark, sf_dir):
    schema = T.object({"o_totalprice": T.number.whereby(exclusive(10_000), 300_000), "o_orderstatus": T.enum.uniform(["F", "O"]), "o_orderdate": T.date.whereby(ms(1996), exclusive(ms(2000)))})
    return read_table(spark, sf_dir, "orders").filter(conforms(schema)).select(O)


def _constraints_events(spark, sf_dir):
    schema = T.object({"event_type": T.string.whereby((4, 5), {"lowercase": 1}), "user_id": T.nullable(T.number.integer.whereby(0, 500))})
    return read_table(spark, sf_dir, "events").filter(~conforms(schema)).select(E)


def _replay(spark, sf_dir):
    """A nested field replayed from its trace: the same values as inside its object."""
    whole_object = world(spark).Maker(T.object({"a": T.number.integer.whereby(0, 999), "b": T.object({"c": T.number.integer.whereby(0, 999)})}), seed="q")
    child = whole_object.children["b"].children["c"]
    again = world(spark).Maker(child.schema, trace=child.trace)
    return again.make_onto(read_table(spark, sf_dir, "orders"), O).withColumnRenamed("value", "c")


def _vocabulary_counts(spark, sf_dir):
    every = [n for n in names() if head_of(n) in ("word", "enum")]
    schema = T.object({n.replace(".", "_"): builder(n)() for n in every})
    drawn = world(spark).Maker(schema, seed="q").words_onto(read_table(spark, sf_dir, "part"), P)
    counts = drawn.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(constant_array([*schema.meta["fields"]]), F.col("field")) - 1
    return counts.select(F.get(constant_array(every), place.cast("int")).alias("entry"), "value", "n")


def _tree():
    return T.object({"t": T.recursive(lambda me: T.object({"v": T.number.integer.whereby(0, 9), "kids": T.array(me).whereby((0, 2))})).whereby(1)})


def _slug(fields: dict[str, Column]) -> Column:
    return F.concat(F.lit("item-"), fields["name"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    letters = {"lowercase": 3, "digit": 1}
    return {
        "q_object_basic": _orders(lambda: T.object({"qty": T.number.integer.whereby(1, 6), "tier": T.enum.weighted([(3, "gold"), (2, "silver"), (0, "never"), (1, "none")])})),
        "q_num_uniform": _orders(lambda: T.object({"x": T.number.whereby(-5, 5)})),
        "q_num_bare": _orders(lambda: T.object({"x": T.number()})),
        "q_num_exclusive": _orders(lambda: T.object({"x": T.number.whereby(exclusive(0), exclusive(1))})),
        "q_int_bounds": _orders(lambda: T.object({"x": T.number.integer.whereby(exclusive(0), exclusive(4)), "y": T.number.integer()})),
        "q_sequence": on("customer", C, lambda: T.object({"n": T.number.integer.sequence()})),
        "q_bigint": then(on("customer", C, lambda: T.object({"b": T.bigint.whereby(1000, min=-7)})), C, "cast(b as bigint) b"),
        "q_bool_weighted": _orders(lambda: T.object({"b": T.boolean.weighted(true=3)})),
        "q_date_range": then(_orders(lambda: T.object({"d": T.date.whereby(DAY_A, exclusive(DAY_B))})), O, "unix_millis(d) d"),
        "q_date_past_future": _orders(lambda: T.object({"p": T.date.past(), "f": T.date.future(), "a": T.date()})),
        "q_date_past_from": then(_orders(lambda: T.object({"p": T.date.past(DAY_A)})), O, "unix_millis(p) p"),
        "q_string_class": on("part", P, lambda: T.object({"s": T.string.whereby((0, 8), letters)})),
        "q_string_wide": on("part", P, lambda: T.object({"s": T.string.whereby(4, {((0x3B1, 0x3C9), (0x4E00, 0x4E10)): 1})})),
        "q_symbol_constants": on("customer", C, lambda: T.object({"s": T.symbol.keyed("id"), "n": T.null, "u": T.undefined, "k": T.always("fixed")})),
        "q_enum_uniform": on("customer", C, lambda: T.object({"e": T.enum.uniform(SEGMENTS)})),
        "q_choice": _orders(lambda: T.object({"c": T.choice.weighted([(1, T.number.integer.whereby(0, 9)), (3, T.always(100))])})),
        "q_choice_mixed": _orders(lambda: T.object({"c": T.choice.uniform([T.boolean(), T.enum.uniform(["x", "y"])])})),
        "q_nullable": _orders(lambda: T.object({"x": T.nullable(T.number.integer.whereby(0, 9)).weighted(null=1, value=3)})),
        "q_undefinable_nullish": _orders(lambda: T.object({"a": T.undefinable(T.always(1)), "b": T.nullish(T.always(2)).weighted(value=4)})),
        "q_optional_presence": on("events", E, lambda: T.object({"a": T.omittable(T.always("x")), "b": T.optional(T.enum.uniform(["p", "q"]))})),
        "q_array": then(on("customer", C, lambda: T.object({"a": T.array(T.number.integer.whereby(0, 9)).whereby((0, 4))})), C, "size(a) n", "aggregate(a, 0L, (x, y) -> x + y) total"),
        "q_tuple": then(_orders(lambda: T.object({"t": T.tuple([T.boolean(), T.number.integer.whereby(0, 3)])})), O, "t._0 a", "t._1 b"),
        "q_record_lastwins": then(on("customer", C, lambda: T.object({"m": T.record(T.string.whereby(1, {((97, 99),): 1}), T.number.integer.whereby(0, 9)).whereby({"max": 4, "min_tried": 1})})), C, "size(m) n", "m['a'] a", "m['b'] b", "m['c'] c"),
        "q_tree_depth1": then(on("customer", C, _tree), C, "t.v v", "size(t.kids) n", "aggregate(t.kids, 0L, (x, y) -> x + y.v) total"),
        "q_extend": _orders(lambda: T.object({"a": T.always(1), "b": T.always(2)}).extend(lambda base: {"b": T.number.integer.whereby(0, 3), "c": base["a"]})),
        "q_refine_slug": on("part", P, lambda: T.object({"name": T.string.whereby(5, {"lowercase": 1})}).refine({"slug": T.compute(T.string.whereby(1)).as_(_slug)})),
        "q_override": _orders(lambda: T.object({"a": T.number.integer.whereby(0, 9), "b": T.number.integer.whereby(0, 9), "o": T.optional(T.always("x"))}).override({"a": 999, "o": OMITTED})),
        "q_override_from_table": _override_from_table,
        "q_producer": _orders(lambda: T.object({"x": T.number().as_(lambda c: c.random.next() + c.random.next()), "y": T.opaque(lambda c: F.lit(c.clock), "long")})),
        "q_dist_skew": then(_orders(_distribution(NUM_SKEW)), O, "round(x, 6) x"),
        "q_dist_triangular": then(_orders(_distribution(NUM_TRI)), O, "round(x, 6) x"),
        "q_dist_normal": then(_orders(_distribution(NUM_NORMAL)), O, "round(x, 6) x"),
        "q_dist_logarithmic": then(_orders(_distribution(NUM_LOG)), O, "round(x, 6) x"),
        "q_dist_multi": _orders(_distribution(Multi(((3, None), (1, Custom(lambda x: x * F.lit(0.5))))))),
        "q_dist_custom": _orders(_distribution(Custom(lambda x: F.lit(1.5) * x - F.lit(0.1)))),
        "q_shuffle": _shuffle,
        "q_combinatorial": _combinatorial,
        "q_coverage": _coverage,
        "q_sum_axis": _sum_axis,
        "q_constraints_orders": _constraints,
        "q_constraints_events": _constraints_events,
        "q_trace_replay": _replay,
        "q_vocab_email": on("customer", C, lambda: T.object({"first": V.person.firstName(), "email": V.internet.email()})),
        "q_vocab_words": _vocabulary_counts,
        "q_flagship": then(on("part", P, entry_schema), P, "name", "price", "in_stock", "created_ms", "size(tags) n_tags", "concat_ws('|', tags) tags"),
    }


def _chars(kind_path: tuple, key: str, length: str, choose: Callable[[str], str]) -> str:
    return f"array_to_string(list_transform(range({length}), lambda i: chr({choose('i')})), '')"


def _class_char(path: tuple, key: str, i: str, classes: list[tuple[float, int, int]]) -> str:
    """A character by its place: with one class a digest makes four, with several two."""
    each = 4 if len(classes) == 1 else 2
    k = f"'c' || ({i} // {each})"
    draw = lambda j: lane("string", *path, key=key, k=k, i=f"({i} % {each}) * {4 // each} + {j}")
    cases = [(w, f"({a} + floor({draw(4 // each - 1)} * {float(n)}::DOUBLE)::INT)") for w, a, n in classes]
    return pick(draw(0), *cases)


def oracle_sql() -> dict[str, str]:
    o, c, p, e = O, C, P, E
    x = u("number", "x", key=o)
    quantile = _quantile_sql
    big_span, max_time = 1008, 8.64e15
    attempts = f"list_transform(range(64), lambda a: floor({lane('bigint', 'b', key=c, k="'a' || a || '.0'", i='0')} * 1024.0::DOUBLE)::BIGINT)"
    first_names, last_names = ["Ada", "Bruno", "Chidi", "Dalia", "Emre", "Freya", "Goran", "Hana"], ["Abara", "Bianchi", "Castro", "Dimitrov", "Eriksen", "Fofana"]
    adjectives, nouns = ["amber", "brisk", "calm", "dusty", "eager", "faint"], ["anchor", "bridge", "candle", "delta", "ember", "forest"]
    email_user = f"{among(first_names, u('string', 'email', key=c, k="'0.0.0'"))} || '_' || {among(last_names, u('string', 'email', key=c, k="'0.2.0'"))} || " + " || ".join(f"substr('0123456789', floor({u('string', 'email', key=c, k=f"'0.3.{i}'")} * 10.0::DOUBLE)::INT + 1, 1)" for i in range(2))
    domain = f"{among(adjectives, u('string', 'email', key=c, k="'2.0.0.0'"))} || '-' || {among(nouns, u('string', 'email', key=c, k="'2.0.2.0'"))} || '.' || {among(['com', 'org', 'net', 'io'], u('string', 'email', key=c, k="'2.2.0'"))}"
    every = [n for n in names() if head_of(n) in ("word", "enum")]
    elem = lambda i, path=("a", "element"): whole(u("number.integer", *path, key=f"{c} || '.' || {i}"), 0, 9)
    slug_name = _chars((), p, "5", lambda i: _class_char(("name",), p, i, [(1, 97, 26)]))
    tag = lambda j: _chars((), p, whole(u("string", "tags", "element", key=f"{p} || '.' || {j}"), 0, 15), lambda i: _class_char(("tags", "element"), f"{p} || '.' || {j}", i, [(1, 97, 26)]))
    n_tags = whole(u("array", "tags", key=p), 0, 5)
    return {
        "q_object_basic": f"SELECT {o}, {whole(u('number.integer', 'qty', key=o), 1, 6)} AS qty, {pick(u('enum', 'tier', key=o), (3, "'gold'"), (2, "'silver'"), (1, "'none'"))} AS tier FROM orders",
        "q_num_uniform": f"SELECT {o}, {at(x, -5, 5)} AS x FROM orders",
        "q_num_bare": f"SELECT {o}, {at(x, -1.7976931348623157e308, 1.7976931348623157e308)} AS x FROM orders",
        "q_num_exclusive": f"SELECT {o}, CASE WHEN {x} <= 0 THEN 5e-324::DOUBLE ELSE {at(x, 0, 1)} END AS x FROM orders",
        "q_int_bounds": f"SELECT {o}, {whole(u('number.integer', 'x', key=o), 1, 3)} AS x, {whole(u('number.integer', 'y', key=o), -(2**53 - 1), 2**53 - 1)} AS y FROM orders",
        "q_sequence": f"SELECT {c}, row_number() OVER (ORDER BY {c}) AS n FROM customer",
        "q_bigint": f"SELECT {c}, (list_filter({attempts}, lambda v: v < {big_span}))[1] - 7 AS b FROM customer",
        "q_bool_weighted": f"SELECT {o}, {u('boolean', 'b', key=o)} * 4.0::DOUBLE < 3.0::DOUBLE AS b FROM orders",
        "q_date_range": f"SELECT {o}, {whole(u('date', 'd', key=o), DAY_A, DAY_B - 1)} AS d FROM orders",
        "q_date_past_future": f"SELECT {o}, trunc({CLOCK}.0::DOUBLE - {u('date', 'p', key=o)} * {float(CLOCK + max_time)!r}::DOUBLE)::BIGINT AS p, trunc({CLOCK}.0::DOUBLE + {u('date', 'f', key=o)} * {float(max_time - CLOCK)!r}::DOUBLE)::BIGINT AS f, trunc((2.0::DOUBLE * {u('date', 'a', key=o)} - 1.0::DOUBLE) * 8.64e15::DOUBLE)::BIGINT AS a FROM orders",
        "q_date_past_from": f"SELECT {o}, {whole(u('date', 'p', key=o), DAY_A, CLOCK)} AS p FROM orders",
        "q_string_class": f"SELECT {p}, {_chars((), p, whole(u('string', 's', key=p), 0, 8), lambda i: _class_char(('s',), p, i, [(3, 97, 26), (1, 48, 10)]))} AS s FROM part",
        "q_string_wide": f"SELECT {p}, array_to_string(list_transform(list_transform(range(4), lambda i: floor({lane('string', 's', key=p, k="'c0'", i='i')} * 42.0::DOUBLE)::INT), lambda z: chr(CASE WHEN z < 25 THEN 945 + z ELSE 19968 + z - 25 END)), '') AS s FROM part",
        "q_symbol_constants": f"SELECT {c}, 'Symbol(id)#s#' || {c} AS s, NULL::VARCHAR AS n, 'null' AS n__presence, NULL::VARCHAR AS u, 'undefined' AS u__presence, 'fixed' AS k FROM customer",
        "q_enum_uniform": f"SELECT {c}, {pick(u('enum', 'e', key=c), *[(1, repr(s)) for s in SEGMENTS])} AS e FROM customer",
        "q_choice": f"SELECT {o}, {pick(u('choice', 'c', key=o), (1, whole(u('number.integer', 'c', '0', key=o), 0, 9)), (3, '100'))} AS c FROM orders",
        "q_choice_mixed": f"""SELECT {o}, {pick(u('choice', 'c', key=o), (1, pick(u('boolean', 'c', '0', key=o), (1, "'true'"), (1, "'false'"))), (1, pick(u('enum', 'c', '1', key=o), (1, "'\"x\"'"), (1, "'\"y\"'"))))} AS c FROM orders""",
        "q_nullable": f"SELECT {o}, {pick(u('nullable', 'x', key=o), (1, 'NULL'), (3, whole(u('number.integer', 'x', 'definition', key=o), 0, 9)))} AS x, {pick(u('nullable', 'x', key=o), (1, "'null'"), (3, "'value'"))} AS x__presence FROM orders",
        "q_undefinable_nullish": f"SELECT {o}, {pick(u('undefinable', 'a', key=o), (1, 'NULL'), (1, '1::BIGINT'))} AS a, {pick(u('undefinable', 'a', key=o), (1, "'undefined'"), (1, "'value'"))} AS a__presence, {pick(u('nullish', 'b', key=o), (1, 'NULL'), (1, 'NULL'), (4, '2::BIGINT'))} AS b, {pick(u('nullish', 'b', key=o), (1, "'null'"), (1, "'undefined'"), (4, "'value'"))} AS b__presence FROM orders",
        "q_optional_presence": f"SELECT {e}, {pick(u('omittable', 'a', key=e), (1, 'NULL'), (1, "'x'"))} AS a, {pick(u('omittable', 'a', key=e), (1, "'omitted'"), (1, "'value'"))} AS a__presence, {pick(u('optional', 'b', key=e), (1, 'NULL'), (1, 'NULL'), (1, pick(u('enum', 'b', 'definition', key=e), (1, "'p'"), (1, "'q'"))))} AS b, {pick(u('optional', 'b', key=e), (1, "'omitted'"), (1, "'undefined'"), (1, "'value'"))} AS b__presence FROM events",
        "q_array": f"SELECT {c}, {whole(u('array', 'a', key=c), 0, 4)}::INT AS n, coalesce(list_sum(list_transform(range({whole(u('array', 'a', key=c), 0, 4)}), lambda i: {elem('i')})), 0)::BIGINT AS total FROM customer",
        "q_tuple": f"SELECT {o}, {u('boolean', 't', '0', key=o)} * 2.0::DOUBLE < 1.0::DOUBLE AS a, {whole(u('number.integer', 't', '1', key=o), 0, 3)} AS b FROM orders",
        "q_record_lastwins": f"WITH t AS (SELECT {c}, i, chr(97 + floor({lane('string', 'm', 'key', key=f"{c} || '.' || i", k="'c0'", i='0')} * 3.0::DOUBLE)::INT) AS k, {elem('i', ('m', 'value'))} AS v FROM customer, range(4) r(i) WHERE i < {whole(u('record', 'm', key=c), 1, 4)}), "
        f"l AS (SELECT {c}, k, arg_max(v, i) AS v FROM t GROUP BY ALL) SELECT {c}, count(*)::INT AS n, max(v) FILTER (k = 'a') AS a, max(v) FILTER (k = 'b') AS b, max(v) FILTER (k = 'c') AS c FROM l GROUP BY {c}",
        "q_tree_depth1": f"SELECT {c}, {whole(u('number.integer', 't', '@0', 'v', key=c), 0, 9)} AS v, {whole(u('array', 't', '@0', 'kids', key=c), 0, 2)}::INT AS n, coalesce(list_sum(list_transform(range({whole(u('array', 't', '@0', 'kids', key=c), 0, 2)}), lambda i: {elem('i', ('t', '@0', 'kids', 'element', '@1', 'v'))})), 0)::BIGINT AS total FROM customer",
        "q_extend": f"SELECT {o}, 1::BIGINT AS a, {whole(u('number.integer', 'b', key=o), 0, 3)} AS b, 1::BIGINT AS c FROM orders",
        "q_refine_slug": f"SELECT {p}, {slug_name} AS name, 'item-' || {slug_name} AS slug FROM part",
        "q_override": f"SELECT {o}, 999::BIGINT AS a, {whole(u('number.integer', 'b', key=o), 0, 9)} AS b, NULL::VARCHAR AS o, 'omitted' AS o__presence FROM orders",
        "q_override_from_table": f"SELECT {o}, {whole(u('number.integer', 'price', key=o), 1, 100)} AS price, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE {pick(u('enum', 'status', key=o), (1, "'new'"), (1, "'old'"))} END AS status FROM orders",
        "q_producer": f"SELECT {o}, {x} + {u('number', 'x', key=o, k="'1'")} AS x, {CLOCK}::BIGINT AS y FROM orders",
        "q_dist_skew": f"SELECT {o}, round({at(f'pow({x}, 3.0::DOUBLE)', 1, 100)}, 6) AS x FROM orders",
        "q_dist_triangular": f"WITH d AS (SELECT {o}, {x} AS u, {(20 / 2 - 1 / 2) / (100 / 2 - 1 / 2)!r}::DOUBLE AS m FROM orders), f AS (SELECT {o}, CASE WHEN u < m THEN sqrt(u * m) ELSE 1 - sqrt((1 - u) * (1 - m)) END AS t FROM d) SELECT {o}, round({at('t', 1, 100)}, 6) AS x FROM f",
        "q_dist_normal": quantile(o, x),
        "q_dist_logarithmic": f"SELECT {o}, round(least(100.0::DOUBLE, 1.0::DOUBLE * pow(100.0::DOUBLE, {x})), 6) AS x FROM orders",
        "q_dist_multi": f"SELECT {o}, {pick(x, (3, at(u('number', 'x', key=o, k="'0.0.1'"), 1, 100)), (1, at(f'({u("number", "x", key=o, k=chr(39) + "0.1.1" + chr(39))} * 0.5::DOUBLE)', 1, 100)))} AS x FROM orders",
        "q_dist_custom": f"WITH d AS (SELECT {o}, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.5::DOUBLE * {x} - 0.1::DOUBLE)) AS t FROM orders) SELECT {o}, {at('t', 1, 100)} AS x FROM d",
        "q_shuffle": f"WITH s AS (SELECT {c}, i, unnest.s AS s, (('0x' || substr(md5('{prefix('shuffle')}#' || {c} || '#' || i), 1, 8))::BIGINT) AS d FROM customer, (SELECT unnest({SEGMENTS!r}) AS s, generate_subscripts({SEGMENTS!r}, 1) - 1 AS i) unnest) SELECT {c}, string_agg(s, ',' ORDER BY d, i) AS shuffled FROM s GROUP BY {c}",
        "q_combinatorial": f"SELECT ({SEGMENTS!r})[i // 18 + 1] AS segment, (['F', 'O', 'P'])[(i // 6) % 3 + 1] AS status, (i // 3) % 2 = 0 AS flag, CASE WHEN i % 3 = 2 THEN 'x' END AS note, (['omitted', 'undefined', 'value'])[i % 3 + 1] AS note__presence FROM range(90) r(i)",
        "q_coverage": _coverage_sql(),
        "q_sum_axis": "SELECT (['x', 'y', 'z', NULL, 'p', 'q'])[i + 1] AS v, CASE WHEN i = 3 THEN 'null' ELSE 'value' END AS v__presence FROM range(6) r(i)",
        "q_constraints_orders": f"SELECT {o} FROM orders WHERE o_totalprice > 10000 AND o_totalprice <= 300000 AND o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'",
        "q_constraints_events": f"SELECT {e} FROM events WHERE NOT (length(event_type) BETWEEN 4 AND 5 AND (user_id IS NULL OR user_id BETWEEN 0 AND 500))",
        "q_trace_replay": f"SELECT {o}, {whole(u('number.integer', 'b', 'c', key=o), 0, 999)} AS c FROM orders",
        "q_vocab_email": f"SELECT {c}, {among(first_names, u('string', 'first', key=c))} AS first, {email_user} || '@' || {domain} AS email FROM customer",
        "q_vocab_words": "WITH x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS entry, {words(n, u('enum' if head_of(n) == 'enum' else 'string', n.replace('.', '_'), key=p))} AS value FROM part" for n in every) + ") SELECT entry, value, count(*) AS n FROM x GROUP BY ALL",
        "q_flagship": f"SELECT {p}, {_chars((), p, whole(u('string', 'name', key=p), 1, 25), lambda i: _class_char(('name',), p, i, [(9, 97, 26), (1, 32, 1)]))} AS name, {at(u('number', 'price', key=p), 1, 500)} AS price, {u('boolean', 'in_stock', key=p)} * 2.0::DOUBLE < 1.0::DOUBLE AS in_stock, trunc({CLOCK}.0::DOUBLE - {u('date', 'created_ms', key=p)} * {float(CLOCK + max_time)!r}::DOUBLE)::BIGINT AS created_ms, {n_tags}::INT AS n_tags, array_to_string(list_transform(range({n_tags}), lambda j: {tag('j')}), '|') AS tags FROM part",
    }


def _shuffled(n: int, draws) -> list[int]:
    """Places 0 to n-1, each swapped with one at random from itself onwards."""
    out = list(range(n))
    for i in range(n - 1):
        j = i + int(next(draws) * (n - i))
        out[i], out[j] = out[j], out[i]
    return out


def _coverage_sql() -> str:
    key = json.dumps([["world", "coverage", "order"], CLOCK, "unattributed", None, [], None, None], separators=(",", ":"))
    draws = (int(hashlib.md5(f"{key}#0#{k}".encode()).hexdigest()[:8], 16) / 2**32 for k in range(100))
    segment, kind, flag, whole_order = (_shuffled(n, draws) for n in (5, 3, 2, 5))  # fields in order, then the object itself
    place = f"({whole_order})[i + 1]"
    at_place = lambda order: f"({order})[{place} % {len(order)} + 1] + 1"
    return f"SELECT ({SEGMENTS!r})[{at_place(segment)}] AS segment, ({TYPES[:3]!r})[{at_place(kind)}] AS type, ([true, false])[{at_place(flag)}] AS flag FROM range(5) r(i)"


def _quantile_sql(key: str, x: str) -> str:
    from .functions import distributions as d

    def horner(cs, v):
        out = f"({cs[0]!r}::DOUBLE)"
        for k in cs[1:]:
            out = f"({out} * {v} + ({k!r}::DOUBLE))"
        return out

    low, high = d.normal_cdf((1 - 50) / 12), d.normal_cdf((100 - 50) / 12)
    tail = lambda q: f"{horner(d.TAIL_C, q)} / {horner((*d.TAIL_D, 1.0), q)}"
    centre = f"{horner(d.CENTRE_A, '(q * q)')} * q / {horner((*d.CENTRE_B, 1.0), '(q * q)')}"
    return (
        f"WITH a AS (SELECT {key}, least({1 - 1e-12!r}::DOUBLE, greatest({1e-12!r}::DOUBLE, {at(x, low, high)})) AS p FROM orders), "
        f"b AS (SELECT {key}, p, p - 0.5::DOUBLE AS q, sqrt(-2.0::DOUBLE * ln(p)) AS s, sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - p)) AS t FROM a) "
        f"SELECT {key}, round(least(100.0::DOUBLE, greatest(1.0::DOUBLE, 50.0::DOUBLE + 12.0::DOUBLE * (CASE WHEN p < 0.02425::DOUBLE THEN {tail('s')} WHEN p > {1 - 0.02425!r}::DOUBLE THEN -({tail('t')}) ELSE {centre} END))), 6) AS x FROM b"
    )
