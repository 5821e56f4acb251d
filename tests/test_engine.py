import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tesserae import OMITTED, Custom, Logarithmic, Multi, Normal, Skew, Triangular, errors, exclusive, initialize, layer, to_constraints, to_json_schema
from tesserae.functions.distributions import normal_cdf
from tesserae.functions.draws import md5_draw
from tesserae.functions.vocabulary import builder, names, vocabulary
from tesserae.operators.adapters import JsonSchema, conforms, drive
from tesserae.operators.instance import derive_clock, relativize, with_dense_rank
from tesserae.plans.bounds import Bound, effective_discrete
from tesserae.plans.compiler import Trace, WordProducer, code_point
from tesserae.plans.kinds import registry as T
from tesserae.queries import queries
from tesserae.streaming.rate import make_on_stream


@pytest.fixture(scope="module")
def world(spark):
    return initialize(spark, seed="w", clock=datetime(2024, 1, 1))


def rows(f, n, **kw):
    return [r.asDict() for r in f.make(n, **kw).collect()]


def test_encoding_and_paths():
    assert Trace(("a", "é"), 5, path=("x", "0"), kind="enum").encode() == '[["a","é"],5,"unattributed",null,["x","0"],"enum",null]'
    assert relativize("/a/b", "/a/c/d.py") == "../c/d.py"
    assert effective_discrete(Bound(1, True), Bound(4, True)) == (2, 3)
    assert derive_clock(("abc",)) == derive_clock(("abc",)) != derive_clock(("abd",))
    assert abs(normal_cdf(1.96) - 0.975) < 1e-4


def test_same_seed_same_rows_whatever_the_partitions(world):
    s = T.object({"n": T.number(), "s": T.string.whereby((0, 9), {"lowercase": 1}), "l": T.array(T.number()).whereby((0, 5))})
    f = world.Maker(s, seed="x")
    one, many = rows(f, 50, partitions=1), rows(f, 50, partitions=7)
    assert sorted(map(str, one)) == sorted(map(str, many))
    assert rows(world.Maker(s, seed="y"), 5) != one[:5]


def test_siblings_do_not_depend_on_each_other(world):
    a = rows(world.Maker(T.object({"name": T.string.whereby(8), "age": T.number()}), seed="x"), 5)
    b = rows(world.Maker(T.object({"age": T.number(), "id": T.bigint.whereby(9), "name": T.string.whereby(8)}), seed="x"), 5)
    assert [(r["name"], r["age"]) for r in a] == [(r["name"], r["age"]) for r in b]
    c = rows(world.Maker(T.object({"name": T.string.whereby(8), "age": T.number()}).override({"name": "k"}), seed="x"), 5)
    assert [r["age"] for r in a] == [r["age"] for r in c] and {r["name"] for r in c} == {"k"}


def test_proportions(world):
    s = T.object({"i": T.number.integer.whereby(0, 3), "o": T.optional(T.always(1)), "u": T.omittable(T.undefinable(T.always(1))), "k": T.number.integer.whereby(0, 99, Skew(3))})
    got = [r.asDict() for r in world.Maker(s, seed="x").make(20_000).collect()]
    for k in range(4):
        assert 0.7 < sum(r["i"] == k for r in got) / 5000 < 1.3
    shares = [sum(r["o__presence"] == p for r in got) / 20_000 for p in ("omitted", "undefined", "value")]
    assert all(abs(x - 1 / 3) < 0.03 for x in shares)
    assert abs(sum(r["u__presence"] == "omitted" for r in got) / 20_000 - 0.5) < 0.03
    assert sum(r["k"] < 50 for r in got) > 14_000


def test_distributions_stay_in_bounds(world):
    for d in (None, Skew(2), Triangular(3), Normal(), Normal(5, 0.5), Logarithmic(), Multi(((1, Skew(2)), (2, Normal()))), Custom(lambda u: u * 3 - 1)):
        got = [r["x"] for r in rows(world.Maker(T.object({"x": T.number.whereby(1, 9, d)}), seed="d"), 500)]
        assert all(1 <= x <= 9 for x in got) and len(set(got)) > 1


def test_strings_count_utf16_units(world):
    got = rows(world.Maker(T.object({"s": T.string.whereby(3), "e": T.string.whereby((0, 1))}), seed="s"), 300)
    assert all(len(r["s"].encode("utf-16-le")) == 6 for r in got)
    assert {len(r["e"].encode("utf-16-le")) for r in got} == {0, 2}


def test_records_tuples_and_recursion(world):
    tree = T.recursive(lambda me: T.object({"v": T.number.integer.whereby(0, 9), "kids": T.array(me).whereby((0, 2))})).whereby({"max": 2})
    s = T.object({"m": T.record(T.string.whereby(1, {((97, 98),): 1}), T.number()).whereby({"max": 6, "min_tried": 2}), "t": T.tuple([T.boolean(), T.null]), "tree": tree})
    got = [r for r in world.Maker(s, seed="r").make(200).collect()]
    assert all(1 <= len(r["m"]) <= 2 for r in got)
    depth = lambda v: 0 if not hasattr(v, "kids") else 1 + max([0, *(depth(k) for k in v.kids)])
    assert max(depth(r["tree"]) for r in got) == 3
    with pytest.raises(errors.UnterminableRecursiveError):
        T.recursive(lambda me: T.choice.uniform([me])).whereby(1)
    assert rows(world.Maker(T.object({"x": T.recursive(lambda me: T.nullable(me)).whereby(0)}), seed="r"), 1)[0]["x"] is None


def test_derivation(world):
    base = T.object({"a": T.always(1), "b": T.object({"c": T.always(2), "d": T.always(3)})})
    got = rows(world.Maker(base.override({"b": {"c": 9}}), seed="x"), 1)[0]
    assert (got["b"]["c"], got["b"]["d"]) == (9, 3)
    more = base.extend(lambda f: {"b": T.always("x")}).refine({"e": T.compute(T.bigint.whereby(9)).as_(lambda f: f["a"] + 1)})
    got = rows(world.Maker(more, seed="x"), 1)[0]
    assert got["b"] == "x" and got["e"] == 2
    assert rows(world.Maker(base, seed="x"), 1, overrides={"a": 7})[0]["a"] == 7
    made = T.object({"a": T.number()}).as_(lambda c: F.struct(F.lit(1.5).alias("a"), F.lit("z").alias("z")), "struct<a:double,z:string>")
    assert rows(world.Maker(made, seed="x"), 1, overrides={"a": 2.0})[0] == {"a": 2.0, "z": "z"}


def test_trace_replays_nested_fields(world):
    f = world.Maker(T.object({"a": T.object({"b": T.number()})}), seed="x")
    child = f.children["a"].children["b"]
    assert [r["value"] for r in rows(world.Maker(child.schema, trace=child.trace), 5)] == [r["a"]["b"] for r in rows(f, 5)]
    with pytest.raises(errors.TraceKindMismatchError):
        world.Maker(T.boolean(), trace=child.trace)


def test_instances_fork_wrap_and_layer(spark, world):
    s = T.object({"n": T.number()})
    a = rows(world.fork(seed="k").Maker(s), 3)
    assert a == rows(initialize(spark, seed="k", clock=datetime(2024, 1, 1)).Maker(s), 3)
    with world.wrap(seed="k"):
        assert world.context.seed == ("k",)
        with world.wrap(seed=layer("deep")):
            assert world.context.seed == ("k", "deep")
        assert rows(world.Maker(s), 3) == a
    assert world.context.seed == ("w",)
    first, second = world.fork(seed="z"), world.fork(seed="z")
    assert rows(first.Maker(s), 2) == rows(second.Maker(s), 2) != rows(first.Maker(s), 2)
    here = initialize(spark, seed="k", clock=0, attribution="call site").Maker(s)
    assert here.trace.file == "test_engine.py"


def test_enumeration(world):
    got = world.combinatorial(T.object({"e": T.enum.uniform(["a", "b", "c"]), "t": T.tuple([T.boolean(), T.boolean()])})).collect()
    assert len({str(r) for r in got}) == 12 and got[0]["e"] == "a"
    assert world.combinatorial(T.object({"c": T.choice.uniform([T.enum.uniform(["x", "y", "z"]), T.boolean()])})).count() == 5
    cover = world.coverage(T.object({"a": T.nullable(T.enum.uniform(["a", "b", "c"])), "b": T.enum.uniform([1, 2, 3, 4, 5])})).collect()
    assert len(cover) == 5 and {r["b"] for r in cover} == {1, 2, 3, 4, 5} and {r["a"] for r in cover} == {"a", "b", "c", None}
    with pytest.raises(errors.CombinatorialLimitExceededError):
        world.fork(limits={"combinatorial": 3}).combinatorial(T.object({"e": T.enum.uniform(list("abcd"))}))
    drawn = world.combinatorial(T.object({"e": T.boolean(), "n": T.number()})).collect()
    assert drawn[0]["n"] != drawn[1]["n"]


@pytest.mark.parametrize(
    "make, error",
    [
        (lambda: T.enum.uniform([]), errors.EmptyItemsError), (lambda: T.enum.weighted([(0, 1)]), errors.NoDrawableOutcomesError), (lambda: T.boolean.weighted(true=-1), errors.InvalidWeightError),
        (lambda: T.nullable(T.null).weighted(value=math.inf), errors.InvalidWeightError), (lambda: T.number.whereby(2, 1), errors.EmptyRangeError), (lambda: T.number.integer.whereby(exclusive(1), exclusive(2)), errors.EmptyRangeError),
        (lambda: T.string.whereby((3, 1)), errors.EmptyRangeError), (lambda: T.object({"__proto__": T.null}), errors.PrototypePollutionError), (lambda: T.object({"a": T.null}).override({"b": 1}), errors.UnknownOverrideFieldError),
        (lambda: T.object({"a": T.number()}).override({"a": "x"}), errors.InvalidOverrideValueError), (lambda: T.object({"a": T.number()}).override({"a": OMITTED}), errors.IllegalOmittedOverrideError),
        (lambda: T.object({"a": T.nullable(T.number())}).override({"a": OMITTED}), errors.InvalidOverrideValueError), (lambda: T.object({"a": 3}), errors.UnknownKindError), (lambda: T.date.whereby(2, 1), errors.EmptyRangeError),
    ],
)
def test_errors_of_builders(make, error):
    with pytest.raises(error):
        make()


def test_errors_of_plans(spark, world):
    build = lambda s: world.Maker(s, seed="x").make(1)
    for schema, error in (
        (T.compute(T.number()).as_(lambda f: 1), errors.DetachedComputeError), (T.object({"a": T.number.whereby(0, 1, Logarithmic())}), errors.InvalidDistributionBoundError),
        (T.object({}).refine({"a": T.compute(T.number()).as_(lambda f: "x")}), errors.ComputeResultMismatchError), (T.object({"d": T.date.past(datetime(2030, 1, 1))}), errors.EmptyRangeError),
    ):
        with pytest.raises(error):
            build(schema)
    with pytest.raises(errors.InvalidCombinatorialLimitError):
        initialize(spark, limits={"combinatorial": 0})
    with pytest.raises(errors.InvalidAttributionRootError):
        initialize(spark, attribution="relative/path")
    with pytest.raises(errors.UnrepresentableRecordKeyError):
        to_json_schema(T.record(T.symbol(), T.null).whereby(1))


def test_adapters(spark, world):
    s = T.object({"n": T.number.whereby(exclusive(0), 5), "e": T.enum.uniform(["a", "b"]), "o": T.omittable(T.boolean()), "s": T.string.whereby((1, 3), {"digit": 1}), "d": T.nullable(T.number.integer.whereby(1, 2))})
    j = to_json_schema(s)
    assert j["properties"]["n"] == {"type": "number", "exclusiveMinimum": 0, "maximum": 5} and j["required"] == ["n", "e", "s", "d"]
    assert world.Maker(s, seed="a").make(200).filter(~conforms(s)).count() == 0
    assert spark.createDataFrame([(0.0, "a", None, "x", None)], "n double, e string, o boolean, s string, d long").filter(conforms(s)).count() == 0
    assert len(to_constraints(s)) >= 6
    twice = T.string.whereby(1).adapt(JsonSchema(), lambda s, m, below: {**below(), "x": 1}).adapt(JsonSchema(), lambda s, m, below: {**below(), "y": 2})
    assert drive(JsonSchema(), twice) == {"type": "string", "minLength": 1, "maxLength": 1, "x": 1, "y": 2}
    assert json.dumps(to_json_schema(T.recursive(lambda me: T.nullable(me)).whereby(1)))
    assert world.Maker(s, seed="a").data_type().fieldNames() == ["n", "e", "o", "o__presence", "s", "d", "d__presence"]


def test_dense_rank_without_one_sort(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS k")
    for rows_per_bucket in (1_000_000, 3):
        got = [r["n"] for r in with_dense_rank(df, "k", "n", rows_per_bucket).orderBy("k").collect()]
        assert got == list(range(1, 1001))
    ties = spark.createDataFrame([(3,), (3,), (None,), (1,)], "k long")
    assert sorted((r["n"], r["k"]) for r in with_dense_rank(ties, "k", "n", 1).collect()) == [(1, None), (2, 1), (3, 3), (4, 3)]
    assert with_dense_rank(ties.filter("k > 9"), "k", "n").count() == 0


def test_vocabulary(world):
    assert len(names()) == 251
    t = T.extend(vocabulary)
    f = world.Maker(T.object({"e": t.vocab.internet.email(), "u": t.vocab.string.uuid(), "g": t.vocab.color.rgb.channels(), "x": t.vocab.use.string(lambda c: F.lit("k")), "y": builder("person.fullName")()}), seed="v")
    for r in rows(f, 20):
        assert "@" in r["e"] and len(r["u"]) == 36 and len(r["g"]) == 3 and " " in r["y"]


def test_streams_make_the_same_rows(spark, world, tmp_path):
    f = world.Maker(T.object({"a": T.number.integer.whereby(0, 9), "q": T.number.integer.sequence()}), seed="st")
    spark.range(20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    query = make_on_stream(f, stream, "id", dense_from=0).writeStream.format("memory").queryName("made").trigger(availableNow=True).start()
    query.awaitTermination()
    want = [(k, r["a"], r["q"]) for k, r in enumerate(rows(f, 20))]
    assert [tuple(r) for r in spark.table("made").orderBy("id").collect()] == want
    assert sorted(tuple(r) for r in f.make_onto(spark.range(20), "id").collect()) == want
    with pytest.raises(errors.MissingOrdinalError):
        make_on_stream(f, stream, "id")
    with pytest.raises(errors.MissingOrdinalError):
        world.Maker(T.array(T.number.integer.sequence()).whereby((0, 2)), seed="st").make(1)


def test_keys_of_one_partition_are_made_over_all_cores(spark, world):
    keys = spark.range(0, 400, 1, 1)
    made = world.Maker(T.object({"x": T.number()}), seed="dealt").make_onto(keys, "id")
    parts = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(parts) >= spark.sparkContext.defaultParallelism and max(parts) <= 2 * 400 / len(parts) and sum(parts) == 400


def test_a_byte_order_mark_is_a_character(world):
    (one,) = rows(world.Maker(T.object({"s": T.string.whereby(3, {((0xFEFF, 0xFEFF),): 1})}), seed="bom"), 1)
    assert one["s"] == "\ufeff" * 3


def test_a_byte_order_mark_beside_characters_of_two_units(world):
    made = rows(world.Maker(T.object({"s": T.string.whereby(2, {((0xFEFF, 0xFEFF), (0x1F600, 0x1F600)): 1})}), seed="bom"), 40)
    assert {len(r["s"].encode("utf-16-be")) for r in made} == {4} and "\ufeff" * 2 in {r["s"] for r in made}


def test_every_code_point_is_its_character(spark):
    made = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343").select("id", code_point(F.col("id"), False).alias("c"))
    wrong = [r["id"] for r in made.collect() if r["c"] != chr(r["id"])]
    assert wrong == []


def test_check_digits_take_no_function_of_higher_order(spark, world):
    schema = T.object({n.replace(".", "_"): builder(n)() for n in ("commerce.isbn", "finance.creditCardNumber", "finance.iban", "vehicle.vin")})
    made = world.Maker(schema, seed="digits").make_onto(spark.range(40), "id")
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()  # they are evaluated uncompiled, with all draws inside
    assert all(int(r["finance_iban"][4:] + "1314" + r["finance_iban"][2:4]) % 97 == 1 for r in made.collect())


def test_fields_of_words_turned_are_those_of_the_wide_form(spark, world):
    entries = ("word.noun", "date.month", "person.zodiacSign", "internet.protocol", "person.firstName")  # lists of 2 to 12 words
    keys = spark.range(0, 300).select(F.when(F.col("id") != 7, F.col("id")).alias("id"))  # a null key too
    for algorithm in ("md5", "xxhash64", lambda key: F.pmod(F.hash(key), F.lit(1000)) / F.lit(1000.0)):
        maker = world.fork(algorithm=algorithm).Maker(T.object({n.replace(".", "_"): builder(n)() for n in entries}), seed="turned")
        wide, turned = maker.make_onto(keys, "id"), maker.words_onto(keys, "id")
        want = sorted((str(r["id"]), f, r[f]) for r in wide.collect() for f in wide.columns[1:])
        assert sorted((str(r["id"]), r["field"], r["value"]) for r in turned.collect()) == want
    long = world.Maker(T.object({"w": T.string.as_(WordProducer(tuple(map(str, range(40))))), "v": T.string.as_(WordProducer(("only",)))}), seed="turned")
    want = sorted((r["id"], f, r[f]) for r in long.make_onto(spark.range(200), "id").collect() for f in ("v", "w"))
    assert sorted(tuple(r) for r in long.words_onto(spark.range(200), "id").collect()) == want
    with pytest.raises(errors.UnknownKindError):
        world.Maker(T.object({"w": builder("word.noun")().as_(lambda c: F.lit("x"))})).words_onto(spark.range(1), "id")


def test_cuts_of_digests_tell_the_places_that_draws_tell(spark):
    near = {(n, min(max(k * 2**32 // n + d, 0), 2**32 - 1)) for n in range(1, 17) for k in range(n + 1) for d in (-1, 0, 1)}
    digests = spark.createDataFrame([(n, f"{x:08x}" + tail) for n, x in near for tail in ("0" * 24, "f" * 24)], "n int, d string")
    made = digests.select("n", "d", F.floor(md5_draw.lane(F.col("d"), 0) * F.col("n")).alias("place")).collect()
    assert all(r["place"] == next(k for k in range(r["n"]) if r["d"] < md5_draw.cut(k + 1, r["n"])) for r in made)


def test_counting_words_takes_one_expression_for_all_entries(spark):
    counts = queries()["q_vocab_words"](spark, "/root/testdata/sf0.001")
    assert counts._jdf.queryExecution().analyzed().toString().count("md5(") <= 16  # as many as the longest list has words, not one for each entry
