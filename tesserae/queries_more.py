"""More queries: paths beside the usual ones, producers of every kind, the vocabulary's shapes, and tables of contracts.

A table of contracts has a row for each case, made by running the case on the driver: what it returned, or the error it
raised. Its SQL states the rows that are expected.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as q
from .errors import EngineError
from .functions.distributions import Logarithmic, check_weights, normal_cdf, normal_quantile, unit_position
from .functions.draws import Stream, sample_column, to_algorithm
from .functions.vocabulary import builder, draw, head_of, names, vocabulary_extension
from .operators.adapters import JsonSchema, conforms, drive, to_json_schema
from .operators.instance import caller_file, derive_clock, env_seed, initialize, layer, normalize_seed, random_seed, relativize
from .plans.bounds import Bound, effective_discrete, epoch_ms, exclusive, length_range
from .plans.compiler import Trace
from .plans.enumeration import plan
from .plans.kinds import OMITTED, contains_self, registry, terminate, violates_kind, whole_value
from .queries import CLOCK, C, O, P, among, at, lane, on, pick, prefix, then, u, whole
from .sources.tables import read_table
from .streaming.rate import make_on_stream

T = registry


def _world_maker(spark: SparkSession, schema, **over):
    return q.world(spark).Maker(schema, seed="q", **over)


# ---- paths beside the usual ones


def _null_key(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(F.when(F.col(O) % 5 != 0, F.col(O)).alias("k"))
    return _world_maker(spark, T.object({"x": T.number.integer.whereby(0, 9)})).make_onto(orders, "k")


SHA = to_algorithm(lambda key: F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0))


def _custom_algorithm(spark, sf_dir):
    world = initialize(spark, seed="world", clock=CLOCK, algorithm=SHA)
    schema = T.object({"x": T.number.whereby(0, 1), "s": T.string.whereby(3, {"lowercase": 1, "digit": 1}), "b": T.bigint.whereby(2**40 - 1, min=0)})
    return world.Maker(schema, seed="q").make_onto(read_table(spark, sf_dir, "customer"), C).withColumn("b", F.col("b").cast("long"))


def _xxhash64(spark, sf_dir):
    world = initialize(spark, seed="world", clock=CLOCK, algorithm="xxhash64")
    rows = world.Maker(T.object({"x": T.number.whereby(0, 1), "s": T.string.whereby(4, {"digit": 1})}), seed="q").make_onto(read_table(spark, sf_dir, "orders"), O)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("x") >= 0) & (F.col("x") < 1)).alias("inside"), (F.abs(F.avg("x") - 0.5) < 0.05).alias("even"), F.count_if(F.col("s").rlike("^[0-9]{4}$")).alias("digits"))


def _sample(spark, sf_dir):
    draws = Stream(prefix("sample"), F.col(C).cast("string"))
    return read_table(spark, sf_dir, "customer").select(C, sample_column(F.array(*[F.lit(x) for x in q.SEGMENTS]), draws).alias("sampled"))


def _quantiles(spark, sf_dir):
    """The quantile of the cumulative normal distribution is its inverse, within the errors of both approximations."""
    points = [k / 4 for k in range(-11, 12)]
    rows = spark.createDataFrame([(z, normal_cdf(z)) for z in points], "z double, p double")
    return rows.select("z", (F.abs(normal_quantile(F.col("p")) - F.col("z")) < 1e-4).alias("inverse"))


def _json_recursion():
    body = T.recursive(lambda me: T.choice.uniform([T.number.integer.whereby(0, 9), T.array(me).whereby((0, 2))]))
    return T.object({"j": body.whereby(1)})


def _rehydrated(spark, sf_dir):
    world = q.world(spark)
    built = world.Maker(T.object({"a": T.number.integer.whereby(0, 9)}), seed="q")
    again = world.Maker(T.object({"inner": built, "b": T.number.integer.whereby(0, 9)}), seed="q")
    return again.make_onto(read_table(spark, sf_dir, "orders"), O).select(O, F.col("inner.a").alias("a"), "b")


def _overridden_producer(spark, sf_dir):
    schema = T.object({"a": T.number(), "z": T.string.whereby(1)}).as_(lambda c: F.struct(c.random.next().alias("a"), F.lit("z").alias("z")), "struct<a:double,z:string>")
    return _world_maker(spark, schema).make_onto(read_table(spark, sf_dir, "customer"), C, {"z": "mine"})


def _element_replay(spark, sf_dir):
    """An array's element, replayed from its trace on the ordinals of elements."""
    whole_array = _world_maker(spark, T.array(T.number.integer.whereby(0, 99)).whereby(2))
    element = whole_array.children["element"]
    again = q.world(spark).Maker(element.schema, trace=element.trace)
    keys = read_table(spark, sf_dir, "customer").select(F.concat(F.col(C).cast("string"), F.lit(".1")).alias("k"))
    return again.make_onto(keys, "k")


def _stream(spark, sf_dir):
    """The same rows on a stream, whose keys are dense from 0, so that sequences are known as well."""
    maker = _world_maker(spark, T.object({"x": T.number.integer.whereby(0, 9), "n": T.number.integer.sequence()}))
    keys = read_table(spark, sf_dir, "customer").select(C)
    stream = spark.readStream.schema(keys.schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    name = f"streamed_{uuid.uuid4().hex}"
    make_on_stream(maker, stream, C, dense_from=0).writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _unchecked(spark, sf_dir):
    schema = T.object({"a": T.number.integer.whereby(0, 9), "o": T.optional(T.always("x"))})
    given = F.when(F.col(O) % 2 == 0, F.lit("given"))
    return _world_maker(spark, schema).make_onto(read_table(spark, sf_dir, "orders"), O, {"nope": 1, "o": given}, validate=False)


def _wide_enum(spark, sf_dir):
    schema = T.object({"e": T.enum.uniform(list(range(1000, 6000))), "w": T.enum.weighted([(k % 3, f"v{k}") for k in range(40)])})
    return _world_maker(spark, schema).make_onto(read_table(spark, sf_dir, "orders"), O)


def _wide_coverage(spark, sf_dir):
    cover = q.world(spark).coverage(T.object({"e": T.enum.uniform(list(range(5000))), "b": T.boolean()}))
    return cover.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("e").alias("members"), F.count_if("b").alias("true"), F.sum("e").alias("total"))


def _constraints_nested(spark, sf_dir):
    """Rows whose vector, cut to two places and given a status, is or isn't what the schema allows."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("v"), F.col("label").cast("long").alias("c"))
    schema = T.object({"v": T.array(T.number.whereby(-0.15, exclusive(0.2))).whereby((1, 3)), "c": T.choice.uniform([T.number.integer.whereby(0, 2), T.number.integer.whereby(5, 6)])})
    return rows.filter(conforms(schema)).select("vec_id")


def _constraints_made(spark, sf_dir):
    """Everything that a schema makes conforms to it."""
    schema = T.object({
        "a": T.array(T.undefinable(T.number.integer.whereby(1, 3))).whereby((0, 3)), "r": T.record(T.string.whereby((1, 2), {"digit": 1}), T.nullable(T.boolean())).whereby({"max": 3}), "c": T.choice.uniform([T.boolean(), T.enum.uniform(["x"])]),
        "p": T.date.past(), "f": T.date.future(CLOCK + 1000), "s": T.symbol.keyed("k"), "t": T.recursive(lambda me: T.object({"v": T.boolean(), "k": T.array(me).whereby((0, 2))})).whereby(2), "n": T.null, "l": T.always([1, 2]),
    })
    made = _world_maker(spark, schema).make_onto(read_table(spark, sf_dir, "customer"), C)
    return made.select(C, conforms(schema, clock=CLOCK).alias("conforms"))


# ---- producers of every kind


def _producers():
    half = lambda c: c.random.next() < 0.5
    return T.object({
        "boolean": T.boolean().as_(half), "date": T.date().as_(lambda c: F.timestamp_millis(F.lit(c.clock)), "timestamp"), "bigint": T.bigint.as_(lambda c: F.floor(c.random.next() * 10).cast("decimal(38,0)")), "symbol": T.symbol().as_(lambda c: F.lit("Symbol()")),
        "enum": T.enum.uniform(["a", "b"]).as_(lambda c: F.when(half(c), F.lit("a")).otherwise(F.lit("b"))), "choice": T.choice.uniform([T.always(1), T.always(2)]).as_(lambda c: F.floor(c.random.next() * 2).cast("long")),
        "tuple": T.tuple([T.number(), T.string.whereby(1)]).as_(lambda c: F.struct(F.lit(1.5).alias("_0"), F.lit("t").alias("_1"))), "array": T.array(T.number()).as_(lambda c: F.array(c.random.next(), c.random.next())),
        "record": T.record(T.string.whereby(1), T.number()).as_(lambda c: F.create_map(F.lit("k"), c.random.next())), "nullable": T.nullable(T.number()).as_(lambda c: F.when(half(c), F.lit(1.0))), "undefinable": T.undefinable(T.number()).as_(lambda c: F.lit(2.0)),
        "nullish": T.nullish(T.number()).as_(lambda c: F.lit(3.0)), "omittable": T.omittable(T.number()).as_(lambda c: F.lit(4.0)), "optional": T.optional(T.number()).as_(lambda c: F.lit(5.0)), "text": T.string.as_(lambda c: F.lit("made")), "integer": T.number.integer().as_(lambda c: F.lit(6).cast("long")),
    })


# ---- the vocabulary: what each entry that isn't a word of a list looks like

TEXT = {
    "airline.flightNumber": "[0-9]{4}", "airline.recordLocator": "[A-Z]{6}", "airline.seat": "[1-3]?[0-9][A-F]", "book.author": "[A-Z][a-z]+ [A-Z][a-z]+", "book.title": "The [a-z]+ [a-z]+",
    "color.rgb.text": r"rgb\([0-9]{1,3}, [0-9]{1,3}, [0-9]{1,3}\)", "color.cmyk.text": r"cmyk\(([0-9]{1,3}%(, )?){4}\)", "color.hsl.text": r"hsl\([0-9]{1,3}deg [0-9]{1,3}% [0-9]{1,3}%\)", "color.hwb.text": r"hwb\([0-9]{1,3} [0-9]{1,3}% [0-9]{1,3}%\)",
    "color.lab.text": r"lab\([0-9]{1,3}% [0-9]{1,3} [0-9]{1,3}\)", "color.lch.text": r"lch\([0-9]{1,3}% [0-9]{1,3} [0-9]{1,3}\)", "color.colorByCSSColorSpace.text": r"color\([A-Za-z0-9-]+ 0\.[0-9] 0\.[0-9] 0\.[0-9]\)",
    "commerce.isbn": "978[0-9]{10}", "commerce.price": r"[0-9]{1,4}\.[0-9]{2}", "commerce.productDescription": "[A-Z][a-z]+ [A-Z][a-z]+ made of [a-z]+", "commerce.productName": "[A-Z][a-z]+ [a-z]+ [A-Z][a-z]+", "commerce.upc": "[0-9]{12}",
    "company.buzzPhrase": "[a-z]+ [a-z]+ [a-z]+", "company.catchPhrase": "[A-Z][a-z]+ [a-z]+ [a-z]+", "company.name": "[A-Z][a-z]+ (Ltd|Group|and Sons|Inc)", "database.mongodbObjectId": "[0-9a-f]{24}",
    "finance.accountNumber": "[0-9]{8}", "finance.amount": r"[0-9]{1,4}\.[0-9]{2}", "finance.bic": "[A-Z]{6}[0-9]{2}", "finance.bitcoinAddress": "1[a-z0-9]{27}", "finance.creditCardCVV": "[0-9]{3}", "finance.creditCardNumber": "4[0-9]{15}", "finance.ethereumAddress": "0x[0-9a-f]{40}",
    "finance.iban": "DE[0-9]{20}", "finance.litecoinAddress": "L[a-z0-9]{26}", "finance.pin": "[0-9]{4}", "finance.routingNumber": "[0-9]{9}", "finance.transactionDescription": r"[a-z]+ of [0-9]+\.[0-9]{2} [A-Z]{3}",
    "food.description": "[a-z]+ [a-z]+ with [a-z]+", "git.branch": "[a-z]+-[a-z]+", "git.commitDate": "[A-Z][a-z]+day [0-2][0-9]:[0-5][0-9]:[0-5][0-9]", "git.commitEntry": "commit [0-9a-f]{40}", "git.commitMessage": "[a-z]+ [a-z-]+ [a-z]+", "git.commitSha": "[0-9a-f]{40}", "hacker.phrase": "Try [a-z]+ the [A-Z]+ [a-z]+",
    "image.avatar": r"https://avatars\.example/[0-9a-f-]{36}\.png", "image.avatarGitHub": r"https://avatars\.example/u/[0-9]{8}", "image.dataUri": "data:image/svg.xml;charset=UTF-8,[a-z]+", "image.personPortrait": r"https://portraits\.example/(fe)?male/[0-9]{2}\.jpg", "image.url": r"https://images\.example/[0-9]{3,4}/[0-9]{3,4}",
    "image.urlPicsumPhotos": r"https://photos\.example/seed/[a-z0-9]{6}/[0-9]{3,4}/[0-9]{3,4}", "image.urlLoremFlickr": r"https://flickr\.example/[0-9]{3,4}/[0-9]{3,4}\?lock=[0-9]{4}",
    "internet.displayName": "[A-Z][a-z]+[0-9]{1,3}", "internet.domainName": r"[a-z]+-[a-z]+\.[a-z]+", "internet.domainWord": "[a-z]+-[a-z]+", "internet.email": r"[A-Z][a-z]+_[A-Z][a-z]+[0-9]{2}@[a-z]+-[a-z]+\.[a-z]+", "internet.exampleEmail": r"[A-Z][a-z]+_[A-Z][a-z]+[0-9]{2}@example\.com",
    "internet.ip": r"([0-9]{1,3}\.){3}[0-9]{1,3}", "internet.ipv4": r"([0-9]{1,3}\.){3}[0-9]{1,3}", "internet.ipv6": "([0-9a-f]{4}:){7}[0-9a-f]{4}", "internet.jwt": r"[a-z0-9]{10}\.[a-z0-9]{20}\.[a-z0-9]{10}", "internet.mac": "([0-9a-f]{2}:){5}[0-9a-f]{2}", "internet.password": "[a-z0-9]{15}",
    "internet.url": r"https?://[a-z]+-[a-z]+\.[a-z]+", "internet.userAgent": r"Mozilla/5\.0 \(X11; Linux x86_64\) Build/[0-9]{3}\.[0-9]", "internet.username": "[A-Z][a-z]+_[A-Z][a-z]+[0-9]{2}", "location.buildingNumber": "[0-9]{3}", "location.postalAddress": "[0-9]{3} [A-Z][a-z]+ Street, [A-Z][a-z]+",
    "location.secondaryAddress": r"Apt\. [0-9]{3}", "location.street": "[A-Z][a-z]+ Street", "location.streetAddress": "[0-9]{3} [A-Z][a-z]+ Street", "location.zipCode": "[0-9]{5}", "lorem.lines": r"([a-z]+ ){2}[a-z]+\.\n([a-z]+ ){2}[a-z]+\.", "lorem.paragraph": r"(([a-z]+ ){2}[a-z]+\. ?){3}", "lorem.paragraphs": r"(([a-z]+ ){2}[a-z]+\.[ \n]?){6}",
    "lorem.sentence": r"([a-z]+ ){2}[a-z]+\.", "lorem.sentences": r"(([a-z]+ ){2}[a-z]+\. ?){2}", "lorem.slug": "[a-z]+-[a-z]+-[a-z]+", "lorem.text": r"(([a-z]+ ){2}[a-z]+\. ?){2}", "lorem.words": "[a-z]+ [a-z]+ [a-z]+", "music.album": "[a-z]+ [a-z]+s", "music.artist": "The [a-z]+s", "music.songName": "[a-z]+ the [a-z]+",
    "number.binary": "[01]", "number.hex": "[0-9a-f]", "number.octal": "[0-7]", "number.romanNumeral": "M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})", "person.bio": "[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+, [a-z]+ enthusiast", "person.fullName": "[A-Z][a-z]+ [A-Z][a-z]+", "person.jobTitle": "[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+",
    "phone.imei": "[0-9]{15}", "phone.number": "[0-9]{3}-[0-9]{3}-[0-9]{4}", "string.alpha": "[a-z]", "string.alphanumeric": "[a-z0-9]", "string.binary": "0b[01]", "string.fromCharacters": "[a-z]", "string.hexadecimal": "0x[0-9a-f]", "string.nanoid": "[a-z0-9]{21}", "string.numeric": "[0-9]", "string.octal": "0o[0-7]", "string.sample": "[a-z0-9]{10}",
    "string.ulid": "01[0-9]{2}[A-HJ-NPR-Z0-9]{22}", "string.uuid": "[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}", "system.commonFileName": r"[a-z]+\.[a-z]+", "system.cron": r"[0-9] [0-9] \* \* [0-9]", "system.fileName": r"[a-z]+_[a-z]+\.[a-z]+", "system.filePath": r"/[a-z/]+/[a-z]+_[a-z]+\.[a-z]+",
    "system.networkInterface": "eth[0-9]", "system.semver": r"[0-9]\.[0-9]\.[0-9]", "vehicle.color": "[a-z]+", "vehicle.vehicle": "[A-Z][a-z]+ [A-Z][a-z]+", "vehicle.vin": "[A-HJ-NPR-Z0-9]{8}[0-9X][A-HJ-NPR-Z0-9]{4}[0-9]{4}", "vehicle.vrm": "[A-Z]{2}[0-9]{2}[A-Z]{3}", "word.sample": "[a-z]+", "word.words": "[a-z]+ [a-z]+",
}
DAY = 86_400_000
TRUTH = {
    **{f"color.{m}.channels": "size(v) = 3 AND forall(v, x -> x BETWEEN 0 AND 1)" for m in ("hsl", "hwb", "lab", "lch", "colorByCSSColorSpace")}, "color.rgb.channels": "size(v) = 3 AND forall(v, x -> x BETWEEN 0 AND 255)", "color.cmyk.channels": "size(v) = 4 AND forall(v, x -> x BETWEEN 0 AND 1)",
    "airline.airline": "v.name <> '' AND v.iataCode rlike '^[A-Z]{2}$'", "airline.airplane": "v.name <> '' AND v.iataTypeCode rlike '^[A-Z0-9]{3}$'", "airline.airport": "v.name <> '' AND v.iataCode rlike '^[A-Z]{3}$'", "datatype.boolean": "v OR NOT v", "finance.currency": "v.code rlike '^[A-Z]{3}$' AND v.name <> '' AND v.symbol <> '' AND v.numericCode rlike '^[0-9]{3}$'",
    "location.language": "v.name <> '' AND v.alpha2 rlike '^[a-z]{2}$' AND v.alpha3 rlike '^[a-z]{3}$'", "science.chemicalElement": "v.symbol rlike '^[A-Z][a-z]?$' AND v.name <> '' AND v.atomicNumber BETWEEN 1 AND 118", "science.unit": "v.name <> '' AND v.symbol <> ''",
    **{f"date.{m}": f"unix_millis(v) BETWEEN {CLOCK + a * DAY} AND {CLOCK + b * DAY}" for m, a, b in (("anytime", -3650, 3650), ("between", -365, 365), ("birthdate", -29200, -6570), ("future", 1, 365), ("past", -365, -1), ("recent", -1, 0), ("soon", 0, 1))},
    "date.betweens": f"size(v) = 3 AND v[0] <= v[1] AND v[1] <= v[2] AND forall(v, x -> unix_millis(x) BETWEEN {CLOCK - 365 * DAY} AND {CLOCK + 365 * DAY})", "internet.httpStatusCode": "v IN (200, 201, 204, 301, 400, 404, 500, 503)", "internet.port": "v BETWEEN 0 AND 65535", "location.latitude": "v BETWEEN -90 AND 90",
    "location.longitude": "v BETWEEN -180 AND 180", "location.nearbyGPSCoordinate": "v._0 BETWEEN -90 AND 90 AND v._1 BETWEEN -180 AND 180", "number.bigInt": "v BETWEEN 0 AND 999999999999999", "number.float": "v BETWEEN 0 AND 1", "number.int": "v BETWEEN 0 AND 9007199254740991",
}


def _shapes(spark, sf_dir):
    """For each entry that isn't a word of a list, how many rows have the shape it must have."""
    every = [n for n in names() if head_of(n) not in ("word", "enum")]
    flat = lambda n: n.replace(".", "_")
    wide = _world_maker(spark, T.object({flat(n): builder(n)() for n in every})).make_onto(read_table(spark, sf_dir, "customer"), C)
    ok = lambda n: F.col(flat(n)).rlike(f"^(?:{TEXT[n]})$") if n in TEXT else F.expr(re.sub(r"\bv\b", flat(n), TRUTH[n]))
    counts = wide.agg(*[F.count_if(ok(n)).alias(flat(n)) for n in every])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("entry"), F.col(flat(n)).alias("n")) for n in every])).alias("x")).select("x.entry", "x.n")


def _options(spark, sf_dir):
    """Builders with options."""
    V = q.V
    schema = T.object({
        "int": V.number.int(min=5, max=7), "words": V.lorem.words(count=5), "alpha": V.string.alpha(length=6), "letters": V.string.fromCharacters(characters="xyz", length=2), "past": V.date.past(years=2, ref_date=CLOCK), "between": V.date.between(from_=0, to=1000),
        "email": V.internet.email(username="ada"), "name": V.person.fullName(first_name="Zoe"), "price": V.commerce.price(min=5, max=6, digits=1, symbol="$"), "hex": V.number.hex(min=255, max=255), "roman": V.number.romanNumeral(min=14, max=14), "pin": V.finance.pin(length=6), "betweens": V.date.betweens(count=2),
        "monat": T.extend(vocabulary_extension("de")).vocab.date.month(), "own": T.extend(vocabulary_extension({"person.firstName": "Q"})).vocab.person.firstName(),
    })
    checks = {
        "int": "`int` BETWEEN 5 AND 7", "words": "`words` rlike '^([a-z]+ ){4}[a-z]+$'", "alpha": "`alpha` rlike '^[a-z]{6}$'", "letters": "`letters` rlike '^[xyz]{2}$'", "past": f"unix_millis(`past`) BETWEEN {CLOCK - 730 * DAY} AND {CLOCK - DAY}", "between": "unix_millis(`between`) BETWEEN 0 AND 1000", "email": "`email` LIKE 'ada@%'",
        "name": "`name` LIKE 'Zoe %'", "price": "`price` rlike '^[$][56][.][0-9]$'", "hex": "`hex` = 'ff'", "roman": "`roman` = 'XIV'", "pin": "`pin` rlike '^[0-9]{6}$'", "betweens": "size(`betweens`) = 2",
        "monat": "`monat` IN ('Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember')", "own": "`own` = 'Q'",
    }
    made = _world_maker(spark, schema).make_onto(read_table(spark, sf_dir, "customer"), C)
    counts = made.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in checks.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("option"), F.col(f"`{n}`").alias("n")) for n in checks])).alias("x")).select("x.option", "x.n")


CLOSED = {
    "date.month": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"], "date.weekday": ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"],
    "person.zodiacSign": ["Aries", "Taurus", "Gemini", "Cancer", "Leo", "Virgo", "Libra", "Scorpio", "Sagittarius", "Capricorn", "Aquarius", "Pisces"], "location.cardinalDirection": ["North", "East", "South", "West"], "internet.httpMethod": ["GET", "POST", "PUT", "DELETE", "PATCH"],
}


def _check_digits(spark, sf_dir):
    schema = T.object({"isbn": builder("commerce.isbn")(), "upc": builder("commerce.upc")(), "card": builder("finance.creditCardNumber")(), "iban": builder("finance.iban")(), "routing": builder("finance.routingNumber")(), "imei": builder("phone.imei")(), "vin": builder("vehicle.vin")()})
    return _world_maker(spark, schema).make_onto(read_table(spark, sf_dir, "customer"), C)


def _check_digits_sql() -> str:
    """The payloads by their draws, and check digits by sums over their characters."""
    def chars(path: str, template: str) -> str:
        parts = []
        for i, piece in enumerate(re.finditer(r"([#^])\1*|[^#^]+", template)):
            t = piece[0]
            letters = {"#": "0123456789", "^": "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"}.get(t[0])
            parts += [f"'{t}'"] if letters is None else [f"substr('{letters}', floor({u('string', path, key=C, k=f"'{i}.{j}'")} * {len(letters)}.0::DOUBLE)::INT + 1, 1)" for j in range(len(t))]
        return " || ".join(parts)

    total = lambda x, n, weigh: " + ".join(weigh(f"substr({x}, {k + 1}, 1)::INT", k) for k in range(n))
    ten = lambda s: f"((10 - ({s}) % 10) % 10)"
    cycle = lambda *w: lambda d, k: f"{d} * {w[k % len(w)]}"
    luhn = lambda n: lambda d, k: f"CASE WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END" if (n - k) % 2 else d
    luhns = lambda x, n: ten(" + ".join(f"({luhn(n)(f'substr({x}, {k + 1}, 1)::INT', k)})" for k in range(n)))
    vin_sum = " + ".join(f"(CASE WHEN substr(vin, {k + 1}, 1) BETWEEN '0' AND '9' THEN substr(vin, {k + 1}, 1)::INT ELSE substr('12345678123457923456789', strpos('ABCDEFGHJKLMNPRSTUVWXYZ', substr(vin, {k + 1}, 1)), 1)::INT END) * {w}" for k, w in enumerate((8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)))
    fields = {"isbn": "978#########", "upc": "###########", "card": "4##############", "iban": "##################", "routing": "########", "imei": "##############", "vin": "^^^^^^^^0^^^^####"}
    return (
        f"WITH p AS (SELECT {C}, {', '.join(f'{chars(n, t)} AS {n}' for n, t in fields.items())} FROM customer), v AS (SELECT *, ({vin_sum}) % 11 AS vd FROM p) "
        f"SELECT {C}, isbn || {ten(total('isbn', 12, cycle(1, 3)))} AS isbn, upc || {ten(total('upc', 11, cycle(3, 1)))} AS upc, card || {luhns('card', 15)} AS card, "
        f"'DE' || lpad((98 - ((iban || '131400')::HUGEINT % 97))::VARCHAR, 2, '0') || iban AS iban, routing || {ten(total('routing', 8, cycle(3, 7, 1)))} AS routing, imei || {luhns('imei', 14)} AS imei, "
        f"substr(vin, 1, 8) || CASE WHEN vd = 10 THEN 'X' ELSE vd::VARCHAR END || substr(vin, 10, 8) AS vin FROM v"
    )


# ---- tables of contracts


def _outcome(run: Callable) -> str:
    try:
        got = run()
    except EngineError as e:
        return type(e).__name__
    return got if isinstance(got, str) else json.dumps(got, sort_keys=True, ensure_ascii=False, default=str)


def _table(spark: SparkSession, cases: dict[str, Callable]) -> DataFrame:
    return spark.createDataFrame([(k, _outcome(f)) for k, f in cases.items()], "`case` string, outcome string")


def _table_sql(cases: dict[str, str]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return 'SELECT * FROM (VALUES ' + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in cases.items()) + ') t("case", outcome)'


def _errors(spark, sf_dir):
    w = q.world(spark)
    build = lambda s, **o: lambda: w.Maker(s, seed="x").make(1, **o).count()
    me = []
    T.recursive(lambda x: me.append(x) or T.array(x).whereby((0, 1)))
    symbol_keys = T.record(T.symbol(), T.null).whereby(1)
    deep = T.recursive(lambda x: T.tuple([T.array(x).whereby(1)] * 4)).whereby
    return _table(spark, {
        "InvalidCombinatorialLimitError": lambda: initialize(spark, limits={"combinatorial": 0}), "InvalidAttributionRootError": lambda: initialize(spark, attribution="relative"), "DetachedSelfError": build(me[0]), "UnterminableRecursiveError": lambda: T.recursive(lambda x: T.choice.uniform([x])).whereby(1),
        "UnknownKindError": lambda: T.object({"a": 3}), "EmptyItemsError": lambda: T.enum.uniform([]), "PrototypePollutionError": lambda: T.object({"__proto__": T.null}), "DetachedComputeError": build(T.compute(T.number()).as_(lambda f: 1)),
        "ComputeResultMismatchError": build(T.object({}).refine({"a": T.compute(T.number()).as_(lambda f: "x")})), "ComputeResultMismatchError of a column": build(T.object({"s": T.string.whereby(1)}).refine({"a": T.compute(T.number.integer()).as_(lambda f: f["s"])})),
        "UnknownOverrideFieldError": lambda: T.object({"a": T.null}).override({"b": 1}), "InvalidOverrideValueError": lambda: T.object({"a": T.number()}).override({"a": "x"}), "InvalidOverrideValueError of omitted": lambda: T.object({"a": T.nullable(T.number())}).override({"a": OMITTED}),
        "IllegalOmittedOverrideError": lambda: T.object({"a": T.number()}).override({"a": OMITTED}), "EnumerationIndexError": lambda: plan(T.boolean()).at(2), "UnpinnableKindError": lambda: plan(T.boolean()).decode(F.lit(0)).pick([F.lit(1)]), "CombinatorialLimitExceededError": lambda: w.fork(limits={"combinatorial": 3}).combinatorial(T.enum.uniform(list("abcd"))),
        "UnrepresentableRecordKeyError": lambda: to_json_schema(symbol_keys), "EmptyRangeError": lambda: T.number.whereby(2, 1), "EmptyRangeError of whole numbers": lambda: T.number.integer.whereby(exclusive(1), exclusive(2)), "EmptyRangeError of lengths": lambda: T.string.whereby((3, 1)), "EmptyRangeError of dates": build(T.date.past(datetime(2030, 1, 1))),
        "InvalidDistributionBoundError": build(T.number.whereby(0, 1, Logarithmic())), "InvalidWeightError": lambda: T.boolean.weighted(true=-1), "NoDrawableOutcomesError": lambda: T.enum.weighted([(0, 1)]), "TraceKindMismatchError": lambda: w.Maker(T.boolean(), kind="number"), "NoActiveScopeError": lambda: draw("person.firstName", None),
        "InvalidClockError": lambda: initialize(spark, clock=9_000_000_000_000_000), "PlanTooLargeError": build(deep(8)), "ClashingNameError": lambda: w.Maker(T.object({"id": T.null}), seed="x").make_onto(spark.range(1), "id"),
        "no error of check_weights": lambda: check_weights([0, 1]),
    })


ERRORS = [
    "InvalidCombinatorialLimitError", "InvalidAttributionRootError", "DetachedSelfError", "UnterminableRecursiveError", "UnknownKindError", "EmptyItemsError", "PrototypePollutionError", "DetachedComputeError", "ComputeResultMismatchError", "ComputeResultMismatchError of a column", "UnknownOverrideFieldError",
    "InvalidOverrideValueError", "InvalidOverrideValueError of omitted", "IllegalOmittedOverrideError", "EnumerationIndexError", "UnpinnableKindError", "CombinatorialLimitExceededError", "UnrepresentableRecordKeyError", "EmptyRangeError", "EmptyRangeError of whole numbers", "EmptyRangeError of lengths", "EmptyRangeError of dates",
    "InvalidDistributionBoundError", "InvalidWeightError", "NoDrawableOutcomesError", "TraceKindMismatchError", "NoActiveScopeError", "InvalidClockError", "PlanTooLargeError", "ClashingNameError",
]


def _instances(spark, sf_dir):
    base = initialize(spark, seed="a", clock=5, attribution="/root/of")
    number = T.number()
    here = "/root/of/dir/file.py"
    first = lambda w, **o: w.Maker(number, **o).make(1).first()[0]

    def with_env():
        before = dict(os.environ)
        os.environ["TESSERAE_SEED"] = "from env"
        try:
            return [env_seed(), list(normalize_seed(None))]
        finally:
            os.environ.clear()
            os.environ.update(before)

    def wrapped():
        w, sibling = base.fork(), base.fork(seed=layer("s"))
        with w.wrap(seed="k"), sibling.wrap(seed=layer("deep")) as scope:
            return [list(x.context.seed) for x in (w, sibling, scope)] + [list(w.fork(seed=layer("x")).seed)]

    def ordinals():
        w = base.fork()
        return [w.Maker(number, file="f").trace.ordinal, w.Maker(number, file="f").trace.ordinal, w.Maker(number, file="g").trace.ordinal, w.Maker(number, file="f", ordinal=9).trace.ordinal, w.Maker(number, file="f").trace.ordinal]

    trace_of = lambda m: m.trace.encode()
    built = base.Maker(T.object({"a": T.array(T.tuple([T.nullable(number)])).whereby(1)}), seed="z")
    return _table(spark, {
        "encode": lambda: Trace(("a", "é"), 5, path=("x", "0"), kind="enum").encode(), "normalize_seed": lambda: [list(normalize_seed(s)) for s in ("a", ["a", "b"], ("a",))], "env_seed": with_env, "random_seed": lambda: 0 <= int(random_seed()) < 2**32 and random_seed() != random_seed(),
        "layer": lambda: list(base.fork(seed=layer(["b", "c"])).seed), "clock given": lambda: base.context.clock, "clock seeded": lambda: initialize(spark, seed="abc", clock="seeded").context.clock == derive_clock(("abc",)), "clock of the wall": lambda: abs(initialize(spark).context.clock - epoch_ms(datetime.now(timezone.utc))) < 60_000,
        "attribution none": lambda: initialize(spark, seed="a", clock=5, attribution="none").Maker(number).trace.file, "attribution rooted": lambda: relativize("/root/of", here), "attribution ascends": lambda: relativize("/root/of/other", here), "attribution by default": lambda: initialize(spark, seed="a").Maker(number).trace.file == os.path.basename(caller_file()),
        "attribution of a URL": lambda: initialize(spark, attribution="file:///a%20b").context.root, "fork keeps its parent": lambda: [list(base.fork(seed="f").seed), base.fork(clock=7).context.clock, base.fork().context.limit, base.fork(limits={"combinatorial": 9}).context.limit], "wrap": wrapped,
        "wrap ends": lambda: list(base.context.seed), "fork draws alike": lambda: first(base.fork(seed="k"), file="f") == first(base.fork(seed="k"), file="f"), "constructions differ": lambda: (lambda w: first(w, file="f") != first(w, file="f"))(base.fork()), "ordinals": ordinals,
        "pins": lambda: trace_of(base.Maker(number, clock=6, root="attributed", file="f", path=("p",), kind="number", ordinal=3)), "trace of a seed": lambda: trace_of(base.Maker(number, seed=layer("more"))), "replay": lambda: trace_of(base.Maker(number, trace=Trace(("z",), 1, "attributed", "f", ("p",), "number", 2))),
        "children": lambda: [list(built.children), list(built.children["a"].children), list(built.children["a"].children["element"].children), list(built.children["a"].children["element"].children["0"].children)], "rehydrate": lambda: [base.Maker(built).schema.kind, list(built.schema.meta["fields"])],
        "registry extends": lambda: [sorted(T.extend({"mine": {"a": number}}).mine.__dir__()), hasattr(T, "mine")], "registry replaces": lambda: [sorted(T.extend({"m": {"a": number, "b": number}}).extend({"m": more}).m.__dir__()) for more in ({"c": number}, whole_value({"c": number}))], "limit": lambda: base.combinatorial(T.enum.uniform(list(range(1024)))).count(),
    })


INSTANCES = {
    "encode": '[["a","é"],5,"unattributed",null,["x","0"],"enum",null]', "normalize_seed": '[["a"], ["a", "b"], ["a"]]', "env_seed": '["from env", ["from env"]]', "random_seed": "true", "layer": '["a", "b", "c"]', "clock given": "5", "clock seeded": "true", "clock of the wall": "true",
    "attribution none": "null", "attribution rooted": "dir/file.py", "attribution ascends": "../dir/file.py", "attribution by default": "true", "attribution of a URL": "/a b", "fork keeps its parent": '[["f"], 7, 1024, 9]', "wrap": '[["k", "deep"], ["k", "deep"], ["k", "deep"], ["a", "x"]]', "wrap ends": '["a"]',
    "fork draws alike": "true", "constructions differ": "true", "ordinals": "[0, 1, 0, 9, 2]", "pins": '[["a"],6,"attributed","f",["p"],"number",3]', "trace of a seed": '[["a","more"],5,"unattributed",null,[],"number",null]', "replay": '[["z"],1,"attributed","f",["p"],"number",2]',
    "children": '[["a"], ["element"], ["0"], ["definition"]]', "rehydrate": '["object", ["a"]]', "registry extends": '[["a"], false]', "registry replaces": '[["a", "b", "c"], ["c"]]', "limit": "1024",
}


def _schemas(spark, sf_dir):
    V = q.V
    layered = T.string.whereby(1).adapt(JsonSchema(), lambda s, m, below: {**below(), "x": 1}).adapt(JsonSchema(), lambda s, m, below: {**below(), "y": 2})
    tree = T.recursive(lambda me: T.object({"k": T.array(me).whereby((0, 2))})).whereby(2)
    cases = {
        "number": T.number(), "number from": T.number.whereby(min=0), "number within": T.number.whereby(exclusive(0), 5), "integer": T.number.integer.whereby(exclusive(0), 9), "bigint": T.bigint.whereby(10, min=0), "date": T.date.whereby(1000, exclusive(3000)), "date past": T.date.past(exclusive(1000)),
        "string": T.string.whereby((1, 8)), "boolean": T.boolean(), "enum": T.enum.weighted([(1, "a"), (0, "b"), (2, 3)]), "always": T.always({"a": [1, "x"]}), "null": T.null, "undefined": T.undefined, "nullable": T.nullable(T.boolean()), "undefinable": T.undefinable(T.boolean()), "nullish": T.nullish(T.boolean()),
        "object": T.object({"a": T.boolean(), "o": T.omittable(T.boolean()), "p": T.optional(T.boolean())}), "computed": T.object({}).refine({"c": T.compute(T.number()).as_(lambda f: 1.0)}), "array": T.array(T.boolean()).whereby(3), "tuple": T.tuple([T.boolean(), T.null]), "record": T.record(T.string.whereby((1, 2)), T.boolean()).whereby({"max": 4}),
        "choice": T.choice.uniform([T.boolean(), T.null]), "recursive": tree, "opaque": T.opaque(lambda c: F.lit(1), "int"), "adapted": layered, "hints": T.string.as_(lambda c: F.lit(""), format="email"), "vocabulary email": V.internet.email(), "vocabulary enum": V.internet.protocol(), "vocabulary port": V.internet.port(),
        "vocabulary date": V.date.past(), "vocabulary object": V.science.unit(), "vocabulary tuple": V.location.nearbyGPSCoordinate(), "vocabulary pattern": V.database.mongodbObjectId(), "vocabulary channels": V.color.rgb.channels(), "vocabulary bigint": V.number.bigInt(), "vocabulary boolean": V.datatype.boolean(), "use": V.use.string(lambda c: F.lit("k")),
    }
    rows = {k: (lambda s: lambda: drive(JsonSchema(), s))(s) for k, s in cases.items()}
    entries = {n: to_json_schema(builder(n)()) for n in names()}
    rows["unknown among the vocabulary"] = lambda: [n for n, j in entries.items() if j == {}]
    rows["hinted entries"] = lambda: sum(j.get("type") == "string" and j.get("format", "date-time") != "date-time" or "pattern" in j for j in entries.values())
    rows["violates_kind"] = lambda: [violates_kind(*x) for x in (("number", 1), ("number", "1"), ("string", 1), ("boolean", 0), ("array", [1]), ("object", []), ("enum", object()), ("null", None), ("date", 5), ("bigint", True))]
    rows["bounds"] = lambda: [effective_discrete(Bound(1, True), Bound(4, True)), effective_discrete(Bound(0.5), Bound(2.5)), length_range(3), length_range({"max": 2}), unit_position(5, 0, 10)]
    rows["terminate"] = lambda: [terminate(T.array(T.boolean()).whereby(2)).meta["high"], terminate(tree.meta["body"]).meta["fields"]["k"].meta["high"], contains_self(tree.meta["body"]), contains_self(tree)]
    rows["widths"] = lambda: [plan(s).width for s in (T.boolean(), T.number(), T.optional(T.boolean()), T.tuple([T.boolean(), T.enum.uniform([1, 2, 3])]), T.choice.uniform([T.boolean(), T.null]))]
    return _table(spark, rows)


SCHEMAS = {
    "number": '{"type": "number"}', "number from": '{"minimum": 0, "type": "number"}', "number within": '{"exclusiveMinimum": 0, "maximum": 5, "type": "number"}', "integer": '{"maximum": 9, "minimum": 1, "type": "integer"}', "bigint": '{"maximum": 10, "minimum": 0, "type": "integer"}',
    "date": '{"format": "date-time", "maximumTimestamp": 2999, "minimumTimestamp": 1000, "type": "string"}', "date past": '{"exclusiveMinimumTimestamp": 1000, "format": "date-time", "type": "string"}', "string": '{"maxLength": 8, "minLength": 1, "type": "string"}', "boolean": '{"type": "boolean"}', "enum": '{"anyOf": [{"const": "a"}, {"const": 3}]}',
    "always": '{"additionalProperties": false, "properties": {"a": {"maxItems": 2, "minItems": 2, "prefixItems": [{"const": 1}, {"const": "x"}], "type": "array"}}, "required": ["a"], "type": "object"}', "null": '{"type": "null"}', "undefined": '{"$comment": "undefined", "not": {}}', "nullable": '{"anyOf": [{"type": "boolean"}, {"type": "null"}]}',
    "undefinable": '{"anyOf": [{"type": "boolean"}, {"$comment": "undefined", "not": {}}]}', "nullish": '{"anyOf": [{"type": "boolean"}, {"type": "null"}, {"$comment": "undefined", "not": {}}]}',
    "object": '{"additionalProperties": false, "properties": {"a": {"type": "boolean"}, "o": {"type": "boolean"}, "p": {"anyOf": [{"type": "boolean"}, {"$comment": "undefined", "not": {}}]}}, "required": ["a"], "type": "object"}', "computed": '{"additionalProperties": false, "properties": {"c": {"type": "number"}}, "required": ["c"], "type": "object"}',
    "array": '{"items": {"type": "boolean"}, "maxItems": 3, "minItems": 3, "type": "array"}', "tuple": '{"maxItems": 2, "minItems": 2, "prefixItems": [{"type": "boolean"}, {"type": "null"}], "type": "array"}', "record": '{"additionalProperties": {"type": "boolean"}, "maxProperties": 4, "propertyNames": {"maxLength": 2, "minLength": 1, "type": "string"}, "type": "object"}',
    "choice": '{"anyOf": [{"type": "boolean"}, {"type": "null"}]}', "recursive": '{"$defs": {"r0": {"additionalProperties": false, "properties": {"k": {"items": {"$ref": "#/$defs/r0"}, "maxItems": 2, "minItems": 0, "type": "array"}}, "required": ["k"], "type": "object"}}, "$ref": "#/$defs/r0"}', "opaque": "{}",
    "adapted": '{"maxLength": 1, "minLength": 1, "type": "string", "x": 1, "y": 2}', "hints": '{"format": "email", "type": "string"}', "vocabulary email": '{"format": "email", "type": "string"}', "vocabulary enum": '{"anyOf": [{"const": "http"}, {"const": "https"}]}', "vocabulary port": '{"type": "number"}',
    "vocabulary date": '{"format": "date-time", "type": "string"}', "vocabulary object": '{"additionalProperties": false, "properties": {"name": {"type": "string"}, "symbol": {"type": "string"}}, "required": ["name", "symbol"], "type": "object"}', "vocabulary tuple": '{"maxItems": 2, "minItems": 2, "prefixItems": [{"type": "number"}, {"type": "number"}], "type": "array"}',
    "vocabulary pattern": '{"pattern": "^[0-9a-fA-F]{24}$", "type": "string"}', "vocabulary channels": '{"items": {"type": "number"}, "type": "array"}', "vocabulary bigint": '{"type": "integer"}', "vocabulary boolean": '{"type": "boolean"}', "use": '{"type": "string"}',
    "unknown among the vocabulary": "[]", "hinted entries": "17", "violates_kind": "[false, true, true, true, false, true, false, false, false, true]", "bounds": "[[2, 3], [1, 2], [3, 3], [0, 2], 0.5]", "terminate": "[2, 0, true, false]", "widths": "[2, 1, 4, 6, 3]",
}


# ---- all together


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    nested = lambda: T.object({"a": T.array(T.undefinable(T.number.integer.whereby(0, 9))).whereby((0, 3)), "r": T.array(T.nullable(T.always(1))).whereby(2)})
    return {
        "q_root_nullable": then(on("orders", O, lambda: T.nullable(T.object({"a": T.number.integer.whereby(0, 9)}))), O, "value.a a", "value__presence"),
        "q_root_optional_scalar": on("orders", O, lambda: T.undefinable(T.number.integer.whereby(0, 9))),
        "q_null_key": _null_key,
        "q_sequence_string": on("customer", "c_name", lambda: T.object({"n": T.number.integer.sequence()})),
        "q_sequence_array": then(on("customer", C, lambda: T.object({"a": T.array(T.tuple([T.number.integer.sequence(), T.array(T.number.integer.sequence()).whereby(2)])).whereby(3)})), C, "a[1]._0 one", "a[2]._1[1] two"),
        "q_array_presence": then(on("customer", C, nested), C, "size(a) n", "size(filter(a, x -> x.presence = 'undefined')) undefined", "aggregate(a, 0L, (s, x) -> s + coalesce(x.value, 0L)) total", "size(filter(r, x -> x IS NULL)) nulls"),
        "q_custom_algorithm": _custom_algorithm,
        "q_xxhash64": _xxhash64,
        "q_sample": _sample,
        "q_quantiles": _quantiles,
        "q_integer_big": then(on("customer", C, lambda: T.object({"b": T.number.integer.big.whereby(2**100 + 5, min=-3)})), C, "cast(b as string) b"),
        "q_bigint_text": then(on("customer", C, lambda: T.object({"b": T.bigint.whereby(10**60, min=10**60 - 7)})), C, "b"),
        "q_string_classes": on("part", P, lambda: T.object({"u": T.string.whereby(5, {"uppercase": 1}), "y": T.string.whereby(2, {"symbol": 1}), "a": T.string.whereby(1, {"bmp": 1})})),
        "q_string_scalars": then(on("part", P, lambda: T.object({"s": T.string.whereby(1)})), P, "s"),
        "q_future_until": then(on("orders", O, lambda: T.object({"f": T.date.future(CLOCK + 1000)})), O, "unix_millis(f) f"),
        "q_json_recursion": on("customer", C, _json_recursion),
        "q_rehydrated": _rehydrated,
        "q_overridden_producer": _overridden_producer,
        "q_element_replay": _element_replay,
        "q_stream": _stream,
        "q_unchecked_overrides": _unchecked,
        "q_wide_enum": _wide_enum,
        "q_wide_coverage": _wide_coverage,
        "q_producers": then(on("customer", C, _producers), C, "boolean", "unix_millis(date) date", "cast(bigint as bigint) big", "symbol", "`enum` e", "choice", "`tuple`._0 t0", "`tuple`._1 t1", "array[0] a0", "array[1] a1", "record['k'] r", "nullable", "undefinable", "nullish", "omittable", "optional", "text", "`integer` i"),
        "q_constraints_nested": _constraints_nested,
        "q_constraints_made": _constraints_made,
        "q_vocab_shapes": _shapes,
        "q_vocab_options": _options,
        "q_vocab_closed": on("customer", C, lambda: T.object({n.split(".")[1]: builder(n)() for n in CLOSED})),
        "q_vocab_check_digits": _check_digits,
        "q_errors": _errors,
        "q_instances": _instances,
        "q_schemas": _schemas,
    }


def oracle_sql() -> dict[str, str]:
    o, c, p = O, C, P
    nullable = u("nullable", key=o)
    undefinable = u("undefinable", key=o)
    key = f"coalesce((CASE WHEN {o} % 5 <> 0 THEN {o} END)::VARCHAR, '∅')"
    sha = lambda kind, path, k: f"(('0x' || substr(sha256('{prefix(kind, *path)}#' || {c} || '#' || {k}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    sha_char = lambda i: pick(sha("string", ("s",), f"'c' || {i} || '.s'"), (1, f"97 + floor({sha('string', ('s',), f"'c' || {i} || '.r'")} * 26.0::DOUBLE)::INT"), (1, f"48 + floor({sha('string', ('s',), f"'c' || {i} || '.r'")} * 10.0::DOUBLE)::INT"))
    n_elements = whole(u("array", "a", key=c), 0, 3)
    there = lambda i: f"{u('undefinable', 'a', 'element', key=f'{c} || {chr(39)}.{chr(39)} || {i}')} * 2.0::DOUBLE >= 1.0::DOUBLE"
    element = lambda i: whole(u("number.integer", "a", "element", "definition", key=f"{c} || '.' || {i}"), 0, 9)
    is_null = lambda i: f"{u('nullable', 'r', 'element', key=f'{c} || {chr(39)}.{chr(39)} || {i}')} * 2.0::DOUBLE < 1.0::DOUBLE"
    big = lambda a, bits: " + ".join(f"floor({lane('bigint', 'b', key=c, k=f"'a' || {a} || '.0'", i=str(i))} * {float(1 << n)}::DOUBLE)::HUGEINT * {1 << (32 * i)}::HUGEINT" for i, n in enumerate([32] * (bits // 32) + [bits % 32] * (bits % 32 > 0)))
    bmp = lambda x: f"CASE WHEN {x} < 55296 THEN {x} ELSE {x} - 55296 + 57344 END"
    scalar = f"floor({u('string', 's', key=p, k="'c0.r'")} * 1112064.0::DOUBLE)::INT"
    filler = f"floor({u('string', 's', key=p, k="'c0.f'")} * 63488.0::DOUBLE)::INT"
    symbols = "".join(chr(k) for a, b in ((33, 47), (58, 64), (91, 96), (123, 126)) for k in range(a, b + 1)).replace("'", "''")
    j, j0, j1 = ("j", "@0"), ("j", "@0", "0"), ("j", "@0", "1")
    inner = lambda i: whole(u("number.integer", *j1, "element", "@1", "0", key=f"{c} || '.' || {i}"), 0, 9)
    uc = lambda kind, name, k=0: u(kind, name, key=c, k=f"'{k}'")
    live = [(k % 3, f"v{k}") for k in range(40) if k % 3]
    ends, run = [], 0
    for w, _ in live:
        run += w
        ends.append(run)
    weighed = f"({[v for _, v in live]!r})[len(list_filter({ends!r}, lambda e: e <= {u('enum', 'w', key=o)} * {float(run)}::DOUBLE)) + 1]"
    shapes = " UNION ALL ".join(f"SELECT '{n}' AS entry, count(*) AS n FROM customer" for n in names() if head_of(n) not in ("word", "enum"))
    options = " UNION ALL ".join(f"SELECT '{n}' AS option, count(*) AS n FROM customer" for n in ("int", "words", "alpha", "letters", "past", "between", "email", "name", "price", "hex", "roman", "pin", "betweens", "monat", "own"))
    return {
        "q_root_nullable": f"SELECT {o}, {pick(nullable, (1, 'NULL'), (1, whole(u('number.integer', 'definition', 'a', key=o), 0, 9)))} AS a, {pick(nullable, (1, "'null'"), (1, "'value'"))} AS value__presence FROM orders",
        "q_root_optional_scalar": f"SELECT {o}, {pick(undefinable, (1, 'NULL'), (1, whole(u('number.integer', 'definition', key=o), 0, 9)))} AS value, {pick(undefinable, (1, "'undefined'"), (1, "'value'"))} AS value__presence FROM orders",
        "q_null_key": f"SELECT CASE WHEN {o} % 5 <> 0 THEN {o} END AS k, {whole(u('number.integer', 'x', key=key), 0, 9)} AS x FROM orders",
        "q_sequence_string": "SELECT c_name, row_number() OVER (ORDER BY c_name) AS n FROM customer",
        "q_sequence_array": f"SELECT {c}, (r - 1) * 3 + 2 AS one, ((r - 1) * 3 + 2) * 2 + 2 AS two FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS r FROM customer)",
        "q_array_presence": f"SELECT {c}, {n_elements}::INT AS n, len(list_filter(range({n_elements}), lambda i: NOT ({there('i')})))::INT AS undefined, coalesce(list_sum(list_transform(list_filter(range({n_elements}), lambda i: {there('i')}), lambda i: {element('i')})), 0)::BIGINT AS total, len(list_filter(range(2), lambda i: {is_null('i')}))::INT AS nulls FROM customer",
        "q_custom_algorithm": f"SELECT {c}, {at(sha('number', ('x',), "'0'"), 0, 1)} AS x, array_to_string(list_transform(range(3), lambda i: chr({sha_char('i')})), '') AS s, floor({sha('bigint', ('b',), "'a0.0'")} * 4294967296.0::DOUBLE)::BIGINT + floor({sha('bigint', ('b',), "'a0.1'")} * 256.0::DOUBLE)::BIGINT * 4294967296 AS b FROM customer",
        "q_xxhash64": "SELECT count(*) AS n, count(*) AS inside, true AS even, count(*) AS digits FROM orders",
        "q_sample": f"SELECT {c}, ({q.SEGMENTS!r})[floor({u('sample', key=c)} * 5.0::DOUBLE)::INT + 1] AS sampled FROM customer",
        "q_quantiles": "SELECT (i / 4.0)::DOUBLE AS z, true AS inverse FROM range(-11, 12) r(i)",
        "q_integer_big": f"SELECT {c}, ((list_filter(list_transform(range(64), lambda a: {big('a', 101)}), lambda v: v < {2**100 + 9}::HUGEINT))[1] - 3)::VARCHAR AS b FROM customer",
        "q_bigint_text": f"SELECT {c}, CASE WHEN d = 7 THEN '1' || repeat('0', 60) ELSE repeat('9', 59) || (d + 3)::VARCHAR END AS b FROM (SELECT {c}, floor({lane('bigint', 'b', key=c, k="'a0.0'", i='0')} * 8.0::DOUBLE)::INT AS d FROM customer)",
        "q_string_classes": f"SELECT {p}, {q._chars((), p, '5', lambda i: q._class_char(('u',), p, i, [(1, 65, 26)]))} AS u, array_to_string(list_transform(range(2), lambda i: substr('{symbols}', floor({lane('string', 'y', key=p, k="'c0'", i='i')} * {float(len(symbols.replace(chr(39) * 2, chr(39))))}::DOUBLE)::INT + 1, 1)), '') AS y, chr({bmp(f"floor({lane('string', 'a', key=p, k=chr(39) + 'c0' + chr(39), i='0')} * 63488.0::DOUBLE)::INT")}) AS a FROM part",
        "q_string_scalars": f"SELECT {p}, chr(CASE WHEN {scalar} < 63488 THEN {bmp(scalar)} ELSE {bmp(filler)} END) AS s FROM part",
        "q_future_until": f"SELECT {o}, {whole(u('date', 'f', key=o), CLOCK, CLOCK + 1000)} AS f FROM orders",
        "q_json_recursion": f"SELECT {c}, {pick(u('choice', *j, key=c), (1, f'({whole(u("number.integer", *j0, key=c), 0, 9)})::VARCHAR'), (1, f"'[' || array_to_string(list_transform(range({whole(u('array', *j1, key=c), 0, 2)}), lambda i: ({inner('i')})::VARCHAR), ',') || ']'"))} AS j FROM customer",
        "q_rehydrated": f"SELECT {o}, {whole(u('number.integer', 'inner', 'a', key=o), 0, 9)} AS a, {whole(u('number.integer', 'b', key=o), 0, 9)} AS b FROM orders",
        "q_overridden_producer": f"SELECT {c}, {u('object', key=c)} AS a, 'mine' AS z FROM customer",
        "q_element_replay": f"SELECT {c} || '.1' AS k, {whole(u('number.integer', 'element', key=f"{c} || '.1'"), 0, 99)} AS value FROM customer",
        "q_stream": f"SELECT {c}, {whole(u('number.integer', 'x', key=c), 0, 9)} AS x, {c} + 1 AS n FROM customer",
        "q_unchecked_overrides": f"SELECT {o}, {whole(u('number.integer', 'a', key=o), 0, 9)} AS a, CASE WHEN {o} % 2 = 0 THEN 'given' ELSE {pick(u('optional', 'o', key=o), (1, 'NULL'), (1, 'NULL'), (1, "'x'"))} END AS o, CASE WHEN {o} % 2 = 0 THEN 'value' ELSE {pick(u('optional', 'o', key=o), (1, "'omitted'"), (1, "'undefined'"), (1, "'value'"))} END AS o__presence FROM orders",
        "q_wide_enum": f"SELECT {o}, (1000 + floor({u('enum', 'e', key=o)} * 5000.0::DOUBLE))::BIGINT AS e, {weighed} AS w FROM orders",
        "q_wide_coverage": "SELECT 5000::BIGINT AS rows, 5000::BIGINT AS members, 2500::BIGINT AS \"true\", 12497500::BIGINT AS total",
        "q_producers": f"SELECT {c}, {uc('boolean', 'boolean')} < 0.5 AS boolean, {CLOCK}::BIGINT AS date, floor({uc('bigint', 'bigint')} * 10)::BIGINT AS big, 'Symbol()' AS symbol, CASE WHEN {uc('enum', 'enum')} < 0.5 THEN 'a' ELSE 'b' END AS e, floor({uc('choice', 'choice')} * 2)::BIGINT AS choice, 1.5::DOUBLE AS t0, 't' AS t1, {uc('array', 'array')} AS a0, {uc('array', 'array', 1)} AS a1, "
        f"{uc('record', 'record')} AS r, CASE WHEN {uc('nullable', 'nullable')} < 0.5 THEN 1.0::DOUBLE END AS nullable, 2.0::DOUBLE AS undefinable, 3.0::DOUBLE AS nullish, 4.0::DOUBLE AS omittable, 5.0::DOUBLE AS optional, 'made' AS text, 6::BIGINT AS i FROM customer",
        "q_constraints_nested": "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding[1:3], lambda x: NOT (x::DOUBLE >= -0.15 AND x::DOUBLE < 0.2))) = 0 AND (label BETWEEN 0 AND 2 OR label BETWEEN 5 AND 6)",
        "q_constraints_made": f"SELECT {c}, true AS conforms FROM customer",
        "q_vocab_shapes": shapes,
        "q_vocab_options": options,
        "q_vocab_closed": f"SELECT {c}, " + ", ".join(f"{among(values, u('enum' if n == 'internet.httpMethod' else 'string', n.split('.')[1], key=c))} AS \"{n.split('.')[1]}\"" for n, values in CLOSED.items()) + " FROM customer",
        "q_vocab_check_digits": _check_digits_sql(),
        "q_errors": _table_sql({**{k: k.split(" ")[0] for k in ERRORS}, "no error of check_weights": "null"}),
        "q_instances": _table_sql(INSTANCES),
        "q_schemas": _table_sql(SCHEMAS),
    }
