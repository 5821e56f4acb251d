"""Exact deduplication as a stateful stream, with DataFrame and SQL functions only.

A structured stream of documents keeps state by text digest (SHA-256 of the text with
A-Z lower-cased): the stable identifier of the row that stays (the largest doc_id), the
locator of its content (the file that holds it) and the number of rows seen. The state
lies in RocksDB on the executors' disks, has no watermark and never expires, and is
checkpointed to the shared folder after each micro-batch. Each micro-batch writes the
keys it changed; the last version of a key is its state. With a state folder of the
caller's, the stream goes on from there whenever it is run again, and reads only files that are new.

A digest that comes again is a hit. Hits are checked on full bytes: the text at the
state's locator, under its identifier, is compared with the text of each hit. Only texts of
hits are moved: their rows are found by a 64-bit hash of the text, broadcast where the hashes
are few (HITS_BROADCAST), joined otherwise. The texts of a large group are spread by a salt, and
the locator's text goes to each part once. A hit whose bytes differ isn't a copy; such
rows, and those whose locator leads to no text any more, are grouped by their text itself.

Defined results: null text counts as empty. Repeated rows (equal doc_id and text)
are copies of which one row stays. Null doc_id is below every other. An empty table
gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import release, remove, stored, work_dir

HITS_BROADCAST = 2_000_000  # 64-bit hashes
GROUP_ROWS = 500  # texts of a group that are compared in one part

STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # many small stores: files grow as they fill instead of by megabytes in advance, and batches upload changes
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """A-Z to a-z and nothing else; the fast path of lower() where the text is ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def run_stream(stream: DataFrame, digest=sha256_digest, locator: Column | None = None, state_dir: str | None = None) -> DataFrame:
    """Runs the stream of documents to its end; one row a digest: digest, keep_id, seen, at. `state_dir` (below a shared folder) keeps the state for later runs."""
    spark = stream.sparkSession
    top = state_dir.rstrip("/") if state_dir else work_dir(spark, "dedup-stream")
    keyed = stream.select("doc_id", digest(normalised(F.col("text"))).alias("digest"), (F.lit(None).cast("string") if locator is None else locator).alias("at"))
    state = keyed.groupBy("digest").agg(F.max(F.struct(F.col("doc_id"), F.col("at"))).alias("top"), F.count(F.lit(1)).alias("seen"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.at").alias("at"), "seen", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{top}/changes/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).foreachBatch(changed).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = dict(stream.select("doc_id").dtypes)["doc_id"]
    schema = f"digest string, keep_id {kind}, at string, seen long, batch int"
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/changes")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], "digest string, keep_id " + kind + ", at string, seen long")
    last = F.max_by(F.struct("keep_id", "at", "seen"), F.col("batch")).alias("s")
    out = spark.read.schema(schema).parquet(f"{top}/changes").groupBy("digest").agg(last).select("digest", "s.keep_id", "s.at", "s.seen")
    out = stored(out, f"{work_dir(spark, 'dedup-state')}/state")
    if not state_dir:
        remove(spark, f"{top}/checkpoint")
        remove(spark, f"{top}/changes")
        release(spark)
    return out


def deduplicate(docs: DataFrame, state: DataFrame, digest=sha256_digest, locator: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, given the state that run_stream() left. `locator` says of a row of docs what the state's `at` says of the keeper."""
    spark = docs.sparkSession
    top = work_dir(spark, "dedup")
    at = F.lit(None).cast("string") if locator is None else locator
    text = normalised(F.col("text"))
    hashed = docs.select("doc_id", digest(text).alias("digest"), sha256_digest(text).alias("text_sha256"), F.xxhash64("text").alias("h"))
    if digest is sha256_digest:
        hashed = hashed.withColumn("text_sha256", F.col("digest"))
    # stored with a number for each row, which tells rows apart that are equal otherwise
    rows = stored(hashed.join(state.select("digest", "keep_id", "seen"), "digest").withColumn("row", F.monotonically_increasing_id()), f"{top}/rows")

    hits = stored(rows.filter("seen > 1").select("h").distinct(), f"{top}/hits")
    hit = state.filter("seen > 1").select("digest", "keep_id", F.col("at").alias("keep_at"), F.ceil(F.col("seen") / GROUP_ROWS).cast("int").alias("parts"))
    few = F.broadcast if hits.count() <= HITS_BROADCAST else lambda df: df
    moved = docs.select("doc_id", "text", at.alias("at")).withColumn("h", F.xxhash64("text")).join(few(hits), "h", "left_semi")
    moved = moved.select("doc_id", "at", text.alias("t")).withColumn("digest", digest(F.col("t")))
    texts = stored(moved.join(hit, "digest").withColumn("part", (F.rand(1) * F.col("parts")).cast("int")), f"{top}/texts")
    keeper = texts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("at").eqNullSafe(F.col("keep_at"))).groupBy("digest", "parts").agg(F.min("t").alias("kt"))
    keeper = keeper.select("digest", "kt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    clash = stored(texts.join(keeper, ["digest", "part"], "left").filter(~F.col("t").eqNullSafe(F.col("kt"))).select("digest").distinct(), f"{top}/clash")
    if clash.isEmpty():
        remove(spark, f"{top}/texts")
        final = rows.select("row", "doc_id", "keep_id", F.col("seen").alias("group_size"), "text_sha256")
    else:
        # digests that stand for several texts: their rows go by the bytes, of which text_sha256 stands for the text
        fine = rows.join(clash, "digest", "left_anti").select("row", "doc_id", "keep_id", F.col("seen").alias("group_size"), "text_sha256")
        groups = texts.join(clash, "digest", "left_semi").groupBy("t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.select("keep_id", "group_size", sha256_digest(F.col("t")).alias("text_sha256"))
        final = fine.unionByName(rows.join(clash, "digest", "left_semi").select("row", "doc_id", "text_sha256").join(groups, "text_sha256"))
    # of rows that share the largest doc_id of their group, the first in number stays; partial minima, and only such groups are joined
    mine = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    shared = final.filter(mine).groupBy("text_sha256").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    shared = stored(shared, f"{top}/shared")
    return final.join(shared, "text_sha256", "left").select("doc_id", "keep_id", "group_size", (mine & F.coalesce(F.col("row") == F.col("_first"), F.lit(True))).alias("kept"), "text_sha256")


def document_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files at `path`, a folder or one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        reader = reader.option("pathGlobFilter", place.getName())
        path = place.getParent().toString()
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def deduplicate_path(spark: SparkSession, path: str, files_per_batch: int | None = None, digest=sha256_digest, state_dir: str | None = None) -> DataFrame:
    """The rows of the Parquet files at `path`. With a `state_dir`, files that an earlier run has seen aren't streamed again."""
    file = F.col("_metadata.file_path")
    state = run_stream(document_stream(spark, path, files_per_batch), digest, file, state_dir)
    return deduplicate(spark.read.parquet(path), state, digest, file)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
