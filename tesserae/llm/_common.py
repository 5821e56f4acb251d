"""Shared pieces: the shared work folder, Arrow text chunks, byte-level word scans and hashes.

Words are found on UTF-8 bytes. Both word classes used here are unions of ASCII
classes and "every byte from 0x80", so a scan of bytes gives the same words as a
scan of code points. A word's 64-bit hash is a polynomial over random byte codes,
computed for all words of a chunk at once from one running sum.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK = 1 << 20
BATCH_BYTES = 32 << 20
TRIM = "systemTrimNativeHeap"  # a command of newer JVMs, on Linux

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACED = np.ones(256, dtype=bool)  # [^\x20\x09-\x0D]
SPACED[[32, 9, 10, 11, 12, 13]] = False

ALNUM = np.zeros(256, dtype=bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = _BASE if name == "up" else _BASE_INV
        run = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        run[0] = 1
        _powers[name] = have = np.cumprod(run, dtype=np.uint64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, bytes, offsets from 0) for runs of whole texts of about `limit` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


class Words:
    """Words of a chunk: byte ranges, the row of each, and the first word of each row (`at`, one longer than rows)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray = SPACED, lower: bool = True):
        self.data = LOWER[data] if lower else data
        inside = table[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        begins = off[:-1][off[:-1] < off[1:]]
        if len(begins):
            first[begins] = inside[begins]
            ends = begins[1:] - 1
            last[ends] = inside[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self, *cuts: int) -> list[np.ndarray]:
        """Hashes of whole words, then for each cut p: of the first p bytes (p > 0) or the last -p bytes (p < 0)."""
        out = [np.empty(len(self), dtype=np.uint64) for _ in range(1 + len(cuts))]
        a = 0
        while a < len(self):
            base = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, base + 4 * CHUNK, side="right")))
            stop = self.end[b - 1]
            codes = _CODES[self.data[base:stop]] * _power("up", stop - base)[: stop - base]
            run = np.zeros(stop - base + 1, dtype=np.uint64)
            np.cumsum(codes, out=run[1:])
            inv = _power("down", stop - base)
            s, e = self.start[a:b] - base, self.end[a:b] - base
            for k, p in enumerate((0, *cuts)):
                x, y = (s, e) if not p else (s, np.minimum(s + p, e)) if p > 0 else (np.maximum(e + p, s), e)
                out[k][a:b] = mix((run[y] - run[x]) * inv[x] + U64(k))
            a = b
        return out


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]] for each i; empty ranges give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def crc_mod(column: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of whole texts stay small in rows and bytes, for this and later queries of the session; smaller settings are kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"[^0-9-]", "", spark.conf.get(key, str(most + 1))))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


_own_dirs: dict[str, str] = {}  # by application, for tests


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only a local session, whose executors are the driver itself, may leave it unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = _own_dirs.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tesserae-")
        _own_dirs[spark.sparkContext.applicationId] = top
    folder = f"{top.rstrip('/')}/tesserae/{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)  # results read from it until the application ends
    return folder


def stored(df: DataFrame, path: str) -> DataFrame:
    """Written once and read back: cuts the lineage and survives the loss of executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def give_back(spark: SparkSession) -> str | None:
    """Has the driver's JVM return to the system what its native code has freed and the C library keeps; what the JVM says, or None if it has no such command."""
    jvm = spark._jvm
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), TRIM
    try:
        return invoke.invoke(server, args)
    except Py4JJavaError:
        return None


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files that no live frame needs: it acts on what both garbage collectors have freed. The driver's freed memory goes back to the system."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
    give_back(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """With doc_id, what tells a row's decision from another's: two texts of one doc_id have equal keys with 2**-64."""
    return F.xxhash64(text)


def by_rows(docs: DataFrame, keys: DataFrame, how: str, most: int = 250_000) -> DataFrame:
    """Join of docs (semi, anti or inner) with distinct stored rows of doc_id, key (see text_key) and whatever an inner join adds; null equals null. The rows are broadcast only if they are `most` at most."""
    keys = keys.withColumnsRenamed({"doc_id": "_row_id", "key": "_row_key"})
    few = keys.count() <= most
    same = docs["doc_id"].cast("long").eqNullSafe(keys["_row_id"]) & (text_key(docs["text"]) == keys["_row_key"])
    out = docs.join(F.broadcast(keys) if few else keys, same, how)
    return out.drop(keys["_row_id"], keys["_row_key"]) if how == "inner" else out
