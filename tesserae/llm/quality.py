"""Quality scores: random Fourier features, ridge regression and isotonic calibration.

A text is described by statistics of its bytes, words and lines. Standardised over
all documents, they pass through cosines of random projections, whose inner products
approximate a Gaussian kernel. Each partition sums its normal equations over the
labelled rows, fold by fold; the sums, whose size depends on the number of features alone, give
the ridge solution, and one without each fold. An isotonic fit over binned raw scores turns them into
probabilities; the raw scores it learns from are those of the solutions that haven't seen the row.

Defined results: null and empty texts have the statistics 0 and get a score like any
other. Repeated rows score alike. Null labels are ignored; of several labels of a
document the largest counts, and of repeated documents each row counts. Without
labelled rows every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CHUNK, U64, Words, crc_mod, mix, row_sums, small_batches, stored, text_chunks, work_dir

FEATURES = 256
BINS = 2000
THRESHOLD = 0.3

_CLASSES = {
    "upper": list(range(65, 91)), "lower": list(range(97, 123)), "digit": list(range(48, 58)), "space": [32, 9], "line": [10, 13],
    "full_stop": [46], "comma": [44, 59, 58], "mark": [33, 63], "bar": [124, 47, 92, 95, 126], "symbol": [35, 36, 37, 38, 42, 43, 61, 64, 94],
    "bracket": [40, 41, 60, 62, 91, 93, 123, 125], "quote": [34, 39, 96], "wide": list(range(128, 256)),
}
NAMES = [*_CLASSES, "log_bytes", "log_words", "word_length", "long_words", "short_words", "again", "again_2", "distinct_words", "distinct_lines", "line_words", "upper_words", "plain_end"]
_TABLE = np.zeros(256, dtype=np.int64)
for _k, _codes in enumerate(_CLASSES.values()):
    _TABLE[_codes] = _k + 1


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row."""
    if not len(keys):
        return np.zeros(n)
    _, first = np.unique(mix(keys + rows.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(rows[first], minlength=n).astype(np.float64)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    out = np.zeros((len(column), len(NAMES)))
    for row, data, off in text_chunks(column, CHUNK // 2):
        n = len(off) - 1
        size = np.diff(off).astype(np.float64)
        per = np.maximum(size, 1)
        owner = np.repeat(np.arange(n), np.diff(off))
        kinds = np.bincount(owner * 16 + _TABLE[data], minlength=16 * n).reshape(n, 16)[:, 1 : 1 + len(_CLASSES)]
        words = Words(data, off)
        count = words.counts().astype(np.float64)
        many = np.maximum(count, 1)
        whole = words.hashes()[0]
        of = np.repeat(np.arange(n), words.counts())
        length = (words.end - words.start).astype(np.float64)
        again, again2 = np.zeros(len(whole)), np.zeros(len(whole))
        again[1:] = (whole[1:] == whole[:-1]) & (of[1:] == of[:-1])
        again2[2:] = (whole[2:] == whole[:-2]) & (of[2:] == of[:-2])
        first = data[words.start] if len(words) else np.zeros(0, np.uint8)
        last = data[words.end - 1] if len(words) else np.zeros(0, np.uint8)
        upper = ((first >= 65) & (first <= 90) & (length > 1) & (data[np.minimum(words.start + 1, max(len(data) - 1, 0))] < 97)).astype(np.float64) if len(words) else np.zeros(0)
        plain = (((last >= 97) & (last <= 122)) | (last >= 128) | (last == 46) | (last == 44)).astype(np.float64)
        # a line's hash: the sum of its words' mixed hashes; its words lie between two breaks
        breaks = np.cumsum(data == 10)
        line = breaks[words.start] if len(words) else np.zeros(0, np.int64)
        new = np.ones(len(whole), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
        begin = np.flatnonzero(new)
        line_hash = np.add.reduceat(mix(whole), begin) if len(begin) else np.zeros(0, np.uint64)
        lines = np.bincount(of[begin], minlength=n).astype(np.float64) if len(begin) else np.zeros(n)
        s = lambda x: row_sums(x, words.at)
        out[row : row + n] = np.column_stack([
            kinds / per[:, None], np.log1p(size), np.log1p(count), s(length) / many, s((length > 14).astype(float)) / many, s((length < 3).astype(float)) / many,
            s(again) / many, s(again2) / many, _distinct(of, whole, n) / many, _distinct(of[begin], line_hash, n) / np.maximum(lines, 1), count / np.maximum(lines, 1) / 100, s(upper) / many, s(plain) / many,
        ])
    return out


@dataclass
class QualityModel:
    """Every array's size is fixed by FEATURES and BINS."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None = None
    bins: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(7))
        d = len(NAMES)
        project = rng.normal(size=(d, FEATURES)) / np.sqrt(d) * 0.7
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(x @ project + phase), np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(stats):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.bins, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: block centres and their non-decreasing means."""
    blocks: list[list[float]] = []
    for a, b, c in sorted(zip(x.tolist(), y.tolist(), weight.tolist(), strict=True)):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("stats").flatten(), dtype=np.float64).reshape(-1, len(NAMES))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def describe(text: pa.Array) -> pa.Array:
        m = statistics(text)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, len(NAMES), dtype=np.int32)), pa.array(m.ravel()))

    return docs.select("doc_id", describe(F.col("text")).alias("stats"))


def fit(stats: DataFrame, labels: DataFrame, ridge: float = 1e-4) -> QualityModel:
    """Learns from every labelled row outside the held-out fifth; no rows reach the driver, only sums."""
    spark = stats.sparkSession
    moments = stats.select(*[F.struct(F.avg(F.col("stats")[k]).alias("m"), F.stddev_pop(F.col("stats")[k]).alias("s")).alias(f"f{k}") for k in range(len(NAMES))]).first()
    model = QualityModel(np.array([c["m"] or 0.0 for c in moments]), np.array([max(c["s"] or 0.0, 1e-6) for c in moments]))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (crc_mod(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = stored(stats.join(known, "doc_id").select("stats", "y", crc_mod(F.col("doc_id"), 5).cast("int").alias("fold")), work_dir(spark, "quality") + "/labelled")
    size = FEATURES + 1

    def normal_equations(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = model.features(_matrix(batch))
            y, fold = np.asarray(batch.column("y"), dtype=np.float64), np.asarray(batch.column("fold"))
            for k in np.unique(fold).tolist():
                mine = z[fold == k]
                part = np.column_stack([mine.T @ mine, mine.T @ y[fold == k], np.zeros(size)])
                part[0, -1] = len(mine)
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k)), pa.array(np.arange(size)), pa.array(list(part), pa.list_(pa.float64()))], names=["fold", "row", "sums"])

    parts = rows.mapInArrow(normal_equations, "fold long, row long, sums array<double>")
    summed = parts.groupBy("fold", "row").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(size + 2)])
    folds: dict[int, np.ndarray] = {}
    for r in summed.collect():  # FEATURES + 1 rows for each of four folds
        folds.setdefault(r[0], np.zeros((size, size + 2)))[r[1]] = r[2:]
    if not folds:
        return model
    every = sum(folds.values())
    solve = lambda s: np.linalg.solve(s[:, :size] + ridge * max(1.0, s[0, -1]) * np.eye(size), s[:, size])
    model.weights = solve(every)
    without = {k: solve(every - s) if len(folds) > 1 else model.weights for k, s in folds.items()}
    shared = spark.sparkContext.broadcast((model, without))

    def binned(batches):
        fitted, unseen = shared.value
        for batch in batches:
            z, fold = fitted.features(_matrix(batch)), np.asarray(batch.column("fold"))
            raw = np.zeros(len(z))
            for k in np.unique(fold).tolist():
                raw[fold == k] = z[fold == k] @ unseen[k]
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int64)), pa.array(raw), batch.column("y").cast(pa.float64())], names=["bin", "raw", "y"])

    bins = rows.mapInArrow(binned, "bin long, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("y").alias("n")).collect()  # at most BINS rows
    model.bins, model.values = isotonic(*(np.array([r[c] for r in bins], dtype=np.float64) for c in ("x", "y", "n")))
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    spark = docs.sparkSession
    stats = stored(document_statistics(docs), work_dir(spark, "quality") + "/stats")
    shared = spark.sparkContext.broadcast(fit(stats, labels))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(np.asarray(column.flatten(), dtype=np.float64).reshape(-1, len(NAMES))))

    return stats.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), score(F.col("stats")).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
