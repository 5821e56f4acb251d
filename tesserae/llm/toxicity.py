"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is a bias plus the weights of
its words' hashed features; the document's probability is the noisy-or of its
sentences, 1 - prod(1 - p). Weights are trained from document labels alone and
then also locate the sentences that made a document toxic.

Training texts are a sample of the labelled documents, bounded in rows and in bytes (see labelled_sample). One task on an
executor trains on them; the driver gets no text, only the weights that aren't 0.

Defined results: null and empty texts have no sentence and score 0. Repeated rows
score alike. Labels that are null are ignored; of several labels of a document the
largest counts, and of several texts the greatest by code point. Without both classes among the training labels every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import U64, Words, crc_mod, row_sums, small_batches, text_chunks

BITS = 20
CUTS = (3, 4, 5, 6)
LEAST_Z = 4.0  # features whose share of toxic documents differs by fewer standard errors have weight 0
_BREAK = np.zeros(256, dtype=np.int32)
_BREAK[[33, 46, 63, 10]] = 1  # ! . ? and line ends


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32, 2**BITS: its size does not depend on the data
    bias: float
    trained: bool


def _sentences(data: np.ndarray, off: np.ndarray):
    """Feature slots of each word, first word of each sentence, first sentence of each row, and sentence byte starts."""
    words = Words(data, off)
    slots = [(h >> U64(64 - BITS)).astype(np.int32) for h in words.hashes(*CUTS)]
    n = len(words)
    breaks = np.cumsum(_BREAK[words.data], dtype=np.int64) if n else np.zeros(0, np.int64)
    new = np.ones(n, dtype=bool)
    if n > 1:
        # a sentence ends where a break stands before the word's first byte
        before = np.where(words.start > 0, breaks[np.maximum(words.start - 1, 0)], 0)
        new[1:] = before[1:] != before[:-1]
        new[words.at[:-1][words.at[:-1] < n]] = True
    first = np.flatnonzero(new)
    return words, slots, np.append(first, n), np.searchsorted(first, words.at)


def _logits(slots: list[np.ndarray], first: np.ndarray, model: ToxicityModel) -> np.ndarray:
    per_word = np.zeros(len(slots[0]))
    for s in slots:
        per_word += model.weights[s]
    return row_sums(per_word, first) + model.bias


@dataclass
class Found:
    """Sentences whose own probability reaches a threshold, row by row: number in the text, byte range of its words, probability."""

    row: np.ndarray
    sentence: np.ndarray
    start: np.ndarray
    end: np.ndarray
    score: np.ndarray


def score_and_locate(column: pa.Array, model: ToxicityModel, least: float = 0.5) -> tuple[np.ndarray, Found]:
    out = np.zeros(len(column))
    parts: list[tuple] = []
    for row, data, off in text_chunks(column) if model.trained else ():
        words, slots, first, at = _sentences(data, off)
        z = _logits(slots, first, model)
        out[row : row + len(off) - 1] = -np.expm1(-np.maximum(row_sums(np.logaddexp(0, z), at), 0))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        hit = np.flatnonzero(p >= least)
        owner = np.searchsorted(at, hit, side="right") - 1
        parts.append((row + owner, hit - at[owner], words.start[first[hit]] - off[owner], words.end[first[hit + 1] - 1] - off[owner], p[hit]))
    found = Found(*(np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, dtype=np.int64 if k < 4 else np.float64) for k in range(5)))
    return np.clip(out, 0.0, 1.0), found


def score_texts(column: pa.Array, model: ToxicityModel) -> np.ndarray:
    return score_and_locate(column, model)[0]


def train(texts: list[str], labels: np.ndarray, rounds: int = 200, rate: float = 0.1, l2: float = 1e-5) -> ToxicityModel:
    """Full-batch Adam on the bags' log loss; classes weigh alike."""
    labels = np.asarray(labels, dtype=np.float64)
    model = ToxicityModel(np.zeros(1 << BITS, dtype=np.float32), -6.0, bool(len(labels)) and 0 < labels.sum() < len(labels))
    if not model.trained:
        return model
    slots, first, at = [[] for _ in range(1 + len(CUTS))], [], [0]
    words_so_far = 0
    sentences = 0
    for _, data, off in text_chunks(pa.array(texts, pa.large_string())):
        words, s, f, a = _sentences(data, off)
        for k, x in enumerate(s):
            slots[k].append(x)
        first.append(f[:-1] + words_so_far)
        at.extend((a[1:] + sentences).tolist())
        words_so_far += len(words)
        sentences += len(f) - 1
    slots = [np.concatenate(x) for x in slots]
    first = np.append(np.concatenate(first), words_so_far).astype(np.int64)
    at = np.asarray(at)
    sentence_of = np.repeat(np.arange(sentences), np.diff(first))
    bag_of = np.repeat(np.arange(len(labels)), np.diff(at))
    size = 1 << BITS
    word_bag = bag_of[sentence_of]
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    keep = np.zeros(size, dtype=bool)
    for s in slots:
        pairs = np.unique(s.astype(np.int64) * len(labels) + word_bag)
        in1 = np.bincount(pairs // len(labels), weights=labels[pairs % len(labels)], minlength=size)
        in0 = np.bincount(pairs // len(labels), minlength=size) - in1
        rate_all = np.clip((in1 + in0) / len(labels), 1e-9, 1 - 1e-9)
        keep |= (in1 / n1 - in0 / n0) / np.sqrt(rate_all * (1 - rate_all) * (1 / n1 + 1 / n0)) >= LEAST_Z
    dense = np.where(keep, np.cumsum(keep), 0).astype(np.int32)  # 0 gathers the rare ones
    slots = [dense[s] for s in slots]
    width = int(keep.sum()) + 1
    weight = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    b = np.array([model.bias, 0.0, 0.0])
    for t in range(1, rounds + 1):
        z = np.full(sentences, b[0])
        per_word = np.zeros(words_so_far)
        for s in slots:
            per_word += w[s]
        z += row_sums(per_word, first)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        total = np.maximum(row_sums(np.logaddexp(0, z), at), 1e-9)
        d_total = weight * np.where(labels > 0, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0)
        d_z = d_total[bag_of] * p
        d_word = d_z[sentence_of]
        g = l2 * w
        for s in slots:
            g += np.bincount(s, weights=d_word, minlength=width)
        g[0] = 0
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        gb = d_z.sum()
        b[1], b[2] = 0.9 * b[1] + 0.1 * gb, 0.99 * b[2] + 0.01 * gb * gb
        b[0] -= rate * (b[1] / (1 - 0.9**t)) / (np.sqrt(b[2] / (1 - 0.99**t)) + 1e-6)
    return ToxicityModel(np.where(keep, w[dense], 0).astype(np.float32), float(b[0]), True)


MOST_BYTES = 24 << 20


def _labelled_rows(docs: DataFrame, labels: DataFrame, target: str, held_out: Column, per_class: int, most_bytes: int) -> DataFrame | None:
    """doc_id, y, text of the documents that labelled_sample() names; None if no document is labelled."""
    known = (
        labels.select("doc_id", F.col(target).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("y = 1").orderBy(*order).limit(per_class).unionAll(known.filter("y = 0").orderBy(*order).limit(per_class))
    ids = {r["doc_id"]: r["y"] for r in picked.collect()}  # at most 2 * per_class numbers
    if not ids:
        return None
    chosen = docs.sparkSession.createDataFrame(sorted(ids.items()), "doc_id long, y int")
    # of rows that repeat a doc_id, however many, the greatest text by code point counts
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")).withColumn("_long", F.coalesce(F.octet_length("text"), F.lit(0))).filter(F.col("_long") <= most_bytes // 4)
    run = Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # over at most per_class rows
    return rows.withColumn("_bytes", F.sum("_long").over(run)).filter(F.col("_bytes") <= most_bytes).select("doc_id", "y", "text")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, held_out: Column, per_class: int, most_bytes: int = MOST_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most `per_class` documents of each class, the first by a hash of doc_id, whole texts of `most_bytes` a class in all; a text of over a quarter of that is not taken."""
    found = _labelled_rows(docs, labels, target, held_out, per_class, most_bytes)
    rows = sorted(found.collect(), key=lambda r: r["doc_id"]) if found is not None else []
    return [r["text"] or "" for r in rows], np.array([r["y"] for r in rows], dtype=np.float64)


def _train_rows(batches):
    """One row: the model that train() gives for all rows of the batches, in order of doc_id."""
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True)]
    rows.sort(key=lambda r: r[0])
    model = train([r[1] or "" for r in rows], np.array([r[2] for r in rows], dtype=np.float64))
    slots = np.flatnonzero(model.weights).astype(np.int32)
    yield pa.RecordBatch.from_pydict({"slots": pa.array([slots.tobytes()], pa.binary()), "weights": pa.array([model.weights[slots].tobytes()], pa.binary()), "bias": [model.bias], "trained": [model.trained]})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_bytes: int = MOST_BYTES) -> ToxicityModel:
    """Learns from at most 2 * per_class labelled documents outside the held-out fifth, of at most 2 * most_bytes, in one task."""
    small_batches(docs.sparkSession)
    rows = _labelled_rows(docs, labels, "toxic", crc_mod(F.col("doc_id"), 5) == 0, per_class, most_bytes)
    found = rows.repartition(1).mapInArrow(_train_rows, "slots binary, weights binary, bias double, trained boolean").first() if rows is not None else None
    model = train([], np.zeros(0))
    if found is not None:
        model.weights[np.frombuffer(found["slots"], np.int32)] = np.frombuffer(found["weights"], np.float32)
        model.bias, model.trained = found["bias"], found["trained"]
    return model


_SCORED = "struct<score double, sentences array<struct<sentence: long, start: long, end: long, score: double>>>"


def scorer(spark: SparkSession, model: ToxicityModel, least: float = 0.5):
    """A Column function from text to a struct: the probability, and the sentences whose own probability reaches `least`."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_SCORED)
    def toxicity(text: pa.Array) -> pa.Array:
        score, found = score_and_locate(text, shared.value, least)
        inside = pa.StructArray.from_arrays([pa.array(found.sentence, pa.int64()), pa.array(found.start, pa.int64()), pa.array(found.end, pa.int64()), pa.array(found.score, pa.float64())], names=["sentence", "start", "end", "score"])
        at = np.searchsorted(found.row, np.arange(len(text) + 1)).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(at), inside)], names=["score", "sentences"])

    return toxicity


def locate(spark: SparkSession, docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (number from 0), start, end (byte offsets of its words), score: sentences whose own probability reaches `least`."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(scorer(spark, model, least)(F.col("text"))["sentences"]).alias("_s"))
    return found.select("doc_id", "_s.sentence", "_s.start", "_s.end", "_s.score")


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences (the offending ones: number, byte range, probability) for every row of docs."""
    toxicity = scorer(docs.sparkSession, fit(docs, labels, per_class))
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity(F.col("text")).alias("_s"))
    return scored.select("doc_id", "held_out", "_s.score", (F.col("_s.score") >= 0.5).cast("int").alias("predicted"), "_s.sentences")


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """The rows of docs, all columns, whose score is below 0.5."""
    toxicity = scorer(docs.sparkSession, fit(docs, labels, per_class))
    return docs.filter(toxicity(F.col("text"))["score"] < 0.5)
