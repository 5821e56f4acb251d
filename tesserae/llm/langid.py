"""Language identification in two steps: the family, then one-versus-one linear SVMs within it.

A text's features are the relative frequencies of its hashed byte trigrams and
four-grams, letters lower-cased and everything else one separator. Families are learned: languages
whose training profiles are more alike than languages are on average are merged, pair by pair. A
one-versus-rest linear SVM over families decides the first step, votes of linear
SVMs between each two languages of the family the second.

Defined results: texts that are null or have no letter are `und` with score 0, as is
every text when nothing could be learned. Repeated rows are predicted alike. Training
rows without lang or doc_id are ignored; of rows that repeat a doc_id the first lang and its
greatest text by code point count. Of tied votes the greater summed margin wins, then the
first language by code point.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import U64, crc_mod, row_sums, small_batches, stored, text_chunks, work_dir

BITS = 13
UNKNOWN = "und"
DENSE = 12_000_000  # numbers, of 8 bytes
_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[list[int]] = field(default_factory=list)
    family: np.ndarray | None = None  # features + bias by family
    pairs: list[tuple[int, int]] = field(default_factory=list)
    between: np.ndarray | None = None  # features + bias by pair; positive: the first of the pair


def _slots(data: np.ndarray, off: np.ndarray):
    """Slots of the byte four-grams and trigrams that begin at each byte; those across texts or of separators alone go to the last, unused slot."""
    b = _LETTER[data].astype(np.uint64)
    n = len(b)
    unused = 1 << BITS
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)  # bytes to the end of the text
    out = []
    for width in (3, 4):
        slot = np.full(n, unused, dtype=np.int64)
        if n >= width:
            gram = b[: n - width + 1].copy()
            for k in range(1, width):
                gram = (gram << U64(8)) | b[k : n - width + 1 + k]
            plain = int.from_bytes(b" " * width, "big")
            h = ((gram * U64(0x9E3779B97F4A7C15) + U64(width)) * U64(0xD6E8FEB86659FD93)) >> U64(64 - BITS)
            ok = (left[: n - width + 1] >= width) & (gram != plain)
            slot[: n - width + 1] = np.where(ok, h.astype(np.int64), unused)
        out.append(slot)
    return out


@dataclass
class Profiles:
    """Sparse rows: slot, value, and where each row begins (one more than rows); slot 1 << BITS is the bias."""

    slot: np.ndarray
    value: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def rows(self, which: np.ndarray) -> Profiles:
        size = np.diff(self.at)[which]
        at = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.at[:-1][which] - at[:-1], size) + np.arange(int(at[-1]))
        return Profiles(self.slot[where], self.value[where], at)

    @cached_property
    def dense(self) -> np.ndarray | None:
        """The rows as a matrix where that is small; it only makes products faster."""
        if len(self) << BITS > DENSE:
            return None
        out = np.zeros((len(self), (1 << BITS) + 1))
        out[np.repeat(np.arange(len(self)), np.diff(self.at)), self.slot] = self.value
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense @ w
        return np.add.reduceat(self.value * w[self.slot], self.at[:-1]) if len(self) else np.zeros(0)  # no row is empty: each has a bias

    def weighted_sum(self, g: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return g @ self.dense
        return np.bincount(self.slot, weights=self.value * np.repeat(g, np.diff(self.at)), minlength=(1 << BITS) + 1)


def _profile(texts: list[str]) -> Profiles:
    slots, values, sizes = [], [], []
    for _, data, off in text_chunks(pc.utf8_lower(pa.array(texts, pa.large_string()))):
        found = _slots(data, off)
        for i in range(len(off) - 1):
            x = sum(np.bincount(s[off[i] : off[i + 1]], minlength=(1 << BITS) + 1)[:-1] for s in found)
            some = np.flatnonzero(x)
            slots += [some.astype(np.int32), np.array([1 << BITS], dtype=np.int32)]
            values += [(x[some] * (np.sqrt(1 << BITS) / max(1, x.sum()))).astype(np.float32), np.ones(1, dtype=np.float32)]  # margins of the order of one
            sizes.append(len(some) + 1)
    empty = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
    return Profiles(empty(slots, np.int32), empty(values, np.float32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def _svm(x: Profiles, sign: np.ndarray, rounds: int = 120, rate: float = 0.05, l2: float = 1e-4) -> np.ndarray:
    """Adam on the mean squared hinge loss of each side, sides weighing alike."""
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    w, m, v = (np.zeros((1 << BITS) + 1) for _ in range(3))
    for t in range(1, rounds + 1):
        slack = np.maximum(0, 1 - sign * x.dot(w))
        g = l2 * w - 2 * x.weighted_sum(weight * sign * slack)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def families_of(centres: np.ndarray) -> list[list[int]]:
    """Average-linkage merges while the closest two groups are more alike than languages are on average."""
    groups = [[k] for k in range(len(centres))]
    if len(groups) < 3:
        return groups
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    like = unit @ unit.T
    mean = like[np.triu_indices(len(groups), 1)].mean()
    while len(groups) > 2:
        score, a, b = max((like[np.ix_(p, q)].mean(), -i, -j) for (i, p), (j, q) in combinations(enumerate(groups), 2))
        if score < mean:
            break
        groups[-a] += groups.pop(-b)
    return [sorted(g) for g in groups]


def train(texts: list[str], langs: list[str]) -> LanguageModel:
    model = LanguageModel(sorted(set(langs)))
    if not model.languages:
        return model
    x = _profile(texts)
    place = {v: k for k, v in enumerate(model.languages)}
    y = np.array([place[v] for v in langs])
    model.families = families_of(np.stack([x.weighted_sum((y == k) / max(1, (y == k).sum()))[:-1] for k in range(len(model.languages))]))
    home = np.zeros(len(model.languages), dtype=int)
    for k, group in enumerate(model.families):
        home[group] = k
    model.family = np.stack([_svm(x, np.where(home[y] == k, 1.0, -1.0)) for k in range(len(model.families))], axis=1)
    model.pairs = [p for group in model.families for p in combinations(group, 2)]
    columns = []
    for a, b in model.pairs:
        rows = np.flatnonzero((y == a) | (y == b))
        columns.append(_svm(x.rows(rows), np.where(y[rows] == a, 1.0, -1.0)))
    model.between = np.stack(columns, axis=1) if columns else np.zeros(((1 << BITS) + 1, 0))
    return model


def _has_letter(column: pa.Array) -> np.ndarray:
    """Exact: some character of the text is a letter."""
    out = np.asarray(pc.fill_null(pc.match_substring_regex(column, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)).astype(bool)
    for k in np.flatnonzero(~out):
        text = column[int(k)].as_py()
        out[k] = bool(text) and any(c.isalpha() for c in text)
    return out


def predict(column: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    n = len(column)
    names, score = [UNKNOWN] * n, np.zeros(n)
    if not model.languages or not n:
        return names, score
    known = _has_letter(column)
    both = np.column_stack([model.family, model.between]).astype(np.float32)
    table = both.copy()
    table[:-1] *= np.sqrt(1 << BITS)
    table[-1] = 0  # the unused slot
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    sigmoid = lambda z: 1 / (1 + np.exp(-2 * z))
    for row, data, off in text_chunks(lowered, 1 << 18):
        total, grams = np.zeros((len(off) - 1, both.shape[1])), np.zeros(len(off) - 1)
        for slot in _slots(data, off):
            # a very long text in pieces, so that memory stays bounded
            for a in range(0, len(slot), 1 << 19):
                part = slot[a : a + (1 << 19)]
                at = np.clip(off - a, 0, len(part))
                total += row_sums(table[part].astype(np.float64), at)
                grams += row_sums((part != 1 << BITS).astype(np.float64), at)
        margin = total / np.maximum(grams, 1)[:, None] + both[-1]
        families = margin[:, : len(model.families)]
        first = families.argmax(axis=1)
        for i in range(len(first)):
            if not known[row + i]:
                continue
            group = model.families[first[i]]
            sure = sigmoid(families[i, first[i]])
            votes = {k: [0, 0.0] for k in group}
            for j, (a, b) in enumerate(model.pairs):
                if a in votes:
                    z = margin[i, len(model.families) + j]
                    votes[a if z > 0 else b][0] += 1
                    votes[a][1] += z
                    votes[b][1] -= z
            best = max(group, key=lambda k: (votes[k][0], votes[k][1], -k))
            if len(group) > 1:
                sure *= sigmoid(votes[best][1] / (len(group) - 1))
            names[row + i], score[row + i] = model.languages[best], min(1.0, max(0.0, float(sure)))
    return names, score


MOST_TEXTS, MOST_BYTES = 20_000, 64 << 20
MOST_BROADCAST = 100_000


def fit(docs: DataFrame, per_language: int = 300, most_texts: int = MOST_TEXTS, most_bytes: int = MOST_BYTES) -> LanguageModel:
    """Learns from at most per_language documents of each language, the first by a hash of doc_id, outside the held-out quarter.

    Of many languages each has fewer, most_texts in all, and most_bytes / languages bytes of whole texts, none of them of over a quarter of that.
    A language's size tells below which hash about twice as many are as are wanted; only those rows are ordered, however many the language has.
    """
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    known = stored(known.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))), work_dir(docs.sparkSession, "languages"))
    below = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows")).select("lang", ((2 * per_language + 50) / F.col("_rows") * float(1 << 40)).alias("_below"))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    below = stored(below, work_dir(docs.sparkSession, "language-cuts"))
    few = F.broadcast if below.count() <= MOST_BROADCAST else lambda df: df  # languages; joined where they are, the rows of one don't meet before they are few
    first = known.join(few(below), "lang").filter(F.col("_h") < F.col("_below")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language)
    ids = {r["doc_id"]: (r["lang"], r["_h"]) for r in first.collect()}
    if not ids:
        return LanguageModel([])
    languages = {lang for lang, _ in ids.values()}
    share, seen, chosen = max(1, most_texts // len(languages)), dict.fromkeys(languages, 0), []
    for doc, (lang, _) in sorted(ids.items(), key=lambda x: (x[1][1], x[0])):
        seen[lang] += 1
        if seen[lang] <= share:
            chosen.append((doc, lang))
    chosen = docs.sparkSession.createDataFrame(sorted(chosen), "doc_id long, _lang string")  # at most most_texts rows
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").filter("lang = _lang").groupBy("doc_id", "lang").agg(F.max("text").alias("text"))
    room = most_bytes // len(languages)
    rows = rows.withColumn("_long", F.coalesce(F.octet_length("text"), F.lit(0))).filter(F.col("_long") <= room // 4)
    run = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over at most per_language rows
    rows = rows.withColumn("_bytes", F.sum("_long").over(run)).filter(F.col("_bytes") <= room).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] or "" for r in rows], [r["lang"] for r in rows])


def predict_documents(docs: DataFrame, per_language: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs, per_language))

    @F.arrow_udf("struct<lang_pred string, score double>")
    def language(text: pa.Array) -> pa.Array:
        names, score = predict(text, shared.value)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], names=["lang_pred", "score"])

    guess = docs.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), language(F.col("text")).alias("_p"))
    return guess.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
