"""Benchmark decontamination with an FM-index for each shard of training text.

A task gathers documents into shards of bounded size and builds an index over each
shard's words: the words of the benchmark's vocabulary have symbols, any other word is
a separator, and runs of symbols too short for any phrase are left out, for nothing
can occur there. Suffix order gives the Burrows-Wheeler transform, kept as a wavelet
matrix with popcount ranks. Every phrase (13 consecutive words of an item, or a shorter item
whole) is searched backwards, all phrases at once; occurrences are located by walking
back to sampled suffix positions; and their spans are merged in each document.

Separators order by position, so suffixes compare no further than the end of their
run; run starts are sampled, so that no walk crosses one. Words are compared by 64-bit hashes; equal hashes of
different words (2**-64 a pair) would count as one word.

The benchmark travels in blocks of bounded size, of which the driver and the executors hold one at a time. There is one pass over the
documents for each block, and documents never move between tasks.

Defined results: null and empty texts have no words and no hits. Items without words
or with null item_id match nothing; rows that repeat an item_id are one item. Repeated
documents get a row each. A row is dropped or cut for its own text, whatever other rows
have its doc_id or none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM, U64, Words, by_rows, small_batches, stored, text_chunks, text_key, work_dir

PHRASE = 13
BLOCK_WORDS = 2_000_000
SHARD_SYMBOLS = 2_000_000
SHARD_BYTES = 48 << 20
SAMPLE = 16


class Bits:
    """A bit vector with rank by popcounts of 64-bit words."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & U64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        mask = (U64(1) << (i & 63).astype(np.uint64)) - U64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class Wavelet:
    """A wavelet matrix over symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        now = symbols
        for level in range(levels - 1, -1, -1):
            one = ((now >> level) & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(int(len(now) - one.sum()))
            now = np.concatenate([now[~one], now[one]])

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i stands on the lowest level among equals of `symbol`."""
        for k, bits in enumerate(self.bits):
            ones = bits.rank(i)
            i = np.where((symbol >> (self.levels - 1 - k)) & 1 == 1, self.zeros[k] + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its place on the lowest level."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for k, bits in enumerate(self.bits):
            one, ones = bits.get(i), bits.rank(i)
            symbol = symbol << 1 | one
            i = np.where(one, self.zeros[k] + ones, i - ones)
        return symbol, i


def suffix_order(text: np.ndarray, levels: int) -> np.ndarray:
    """Suffixes in order; 0 separates, and equal suffixes up to a separator order by position. text ends with 0."""
    n = len(text)
    per = max(1, 60 // levels)
    padded = np.concatenate([text, np.zeros(per, dtype=text.dtype)]).astype(np.int64)
    key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(per):
        now = padded[k : k + n]
        alive &= now != 0
        key = key << levels | np.where(alive, now, 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    ended = ~alive[order]
    place = np.arange(n)
    start = np.maximum.accumulate(np.where(new | ended, place, 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    size = np.diff(np.append(np.flatnonzero(new), n))
    open_at = np.flatnonzero(~ended & np.repeat(size > 1, size))
    span = per
    while len(open_at):
        who = order[open_at]
        pair = rank[who] * (n + 1) + rank[who + span]
        by = np.argsort(pair, kind="stable")
        who, pair = who[by], pair[by]
        order[open_at] = who
        new = np.ones(len(who), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[who] = open_at[np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(who)))
        open_at = open_at[np.repeat(size > 1, size)]
        span *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, levels: int):
        n = len(text)
        order = suffix_order(text, levels)
        self.wavelet = Wavelet(text[order - 1], levels)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << levels))])
        symbols = np.arange(1 << levels)
        self.base = self.wavelet.down(symbols, np.zeros(1 << levels, dtype=np.int64))
        sampled = (np.arange(n) % SAMPLE == 0) | (text == 0)
        sampled[1:] |= text[:-1] == 0
        self.marked = Bits(sampled[order])
        self.places = order[sampled[order]]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of phrases (equal lengths) that occur: their numbers and ranges of suffixes."""
        live = np.arange(len(phrases))
        last = phrases[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            on = low < high
            live, low, high = live[on], low[on], high[on]
            if not len(live):
                break
            c = phrases[live, k]
            low = self.first[c] + self.wavelet.down(c, low) - self.base[c]
            high = self.first[c] + self.wavelet.down(c, high) - self.base[c]
        on = low < high
        return live[on], low[on], high[on]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, steps, todo = np.zeros(len(rows), dtype=np.int64), 0, np.arange(len(rows))
        while len(todo):
            at = self.marked.get(rows)
            out[todo[at]] = self.places[self.marked.rank(rows[at])] + steps
            todo, rows = todo[~at], rows[~at]
            symbol, low = self.wavelet.access(rows)
            rows = self.first[symbol] + low - self.base[symbol]
            steps += 1
        return out


@dataclass
class Block:
    """Phrases of some items: at most BLOCK_WORDS words, or one item."""

    vocabulary: np.ndarray  # sorted hashes; symbol k + 1 is vocabulary[k]
    phrases: list[np.ndarray]  # distinct ones, a matrix of symbols for each length
    owners: list[tuple[np.ndarray, np.ndarray]]  # for each length: offsets by phrase, and items
    items: np.ndarray

    @property
    def levels(self) -> int:
        return max(1, int(len(self.vocabulary)).bit_length())

    def shortest(self) -> int:
        return min((p.shape[1] for p in self.phrases), default=1 << 60)


def make_block(ids: list[int], texts: list[str], phrase: int = PHRASE) -> Block:
    found: list[tuple[int, np.ndarray]] = []
    for row, data, off in text_chunks(pa.array(texts, pa.large_string())):
        words = Words(data, off, ALNUM)
        h = words.hashes()[0]
        found += [(ids[row + i], h[words.at[i] : words.at[i + 1]]) for i in range(len(off) - 1)]
    vocabulary = np.unique(np.concatenate([h for _, h in found])) if found else np.zeros(0, np.uint64)
    items = np.unique(np.array([i for i, _ in found], dtype=np.int64))
    by_length: dict[int, list] = {}
    for item, h in found:
        if not len(h):
            continue
        symbols = np.searchsorted(vocabulary, h) + 1
        k = min(phrase, len(symbols))
        windows = np.lib.stride_tricks.sliding_window_view(symbols, k)
        by_length.setdefault(k, []).append((windows, np.full(len(windows), np.searchsorted(items, item))))
    phrases, owners = [], []
    for k in sorted(by_length):
        rows = np.concatenate([w for w, _ in by_length[k]])
        who = np.concatenate([o for _, o in by_length[k]])
        distinct, at = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(at.reshape(-1) * len(items) + who)
        phrases.append(distinct)
        owners.append((np.searchsorted(pairs // len(items), np.arange(len(distinct) + 1)), pairs % len(items)))
    return Block(vocabulary, phrases, owners, items)


def blocks(benchmark: DataFrame, phrase: int = PHRASE, limit: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark, block by block; the driver holds one block's texts at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        words = len(r["text"]) // 2 + 1  # no text has more words than this
        if ids and size + words > limit:
            yield make_block(ids, texts, phrase)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += words
    yield make_block(ids, texts, phrase)


def _expand(low: np.ndarray, high: np.ndarray, most: int = 1 << 20):
    """(range number, member) of all ranges, some at a time."""
    size = high - low
    total = np.concatenate([[0], np.cumsum(size)])
    for a in range(0, int(total[-1]), most):
        i = np.arange(a, min(a + most, int(total[-1])))
        owner = np.searchsorted(total, i, side="right") - 1
        yield owner, low[owner] + i - total[owner]


class Shard:
    """Documents gathered for one index."""

    def __init__(self, block: Block):
        self.block, self.parts, self.columns = block, [], []
        self.rows = self.symbols = self.bytes = 0
        quick = np.zeros(1 << 16, dtype=bool)
        quick[(block.vocabulary >> U64(48)).astype(np.int64)] = True
        self.quick, self.least = quick, block.shortest()

    def add(self, ids: pa.Array, data: np.ndarray, off: np.ndarray, keys: pa.Array | None = None) -> None:
        words = Words(data, off, ALNUM)
        h = words.hashes()[0]
        near = np.flatnonzero(self.quick[(h >> U64(48)).astype(np.int64)]) if len(self.block.vocabulary) else np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(self.block.vocabulary, h[near]), max(0, len(self.block.vocabulary) - 1))
        hit = self.block.vocabulary[slot] == h[near] if len(near) else np.zeros(0, bool)
        at, symbol = near[hit], slot[hit] + 1
        doc = np.searchsorted(words.at, at, side="right") - 1
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        keep = np.repeat(size >= self.least, size)
        self.parts.append((symbol[keep], doc[keep] + self.rows, (at - words.at[doc])[keep], new[keep]))
        self.columns.append((ids, words.counts(), pa.nulls(len(off) - 1, pa.int64()) if keys is None else keys))
        self.rows += len(off) - 1
        self.symbols += int(keep.sum())
        self.bytes += len(data)

    def full(self) -> bool:
        return self.symbols >= SHARD_SYMBOLS or self.bytes >= SHARD_BYTES

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merged spans (document, first word, end word), and (document, item) pairs."""
        symbol, doc, word, new = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        none = np.zeros(0, dtype=np.int64)
        if not len(symbol):
            return none, none, none, none, none
        place = np.arange(len(symbol)) + np.cumsum(new)  # a separator before each run
        text = np.zeros(int(place[-1]) + 2, dtype=np.int64)
        text[place] = symbol
        back = np.zeros(len(text), dtype=np.int64)
        back[place] = np.arange(len(symbol))
        index = FMIndex(text, self.block.levels)
        edge = np.zeros(len(text) + 1, dtype=np.int64)
        items = len(self.block.items)
        pairs = [none]
        for phrases, (owner_at, owners) in zip(self.block.phrases, self.block.owners, strict=True):
            which, low, high = index.search(phrases)
            for k, row in _expand(low, high):
                at = index.locate(row)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + phrases.shape[1], -1)
                d, w = doc[back[at]], which[k]
                seen = np.unique(d * len(phrases) + w)
                d, w = seen // len(phrases), seen % len(phrases)
                for j, item in _expand(owner_at[w], owner_at[w + 1]):
                    pairs.append(np.unique(d[j] * items + owners[item]))
        covered = np.cumsum(edge)[place] > 0
        begin = covered.copy()
        begin[1:] &= ~covered[:-1] | new[1:]
        end = covered.copy()
        end[:-1] &= ~covered[1:] | new[1:]
        both = np.unique(np.concatenate(pairs))
        return doc[begin], word[begin], word[end] + 1, both // max(1, items), self.block.items[both % max(1, items)]

    def result(self) -> pa.RecordBatch:
        of, start, end, doc, item = self.search()
        rows = np.arange(self.rows + 1)
        at, item_at = np.searchsorted(of, rows).astype(np.int32), np.searchsorted(doc, rows).astype(np.int32)
        long_lists = lambda x, a: pa.ListArray.from_arrays(pa.array(a), pa.array(x, pa.int64()))
        ids, keys = (pa.concat_arrays([c[k] for c in self.columns]) for k in (0, 2))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.concatenate([c[1] for c in self.columns]), pa.int64()), keys, long_lists(start, at), long_lists(end, at), long_lists(item, item_at)],
            names=["doc_id", "n_words", "key", "starts", "ends", "items"],
        )


_SCHEMA = "doc_id long, n_words long, key long, starts array<long>, ends array<long>, items array<long>"


def _pass(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """One pass over docs with a block: at most BLOCK_WORDS words and their phrases."""

    def run(batches):
        shard = Shard(shared.value)
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for row, data, off in text_chunks(batch.column("text")):
                shard.add(ids.slice(row, len(off) - 1), data, off, keys.slice(row, len(off) - 1))
                if shard.full():
                    yield shard.result()
                    shard = Shard(shared.value)
        if shard.rows:
            yield shard.result()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key")).mapInArrow(run, _SCHEMA)


def _merge(a, b):
    """Spans in order of start, joined where they touch; SQL lambdas over structs."""
    last = F.element_at(a, -1)
    joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], b["e"]).alias("e"))))
    return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["e"] >= b["s"]), joined).otherwise(F.concat(a, F.array(b)))


def _spans(docs: DataFrame, benchmark: DataFrame, phrase: int, block_words: int) -> DataFrame:
    """What removal_spans() gives, with the key of the row's text."""
    small_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    found = blocks(benchmark, phrase, block_words)
    first, second = next(found), next(found, None)
    if second is None:
        return _pass(docs, share(first))
    top, passes = work_dir(docs.sparkSession, "passes"), []
    for b in chain((first, second), found):
        shared = share(b)
        passes.append(stored(_pass(docs, shared), f"{top}/{len(passes)}"))
        shared.destroy()
    # the same row comes once from each pass; equal rows have equal results, so they are merged together and counted
    every = passes[0]
    for p in passes[1:]:
        every = every.unionAll(p)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e")))))
    merged = every.groupBy("doc_id", "n_words", "key").agg(
        F.aggregate(spans, F.array().cast("array<struct<s:bigint,e:bigint>>"), _merge).alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count(F.lit(1)) / len(passes)).cast("int").alias("n")
    )
    return merged.select("doc_id", "n_words", "key", F.col("m.s").alias("starts"), F.col("m.e").alias("ends"), "items", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("_n")).drop("_n")


def removal_spans(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, starts, ends (merged word ranges to remove), items (item_ids that occur), a row for each row of docs."""
    return _spans(docs, benchmark, phrase, block_words).drop("key")


def _n_hit():
    return F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def _contaminated(n_hit):
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    spans = removal_spans(docs, benchmark, phrase, block_words)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return spans.select(
        "doc_id", "n_words", _n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256")
    ).withColumn("contaminated", _contaminated(F.col("n_hit")))


def cut_words(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the words [start, end) of each span and what lies between them; what stands before and after a span stays."""
    raw = text.encode()
    words = Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), ALNUM)
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(raw[at : words.start[s]])
        at = int(words.end[e - 1])
    return b"".join([*out, raw[at:]]).decode()


def _without_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that `found` names (doc_id, key, starts, ends), cut; n_chars, if it's there, follows the text."""

    @F.arrow_udf("string")
    def cut_text(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([cut_words(*row) for row in zip(text.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True)], pa.string())

    added = {"starts": "_starts", "ends": "_ends"}
    cut = by_rows(docs, found.select("doc_id", "key", *added).withColumnsRenamed(added), "inner").withColumn("text", cut_text("text", "_starts", "_ends"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, in which no phrase occurs, byte for byte; a row with any span to remove goes whole."""
    found = _spans(docs, benchmark, phrase, block_words).filter(F.size("starts") > 0).select("doc_id", "key").distinct()
    return by_rows(docs, stored(found, work_dir(docs.sparkSession, "leaks")), "left_anti")


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, without those that are contaminated; from the others every span is cut, so no phrase is left.

    Rows without a hit stay as they are. Where a cut brings words together that make a phrase, it is cut as well.
    """
    top = work_dir(docs.sparkSession, "leaks")

    def hits(of: DataFrame, name: str) -> DataFrame:
        found = _spans(of, benchmark, phrase, block_words).filter(F.size("starts") > 0).dropDuplicates(["doc_id", "key"])
        return stored(found.select("doc_id", "key", "starts", "ends", _contaminated(_n_hit()).alias("gone")), f"{top}/{name}")

    found = hits(docs, "hits")
    out = by_rows(docs, found.select("doc_id", "key"), "left_anti")
    rest, k = _without_spans(docs, found.filter("NOT gone")), 0
    while True:
        rest = stored(rest, f"{top}/cut-{k}")
        found = hits(rest, f"hits-{k}")
        out = out.unionByName(by_rows(rest, found.select("doc_id", "key"), "left_anti"))
        if found.isEmpty():
            return out
        rest, k = _without_spans(rest, found), k + 1


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[a:a + least(13, len(w)) - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS a FROM i WHERE len(w) > 0)),
x AS (SELECT r, k, a, array_to_string(w[a:a + k - 1], ' ') AS phrase FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
h AS (SELECT x.r, x.a, x.k, p.item_id FROM x JOIN p ON x.k = p.k AND x.phrase = p.phrase),
n AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(a, a + k)) AS spot FROM h) GROUP BY r),
g AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN g USING (r)
"""
