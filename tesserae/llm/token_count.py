"""Token counts of a unigram tokenizer without making the tokens.

Text is split at white space; a word begins with U+2581, and further U+2581 inside a
word begin pieces of their own, as the usual unigram pre-tokenizer does. Over each such
word an Aho-Corasick automaton lists all vocabulary entries, and dynamic programming
carries, for each position, the best score and the number of pieces of the first best
path. Tie rules are those of the tokenizers library's unigram model: matches are
considered by start, then by length, a later path replaces one only with a greater
score, a position without a one-character entry gets an unknown piece with the lowest
score less 10, adjacent unknown pieces are one, and with byte fallback an unknown
piece counts its UTF-8 bytes.

Chunks between ASCII white space are found and hashed for a whole Arrow batch at once; each distinct chunk is counted once and
its count is kept by its 64-bit hash in sorted arrays (equal hashes of different chunks, 2**-64 a pair, would count alike). A row's count is
a sum over its chunks.

The vocabulary is read from a public sentencepiece file whose path is a parameter. Its
pieces are ranked; a piece's score is minus the logarithm of its rank plus one, as for words
whose frequencies follow Zipf's law.

Defined results: null and empty texts and texts of white space have 0 tokens;
repeated rows count alike.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACED, Words, row_sums, small_batches, text_chunks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 2_000_000  # chunks, of 16 bytes
# White_Space as Unicode defines it: str.split() would also split at U+001C to U+001F
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) in the file's order; entry 0 is the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    return [(p, -math.log(k + 1.0)) for k, p in enumerate(pieces)]


class Counter:
    """Counts of pieces; those of chunks are kept, and forgotten when there are too many, so memory stays bounded."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, unknown: int = 0):
        self.lowest = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.trie = ahocorasick.Automaton()
        last = {p: s for p, s in vocabulary}  # of equal pieces the last counts
        for p, s in last.items():
            if p:
                self.trie.add_word(p, (len(p), s))
        self.trie.make_automaton()
        self.hashes, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # of chunks, by hash

    def piece_count(self, word: str) -> int:
        """Pieces of the best path over one pre-tokenized word."""
        # Matches come by end; of one end the longest first, which is the order of starts,
        # so a path is replaced only by a greater score, as if starts were visited in order.
        n = len(word)
        best, count, open_bytes = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        at, top, single = 0, None, True

        def close() -> None:
            if not single:
                score = best[at - 1] + self.lowest
                if top is None or score > top:
                    size = len(word[at - 1].encode("utf-8", "surrogatepass"))
                    best[at], open_bytes[at] = score, open_bytes[at - 1] + size
                    count[at] = count[at - 1] + (size if self.bytes else 0 if open_bytes[at - 1] else 1)

        for end, (length, score) in self.trie.iter(word):
            while at <= end:
                close()
                at, top, single = at + 1, None, False
            score += best[at - length]
            single = single or length == 1
            if top is None or score > top:
                top = best[at] = score
                count[at], open_bytes[at] = count[at - length] + 1, 0
        while at < n:
            close()
            at, top, single = at + 1, None, False
        close()
        return count[n]

    def word(self, word: str) -> int:
        """Pieces of a word between white space."""
        if word[0] != MARK:
            word = MARK + word
        if MARK not in word[1:]:
            return self.piece_count(word)
        return sum(self.piece_count(MARK + w) for w in word[1:].split(MARK))

    def chunk(self, chunk: str) -> int:
        """Pieces of a chunk between ASCII white space, within which wider spaces separate as well."""
        if chunk.isascii():  # neither space nor mark is left in it
            return self.piece_count(MARK + chunk)
        return sum(self.word(w) for w in _SPACE.split(chunk) if w)

    def texts(self, column: pa.Array) -> np.ndarray:
        """Pieces of each text."""
        out = np.zeros(len(column), dtype=np.int64)
        for row, data, off in text_chunks(column):
            words = Words(data, off, SPACED, lower=False)
            found, first, at = np.unique(words.hashes()[0], return_index=True, return_inverse=True)
            place = np.searchsorted(self.hashes, found)
            known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == found if len(self.hashes) else np.zeros(len(found), dtype=bool)
            counts = np.empty(len(found), dtype=np.int64)
            counts[known] = self.counts[place[known]]
            new = np.flatnonzero(~known)
            raw = data.tobytes() if len(new) else b""
            begin, end = words.start[first[new]].tolist(), words.end[first[new]].tolist()
            counts[new] = [self.chunk(raw[a:b].decode()) for a, b in zip(begin, end, strict=True)]
            if len(new):
                if len(self.hashes) + len(new) > CACHE:
                    self.hashes, self.counts = self.hashes[:0], self.counts[:0]
                    place = np.zeros(len(found), dtype=np.int64)
                    known = np.zeros(len(found), dtype=bool)
                    new = np.arange(len(found))[:CACHE]
                self.hashes, self.counts = np.insert(self.hashes, place[new], found[new]), np.insert(self.counts, place[new], counts[new])
            out[row : row + len(off) - 1] = row_sums(counts[at.reshape(-1)].astype(np.float64), words.at).astype(np.int64)  # exact below 2**53
        return out

    def text(self, text: str | None) -> int:
        return int(self.texts(pa.array([text], pa.large_string()))[0])


_counters: dict[tuple, Counter] = {}  # of this worker process


def count_tokens(docs: DataFrame, path: str = VOCABULARY, byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_chars, n_tokens for every row of docs."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(path))  # the vocabulary's size is the tokenizer's

    @F.arrow_udf("long")
    def tokens(text: pa.Array) -> pa.Array:
        key = (path, byte_fallback)
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value, byte_fallback)
        counter = _counters[key]
        return pa.array(counter.texts(text), pa.int64())

    return docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), tokens(F.col("text")).alias("n_tokens"))
