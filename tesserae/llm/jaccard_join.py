"""Exact n-gram Jaccard join of all documents, as components, by set-relation skipping.

A document's set holds the 64-bit hashes of its distinct word n-grams (a shorter
document: its whole sequence). With d the size of the symmetric difference, a similarity of
num/den or more means d <= (|x| + |y|)(den - num) / (den + num).

Index. Sizes fall into classes, each as wide as a similar pair's sizes can differ.
In a class the range of hashes is cut into positions, more than d can be, so that
a similar pair agrees on the whole content of one position at least. A list of the
index holds the sets with equal content at one position of one class; lists of one
set are skipped. Positions are numerous enough that empty ones can be skipped as
well; the rare sets with more empty positions than that are listed under empty
positions too, which keeps the join exact.

Before any set travels, the members of a cell are compared by bitmaps: the parity of
the number of items in each of 512 parts or more, twice as many as the set has items; a longer one is folded to a shorter one's length. Two bitmaps
differ in no more bits than their sets do, so a member whose bitmap is too far from all others leaves the cell.

Answers. The first set of a list leads it. A set joins the cell of each leader of its
lists, so two similar sets meet in a cell. Within a cell members are compared with
the leader first. Those similar to it take its answers as theirs: they are in
its component, and nothing is left to find among them. Only the rest are looked up, in lists of the members' rarest
items (see Lists), of whose blocks those are skipped whose size or position rules a similar set out. Of what is
left, sets are skipped that by the triangle inequality of the Jaccard distance are too near or too far from the leader,
and so is whatever is in the same component already, by the answers of sets before. A cell yields a link for each two
components it joins, never all pairs. Large cells are cut into chunks. Their members are compared
with the leader first, each once; those similar to it meet only chunks of the rest, in tasks of
bounded size, so a large group of near copies costs as many rows as it has members. Lists that are
very long get their leader from partial minima instead of being gathered.

Components come from the links by star contractions on the cluster; each round's
links are written to the shared folder. Documents with equal sets are one node
throughout: a group of copies costs one row a document.

Defined results: empty and null texts have an empty set and are their own component;
rows with null doc_id take part, and component_id is the least doc_id that isn't null
(null if there is none). Repeated rows have equal sets and get equal results. Equal hashes of
different n-grams (2**-64 a pair) would count as one n-gram.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import U64, Words, by_rows, mix, release, remove, row_sums, small_batches, stored, text_chunks, text_key, work_dir

CELL_ROWS = 2048
CELL_ITEMS = 1_000_000
BITMAP = 512
LONG_LIST = 200_000  # rows
SAMPLED = 64  # one node in so many tells which lists are long; this decides the plan, never a result
MOST_BROADCAST = 1_000_000  # lists


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int):
    """The sorted distinct hashes of each text's word n-grams."""
    words = Words(data, off)
    h = words.hashes()[0]
    count = words.counts()
    grams = np.zeros(len(h), dtype=np.uint64)
    m = len(h) - n + 1
    if m > 0:
        run = h[:m].copy()
        for k in range(1, n):
            run = mix(run * U64(0x9E3779B97F4A7C15) + h[k : k + m])
        grams[:m] = mix(run + U64(n))
    for i in range(len(off) - 1):
        a, c = words.at[i], int(count[i])
        if c >= n:
            yield np.unique(grams[a : a + c - n + 1])
        elif c:
            run = h[a : a + 1].copy()
            for k in range(1, c):
                run = mix(run * U64(0x9E3779B97F4A7C15) + h[a + k : a + k + 1])
            yield mix(run + U64(c))
        else:
            yield grams[:0]


class Positions:
    """Size classes and the number of positions of each."""

    def __init__(self, num: int, den: int, width: float = 1.3):
        if not 0 < num <= den:
            raise ValueError("the similarity must be above 0 and at most 1")
        self.num, self.den, self.width = num, den, max(width, den / num)
        self.low = [1]
        self._edges: dict[int, tuple[int, int, np.ndarray]] = {}

    def _reach(self, c: int) -> None:
        while len(self.low) <= c + 2:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * self.width)))

    def classes(self, size: int) -> list[int]:
        """The set's own class, and the next if a similar set can be there."""
        while self.low[-1] <= size:
            self._reach(len(self.low))
        own = int(np.searchsorted(self.low, size, side="right")) - 1
        self._reach(own)
        return [own, own + 1] if size * self.den >= self.num * self.low[own + 1] else [own]

    def of(self, c: int) -> tuple[int, int, np.ndarray]:
        """Positions of class c, how many may be empty, and the hashes at which they begin."""
        if c not in self._edges:
            self._reach(c)
            high, least = self.low[c + 1] - 1, math.ceil(self.low[c] * self.num / self.den)
            differ = 2 * high * (self.den - self.num) // (self.den + self.num)
            spare, k = 0, differ + 1
            for _ in range(30):
                empty = k * math.exp(-max(1, least) / k)
                more = math.ceil(empty + 4 * math.sqrt(empty)) if k > 1 else 0
                if more <= spare:
                    break
                spare, k = more, differ + 1 + more
            self._edges[c] = k, k - differ - 1, np.array([(j << 64) // k for j in range(1, k)], dtype=np.uint64)
        return self._edges[c]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """One hash for each (class, position, content) under which the set is listed."""
        total = np.zeros(len(s) + 1, dtype=np.uint64)
        np.cumsum(mix(s + U64(0x5851F42D4C957F2D)), out=total[1:])
        out = []
        for c in self.classes(len(s)):
            k, spare, edges = self.of(c)
            cut = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
            content = total[cut[1:]] - total[cut[:-1]]
            seed = U64((c * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64))
            sig = mix(mix(content + seed) + np.arange(k, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
            empty = cut[1:] == cut[:-1]
            out.append(sig if empty.sum() > spare else sig[~empty])
        return np.concatenate(out)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Whether each of some parts of the hash's range holds an odd number of the set's items; twice as many parts as items or more, a power of two."""
    bits = max(BITMAP, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps, one a row, as those of `width` words: the parity of two parts together is that of both."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


class Lists:
    """An inverted index over the prefixes of sets, whose lists are cut into blocks of equal size and position.

    Items are in order of frequency, the rarest first. Two similar sets share an item among the first size - ceil(size * num / den) + 1
    of each; the first they share stands at a position in either, after which too few may be left for what they must have in common. All
    entries of a block have one size and one position, so that is decided for a block at once, and no entry of a block that fails is read.
    """

    def __init__(self, sets: list[np.ndarray], size: np.ndarray, num: int, den: int):
        self.size, self.num, self.den = size, num, den
        items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, code, count = np.unique(items, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), dtype=np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        rank = rank[code.reshape(-1)]
        order = np.lexsort((rank, owner))  # each set's items, the rarest first
        rank = rank[order]
        first = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(len(rank)) - first[owner]
        prefix = size + num * size // -den + 1  # size - ceil(size * num / den) + 1
        kept = place < prefix[owner]
        self.item, self.place, owner = rank[kept], place[kept], owner[kept]
        self.begin = np.searchsorted(owner, np.arange(len(sets) + 1))
        by = np.lexsort((owner, self.place, size[owner], self.item))
        item, place, self.owner = self.item[by], self.place[by], owner[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (size[self.owner[1:]] != size[self.owner[:-1]]) | (place[1:] != place[:-1])
        self.block = np.flatnonzero(new)
        self.block_end = np.append(self.block[1:], len(by))
        self.block_place, self.block_size = place[self.block], size[self.owner[self.block]]
        self.wide = int(size.max()) + 1
        self.block_key = item[self.block] * self.wide + self.block_size  # blocks are in order of item, size and position
        self.read = self.skipped = 0  # blocks

    def candidates(self, i: int) -> np.ndarray:
        """Sets that may be similar to set i, in order."""
        mine = slice(self.begin[i], self.begin[i + 1])
        item, place, n = self.item[mine], self.place[mine], int(self.size[i])
        low, high = -(self.num * n // -self.den), n * self.den // self.num  # the sizes that a similar set can have
        every = np.searchsorted(self.block_key, (item + 1) * self.wide) - np.searchsorted(self.block_key, item * self.wide)
        at = np.searchsorted(self.block_key, item * self.wide + min(low, self.wide - 1))
        to = np.maximum(at, np.searchsorted(self.block_key, item * self.wide + min(high, self.wide - 1), side="right"))
        query = np.repeat(np.arange(len(item)), to - at)
        block = _ranges(at, to)
        least = -(self.num * (n + self.block_size[block]) // -(self.num + self.den))
        block = block[np.minimum(n - place[query], self.block_size[block] - self.block_place[block]) >= least]
        self.read += len(block)
        self.skipped += int(every.sum()) - len(block)
        return np.unique(self.owner[_ranges(self.block[block], self.block_end[block])])


def _ranges(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """at[0], .., to[0] - 1, at[1], .."""
    size = to - at
    if not size.sum():
        return np.zeros(0, dtype=np.int64)
    return np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


def _common(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many items each of the others shares with x; sets are sorted."""
    items = np.concatenate(others)
    same = x[np.minimum(np.searchsorted(x, items), len(x) - 1)] == items
    return row_sums(same.astype(np.float64), np.concatenate([[0], np.cumsum([len(s) for s in others])])).astype(np.int64)


class Cell:
    """Members of a cell or of two chunks of one; finds links that join their components."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray], side: np.ndarray, leader: int, num: int, den: int):
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.nodes, self.sets, self.side = [nodes[i] for i in order], [sets[i] for i in order], side[order]
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.num, self.den = num, den
        self.leader = self.nodes.index(leader)
        self.parent = np.arange(len(nodes))
        self.links: list[tuple[int, int]] = []
        self.lists: Lists | None = None
        self.compared = 0  # pairs of sets

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[b] = a
            self.links.append((self.nodes[i], self.nodes[j]))

    def similar(self, common: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (self.size[i] + self.size[others] - common)

    def compare(self, i: int, others: np.ndarray) -> np.ndarray:
        self.compared += len(others)
        return self.similar(_common(self.sets[i], [self.sets[j] for j in others]), i, others)

    def run(self, known: bool = False, at_once: int = 64) -> list[tuple[int, int]]:
        """The links; not those with the leader if they are known."""
        m = len(self.nodes)
        everyone = np.arange(m)
        common = _common(self.sets[self.leader], self.sets)
        self.compared += m - 1
        near = self.similar(common, self.leader, everyone)
        for j in np.flatnonzero(near):
            self.join(self.leader, int(j))
        if known:
            self.links.clear()
        if near.all() or m == 2:  # all take the leader's answers
            return self.links
        distance = 1 - common / np.maximum(self.size + self.size[self.leader] - common, 1)
        bound = 1 - self.num / self.den + 1e-9
        cut = bool((self.side == 1).any())  # two chunks: only pairs across them are due here
        self.lists = Lists(self.sets, self.size, self.num, self.den)
        for i in np.flatnonzero(~near):
            i = int(i)
            todo = self.lists.candidates(i)
            todo = todo[(np.abs(distance[todo] - distance[i]) <= bound) & (near[todo] | (todo > i))]  # of two that are looked up, the first asks
            if cut:
                todo = todo[self.side[todo] != self.side[i]]
            while len(todo):
                # what one answer says of a component is said of all its members
                mine = self.root(i)
                todo = todo[np.array([self.root(int(j)) != mine for j in todo])]
                some, todo = todo[:at_once], todo[at_once:]
                if len(some):
                    for j in some[self.compare(i, some)]:
                        self.join(i, int(j))
        return self.links


def _describe(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, key, n_shingles, node, sigs, bits; of equal sets that a task meets again, the signatures come once."""

    def run(batches):
        positions, seen = Positions(num, den), set()
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for row, data, off in text_chunks(batch.column("text")):
                sizes, nodes, sigs, maps = [], [], [], []
                for s in shingle_sets(data, off, n):
                    node = _node(s) if len(s) else None
                    sizes.append(len(s))
                    nodes.append(node)
                    maps.append(bitmap(s) if node is not None else np.zeros(0, np.int64))
                    if node is None or node in seen:
                        sigs.append(np.zeros(0, np.int64))
                    else:
                        if len(seen) >= 1_000_000:
                            seen.clear()  # then some come twice, which changes nothing
                        seen.add(node)
                        sigs.append(positions.signatures(s).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(off) - 1), keys.slice(row, len(off) - 1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), _lists(sigs), _lists(maps)], names=["doc_id", "key", "n_shingles", "node", "sigs", "bits"]
                )

    return docs.mapInArrow(run, "doc_id long, key long, n_shingles long, node long, sigs array<long>, bits array<long>")


def _sets_of(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, data, off in text_chunks(batch.column("text")):
                sets = [s for s in shingle_sets(data, off, n) if len(s)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                items = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(items))], names=["node", "items"])

    return docs.mapInArrow(run, "node long, items array<long>")


def _by_task(batches, column: str, finish, names: list[str]):
    """Gathers the rows of each (leader, i, j), which come one after another, and yields the pairs that finish() makes of them."""

    def batch(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=names)

    now, rows, out = None, {}, []
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in ("leader", "i", "j")), strict=True))
        side, node, size = (b.column(c).to_pylist() for c in ("side", "node", "n_shingles"))
        flat = np.asarray(b.column(column).flatten()).view(np.uint64)
        at = np.concatenate([[0], np.cumsum(np.asarray(b.column(column).value_lengths()))])
        for k, key in enumerate(keys):
            if key != now:
                out += finish(now, rows) if len(rows) > 1 else ()
                now, rows = key, {}
            rows.setdefault(node[k], (flat[at[k] : at[k + 1]].copy(), side[k], size[k]))  # a set that comes again counts once
        if len(out) >= 10_000:
            yield batch(out)
            out = []
    out += finish(now, rows) if len(rows) > 1 else ()
    if out:
        yield batch(out)


def _cell_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links found in cells; members: leader, i, j, side, node, n_shingles, items, in order of (leader, i, j)."""

    def finish(key, rows):
        if key[0] not in rows:
            return []
        # tasks of large cells are numbered above 0 if they have members similar to the leader, whose links are known
        return Cell(list(rows), [r[0] for r in rows.values()], np.array([r[1] for r in rows.values()]), key[0], num, den).run(key[2] > 0)

    return members.mapInArrow(lambda batches: _by_task(batches, "items", finish, ["a", "b"]), "a long, b long")


def _star_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links between leaders and the members similar to them; members as above, a chunk and its leader in a task."""

    def finish(key, rows):
        if key[0] not in rows:
            return []
        lead, nodes = rows[key[0]][0], list(rows)
        sizes = np.array([len(r[0]) for r in rows.values()], dtype=np.int64)
        common = _common(lead, [r[0] for r in rows.values()])
        return [(key[0], nodes[k]) for k in np.flatnonzero(den * common >= num * (sizes + len(lead) - common)) if nodes[k] != key[0]]

    return members.mapInArrow(lambda batches: _by_task(batches, "items", finish, ["a", "b"]), "a long, b long")


def near_bitmaps(maps: list[np.ndarray], size: np.ndarray, side: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which members' bitmaps and sizes allow a similar one; with two chunks, across them. Pairs that short bitmaps leave are compared by whole ones."""
    cut = bool((side == 1).any())
    m = len(maps)
    maps = [x.view(np.uint64) for x in maps]  # bits of signed numbers would be counted without the sign
    width = np.array([len(x) for x in maps])
    short = np.empty((m, BITMAP // 64), dtype=np.uint64)
    whole = {int(w): (np.flatnonzero(width == w), np.stack([maps[k] for k in np.flatnonzero(width == w)])) for w in np.unique(width)}
    at = np.empty(m, dtype=np.int64)  # a member's place among those of its width
    for w, (which, rows) in whole.items():
        short[which], at[which] = folded(rows, BITMAP // 64), np.arange(len(which))
    allowed = lambda a, b: (size[a] + size[b]) * (den - num) // (den + num)
    out = np.zeros(m, dtype=bool)
    step = max(1, (1 << 19) // max(1, m))
    for first in range(0, m, step):
        rows = np.arange(first, min(first + step, m))
        differ = np.zeros((len(rows), m - first), dtype=np.int32)
        for k in range(short.shape[1]):
            differ += np.bitwise_count(short[rows, k, None] ^ short[None, first:, k])
        others = np.arange(first, m)
        ok = differ <= allowed(rows[:, None], others[None, :])
        ok &= (size[rows, None] * den >= num * size[None, first:]) & (size[None, first:] * den >= num * size[rows, None]) & (others[None, :] > rows[:, None])
        if cut:
            ok &= side[rows, None] != side[None, first:]
        a, b = np.nonzero(ok)
        a, b = rows[a], others[b]
        for wa in np.unique(width[a]).tolist():
            for wb in np.unique(width[b[width[a] == wa]]).tolist():
                some = np.flatnonzero((width[a] == wa) & (width[b] == wb))
                w = min(wa, wb)
                left, right = folded(whole[wa][1], w), folded(whole[wb][1], w)
                at_once = max(1, (1 << 19) // w)
                for c in range(0, len(some), at_once):
                    x, y = a[some[c : c + at_once]], b[some[c : c + at_once]]
                    near = np.bitwise_count(left[at[x]] ^ right[at[y]]).sum(axis=1, dtype=np.int64) <= allowed(x, y)
                    out[x[near]] = out[y[near]] = True
    return out


def _near_members(members: DataFrame, num: int, den: int) -> DataFrame:
    """leader, node: the members that the bitmaps leave, and their leaders."""

    def finish(key, rows):
        maps = [r[0] for r in rows.values()]
        near = near_bitmaps(maps, np.array([r[2] for r in rows.values()], dtype=np.int64), np.array([r[1] for r in rows.values()]), num, den)
        return [(key[0], n) for n, ok in zip(rows, near.tolist(), strict=True) if ok or (n == key[0] and near.any())]

    return members.mapInArrow(lambda batches: _by_task(batches, "bits", finish, ["leader", "node"]), "leader long, node long").distinct()


def _chunks(rows, held, cell_rows: int, cell_items: int):
    return F.greatest(F.ceil(rows / cell_rows), F.ceil(held / cell_items)).cast("int")


def _large(sized: DataFrame, cell_rows: int, cell_items: int) -> DataFrame:
    """leader, chunks of the cells that need more than one; sized: leader, node, n_shingles."""
    spread = sized.groupBy("leader").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("held"))
    return spread.select("leader", _chunks(F.col("rows"), F.col("held"), cell_rows, cell_items).alias("chunks")).filter("chunks > 1")


def _once(sized: DataFrame, large: DataFrame) -> DataFrame:
    """leader, i, j, side, node, n_shingles: each member of a large cell in one chunk, with the leader in all."""
    cut = sized.join(large, "leader")
    own = cut.filter("node <> leader").withColumn("i", F.pmod(F.xxhash64("node", "leader"), F.col("chunks")).cast("int")).withColumn("side", F.lit(0))
    heads = cut.filter("node = leader").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(2))
    return own.unionByName(heads).select("leader", "i", F.col("i").alias("j"), "side", "node", "n_shingles")


def _dealt(cells: DataFrame, cell_rows: int, cell_items: int) -> DataFrame:
    """leader, i, j, side, node, n_shingles: which tasks get which members of cells (leader, node, n_shingles, near).

    Chunks of near members, which need no comparison with each other, come first. A near member goes to each pair
    of its chunk and one of the rest, any other member to each pair that holds its chunk, and the leader to all.
    In a cell of one chunk no member is near, so a member goes to one task.
    """
    some = lambda of: (F.coalesce(F.count_if(of), F.lit(0)), F.coalesce(F.sum(F.when(of, F.col("n_shingles"))), F.lit(0)))
    member = F.col("node") != F.col("leader")
    spread = cells.groupBy("leader").agg(
        _chunks(*some(member & F.col("near")), cell_rows, cell_items).alias("n"), _chunks(*some(member & ~F.col("near")), cell_rows, cell_items).alias("f")
    )
    dealt = cells.join(spread.filter("f > 0"), "leader")
    draw, last = F.xxhash64("node", "leader"), F.col("n") + F.col("f") - 1
    chunk = F.when(F.col("near"), F.pmod(draw, F.greatest("n", F.lit(1)))).otherwise(F.col("n") + F.pmod(draw, F.col("f"))).cast("int")
    other = F.explode(F.sequence(F.when(F.col("near"), F.col("n")).otherwise(0), last))
    own = dealt.filter(member).select("leader", "node", "n_shingles", chunk.alias("c"), other.alias("o")).select(
        "leader", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.when(F.col("c") <= F.col("o"), 0).otherwise(1).alias("side"), "node", "n_shingles"
    )
    heads = dealt.filter(~member).select("leader", "node", "n_shingles", "n", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    heads = heads.select("leader", "i", F.explode(F.sequence(F.greatest("i", "n"), F.col("last"))).alias("j"), F.lit(2).alias("side"), "node", "n_shingles")
    return own.unionByName(heads)


def _led(base: DataFrame, top: str, long_list: int) -> DataFrame:
    """leader, node for each list of two sets or more; the rows of a very long list are not gathered."""
    listed = base.filter(F.size("sigs") > 0).select("node", F.explode("sigs").alias("sig"))
    some = base.filter((F.size("sigs") > 0) & (F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0)).select(F.explode("sigs").alias("sig"))
    long = stored(some.groupBy("sig").count().filter(F.col("count") >= max(2, long_list // SAMPLED)).select("sig"), f"{top}/long")
    n = long.count()
    few = F.broadcast if n <= MOST_BROADCAST else lambda df: df
    lists = Window.partitionBy("sig")
    rest = listed.join(few(long), "sig", "left_anti") if n else listed
    led = rest.withColumn("leader", F.min("node").over(lists)).withColumn("_last", F.max("node").over(lists))
    if n:
        ends = listed.join(few(long), "sig", "left_semi").groupBy("sig").agg(F.min("node").alias("leader"), F.max("node").alias("_last"))
        led = led.unionByName(listed.join(few(stored(ends, f"{top}/ends")), "sig"))
    return led.filter("leader <> _last").select("leader", "node").distinct()


def _together(members: DataFrame, column: str) -> DataFrame:
    return members.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").select("leader", "i", "j", "side", "node", "n_shingles", column)


def _are_stars(links: DataFrame) -> bool:
    """Whether no node is the upper end (a) of two links, nor of one while it is a lower end (b): then each lower end is the least node of its component."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("b", F.lit(0), F.lit(1)))
    most = ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n")).agg(F.max("n")).first()[0]
    return most is None or most < 2


def connected_components(links: DataFrame, top: str) -> DataFrame:
    """node, component (its least node) from links a, b, by large-star and small-star rounds until only stars are left; each is written to `top`."""
    spark = links.sparkSession

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(least.withColumnRenamed("u", "u_"), F.col("u") == F.col("u_"))
        if large:
            return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()

    now, k = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{top}/links-0"), 0
    while not _are_stars(now):  # each round that changes a link lowers an end of it, and one that changes none has met stars, so the rounds end
        k += 1
        now = stored(stars(stars(now, True), False), f"{top}/links-{k}")
        remove(spark, f"{top}/links-{k - 1}")
        release(spark)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _rows_in_components(docs: DataFrame, n: int, num: int, den: int, cell_rows: int, cell_items: int, long_list: int) -> DataFrame:
    """doc_id, key (of the text), n_shingles, component_id, first (whether doc_id and text are those of its component's first row) for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    top = work_dir(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key"))
    base = stored(_describe(docs, n, num, den), f"{top}/base")

    cells = stored(_led(base, top, long_list), f"{top}/cells")
    plain = stored(base.select("doc_id", "key", "n_shingles", "node"), f"{top}/plain")
    facts = stored(base.filter("node IS NOT NULL").groupBy("node", "n_shingles").agg(F.min(F.struct("doc_id", "key")).alias("one"), F.first("bits").alias("bits")), f"{top}/facts")
    base = None
    remove(spark, f"{top}/base")
    release(spark)
    size = facts.select("node", "n_shingles")

    # by bitmaps alone; a cell is cut beyond a bound of rows, and members that may be similar to its leader stay
    sized = cells.join(size, "node")
    large = stored(_large(sized, cell_rows, cell_items * 1000), f"{top}/large-by-bitmap")
    cut = not large.isEmpty()
    marked = sized.withColumn("near", F.lit(False))
    if cut:
        lead = facts.select(F.col("node").alias("leader"), F.col("n_shingles").alias("_n"), F.col("bits").alias("_bits"))
        xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
        half = lambda x: xor(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")))
        bits, _bits, wide, _wide = F.col("bits"), F.col("_bits"), F.size("bits"), F.size("_bits")
        between = F.when(wide == _wide, xor(bits, _bits)).when(wide == 2 * _wide, xor(half(bits), _bits)).when(_wide == 2 * wide, xor(bits, half(_bits)))
        differ = F.aggregate(between, F.lit(0), lambda a, x: a + F.bit_count(x))
        able = F.coalesce(differ * (den + num) <= (F.col("n_shingles") + F.col("_n")) * (den - num), F.lit(True))
        members = sized.join(large.select("leader"), "leader", "left_semi").join(facts.select("node", "bits"), "node").join(lead, "leader")
        members = stored(members.select("leader", "node", "n_shingles", able.alias("near")), f"{top}/near-by-bitmap")
        marked = marked.join(large.select("leader"), "leader", "left_anti").unionByName(members)
    mapped = _dealt(marked, cell_rows, cell_items * 1000).join(facts.select("node", "bits"), "node")
    left = _near_members(_together(mapped, "bits"), num, den)
    cells = stored(left.unionByName(members.filter("near").select("leader", "node")).distinct() if cut else left, f"{top}/near")
    mapped = None
    release(spark)

    # the sets of the members that are left, from one document each
    source = facts.join(cells.select("node").distinct(), "node", "left_semi").select("one.*")
    sets = stored(_sets_of(by_rows(docs, stored(source, f"{top}/source"), "left_semi").select("text"), n), f"{top}/sets")
    sized = cells.join(size, "node")
    large = stored(_large(sized, cell_rows, cell_items), f"{top}/large")
    cut = not large.isEmpty()
    marked = sized.withColumn("near", F.lit(False))
    if cut:
        star = stored(_star_links(_together(_once(sized, large).join(sets, "node"), "items"), num, den).distinct(), f"{top}/star")
        near = star.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.lit(True).alias("near"))
        members = sized.join(large.select("leader"), "leader", "left_semi").join(near, ["leader", "node"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
        marked = marked.join(large.select("leader"), "leader", "left_anti").unionByName(members)
    grouped = _together(_dealt(marked, cell_rows, cell_items).join(sets, "node"), "items")
    links = stored(_cell_links(grouped, num, den).unionByName(star) if cut else _cell_links(grouped, num, den), f"{top}/found")
    grouped = sets = None
    remove(spark, f"{top}/sets")
    release(spark)

    component = connected_components(links, top)
    # the first row of a component has its least doc_id (null after all others) and of those its least key
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    least = plain.filter("node IS NOT NULL").groupBy("node").agg(F.min(order).alias("least")).join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # partial minima, then a join that Spark can split: a component may hold any share of the nodes
    smallest = least.groupBy("component").agg(F.min("least").alias("least"))
    named = stored(least.drop("least").join(smallest, "component").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("_key")), f"{top}/named")
    return plain.join(named, "node", "left").select(
        "doc_id", "key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("_key"))).alias("first"),
    )


def jaccard_components(docs: DataFrame, n: int, num: int, den: int, cell_rows: int = CELL_ROWS, cell_items: int = CELL_ITEMS, long_list: int = LONG_LIST) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; two documents link when den * |x & y| >= num * |x | y|."""
    return _rows_in_components(docs, n, num, den, cell_rows, cell_items, long_list).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs, all columns, one of each component: of its least doc_id (a null one only if all are) and, where texts share that, one text. Rows without words stay."""
    rows = _rows_in_components(docs, n, num, den, CELL_ROWS, CELL_ITEMS, LONG_LIST).filter("n_shingles > 0")
    listed = rows.groupBy("doc_id", "key").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("n")).filter("NOT first OR n > 1")
    listed = stored(listed, f"{work_dir(docs.sparkSession, 'kept')}/listed")
    release(docs.sparkSession)
    out = by_rows(docs, listed.select("doc_id", "key"), "left_anti")
    copies = listed.filter("first").select("doc_id", "key")
    if copies.isEmpty():
        return out
    # of first rows that repeat doc_id and text, one; partial minima, so that a row's copies needn't meet
    whole = F.struct(*docs.columns)
    one = by_rows(docs, copies, "left_semi").groupBy(F.col("doc_id").alias("_row_id"), text_key(F.col("text")).alias("_row_key")).agg(F.min_by(whole, F.to_json(whole)).alias("_row"))
    return out.unionByName(one.select("_row.*"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, shingle FROM (SELECT r, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.r <> y.r GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
t AS (SELECT r, r AS o FROM d UNION SELECT t.r, l.b FROM t JOIN l ON t.o = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n USING (r)
JOIN (SELECT t.r, min(e.doc_id) AS component_id FROM t JOIN d e ON e.r = t.o GROUP BY t.r) m USING (r)
"""
