"""N-gram Jaccard join with signature trees.

Texts with the same shingle set are one node. Sets that can reach the similarity share a shingle among the first
n - ceil(0.75 n) + 1 of their sets in any common order; the order used is that of a sketch's counts, rare ones first, so
passages of many documents seldom bring nodes together. Each such shingle is the root of a signature tree over the nodes
that have it; of shingles with the same nodes one is enough. Leaves, in order of size, hold a bitmap of a set; inner
nodes the OR of their children's bitmaps and the range of their sizes. Every candidate comes out of a tree, and links join
leaves to classes between traversals. The first takes neighbouring leaves whose bitmaps allow a link. The others descend from
pairs of nodes, and leave out those whose sizes, classes or greatest possible overlap exclude a link: in trees of more than
LARGE leaves first for the NEAREST candidates of each leaf alone, so that a group of near copies meets in one class and not
pair by pair, then in all trees for every candidate that is left. Of the trees in which two nodes meet only the largest
tells their pair, as far as both have it among their KNOWN largest. Bitmaps, the widest column, come last: only to leaves that
some other leaf of their tree can link with by size, class and larger roots, and for the first traversal each pair of
neighbours stays in one tree. Candidates are compared set by set. Components are found by star rounds.

A tree has at most TILE leaves: a shingle of more nodes has several trees, which are traversed pair by pair. Texts are
staged once with a number; sets are made again from them where they are needed, and which of them is told by one small
file for each task, so no text is shuffled, and of sets only those of candidate pairs. Sets are of 64-bit hashes.

Defined results: null and blank texts have no shingles and are components of their own; fewer than five words are one
shingle; equal texts have one component; null ids join components and are never their name unless no id is known;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoraflow.llm import pieces
from agoraflow.llm.shared import SEPARATORS, dropped, freed, fresh_path, staged, trimmed, unused
from agoraflow.llm.sidefiles import TASK_BITS, read_numbers, write_numbers

WORDS, PERCENT = 5, 75
#: Counters of the frequency sketch: fixed, so that it can be broadcast.
#: Counters of the sketch, in so many parts; characters of texts that are split together.
SKETCH, SLICES, SLICE = 1 << 20, 64, 1 << 18
BROADCAST_ROWS = 200_000
#: Leaves of a tree; texts made into sets together.
TILE, ROWS = 2048, 512
#: Roots of a node, the largest ones, by which a tree knows pairs that a larger one tells.
KNOWN = 16
#: Leaves from which on a tree is traversed for the nearest candidates first; how many of a leaf are.
LARGE, NEAREST = 64, 3
#: Rows of a tree or a pair of tiles beyond which all get their bitmaps.
PAIRWISE = 256
#: Children of a tree node.
FANOUT = 16
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M
    return x ^ (x >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(where words begin, their hashes) in UTF-8 text, A-Z in lower case."""
    weights, separators, lower = _bytes()
    code = np.frombuffer(data, np.uint8)
    apart = separators[code]
    at = np.flatnonzero(~apart & np.append(True, apart[:-1]))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    stop = np.flatnonzero(apart & np.append(False, ~apart[:-1]))
    size = (stop if len(stop) == len(at) else np.append(stop, len(code))) - at
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    letters = lower[code[~apart]]
    powers = np.cumprod(np.full(int(size.max()), _P, np.uint64))
    return at, _mixed(np.add.reduceat(weights[letters] * powers[place], begin) + size.astype(np.uint64))


@functools.lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    separators, lower = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    separators[[ord(c) for c in SEPARATORS]] = True
    lower[65:91] += 32
    return np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64), separators, lower


def shingle_sets(texts: list[str | None], size: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of runs of `size` words; of the whole sequence if it is shorter; none without words."""
    out: list[np.ndarray] = []
    for _, _, group in pieces.slices(texts, SLICE):
        data = [t.encode() for t in group]
        at, words = word_hashes(b" ".join(data))
        ends = np.searchsorted(at, np.cumsum([len(d) + 1 for d in data]))
        run = np.full(max(0, len(words) - size + 1), size, np.uint64)
        for i in range(size):
            run = _mixed(run * _P + words[i : i + len(run)])
        for a, b in zip([0, *ends.tolist()], ends.tolist()):
            if b - a >= size:
                out.append(np.unique(run[a : b - size + 1]))
            else:
                whole = np.full(min(1, b - a), b - a, np.uint64)
                for w in words[a:b]:
                    whole = _mixed(whole * _P + w)
                out.append(whole)
    return out


def needed(a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
    """The least intersection with which sets of these sizes link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def bit_count(n: int) -> int:
    """Bits of the bitmap of a set: a power of two, two to four for each shingle."""
    return min(1 << 20, max(256, 1 << int(2 * n - 1).bit_length()))


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(own & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap brought to fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


class Tree:
    """Levels of nodes over sets in order of size: bitmaps, least and greatest size, most shingles lost to equal bits, class or -1 if mixed,
    larger roots of all leaves as bits."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, label: np.ndarray, known: np.ndarray | None = None):
        lost = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, size, size, lost, label, np.zeros((len(bits), 0), np.uint64) if known is None else known)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, lost, label, known = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            same = np.minimum.reduceat(label, at) == np.maximum.reduceat(label, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at), np.where(same, label[at], -1), np.bitwise_and.reduceat(known, at)))


def dual(a: Tree, b: Tree, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sets of both trees that may link and have no larger root in common; with same, trees are one and each pair comes once."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        bits, low, high, lost, label, known = a.levels[la]
        bits2, low2, high2, lost2, label2, known2 = b.levels[lb]
        keep = (100 * high[i] >= PERCENT * low2[j]) & (100 * high2[j] >= PERCENT * low[i]) & ((label[i] != label2[j]) | (label[i] < 0))
        if same:
            keep &= i < j if la == lb == 0 else i <= j
        i, j = i[keep], j[keep]
        if known.shape[1]:
            keep = ~np.concatenate([(known[i[k : k + 4096]] & known2[j[k : k + 4096]]).any(1) for k in range(0, len(i), 4096)] or [np.zeros(0, bool)])
            i, j = i[keep], j[keep]
        most = np.concatenate([np.bitwise_count(bits[i[k : k + 4096]] & bits2[j[k : k + 4096]]).sum(1).astype(np.int64) for k in range(0, len(i), 4096)] or [np.zeros(0, np.int64)])
        keep = most + np.minimum(lost[i], lost2[j]) >= needed(low[i], low2[j])
        i, j = i[keep], j[keep]
        if la == lb == 0 or not len(i):
            yield i, j
            return
        down_a, down_b = la >= lb, lb >= la
        la, lb = la - down_a, lb - down_b
        na, nb = len(a.levels[la][0]), len(b.levels[lb][0])
        span = np.arange(FANOUT)
        ii = i[:, None] * FANOUT + span if down_a else i[:, None]
        jj = j[:, None] * FANOUT + span if down_b else j[:, None]
        i, j = np.repeat(ii, jj.shape[1], 1).ravel(), np.tile(jj, (1, ii.shape[1])).ravel()
        inside = (i < na) & (j < nb)
        i, j = i[inside], j[inside]


def shared_roots(above: list[list[int]]) -> np.ndarray:
    """For each set the roots in its list, as bits; those in one list alone have none."""
    found, which, times = np.unique(np.array([h for own in above for h in own], np.int64), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    out = np.zeros((len(above), -(-int((times > 1).sum()) // 64) * 64), bool)
    row = np.repeat(np.arange(len(above)), [len(own) for own in above])
    some = times[which] > 1
    out[row[some], column[which[some]]] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def tree_pairs(size: np.ndarray, bits: list[np.ndarray], label: np.ndarray, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that may link among sets with these sizes, bitmaps and classes: a tree for each length of bitmap; neighbouring lengths meet folded."""
    length = np.array([len(x) for x in bits])
    known = np.zeros((len(bits), 0), np.uint64) if known is None else known
    order = np.argsort(size, kind="stable")
    kinds = {int(n): order[length[order] == n] for n in np.unique(length)}
    trees = {n: Tree(np.stack([bits[k] for k in own]), size[own], label[own], known[own]) for n, own in kinds.items()}
    for n, own in kinds.items():
        for i, j in dual(trees[n], trees[n], True):
            yield own[i], own[j]
        if (more := kinds.get(2 * n)) is not None:
            other = Tree(np.stack([folded(bits[k], n) for k in more]), size[more], label[more], known[more])
            for i, j in dual(trees[n], other, False):
                yield own[i], more[j]


def across(size: np.ndarray, bits: list[np.ndarray], label: np.ndarray, first: np.ndarray, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As tree_pairs(), for pairs of a set in `first` and one that is not."""
    length = np.array([len(x) for x in bits])
    known = np.zeros((len(bits), 0), np.uint64) if known is None else known
    order = np.argsort(size, kind="stable")
    sides = [{int(n): order[(length[order] == n) & (first[order] == side)] for n in np.unique(length)} for side in (True, False)]

    def tree(own: np.ndarray, n: int) -> Tree:
        return Tree(np.stack([folded(bits[k], n) for k in own]), size[own], label[own], known[own])

    for n, own in sides[0].items():
        for m, other in sides[1].items():
            # sets link only if their sizes, and so the lengths of their bitmaps, differ by a factor of two at most
            if len(own) and len(other) and max(n, m) <= 2 * min(n, m):
                k = min(n, m)
                for i, j in dual(tree(own, k), tree(other, k), False):
                    yield own[i], other[j]


def row_mark() -> Column:
    """128 bits of hashes of id and text: rows with equal marks are repeated rows."""
    return F.concat_ws(" ", F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id")).alias("mark")


def numbered(docs: DataFrame) -> DataFrame:
    """(ref, doc_id, mark, text): ref is the number of the task that wrote the row times 2^33 plus its place."""
    rows = docs.select(F.monotonically_increasing_id().alias("ref"), F.col("doc_id").cast("long"), row_mark(), F.col("text").cast("string"))
    return staged(rows, "texts")


def keyed(texts: DataFrame) -> DataFrame:
    """Rows (ref, doc_id, mark, n, key), key a hash of the whole set, and rows (slice, counts) of the sketch, in which a task counts each set once."""
    schema = pa.schema([("ref", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.string()), ("n", pa.int64()), ("key", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(SKETCH, np.uint32), set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = shingle_sets(part.column(3).to_pylist())
                keys = [xxhash.xxh3_128_digest(own.tobytes()) for own in sets]
                new = [own for key, own in dict(zip(keys, sets, strict=True)).items() if len(own) and key not in seen]
                seen.update(keys)
                if new:
                    sketch += np.bincount((np.concatenate(new) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        if seen:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, schema.field(i).type) for i in range(5)), pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in sketch.reshape(SLICES, -1)], pa.binary())], schema=schema)
        trimmed()

    return texts.select("ref", "doc_id", "mark", "text").mapInArrow(run, "ref long, doc_id long, mark string, n long, key binary, slice int, counts binary")


def frequency_sketch(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[at] = held.get(at, 0) + np.frombuffer(counts, np.uint32).astype(np.uint64)
        if held:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(held), pa.int32()), "counts": [x.tobytes() for x in held.values()]})

    out = np.zeros((SLICES, SKETCH // SLICES), np.uint64)
    for row in parts.repartition(SLICES, "slice").mapInArrow(run, "slice int, counts binary").toLocalIterator():  # SKETCH counters
        out[row["slice"]] += np.frombuffer(row["counts"], np.uint64)
    return out.ravel()


def of_sets(texts: DataFrame, folder: str, make, kind: str) -> DataFrame:
    """What make(refs, sets) gives as a record batch for the rows whose numbers the files in folder name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wanted = None, np.zeros(0, np.int64)
        for batch in batches:
            refs = batch.column(0).to_numpy()
            keep = np.zeros(len(refs), bool)
            for task in np.unique(refs >> TASK_BITS).tolist():
                if task != at:
                    at, wanted = task, np.array(read_numbers(folder, task), np.int64)
                keep |= np.isin(refs, wanted)
            some = np.flatnonzero(keep)
            for i in range(0, len(some), ROWS):
                own = some[i : i + ROWS]
                yield make(refs[own].tolist(), shingle_sets(batch.column(1).take(pa.array(own)).to_pylist()))
        trimmed()

    return texts.select("ref", "text").mapInArrow(run, kind)


def prefixes(texts: DataFrame, folder: str, sketch) -> DataFrame:
    """(h, node, n): the shingles under which the sets named in folder are to meet."""

    def make(refs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        counts = sketch.value
        first = [own[np.lexsort((own, counts[(own & np.uint64(SKETCH - 1)).astype(np.int64)]))[: len(own) - -(-PERCENT * len(own) // 100) + 1]] for own in sets]
        size = [len(x) for x in first]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(refs, size)), pa.array(np.repeat([len(x) for x in sets], size).astype(np.int32))], names=["h", "node", "n"])

    return of_sets(texts, folder, make, "h long, node long, n int")


def met(rows: DataFrame) -> DataFrame:
    """(h, node, n, tile) of every shingle under which two or more nodes meet, from rows sorted by h, n and node; a tile is TILE nodes in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = None, 0  # the last row, which may begin a group, and its place in its group

        def rows_of(h, node, n, tile) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(node), pa.array(n), pa.array(tile.astype(np.int32))], names=["h", "node", "n", "tile"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                columns = [np.append(x, y) for x, y in zip(held, columns, strict=True)]
            h = columns[0]
            same = h[1:] == h[:-1]
            begin = np.flatnonzero(np.append(True, ~same))
            at = np.arange(len(h)) - np.repeat(begin, np.diff(begin, append=len(h)))
            at[: begin[1] if len(begin) > 1 else len(h)] += place
            keep = (at > 0) | np.append(same, False)
            keep[-1] = False  # told with the next batch
            if keep.any():
                yield rows_of(*(x[keep] for x in columns), at[keep] // TILE)
            held, place = [x[-1:] for x in columns], int(at[-1])
        if held is not None and place > 0:
            yield rows_of(*held, np.array([place // TILE]))

    return rows.select("h", "node", "n").mapInArrow(run, "h long, node long, n int, tile int")


def one_of_each(meetings: DataFrame) -> DataFrame:
    """meetings, with the number c of a shingle's nodes, without the shingles whose nodes are those of another shingle."""
    nodes = [F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x")]
    roots = meetings.groupBy("h").agg(*nodes).groupBy("c", "s", "x").agg(F.min("h").alias("h")).select("h", "c")
    return meetings.join(roots, "h")


def with_larger(meetings: DataFrame) -> DataFrame:
    """meetings with `above`: of the KNOWN roots of a node that have most nodes, those that come before its shingle in this order."""
    tops = meetings.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "h")), False), 1, KNOWN).alias("_tops"))
    before = lambda x: (x["c"] > F.col("c")) | ((x["c"] == F.col("c")) & (x["h"] > F.col("h")))
    return meetings.join(tops, "node").withColumn("above", F.transform(F.filter("_tops", before), lambda x: x["h"])).drop("_tops", "c")


def signatures(texts: DataFrame, folder: str) -> DataFrame:
    """(node, bits) of the sets named in folder."""

    def make(refs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array([bitmap(x, bit_count(len(x))).tobytes() for x in sets], pa.binary())], names=["node", "bits"])

    return of_sets(texts, folder, make, "node long, bits binary")


def linking(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets link."""
    spark, folder = pairs.sparkSession, fresh_path(pairs.sparkSession, "compared")
    write_numbers(pairs.select("a").union(pairs.select("b")), folder)

    def make(refs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "own"])

    sets = staged(of_sets(texts, folder, make, "node long, own binary"), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    keep.append(len(np.intersect1d(p, q, assume_unique=True)) >= needed(len(p), len(q)))
            told = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(told), batch.column(1).filter(told)], names=["a", "b"])
        trimmed()

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    out = staged(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    dropped(spark, sets)
    freed(spark)
    return out


def neighbours(size: np.ndarray, bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of neighbouring leaves, in order of size, that may link by their bitmaps."""
    order = np.argsort(size, kind="stable")
    found = []
    for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        if 100 * size[i] < PERCENT * size[j]:
            continue
        k = min(len(bits[i]), len(bits[j]))
        p, q = folded(bits[i], k), folded(bits[j], k)
        lost = min(size[i] - int(np.bitwise_count(p).sum()), size[j] - int(np.bitwise_count(q).sum()))
        if int(np.bitwise_count(p & q).sum()) + lost >= needed(int(size[i]), int(size[j])):
            found.append((i, j))
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def nearest(size: np.ndarray, bits: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of index pairs those that are, by bitmaps of one length, among the NEAREST of either side."""
    k = min(map(len, bits))
    short = np.stack([folded(b, k) for b in bits])
    both = np.concatenate([np.bitwise_count(short[i[a : a + 4096]] ^ short[j[a : a + 4096]]).sum(1).astype(np.int64) for a in range(0, len(i), 4096)] or [np.zeros(0, np.int64)])
    keep = np.zeros(len(i), bool)
    for side in (i, j):
        order = np.lexsort((np.abs(size[i] - size[j]), both, side))
        begin = np.flatnonzero(np.diff(side[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(begin, np.diff(begin, append=len(order)))
        keep[order[place < NEAREST]] = True
    return i[keep], j[keep]


def traversed(rows: DataFrame, full: bool, near: bool = False) -> DataFrame:
    """Candidate pairs (a, b), a < b, from rows (h, t, u, tile, node, n, bits, label, above) sorted by h, t, u: the trees of tiles t and u of
    a shingle, traversed from their roots (full; near: of each leaf the nearest), or the neighbouring leaves of one tree. A traversal
    from roots leaves a pair to the largest shingle that both have above this one."""

    def pairs(group: list[tuple], apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node, size, label = (np.array([g[k] for g in group], np.int64) for k in (1, 2, 4))
        bits = [np.frombuffer(g[3], np.uint64) for g in group]
        known = shared_roots([g[5] for g in group])
        if not full:
            found = [neighbours(size, bits)]
        elif apart:
            side = np.array([g[0] for g in group])
            found = across(size, bits, label, side == side.min(), known)
        else:
            found = tree_pairs(size, bits, label, known)
        if near:
            some = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)] or [np.zeros(0, np.int64)] * 2
            found = [nearest(size, bits, *some)]
        for i, j in found:
            yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        done: set[tuple[int, int]] = set()

        def told() -> Iterator[pa.RecordBatch]:
            for a, b in pairs(group, at[1] != at[2]) if len(group) > 1 else ():
                new = [p for p in zip(a.tolist(), b.tolist(), strict=True) if p not in done]
                if len(done) > 200_000:
                    done.clear()
                done.update(new)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in new], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                for h, t, u, *row in zip(*(c.to_pylist() for c in batch.slice(i, ROWS).columns), strict=True):
                    if (h, t, u) != at:
                        yield from told()
                        at, group = (h, t, u), []
                    group.append(tuple(row))
        yield from told()
        trimmed()

    parts = max(12, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("h", "t", "u", "tile", "node", "n", "bits", "label", "above").repartition(parts, "h", "t", "u").sortWithinPartitions("h", "t", "u", "n", "node")
    return staged(dealt.mapInArrow(run, "a long, b long").distinct(), "candidates")


def tile_pairs(members: DataFrame) -> DataFrame:
    """(h, t, u) of tiles of a shingle, t <= u, that hold different classes and whose sizes allow a link."""
    tiles = staged(members.groupBy("h", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("c")), "tiles")
    alone = tiles.where("x <> y").select("h", F.col("tile").alias("t"), F.col("tile").alias("u"))
    some = tiles.where("tile > 0").select("h").distinct()  # shingles of several tiles
    several = tiles.join(some, "h", "left_semi")
    left, right = several.select("h", *(F.col(c).alias(f"{c}1") for c in ("tile", "low", "high", "x", "y"))), several.select("h", *(F.col(c).alias(f"{c}2") for c in ("tile", "low", "high", "x", "y")))
    near = (F.col("tile1") < F.col("tile2")) & (100 * F.col("high1") >= PERCENT * F.col("low2")) & ((F.least("x1", "x2") != F.greatest("y1", "y2")))
    return alone.unionByName(left.join(right, "h").where(near).select("h", F.col("tile1").alias("t"), F.col("tile2").alias("u")))


def small_star(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, of which each u keeps the one to its least v; its other neighbours are joined to that v. Rows are read in order, none are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = least = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (batch.column(i).to_numpy() for i in range(2))
            first = np.append(u[0] != at, u[1:] != u[:-1])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(u)), -1))
            m = np.where(begin >= 0, v[np.maximum(begin, 0)], 0 if least is None else least)
            again = ~first & (v == np.append(-1 if last is None else last, v[:-1]))
            at, least, last = int(u[-1]), int(m[-1]), int(v[-1])
            keep = ~again
            yield pa.RecordBatch.from_arrays([pa.array(np.where(first, u, v)[keep]), pa.array(m[keep])], names=["u", "v"])

    parts = max(12, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return edges.repartition(parts, "u").sortWithinPartitions("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in links (a, b): rounds of small-star, then of every edge to the least neighbour of its lower end, until nothing changes."""
    mark = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    edges = staged(small_star(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")), "stars")
    was = mark(edges)
    while was[0]:
        least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        edges = staged(small_star(large), "stars")
        now = mark(edges)
        if now == was:
            break
        was = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return staged(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "components")


def relabelled(members: DataFrame, label: DataFrame) -> DataFrame:
    """members with the class of each node, itself where `label` (node, to) does not name it."""
    return members.drop("label").join(label, "node", "left").withColumn("label", F.coalesce("to", "node")).drop("to")


def contracted(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, to) after links (a, b) join classes; only classes go through the star rounds."""
    own = lambda df, c: df.join(label.select(F.col("node").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    joined = components(own(own(links, "a"), "b")).select(F.col("node").alias("to"), F.col("root").alias("last"))
    moved = label.join(joined, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    new = joined.join(label.select(F.col("node").alias("to")), "to", "left_anti").select(F.col("to").alias("node"), F.col("last").alias("to"))
    return staged(moved.unionByName(new), "labels")


def side_by_side(members: DataFrame) -> DataFrame:
    """(h, t, u, tile, node, n, label, above) of leaves whose neighbour in order of size is near enough in size; each pair of neighbours in one tree alone."""
    order = Window.partitionBy("h", "tile").orderBy("n", "node")
    pairs = members.select("h", "tile", "node", "n", F.lead("node").over(order).alias("node2"), F.lead("n").over(order).alias("n2")).where(100 * F.col("n") >= PERCENT * F.col("n2"))
    ends = F.sort_array(F.array(F.struct("node", "n"), F.struct(F.col("node2").alias("node"), F.col("n2").alias("n"))))
    once = pairs.groupBy(ends.alias("ends")).agg(F.min(F.struct("h", "tile")).alias("of"))
    rows = once.select("of.h", "of.tile", F.explode("ends").alias("end")).select("h", "tile", "end.node", "end.n").distinct()
    return rows.withColumns({"t": F.col("tile"), "u": F.col("tile"), "label": F.col("node"), "above": F.array().cast("array<long>")})


def promising(rows: DataFrame) -> DataFrame:
    """Of rows (h, t, u, tile, node, n, label, above) those of nodes that some other node of their tree or pair of tiles can link with by
    size, class and larger roots, as dual() tests leaves; of groups of more than PAIRWISE rows all."""
    kind = "h long, t int, u int, tile int, node long, n int, label long, above array<long>"

    def useful(group: list[tuple]) -> list[bool] | np.ndarray:
        if len(group) > PAIRWISE:
            return [True] * len(group)
        if len(group) == 2:
            (tile, _, n, label, above), (tile2, _, n2, label2, above2) = group
            return [100 * min(n, n2) >= PERCENT * max(n, n2) and label != label2 and set(above).isdisjoint(above2)] * 2
        n, label = (np.array([g[k] for g in group], np.int64) for k in (2, 3))
        may = (100 * n[:, None] >= PERCENT * n) & (label[:, None] != label)
        may &= may.T
        if may.any():
            for known in shared_roots([g[4] for g in group]).T:
                may &= (known[:, None] & known) == 0
        return may.any(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, schema = None, [], None
        held: list[tuple] = []

        def close() -> None:
            if len(group) > 1:
                held.extend((*at, *row) for row, keep in zip(group, useful(group), strict=True) if keep)

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*held, strict=True))], schema=schema)
            held.clear()
            return out

        for batch in batches:
            schema = batch.schema
            for i in range(0, batch.num_rows, ROWS):
                for h, t, u, *row in zip(*(c.to_pylist() for c in batch.slice(i, ROWS).columns), strict=True):
                    if (h, t, u) != at:
                        close()
                        at, group = (h, t, u), []
                    group.append(tuple(row))
                if len(held) >= ROWS:
                    yield told()
        close()
        if held:
            yield told()
        trimmed()

    parts = max(12, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("h", "t", "u", "tile", "node", "n", "label", "above").repartition(parts, "h", "t", "u").sortWithinPartitions("h", "t", "u")
    return dealt.mapInArrow(run, kind)


def tree_tiles(members: DataFrame, bits: DataFrame, least: int = 0) -> DataFrame:
    """The promising() of members, with bits, t and u, once for each pair of tiles of their shingle that is to be traversed; of shingles with more
    than `least` nodes."""
    if least:
        members = members.join(members.groupBy("h").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > least).select("h"), "h", "left_semi")
    members = members.select("h", "node", "n", "tile", "label", "above")
    tiles = staged(tile_pairs(members), "tile-pairs")
    one = members.join(tiles.withColumn("tile", F.col("t")), ["h", "tile"])
    two = members.join(tiles.where("t < u").withColumn("tile", F.col("u")), ["h", "tile"])
    return promising(one.unionByName(two)).join(bits, "node")


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, ref (a number of the row), mark and group of every document."""
    spark = docs.sparkSession
    texts = numbered(docs)
    table = staged(keyed(texts), "keys")
    rows = table.where("ref IS NOT NULL").select("ref", "doc_id", "mark", "n", "key")
    sketch = spark.sparkContext.broadcast(frequency_sketch(table.where("slice IS NOT NULL").select("slice", "counts")))  # SKETCH counters
    nodes = staged(rows.where("n > 0").groupBy("key").agg(F.min("ref").alias("node"), F.min("doc_id").alias("least")), "nodes")
    named = fresh_path(spark, "nodes")
    write_numbers(nodes.select("node"), named)
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = staged(met(prefixes(texts, named, sketch).repartition(parts, "h").sortWithinPartitions("h", "n", "node")), "meetings")
    freed(spark)
    meetings = staged(one_of_each(every), "roots")
    dropped(spark, every)
    freed(spark)
    taken = fresh_path(spark, "active")
    write_numbers(meetings.select("node"), taken)
    bits = staged(signatures(texts, taken), "signatures")
    members = staged(with_larger(meetings).withColumn("label", F.col("node")), "members")
    dropped(spark, meetings)
    first = linking(traversed(side_by_side(members).join(bits, "node"), False), texts)
    freed(spark)
    label = components(first).withColumnRenamed("root", "to")
    large = staged(tree_tiles(relabelled(members, label), bits, LARGE), "large-trees")
    if not large.isEmpty():
        label = contracted(label, linking(traversed(large, True, near=True), texts))
    dropped(spark, large)
    freed(spark)
    rest = linking(traversed(tree_tiles(relabelled(members, label), bits), True), texts)
    dropped(spark, texts, bits, members)
    freed(spark)
    roots = contracted(label, rest).withColumnRenamed("to", "root")
    named_nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named_nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = named_nodes.join(least, "root").select(F.col("key").alias("k"), "component_id", F.col("root").alias("group"))
    slim = rows.select("ref", "doc_id", "mark", F.col("n").alias("n_shingles"), "key")
    linked = slim.where("n_shingles > 0").join(of_key, F.col("key") == F.col("k")).drop("key", "k")
    alone = slim.where("n_shingles = 0").select("ref", "doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.col("ref").alias("group"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the least id, with its own columns; documents without shingles all stay.

    The rows to drop are broadcast up to BROADCAST_ROWS, else joined by key.
    """
    rows = staged(link_documents(docs).select("doc_id", "mark", "n_shingles", "group"), "linked").where("n_shingles > 0")
    best = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))["mark"].alias("best"))
    judged = staged(rows.join(best, "group").groupBy("mark").agg(F.max(F.col("mark") == F.col("best")).alias("stays"), F.count(F.lit(1)).alias("times")).where("NOT stays OR times > 1"), "judged")
    held = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    own = [f"`{c}`" for c in docs.columns]
    name = unused(docs, "mark")
    marked = docs.withColumn(name, row_mark())
    once = marked.join(held(judged.select(F.col("mark").alias(name))), name, "left_anti")
    again = judged.where("stays").select(F.col("mark").alias(name))
    if not again.isEmpty():
        once = once.unionByName(marked.join(held(again), name, "left_semi").dropDuplicates([name]))
    return once.select(*own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
