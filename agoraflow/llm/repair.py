"""Token-id shards compressed by Re-Pair grammars.

Documents are dealt by ranges of doc_id and encoded; in each shard's id sequence frequent pairs of neighbours are replaced
by nonterminals, the most frequent ones first, round by round, until no pair occurs LEAST_COUNT times.
A shard file holds the rules, the length of what each nonterminal expands to, where documents begin, and the symbols;
so any document or range of ids is decoded without expanding the rest. No pair crosses the end of a document.

File format, all numbers little-endian: magic RPAIR001; seven unsigned 64-bit numbers (documents, ids, symbols, rules,
first nonterminal, bytes of a symbol: 2 or 4, end id); rules as pairs of unsigned 32-bit; expansion lengths, unsigned
32-bit; doc_id, signed 64-bit; one byte each, 1 if doc_id is null; symbols of each document, then ids of each document,
unsigned 64-bit; the symbols.

Defined results: null and empty texts have the end id alone; null ids come first; repeated ids and rows are kept, in
order of a hash of the text; an empty table gives no file and an empty result; other columns are not read.
"""

from __future__ import annotations

import array
import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agoraflow.llm import pieces
from agoraflow.llm.shared import fresh_path, staged, store_of, trimmed

TOKENIZER, END = "byte_bpe_50k.json", 2
#: A shard is closed at so many ids.
SHARD_IDS = 1 << 21
#: A rule takes three numbers in the file and an occurrence saves one, so pairs of fewer occurrences are left.
LEAST_COUNT = 4
#: Pairs of a round are at least this part as frequent as the most frequent; pairs are counted by BITS of a hash first.
DROP, BITS = 8, 20
#: Distinct pieces whose ids a worker remembers; texts encoded together.
KNOWN, ROWS = 800_000, 1024
MAGIC = b"RPAIR001"


class Encoder:
    """Ids of texts as Tokenizer.encode(text, add_special_tokens=False) gives them, from a byte-level BPE file of the tokenizers library.

    The library's model encodes each distinct piece of a slice of texts that the worker does not know yet; texts that spell
    an added token go through the library's own encode.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        # bytes as the characters that byte-level vocabularies write them with: printable ones as they are, others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.char = [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]
        self.spelling = {b: c for b, c in enumerate(self.char)}
        self.known: dict[str, bytes] = {}
        self.first = 1 + max(max(t.id for t in self.model.tokenize(c)) for c in self.char)

    def _learned(self, words: list[str]) -> list[bytes]:
        """The ids of words not known yet. They are spelt together, with a byte between them that UTF-8 does not have."""
        spelt = b"\xff".join([w.encode() for w in words]).decode("latin-1").translate(self.spelling).split(self.char[255])
        out = [array.array("I", [t.id for t in self.model.tokenize(own)]).tobytes() for own in spelt]
        self.known.update(zip(words, out, strict=True))
        return out

    def _pieces(self, texts: list[str]) -> list[np.ndarray]:
        s = pieces.split(texts)
        if len(self.known) > KNOWN:
            self.known.clear()
        data = list(map(self.known.get, s.distinct))
        fresh = [k for k, own in enumerate(data) if own is None]
        if fresh:
            for k, own in zip(fresh, self._learned([s.distinct[k] for k in fresh]), strict=True):
                data[k] = own
        flat = np.frombuffer(b"".join(data), np.uint32)
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        start = np.cumsum(size) - size
        count = size[s.which]
        end = np.cumsum(count)
        ids = flat[np.repeat(start[s.which] - end + count, count) + np.arange(len(count) and end[-1])]
        return np.split(ids, np.append(0, end)[np.cumsum(s.counts)[:-1]])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit numbers."""
        plain = ["" if t is None or self.added(t) else t for t in texts]
        out: list[np.ndarray] = []
        for _, _, group in pieces.slices(plain):
            out += self._pieces(group) if len(group) > 1 else [np.concatenate([self._pieces([part])[0] for part in pieces.cut(group[0])])]
        for k, t in enumerate(texts):
            if t and not plain[k]:
                out[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        return out


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker: what it knows serves the next task."""
    return Encoder(path)


def _bins(keys: np.ndarray) -> np.ndarray:
    """A bin of 2^BITS for each pair."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def _frequent(a: np.ndarray, b: np.ndarray, inside: np.ndarray, limit: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The limit, lowered to 1 / DROP as often as no bin of pairs reaches it; the places of pairs that occur `limit` times, which
    of these pairs each place has, the pairs in ascending order, and their counts."""
    at = np.flatnonzero(inside)
    keys = (a[at].astype(np.uint64) << np.uint64(32)) | b[at]
    bins = _bins(keys)
    room = np.bincount(bins, minlength=1 << BITS)
    while limit > LEAST_COUNT and room.max() < limit:
        limit = max(LEAST_COUNT, limit // DROP)
    some = np.flatnonzero((room >= limit)[bins])  # leaves out most rare pairs, so that few are sorted
    at, keys, bins = at[some], keys[some], bins[some]
    ordered = np.sort(keys)
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    n = np.diff(begin, append=len(ordered))
    pairs, n = ordered[begin[n >= limit]], n[n >= limit]
    if not len(pairs):
        return limit, at[:0], at[:0], pairs, n
    holder = np.full(1 << BITS, -1, np.int64)
    own = _bins(pairs)
    holder[own] = np.arange(len(pairs))
    which = holder[bins]
    hit = (which >= 0) & (pairs[which] == keys)
    shared = np.zeros(1 << BITS, bool)
    shared[own[holder[own] != np.arange(len(pairs))]] = True  # bins of two such pairs: looked up in order
    rest = np.flatnonzero(~hit & shared[bins])
    found = np.minimum(np.searchsorted(pairs, keys[rest]), len(pairs) - 1)
    which[rest], hit[rest] = found, pairs[found] == keys[rest]
    return limit, at[hit], which[hit], pairs, n


def compress(ids: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, each document's end among them, rules and expansion lengths. ids < first; ends: where documents end.

    In each round every pair that occurs `limit` times gets a nonterminal, and the limit falls to 1 / DROP; where two of them
    overlap, the more frequent one is replaced. At LEAST_COUNT, rounds go on over pairs with a symbol of the round before;
    all ends when a count of all pairs finds none that occurs LEAST_COUNT times within documents.
    """
    seq, rules = ids.astype(np.uint32), []
    size = np.ones(first, np.uint32)
    last = np.zeros(len(seq), bool)  # symbols that end a document
    last[ends[ends > 0] - 1] = True
    limit, fresh = max(LEAST_COUNT, len(seq) // DROP), 0  # fresh: pairs with a symbol from it on are counted
    while len(seq) > 1:
        a, b = seq[:-1], seq[1:]
        inside = ~last[:-1]
        if fresh:
            inside &= (a >= fresh) | (b >= fresh)
        limit, at, of, pairs, n = _frequent(a, b, inside, limit)
        if not len(pairs):
            if limit == LEAST_COUNT and not fresh:
                break
            limit, fresh = max(LEAST_COUNT, limit // DROP), 0
            continue
        order = np.empty(len(pairs), np.int64)
        order[np.argsort(-n, kind="stable")] = np.arange(len(pairs))
        mine = order[of]
        # of overlapping pairs the more frequent one stays; of equal ones in a row every other one
        near = np.diff(at) == 1
        beaten = np.zeros(len(at), bool)
        beaten[1:] |= near & (mine[:-1] < mine[1:])
        beaten[:-1] |= near & (mine[1:] < mine[:-1])
        at, mine = at[~beaten], mine[~beaten]
        place = np.arange(len(at))
        even = (place - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))) % 2 == 0
        at, mine = at[even], mine[even]
        taken = np.bincount(mine, minlength=len(pairs)) > 0
        used, symbol = np.flatnonzero(taken), (np.cumsum(taken) - 1)[mine]
        pair = np.empty(len(pairs), np.uint64)
        pair[order] = pairs
        left, right = (pair[used] >> np.uint64(32)).astype(np.uint32), pair[used].astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        last[at] = last[at + 1]
        seq = seq.copy()
        seq[at] = symbol + len(size)
        seq, last = seq[keep], last[keep]
        rules.append(np.stack([left, right], 1))
        fresh = len(size) if limit == LEAST_COUNT else 0
        limit = max(LEAST_COUNT, limit // DROP)
        size = np.concatenate([size, size[left] + size[right]])
    ended = np.flatnonzero(last) + 1
    # documents without symbols end where those before them do
    return seq, np.append(0, ended)[np.searchsorted(np.unique(ends[ends > 0]), ends, "right")], np.concatenate([np.zeros((0, 2), np.uint32), *rules]), size[first:]


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for: what each nonterminal expands to is laid out once, then gathered for every symbol."""
    if not len(rules):
        return symbols.astype(np.uint32)
    sides = rules.astype(np.int64)
    reach = np.maximum.accumulate(sides.max(1))
    size, steps, done = np.ones(first + len(rules), np.int64), [], 0
    while done < len(rules):
        stop = int(np.searchsorted(reach, first + done))  # rules over symbols that are laid out by then
        if stop <= done:
            raise ValueError("a rule over itself or a later one")
        size[first + done : first + stop] = size[sides[done:stop]].sum(1)
        steps.append((done, stop))
        done = stop
    end = np.cumsum(size)
    start = end - size
    flat = np.empty(end[-1], np.uint32)
    flat[:first] = np.arange(first)

    def gathered(own: np.ndarray) -> np.ndarray:
        count = size[own]
        ends = np.cumsum(count)
        return flat[np.repeat(start[own] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]

    for done, stop in steps:
        flat[start[first + done] : end[first + stop - 1]] = gathered(sides[done:stop].ravel())
    return gathered(symbols.astype(np.int64))


def pack(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, first: int, end: int = END) -> bytes:
    """A shard file."""
    seq, ends, rules, lengths = compress(ids, np.cumsum(counts), first)
    wide = 2 if first + len(rules) <= 1 << 16 else 4
    head = np.array([len(doc_ids), len(ids), len(seq), len(rules), first, wide, end], "<u8")
    parts = [head, rules.astype("<u4"), lengths.astype("<u4"), np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), np.diff(ends, prepend=0).astype("<u8"), counts.astype("<u8"), seq.astype(f"<u{wide}")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard file in memory, decoded where it is asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        docs, self.size, symbols, rules, self.first, wide, self.end = (int(x) for x in np.frombuffer(data, "<u8", 7, 8))
        at = 64

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else i for i, n in zip(ids.tolist(), null.tolist(), strict=True)]
        self.ends = np.cumsum(take("<u8", docs).astype(np.int64))
        self.counts = take("<u8", docs).astype(np.int64)
        self.symbols = take(f"<u{wide}", symbols)
        if at != len(data) or self.counts.sum() != self.size:
            raise ValueError("the shard file is damaged")

    def document(self, i: int) -> np.ndarray:
        """The ids of document i."""
        return expand(self.symbols[self.ends[i - 1] if i else 0 : self.ends[i]], self.rules, self.first)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop: only the symbols that cover them are expanded."""
        size = np.concatenate([np.ones(self.first, np.int64), self.lengths])[self.symbols]
        after = np.cumsum(size)
        a, b = np.searchsorted(after, start, "right"), np.searchsorted(after, stop, "left") + 1
        return expand(self.symbols[a:b], self.rules, self.first)[start - (after[a - 1] if a else 0) :][: stop - start]


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write documents in ascending order of doc_id as shard files into folder (a URI); returns part, nth, path, n_docs, n_ids of whole files."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        encoder, stop = encoder_of(path), np.array([end], np.uint32)
        doc_ids, data, size, rows = [], [], 0, []

        def flush() -> None:
            nonlocal size
            if doc_ids:
                ids = np.concatenate(data)
                name = f"{root}/{uuid.uuid4().hex}.rpair"
                with store.open_output_stream(name, compression=None) as out:
                    out.write(pack(list(doc_ids), ids, np.array([len(x) for x in data]), max(encoder.first, 1 + int(ids.max())), end))
                rows.append((TaskContext.get().partitionId(), len(rows), f"{folder}/{name.rsplit('/', 1)[1]}", len(doc_ids), len(ids)))
                doc_ids.clear()
                data.clear()
                size = 0

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, texts = (c.to_pylist() for c in batch.slice(at, ROWS).columns)
                for doc_id, own in zip(ids, encoder.encode(texts), strict=True):
                    doc_ids.append(doc_id)
                    data.append(np.concatenate([own, stop]))
                    size += len(data[-1])
                    if size >= shard_ids:
                        flush()
        flush()
        trimmed()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()])], names=["part", "nth", "path", "n_docs", "n_ids"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    ranged = dealt.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    return staged(ranged.mapInArrow(write, "part int, nth int, path string, n_docs long, n_ids long"), "shards")


def with_starts(files: DataFrame) -> DataFrame:
    """files with start, the ids in all files before: parts are summed up first, so that no window holds all files."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("m"))
    before = parts.select("part", (F.sum("m").over(W.orderBy("part")) - F.col("m")).alias("base"))
    own = F.sum("n_ids").over(W.partitionBy("part").orderBy("nth")) - F.col("n_ids")
    return files.withColumn("own", own).join(before, "part").withColumn("start", F.col("base") + F.col("own")).drop("own", "base")


def read_shards(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document in the files of (path, start)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = store_of(path)
                with store.open_input_stream(place, compression=None) as file:
                    shard = Shard(file.read())
                starts = start + np.cumsum(shard.counts) - shard.counts
                all_ids = expand(shard.symbols, shard.rules, shard.first)
                cut = np.cumsum(shard.counts).tolist()
                for i in range(0, len(cut), 500):
                    ids = [all_ids[(cut[k - 1] if k else 0) : cut[k]].tobytes() for k in range(i, min(i + 500, len(cut)))]
                    part = slice(i, i + 500)
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[part], pa.int64()), pa.array(starts[part]), pa.array(shard.counts[part]), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    parts = min(max(1, files.count()), 4096)
    return files.select("path", "start").repartition(parts, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "rpair"))
    return read_shards(with_starts(files)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
