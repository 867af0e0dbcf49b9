"""Byte-level BPE over the distinct words of a corpus, and decoding.

A word is a match of the split pattern. A first pass splits documents and writes, block by block, the block's distinct
words, packed by hash into buckets, and each document as numbers of words. Buckets meet, and every distinct word of the
corpus is encoded once: higher-order functions fold the ranked merges over its byte array, with ranks from a map of
pairs of ids. The encodings return to the blocks as one file each, and documents are put together from them.
Decoding concatenates the binary pieces of the ids.

A block ends at BLOCK_WORDS distinct words, so neither a task nor a file grows with the corpus. What is shuffled are the
distinct words of blocks and their ids, many to a row; a word of very many blocks comes in several rows, each folded.

Defined results: null and empty texts have no ids; a null id stays; repeated rows are encoded alike; a very long text is
split in parts; a very long word takes time with the square of its length; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraflow.llm import pieces
from agoraflow.llm.shared import dropped, freed, fresh_path, open_file, removed, staged, trimmed, whole_file

BLOCK_WORDS = 250_000
#: Buckets of the map of pairs: a lookup walks through the few entries of one.
BUCKETS = 1 << 16
#: Texts, and words, in a batch that passes to Spark; blocks in a row of a word.
ROWS, WORDS, PLACES = 256, 5_000, 10_000
RANKS = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank of every token of a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def pair_map(ranks: dict[bytes, int]) -> Column:
    """Maps from a pair of ids, the left times 2^17 plus the right, to the id of both together, in an array by remainder. It is a
    scalar subquery of one row: a literal is written out in every text of a plan, which the driver keeps. The optimizer
    puts it where its column is used, so rows do not carry it."""
    buckets: list[dict[int, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                key = (a << 17) + b
                buckets[(a ^ b) % BUCKETS][key] = rank
    row = pa.array([[list(b.items()) for b in buckets]], pa.list_(pa.map_(pa.int64(), pa.int32())))
    return SparkSession.active().createDataFrame(pa.table({"pairs": row})).scalar()


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encoded_word(word: Column, pairs: Column, ranks: dict[bytes, int]) -> Column:
    """The ids as array<int> of a word given as array<int> of its bytes, with pair_map() in a column: the pair of least rank, leftmost first, is merged
    until no pair has a rank. The state is the ids, the ranks of neighbours and the least of these."""
    single = F.from_json(F.lit(json.dumps([ranks[bytes([b])] for b in range(256)])), "array<int>")
    none = F.array().cast("array<int>")

    def fold(pairs: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            key = F.shiftleft(a.cast("long"), 17) + b
            return F.element_at(F.get(pairs, a.bitwiseXOR(b).bitwiseAND(F.lit(BUCKETS - 1))), key)

        def state(p: Column, r: Column) -> Column:
            return F.struct(p.alias("p"), r.alias("r"), F.array_min(r).alias("m"))

        def merged(s: Column, i: Column) -> Column:
            p, r, m = s["p"], s["r"], s["m"]
            left = F.when(i > 1, F.concat(F.slice(r, 1, i - 2), F.array(rank(F.get(p, i - 2), m)))).otherwise(none)
            right = F.when(i < F.size(r), F.concat(F.array(rank(m, F.get(p, i + 1))), F.slice(r, i + 2, F.size(r)))).otherwise(none)
            ids = F.concat(F.slice(p, 1, i - 1), F.array(m), F.slice(p, i + 2, F.size(p)))
            return _let(F.concat(left, right), lambda x: state(ids, x))

        def step(s: Column) -> Column:
            return F.when(s["m"].isNull(), s).otherwise(_let(F.array_position(s["r"], s["m"]).cast("int"), lambda i: merged(s, i)))

        ids = F.transform(word, lambda b: F.get(single, b))
        begun = _let(ids, lambda p: state(p, F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), rank)))
        return F.when(F.size(word) < 2, ids).otherwise(F.aggregate(F.slice(word, 2, F.size(word)), begun, lambda s, _: step(s), lambda s: s["p"]))

    return _let(pairs, fold)


def planes(numbers: bytes) -> bytes:
    """The bytes of 32-bit numbers, first all lowest bytes, last all highest: compresses better."""
    return np.frombuffer(numbers, np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


#: Least numbers of two, three and five bytes, and the first bytes from which on these are meant.
LEAST, FIRST = np.array([0, 160, 160 + (64 << 8), 160 + (64 << 8) + (31 << 16)]), np.array([0, 160, 224, 255])


def short(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers, small ones in fewer bytes: the first byte of each, and the others, all lowest first. Apart they compress better."""
    kind = np.searchsorted(LEAST, numbers, "right") - 1
    rest = numbers.astype(np.int64) - LEAST[kind]
    high = np.where(kind == 3, 0, rest >> 8 * kind)
    others = [rest[kind >= least] >> shift & 255 for least, shift in ((1, 0), (2, 8), (3, 16), (3, 24))]
    return (FIRST[kind] + high).astype(np.uint8).tobytes(), np.concatenate(others).astype(np.uint8).tobytes()


def from_short(first: bytes, others: bytes) -> np.ndarray:
    code, data, at = np.frombuffer(first, np.uint8).astype(np.int64), np.frombuffer(others, np.uint8), 0
    kind = np.searchsorted(FIRST, code, "right") - 1
    rest = code - FIRST[kind] << 8 * kind
    for least, shift in ((1, 0), (2, 8), (3, 16), (3, 24)):
        own = np.flatnonzero(kind >= least)
        rest[own] |= data[at : at + len(own)].astype(np.int64) << shift
        at += len(own)
    return rest + LEAST[kind]


def packed(numbers: np.ndarray, sizes: np.ndarray, data: bytes) -> bytes:
    """Ascending numbers, as differences, as many sizes, and bytes after them, compressed."""
    body = planes(np.diff(numbers, prepend=0).astype(np.uint32).tobytes()) + planes(sizes.astype(np.uint32).tobytes()) + data
    return np.array([len(numbers), len(body)], np.uint32).tobytes() + pa.compress(body, "zstd", asbytes=True)


def unpacked(row: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    n, size = np.frombuffer(row, np.uint32, 2).tolist()
    body = pa.decompress(row[8:], size, "zstd", asbytes=True)
    return np.cumsum(from_planes(body[: 4 * n]), dtype=np.uint32), from_planes(body[4 * n : 8 * n]), body[8 * n :]


def gathered(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of `source` that begin at `start`, one after the other."""
    end = np.cumsum(size)
    return source[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)]


def blocks(docs: DataFrame, buckets: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (block, bucket, data) with the distinct words of a block that fall into a bucket by hash, and rows (block, doc_id, data, others) with the numbers of each document's words."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("others", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        # blocks of a task count up from its number: unique, as the table keeps one attempt of each task
        block = TaskContext.get().partitionId() << 20

        def words() -> Iterator[pa.RecordBatch]:
            held = [w.encode() for w in number]
            number.clear()
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in held), np.int64, len(held))
            order = np.argsort(bucket, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
                part = [held[i] for i in own.tolist()]
                row = packed(own, np.array([len(w) for w in part]), b"".join(part))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), pa.array([int(bucket[own[0]])], pa.int32()), pa.array([row], pa.binary()), pa.nulls(1, pa.binary())], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, texts = (c.to_pylist() for c in batch.slice(at, ROWS).columns)
                for first, last, group in pieces.slices(texts):
                    own = []
                    for part in [group] if len(group) > 1 else [[p] for p in pieces.cut(group[0])]:
                        s = pieces.split(part)
                        # frequent words first: small numbers compress better
                        first_come = np.argsort(-np.bincount(s.which, minlength=len(s.distinct)), kind="stable")
                        own_number = np.empty(len(s.distinct), np.uint32)
                        own_number[first_come] = np.fromiter((number.setdefault(s.distinct[k], len(number)) for k in first_come.tolist()), np.uint32, len(s.distinct))
                        numbers = own_number[s.which]
                        own += np.split(numbers, np.cumsum(s.counts)[:-1])
                    data, others = zip(*map(short, own if len(group) > 1 else [np.concatenate(own)]), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(data), pa.int64()), pa.array(ids[first:last], pa.int64()), pa.nulls(len(data), pa.int32()), pa.array(data, pa.binary()), pa.array(others, pa.binary())], schema=schema)
                    if len(number) >= block_words:
                        yield from words()
                        block += 1
        yield from words()
        trimmed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "block long, doc_id long, bucket int, data binary, others binary")


def distinct_words(rows: DataFrame) -> DataFrame:
    """(word, blocks, numbers): the bytes of each distinct word with its places; rows (block, bucket, data) come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, held = None, {}, []

        def told() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            which, block, number = (np.concatenate([h[k] for h in held]) for k in range(3))
            words = list(seen)
            held.clear()
            seen.clear()
            order = np.argsort(which, kind="stable")
            which, block, number = which[order], block[order], number[order]
            begin = np.flatnonzero(np.diff(which, prepend=-1))
            # a row has at most PLACES places of its word
            size = np.diff(begin, append=len(which))
            times = -(-size // PLACES)
            cut = np.repeat(begin, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * PLACES
            for i in range(0, len(cut), WORDS):
                own = cut[i : i + WORDS]
                stop = int(cut[i + WORDS]) if i + WORDS < len(cut) else len(which)
                data = [words[w] for w in which[own].tolist()]
                ends = pa.array(np.append(own, stop) - own[0], pa.int32())
                spelt = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, data)]), pa.int32()), pa.array(np.frombuffer(b"".join(data), np.uint8).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([spelt, pa.ListArray.from_arrays(ends, pa.array(block[own[0] : stop])), pa.ListArray.from_arrays(ends, pa.array(number[own[0] : stop].astype(np.int32)))], names=["word", "blocks", "numbers"])

        for batch in batches:
            for block, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != at:
                    yield from told()
                    at = bucket
                numbers, sizes, text = unpacked(data)
                end = np.cumsum(sizes).tolist()
                which = np.fromiter((seen.setdefault(text[a:b], len(seen)) for a, b in zip([0, *end], end)), np.int64, len(end))
                held.append((which, np.full(len(which), block, np.int64), numbers))
        yield from told()
        trimmed()

    return rows.select("block", "bucket", "data").mapInArrow(run, "word array<int>, blocks array<long>, numbers array<int>")


def by_block(encoded: DataFrame) -> DataFrame:
    """(block, data) from (blocks, numbers, ids): the ids of words go back to every block that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, numbers, ids = batch.columns
            word = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            block, number = places.flatten().to_numpy(), numbers.flatten().to_numpy()
            flat, end = ids.flatten().to_numpy().astype(np.uint32), ids.offsets.to_numpy().astype(np.int64)
            end = end - end[0]
            start, size = end[:-1], np.diff(end)
            order = np.lexsort((number, block))
            rows = []
            for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else ():
                w = word[own]
                rows.append((int(block[own[0]]), packed(number[own], size[w], planes(gathered(flat, start[w], size[w]).tobytes()))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "data"])
        trimmed()

    return encoded.select("blocks", "numbers", "ids").mapInArrow(run, "block long, data binary")


def write_tables(rows: DataFrame, folder: str) -> DataFrame:
    """One file for each block with the ids of its words in order, from rows (block, data) sorted by block; returns (block, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, done = None, [], []

        def close() -> None:
            if at is None:
                return
            numbers, sizes = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(2))
            flat = np.concatenate([from_planes(p[2]) for p in parts])
            start, order = np.cumsum(sizes) - sizes, np.argsort(numbers)
            ids = gathered(flat, start[order], sizes[order])
            body = np.uint64(len(sizes)).tobytes() + planes(sizes[order].astype(np.uint32).tobytes()) + planes(ids.tobytes())
            done.append((at, whole_file(folder, f"{at}", pa.compress(body, "zstd", asbytes=True), len(body))))

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != at:
                    close()
                    at, parts = block, []
                parts.append(unpacked(data))
        close()
        yield pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in done], pa.int64()), "path": pa.array([p for _, p in done], pa.string())})
        trimmed()

    return staged(rows.mapInArrow(run, "block long, path string"), "bpe-blocks")


def encode_documents(docs: DataFrame, rank_file: str | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (bytes) of every document."""
    spark = docs.sparkSession
    ranks = load_ranks(rank_file or public_tokenizers.path(RANKS))
    tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
    if {t: i for i, t in enumerate(tokens)} != ranks:
        raise ValueError("ranks are not 0, 1, 2 ...")
    held = spark.sparkContext.broadcast((b"".join(tokens), np.cumsum([0, *map(len, tokens)])))  # the vocabulary: a fixed size
    tasks = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    split = fresh_path(spark, "bpe-split")
    blocks(docs, 4 * tasks, block_words).withColumn("words", F.col("bucket").isNotNull()).write.partitionBy("words").option("compression", "zstd").parquet(split)

    def rows_of(words: bool) -> DataFrame:
        return spark.read.schema("block long, doc_id long, bucket int, data binary, others binary, words boolean").parquet(split).where(F.col("words") == words)

    distinct = distinct_words(rows_of(True).select("block", "bucket", "data").repartition(tasks, "bucket").sortWithinPartitions("bucket"))
    back = staged(by_block(distinct.withColumn("pairs", pair_map(ranks)).select("blocks", "numbers", encoded_word(F.col("word"), F.col("pairs"), ranks).alias("ids"))), "bpe-ids")
    removed(spark, f"{split}/words=true")  # every encoding is in the table of ids by now
    freed(spark)
    folder = fresh_path(spark, "bpe-tables")
    write_tables(back.repartition(tasks, "block").sortWithinPartitions("block"), folder)
    dropped(spark, back)
    freed(spark)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, cut = held.value
        data, begin, length = np.frombuffer(text, np.uint8), cut[:-1], np.diff(cut)
        at = flat = start = size = None
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(i, ROWS), []
                for block, words, others in zip(*(part.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                    if words and block != at:
                        body = open_file(folder, f"{block}")
                        n = int(np.frombuffer(body, np.uint64, 1)[0])
                        size, flat = from_planes(body[8 : 8 + 4 * n]).astype(np.int64), from_planes(body[8 + 4 * n :])
                        at, start = block, np.cumsum(size) - size
                    own = np.zeros(0, np.uint32)
                    if words:
                        w = from_short(words, others)
                        own = gathered(flat, start[w], size[w])
                    out.append((len(own), own.tobytes(), gathered(data, begin[own], length[own]).tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64(), pa.binary(), pa.binary()]))], names=["doc_id", "n_tokens", "ids", "decoded"])
        trimmed()

    return rows_of(False).select("block", "doc_id", "data", "others").mapInArrow(join, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
