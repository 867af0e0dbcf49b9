"""Corpora as blocks of numbered words.

A block is a run of documents within one task with its own list of distinct words; documents are arrays of numbers into
it. What a corpus-wide step finds out about words returns as one file for each block, so that passes over documents
need neither a join with the vocabulary nor a broadcast of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from agoraflow.llm import pieces
from agoraflow.llm.shared import moved, staged, store_of, trimmed

#: Distinct words after which a block ends: bounds the memory of a task and the size of a file.
BLOCK_WORDS = 300_000
#: Texts, and characters, that are split together.
ROWS, SLICE = 1024, 1 << 19
SCHEMA = "block string, doc_id long, flag boolean, words binary, number int, word string, weight long"
_ARROW = pa.schema([("block", pa.string()), ("doc_id", pa.int64()), ("flag", pa.bool_()), ("words", pa.binary()), ("number", pa.int32()), ("word", pa.string()), ("weight", pa.int64())])


def split_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs has doc_id, text, flag. Rows (block, doc_id, flag, words) for documents: numbers of their words, A-Z in lower case,
    and of the end, which is the empty word; rows (block, number, word, weight) for distinct words, weight counting a word's
    occurrences in the block's documents whose flag is true."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {b"": 0}
        weights, block, used = np.zeros(1 << 12, np.int64), uuid.uuid4().hex, False

        def grown(size: int) -> np.ndarray:
            return weights if len(weights) >= size else np.concatenate([weights, np.zeros(max(size, len(weights)), np.int64)])

        def listed() -> Iterator[pa.RecordBatch]:
            held, weight = list(number), grown(len(number))
            for i in range(0, len(held), 20_000):
                part = held[i : i + 20_000]
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([block] * m), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()), pa.array(range(i, i + m), pa.int32()), pa.array([w.decode() for w in part], pa.string()), pa.array(weight[i : i + m])], schema=_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, texts, flags = (c.to_pylist() for c in batch.slice(at, ROWS).columns)
                for first, last, group in pieces.slices(texts, SLICE):
                    found = pieces.words(group)
                    numbers = np.fromiter((number.setdefault(w, len(number)) for w in found.distinct), np.uint32, len(found.distinct))[found.which]
                    ends = np.cumsum(found.counts)
                    own = np.split(np.insert(numbers, ends, np.uint32(0)), (ends + np.arange(1, len(ends) + 1))[:-1])
                    taught = [x for x, flag in zip(own, flags[first:last], strict=True) if flag]
                    if taught:
                        counts = np.bincount(np.concatenate(taught))
                        weights = grown(len(counts))
                        weights[: len(counts)] += counts
                    m, used = last - first, True
                    yield pa.RecordBatch.from_arrays([pa.array([block] * m), pa.array(ids[first:last], pa.int64()), pa.array(flags[first:last], pa.bool_()), pa.array([x.tobytes() for x in own], pa.binary()), *(pa.nulls(m, _ARROW.field(i).type) for i in (4, 5, 6))], schema=_ARROW)
                    if len(number) >= block_words:
                        yield from listed()
                        number = {b"": 0}
                        weights, block, used = np.zeros(1 << 12, np.int64), uuid.uuid4().hex, False
        if used:
            yield from listed()
        number.clear()
        trimmed()

    return docs.select("doc_id", "text", "flag").mapInArrow(split, SCHEMA)


def write_tables(rows: DataFrame, columns: list[str], folder: str, blocks: int) -> DataFrame:
    """Write one file for each block, the given columns in order of number; returns the blocks written.

    A file appears under its name only when whole; every attempt of a task writes the same content.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        at, parts, done = None, [], []

        def close() -> None:
            if at is None:
                return
            held, own = pa.Table.from_batches(parts).combine_chunks(), f"{root}/{at}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(own, compression=None) as raw, pa.ipc.new_file(raw, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as sink:
                sink.write_table(held)
            moved(store, own, f"{root}/{at}.arrow")
            done.append(at)

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0)
            begins = [0, *[i for i, x in enumerate(pc.not_equal(names[1:], names[:-1]).to_pylist(), 1) if x]]
            for a, b in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                if names[a].as_py() != at:
                    close()
                    at, parts = names[a].as_py(), []
                parts.append(batch.select(columns).slice(a, b - a))
        close()
        yield pa.RecordBatch.from_pydict({"block": pa.array(done, pa.string())})

    dealt = rows.select("block", "number", *columns).repartition(max(1, min(blocks, 4096)), "block").sortWithinPartitions("block", "number")
    return staged(dealt.mapInArrow(write, "block string"), "block-files")


def read_table(folder: str, block: str) -> pa.Table:
    store, root = store_of(folder)
    with store.open_input_file(f"{root}/{block}.arrow") as raw:
        return pa.ipc.open_file(raw).read_all()
