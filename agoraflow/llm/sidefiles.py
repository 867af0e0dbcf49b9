"""Sets of row numbers, one small file for each task that wrote the rows.

A row's number is the number of its task times 2^33 plus its place. Which rows a later pass is to take is told by files
that it opens by task number, so that wide rows need not be shuffled to meet the choice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraflow.llm.shared import open_file, staged, store_of, whole_file


TASK_BITS = 33


def write_numbers(numbers: DataFrame, folder: str) -> None:
    """Write the distinct numbers in the only column of `numbers`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> None:
            if at is not None:
                body = np.concatenate(held).tobytes()
                whole_file(folder, f"{at}", pa.compress(body, "zstd", asbytes=True), len(body))

        for batch in batches:
            task, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first in np.r_[0, np.where(task[1:] != task[:-1])[0] + 1] if len(task) else ():
                if task[first] != at:
                    close()
                    at, held = int(task[first]), []
                held.append(number[first : first + int((task[first:] == task[first]).sum())])
        close()
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    rows = numbers.toDF("n").distinct().select(F.shiftright("n", TASK_BITS).alias("task"), "n")
    parts = max(12, int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    staged(rows.repartition(parts, "task").sortWithinPartitions("task", "n").mapInArrow(run, "done int"), "files")


def read_numbers(folder: str, task: int) -> list[int]:
    """The numbers of a task; none if no file names it."""
    store, root = store_of(folder)
    if store.get_file_info(f"{root}/{task}").type == fs.FileType.NotFound:
        return []
    return np.frombuffer(open_file(folder, f"{task}"), np.int64).tolist()
