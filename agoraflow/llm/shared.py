"""What the operators of this subpackage share: the cluster's shared folder, staged tables and column handling."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: space and the five control characters from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A temporary one is set only where that is unset, as in local tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        there = sc._jsc.sc().getCheckpointDir()
        if there.isDefined():
            return _qualified(spark, there.get())
        folder = "file://" + tempfile.mkdtemp(prefix="agoraflow-")
        sc.setCheckpointDir(folder)
    return _qualified(spark, folder.rstrip("/"))


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme and host, as Spark itself completes it, so that tasks do not take it for a local path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation before it."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a folder in the shared place."""
    return fs.FileSystem.from_uri(folder)


def moved(store: fs.FileSystem, own: str, path: str) -> None:
    """Give a file its name, unless another attempt's file has it."""
    try:
        store.move(own, path)
    except OSError:
        if store.get_file_info(path).type == fs.FileType.NotFound:
            raise
        store.delete_file(own)


def whole_file(folder: str, name: str, data: bytes, size: int) -> str:
    """Write a file that appears under its name only when whole: 8 bytes with the size before compression, then data.

    Every attempt of a task writes the same content, so a name that another attempt took meanwhile is left as it is.
    """
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    own, path = f"{root}/{name}.{uuid.uuid4().hex}.tmp", f"{root}/{name}"
    with store.open_output_stream(own, compression=None) as out:
        out.write(size.to_bytes(8, "little") + data)
    moved(store, own, path)
    return f"{folder}/{name}"


def open_file(folder: str, name: str) -> bytes:
    """The content that was compressed into a file of whole_file()."""
    store, root = store_of(folder)
    with store.open_input_stream(f"{root}/{name}", compression=None) as raw:
        data = raw.read()
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def freed(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no table refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            removed(spark, folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared place, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed() -> None:
    """Give memory that a Python worker has freed back to the system: workers live on and serve other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def word_array(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc32(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
