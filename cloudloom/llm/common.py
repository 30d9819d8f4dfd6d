"""What the operators of this subpackage share: shared-folder materialisation, size-checked joins, text as bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: A side of at most this many rows of a few bytes each may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master without that setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cloudloom-"))
    return sc.getCheckpointDir()


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet; its shuffle files go then, else they stay until the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise wrote for df, once nothing is read from it any more."""
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(df._written)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written on the way to a result, deleted together once the result is written."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.held.append(materialise(df))
        return self.held[-1]

    def clear(self) -> None:
        while self.held:
            discard(self.held.pop())


def text_bytes(name: str = "text"):
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """The key, doc_id as a long and any other column as it is, and the text's bytes: what the operators on single rows read."""
    return docs.select(F.col(key).cast("bigint").alias(key) if key == "doc_id" else F.col(key), text_bytes())


def keyed_schema(docs: DataFrame, key: str, others: str) -> StructType:
    """The key's field of ``keyed``, then others."""
    own = StructField(key, LongType() if key == "doc_id" else docs.schema[key].dataType)
    return StructType([own, *StructType.fromDDL(others).fields])


def crc_mod(column: str, n: int):
    """crc32 of a column as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def drawn(rows: DataFrame, key: str, rate) -> DataFrame:
    """The rows whose hash of ``key`` falls below a rate (a number or a column), drawn to 53 bits: a rate of 1e-12 still draws."""
    return rows.where(F.shiftrightunsigned(F.xxhash64(key), 11) < F.lit(2.0**53) * rate)


def keep_matching(df: DataFrame, keys: DataFrame, on: str, rows: int, how: str = "left_semi") -> DataFrame:
    """Semi or anti join; keys are broadcast only when their known row count is small."""
    return df.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, on, how)


def stable_hash(word: bytes) -> int:
    """An unsigned 64-bit hash of a word that every process computes alike."""
    return (zlib.crc32(word) << 32) ^ (zlib.crc32(word[::-1], 0x9E3779B9) * 0x1003F) & 0xFFFFFFFFFFFFFFFF


def hash_words(words: list[bytes]) -> np.ndarray:
    """Unsigned 64-bit hashes of words that every process computes alike, in one call."""
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


class Memo(dict):
    """A dictionary that computes what it lacks and starts anew when it holds too much: memory stays bounded."""

    def __init__(self, compute, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit numbers, so that equal low bits don't stay together."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def parts_of_batch(batch: pa.RecordBatch, column: int, most: int = 4_000_000):
    """Slices of a batch whose texts have at most so many bytes together; a longer text is a slice of its own."""
    texts = batch.column(column)
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def as_text(texts: pa.Array) -> pa.Array:
    """Binary to text without a check: the bytes stay as they are."""
    return pc.cast(texts, options=pc.CastOptions.unsafe(pa.string()))


def release_memory() -> None:
    """Give memory that Arrow and the C library hold back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words between ASCII white space of a string column: for each its place among the distinct words, these, and
    where each text's words begin (and the last one's end)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))])
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not filled.all():  # white space at a text's ends leaves empty words there
        flat = flat.filter(pa.array(filled))
        bounds = np.concatenate([[0], np.cumsum(filled)])[bounds]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), bounds
