"""Shared kernels of the training-data operators: words, hashes, Arrow plumbing and shared storage.

Words are runs of anything but the six ASCII blanks (space, tab, LF, VT, FF, CR). ``bytes.split()`` splits UTF-8 at
exactly these, so the hot loops work on encoded text and never on a character at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
MEMO_WORDS = 200_000  # words a worker remembers; a full memo starts anew, so memory stays bounded
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of eight, as a mask


def as_bytes(text: str | None) -> bytes:
    """UTF-8 of a text, nothing for null; lone surrogates survive instead of failing the task."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class Memo(dict):
    """Word -> 64-bit hash, computed once per distinct word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values (a bijection, so it adds no collisions)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts, in lower case, and how many words each text has.

    Words are what ``bytes.split()`` finds. They are hashed eight bytes at a time, the first bytes of all words at once, so
    a word that no task has met before costs no more than others, however many there are.
    """
    column = pc.ascii_lower(pc.fill_null(column, ""))
    kind = np.int32 if pa.types.is_string(column.type) else np.int64
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    raw = np.concatenate((raw, np.full(8, 32, np.uint8)))  # eight bytes can be read from any place
    word = ~_BLANK[raw]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    opens[ends[:-1]] = word[ends[:-1]]  # texts stand side by side
    last = ends[1:][ends[1:] > 0] - 1
    closes[last] = word[last]
    at = np.flatnonzero(opens)
    size = np.flatnonzero(closes) + 1 - at
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    out, rest, done = size.astype(np.uint64), np.arange(len(at)), 0
    while len(rest):
        out[rest] = mix(out[rest] * _ODD + (eight[at[rest] + done] & _FIRST_BYTES[np.minimum(size[rest] - done, 8)]))
        done += 8
        rest = rest[size[rest] > done]
    return out, np.diff(np.searchsorted(at, ends))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles from word hashes; a shorter, non-empty text is one shingle."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        out = mix(out * _ODD + h[k : len(h) - n + 1 + k])
    return out


def crc_fold(doc_id: Column, folds: int = 3) -> Column:
    """Remainder that assigns a document to a fold: crc32 of its id as text."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | dict | None]]) -> DataFrame:
    """``mapInArrow`` with one state per task: ``make()`` runs once, its result once per batch."""
    out = T.StructType.fromDDL(schema)
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, step = to_arrow_schema(out), make()
        for batch in batches:
            for part in pieces(batch):
                got = step(part)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([as_array(got[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, out)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def pieces(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes, so that very long texts don't pile up in a worker."""
    if batch.num_rows <= 1 or batch.nbytes <= most:
        yield batch
        return
    rows = max(1, int(batch.num_rows * most / batch.nbytes))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def list_array(lengths: list[int], flat: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from the lengths of its rows and their joined values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def shared_folder(spark: SparkSession) -> str:
    """A new folder for one run's tables, in the shared folder that the cluster names.

    ``spark.checkpoint.dir`` decides; only where it is unset (tests, a single machine) a folder is chosen here.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.gettempdir() + "/loamsift-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def shuffles_end(spark: SparkSession):
    """Shuffle files of what is written inside go as soon as it is, instead of when the driver collects its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def batches_of(spark: SparkSession, rows: int):
    """What runs inside goes to Python in batches of so many rows; both sides hold a batch whole, off the heap."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and outlives lost executors.

    Frames made from it read it lazily, so it stays until ``discard`` or until the owner of the shared folder empties that.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}"
    with shuffles_end(df.sparkSession):
        df.write.option("compression", "lz4").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.loamsift_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written table that no frame in use reads any more."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(df.loamsift_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
