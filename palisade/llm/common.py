"""Shared helpers of this package: staging, table reads and vectorised word hashing."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words, [\x20\x09-\x0D].
WORD_SPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session that names none gets one (driver and tasks then share the machine); on a cluster a
    missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="palisade-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, every re-read sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete a table that ``stage`` gave, once nothing reads it any more."""
    hadoop = staged.sparkSession._jvm.org.apache.hadoop.fs.Path
    for folder in {name.rpartition("/")[0] for name in staged.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def other_columns(docs: DataFrame) -> list:
    """All columns but the text, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c != "text"]


def rows_and_text(docs: DataFrame) -> DataFrame:
    """row (all columns but the text, as a struct) and text (as a string)."""
    others = other_columns(docs) or [F.lit(None).cast("int").alias("none")]
    return docs.select(F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"))


def with_row(rows: DataFrame, more: str) -> T.StructType:
    """The schema of ``row`` as rows hold it, then the fields that ``more`` lists."""
    return T.StructType([rows.schema["row"], *T.StructType.fromDDL(more)])


def kept_in_worker(key: tuple, make):
    """What ``make`` gives, made once per Python worker and key: functions are shipped by value, so globals are not shared."""
    held = sys.modules.setdefault("palisade_worker", types.ModuleType("palisade_worker")).__dict__
    if held.get("key", {}).get(key[0]) != key:
        held.setdefault("key", {})[key[0]] = key
        held[key[0]] = make()
    return held[key[0]]


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: fewer rows than Spark's default go to a Python worker at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; a null id counts as the empty string."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % modulus) == remainder


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[list(WORD_SPACE)] = True
_STEP = _U(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _STEP, _U))


def _powers(upto: int) -> np.ndarray:
    global _POWERS
    if upto > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(upto, 2 * len(_POWERS)), _STEP, _U))
    return _POWERS


class Words:
    """The words of a run of texts.

    hashes: a 64-bit hash of each word's bytes; start, end: byte range in ``data``; text: index of its text;
    first: index of the first word of each text (one more entry at the end).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        self.data, self.offsets = data, offsets
        space = _SPACE[data]
        inside = ~space
        begins = inside.copy()
        begins[1:] &= space[:-1]
        cut = offsets[1:-1]
        cut = cut[cut < len(data)]
        begins[cut] = inside[cut]
        ends = inside.copy()
        ends[:-1] &= space[1:]
        last = offsets[1:] - 1
        last = last[last >= 0]
        ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        if len(self.start):
            length = self.end - self.start
            place = np.flatnonzero(inside)
            within = place - np.repeat(self.start, length)
            values = _BYTE[data[place]] * _powers(int(length.max()))[within]
            at = np.cumsum(length) - length
            self.hashes = mix(np.add.reduceat(values, at))
        else:
            self.hashes = np.zeros(0, _U)
        self.text = np.searchsorted(offsets[1:], self.start, side="right")
        self.first = np.searchsorted(self.start, offsets)
        self.n_texts = n


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, target: int = 1 << 21):
    """The batch in runs of rows with about ``target`` bytes of text each (one row at least)."""
    at = batch.schema.get_field_index(column)
    _, offsets = texts_of(batch.column(at))
    n, begin = batch.num_rows, 0
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + target, side="right")) - 1
        end = min(max(end, begin + 1), n)
        yield batch.slice(begin, end - begin)
        begin = end


#: Two odd multipliers for window hashes; their inverses modulo 2**64 are computed, not stated.
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def _inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


class Rolling:
    """Hashes of any run of consecutive values: polynomial prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up = np.ones(n + 1, _U)
        up[1:] = base
        np.multiply.accumulate(up, out=up)
        self.down = np.ones(n + 1, _U)
        self.down[1:] = _inverse(base)
        np.multiply.accumulate(self.down, out=self.down)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(_U))
