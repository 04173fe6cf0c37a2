"""Helpers shared by the training-data operators: tables in the shared folder, Arrow slices, hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank and the controls 9 to 13 (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="linkspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def save(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, lost executors cost nothing. Spark
    deletes the shuffle files behind a written table once the driver has collected its garbage, which is asked for here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkspark/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of save() that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def words_in(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by."""
    return F.crc32(doc_id.cast("string")) % by


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of a text column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
        ends, total, start = np.cumsum(size, dtype=np.int64), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, total + most, "right")))
            yield batch.slice(start, stop - start)
            total, start = int(ends[stop - 1]), stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins and the last ends; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    raw = column.buffers()
    ends = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a multiply and xor-shift finaliser)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _odd(256, 1)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BLANK = _BYTE == 0
_STEP = _odd(1, 2)[0]
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 64), _STEP, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word (A-Z as a-z), number of the first word of each text (and of all), byte where each
    word begins, and the bytes."""
    data, ends = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64), np.zeros(0, np.int64), data
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] |= solid[first]
    starts = np.flatnonzero(begins)
    firsts = np.searchsorted(starts, ends)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts, starts, data
    lengths = np.diff(starts, append=len(data))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = (_FOLDED if fold else _BYTE)[data[starts[0] :]] * _powers(int(lengths.max()))[at]
    return mix(np.add.reduceat(values, starts - starts[0])), firsts, starts, data


_PLACE = _odd(64, 3)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its n-word shingles in order, repeats included; a text of fewer words has its
    whole sequence as one, a text without words none."""
    total = len(words)
    run = np.zeros(max(0, total - n + 1), np.uint64)
    for j in range(n):
        run += words[j : j + len(run)] * _PLACE[j]
    run = mix(run)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(run[a : b - n + 1])
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
