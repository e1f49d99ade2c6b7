"""Shared helpers: written intermediate tables, word columns, vectorised word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset and all runs on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path or f"file://{tempfile.gettempdir()}/glossa-{os.getpid()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. One that is read in fewer parts than there are cores (a small file) is dealt out, so that a pass over its texts uses them all; larger tables are left as they lie."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(2 * cores)


def numbers(df: DataFrame) -> list[np.ndarray]:
    """The numeric columns of a df of bounded size as arrays; they come packed, a row a partition, not as rows of objects."""
    kinds = [(f.name, {"bigint": np.int64, "int": np.int32, "double": np.float64}[f.dataType.simpleString()]) for f in df.schema.fields]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        columns = [b"".join(np.ascontiguousarray(b.column(i).to_numpy(), kind).tobytes() for b in found) for i, (_, kind) in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=[n for n, _ in kinds])

    rows = df.mapInArrow(pack, ", ".join(f"{n} binary" for n, _ in kinds)).collect()
    return [np.frombuffer(b"".join(r[i] for r in rows), kind) for i, (_, kind) in enumerate(kinds)]


def word_count(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int = 100_000, most_bytes: int = 256 << 20) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows and its strings, arrays and maps at most `most_bytes`, else as it is (a shuffled join)."""
    widths = [F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else F.octet_length(F.to_json(F.struct(f.name))) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    total = F.lit(0).cast("long")
    for w in widths:
        total = total + F.coalesce(w, F.lit(0))
    found = df.select(total.alias("width")).limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("width"), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= most_bytes else df


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, most_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of a string column as (first row, end row, bytes, row ends), about most_bytes at a time; nulls are empty."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most_bytes, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i + 1 : j + 1] - at[i]
        i = j


_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def words(raw: np.ndarray, ends: np.ndarray, without_marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased, white space \\x20 \\x09-\\x0D) and the words' counts by row.

    without_marks: ASCII punctuation counts for nothing, and words of nothing else are left out.
    """
    n = len(raw)
    none = np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    if not n:
        return none
    first = np.zeros(n, bool)  # of a row
    starts_of_rows = np.concatenate(([0], ends[:-1]))
    first[starts_of_rows[starts_of_rows < n]] = True
    is_word = ~_SPACE[raw]
    begins = is_word.copy()
    begins[1:] &= first[1:] | ~is_word[:-1]
    start = np.flatnonzero(begins)
    if not len(start):
        return none
    counted = is_word & ~_MARK[raw] if without_marks else is_word
    upto = np.cumsum(counted, dtype=np.int64)
    which = np.maximum(np.cumsum(begins) - 1, 0)
    place = upto - 1 - (upto[start] - counted[start])[which]
    value = _BYTES[_LOWER[raw]] * _POWERS[place & 63]
    if (far := place > 63).any():  # so that equal bytes 64 apart differ
        value[far] = mix64(value[far] + (place[far] >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value[~counted] = 0
    hashes = mix64(np.add.reduceat(value, start))
    if without_marks:
        some = np.diff(np.append(upto[start] - counted[start], upto[-1])) > 0
        start, hashes = start[some], hashes[some]
    return hashes, np.bincount(np.searchsorted(ends, start, "right"), minlength=len(ends)).astype(np.int64)


_FIVE = np.random.default_rng(13).integers(1, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's 5-word shingles, repeats kept, and the rows they are of; the rows' words follow one another.

    With fewer words a row's whole sequence is one shingle (these stand at the end), without words there is none.
    """
    rows = np.repeat(np.arange(len(counts)), counts)
    n = max(len(hashes) - 4, 0)
    total = np.full(n, 5, np.uint64)
    for i in range(5):
        total += hashes[i : i + n] * _FIVE[i]
    whole = rows[:n] == rows[4:]
    out, of = mix64(total[whole]), rows[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < 5))
    if len(short):
        begin = np.cumsum(counts) - counts
        total = counts[short].astype(np.uint64)
        for i in range(4):
            there = counts[short] > i
            total[there] += hashes[begin[short][there] + i] * _FIVE[i]
        out, of = np.concatenate([out, mix64(total)]), np.concatenate([of, short])
    return out, of
