"""Helpers of the training-data operators: tables, shared folders, words and shingles.

Words are maximal runs of bytes other than space and ``\\t\\n\\v\\f\\r``; word and
shingle hashes are computed for a whole slice of an Arrow column at once with
numpy, straight on the column's UTF-8 buffer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipflow.session import app_id, checkpoint_dir

SHINGLE = 5
# Bytes of text that numpy handles in one go (a longer document is one slice of its own).
SLICE_BYTES = 1 << 20
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{app_id(spark)}-llm/{name}-{uuid.uuid4().hex}"


BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in Arrow batches of bounded rows and bytes.

    A batch is held whole outside the executor's heap, by its JVM and by the Python worker, and neither gives
    that memory back; Spark's 10,000 rows are 20 MB of short texts and without bound for long ones.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_paths: list[str] = []  # what ``written`` has left in the shared folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, before: int, after: int) -> int:
    """Delete the tables written from number ``before`` up to ``after``, which nothing reads any longer.

    Returns how many are left, the number of the next one.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _paths[before:after]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del _paths[before:after]
    return len(_paths)


BROADCAST_KEYS = 500_000  # of two longs at most: 32 MB in a join's hash table


def anti_join(rows: DataFrame, keys: DataFrame, on) -> DataFrame:
    """``rows`` (wide) that meet none of ``keys`` (at most two longs a row, written): the keys are broadcast up
    to ``BROADCAST_KEYS``, so the rows are not shuffled; more of them meet the rows in a shuffle."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_anti")


def collected(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table of proven size on the driver, moved as Arrow batches (no row objects)."""
    table = df.toArrow()
    return {name: table.column(name).to_numpy() for name in table.column_names}


def crc_fold(doc_id: str, folds: int):
    """``crc32(doc_id as text) mod folds`` (null ids are in no fold)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- words and shingles -------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_BYTE[_SPACE] = 0
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_STEP = U64(0xD6E8FEB86659FD93)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the hash base (up) or of its inverse (down), modulo 2**64."""
    got = _powers[kind]
    if len(got) < n:
        size = 1 << (n - 1).bit_length()
        base = np.full(size, _BASE if kind == "up" else _BASE_INV, U64)
        base[0] = 1
        got = _powers[kind] = np.multiply.accumulate(base)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (invertible), so that every bit depends on every other."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, one row at least."""
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, min(end, rows)
        row = end


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows ``at`` bounds, and where each row's words begin."""
    lo, hi = int(at[0]), int(at[-1])
    text = data[lo:hi]
    rows = at - lo
    if not len(text):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    space = _SPACE[text]
    begins = ~space
    begins[1:] &= space[:-1]
    cuts = rows[:-1][rows[:-1] < len(text)]
    begins[cuts] = ~space[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    parts = (_BYTE_LOWER if lower else _BYTE)[text]
    parts *= _power("up", len(text))
    hashes = np.add.reduceat(parts, starts)
    hashes *= _power("down", len(text))[starts]
    return mix(hashes), np.searchsorted(starts, rows)


def grams(words: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k-word window that begins at each word, and whether the window fits its row."""
    n = len(words)
    h = np.zeros(n, U64)
    for i in range(min(k, n)):
        h[:n - i] += words[i:] * U64(pow(int(_STEP), k - i, 1 << 64))
    ends = np.repeat(at[1:], np.diff(at))
    return mix(h), np.arange(n) + k <= ends


def shingle_sets(column, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles (lower-cased A-Z).

    Fewer than k words: the whole sequence is one shingle.  No words: empty.
    """
    data, at = utf8(column)
    for a, b in slices(at):
        words, begin = word_hashes(data, at[a:b + 1])
        hashes, fits = grams(words, begin, k) if len(words) else (words, words)
        for i in range(b - a):
            x, y = int(begin[i]), int(begin[i + 1])
            if y - x >= k:
                yield np.unique(hashes[x:y - k + 1])
            elif y > x:
                short = np.array([y - x], U64)
                for w in words[x:y]:
                    short = mix(short * _STEP + w)
                yield short
            else:
                yield np.zeros(0, U64)


class Identity:
    """64-bit identity of a shingle set, told apart by 128 bits.

    ``moved`` names the sets whose first 64 bits another set has too: (first, last 64 bits) -> identity.
    """

    def __init__(self, moved: dict[tuple[int, int], int] | None = None):
        self.moved = moved or {}

    @staticmethod
    def halves(shingles: np.ndarray) -> tuple[int, int]:
        whole = xxhash.xxh3_128_intdigest(shingles.tobytes(), seed=len(shingles))
        return (whole & (1 << 64) - 1) - (1 << 63), (whole >> 64) - (1 << 63)

    def __call__(self, shingles: np.ndarray) -> int:
        first, last = self.halves(shingles)
        return self.moved.get((first, last), first) if self.moved else first


def identity(sets: DataFrame) -> Identity:
    """From the halves ``(id, check)`` of all sets.

    Sets that share an id are brought to the driver: about n * n / 2**65 of n sets, ten of 2 * 10**10.
    """
    several = (sets.groupBy("id").agg(F.min("check").alias("least"), F.max("check").alias("most"))
               .where("least <> most").select("id", "least").collect())
    if not several:
        return Identity()
    least = dict(map(tuple, several))
    rows = sets.where(F.col("id").isin(list(least))).select("id", "check").distinct().collect()
    return Identity({(i, c): xxhash.xxh3_64_intdigest(f"{i}:{c}") - (1 << 63) for i, c in rows if c != least[i]})


def named(sets: DataFrame, ident: Identity) -> DataFrame:
    """``sets (id, check, ...)`` with the final ids."""
    out = F.col("id")
    for (first, last), new in ident.moved.items():
        out = F.when((F.col("id") == first) & (F.col("check") == last), new).otherwise(out)
    return sets.withColumn("id", out)


def shift(values: np.ndarray) -> np.ndarray:
    """uint64 as Spark's signed long, bit for bit."""
    return values.view(np.int64)


def batches(names_types: list[tuple[str, pa.DataType]], rows: Iterable[tuple], size: int = 20_000
            ) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches."""
    schema = pa.schema(names_types)
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
