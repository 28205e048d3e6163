"""Shared parts: reading tables, cutting lineage, and vectorised tokenising of Arrow text.

All tokenisers here work on whole texts. A null text counts as empty.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_SEED = 0x9E3779B97F4A7C15
#: Text bytes that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Whether Spark deletes the shuffle files of a query when it ends (Spark 4.1; others overlook it).
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once a context, so that nothing need be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_twinlake_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="twinlake-")) / "twinlake.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._twinlake_shipped = True


def bounded_batches(spark: SparkSession) -> None:
    """Before an operator that uses Python: ship the package, and have Arrow batches of a size that
    workers can hold, unless the session chose its own."""
    ship_package(spark)
    for key, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(8 << 20)),
    ):
        if default is None or spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="twinlake-")
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """End the lineage by checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended
        pass


def _save(df: DataFrame, path: str, *by: str) -> None:
    """Write a table. The shuffle files of the write are deleted when it ends: what follows reads the table, and otherwise
    they stay until the driver's garbage collection finds them, which may be steps later."""
    conf = df.sparkSession.conf
    before = conf.get(FILE_CLEANUP, "false")
    conf.set(FILE_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        conf.set(FILE_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """End the lineage by a Parquet table in the shared folder (pruned by column when read)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _save(df, path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)  # a schema given is a job less


def tidy(spark: SparkSession) -> None:
    """Let go of what a finished step has left: its shuffle files and broadcasts stay on the cluster until the driver
    collects its garbage, which it does by itself only when its memory is full."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables written for the steps of one operator; they are deleted when its block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, *by: str) -> DataFrame:
        """``by``: columns whose values get folders of their own."""
        self.paths.append(f"{shared_dir(self.spark)}/tables/{uuid.uuid4().hex}")
        _save(df, self.paths[-1], *by)
        out = self.spark.read.schema(df.schema).parquet(self.paths[-1])
        out._scratch = self.paths[-1]
        return out

    def done(self, *tables: DataFrame) -> None:
        """Delete tables that were returned by ``written`` and that no later step reads."""
        for df in tables:
            self.paths.remove(df._scratch)
            _delete(self.spark, df._scratch)

    def keep_last(self) -> None:
        """Delete all tables but the last one written."""
        while len(self.paths) > 1:
            _delete(self.spark, self.paths.pop(0))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        tidy(self.spark)


# --------------------------------------------------------------------------- bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit (Stafford's variant 13 of a 64-bit finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_SEED))
_BASE, _INV = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        n = max(n, STEP_BYTES + 1)
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(n + 1, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[e] - h[s], times base**-s, a hash of data[s:e]."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(_SEED))


def lower_table(word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte -> byte with A-Z lowered, byte -> is part of a word)."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    is_word = np.zeros(256, bool)
    is_word[np.frombuffer(word, np.uint8)] = True
    return low, is_word[low]


#: Words as runs without space and \t..\r, and words as runs of letters, digits and non-ASCII bytes.
SPACED = lower_table(bytes(b for b in range(256) if b != 0x20 and not 9 <= b <= 13))
ALNUM = lower_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Runs of letters (bytes of non-ASCII characters count as letters).
ALPHA = lower_table(bytes([*range(0x61, 0x7B), *range(0x80, 0x100)]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES):
    """(first row, last row) of runs of rows with at most that many bytes, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


class Words:
    """The words of rows i..j of a batch: hash, start, end (byte offsets in data), and per-row bounds."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind=SPACED):
        low, is_word = kind
        self.data = low[raw]
        self.offsets = offsets
        n = len(raw)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = is_word[raw]
        before, after = inside[:-2].copy(), inside[2:].copy()
        full = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[full] = False
        after[full[1:] - 1] = False
        here = inside[1:-1]
        self.start = np.flatnonzero(here & ~before)
        self.end = np.flatnonzero(here & ~after) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.data), self.start, self.end)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words_of(column: pa.Array, kind=SPACED, most: int = STEP_BYTES):
    """(first row, last row, Words) for all rows of a column, step by step."""
    raw, offsets = utf8(column)
    for i, j in steps(offsets, most):
        yield i, j, Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], kind)


def word_hash(words: list[bytes]) -> np.ndarray:
    """The hash that Words.hashes() gives to each of these (lower-case) words."""
    if not words:
        return np.zeros(0, U64)
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    return span_hash(prefix_hash(data), starts, ends)


class Lookup:
    """Position of 64-bit keys in a fixed table, -1 where absent; a bit filter answers most misses."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.filter = np.zeros(1 << self.BITS, bool)
        self.filter[keys >> U64(64 - self.BITS)] = True

    def __call__(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in asked that are in the table, their position in the table)."""
        maybe = np.flatnonzero(self.filter[asked >> U64(64 - self.BITS)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        k = np.minimum(np.searchsorted(self.keys, asked[maybe]), len(self.keys) - 1)
        hit = self.keys[k] == asked[maybe]
        return maybe[hit], self.order[k[hit]]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i, empty ones 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "fu" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
