"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds in work arrays at once.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch where the session leaves Spark's default: texts are long, and both sides of the
#: socket hold whole batches.
BATCH_ROWS, _DEFAULT_ROWS = 1000, 10_000
#: A key with more than 1/HEAVY of all rows is heavy; so there are fewer than HEAVY such keys.
HEAVY = 2000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. A local session where it is
    unset gets a temporary one; a cluster has no folder that could stand in for it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dirs.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="annoloom-")
        _local_dirs[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


_local_dirs: dict[str, str | None] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a
    lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/annoloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._annoloom_path = path
    return table


def release(table: DataFrame, instead: DataFrame | None = None) -> DataFrame | None:
    """Delete the files of a table of ``materialise`` that nothing reads any more; returns ``instead``."""
    path = getattr(table, "_annoloom_path", None)
    if path:
        context = table.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    return instead


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches of ``BATCH_ROWS``, unless the session sets a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == _DEFAULT_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """``mapInArrow`` in small batches; a worker gives memory back after each."""
    small_batches(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lent() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                pa.default_memory_pool().release_unused()

        yield from run(lent())

    return df.mapInArrow(tidy, ddl)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text; a longer text stays whole."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_list(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column in one array, and each row's bounds (rows + 1). Null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.empty(size, np.uint64)
        got[0] = 1
        got[1:] = base
        np.multiply.accumulate(got, out=got)
        if size <= 2 * SLICE_BYTES:
            _powers[name] = got
    return got[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def polynomial(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial modulo 2**64 with these coefficients, and the inverse powers: the hash of
    values[i:j] is (sums[j] - sums[i]) * inverse[i]."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(_BASE, n, "base"), out=sums[1:])
    return sums, _power(_INVERSE, n + 1, "inverse")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[starts[i]:ends[i]], spans in page order, by prefix sums of a polynomial modulo 2**64.
    A long text is taken in parts, for the sums take many bytes for each of its own."""
    if len(data) <= SLICE_BYTES:
        return _span_hashes(data, starts, ends)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        begin = starts[at]
        if ends[at] - begin > SLICE_BYTES:
            out[at] = _long_hash(data[begin : ends[at]])
            at += 1
            continue
        to = int(np.searchsorted(ends, begin + SLICE_BYTES, side="right"))
        out[at:to] = _span_hashes(data[begin : ends[to - 1]], starts[at:to] - begin, ends[at:to] - begin)
        at = to
    return out


def _long_hash(data: np.ndarray) -> np.uint64:
    """The same hash of one long span, block by block."""
    total = len(data) * _LENGTH
    for at in range(0, len(data), SLICE_BYTES):
        part = data[at : at + SLICE_BYTES].astype(np.uint64) + np.uint64(1)
        total += int((part * _power(_BASE, len(part), "base")).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return mix64(np.array([total % (1 << 64)], np.uint64))[0]


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n, "base"), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power(_INVERSE, n + 1, "inverse")[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(_LENGTH))


#: Word separators: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (rows + 1)."""
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1 : n + 1])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of words[i:i+width] for each i with so many words after it."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x100000001B3) + words[k : k + n]
    return mix64(out)


def skew_safe_lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has one row a key and in ``count`` the number of
    rows with it. Keys with over total/HEAVY rows (under HEAVY of them) are broadcast; the other
    keys are joined by a shuffle, in which no key is large. Null keys match nothing."""
    limit = max(1, total // HEAVY)
    others = [c for c in table.columns if c not in keys]
    heavy = table.filter(F.col(count) > limit).select(*keys, F.struct(*others).alias("_heavy"))
    light = table.filter(F.col(count) <= limit).select(*keys, F.struct(*others).alias("_light"))
    rows = rows.join(F.broadcast(heavy), keys, "left")
    own = rows.filter(F.col("_heavy").isNotNull())
    rest = rows.filter(F.col("_heavy").isNull()).drop("_heavy").join(light, keys, "left")
    flat = [c for c in own.columns if c != "_heavy"]
    return own.select(*flat, "_heavy.*").unionByName(rest.select(*flat, "_light.*"))
