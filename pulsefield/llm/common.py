"""Shared plumbing: shared-folder checkpoints, byte-bounded Arrow slices, words and their hashes."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 19
#: Broadcast relations and arrays stay under this; beyond it each operator has another way.
BROADCAST_BYTES = 32 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Two polynomial hashes modulo a prime, so no text is known to collide with another by the shape of its letters alone.
_M = np.uint64((1 << 31) - 1)
_BASES = (1_412_358_601, 768_934_273)
_powers = np.ones((4, 1), np.uint32)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is set, one in the warehouse, which executors share too."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, rows: int | None = None):
    """For plans that run inside: they delete their shuffle files as they end, as nothing reads them again, and send at
    most `rows` rows in an Arrow batch."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({ROWS: str(rows)} if rows else {})
    before = {key: spark._jsparkSession.conf().get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder that the session names."""
    shared_dir(df.sparkSession)
    with settings(df.sparkSession, rows):
        return df.select("*").checkpoint()  # a plan of its own, made under the settings


def stored(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str]:
    """Cut lineage with a Parquet table in the shared folder; denser than a checkpoint where rows are many. remove() it by its path."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with settings(df.sparkSession, rows):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that stored() wrote, once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts can be long: rows in an Arrow batch between the JVM and Python, unless the session has its own number.

    Spark reads it as a plan runs, after the operator has returned it, so it stays set.
    """
    if spark._jsparkSession.conf().get(ROWS) == "10000":
        spark.conf.set(ROWS, str(rows))


def slices(batch: pa.RecordBatch, text: int, most: int = STEP_BYTES, rows: int = 8192):
    """Consecutive slices of a record batch of at most `rows` rows whose text column holds about `most` bytes."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def trim() -> None:
    """Give what this worker no longer uses back to the system, as idle workers stay for the next task."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow by workers that hold on to no memory between tasks."""

    def trimmed(batches):
        yield from run(batches)
        trim()

    return df.mapInArrow(trimmed, schema)


def map_text(df: DataFrame, make, fields: list[tuple[str, T.DataType]], text: str = "text", keep: tuple[str, ...] = ("doc_id",), step_bytes: int = STEP_BYTES) -> DataFrame:
    """mapInArrow over whole texts: make() runs once a task and returns slice's text array -> output columns.

    Only `keep` columns pass through, so other input columns can't clash with the output's.
    """
    small_batches(df.sparkSession)
    src = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([src.schema[k] for k in keep] + [T.StructField(n, t) for n, t in fields])

    def run(batches):
        fn = make()
        for batch in batches:
            for part in slices(batch, len(keep), step_bytes):
                cols = fn(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *cols], names=schema.names)

    return map_arrow(src, run, schema)


def squeeze(x: np.ndarray) -> bytes:
    """An array as compressed bytes that begin with their length."""
    return x.nbytes.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x).view(np.uint8), "zstd", asbytes=True)


def unsqueeze(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True), kind)


def pack(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end and the n+1 offsets; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    x = (x & _M) + (x >> np.uint64(31))
    x = (x & _M) + (x >> np.uint64(31))
    return np.where(x >= _M, x - _M, x)


def powers(n: int) -> np.ndarray:
    """The first n powers of both bases and then of their inverses."""
    global _powers
    if _powers.shape[1] < n:
        rows = []
        for base in (*_BASES, *(pow(b, -1, int(_M)) for b in _BASES)):
            x = np.ones(1, np.uint64)
            while len(x) < n:
                x = np.concatenate([x, fold(x[: n - len(x)] * np.uint64(pow(base, len(x), int(_M))))])
            rows.append(x.astype(np.uint32))
        _powers = np.stack(rows)
    return _powers[:, :n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n+1 prefix sums of each of the two polynomial hashes (see span_hash)."""
    p = powers(len(data) + 1)
    out = np.zeros((2, len(data) + 1), np.uint32)
    letters = data.astype(np.uint64) + np.uint64(1)
    for k in range(2):
        out[k, 1:] = fold(np.cumsum(fold(letters * p[k, : len(data)])))
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of 62 bits of the spans [start, end), the same wherever equal bytes stand."""
    p = powers(prefix.shape[1])
    out = []
    for k in range(2):
        between = prefix[k][end].astype(np.uint64) + _M - prefix[k][start]
        out.append(fold(fold(between) * p[2 + k][start]))
    return mix(out[0] | out[1] << np.uint64(31))


def words(data: np.ndarray, off: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes not in `apart`, never across texts, and n+1 word offsets of the texts."""
    n = len(data)
    inside = ~apart[data]
    edge = off[:-1][off[:-1] < n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def coded_words(texts: pa.Array, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's place in the last result, n+1 word offsets of the texts, and the distinct words' bytes, A-Z lower-cased."""
    data, off = pack(texts)
    starts, ends, at = words(data, off, apart)
    letters = LOWER[data][~apart[data]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    each = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(letters)])
    each = each.dictionary_encode()
    return each.indices.to_numpy(zero_copy_only=False), at, each.dictionary


def hashes_of(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of byte strings."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    distinct = distinct.cast(pa.large_binary())
    _, off, data = distinct.buffers()
    off = np.frombuffer(off, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    raw = data[off[0] : off[-1]].to_pybytes() if data is not None else b""
    off = (off - off[0]).tolist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, map(raw.__getitem__, map(slice, off, off[1:]))), np.uint64, len(distinct))


def word_hashes(texts: pa.Array, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and n+1 offsets."""
    codes, off, distinct = coded_words(texts, apart)
    return hashes_of(distinct)[codes], off


def sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of x over ragged rows, empty rows 0."""
    total = np.zeros(len(x) + 1, x.dtype if x.dtype.kind == "f" else np.int64)
    np.cumsum(x, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
