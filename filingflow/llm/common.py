"""What the corpus operators share: scratch tables, Arrow batches as flat byte arrays, word and line boundaries, hashes.

A batch of texts is handled as one flat ``uint8`` array with document offsets, so that numpy does the per-byte work for
many documents at once. Blocks hold about a million bytes (one longer document makes a block of its own), which bounds
the memory of a Python worker whatever the table holds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1_000_000

#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path for intermediate tables under the shared folder that the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster, where other machines would not see
    it, this is an error. The folders stay until the shared folder is cleared: results may still be read from them.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="filingflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/filingflow/{name}-{uuid.uuid4().hex[:12]}"


#: Settings while a step is written: Spark deletes the shuffle files of the finished write, and Arrow batches stay small, as
#: rows can be long texts and executors share their memory with Python workers.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def written(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there: later steps survive lost executors.

    Nothing later reads the shuffle files of this step. The session's settings are put back when the write ends.
    ``rows_per_file`` splits the files, so that few long rows are dealt over tasks when they are read.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), {k: spark.conf.get(k) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, for what holds Python objects for each row; nothing is copied."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def crc_text(column: str):
    """crc32 of an integer column written as text."""
    return F.crc32(F.col(column).cast("string"))


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for consecutive rows of a batch; null texts are empty."""
    texts = batch.column(column)
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    rows = len(texts)
    if not rows:
        return
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, np.int64)[texts.offset : texts.offset + rows + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        last = min(last, rows)
        yield first, last, flat[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last
    pa.default_memory_pool().release_unused()  # else a waiting worker keeps what its last batches took


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    return out


#: Another base, for digests of 128 bits.
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _kept_powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of a base and of its inverse; kept unless they are for one very long document."""
    kept = _POWERS.get(int(base))
    if kept is None or len(kept[0]) < n:
        size = max(n, BLOCK_BYTES + 200_000)
        kept = powers(size, base), powers(size, np.uint64(pow(int(base), -1, 1 << 64)))
        if size <= 4 * BLOCK_BYTES:
            _POWERS[int(base)] = kept
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): equal bytes give equal hashes, wherever they stand."""
    up, down = _kept_powers(len(flat) + 1, base)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
        raw = (sums[end] - sums[start]) * down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_sums(flat: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of every ``size`` consecutive bytes."""
    up, down = _kept_powers(len(flat) + 1, BASE)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
        return mix((sums[size:] - sums[:-size]) * down[: len(flat) - size + 1])


def words(flat: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document and one past the last) of maximal runs outside ``gap``.

    A document's boundary always ends a word.
    """
    inside = ~gap[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    if len(flat):
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, offsets)


def run_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words within a document, and the document of each."""
    count = np.diff(first)
    runs = np.maximum(count - n + 1, 0)
    document = np.repeat(np.arange(len(count)), runs)
    at = np.arange(len(document)) + np.repeat(first[:-1] - (np.cumsum(runs) - runs), runs)
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        for k in range(n):
            total = total * np.uint64(0xA24BAED4963EE407) + hashes[at + k]
            total = mix(total)
    return total, document


def sums_by_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def ranges(x: np.ndarray, parts: int) -> list[int]:
    """Where the ranges of sorted hashes begin and the last one ends."""
    cut = np.searchsorted(x, (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64))
    return [0, *cut.tolist(), len(x)]


def squeezed(x: np.ndarray) -> bytes:
    """An array, compressed with the first bytes of all numbers together, then the second ones: small numbers take little."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 3)


def widened(data: bytes, kind: type) -> np.ndarray:
    """What ``squeezed`` was given."""
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def arrow_table(schema: str, rows: list[tuple]) -> pa.Table:
    """An Arrow table of rows, by a schema of int, long, binary and string columns."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The arrays packed in a binary column, one after another."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist())])
