"""WARC archives from a table of pages: a deterministic sharded writer, and a reader of what it wrote.

Records are sorted by page id and payload digest; shards are ranges of that order with about equal bytes of payload, so a
page id that many rows have (or none) is spread too. Each shard is one task, which rolls to a new file whenever the compressed
size passes a limit. Every record is its own gzip member with fresh headers and digests. A task writes under
temporary names and returns the manifest rows of its files; files get their final names only in the commit that follows,
and a shard that was written twice (a retried task) counts once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, sliced, written

#: What a record weighs besides its payload when shards are cut.
HEAD_BYTES = 600
#: Fixed date of the regenerated headers, so that the same rows give the same bytes.
DATE = "2000-01-01T00:00:00Z"
FILE_BYTES = 128_000_000
#: Bytes of payloads behind a shard, on average, and shards at least: both follow from the table alone.
SHARD_BYTES, SHARDS = 256_000_000, 16
#: Bins of one counting round; a bin goes on being cut while it holds more than this share of a shard.
BINS, FINE = 4096, 0.25
MANIFEST = "shard int, file int, path string, records long, bytes long, sha256 string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path)


def revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, sha, refers_to of each row (page_id, sha, n) whose payload an earlier record has.

    Of rows with equal payloads of at least ``min_payload`` bytes, those with the smallest page_id stay responses; a null
    page_id comes last. Digests are counted with partial aggregates first, and only digests that occur more than once are
    joined back, where Spark may split a hot one. Payloads themselves are not moved.
    """
    first = pages.groupBy("sha", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_c"))
    first = first.where((F.col("_c") > 1) & (F.col("n") >= min_payload)).select(F.col("sha").alias("_s"), "refers_to")
    joined = pages.join(written(first, "payloads"), F.col("sha") == F.col("_s"))
    return joined.where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to")


def _ranks(column: pa.Array) -> np.ndarray:
    """Page ids as unsigned numbers of the same order, nulls first."""
    valid, own = column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy()
    return np.where(valid, own.view(np.uint64) ^ np.uint64(1 << 63), np.uint64(0))


def _head(sha: pa.Array) -> np.ndarray:
    """The first twelve bits of hexadecimal digests."""
    return np.array([int(x[:3], 16) for x in sha.to_pylist()], np.int64)


def _sums(pages: DataFrame, bins) -> np.ndarray:
    """The sizes of the rows that fall into each bin, as (bin, size) rows, summed by Spark; ``bins`` numbers a batch's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, back = np.unique(bins(b), return_inverse=True)
                size = np.zeros(len(at), np.int64)
                np.add.at(size, back, b.column("n").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(size)], names=["bin", "n"])

    got = pages.mapInArrow(run, "bin long, n long").where("bin >= 0").groupBy("bin").agg(F.sum("n")).collect()
    return np.array(sorted((r[0], r[1]) for r in got), np.int64).reshape(-1, 2)


def shard_bounds(pages: DataFrame, shards: int) -> list[tuple[int, int]]:
    """The first (rank of the page id, digest head) of the shards 1.. for rows (page_id, sha, n): about equal sums of n.

    Counting rounds cut the bins that hold much until they hold little or one page id; the rows of such an id are then
    counted by their digests. All sums are exact, so the same rows give the same bounds. At most about eight bins a shard
    are cut in a round, which bounds what the driver holds.
    """
    low, high, nulls, total = pages.agg(F.min("page_id"), F.max("page_id"), F.count_if(F.col("page_id").isNull()), F.sum("n")).first()
    if not total or shards < 2:
        return []
    first = 0 if nulls or low is None else low + (1 << 63)
    last = 0 if high is None else high + (1 << 63)
    limit = max(1, FINE * total / shards)

    def cut(a: int, z: int, parts: int) -> set[int]:
        return {a + (z - a) * k // parts for k in range(parts)}

    edges = sorted(cut(first, last + 1, BINS) | {last + 1})
    while True:
        shared = np.array(edges[:-1], np.uint64)
        found = _sums(pages, lambda b, shared=shared: np.searchsorted(shared, _ranks(b.column("page_id")), "right") - 1)
        heavy = [k for k, n in found.tolist() if n > limit and edges[k + 1] - edges[k] > 1]
        if not heavy:
            break
        parts = max(16, 16 * BINS // len(heavy))
        edges = sorted({*edges, *(e for k in heavy for e in cut(edges[k], edges[k + 1], parts))})
    single = np.array([k for k, n in found.tolist() if n > limit], np.int64)
    heads = np.zeros((0, 2), np.int64)
    if len(single):
        ranks = np.array([edges[k] for k in single], np.uint64)

        def by_head(b: pa.RecordBatch) -> np.ndarray:
            rank = _ranks(b.column("page_id"))
            at = np.minimum(np.searchsorted(ranks, rank), len(ranks) - 1)
            return np.where(ranks[at] == rank, single[at] * 4096 + _head(b.column("sha")), -1)

        heads = _sums(pages, by_head)
    light = [(k, 0, n) for k, n in found.tolist() if n <= limit]
    bounds, seen = [], 0
    for k, head, n in sorted([*light, *((c // 4096, c % 4096, n) for c, n in heads.tolist())]):
        if seen >= total * (len(bounds) + 1) / shards:
            bounds.append((edges[k], head))
        seen += n
    return bounds


def shard_of(bounds: list[tuple[int, int]]):
    """A column function of (page_id, sha): how many bounds do not lie behind a row."""
    rank, head = np.array([b[0] for b in bounds], np.uint64), np.array([b[1] for b in bounds] + [0], np.int64)
    equal = int(np.unique(rank, return_counts=True)[1].max(initial=0))

    @F.arrow_udf("int")
    def number(page_id: pa.Array, sha: pa.Array) -> pa.Array:
        own = _ranks(page_id)
        at, z = np.searchsorted(rank, own, "left"), np.searchsorted(rank, own, "right")
        if (z > at).any():
            mine = _head(sha)
            for _ in range(equal):
                at = at + ((at < z) & (head[np.minimum(at, len(head) - 1)] <= mine))
        return pa.array(at.astype(np.int32))

    return number


def _urn(page_id: int | None, payload: bytes, number: int) -> str:
    """The id of a record: page id, payload digest and the number among rows that agree in both."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{hashlib.sha1(payload).hexdigest()}:{number}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, number: int = 0) -> bytes:
    """One WARC record; a revisit has the headers of its payload and no body, and names the first record with it."""
    body = b"" if refers_to is not None else payload
    target = "".join((url or "about:blank").split()) or "about:blank"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, payload, number)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(body)}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, payload, 0)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Roll:
    """The open file of a shard, its temporary names and the manifest rows so far."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.fs, self.root = _filesystem(folder)
        self.shard, self.limit, self.rows, self.attempt = shard, limit, [], uuid.uuid4().hex[:12]
        self.out = None

    def add(self, data: bytes) -> None:
        member = gzip.compress(data, 6, mtime=0)
        if self.out is not None and self.size + len(member) > self.limit:
            self.close()
        if self.out is None:
            self.name = f"_temporary-{self.attempt}-{self.shard:05d}-{len(self.rows):05d}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.records = self.size + len(member), self.records + 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, len(self.rows), self.name, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def write_archives(pages: DataFrame, folder: str, shards: int | None = None, min_payload: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a WARC record; returns the committed manifest.

    Null html is an empty payload, a null url ``about:blank``; a null page_id sorts first and repeated rows stay. An empty
    table commits an empty manifest. Records keep the order of (page_id, payload digest) in and across the files.
    """
    spark = pages.sparkSession
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    sizes = written(rows.select("page_id", "sha", (F.octet_length("html").cast("long") + HEAD_BYTES).alias("n")), "pages")
    shards = shards or max(SHARDS, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // SHARD_BYTES))
    again = revisits(sizes, min_payload + HEAD_BYTES).distinct()
    # a note that a record is a revisit sorts right before the record, so that payloads are shuffled once
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(again, allowMissingColumns=True)
    bounds = shard_bounds(sizes, shards)
    both = both.withColumn("shard", shard_of(bounds)("page_id", "sha") if bounds else F.lit(0))
    # a shard is a partition of its own
    both = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "sha", F.col("html").isNotNull(), "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, done, noted, last, number = None, [], None, None, 0
        for b in sliced(batches, 100):
            for k, page_id, url, html, sha, refers in zip(*(b.column(c) for c in ("shard", "page_id", "url", "html", "sha", "refers_to")), strict=True):
                place = (page_id.as_py(), sha.as_py())
                if not html.is_valid:
                    noted = (*place, refers.as_py())
                    continue
                last, number = place, number + 1 if place == last else 0
                if roll is None or roll.shard != k.as_py():
                    if roll is not None:
                        roll.close()
                        done += roll.rows
                    roll = _Roll(folder, k.as_py(), file_bytes)
                roll.add(record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8"), noted[2] if noted and noted[:2] == place else None, number))
        if roll is not None:
            roll.close()
            done += roll.rows
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    # the rows come from the attempts that Spark accepted, one for each task
    files = sorted(tuple(r) for r in both.mapInArrow(write, MANIFEST).collect())
    return _commit(spark, fs, root, folder, files)


def _commit(spark, fs, root: str, folder: str, files: list[tuple]) -> DataFrame:
    """Final names for the accepted files, then the manifest, then away with what failed attempts left."""
    final = []
    for shard, k, name, *rest in files:
        path = f"part-{shard:05d}-{k:05d}.warc.gz"
        fs.move(f"{root}/{name}", f"{root}/{path}")
        final.append((shard, k, path, *rest))
    lines = "".join(json.dumps(dict(zip(("shard", "file", "path", "records", "bytes", "sha256"), f, strict=True))) + "\n" for f in final)
    with fs.open_output_stream(f"{root}/_manifest.tmp") as out:
        out.write(lines.encode())
    fs.move(f"{root}/_manifest.tmp", f"{root}/manifest.jsonl")
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.base_name.startswith("_temporary-"):
            fs.delete_file(info.path)
    return spark.createDataFrame([(s, k, f"{folder}/{p}", *rest) for s, k, p, *rest in final], MANIFEST)


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, file string"


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the files in a manifest: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload, file.

    Digests of responses are computed from what is read and must equal their header. A revisit has no payload.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                for row in parse(path):
                    rows.append(row)
                    held += len(row[6] or b"")
                    if held > 4_000_000 or len(rows) == 1000:
                        yield _records(rows)
                        rows, held = [], 0
                yield _records(rows)

    files = manifest.select("path", "bytes")
    return files.repartition(max(1, files.count())).mapInArrow(load, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in RECORDS.split(", ")])


def _page(urn: str) -> int | None:
    number = urn.strip("<>").split(":")[2]
    return None if number == "null" else int(number)


def parse(path: str) -> Iterator[tuple]:
    """The records of one archive, read as a stream of gzip members."""
    fs, name = _filesystem(path)
    with fs.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(_Readable(raw), 1 << 20)) as f:
        while line := f.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{path}: no record starts here: {line[:40]!r}")
            head = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
                head[key] = value
            body = f.read(int(head["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: a record does not end where its length says")
            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and base32_sha1(body) != digest:
                raise ValueError(f"{path}: the payload of {head['WARC-Record-ID']} does not have its digest")
            refers = _page(head["WARC-Refers-To"]) if kind == "revisit" else None
            yield _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, refers, digest, int(head["X-Payload-Length"]), body if kind == "response" else None, path


class _Readable(io.RawIOBase):
    """An Arrow input stream as a raw Python stream."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.stream.read(len(into))
        into[: len(data)] = data
        return len(data)


def archive_pages(pages: DataFrame, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back: one row per record, in the columns of ``read_archives``.

    The number of shards follows from the bytes of the payloads, unless it is given: the same rows give the same files.
    """
    return read_archives(write_archives(pages, folder or scratch(pages.sparkSession, "warc"), shards))
