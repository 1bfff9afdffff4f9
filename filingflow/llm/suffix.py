"""Exact removal of long repeated byte strings, with a suffix array per shard.

A string of ``LENGTH`` bytes is known by its key: the smallest hash among the ``GRAM``-byte strings inside it. Consecutive
strings with the same key make a segment of a document (a new one after ``STRINGS`` of them), so a document is cut into segments
that overlap by LENGTH - 1 bytes, and equal strings have equal keys wherever they stand. Segments are known by digests of 128
bits. That deals the work out exactly:

1. Documents are dealt over chunks. A chunk sends, for each range of keys, the distinct segments it holds (key, digest, how
   often) to the task that owns the range, and gets back what is known of each over all chunks: it stands alone, all of it is
   repeated, or other segments share its key. A very common segment costs each chunk one entry.
2. Distinct segments that share a key go once to the shard of that key. A shard's suffix array is made by induced sorting,
   and the permuted common prefixes give the strings that start twice.
3. A key with more than ``MOST`` different segments (a passage that a third of all documents share has that at its edges)
   would make one shard grow with the corpus. Its strings are hashed one by one to 128 bits, reduced within each chunk, and
   met over ranges of hashes: the exact way for what is left of hot keys.
4. The removed spans of a document meet its text again, which is cut and hashed.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, SECOND, arrow_table, blocks, joined, mix, ranges, span_hashes, span_sums, written
from .induced import common_prefixes, suffix_array

LENGTH, GRAM = 200, 48
#: Bytes of text in a chunk and of segments in a shard, on average; a shard takes its segments in blocks of this size.
CHUNK_BYTES, SHARD_BYTES = 4_000_000, 1_500_000
#: Chunks at least, so that a small table is dealt over all tasks too.
CHUNKS = 48
#: Different segments of one key that a shard takes, and strings of one segment: together they bound the bytes of a key.
MOST, STRINGS = 1000, 4096
#: What is known of a segment, as bits: all of it is repeated; the shard of its key needs it; so do the hot keys' hashes.
REPEATED, SHARED, HOT = 1, 2, 4


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def sliced_blocks(batch: pa.RecordBatch, length: int = LENGTH):
    """(first row, bytes in front, bytes, offsets) of blocks of rows; a very long document comes in slices that overlap, so
    that each of its strings lies in one of them."""
    for i, _, flat, offsets in blocks(batch):
        if len(offsets) == 2 and len(flat) > 2 * BLOCK_BYTES:
            for at in range(0, len(flat) - length + 1, BLOCK_BYTES):
                own = flat[at : at + BLOCK_BYTES + length - 1]
                yield i, at, own, np.array([0, len(own)])
        else:
            yield i, 0, flat, offsets


def segments(flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, most: int = STRINGS):
    """(document, start, end, key, digest, check, twice): runs of strings with one key, none across documents.

    ``twice`` tells that the key's gram stands twice in the segment; only then can a string start twice within it.
    """
    if len(flat) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, *(none.astype(np.uint64) for _ in range(3)), none.astype(bool)
    h = span_sums(flat, gram)
    width = length - gram + 1
    least = _smallest(h, width)
    n = len(least)
    cut = np.zeros(n, bool)
    cut[0] = True
    cut[1:] = least[1:] != least[:-1]
    edge = np.concatenate([offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])])
    cut[edge[edge < n]] = True
    start = np.flatnonzero(cut)
    last = np.append(start[1:], n)
    document = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[document + 1]
    start, last, document = start[inside], last[inside], document[inside]
    if len(start) and (last - start).max() > most:
        parts = -(-(last - start) // most)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, last, document = np.repeat(start, parts) + part * most, np.repeat(last, parts), np.repeat(document, parts)
        last = np.minimum(last, start + most)
    end, key = last + length - 1, least[start]
    # grams that are the smallest of some string; the next one of the same value shows a key that stands twice
    outside = np.zeros(width - 1, np.uint64)
    place = np.flatnonzero(h == ~_smallest(~np.concatenate([outside, least, outside]), width))
    value, number = np.unique(h[place], return_inverse=True)
    code = np.sort(number * len(flat) + place)
    own = np.searchsorted(value, key) * len(flat)
    at = np.searchsorted(code, own + start) + 1
    twice = np.append(code, np.iinfo(np.int64).max)[np.minimum(at, len(code))] <= own + end - gram
    with np.errstate(over="ignore"):
        digest = mix(span_hashes(flat, start, end) + key)
    return document, start, end, key, digest, span_hashes(flat, start, end, SECOND), twice


def _distinct(digests: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one row of each different pair, pair of each row)."""
    order = np.lexsort((checks, digests))
    d, c = digests[order], checks[order]
    first = np.append(True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])) if len(order) else np.zeros(0, bool)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(first) - 1
    return order[first], back


# --- what is known of a segment over all chunks ---------------------------------------------------------------------

SENT = "part int, chunk int, keys binary, digests binary, checks binary, counts binary"
KNOWN = "chunk int, digests binary, checks binary, codes binary"


def _sent(documents: DataFrame, parts: int) -> DataFrame:
    def gather(key, table):
        keys, digests, checks, counts = *(np.zeros(0, np.uint64) for _ in range(3)), np.zeros(0, np.int64)
        for b in table.combine_chunks().to_batches():
            for _, _, flat, offsets in sliced_blocks(b):
                _, _, _, k, d, c, _ = segments(flat, offsets)
                keys, digests, checks = np.concatenate([keys, k]), np.concatenate([digests, d]), np.concatenate([checks, c])
                at, back = _distinct(digests, checks)
                counts = np.bincount(back, np.concatenate([counts, np.ones(len(d), np.int64)]), len(at)).astype(np.int64)
                keys, digests, checks = keys[at], digests[at], checks[at]
        order = np.argsort(keys, kind="stable")
        keys, digests, checks, counts = keys[order], digests[order], checks[order], np.minimum(counts[order], 2).astype(np.int8)
        edges = ranges(keys, parts)
        return arrow_table(SENT, [(p, key[0].as_py(), *(x[a:b].tobytes() for x in (keys, digests, checks, counts))) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a])

    return documents.groupBy("chunk").applyInArrow(gather, SENT)


def _known(sent: DataFrame, most: int) -> DataFrame:
    def answer(key, table):
        chunks = table.column("chunk").to_numpy()
        sizes = np.array([len(x) // 8 for x in table.column("keys").to_pylist()])
        keys, digests, checks, counts = (joined(table.column(c), t) for c, t in (("keys", np.uint64), ("digests", np.uint64), ("checks", np.uint64), ("counts", np.int8)))
        owner = np.repeat(chunks, sizes)
        order = np.lexsort((owner, checks, digests, keys))
        keys, digests, checks, counts, owner = (x[order] for x in (keys, digests, checks, counts, owner))
        first = np.append(True, (keys[1:] != keys[:-1]) | (digests[1:] != digests[:-1]) | (checks[1:] != checks[:-1])) if len(keys) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        repeated = np.bincount(group, counts) > 1
        new_key = np.append(True, keys[1:] != keys[:-1]) if len(keys) else first
        key_of = np.cumsum(new_key) - 1
        different = np.bincount(key_of[first])[key_of]
        code = repeated[group] * REPEATED + np.where(first & (different > 1), np.where(different > most, HOT, SHARED), 0)
        told = np.flatnonzero(code)
        told = told[np.argsort(owner[told], kind="stable")]
        edges = np.flatnonzero(np.append(True, owner[told][1:] != owner[told][:-1])).tolist() + [len(told)] if len(told) else []
        return arrow_table(KNOWN, [(int(owner[told[a]]), digests[told[a:b]].tobytes(), checks[told[a:b]].tobytes(), code[told[a:b]].astype(np.int8).tobytes()) for a, b in zip(edges, edges[1:], strict=False)])

    return sent.groupBy("part").applyInArrow(answer, KNOWN)


# --- what follows for each chunk -------------------------------------------------------------------------------------

#: kind 0: removed spans of the chunk's documents (rid, start, end); 1: a segment for the shard of its key;
#: 2: strings of hot keys for a range of hashes (two hashes, rid, start; rid 0 and start -1 if the chunk has it twice).
FOUND = "kind int, chunk int, key long, rid long, start long, whole int, data binary"


def _spans_of(rid: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """(rid, start, end) of the merged strings that start at these places."""
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order]
    if not len(rid):
        return np.zeros((0, 3), np.int64)
    new = np.append(True, (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + length))
    return np.stack([rid[new], start[new], start[np.append(new[1:], True)] + length], 1)


def _found(documents: DataFrame, known: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    def follow(key, left, right):
        chunk = key[0].as_py()
        told, proof, codes = joined(right.column("digests"), np.uint64), joined(right.column("checks"), np.uint64), joined(right.column("codes"), np.int8)
        order = np.argsort(told)
        told, proof, codes = told[order], proof[order], codes[order]
        spans, rows, hot, sent = [], [], [], set()
        for b in left.combine_chunks().to_batches():
            rids = b.column("rid").to_numpy()
            for i, front, flat, offsets in sliced_blocks(b):
                document, start, end, keys, digest, check, twice = segments(flat, offsets)
                if not len(document):
                    continue
                code = np.zeros(len(document), np.int8)
                if len(told):
                    at = np.minimum(np.searchsorted(told, digest), len(told) - 1)
                    code = np.where((told[at] == digest) & (proof[at] == check), codes[at], 0)
                code = np.where((code == 0) & twice, SHARED, code)
                rid, own = rids[i + document], start - offsets[document] + front
                whole = np.flatnonzero(code & REPEATED)
                spans.append(np.stack([rid[whole], own[whole], own[whole] + end[whole] - start[whole]], 1))
                for r in np.flatnonzero(code & SHARED):
                    if (digest[r], check[r]) not in sent:
                        if code[r] & REPEATED:
                            sent.add((digest[r], check[r]))
                        rows.append((1, chunk, int(keys[r].view(np.int64)), int(rid[r]), int(own[r]), int(code[r] & REPEATED), flat[start[r] : end[r]].tobytes()))
                picked = [r for r in np.flatnonzero(code & HOT) if not (code[r] & REPEATED and (digest[r], check[r]) in sent)]
                sent.update((digest[r], check[r]) for r in picked if code[r] & REPEATED)
                if picked:
                    size = end[picked] - start[picked] - length + 1
                    row = np.repeat(np.array(picked), size)
                    at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                    with np.errstate(over="ignore"):
                        h = mix(span_hashes(flat, at, at + length) + keys[row])
                    hot.append((h, span_hashes(flat, at, at + length, SECOND), rid[row], at - offsets[document[row]] + front))
        if hot:
            h, second, rid, start = (np.concatenate([x[k] for x in hot]) for k in range(4))
            order = np.lexsort((second, h))
            h, second, rid, start = (x[order] for x in (h, second, rid, start))
            first = np.append(True, (h[1:] != h[:-1]) | (second[1:] != second[:-1]))
            n = np.diff(np.append(np.flatnonzero(first), len(h)))
            here = np.repeat(n > 1, n)
            spans.append(_spans_of(rid[here], start[here], length))
            h, second, rid, start = h[first], second[first], np.where(n > 1, 0, rid[first]), np.where(n > 1, -1, start[first])
            edges = ranges(h, parts)
            rows += [(2, chunk, p, None, None, None, np.stack([h[a:b].view(np.int64), second[a:b].view(np.int64), rid[a:b], start[a:b]], 1).tobytes()) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        if spans:
            rows.append((0, chunk, None, None, None, None, np.concatenate(spans).astype(np.int64).tobytes()))
        return arrow_table(FOUND, rows)

    return documents.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(follow, FOUND)


SPANS = "chunk int, data binary"


def _by_chunk(chunk: np.ndarray, spans: np.ndarray) -> pa.Table:
    order = np.argsort(chunk, kind="stable")
    chunk, spans = chunk[order], spans[order]
    edges = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])).tolist() + [len(chunk)] if len(chunk) else []
    return arrow_table(SPANS, [(int(chunk[a]), spans[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)])


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece, place) of every string of ``length`` bytes in the pieces that starts at two places or more."""
    size = np.array([len(p) for p in pieces])
    flat = np.frombuffer(b"\0".join(pieces) + b"\0\0", np.uint8).astype(np.int64) + 2
    end = np.cumsum(size + 1) - 1
    flat[end] = 1
    flat[-1] = 0
    prefix, before = common_prefixes(flat, suffix_array(flat, 258))
    begin = end - size
    piece = np.repeat(np.arange(len(pieces)), size + 1)
    at = np.flatnonzero(prefix[:-1] >= length)
    at = at[at + length <= end[piece[at]]]
    mark = np.zeros(len(flat), bool)
    mark[at] = mark[before[at]] = True
    at = np.flatnonzero(mark)
    return piece[at], at - begin[piece[at]]


def _shards(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """The removed spans that the suffix arrays of the shards show, a row for each shard and chunk."""
    rows = found.where("kind = 1")
    shards = max(1, -(-(rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // SHARD_BYTES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))

    def search(key, table):
        table = table.sort_by([("key", "ascending"), ("chunk", "ascending"), ("rid", "ascending"), ("start", "ascending")])
        keys, chunk, rid, start, whole = (table.column(c).to_numpy() for c in ("key", "chunk", "rid", "start", "whole"))
        data = table.column("data").to_pylist()
        size = np.cumsum([len(x) for x in data])
        chunks, spans, a = [], [], 0
        while a < len(data):
            b = int(np.searchsorted(size, (size[a - 1] if a else 0) + SHARD_BYTES, "right"))
            b = int(np.searchsorted(keys, keys[min(max(b, a), len(keys) - 1)], "right"))  # keys stay whole
            piece, at = repeated_starts(data[a:b], length)
            piece += a
            keep = whole[piece] == 0
            piece, at = piece[keep], at[keep]
            got = _spans_of(piece, start[piece] + at, length)
            chunks.append(chunk[got[:, 0]])
            got[:, 0] = rid[got[:, 0]]
            spans.append(got)
            a = b
        return _by_chunk(np.concatenate(chunks), np.concatenate(spans))

    return rows.select("shard", "key", "chunk", "rid", "start", "whole", "data").groupBy("shard").applyInArrow(search, SPANS)


def _hot(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """The removed spans of hot keys: strings whose hash comes from two places or more."""

    def meet(key, table):
        rows = [np.frombuffer(x, np.int64).reshape(-1, 4) for x in table.column("data").to_pylist()]
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(x) for x in rows])
        h, second, rid, start = np.concatenate(rows).T
        at, back = _distinct(h, second)
        n = np.bincount(back, minlength=len(at))
        keep = (n[back] > 1) & (start >= 0)
        chunk, rid, start = chunk[keep], rid[keep], start[keep]
        return _by_chunk(chunk, np.stack([rid, start, start + length], 1))

    return found.where("kind = 2").select("key", "chunk", "data").groupBy("key").applyInArrow(meet, SPANS)


# --- the documents again ---------------------------------------------------------------------------------------------

REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Maximal (start, end) runs of sorted spans."""
    if len(spans) < 2:
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[new, 0], reach[np.append(new[1:], True)]], 1)


def _cut(documents: DataFrame, spans: DataFrame, texts: bool) -> DataFrame:
    def cut(key, left, right):
        triples = joined(right.column("data"), np.int64).reshape(-1, 3)
        triples = triples[np.lexsort((triples[:, 1], triples[:, 0]))]
        out = []
        for b in left.combine_chunks().to_batches():
            for doc_id, rid, text in zip(b.column("doc_id").to_pylist(), b.column("rid").to_pylist(), b.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                a, z = np.searchsorted(triples[:, 0], [rid, rid], "left")[0], np.searchsorted(triples[:, 0], rid, "right")
                runs = _merged(triples[a:z, 1:]).tolist()
                kept, at = [], 0
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                out.append((doc_id, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in runs], kept if texts else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), SPAN_TYPE, pa.binary())
        return pa.table({name.split()[0]: pa.array([r[i] for r in out], kinds[i]) for i, name in enumerate(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"))})

    return documents.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(cut, REMOVED)


def remove_repeats(documents: DataFrame, texts: bool = True, most: int = MOST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and the kept bytes of each row of ``documents``.

    Every byte goes that a 200-byte string covers which also starts elsewhere in the corpus, the same document included;
    all occurrences go, and strings never cross documents. Null texts are empty, empty and short texts stay. Repeated rows
    stay rows and are repeats of each other; a null doc_id is a value like others; an empty table gives an empty result;
    other columns are not read. ``texts`` false leaves ``kept`` null.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(CHUNKS, -(-total // chunk_bytes))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("chunk", F.pmod("rid", F.lit(chunks)).cast("int"))
    long = rows.where(F.octet_length("text") >= LENGTH).select("chunk", "rid", "text")
    known = written(_known(_sent(long, chunks), most), "segments")
    found = written(_found(long, known, chunks), "found")
    spans = found.where("kind = 0").select("chunk", "data").unionByName(_shards(found)).unionByName(_hot(found))
    return _cut(rows, written(spans, "spans"), texts)
