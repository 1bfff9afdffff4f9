"""Alignment of two tokenizers: which tokens of one overlap which of the other, over texts and over the corpus.

Both tokenizers cover the same bytes, a text with a space in front. The tokens of the second lie in a static interval index,
their sorted byte offsets; bisecting it at the first and the last byte of a token of the first lists the overlapping ones. A
gap between tokens of the second that no token of the first spans is a group boundary.

Texts are cut into pre-tokens at which both tokenizers begin anew (``pretokens``), so a distinct pre-token is aligned once in
each task as long as its memo has room. Documents are gathered into chunks; a chunk keeps its documents as numbers of
pre-tokens and sends each distinct pair of ids once, with its count. Spark sums the pairs over the corpus, and a join brings
each chunk the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, squeezed, widened, written
from .pretokens import SPACE_MARK, ByteMerges, Pieces, byte_merges, pieces, pretokens, read_bytes

#: Characters of text in a chunk, and the distinct pre-tokens that a task remembers from chunk to chunk.
CHUNK_BYTES, MEMO = 4_000_000, 200_000
#: Pre-tokens that are encoded together.
GROUP = 2000

CHUNK = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "codes binary, counts binary, unit_sizes binary, unit_codes binary, doc_sizes binary, doc_units binary, doc_times binary"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: A pair as one number: the id of the second tokenizer, then that of the first.
SHIFT = 32


class IntervalIndex:
    """Tokens that cover the bytes from 0 on without gaps, known by their ends."""

    def __init__(self, ends: np.ndarray):
        self.ends = ends

    def stab(self, at: np.ndarray) -> np.ndarray:
        """The token that holds each byte."""
        return np.searchsorted(self.ends, at, "right")


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, boundary): the B tokens first..last that each A token overlaps, and for each B token whether a group
    ends with it. Both lists of sizes cover the same bytes, and no token is empty."""
    ends = np.cumsum(a_sizes)
    index = IntervalIndex(np.cumsum(b_sizes))
    first, last = index.stab(ends - a_sizes), index.stab(ends - 1)
    # gap j lies behind B token j; an A token spans the gaps first..last-1
    spans = np.bincount(first, minlength=len(b_sizes) + 1) - np.bincount(last, minlength=len(b_sizes) + 1)
    return first, last, np.cumsum(spans)[: len(b_sizes)] == 0


class _Numbers(dict):
    """Numbers of pre-tokens, given as they are met."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        k = self[unit] = len(self)
        self.new.append(unit)
        return k


class Aligner:
    """Aligned pre-tokens, each known by its number."""

    def __init__(self, a: ByteMerges, b: Pieces):
        self.a, self.b = a, b
        self.a_bytes, self.b_bytes = a.bytes_of(), b.bytes_of()
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.proved = b.proved_cuts()
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.strings: list[str | None] = []
        self.figures = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; -1 where the bytes differ
        self.codes, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def read(self, text: str | None) -> array:
        """A text as numbers of pre-tokens."""
        out = array("i")
        for units in pretokens(text) if self.proved else [[" " + text]] if text else []:
            out.extend(map(self.number.__getitem__, units))
        return out

    def _encoded(self, units: list[str]) -> tuple:
        """((ids, edges) of each tokenizer, whether its tokens' bytes are those of the pre-token), edges for those where they are.

        Pre-tokens with a space in front and neither white space nor U+2581 at the end are encoded in groups, one behind
        another, as in a text; the sizes of tokens tell them apart. The others are encoded one by one.
        """
        ids: list[list[np.ndarray]] = [[], []]
        sizes: list[list[np.ndarray]] = [[], []]
        order, same = [], []
        plain = np.array([u[0] == " " and not u[-1].isspace() and u[-1] != SPACE_MARK for u in units], bool)
        joinable = np.flatnonzero(plain)
        groups = [joinable[k : k + GROUP] for k in range(0, len(joinable), GROUP)]
        alone = [np.flatnonzero(~plain)]
        for own in groups:
            text = "".join([units[k] for k in own])
            raw = text.encode()
            ends = np.cumsum([len(units[k].encode()) for k in own])
            found = []
            for (x,), size, pieces in ((self.a.ids([text]), self.a_sizes, self.a_bytes), (self.b.ids([text]), self.b_sizes, self.b_bytes)):
                x = np.array(x, np.int64)
                at = np.cumsum(size[x])
                cut = np.searchsorted(at, ends)
                if b"".join([pieces[i] for i in x.tolist()]) == raw and (at[cut] == ends).all():
                    found.append((x, np.diff(cut + 1, prepend=0)))
            if len(found) < 2:
                alone.append(own)
                continue
            order.append(own)
            same.append(np.ones(len(own), bool))
            for side, (x, n) in enumerate(found):
                ids[side].append(x)
                sizes[side].append(n)
        rest = np.concatenate(alone)
        own = [units[k] for k in rest]
        pairs = [*zip(self.a.ids(own), self.b.ids(own), strict=True)]
        ok = np.array([u.encode() == b"".join([self.a_bytes[i] for i in x]) == b"".join([self.b_bytes[i] for i in y]) for u, (x, y) in zip(own, pairs, strict=True)], bool)
        order.append(rest)
        same.append(ok)
        for side in (0, 1):
            good = [p[side] for p, k in zip(pairs, ok.tolist(), strict=True) if k]
            ids[side].append(np.array([i for x in good for i in x], np.int64))
            sizes[side].append(np.array([len(x) for x in good], np.int64))
        # back to the order of the pre-tokens
        where, flags = np.concatenate(order), np.concatenate(same)
        turn = np.argsort(where[flags], kind="stable")
        out = []
        for side in (0, 1):
            flat, n = np.concatenate(ids[side]), np.concatenate(sizes[side])
            begin = (np.cumsum(n) - n)[turn]
            n = n[turn]
            edges = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            out.append((flat[np.arange(edges[-1]) + np.repeat(begin - edges[:-1], n)], edges))
        kept = np.zeros(len(units), bool)
        kept[where] = flags
        return *out, kept

    def learn(self) -> None:
        """Aligns the pre-tokens met since the last call."""
        units = self.number.new
        self.number.new = []
        if not units:
            return
        (a, a_edges), (b, b_edges), same = self._encoded(units)
        first, last, boundary = overlaps(self.a_sizes[a], self.b_sizes[b])
        n_links = last - first + 1
        begins = np.cumsum(n_links) - n_links
        links = np.arange(int(n_links.sum())) + np.repeat(first - begins, n_links)
        codes = (b[links] << SHIFT) | np.repeat(a, n_links)
        group = np.cumsum(boundary) - boundary  # of each B token
        link_edges = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int64)[a_edges]
        n_groups = np.concatenate([[0], np.cumsum(boundary)]).astype(np.int64)[b_edges]

        figures = np.full((len(units), 4), -1, np.int64)
        figures[same] = np.stack([np.diff(x) for x in (a_edges, b_edges, n_groups, link_edges)], 1)
        sizes = np.zeros(len(units), np.int64)
        sizes[same] = np.diff(link_edges)
        self.figures = np.concatenate([self.figures, figures])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.codes = np.concatenate([self.codes, codes])

        text_a, text_b = [*map(str, a.tolist())], [*map(str, b.tolist())]
        group_a, ends = group[first] if len(a) else group[:0], int(boundary.sum())
        cut_a = np.searchsorted(group_a, np.arange(ends + 1)).tolist()
        cut_b = np.searchsorted(group, np.arange(ends + 1)).tolist()
        groups = [",".join(text_a[cut_a[g] : cut_a[g + 1]]) + "|" + ",".join(text_b[cut_b[g] : cut_b[g + 1]]) for g in range(ends)]
        bounds, k = n_groups.tolist(), 0
        for ok in same.tolist():
            self.strings.append(";".join(groups[bounds[k] : bounds[k + 1]]) if ok else None)
            k += ok

    def digest(self, numbers: np.ndarray) -> str:
        """The digest of a text's groups, made in steps."""
        h = hashlib.sha256()
        for k in range(0, len(numbers), 100_000):
            h.update((";" * (k > 0) + ";".join(map(self.strings.__getitem__, numbers[k : k + 100_000].tolist()))).encode())
        return h.hexdigest()

    def chunk(self, number: int, doc_ids: list[int | None], texts: list[array]) -> tuple:
        """A row of ``CHUNK`` for these documents."""
        self.learn()
        docs = [np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in texts]
        docs = [x if (self.figures[x, 0] >= 0).all() else x[:0] for x in docs]
        totals = [self.figures[x].sum(0).tolist() for x in docs]
        shas = [self.digest(x) if len(x) else "" for x in docs]
        each = [np.unique(x, return_counts=True) for x in docs]
        used, times = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in each)]) for i in (0, 1))
        units, back = np.unique(used, return_inverse=True)
        units = units.astype(np.int64)
        sizes = self.at[units + 1] - self.at[units]
        links = np.arange(int(sizes.sum())) + np.repeat(self.at[units] - (np.cumsum(sizes) - sizes), sizes)
        codes, own = np.unique(self.codes[links], return_inverse=True)
        weight = np.bincount(back, times, len(units)).astype(np.int64)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, own, np.repeat(weight, sizes))
        packed = (codes, counts, sizes.astype(np.int32), own.astype(np.int32), np.array([len(u) for u, _ in each], np.int32), back.astype(np.int32), times.astype(np.int32))
        if len(self.number) > MEMO or len(self.codes) > 20 * MEMO:
            self.forget()
        return number, doc_ids, *([t[i] for t in totals] for i in range(4)), shas, *map(squeezed, packed)


def _chunks(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast((read_bytes(a_path), read_bytes(b_path)))  # the vocabularies
    fields = [f.strip().rsplit(" ", 1) if "<" not in f else f.strip().split(" ", 1) for f in CHUNK.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        aligner = Aligner(byte_merges(a), pieces(b))
        number = TaskContext.get().partitionId() << 32
        doc_ids, texts, size = [], [], 0

        def close():
            row = aligner.chunk(number, doc_ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                doc_ids.append(doc_id)
                texts.append(aligner.read(text))
                size += len(text or "") + 64
                if size > CHUNK_BYTES:
                    yield close()
                    number, doc_ids, texts, size = number + 1, [], [], 0
        if doc_ids:
            yield close()

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, CHUNK)


def _pairs(chunks: DataFrame) -> DataFrame:
    """chunk, code, n: the distinct pairs of each chunk with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            code, n = (widened(b.column(c)[0].as_py(), np.int64) for c in ("codes", "counts"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), b.column("chunk")[0].as_py())), pa.array(code), pa.array(n)], names=["chunk", "code", "n"])

    return chunks.select("chunk", "codes", "counts").mapInArrow(run, "chunk long, code long, n long")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """code, count, best: how many links hold each pair of ids, and whether no pair of its B id has more."""
    total = _pairs(chunks).groupBy("code").agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("code", SHIFT)))  # as many rows as the first vocabulary at most
    return total.select("code", "count", (F.col("count") == most).alias("best"))


def align(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``RESULT`` for each row: tokens of both tokenizers, groups, links, and what the corpus says of the links.

    ``a_path`` is a byte-level merge vocabulary, ``b_path`` a piece model. Texts that are null, empty, or whose tokens' bytes
    differ from the text with a space in front (as with U+2581, which the piece model reads as a space) have no tokens: all
    figures are 0 and the digest is ''; they add nothing to the counts of pairs. Rows stay one for one, repeated rows and null
    doc_id included; an empty table gives an empty result; other columns are not read.
    """
    chunks = written(_chunks(documents, a_path, b_path), "alignment")
    known = _pairs(chunks).drop("n").join(pair_counts(chunks), "code")

    def run(key, left, right):
        found = left.to_pylist()
        if not found:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        row = found[0]
        at, count, best = (right.column(c).to_numpy() for c in ("code", "count", "best"))
        order = np.argsort(at)
        sizes, own, doc_sizes, units, times = (widened(row[c], np.int32) for c in ("unit_sizes", "unit_codes", "doc_sizes", "doc_units", "doc_times"))
        sums = []
        for value in (best[order].astype(np.int64), count[order]):
            unit = np.concatenate([[0], np.cumsum(value[own])]).astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            each = (unit[edge[1:]] - unit[edge[:-1]])[units] * times
            total, edge = np.concatenate([[0], np.cumsum(each)]).astype(np.int64), np.concatenate([[0], np.cumsum(doc_sizes)])
            sums.append(total[edge[1:]] - total[edge[:-1]])
        columns = [row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [*sums, row["groups_sha256"]]
        return pa.table({n: pa.array(x, k) for n, x, k in zip(names, columns, kinds, strict=True)})

    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    return chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, RESULT)
