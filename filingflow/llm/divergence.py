"""Audit of sources: how far the word frequencies of each source of a language lie from those of every other source.

1. Tasks count terms by group, a (lang, source), and the documents that have them; Spark sums both. Terms that enough
   documents of a language have are kept, dealt over slices of a bounded number of terms, and numbered within their slice.
2. A group's counts in one slice are a compressed vector. The groups of a language are dealt over blocks of a bounded number.
   The vectors of a block stay in one partition, for each slice, while those of the other blocks pass by: a round-robin
   tournament says which block meets which in which round, and which of the two is the host, so that each pair of blocks
   meets once. A partition sorts what it has been sent by round and reads it as a stream, so it holds its residents and one
   vector at a time.
3. A meeting evaluates both directions. It starts from what the terms that neither has add, which needs no loop, and corrects
   that for the terms that either has; sums over slices are exact, as all values are integers.
4. A vector of the whole language passes every resident too; a heap keeps each resident's highest terms in that slice, and
   those few rows are ranked over all slices.

No vector, group or vocabulary is ever held whole, and nothing is collected.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, squeezed, widened, written

#: Documents of a language that a kept term is in, and ranks of the part ``term``.
LEAST_DOCUMENTS, TOP = 10, 10
#: Terms in a slice and groups in a block, on average.
SLICE_TERMS, BLOCK_GROUPS = 16_384, 8
#: Parts of a language's terms where they meet what is known of the language.
SALTS = 64
#: Added to each count, and what all shares of a group add up to.
PRIOR, SCALE = 2, 1_000_000_000
#: Distinct terms that a task counts before it sends them on, and bytes of a text that it splits at a time.
TERMS, SLICE_BYTES = 200_000, 1_000_000

#: A-Z to a-z; a-z and all bytes of letters beyond ASCII stay; the others are gaps.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

MEETING = "part string, lang string, source string, item string, slice int, idx int, value long"
VECTOR = "lang string, source string, slice int, data binary"
#: Rounds of what is no guest: the language itself comes first, then the residents.
LANGUAGE, RESIDENT = -2, -1


# --- counting ---------------------------------------------------------------------------------------------------------


def _terms(raw: bytes) -> Iterator[list[bytes]]:
    at = 0
    folded = raw.translate(FOLD)
    while len(folded) - at > SLICE_BYTES and (end := folded.find(b" ", at + SLICE_BYTES)) >= 0:
        yield folded[at:end].split()
        at = end
    yield folded[at:].split() if at else folded.split()


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often a term stands in a group and in how many rows; each group has a row without term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush():
            keys = [k for k, (n, _) in held.items() for _ in range(len(n) + 1)]
            terms = [t for n, _ in held.values() for t in (None, *n)]
            counts = [v for n, _ in held.values() for v in (0, *n.values())]
            docs = [v for n, d in held.values() for v in (0, *(d[t] for t in n))]
            held.clear()
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)]
            columns += [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        size = 0
        for b in sliced(batches):
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                seen = set()
                for terms in _terms(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                size += len(n)
                if size > TERMS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, n, slice, slices, idx: the terms that enough documents of a language have, numbered within their slice."""
    rows = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    rows = written(rows, "divergence-terms")
    slices = rows.groupBy("lang").agg(F.ceil(F.count("*") / SLICE_TERMS).cast("int").alias("slices"))
    # salted, as one language can have most terms
    slices = slices.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(slices, ["lang", "salt"]).drop("salt")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("term", F.lit("slice")), "slices").cast("int")).repartition("lang", "slice")
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1)


# --- vectors and their way --------------------------------------------------------------------------------------------


def partner(block: Column, blocks: Column, turn: Column) -> Column:
    """Whom a block meets in a turn of the round-robin tournament; with an odd number of blocks one rests each time, which
    shows as a partner that is none of them. One place is fixed and the others rotate."""
    even = blocks + blocks % 2
    opposite = F.pmod(turn - block, even - 1)
    moving = F.when(opposite == block, even - 1).otherwise(opposite)
    fixed = F.pmod(turn.cast("long") * (even / 2).cast("long"), even - 1)
    return F.when(block == even - 1, fixed).otherwise(moving).cast("int")


def _packed(key, table):
    idx, n = (table.column(c).to_numpy() for c in ("idx", "n"))
    order = np.argsort(idx)
    data = squeezed(np.diff(idx[order].astype(np.int64), prepend=0)), squeezed(n[order].astype(np.int64))
    blob = len(data[0]).to_bytes(4, "little") + data[0] + data[1]
    return pa.table({"lang": [key[0].as_py()], "source": pa.array([key[1].as_py()], pa.string()), "slice": pa.array([key[2].as_py()], pa.int32()), "data": [blob]})


def _unpacked(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if data is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = 4 + int.from_bytes(data[:4], "little")
    return np.cumsum(widened(data[4:cut], np.int64)), widened(data[cut:], np.int64)


def visits(counts: DataFrame, kept: DataFrame, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """lang, slice, block, turn, source, total, vocabulary, data: which vector is in which block, as a resident or a guest.

    Every group has a row for each slice of its language, also where it has none of its terms. A null source is the language.
    """
    sizes = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("total"), F.max("slices").alias("slices"))
    groups = counts.select("lang", "source").distinct()
    own = counts.select("lang", "source", "term", F.col("n").alias("own")).where("term IS NOT NULL").join(kept.drop("n"), ["lang", "term"])
    own = written(own.select("lang", "source", "slice", "idx", F.col("own").alias("n")), "divergence-counts")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block_groups).cast("int").alias("blocks"))
    groups = groups.join(totals, ["lang", "source"], "left").join(blocks, "lang").join(sizes.select("lang", "vocabulary", "slices"), "lang", "left")
    groups = groups.na.fill(0, ["total", "vocabulary"]).na.fill(1, ["slices"])
    cells = groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    whole = kept.select("lang", F.lit(None).cast("string").alias("source"), "slice", "idx", "n")
    vectors = written(own.unionByName(whole).groupBy("lang", "source", "slice").applyInArrow(_packed, VECTOR), "divergence-vectors")
    cells = cells.join(vectors.where("source IS NOT NULL"), ["lang", "source", "slice"], "left")

    turns = F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") + F.col("blocks") % 2 - 2)).otherwise(F.array().cast("array<int>"))
    guests = cells.withColumn("turn", F.explode(turns)).withColumn("other", partner(F.col("block"), F.col("blocks"), F.col("turn"))).where("other < blocks")
    host = F.when((F.col("block") + F.col("other")) % 2 == 0, F.least("block", "other")).otherwise(F.greatest("block", "other"))
    guests = guests.where(host == F.col("other")).withColumn("block", F.col("other"))
    language = vectors.where("source IS NULL").drop("source").join(sizes.select("lang", "total", "vocabulary"), "lang")
    language = language.join(cells.select("lang", "slice", "block").distinct(), ["lang", "slice"])
    names = ["lang", "slice", "block", "turn", "source", "total", "vocabulary", "data"]
    return (
        guests.select(names)
        .unionByName(cells.withColumn("turn", F.lit(RESIDENT)).select(names))
        .unionByName(language.withColumn("turn", F.lit(LANGUAGE)).withColumn("source", F.lit(None).cast("string")).select(names))
    )


# --- meetings ---------------------------------------------------------------------------------------------------------


def share(n: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * vocabulary)), exact for totals up to 10**14: long division in two steps."""
    whole = total + PRIOR * vocabulary
    if not whole:
        return np.ones(len(n), np.int64)
    high, rest = np.divmod((n + PRIOR) * 31_250, whole)
    return 1 + 32_000 * high + 32_000 * rest // whole


def gap(p, q):
    """floor((p - q)**2 / (p + q)): the value of one term, the same in both directions."""
    return (p - q) ** 2 // (p + q)


class Vector:
    """The shares of a group in one slice: ``p`` at ``idx``, ``zero`` elsewhere."""

    def __init__(self, source: str | None, total: int, vocabulary: int, data: bytes | None):
        self.source, self.vocabulary = source, vocabulary
        self.idx, self.n = _unpacked(data)
        self.p, self.zero = share(self.n, total, vocabulary), int(share(np.zeros(1, np.int64), total, vocabulary)[0])


class Residents:
    """The vectors of a block in one slice, which guests pass by."""

    def __init__(self, vectors: list[Vector], width: int, first_slice: bool):
        self.vectors, self.first_slice = vectors, first_slice
        self.zero = np.array([v.zero for v in vectors], np.int64)
        self.table = np.repeat(self.zero[:, None], width, 1)
        for row, v in zip(self.table, vectors, strict=True):
            row[v.idx] = v.p
        self.flat = np.concatenate([np.zeros(0, np.int64), *(v.p for v in vectors)])
        self.edges = np.concatenate([[0], np.cumsum([len(v.p) for v in vectors])]).astype(np.int64)

    def values(self, guest: Vector, first: int = 0) -> np.ndarray:
        """The summed values of this slice between the guest and each resident from ``first`` on."""
        zero, lengths = self.zero[first:], np.diff(self.edges)[first:]
        none = gap(zero, guest.zero)  # of a term that neither has
        own = np.concatenate([[0], np.cumsum(gap(self.flat[self.edges[first] :], guest.zero) - np.repeat(none, lengths))])
        at = self.edges[first:] - self.edges[first]
        met = self.table[first:, guest.idx]
        both = (gap(met, guest.p) - gap(met, guest.zero)).sum(1)
        return none * (guest.vocabulary if self.first_slice else 0) + own[at[1:]] - own[at[:-1]] + both

    def among(self) -> Iterator[tuple[str, str, int]]:
        for k, guest in enumerate(self.vectors):
            yield from self.meet(guest, k + 1)

    def meet(self, guest: Vector, first: int = 0) -> Iterator[tuple[str, str, int]]:
        """(source, other source, value) in both directions."""
        for v, value in zip(self.vectors[first:], self.values(guest, first).tolist(), strict=True):
            yield v.source, guest.source, value
            yield guest.source, v.source, value

    def highest(self, language: Vector, top: int) -> Iterator[tuple[str, int, int]]:
        """(source, term, value): the terms a resident has more than the language, the highest values, earlier terms first."""
        q = np.zeros(self.table.shape[1], np.int64)
        q[language.idx] = language.p
        for v in self.vectors:
            more = (v.p > q[v.idx]) & (v.n > 0)
            values = gap(v.p[more], q[v.idx[more]])
            for value, idx in heapq.nsmallest(top, zip((-values).tolist(), v.idx[more].tolist(), strict=True)):
                yield v.source, idx, -value


def _rows(kind: str, cell: tuple, found: Iterator[tuple]) -> pa.RecordBatch:
    lang, part = cell[0], cell[1]
    source, other, value = ([*x] for x in zip(*found, strict=True)) if (found := [*found]) else ([], [], [])
    n = len(source)
    pair = kind == "pair"
    columns = [
        pa.array([kind] * n, pa.string()), pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array(other if pair else [None] * n, pa.string()),
        pa.array([part] * n, pa.int32()), pa.array([None] * n if pair else other, pa.int32()), pa.array(value, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in MEETING.split(", ")])


def meetings(visits: DataFrame, top: int = TOP) -> DataFrame:
    """``MEETING``: for each slice what two groups of a language add to their values, and each group's highest terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, language, waiting, residents = None, None, [], None

        def settle():
            """The residents are complete: they meet each other and the language."""
            settled = Residents(waiting, len(language.idx) if language else 0, cell[1] == 0)
            found = [_rows("pair", cell, settled.among())]
            if language:
                found.append(_rows("term", cell, settled.highest(language, top)))
            return settled, found

        for b in sliced(batches, 50):
            for r in b.to_pylist():
                if cell != (own := (r["lang"], r["slice"], r["block"])):
                    if waiting and residents is None:
                        yield from settle()[1]
                    cell, language, waiting, residents = own, None, [], None
                vector = Vector(r["source"], r["total"], r["vocabulary"], r["data"])
                if r["turn"] == LANGUAGE:
                    language = vector
                elif r["turn"] == RESIDENT:
                    waiting.append(vector)
                elif waiting:
                    if residents is None:
                        residents, found = settle()
                        yield from found
                    yield _rows("pair", cell, residents.meet(vector))
        if waiting and residents is None:
            yield from settle()[1]

    dealt = visits.repartition("lang", "slice", "block").sortWithinPartitions("lang", "slice", "block", "turn", "source")
    return dealt.mapInArrow(run, MEETING)


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair`` has a row for each other source of the group's language, all ranks; part ``term`` the ``top`` kept terms
    that the group has with a greater share than its language. Null text, lang and source are ''. A group without terms has
    all its pairs; a language without kept terms has pairs of value 0. Repeated rows count as documents of their own; an empty
    table gives an empty result; other columns are not read.
    """
    counts = written(term_counts(documents), "divergence-groups")
    kept = written(kept_terms(counts, least), "divergence-kept")
    met = written(meetings(visits(counts, kept, block_groups), top), "divergence-meetings")
    pairs = met.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = met.where("part = 'term'").drop("item").join(kept.select("lang", "slice", "idx", F.col("term").alias("item")), ["lang", "slice", "idx"])
    rows = pairs.unionByName(terms.select("lang", "source", "part", "item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
