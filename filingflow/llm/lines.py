"""Substring removal by hashing lines and sentences: keep the earliest occurrence in the corpus, remove the others.

A task cuts texts into units: a line or sentence (it ends after a run of ``.``, ``!``, ``?`` and line breaks) of ``UNIT_WORDS``
words or more with the shorter ones behind it. It normalises them and sends a 128-bit digest with the unit's number. Digests
are grouped over all documents with partial aggregates, so a very common unit costs each task one row; the places, written
once, are joined to the earliest one as a shuffle join, whose hot digests Spark may split. A repeated unit alone proves
little (sentences such as boilerplate recur in clean documents), so only runs of consecutive repeated units with
``RUN_WORDS`` words or more count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, sliced, written

#: Words of a line or sentence that begins a unit, and of a run of consecutive repeated units; shorter runs stay.
UNIT_WORDS, RUN_WORDS = 5, 20

PIECE = re.compile(rb"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_FOLD = LOWER.tobytes()

UNITS = "uid long, doc_id long, place int, high long, low long"


def units_of(raw: bytes) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, words) of each unit, in order: A-Z in lower case, white space between words is not kept.

    Short lines and sentences before the first long one are a unit of their own; all bytes of a text with a word belong to
    a unit but for signs and white space in front.
    """
    start = end = 0
    words: list[bytes] = []
    for m in PIECE.finditer(raw.translate(_FOLD)):
        own = m.group().split()
        if len(own) >= UNIT_WORDS and words:
            yield start, end, words
            words = []
        if own and not words:
            start = m.start()
        words += own
        end = m.end()
    if words:
        yield start, end, words


def units(documents: DataFrame) -> DataFrame:
    """One row per unit: its digest and its number in the document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in UNITS.split(", ")]
        kinds = [pa.int32() if x.endswith("int") else pa.int64() for x in UNITS.split(", ")]
        for b in sliced(batches):
            rows = []
            for uid, doc_id, text in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for place, (_, _, words) in enumerate(units_of(raw)):
                    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                    rows.append((uid, doc_id, place, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return documents.mapInArrow(cut, UNITS)


def repeats(documents: DataFrame) -> DataFrame:
    """uid, places, later: the numbers of the repeated units of each row that has any, and those of later occurrences.

    Occurrences rank by (doc_id, row, number), a null doc_id last: of rows that are equal in full one ranks first too.
    """
    rows = written(units(documents), "units")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid", "place")
    first = rows.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    first = first.select(F.col("high").alias("_h"), F.col("low").alias("_l"), F.col("first.uid").alias("_u"), F.col("first.place").alias("_p"))
    met = rows.drop("doc_id").join(written(first, "first-units"), (F.col("high") == F.col("_h")) & (F.col("low") == F.col("_l")))
    later = (F.col("uid") != F.col("_u")) | (F.col("place") != F.col("_p"))
    return met.groupBy("uid").agg(F.collect_list("place").alias("places"), F.collect_list(F.when(later, F.col("place"))).alias("later"))


def runs(found: list[tuple[int, int, int]], marked: set[int], least: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of consecutive marked units, of (start, end, words) each, with enough words."""
    out, first, words = [], None, 0
    for k in range(len(found) + 1):
        if k in marked:
            first, words = k if first is None else first, words + found[k][2]
        elif first is not None:
            if words >= least:
                out.append((found[first][0], found[k - 1][1]))
            first, words = None, 0
    return out


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept_text string"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def dedupe_lines(documents: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_repeated, spans, kept_sha256, kept_text for each row of ``documents``.

    Spans are byte offsets of the original text; a removed unit takes its closing signs with it. ``n_repeated`` counts the
    bytes of all such runs of repeated units, those of the kept earliest occurrences included. Null texts are empty; empty
    texts and tables stay as they are; of rows equal in full one is the earliest; other columns are not read.
    """
    text = F.col("text").cast("string")
    # numbered and written once, so that a row has the same number whichever task reads it again
    rows = written(documents.select(F.col("doc_id").cast("long"), text.alias("text"), F.monotonically_increasing_id().alias("uid")), "texts")
    marks = repeats(rows).withColumnRenamed("uid", "_u")
    joined = rows.join(marks, F.col("uid") == F.col("_u"), "left").select("doc_id", "text", "places", "later")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for doc_id, text, places, later in zip(*(b.column(c) for c in ("doc_id", "text", "places", "later")), strict=True):
                raw, kept, at = text.as_buffer().to_pybytes() if text.is_valid else b"", [], 0
                found = [(start, end, len(words)) for start, end, words in units_of(raw)] if places.is_valid else []
                spans = runs(found, set(later.as_py() or ()), run_words)
                for start, end in spans:
                    kept.append(raw[at:start])
                    at = end
                kept = b"".join([*kept, raw[at:]])
                again = sum(end - start for start, end in runs(found, set(places.as_py() or ()), run_words))
                out.append((doc_id.as_py(), len(raw), len(raw) - len(kept), len(spans), again, [{"start": s, "end": e} for s, e in spans], hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), SPANS, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in REPORT.split(", ")])

    return joined.mapInArrow(cut, REPORT)
