"""Benchmark decontamination with one Aho-Corasick automaton over words.

The test items are normalised to words and cut into windows of ten words. All windows form one automaton over numbers of
words, which one task builds and writes to the shared folder; a worker process loads it once, and each document is
normalised and scanned once. Hits come back as word numbers and as byte offsets of the original text. Neither the test set
nor the automaton passes through the driver. What bounds it is the test set: about 750 bytes a window in each process.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, sliced

WINDOW = 10

#: Bytes that belong to words once A-Z is lower-cased: 0-9, a-z and all bytes of non-ASCII characters.
_FOLD = bytearray(b" " * 256)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _FOLD[_b] = _b
for _b in range(0x41, 0x5B):
    _FOLD[_b] = _b + 32
FOLD = bytes(_FOLD)
INSIDE = np.frombuffer(FOLD, np.uint8) != 32


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The windows of an item: every ``size`` consecutive words; one window of all words if there are fewer."""
    w = item_words(text)
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))] if w else []


def window_table(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per distinct window: ``window`` and the sorted distinct ``items`` (ids as strings) that hold it.

    Null texts have no windows. An item with a null id still marks words, but is not listed.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, i) for i, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True) for w in windows(t, size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["window", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).mapInArrow(cut, "window binary, item string")
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Numbers(dict):
    """The number of each benchmark word; 0 for any other word."""

    def __missing__(self, word: bytes) -> int:
        return 0


def _build(found: Iterator[tuple[bytes, list[str]]]) -> tuple[Numbers, object, list[list[str]]]:
    """(word numbers, automaton, items of each window) of all windows; the automaton gives (window, words)."""
    numbers, automaton, items = Numbers(), ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), []
    for window, ids in found:
        words = window.split()
        automaton.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in words), (len(items), len(words)))
        items.append(ids)
    if items:
        automaton.make_automaton()
    return numbers, automaton, items


def automaton_file(windows: DataFrame) -> str | None:
    """The path of the automaton of all rows of ``window_table``, in the shared folder; None without windows.

    One task builds it. The path is that of the attempt which Spark accepted.
    """
    folder = scratch(windows.sparkSession, "automaton")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((w, i) for b in batches for w, i in zip(b.column("window").to_pylist(), b.column("items").to_pylist(), strict=True))
        built = _build(rows)
        if built[2]:
            fs, root = pafs.FileSystem.from_uri(folder)
            fs.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.pickle"
            with fs.open_output_stream(f"{root}/{name}") as out:
                pickle.dump(built, out, protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    made = windows.repartition(1).mapInArrow(build, "path string").collect()
    return made[0]["path"] if made else None


_LOADED: dict[str, tuple] = {}


def _loaded(path: str | None) -> tuple:
    """The automaton of this path, read once per worker process."""
    if path is None:
        return _build(iter(()))
    if path not in _LOADED:
        _LOADED.clear()
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(name, buffer_size=1 << 20) as f:
            _LOADED[path] = pickle.load(f)
    return _LOADED[path]


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:long,end:long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def mark(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``documents`` with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans.

    ``hit_spans`` holds the maximal runs of hit words as (start, end) byte offsets of the original UTF-8 text. Empty and
    null texts have no words and no hits; rows stay one for one, repeated rows included, and columns of the input that
    have one of these names are replaced. The scan is narrow: it needs no shuffle and no state, and a lost task is redone.
    """
    path = automaton_file(window_table(benchmark, size))
    added = T.StructType.fromDDL(RESULT)
    rows = documents.drop(*added.names)
    passed = rows.schema.fields
    schema = T.StructType(passed + added.fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, automaton, items = _loaded(path)
        for b in sliced(batches):
            made = []
            for text in b.column("text"):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.translate(FOLD).split()
                got = list(automaton.iter(tuple(map(numbers.__getitem__, words)))) if items and words else []
                hit = sorted({k for end, (_, n) in got for k in range(end - n + 1, end + 1)})
                ids = sorted({x for _, (w, _) in got for x in items[w]})
                made.append((len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit), [{"start": s, "end": e} for s, e in _spans(raw, hit)] if hit else []))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), SPANS)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in passed), *(pa.array([m[i] for m in made], t) for i, t in enumerate(kinds))], names=schema.names)

    return rows.mapInArrow(scan, schema)


def _spans(raw: bytes, hit: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of hit words, as byte offsets of the original text."""
    inside = np.concatenate([[False], INSIDE[np.frombuffer(raw, np.uint8)], [False]]).astype(np.int8)
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    word = np.asarray(hit)
    cut = np.flatnonzero(np.diff(word) > 1)
    first, last = word[np.concatenate([[0], cut + 1])], word[np.concatenate([cut, [len(word) - 1]])]
    return [(int(start[a]), int(end[b])) for a, b in zip(first, last, strict=True)]


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the rows that any window occurs in; all columns of the input stay as they are."""
    named = [F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(documents.columns)]
    marked = mark(documents.select(*named, F.col("text").cast("string").alias("text")), benchmark.select("item_id", "text"))
    return marked.where(~F.col("contaminated")).select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(documents.columns)])
