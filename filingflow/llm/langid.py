"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are pairs and triples of UTF-8 bytes with ASCII letters lower-cased and other ASCII bytes as one gap; a gap stands
before and behind each text, so that a single letter has subwords too. The model is trained by stochastic gradient descent in
numpy on a bounded sample of labelled documents; prediction is a narrow stage over all documents. As both layers are linear,
a worker folds them into one table of a row per bucket. A prediction depends on its own text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_text

BUCKETS, WIDTH = 8192, 16
#: About so many labelled documents are sampled by a hash of doc_id and text, and of a rarer language about so many of its
#: own; a fifth of them calibrates.
TRAIN_DOCUMENTS, TRAIN_OF_EACH = 3000, 200
#: Values of lang that are learned at most, the most frequent ones.
MOST_LANGUAGES = 512
EPOCHS, BATCH, STEP = 15, 32, 0.5
#: Share of calibration documents whose score lies above the rejection threshold.
ACCEPT = 0.995

_FOLD = np.full(256, 32, np.uint64)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")


def padded(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a gap before and behind each document, and the documents' offsets in them."""
    size, n = np.diff(offsets), len(offsets) - 1
    out = np.full(len(flat) + 2 * n, 32, np.uint8)
    out[np.arange(len(flat)) + np.repeat(2 * np.arange(n) + 1, size)] = flat
    return out, offsets + 2 * np.arange(n + 1)


def buckets(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the pair and of the triple that begin at each byte (shorter by one and by two than the bytes)."""
    x = _FOLD[flat]
    pair = x[:-1] * np.uint64(257) + x[1:]
    triple = pair[:-1] * np.uint64(257) + x[2:] + np.uint64(1 << 30)
    return tuple(((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).astype(np.int64) for k in (pair, triple))


def _bags(samples: DataFrame) -> pa.Table:
    """label, buckets, shares: the sparse average of each sampled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, j, flat, offsets in blocks(b):
                flat, offsets = padded(flat, offsets)
                for k in range(i, j):
                    own = flat[offsets[k - i] : offsets[k - i + 1]]
                    if len(own) > 2:
                        seen, times = np.unique(np.concatenate(buckets(own)), return_counts=True)
                        rows.append((b.column("lang")[k].as_py(), seen.astype(np.int32).tobytes(), (times / times.sum()).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2))], names=["label", "buckets", "shares"])

    return samples.select("lang", "text").mapInArrow(run, "label string, buckets binary, shares binary").toArrow()


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float


def train(bags: pa.Table, seed: int = 3) -> Model:
    """Embeddings and softmax by SGD; a held-back fifth sets the temperature and the rejection threshold."""
    labels = bags.column("label").to_pylist()
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    x = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(bags.column("buckets").to_pylist(), bags.column("shares").to_pylist(), strict=True)]
    order = np.array(sorted(range(len(y)), key=lambda k: (labels[k], x[k][0].tobytes(), x[k][1].tobytes())))  # the order of rows must not matter
    rng.shuffle(order)
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    e = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    w = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    grown_e, grown_w = np.full(BUCKETS, 1e-8, np.float32), np.float32(1e-8)

    def dense(rows):
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for k, r in enumerate(rows):
            out[k, x[r][0]] = x[r][1]
        return out

    for _ in range(EPOCHS):
        rng.shuffle(used)
        for k in range(0, len(used), BATCH):
            rows = used[k : k + BATCH]
            d = dense(rows)
            hidden = d @ e
            p = _softmax(hidden @ w + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            ge, gw = d.T @ (p @ w.T), hidden.T @ p
            grown_e += (ge * ge).sum(1)
            grown_w += (gw * gw).sum()
            e -= STEP * ge / np.sqrt(grown_e)[:, None]
            w -= STEP * gw / np.sqrt(grown_w)
            bias -= STEP * 0.1 * p.sum(0)
    if not len(held):
        held = used
    logits = np.concatenate([dense(held[k : k + 256]) @ e @ w + bias for k in range(0, len(held), 256)]) if len(held) else np.zeros((0, len(languages)))
    losses = [(-np.log(_softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() if len(held) else 0, t) for t in np.geomspace(0.2, 5, 41)]
    temperature = min(losses)[1] if losses else 1.0
    top = _softmax(logits / temperature).max(1) if len(held) else np.zeros(1)
    return Model(languages, (e @ w).astype(np.float32), bias, float(temperature), float(np.quantile(top, 1 - ACCEPT)))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True)) if x.size else x
    return x / x.sum(1, keepdims=True)


def fit(documents: DataFrame, size: int = TRAIN_DOCUMENTS, each: int = TRAIN_OF_EACH) -> Model | None:
    """A model of the labelled rows of ``documents``, or None without any; about ``size`` of them are used, and of a language
    that would have fewer than ``each`` among these, about so many of its own. Rows that repeat in full count once. The
    ``MOST_LANGUAGES`` most frequent values of lang are learned, so that a dirty column does not make the model without end."""
    labelled = documents.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    key = F.xxhash64("doc_id", "text", F.lit("sample"))
    each_once = labelled.select("lang", key.alias("key")).distinct()  # rows that repeat in full count once
    counts = {r["lang"]: r["count"] for r in each_once.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, max(size / sum(counts.values()), each / n)))])
    drawn = labelled.where(F.pmod(key, F.lit(1_000_003)) / F.lit(1_000_003.0) < share[F.col("lang")])
    bags = _bags(drawn.dropDuplicates(["doc_id", "lang", "text"]))
    return train(bags) if bags.num_rows else None


PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for rows (doc_id, held_out, text), in one narrow stage.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; so is everything without a model. Other
    texts get a learned language; ``rejected`` marks scores below the calibrated threshold.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for i, j, flat, offsets in blocks(b):
                best, top = [None] * (j - i), np.zeros(j - i)
                if model:
                    flat, offsets = padded(flat, offsets)
                    n = 2 * np.diff(offsets) - 3
                    pair, triple = buckets(flat)
                    logits = np.empty((j - i, len(model.languages)))
                    for k in range(logits.shape[1]):
                        column = np.ascontiguousarray(model.table[:, k])
                        logits[:, k] = (_spans(column[pair], offsets, 1) + _spans(column[triple], offsets, 2)) / n + model.bias[k]
                    p = _softmax(logits / model.temperature)
                    best, top = [model.languages[k] for k in p.argmax(1)], p.max(1)
                letter = [_LETTER.search(x) is not None if x else False for x in b.column("text")[i:j].to_pylist()]
                known = [x is not None and y for x, y in zip(best, letter, strict=True)]
                score = np.where(known, top, 0.0)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id")[i:j], b.column("held_out")[i:j], pa.array([x if y else "und" for x, y in zip(best, known, strict=True)], pa.string()),
                    pa.array(score), pa.array(~np.array(known, bool) | (score < (model.threshold if model else 1))),
                ], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return documents.mapInArrow(run, PREDICTIONS)


def _spans(values: np.ndarray, offsets: np.ndarray, less: int) -> np.ndarray:
    """Sums over each document's own subwords: those that begin more than ``less`` bytes before its end.

    A document has two bytes at least, its gaps; its sum does not depend on what stands beside it.
    """
    own = np.zeros(offsets[-1])
    own[: len(values)] = values
    for k in range(1, less + 1):
        own[offsets[1:] - k] = 0
    return np.add.reduceat(own, offsets[:-1])


def identify(documents: DataFrame) -> DataFrame:
    """The predictions for every row of ``documents`` (doc_id, text, lang).

    Documents whose crc32(doc_id as text) leaves 2 when divided by 4 are held out; a null doc_id is not. Repeated rows are
    predicted each, an empty table gives an empty result, and other columns are not read.
    """
    held = F.coalesce(F.pmod(crc_text("doc_id"), F.lit(4)) == 2, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), held.alias("held_out"))
    model = fit(rows.where("not held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), model)
