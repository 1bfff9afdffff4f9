"""Mixing to target weights with soft domain membership.

A softmax over hashed words, fitted on a bounded sample of the labelled table, gives each document a posterior over the
domains. Nonnegative rates then make the expected tokens of each domain meet its target: projected gradient descent on the
squared residual, scaled by the Gram matrix of the posteriors whose rates are above zero. A step needs the expected tokens of
each domain only, one small Spark aggregate; a document's rate follows from its posterior and the past steps, so no step
stores or moves a row.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import LOWER, blocks, fresh, span_hashes, words, written

DOMAINS = ("high", "low", "toxic")
#: Posteriors are soft, so clean documents carry some toxic mass: a target near none would drop them too.
TARGETS = {"high": 0.87, "low": 0.08, "toxic": 0.05}
BUCKETS = 1 << 14
#: About so many labelled documents are sampled by a hash of doc_id to fit the classifier.
TRAIN_DOCUMENTS = 4000
EPOCHS, BATCH, STEP, DECAY = 60, 64, 1.0, 1e-4
STEPS, CLOSE = 25, 1e-6
#: A domain that must grow by more than this to meet its target keeps its share.
MOST_GROWTH = 4.0


def _bag(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value, words of each document): presence of words, scaled to length one."""
    flat = LOWER[flat]
    start, end, first = words(flat, offsets)
    n = np.diff(first)
    bucket = (span_hashes(flat, start, end) >> np.uint64(50)).astype(np.int64)
    code = np.unique(np.repeat(np.arange(len(n)), n) * BUCKETS + bucket)
    document = code // BUCKETS
    size = np.bincount(document, minlength=len(n))
    return document, code % BUCKETS, (1 / np.sqrt(np.maximum(size, 1)))[document], n


def domain(quality, toxic):
    """The domain of a row of the labelled table; null where a label is null."""
    return F.when(toxic == 1, "toxic").when((toxic == 0) & (quality == 1), "high").when((toxic == 0) & (quality == 0), "low")


def _sample(documents: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """_domain, text of about ``size`` labelled rows. Labels and rows that repeat in full count once, so that neither an id
    with many labels nor one with many rows makes the sample larger."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), domain(F.col("quality"), F.col("toxic")).alias("_domain")).where("_domain is not null and _id is not null").distinct()
    share = min(1.0, size / max(known.count(), 1))
    part = lambda *c: F.pmod(F.xxhash64(*c, F.lit("mix")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("_doc"), text.alias("text"), F.xxhash64(text).alias("_h"))
    few = F.broadcast(known.where(part("_id") <= share))  # about ``size`` narrow rows, however many are labelled: texts stay in place
    met = rows.join(few, F.col("_doc") == F.col("_id")).dropDuplicates(["_id", "_domain", "_h"])
    met = written(met.select("_id", "_domain", "_h", "text"), "labelled")
    return met.where(part("_id", "_domain", "_h") <= min(1.0, size / max(met.count(), 1))).select("_domain", "text")


def fit_classifier(documents: DataFrame, labels: DataFrame, size: int = TRAIN_DOCUMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of the softmax; both zero without labelled rows."""
    rows = _sample(documents, labels, size)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("_domain").to_pylist()
            for i, j, flat, offsets in blocks(b):
                document, bucket, _, _ = _bag(flat, offsets)
                cut = np.searchsorted(document, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([pa.array(names[i:j]), pa.array([bucket[s:e].astype(np.int32).tobytes() for s, e in zip(cut, cut[1:], strict=False)], pa.binary())], names=["name", "bag"])

    got = rows.mapInArrow(bags, "name string, bag binary").toArrow()
    pairs = sorted(zip(got.column("name").to_pylist(), got.column("bag").to_pylist(), strict=True))
    k = len(DOMAINS)
    w, bias, grown = np.zeros((BUCKETS, k), np.float32), np.zeros(k, np.float32), np.full(BUCKETS, 1e-6, np.float32)
    y = np.array([DOMAINS.index(n) for n, _ in pairs], int)
    x = [np.frombuffer(b, np.int32) for _, b in pairs]
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS if pairs else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            size_of = np.array([len(x[r]) for r in own])
            row, column = np.repeat(np.arange(len(own)), size_of), np.concatenate([x[r] for r in own])
            value = np.repeat(1 / np.sqrt(np.maximum(size_of, 1)), size_of)
            logits = np.stack([np.bincount(row, value * w[column, d], len(own)) for d in range(k)], 1)
            p = _softmax(logits + bias)
            p[np.arange(len(own)), y[own]] -= 1
            g = np.stack([np.bincount(column, value * p[row, d], BUCKETS) for d in range(k)], 1) / len(own) + DECAY * w
            grown += (g * g).sum(1).astype(np.float32)
            w -= (STEP * g / np.sqrt(grown)[:, None]).astype(np.float32)
            bias -= (STEP * p.mean(0)).astype(np.float32)
    return w, bias


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True)) if x.size else x
    return x / x.sum(1, keepdims=True)


def _posterior(classifier: tuple[np.ndarray, np.ndarray], flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, words) of each document; a text without words has the bias alone."""
    w, bias = classifier
    document, bucket, value, n = _bag(flat, offsets)
    logits = np.stack([np.bincount(document, value * w[bucket, k], len(n)) for k in range(len(DOMAINS))], 1) + bias
    return _softmax(logits), n


POSTERIORS = "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS)


def posteriors(documents: DataFrame, classifier: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n_tokens and the posterior of each domain for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(classifier)
    names = [x.split()[0] for x in POSTERIORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, flat, offsets in blocks(b):
                p, n = _posterior(shared.value, flat, offsets)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array(n.astype(np.int64)), *map(pa.array, p.T.copy())], names=names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, POSTERIORS)


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rate of each posterior after the steps so far: from 1, along the posterior, cut at 0 each time."""
    r = np.ones(len(p))
    for u in steps:
        r = np.maximum(0.0, r - p @ u)
    return r


def _expected(rows: DataFrame, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(expected tokens of each domain under the rates, Gram matrix of the rows with a rate above zero), summed by Spark."""
    k = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(k), np.zeros((k, k))
        for b in batches:
            p = np.stack([b.column(f"p_{d}").to_numpy() for d in DOMAINS], 1)
            t = b.column("n_tokens").to_numpy().astype(float)
            r = rates(p, steps)
            total += (r * t) @ p
            gram += (p * (t * (r > 0))[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate([total, gram.ravel()]))], names=["i", "x"])

    got = dict(rows.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x")).collect())
    x = np.array([got.get(i, 0.0) for i in range(k + k * k)])
    return x[:k], x[k:].reshape(k, k)


def solve(rows: DataFrame, targets: Mapping[str, float], budget: float | None = None, absent: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps, targets in tokens, expected tokens): projected gradient until the residual is below a millionth.

    Without a budget the total is the smallest that lets every domain whose share grows keep all its expected tokens.
    An ``absent`` domain has no labelled row to learn it from, and a scarce one would have to grow more than ``MOST_GROWTH``
    times (when a filter has left next to none of it): neither has a target to meet, as rates that made up for them would
    repeat a few documents without end; they are expected to keep their share.

    A step is first scaled by the Gram matrix, in ever smaller parts, then by its bound, which never makes the residual
    larger; a step that does not lessen the residual is not taken.
    """
    share = np.array([targets[d] for d in DOMAINS], float)
    if share.min() < 0 or not share.sum():
        raise ValueError("targets must hold a positive share and none below 0")
    share /= share.sum()
    steps: list[np.ndarray] = []
    now, gram = _expected(rows, steps)
    fixed = np.zeros(len(share), bool) if absent is None else absent.copy()
    scarce = ~fixed & (share * now.sum() > MOST_GROWTH * now)
    if scarce.any():
        warnings.warn(f"the mixture misses its targets: {', '.join(np.array(DOMAINS)[scarce])} would have to grow more than {MOST_GROWTH:g} times", stacklevel=2)
    fixed |= scarce
    if not share[~fixed].sum():
        fixed[:] = True  # no other domain has a target
    if fixed.any() and now.sum() and share[~fixed].sum():
        share[fixed] = now[fixed] / now.sum()
        share[~fixed] *= (1 - share[fixed].sum()) / share[~fixed].sum()
    grows = (share > 0) & (share * now.sum() >= now * (1 - 1e-9))
    total = budget if budget is not None else max((now[grows] / share[grows]).max(initial=0.0), now.sum())
    want = share * total
    free = np.diag((~fixed).astype(float))
    bound = max(np.linalg.eigvalsh(gram)[-1], 1e-300)  # with all rates above zero: no later one is larger
    for _ in range(STEPS):
        off = free @ (now - want)
        if np.abs(off).sum() <= CLOSE * max(total, 1):
            break
        scaled = np.linalg.pinv(free @ gram @ free, rcond=1e-9) @ off
        for step in (scaled, scaled / 4, scaled / 16, off / bound):
            later, its_gram = _expected(rows, [*steps, step])
            if np.square(free @ (later - want)).sum() < np.square(off).sum():
                break
        else:
            break
        steps.append(step)
        stuck = np.abs(later - now).sum() <= 1e-3 * CLOSE * max(total, 1)
        now, gram = later, its_gram
        if stuck:
            break
    rest = np.abs(free @ (now - want)).sum() / max(total, 1)
    if rest > 1e-3:
        warnings.warn(f"the mixture misses its targets by {rest:.2%} of all tokens", stacklevel=2)
    return steps, want, now


def _copies(doc_id: Column, weight: list[Column], steps: list[np.ndarray]) -> tuple[Column, Column]:
    """(rate, copies) of a row: ``rates`` as an expression, and the rate rounded by a hash of doc_id."""
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in u]) for u in steps])
    gain = lambda r, u: F.greatest(F.lit(0.0), r - sum((w * u[i] for i, w in enumerate(weight)), F.lit(0.0)))
    rate = F.aggregate(moves, F.lit(1.0), gain) if steps else F.lit(1.0)
    part = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return rate, F.floor(rate + part).cast("long")


def _steps(rows: DataFrame, documents: DataFrame, labels: DataFrame, targets: Mapping[str, float], budget: float | None) -> list[np.ndarray]:
    """The steps for rows with posteriors and n_tokens."""
    known = labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("_domain")).join(documents.select("doc_id"), "doc_id", "left_semi")
    named = {r["_domain"] for r in known.select("_domain").distinct().collect()}
    absent = np.array([d not in named for d in DOMAINS])
    return solve(rows, targets, budget, absent if not absent.all() else None)[0]


def mix(documents: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and copies for each row of ``documents``.

    ``copies`` rounds the rate by a hash of doc_id, so that its mean is the rate. Null and empty texts have no tokens and
    the rate of their posterior; a null doc_id has a number like any other. Repeated rows are mixed each; without labels
    all posteriors are equal and with an empty table nothing is solved. Other columns are not read.
    """
    rows = written(posteriors(documents, fit_classifier(documents, labels)), "mixing")
    steps = _steps(rows, documents, labels, targets, budget)
    rate, copies = _copies(F.col("doc_id"), [F.col(f"p_{d}") for d in DOMAINS], steps)
    return rows.withColumn("rate", rate).withColumn("copies", copies)


def mixed_documents(documents: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """``documents`` with each row as often as its own copies say; all columns of the input stay as they are.

    The documents are written once more with their posteriors; steps and copies follow from those alone, so nothing is
    joined and no text is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit_classifier(documents, labels))
    width = len(DOMAINS) + 1

    @F.arrow_udf(ArrayType(DoubleType()))
    def posterior(texts: pa.Array) -> pa.Array:
        """The posteriors and the words of each text."""
        found = [_posterior(shared.value, flat, offsets) for _, _, flat, offsets in blocks(pa.RecordBatch.from_arrays([texts], names=["text"]))]
        flat = np.concatenate([np.zeros(0), *(np.column_stack([p, n]).ravel() for p, n in found)])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))

    own, copy = fresh(documents, "posterior"), fresh(documents, "copy")
    rows = written(documents.withColumn(own, posterior(F.col("text").cast("string"))), "mixing")
    weight = [F.col(own)[k] for k in range(len(DOMAINS))]
    steps = _steps(rows.select(*(w.alias(f"p_{d}") for w, d in zip(weight, DOMAINS, strict=True)), F.col(own)[len(DOMAINS)].cast("long").alias("n_tokens")), documents, labels, targets, None)
    _, copies = _copies(F.col("doc_id").cast("long"), weight, steps)
    rows = rows.withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<long>"))))
    return rows.select(*[F.col(f"`{c}`") for c in documents.columns])
