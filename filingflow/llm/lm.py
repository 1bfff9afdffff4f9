"""Language-model scoring: a class-based log-bilinear model trained with noise-contrastive estimation.

A token's probability is that of its class given the classes of the two tokens before it, times that of the token within
its class. The most frequent words are classes of their own; other words share a class with words of the same last three
bytes. Word counts are exact over all training texts. They never meet in one place: documents are dealt over chunks, a
chunk sends its distinct words (as sorted hash arrays, cut by hash range) to the tasks that own the ranges, and gets back
the counts of just these words.

The bilinear model is fitted to the counts of class trigrams over all training texts. Spark sums them in parts by hash,
whose number follows from the training tokens. Parts are then gathered into shards by how many distinct trigrams there are,
of which the model knows at most ``CLASSES**3``: a shard's pass takes as many steps in a large corpus as in a small one, and
more tokens only make its counts more exact. Shards hold the same counts however the table is partitioned. In each round
every shard trains from the common parameters, and their means, weighted by how often a shard saw what a parameter belongs
to and summed as integers, start the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, arrow_table, blocks, crc_text, joined, mix, ranges, span_hashes, words, written

TOP, SUFFIXES = 768, 254
END, BEGIN, CLASSES = TOP + SUFFIXES, TOP + SUFFIXES + 1, TOP + SUFFIXES + 2
WIDTH, NOISE, STEP, BATCH, ROUNDS = 16, 64, 0.15, 1024, 4
#: Bytes of text in a chunk and behind a range of words, on average; at least so many of each.
CHUNK_BYTES, RANGE_BYTES, LEAST = 4_000_000, 64_000_000, 32
#: Training tokens behind a part of trigrams, and trigrams of blocks that a task holds before it sums or sends them.
PART_TOKENS, HELD = 2_000_000, 2_000_000
#: Distinct trigrams that a shard trains on, on average.
SHARD_CODES = 400_000


def tokens(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix class, first word of each document) of the lower-cased words."""
    flat = LOWER[flat]
    start, end, first = words(flat, offsets)
    tail = np.zeros(len(start), np.uint64)
    for k in (1, 2, 3):
        at = end - k
        tail = tail * np.uint64(257) + np.where(at >= start, flat[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return span_hashes(flat, start, end), (mix(tail) % np.uint64(SUFFIXES)).astype(np.uint8), first


def _training(column: str = "doc_id"):
    return F.pmod(crc_text(column), F.lit(5)) != 1


# --- counts ---------------------------------------------------------------------------------------------------------

DISTINCT = "part int, chunk int, hashes binary, counts binary, suffixes binary"
ANSWER = "part int, chunk int, hashes binary, counts binary, stats binary"


def _distinct_words(documents: DataFrame, parts: int) -> DataFrame:
    """For each chunk and hash range: the chunk's distinct words, and how often training texts of the chunk have them."""

    def gather(key, table):
        hashes, counts, suffixes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        for b in table.combine_chunks().to_batches():
            train = b.column("train").to_numpy(zero_copy_only=False)
            for i, j, flat, offsets in blocks(b):
                h, s, first = tokens(flat, offsets)
                weight = np.repeat(train[i:j], np.diff(first)).astype(np.int64)
                hashes, at, back = np.unique(np.concatenate([hashes, h]), return_index=True, return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, weight]), len(hashes)).astype(np.int64)
                suffixes = np.concatenate([suffixes, s])[at]
        edges = ranges(hashes, parts)
        rows = [(k, key[0].as_py(), hashes[a:b].tobytes(), counts[a:b].tobytes(), suffixes[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return arrow_table(DISTINCT, rows)

    return documents.groupBy("chunk").applyInArrow(gather, DISTINCT)


def _answers(distinct: DataFrame) -> DataFrame:
    """For each row of ``_distinct_words`` the counts over all chunks; ``stats`` (one row per range has it): tokens and
    distinct words per suffix class, and the range's most frequent words."""

    def answer(key, table):
        parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        counts = [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()]
        suffixes = [np.frombuffer(x, np.uint8) for x in table.column("suffixes").to_pylist()]
        every, at, back = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        total = np.bincount(back, np.concatenate(counts), len(every)).astype(np.int64)
        suffix = np.concatenate(suffixes)[at]
        n = np.bincount(suffix, total, SUFFIXES).astype(np.int64)
        v = np.bincount(suffix[total > 0], minlength=SUFFIXES)
        best = np.lexsort((every, -total))[:TOP]
        stats = np.concatenate([n, v, every[best].view(np.int64), total[best], suffix[best].astype(np.int64)]).tobytes()
        edges = np.cumsum([0, *map(len, parts)])
        return pa.table({
            "part": table.column("part"), "chunk": table.column("chunk"), "hashes": table.column("hashes"),
            "counts": pa.array([total[back[a:b]].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()),
            "stats": pa.array([stats] + [None] * (len(parts) - 1), pa.binary()),
        })

    return distinct.groupBy("part").applyInArrow(answer, ANSWER)


class Vocabulary:
    """The most frequent words and the totals of each class: what Spark sums of the ranges' statistics."""

    def __init__(self, answers: DataFrame, texts: int):
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for blob in b.column("stats").to_pylist():
                    x = np.frombuffer(blob, np.int64)
                    h, c, s = x[2 * SUFFIXES :].reshape(3, -1)
                    suffix = np.concatenate([np.arange(SUFFIXES), s])
                    none = np.zeros(len(h), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([False, True], [SUFFIXES, len(h)])), pa.array(suffix), pa.array(np.concatenate([x[:SUFFIXES], c])), pa.array(np.concatenate([x[SUFFIXES : 2 * SUFFIXES], none])), pa.array(np.concatenate([np.zeros(SUFFIXES, np.int64), h]))], names=["word", "suffix", "n", "v", "h"])

        rows = answers.where("stats is not null").select("stats").mapInArrow(unpack, "word boolean, suffix long, n long, v long, h long")
        sums = rows.where("not word").groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
        top = rows.where("word and n > 0").orderBy(F.desc("n"), "h").limit(TOP).toArrow()
        n, v = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
        n[sums.column("suffix").to_numpy()], v[sums.column("suffix").to_numpy()] = sums.column("n").to_numpy(), sums.column("v").to_numpy()
        h, c, s = (top.column(x).to_numpy() for x in ("h", "n", "suffix"))
        self.texts = texts
        self.tokens, self.distinct = int(n.sum()) + texts, int(v.sum()) + (texts > 0)
        np.subtract.at(n, s, c)
        np.subtract.at(v, s, 1)
        order = np.argsort(h.view(np.uint64))
        self.top = h.view(np.uint64)[order]
        self.class_tokens = np.concatenate([c[order], np.zeros(TOP - len(h), np.int64), n, [texts, 0]])
        self.suffix_n, self.suffix_v = n, v

    def classes(self, hashes: np.ndarray, suffix: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes of all documents' tokens, ends included, in order, and where each document's begin."""
        out = suffix.astype(np.int64) + TOP
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            out = np.where(self.top[at] == hashes, at, out)
        n = len(first) - 1
        full = np.full(len(out) + n, END, np.int64)
        full[np.arange(len(out)) + np.repeat(np.arange(n), np.diff(first))] = out
        return full, first + np.arange(n + 1)


def contexts(classes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two tokens back; BEGIN before a document's first token."""
    one, two = np.roll(classes, 1), np.roll(classes, 2)
    one[begin[:-1]] = two[begin[:-1]] = BEGIN
    second = begin[:-1] + 1
    two[second[second < begin[1:]]] = BEGIN
    return one, two


# --- the counts of class trigrams ------------------------------------------------------------------------------------

TRIGRAMS = "part int, codes binary, counts binary"


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, back = np.unique(codes, return_inverse=True)
    return code, np.bincount(back, counts, len(code)).astype(np.int64)


def trigrams(documents: DataFrame, vocabulary: Vocabulary, parts: int) -> DataFrame:
    """For each part the codes of its class trigrams, sorted, and how often the texts have each."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def sent(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = (mix(code.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        code, n = code[order].astype(np.uint32), n[order].astype(np.int64)
        rows = [(k, code[a:b].tobytes(), n[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return arrow_table(TRIGRAMS, rows).combine_chunks().to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, size = shared.value, [], 0
        for b in batches:
            for _, _, flat, offsets in blocks(b):
                target, begin = vocabulary.classes(*tokens(flat, offsets))
                one, two = contexts(target, begin)
                held.append(np.unique((two * CLASSES + one) * CLASSES + target, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from sent(*held[0])
                        held, size = [], 0
        if held:
            yield from sent(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    def merge(key, table):
        code, n = _summed(joined(table.column("codes"), np.uint32), joined(table.column("counts"), np.int64))
        return arrow_table(TRIGRAMS, [(key[0].as_py(), code.astype(np.uint32).tobytes(), n.tobytes())])

    return documents.select("text").mapInArrow(count, TRIGRAMS).groupBy("part").applyInArrow(merge, TRIGRAMS)


def sharded(parts: DataFrame) -> tuple[DataFrame, int]:
    """(shards, their number): the trigrams of whole parts, sorted, with about ``SHARD_CODES`` in each.

    A part's trigrams are in no other, and which part a trigram is in follows from its hash, so a shard is a random share.
    """
    distinct = (parts.agg(F.sum(F.octet_length("codes"))).first()[0] or 0) // 4
    n = max(1, -(-distinct // SHARD_CODES))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part can hold more than a shard does, so its trigrams are dealt by other bits of their hash."""
        for b in batches:
            for codes, counts in zip(b.column("codes").to_pylist(), b.column("counts").to_pylist(), strict=True):
                code, count = np.frombuffer(codes, np.uint32), np.frombuffer(counts, np.int64)
                shard = ((mix(code.astype(np.uint64)) >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(n + 1))
                rows = [(k, code[order[a:z]].tobytes(), count[order[a:z]].tobytes()) for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)) if z > a]
                yield from arrow_table(SHARDS, rows).combine_chunks().to_batches()

    def gather(key, table):
        code, count = joined(table.column("codes"), np.uint32), joined(table.column("counts"), np.int64)
        order = np.argsort(code)
        return arrow_table(SHARDS, [(key[0].as_py(), code[order].tobytes(), count[order].tobytes())])

    return parts.select("codes", "counts").mapInArrow(spread, SHARDS).groupBy("shard").applyInArrow(gather, SHARDS), n


SHARDS = "shard int, codes binary, counts binary"


# --- the log-bilinear model --------------------------------------------------------------------------------------------


class LogBilinear:
    """Scores are the product of a context vector and a class vector, plus a class bias."""

    SHAPES = ((CLASSES, WIDTH), (2, WIDTH), (CLASSES, WIDTH), (CLASSES,))

    def __init__(self, flat: np.ndarray):
        cut = np.cumsum([np.prod(s) for s in self.SHAPES])
        self.q, self.c, self.r, self.b = (x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat, cut[:-1]), self.SHAPES, strict=True))

    @classmethod
    def start(cls, class_tokens: np.ndarray, seed: int = 7) -> np.ndarray:
        rng = np.random.default_rng(seed)
        share = (class_tokens + 0.5) / (class_tokens + 0.5).sum()
        return np.concatenate([rng.normal(0, 0.1, CLASSES * WIDTH), np.ones(2 * WIDTH), rng.normal(0, 0.1, CLASSES * WIDTH), np.log(share)])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.q, self.c, self.r, self.b)]).astype(np.float64)

    def train(self, code: np.ndarray, n: np.ndarray, noise: np.ndarray, seed: int, step: float = STEP) -> None:
        """One pass of noise-contrastive estimation with Adagrad over counted trigrams; noise: the share of each class.

        A trigram weighs as much as it is frequent, and one far more frequent than the mean comes in several batches. The
        trigrams of a batch share their noise, so that all scores and gradients are matrix products.
        """
        rng = np.random.default_rng(seed)
        bound, log_noise = np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)
        mean = n.mean()
        times = np.ceil(n / (4 * mean)).astype(np.int64)
        at = rng.permutation(np.repeat(np.arange(len(code)), times))
        weight = (n / times / (mean * BATCH)).astype(np.float32)[at]
        code = code[at].astype(np.int64)
        two, one, target = code // CLASSES**2, code // CLASSES % CLASSES, code % CLASSES
        q, c, r, b = self.q, self.c, self.r, self.b
        grown = [np.full(s, 1e-3, np.float32) for s in self.SHAPES]
        for k in range(0, len(at), BATCH):
            own_two, own_one, t, w = two[k : k + BATCH], one[k : k + BATCH], target[k : k + BATCH], weight[k : k + BATCH]
            q2, q1 = q[own_two], q[own_one]
            p = q2 * c[0] + q1 * c[1]
            drawn = np.searchsorted(bound, rng.random(NOISE) * bound[-1], "right").clip(0, END)
            own = (p * r[t]).sum(1) + b[t] - log_noise[t]
            other = p @ r[drawn].T + (b[drawn] - log_noise[drawn])
            up = w / (1 + np.exp(own.clip(-30, 30)))
            down = w[:, None] / (1 + np.exp(-other.clip(-30, 30)))
            dp = up[:, None] * r[t] - down @ r[drawn]
            dr, dq = np.zeros_like(r), np.zeros_like(q)
            np.add.at(dr, t, up[:, None] * p)
            np.subtract.at(dr, drawn, down.T @ p)
            np.add.at(dq, own_two, dp * c[0])
            np.add.at(dq, own_one, dp * c[1])
            db = np.bincount(t, up, CLASSES) - np.bincount(drawn, down.sum(0), CLASSES)
            dc = np.stack([(dp * q2).sum(0), (dp * q1).sum(0)])
            for x, d, s in zip((q, c, r, b), (dq, dc, dr, db.astype(np.float32)), grown, strict=True):
                s += d * d
                x += step * d / np.sqrt(s)

    def normaliser(self, two: int) -> np.ndarray:
        """log of the sum over all classes for a class two tokens back and every class one back."""
        score = (self.q[two] * self.c[0] + self.q * self.c[1]) @ self.r.T + self.b
        score[:, BEGIN] = -np.inf
        top = score.max(1)
        return top + np.log(np.exp(score - top[:, None]).sum(1))

    def log10(self, two: np.ndarray, one: np.ndarray, target: np.ndarray, normalisers: np.ndarray) -> np.ndarray:
        """log10 P(target | two back, one back)."""
        out = np.empty(len(target))
        for k in range(0, len(target), 100_000):
            s = slice(k, k + 100_000)
            score = ((self.q[two[s]] * self.c[0] + self.q[one[s]] * self.c[1]) * self.r[target[s]]).sum(1) + self.b[target[s]]
            out[s] = (score - normalisers[two[s], one[s]]) / np.log(10)
        return out


#: Parameters and weights are averaged as integers, whose sums do not depend on their order: units of 2**-20 and 2**-12.
UNIT, SHARE = 1 << 20, 1 << 12


def fit(counts: DataFrame, shards: int, vocabulary: Vocabulary) -> LogBilinear:
    """The model of the rows of ``sharded``: rounds of one pass over every shard and a weighted mean."""
    scale = SHARE * 64 * shards / max(vocabulary.tokens, 1)  # weights are shares of a shard's tokens, so that their sums stay small
    flat = LogBilinear.start(vocabulary.class_tokens)
    noise = (vocabulary.class_tokens + 0.5) / (vocabulary.class_tokens + 0.5).sum()
    context = counts.sparkSession.sparkContext

    def masses(code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How often the shard saw what each parameter belongs to; every class is drawn as noise."""
        total = n.sum()
        back = np.bincount(code // CLASSES**2, n, CLASSES) + np.bincount(code // CLASSES % CLASSES, n, CLASSES)
        here = np.bincount(code % CLASSES, n, CLASSES) + noise * total
        return np.concatenate([np.repeat(back, WIDTH), np.full(2 * WIDTH, total), np.repeat(here, WIDTH), here])

    for k in range(ROUNDS):
        shared = context.broadcast(flat)

        def train(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, codes, n in zip(*(b.column(x).to_pylist() for x in ("shard", "codes", "counts")), strict=True):
                    code, n = np.frombuffer(codes, np.uint32).astype(np.int64), np.frombuffer(n, np.int64)
                    model = LogBilinear(shared.value)
                    model.train(code, n, noise, 1000 * k + shard, STEP / (1 + k))
                    weight = np.rint(masses(code, n) * scale).astype(np.int64)
                    at = np.flatnonzero(weight)
                    x = np.rint(model.flat()[at] * UNIT).astype(np.int64) * weight[at]
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(x), pa.array(weight[at])], names=["k", "x", "w"])

        got = counts.mapInArrow(train, "k int, x long, w long").groupBy("k").agg(F.sum("x").alias("x"), F.sum("w").alias("w")).toArrow()
        flat = flat.copy()
        flat[got.column("k").to_numpy()] = got.column("x").to_numpy() / got.column("w").to_numpy() / UNIT
        shared.unpersist()
    return LogBilinear(flat)


def normalisers(spark: SparkSession, model: LogBilinear) -> np.ndarray:
    """The logs of the sums for every pair of context classes: batched matrix products, one row a class, a fixed size."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            two = b.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(two, pa.int64()), pa.array([shared.value.normaliser(k).astype(np.float32).tobytes() for k in two], pa.binary())], names=["two", "z"])

    got = spark.range(0, CLASSES, 1, 32).mapInArrow(run, "two long, z binary").toArrow().sort_by("two")
    return joined(got.column("z"), np.float32).reshape(CLASSES, CLASSES)


# --- scores ---------------------------------------------------------------------------------------------------------

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``documents``.

    Documents whose crc32(doc_id as text) leaves 1 when divided by 5 are held out; all others train. Null and empty texts
    have the end token alone. Repeated rows are scored each; a null doc_id trains (its remainder is unknown) and is not
    held out. Only doc_id and text are read; an empty table gives an empty result. Scores do not depend on the partitioning.
    """
    spark = documents.sparkSession
    total, texts = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")), F.count_if(F.coalesce(_training(), F.lit(True)))).first()
    chunks, parts = max(LEAST, -(-(total or 0) // CHUNK_BYTES)), max(LEAST, -(-(total or 0) // RANGE_BYTES))
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(_training(), F.lit(True)).alias("train"), F.pmod(F.xxhash64("doc_id", text), F.lit(chunks)).cast("int").alias("chunk"))
    answers = written(_answers(_distinct_words(rows, parts)), "lm-words")
    vocabulary = Vocabulary(answers, texts)
    parts = written(trigrams(rows.where("train"), vocabulary, max(1, -(-vocabulary.tokens // PART_TOKENS))), "lm-trigrams")
    shards, n = sharded(parts)
    model = fit(written(shards, "lm-shards", 1), n, vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, model, normalisers(spark, model)))

    def score(key, left, right):
        vocabulary, model, sums = shared.value
        parts = sorted(zip(right.column("hashes").to_pylist(), right.column("counts").to_pylist(), right.column("part").to_pylist(), strict=True), key=lambda x: x[2])
        known = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x[0], np.uint64) for x in parts)])
        count = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x[1], np.int64) for x in parts)])
        total = np.log10(vocabulary.tokens + 0.5 * (vocabulary.distinct + 1))
        end = np.log10(vocabulary.texts + 0.5) - total
        within = np.log10(vocabulary.suffix_n + 0.5 * (vocabulary.suffix_v + 1))
        out = []
        for b in left.combine_chunks().to_batches():
            for i, j, flat, offsets in blocks(b):
                h, s, first = tokens(flat, offsets)
                c = count[np.searchsorted(known, h)] if len(h) else np.zeros(0, np.int64)
                classes, begin = vocabulary.classes(h, s, first)
                one, two = contexts(classes, begin)
                logs = model.log10(two, one, classes, sums)
                smooth = np.log10(c + 0.5)
                word = np.ones(len(classes), bool)
                word[begin[1:] - 1] = False
                own = np.where(classes[word] >= TOP, smooth - within[s], 0.0)
                out.append((
                    b.column("doc_id")[i:j].to_pylist(), b.column("train")[i:j].to_pylist(), np.diff(begin),
                    _sums(c > 0, first) + (vocabulary.texts > 0), _sums(smooth - total, first) + end, _sums(logs, begin) + _sums(own, first),
                ))
        ids, train = [x for o in out for x in o[0]], [x for o in out for x in o[1]]
        n, got, base, lbl = (np.concatenate([np.zeros(0), *(o[k] for o in out)]) for k in (2, 3, 4, 5))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([not x for x in train], pa.bool_()), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(got.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(ids), vocabulary.tokens, np.int64)), "base_score": pa.array(base, pa.float64()), "score": pa.array(lbl, pa.float64()),
        })

    return rows.groupBy("chunk").cogroup(answers.select("chunk", "part", "hashes", "counts").groupBy("chunk")).applyInArrow(score, SCORES)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each document's values, whatever stands beside it in the block."""
    out = np.zeros(len(first) - 1)
    own = np.flatnonzero(np.diff(first))
    if len(own):
        out[own] = np.add.reduceat(values.astype(np.float64), first[own])
    return out
