"""Quality rules: word, line and repetition counts, and a perplexity band per language.

The perplexity comes from interpolated modified Kneser-Ney models of the corpus itself, one for each language: n-grams of four
code points, A-Z in lower case, digits and white space as one symbol each. It is taken per word that holds a letter or a
digit: runs of symbols are cheap to predict, so per symbol they would hide in the mean, while per word whatever they cost is
added.

Nothing of a model meets in one place. Texts are packed into chunks of some megabytes; a chunk sends its distinct n-grams with
their counts, as compressed arrays cut by hash range. Spark sums them, lower orders count distinct left contexts, and
joins of the orders give each n-gram its probability. The model is kept as sorted hash arrays by range, and a chunk gets back
the probabilities of just the n-grams it sent. An n-gram that no other text has counts as unseen in its own text: else junk
would be predicted from itself. Copies are one text in this: what only they have is counted as in one of them, so junk that
stands many times in the table fares like junk that stands once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SECOND, SPACE, arrow_table, blocks, fresh, mix, run_hashes, span_hashes, squeezed, sums_by_document, widened, words, written

ORDER = 4
#: Stands before and behind each text; code points beyond 16 bits share the numbers of the surrogates, which no text has.
EDGE = 0xFFFF
MIN_WORDS = 50
#: A band reaches from the median of log10 perplexity so many times as far as the nearer quartile, and this far at least: junk
#: on one side, even a quarter of a language, does not widen it.
REACH, LEAST = 7.0, 0.7
#: Bytes of text in a chunk, and behind a range of hashes; the number of ranges is a power of two.
PACK_BYTES, RANGE_BYTES, LEAST_RANGES = 4_000_000, 256_000_000, 16

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Bytes that make a word count for the perplexity: letters, digits, all of non-ASCII characters.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def _folded() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    out[0x10000:] = 0xD800 + out[0x10000:] % 0x800
    out[65:91] += 32
    out[48:58] = 48
    out[: len(SPACE)][SPACE] = 32
    return out.astype(np.uint16)


FOLD = _folded()


def codes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit code of the 4-gram that ends at each code point, an edge per document included; offsets of the documents.

    Each document begins with three edges as context, so none of its n-grams reaches into another document. The first symbol
    has the highest bits: a context is the code without its lowest 16 bits, a lower order the code without its highest.
    """
    points = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(offsets) - 1
    offsets = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])[offsets]
    size = np.diff(offsets)
    out = np.full(len(points) + ORDER * n, EDGE, np.uint64)
    out[np.arange(len(points)) + np.repeat(np.arange(n) * ORDER + ORDER - 1, size)] = FOLD[points]
    gram = out[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        gram |= out[ORDER - 1 - k : len(out) - k] << np.uint64(16 * k)
    keep = np.ones(len(out), bool)
    start = offsets[:-1] + ORDER * np.arange(n)
    for k in range(ORDER - 1):
        keep[start + k] = False
    return gram[keep[ORDER - 1 :]], offsets + np.arange(n + 1)


# --- chunks of texts and their n-grams -------------------------------------------------------------------------------

PACKED = "chunk long, blob binary"
ASKED = "part int, chunk long, lang_key long, codes binary"
SENT = "part int, chunk long, lang_key long, codes binary, counts binary, lone binary, owners binary, times binary"


def packed(documents: DataFrame) -> DataFrame:
    """chunk, blob: the rows (doc_id, lang, lang_key, rid, text), some megabytes of text in each compressed blob.

    A chunk is known by the task that packed it and a number: what is made of the packs must read them from a written table.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 12))
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            for i, j, _, _ in blocks(b, limit=PACK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                    out.write_batch(b.slice(i, j - i))
                blob = sink.getvalue().to_pybytes()
                chunk += 1
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "blob"])

    return documents.mapInArrow(pack, PACKED)


def _languages(blob: bytes) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a blob, a language after the other."""
    for b in pa.ipc.open_stream(blob):
        key = b.column("lang_key").to_numpy()
        for k in np.unique(key):
            yield int(k), b.filter(pa.array(key == k))


def _text_digests(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A digest of each text of a block that is not 0; equal texts have equal ones."""
    return mix(span_hashes(flat, offsets[:-1], offsets[1:], SECOND) ^ np.diff(offsets).astype(np.uint64)) | np.uint64(1)


def _grams(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of the rows, sorted; how often the rows have each; the digest of the text that alone has it, copies
    being one text, or 0; and how often that text has it."""
    code, n, low, high = (np.zeros(0, t) for t in (np.uint64, np.int64, np.uint64, np.uint64))
    texts = []
    for _, _, flat, offsets in blocks(rows):
        own, bound = codes(flat, offsets)
        texts.append(_text_digests(flat, offsets))
        order = np.argsort(own, kind="stable")
        own, text = own[order], np.repeat(texts[-1], np.diff(bound))[order]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        new = own[start], np.diff(start, append=len(own)), np.minimum.reduceat(text, start), np.maximum.reduceat(text, start)
        if len(code):
            both = [np.concatenate(x) for x in zip((code, n, low, high), new, strict=True)]
            order = np.argsort(both[0], kind="stable")
            both = [x[order] for x in both]
            start = np.flatnonzero(np.append(True, both[0][1:] != both[0][:-1]))
            new = both[0][start], np.add.reduceat(both[1], start), np.minimum.reduceat(both[2], start), np.maximum.reduceat(both[3], start)
        code, n, low, high = new
    lone = low == high
    if not lone.any():
        return code, n, np.zeros(len(code), np.uint64), np.zeros(len(code), np.int64)
    digest, copies = np.unique(np.concatenate(texts), return_counts=True)
    times = np.where(lone, n // copies[np.minimum(np.searchsorted(digest, low), len(digest) - 1)], 0)
    return code, n, np.where(lone, low, np.uint64(0)), times


def _own_codes(rows: pa.RecordBatch) -> np.ndarray:
    """The distinct n-grams of the rows, sorted."""
    code = np.zeros(0, np.uint64)
    for _, _, flat, offsets in blocks(rows):
        code = np.union1d(code, codes(flat, offsets)[0])
    return code


def _dealt(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams by hash range, and by code within each, and where the ranges begin and the last one ends."""
    part = (mix(code) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange((1 << bits) + 1))


def sent_grams(packs: DataFrame, bits: int) -> DataFrame:
    """For each chunk, hash range and language the distinct n-grams, as differences, and how often the chunk has each.

    ``lone`` tells those that one text of the chunk has; ``owners`` and ``times`` hold its digest and how often it has them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob"), strict=True):
                for key, rows in _languages(blob.as_py()):
                    grams = _grams(rows)
                    order, edges = _dealt(grams[0], bits)
                    code, n, owner, times = (x[order] for x in grams)
                    out = []
                    for p, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                        if y > x:
                            lone = owner[x:y] > 0
                            arrays = np.diff(code[x:y], prepend=np.uint64(0)), n[x:y].astype(np.uint32), np.packbits(lone), owner[x:y][lone], times[x:y][lone].astype(np.uint32)
                            out.append((p, chunk, key, *map(squeezed, arrays)))
                    yield from arrow_table(SENT, out).to_batches()

    return packs.mapInArrow(send, SENT)


def asked_grams(packs: DataFrame, bits: int) -> DataFrame:
    """part, chunk, lang_key, codes: the n-grams of ``sent_grams`` without what is known of them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob"), strict=True):
                for key, rows in _languages(blob.as_py()):
                    code = _own_codes(rows)
                    order, edges = _dealt(code, bits)
                    code = code[order]
                    yield from arrow_table(ASKED, [(p, chunk, key, squeezed(np.diff(code[x:y], prepend=np.uint64(0)))) for p, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]).to_batches()

    return packs.mapInArrow(send, ASKED)


def _codes_of(data: bytes) -> np.ndarray:
    return np.cumsum(widened(data, np.uint64), dtype=np.uint64)


def gram_counts(sent: DataFrame) -> DataFrame:
    """lang_key, code, n, alone: how often all texts of a language have each n-gram, or, where a single text is ``alone`` in
    having it, how often that one does, however many copies it has."""

    def total(key, table):
        langs, out = table.column("lang_key").to_numpy(), []
        for k in np.unique(langs):
            own = table.filter(pa.array(langs == k))
            parts = []
            for codes_, counts, lone, owners, times in zip(*(own.column(c).to_pylist() for c in ("codes", "counts", "lone", "owners", "times")), strict=True):
                code = _codes_of(codes_)
                single = np.unpackbits(widened(lone, np.uint8), count=len(code)).astype(bool)
                owner, once = np.zeros(len(code), np.uint64), np.zeros(len(code), np.uint32)
                owner[single], once[single] = widened(owners, np.uint64), widened(times, np.uint32)
                parts.append((code, widened(counts, np.uint32), owner, once))
            code, n, owner, once = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(code, kind="stable")
            code, n, owner, once = code[order], n[order].astype(np.int64), owner[order], once[order]
            start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            alone = (np.minimum.reduceat(owner, start) == np.maximum.reduceat(owner, start)) & (owner[start] > 0)
            n = np.where(alone, once[start], np.add.reduceat(n, start))
            out.append(pa.table({"lang_key": pa.array(np.full(len(start), k)), "code": pa.array(code[start].view(np.int64)), "n": pa.array(n), "alone": pa.array(alone)}))
        return pa.concat_tables(out)

    return sent.groupBy("part").applyInArrow(total, "lang_key long, code long, n long, alone boolean")


# --- the model --------------------------------------------------------------------------------------------------------

MODEL = "part int, lang_key long, hashes binary, logs binary"


def _discounts(grams: DataFrame) -> DataFrame:
    """lang_key, d1, d2, d3: the discounts of counts 1, 2 and more, from counts of counts."""
    n1, n2, n3, n4 = (F.col(f"n{k}").cast("double") for k in (1, 2, 3, 4))
    y = F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(0.5)
    clip = lambda x, top: F.least(F.lit(top), F.greatest(F.lit(0.05), x))
    return (
        grams.groupBy("lang_key").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
        .select("lang_key", clip(F.when(n1 > 0, 1 - 2 * y * n2 / n1).otherwise(y), 0.95).alias("d1"), clip(F.when(n2 > 0, 2 - 3 * y * n3 / n2).otherwise(2 * y), 1.95).alias("d2"), clip(F.when(n3 > 0, 3 - 4 * y * n4 / n3).otherwise(3 * y), 2.95).alias("d3"))
    )


def probabilities(counts: DataFrame) -> DataFrame:
    """lang_key, code, p: the probability of the last symbol of each n-gram after its context; for an n-gram that one text is
    alone in having, what it would be had the n-gram not been seen.

    Lower orders count distinct left contexts. A group of one context has at most as many rows as there are symbols, 65,536.
    """
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):
        orders.insert(0, orders[0].groupBy("lang_key", F.col("code").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("code")).agg(F.count("*").alias("n"), F.lit(False).alias("alone")))
    below = None
    for k, grams in enumerate(orders, 1):
        context = Window.partitionBy("lang_key", F.shiftrightunsigned("code", 16))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = grams.join(_discounts(grams), "lang_key").withColumn("cut", cut)
        total = F.sum("n").over(context)
        rows = rows.select("lang_key", "code", "alone", ((F.col("n") - F.col("cut")) / total).alias("share"), (F.sum("cut").over(context) / total).alias("rest"))
        if below is None:
            sizes = grams.groupBy("lang_key").agg((F.count("*") + 1).alias("symbols"))
            rows = rows.join(sizes, "lang_key").withColumn("under", 1 / F.col("symbols"))
        else:
            under = below.select("lang_key", F.col("code").alias("suffix"), F.col("p").alias("under"))
            rows = rows.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))).join(under, ["lang_key", "suffix"])
        lower = F.col("rest") * F.col("under")
        below = rows.select("lang_key", "code", F.when(F.col("alone"), lower).otherwise(F.col("share") + lower).alias("p"))
    return below


def model(probability: DataFrame, bits: int) -> DataFrame:
    """The model as arrays sorted by hash, one row for each hash range and language."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = mix(b.column("code").to_numpy().view(np.uint64))
            part = (h >> np.uint64(64 - bits)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column("lang_key"), pa.array(h.view(np.int64)), pa.array(np.log10(b.column("p").to_numpy()).astype(np.float32))], names=["part", "lang_key", "h", "log"])

    def sort(key, table):
        langs, h, log = (table.column(c).to_numpy() for c in ("lang_key", "h", "log"))
        order = np.lexsort((h.view(np.uint64), langs))
        langs, h, log = langs[order], h[order], log[order]
        edges = [*np.flatnonzero(np.append(True, langs[1:] != langs[:-1])).tolist(), len(langs)]
        return arrow_table(MODEL, [(key[0].as_py(), int(langs[a]), h[a:b].tobytes(), log[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)])

    return probability.mapInArrow(keyed, "part int, lang_key long, h long, log float").groupBy("part").applyInArrow(sort, MODEL)


ANSWERS = "chunk long, part int, lang_key long, logs binary"


def answers(asked: DataFrame, model: DataFrame) -> DataFrame:
    """chunk, part, lang_key, logs: the log probabilities of the n-grams that a chunk asks for, in their order."""

    def find(key, left, right):
        known = {k: (np.frombuffer(h, np.uint64), np.frombuffer(log, np.float32)) for k, h, log in zip(*(right.column(c).to_pylist() for c in ("lang_key", "hashes", "logs")), strict=True)}
        rows = []
        for chunk, k, wanted in zip(*(left.column(c).to_pylist() for c in ("chunk", "lang_key", "codes")), strict=True):
            h, log = known[k]
            rows.append((chunk, key[0].as_py(), k, squeezed(log[np.searchsorted(h, mix(_codes_of(wanted)))])))
        return arrow_table(ANSWERS, rows)

    return asked.groupBy("part").cogroup(model.groupBy("part")).applyInArrow(find, ANSWERS)


def told(rows: pa.Table, code: np.ndarray, bits: int) -> np.ndarray:
    """The logs of a chunk's n-grams of one language, from the answers in the order of their ranges."""
    order, edges = _dealt(code, bits)
    log = np.zeros(len(code), np.float32)
    for part, logs in zip(rows.column("part").to_pylist(), rows.column("logs").to_pylist(), strict=True):
        log[order[edges[part] : edges[part + 1]]] = widened(logs, np.float32)
    return log


# --- the measures -----------------------------------------------------------------------------------------------------

MEASURES = "doc_id long, lang string, rid long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log10_ppl double"


def _line_repeats(flat: np.ndarray, offsets: np.ndarray, word_start: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the document."""
    breaks = flat == 10
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    start = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(breaks) + 1]))
    start = start[start < len(flat)]
    if not len(start):
        return np.zeros(len(offsets) - 1, np.int64)
    end = np.concatenate([start[1:], [len(flat)]])
    document = np.searchsorted(offsets, start, "right") - 1
    end = end - (breaks[end - 1] & (end > start))
    filled = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end, document = start[filled], end[filled], document[filled]
    with np.errstate(over="ignore"):
        key = mix(span_hashes(flat, start, end) + document.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, first = np.unique(key, return_index=True)
    n = len(offsets) - 1
    return np.bincount(document, minlength=n) - np.bincount(document[first], minlength=n)


def _repeat_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words in windows of three that occur twice or more in the document."""
    window, document = run_hashes(hashes, first, 3)
    n = len(first) - 1
    if not len(window):
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        key = mix(window + document.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[back] > 1)
    runs = np.maximum(np.diff(first) - 2, 0)
    at = np.arange(len(window)) + np.repeat(first[:-1] - (np.cumsum(runs) - runs), runs)
    covered = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        covered[at[again] + k] = True
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[first[1:]] - total[first[:-1]]


def _lettered(flat: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each document that hold a letter or a digit."""
    letters = np.concatenate([[0], np.cumsum(LETTERS[flat])])
    total = np.concatenate([[0], np.cumsum(letters[end] > letters[start])])
    return total[first[1:]] - total[first[:-1]]


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, lang, rid, the counts of the contract and log10 perplexity per word with a letter or digit, one row per document.

    ``rid`` is a hash of doc_id, language and text, by which a row's verdict finds it again.
    """
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    rows = documents.select(F.col("doc_id").cast("long"), lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.xxhash64(F.col("doc_id").cast("long"), lang, text).alias("rid"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = int(np.ceil(np.log2(max(LEAST_RANGES, total / RANGE_BYTES))))
    packs = written(packed(rows), "quality-packs")
    arrays = written(model(probabilities(written(gram_counts(sent_grams(packs, bits)), "quality-counts")), bits), "quality-model")
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(key, left, right):
        langs = right.column("lang_key").to_numpy()
        out = []
        for blob in left.column("blob"):
            for k, b in _languages(blob.as_py()):
                code = _own_codes(b)
                log = told(right.filter(pa.array(langs == k)), code, bits).astype(np.float64)
                for i, j, flat, offsets in blocks(b):
                    start, end, first = words(flat, offsets)
                    gram, bound = codes(flat, offsets)
                    total = np.add.reduceat(log[np.searchsorted(code, gram)], bound[:-1])
                    columns = [
                        b.column("doc_id")[i:j], b.column("lang")[i:j], b.column("rid")[i:j],
                        *map(pa.array, (
                            np.diff(first).astype(np.int64),
                            sums_by_document(((flat & 0xC0) != 0x80) & ~SPACE[flat], offsets),
                            sums_by_document(SYMBOLS[flat], offsets),
                            _line_repeats(flat, offsets, start).astype(np.int64),
                            _repeat_words(span_hashes(flat, start, end), first).astype(np.int64),
                            -total / np.maximum(_lettered(flat, start, end, first), 1),
                        )),
                    ]
                    out.append(pa.RecordBatch.from_arrays(columns, names=names))
        return pa.Table.from_batches(out)

    return packs.groupBy("chunk").cogroup(answers(asked_grams(packs, bits), arrays).groupBy("chunk")).applyInArrow(run, MEASURES)


def bands(measures: DataFrame, reach: float = REACH, least: float = LEAST) -> DataFrame:
    """band_lang, low, high: the accepted log10 perplexities of each language, from all its documents of enough words.

    Equal perplexities count once, so that a large group of copies does not set the quartiles.
    """
    q = F.percentile_approx("log10_ppl", [0.25, 0.5, 0.75], 10_000)
    each = measures.where(F.col("n_words") >= MIN_WORDS).select("lang", "log10_ppl").distinct()
    rows = each.groupBy(F.col("lang").alias("band_lang")).agg(q.alias("q"))
    wide = F.greatest(F.least(F.col("q")[1] - F.col("q")[0], F.col("q")[2] - F.col("q")[1]) * reach, F.lit(least))
    return rows.select("band_lang", (F.col("q")[1] - wide).alias("low"), (F.col("q")[1] + wide).alias("high"))


def judge(documents: DataFrame, reach: float = REACH, least: float = LEAST) -> DataFrame:
    """The counts of each document with log10_ppl, low, high, base_failed and kept.

    A document fails the base rules with fewer than 50 words or with more than half its words in repeated three-word
    windows; the others are kept if their perplexity lies in the band of their language. Null texts count as empty; a null
    language has a model and a band of its own. Rows stay one for one, repeated rows included; an empty table gives an empty
    result; other columns are not read.
    """
    rows = written(measure(documents), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    joined = rows.join(bands(rows, reach, least), F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
    inside = F.coalesce(F.col("log10_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside)


def quality_filter(documents: DataFrame) -> DataFrame:
    """``documents`` without the rows whose counts or perplexity fail; all columns of the input stay as they are.

    Each row gets the verdict of its own language and text, whatever other rows have its doc_id.
    """
    key, doc = fresh(documents, "key"), fresh(documents, "doc")
    good = judge(documents).where("kept").select(F.col("doc_id").alias(doc), F.col("rid").alias(key)).distinct()
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return documents.join(good, (own == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left_semi")
