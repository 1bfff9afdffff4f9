"""Near-duplicate documents by the Jaccard similarity of their word shingles: a prefix-filtered set similarity join.

Shingles have one global order, rare before frequent; two sets of similarity t share a shingle among the first
n - ceil(t n) + 1 of each. Equal sets are collapsed first. Candidates that share a prefix shingle are linked to a few
representatives of that shingle and verified; sets that this leaves outside a shingle's largest component try one member of
it for every shingle they share; only sets that are still in different components are then paired with each other, under the
length and positional filters, and each pair is verified once. So a large group of near copies costs a few tries for each
member, and no link between different components is lost.

A shingle's count is that of its hash's range and ``FINE`` bits below it: shingles that agree there share a count, which moves
both in the order and changes no result, since any fixed order gives the same links. Counts never meet in one place:
documents are dealt over chunks, a chunk sends its different codes by ranges to the tasks that own the ranges, and gets back
how many documents have each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_table, blocks, fresh, joined, mix, ranges, run_hashes, span_hashes, squeezed, widened, words, written
from .components import connected

SHINGLE = 5
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Bytes of text in a chunk and bytes of prefixes in a chunk, on average, and chunks at least.
TEXT_BYTES, PREFIX_BYTES, CHUNKS = 4_000_000, 1_000_000, 48
#: Bits of a shingle's hash, below those that name its range, that tell shingles apart when they are counted.
FINE = 24
#: Rounds of further representatives before the exact last one.
ROUNDS = 2
#: Random-looking constants: each gives another representative of a bucket.
SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B)


def shingles(flat: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): all shingles in order and where each document's begin; a short text has its whole sequence."""
    flat = LOWER[flat]
    start, end, first = words(flat, offsets)
    h = span_hashes(flat, start, end)
    count = np.diff(first)
    runs, document = run_hashes(h, first, size)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.array([_sequence(h[first[k] : first[k + 1]]) for k in short], np.uint64)
        at = np.searchsorted(document, short)
        runs, document = np.insert(runs, at, whole), np.insert(document, at, short)
    return runs, np.searchsorted(document, np.arange(len(count) + 1))


def _sequence(h: np.ndarray) -> np.uint64:
    total = np.array([len(h)], np.uint64)
    for x in h:
        with np.errstate(over="ignore"):
            total = mix(total * np.uint64(0xA24BAED4963EE407) + x)
    return total[0]


# --- the order: how many documents have a shingle --------------------------------------------------------------------


def _codes(h: np.ndarray, parts: int) -> np.ndarray:
    """The range of a hash and, below it, ``FINE`` bits: what is counted. Two shingles with one code share their count,
    which moves both in the order and changes no result."""
    return h // np.uint64((1 << 64) // (parts << FINE) + 1)


def _gaps(code: np.ndarray) -> bytes:
    """Sorted different codes as 16-bit differences; 65535 means as much and more to come."""
    gap = np.diff(code, prepend=np.uint64(0)).astype(np.int64)
    out = np.full(len(gap) + int((gap // 65535).sum()), 65535, np.uint16)
    out[np.arange(len(gap)) + np.cumsum(gap // 65535)] = gap % 65535
    return out.tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    gap = np.frombuffer(data, np.uint16)
    return np.cumsum(gap, dtype=np.int64)[gap != 65535]


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, row after the last, sorted shingles of each document) for blocks of rows."""
    for i, j, flat, offsets in blocks(batch):
        h, bound = shingles(flat, offsets)
        yield i, j, [np.unique(h[s:e]) for s, e in zip(bound, bound[1:], strict=False)]


def _levels(documents: DataFrame, parts: int) -> DataFrame:
    """chunk, part, levels: how many documents have each of the chunk's codes, in the order of the codes."""

    def send(key, table):
        code, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in table.combine_chunks().to_batches():
            for _, _, sets in _sets(b):
                code, back = np.unique(np.concatenate([code, *(_codes(s, parts) for s in sets)]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n, np.ones(len(back) - len(n), np.int64)]), len(code)).astype(np.int64)
        edges = np.searchsorted(code, np.arange(parts + 1, dtype=np.uint64) << np.uint64(FINE)).tolist()
        rows = [(p, key[0].as_py(), _gaps(code[a:b] - np.uint64(p << FINE)), squeezed(n[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return arrow_table("part int, chunk int, codes binary, counts binary", rows)

    def answer(key, table):
        codes = [_from_gaps(x) for x in table.column("codes").to_pylist()]
        _, back = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.concatenate([widened(x, np.uint32) for x in table.column("counts").to_pylist()])
        level = np.minimum(np.bincount(back, n), 0xFFFFFFFF).astype(np.uint32)[back]
        edges = np.cumsum([0, *map(len, codes)])
        return arrow_table("chunk int, part int, levels binary", [(c, key[0].as_py(), squeezed(level[a:b])) for c, a, b in zip(table.column("chunk").to_pylist(), edges, edges[1:], strict=False)])

    sent = documents.groupBy("chunk").applyInArrow(send, "part int, chunk int, codes binary, counts binary")
    return sent.groupBy("part").applyInArrow(answer, "chunk int, part int, levels binary")


PREFIXES = "doc_id long, n int, node long, check long, prefix binary, hashes binary"


def _digests(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, whatever its order."""
    with np.errstate(over="ignore"):
        one, two = mix(h ^ np.uint64(0x6A09E667F3BCC908)).sum(dtype=np.uint64), mix(h ^ np.uint64(0xBB67AE8584CAA73B)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def prefixes(documents: DataFrame) -> DataFrame:
    """The size and the digests of each document's set, with its prefix, rarest shingle first, and its sorted shingles.

    A chunk gives prefix and shingles of equal sets once, and only if another document has a shingle of the prefix; the
    other rows have neither.
    """
    total = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(CHUNKS, -(-total // TEXT_BYTES))
    rows = documents.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    levels = written(_levels(rows, chunks), "levels")

    def run(key, left, right):
        level = np.concatenate([np.zeros(0, np.uint32), *(widened(x, np.uint32) for x in right.sort_by("part").column("levels").to_pylist())])
        left = left.combine_chunks()
        code = np.zeros(0, np.uint64)
        for b in left.to_batches():
            for _, _, sets in _sets(b):
                code = np.unique(np.concatenate([code, *(_codes(s, chunks) for s in sets)]))
        met, rows, ids = set(), [], []
        for b in left.to_batches():
            for i, j, sets in _sets(b):
                every = np.concatenate(sets)
                own = level[np.searchsorted(code, _codes(every, chunks))]
                at = 0
                for s in sets:
                    mine, n = own[at : at + len(s)], len(s)
                    at += n
                    digests = _digests(s)
                    prefix = hashes = None
                    if n and digests not in met:
                        size = n - -(-n * NUMERATOR // DENOMINATOR) + 1
                        first = np.argsort(mine, kind="stable")[:size]
                        if mine[first[-1]] > 1:
                            prefix, hashes = s[first].tobytes(), s.tobytes()
                    met.add(digests)
                    rows.append((n, *digests, prefix, hashes))
                ids.append(b.column("doc_id")[i:j])
        made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
        return pa.table([pa.chunked_array(ids, pa.int64()), *made], names=[x.split()[0] for x in PREFIXES.split(", ")])

    return rows.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(run, PREFIXES)


ENTRIES = "h long, node long, doc_id long, n int, pos int"


def shared_entries(table: DataFrame) -> DataFrame:
    """h, node, doc_id, n, pos: the prefix shingles that two different sets have, a row for each set.

    Most prefix shingles stand in one set only. So sets are dealt over chunks by their digest, a chunk sends its distinct
    shingles to the tasks that own ranges of them, and gets back those that another set has too.
    """
    rows = table.where("prefix is not null")
    total = rows.agg(F.sum(F.octet_length("prefix").cast("long"))).first()[0] or 0
    chunks = max(CHUNKS, -(-total // PREFIX_BYTES))
    rows = rows.withColumn("chunk", F.pmod("node", F.lit(chunks)).cast("int")).select("chunk", "doc_id", "n", "node", "check", "prefix")

    def own(table):
        """The chunk's different sets: their rows and their prefixes, one after another."""
        table = table.sort_by([("node", "ascending"), ("check", "ascending"), ("doc_id", "ascending")])
        node, check = (table.column(c).to_numpy() for c in ("node", "check"))
        first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (check[1:] != check[:-1])))
        table = table.take(first)
        parts = [np.frombuffer(x, np.uint64) for x in table.column("prefix").to_pylist()]
        return table, np.concatenate(parts), np.array([len(x) for x in parts])

    def send(key, table):
        _, h, _ = own(table)
        h, n = np.unique(h, return_counts=True)
        edges = ranges(h, chunks)
        sent = [(p, key[0].as_py(), h[a:b].tobytes(), np.minimum(n[a:b], 2).astype(np.int8).tobytes()) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return arrow_table("part int, chunk int, hashes binary, counts binary", sent)

    def answer(key, table):
        sizes = [len(x) // 8 for x in table.column("hashes").to_pylist()]
        h, n = joined(table.column("hashes"), np.uint64), joined(table.column("counts"), np.int8)
        _, back = np.unique(h, return_inverse=True)
        shared = np.bincount(back, n)[back] > 1
        edges = np.cumsum([0, *sizes])
        told = [(c, h[a:b][shared[a:b]].tobytes()) for c, a, b in zip(table.column("chunk").to_pylist(), edges, edges[1:], strict=False)]
        return arrow_table("chunk int, hashes binary", [t for t in told if t[1]])

    def keep(key, left, right):
        shared = np.sort(joined(right.column("hashes"), np.uint64))
        if not len(shared) or not left.num_rows:
            return arrow_table(ENTRIES, [])
        table, h, size = own(left)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        at = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h)
        row = table.select(["node", "doc_id", "n"]).take(np.repeat(np.arange(len(size)), size)[at])
        return pa.table({"h": pa.array(h[at].view(np.int64)), "node": row.column("node"), "doc_id": row.column("doc_id"), "n": row.column("n"), "pos": pa.array(pos[at].astype(np.int32))})

    sent = rows.groupBy("chunk").applyInArrow(send, "part int, chunk int, hashes binary, counts binary")
    told = sent.groupBy("part").applyInArrow(answer, "chunk int, hashes binary")
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(keep, ENTRIES)


def sets_of(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes: the sorted shingles of the wanted (doc_id, node) rows."""
    named = wanted.select(F.col("doc_id").alias("_d"), F.col("node").alias("_n"))
    return table.where("hashes is not null").join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("node") == F.col("_n"))).select("node", "hashes")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link. The suffix filter comes first: shingles that fall into different sixteenths of the
    hash range cannot be shared, so the smaller counts of each sixteenth bound the overlap."""
    need = -(-NUMERATOR * (len(x) + len(y)) // (NUMERATOR + DENOMINATOR))
    cuts = (np.arange(1, 16, dtype=np.uint64)) << np.uint64(60)
    p, q = (np.diff(np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])) for s in (x, y))
    if np.minimum(p, q).sum() < need:
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of different nodes whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _reach(n, m):
    """Whether sizes n and m can reach the similarity."""
    return (DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m))


def star_pairs(entries: DataFrame) -> DataFrame:
    """Each entry with a representative set of its shingle, ``rep``, and that set's size and position: one of few seeds' choices."""
    seed = F.element_at(F.array(*[F.lit(x) for x in SEEDS]), (F.pmod("h", F.lit(len(SEEDS))) + 1).cast("int"))
    reps = entries.groupBy("h").agg(F.min(F.struct(F.col("node").bitwiseXOR(seed).alias("x"), "n", "pos")).alias("best"))
    reps = reps.select(F.col("h").alias("_h"), F.col("best.x").bitwiseXOR(seed).alias("rep"), F.col("best.n").alias("rep_n"), F.col("best.pos").alias("rep_pos"))
    return entries.join(written(reps, "representatives"), F.col("h") == F.col("_h")).drop("_h")


def _open(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of shingles whose sets lie in several components, with their component and the shingle's largest one."""
    placed = entries.join(labels.select(F.col("node").alias("_n"), F.col("label").alias("part")), F.col("node") == F.col("_n"), "left").drop("_n").withColumn("part", F.coalesce("part", "node"))
    sizes = placed.groupBy("h", "part").agg(F.count("*").alias("c"))
    main = sizes.groupBy("h").agg(F.count("*").alias("k"), F.max(F.struct("c", "part")).alias("m")).where("k > 1").select(F.col("h").alias("_h"), F.col("m.part").alias("main"))
    return placed.join(main, F.col("h") == F.col("_h")).drop("_h")


def more_stars(entries: DataFrame, labels: DataFrame, salt: int) -> DataFrame:
    """Pairs (a, b) of each set outside a shingle's largest component with one set inside, another for every shingle: as
    many pairs as entries at most, and many tries for a set that shares many shingles with a group."""
    split = _open(entries, labels)
    inside = split.where("part = main").groupBy("h").agg(F.min(F.struct(F.xxhash64("node", "h", F.lit(salt)).alias("x"), "node", "n")).alias("best"))
    inside = inside.select(F.col("h").alias("_h"), F.col("best.node").alias("rep"), F.col("best.n").alias("rep_n"))
    met = split.where("part <> main").join(written(inside, "representatives"), F.col("h") == F.col("_h")).where(_reach(F.col("n"), F.col("rep_n")))
    return met.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()


def rest_pairs(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of nodes in different components that share a prefix shingle and pass the length and positional filters.

    In each bucket every node outside the bucket's largest component meets the nodes of other components; buckets within one
    component give nothing.
    """
    open_ = _open(entries, labels)
    x = open_.where("part <> main").select("h", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("part").alias("ca"))
    y = open_.select(F.col("h").alias("hb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("part").alias("cb"), (F.col("part") == F.col("main")).alias("big"))
    near = (F.col("ca") != F.col("cb")) & (F.col("big") | (F.col("a") < F.col("b"))) & _reach(F.col("na"), F.col("nb"))
    # what lies from a pair's first shared shingle on must hold the whole overlap; later shared ones need not be met here
    need = (F.col("na") + F.col("nb")) * NUMERATOR
    first = (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (NUMERATOR + DENOMINATOR)) >= need
    met = x.join(y, (F.col("h") == F.col("hb")) & near & first)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ids(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, node: a document of each set in the pairs."""
    wanted = pairs.select(F.col("a").alias("_n")).union(pairs.select("b")).distinct()
    return entries.select("doc_id", "node").distinct().join(wanted, F.col("node") == F.col("_n"), "left_semi")


def components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``documents``.

    A text's set holds its distinct five-word shingles over A-Z lower-cased words; with fewer words, the whole sequence.
    Null texts and texts without words have no shingles and are components of their own. Equal sets always link. A
    component's id is its smallest doc_id; null doc_ids take part but are not smallest unless alone. Sets are known by a
    64-bit digest. Repeated rows stay; an empty table gives an empty result; other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = written(prefixes(rows), "prefixes")
    entries = written(shared_entries(table), "entries")
    near = star_pairs(entries).where((F.col("node") != F.col("rep")) & _reach(F.col("n"), F.col("rep_n")))
    stars = written(near.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct(), "stars")
    labels = connected(verified(stars, written(sets_of(table, _ids(stars, entries)), "sets")))
    bare, tried = entries.drop("doc_id"), stars
    for step in (*range(ROUNDS), None):  # the last one is exact: all pairs that are left
        pairs = rest_pairs(bare, labels) if step is None else more_stars(bare, labels, step)
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = written(verified(pairs, written(sets_of(table, _ids(pairs, entries)), "sets")), "links")
        labels = written(_merged(labels, connected(_between(links, labels))), "labels")
        tried = tried.union(pairs)
    final = labels
    placed = table.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node").join(final, "node", "left").withColumn("part", F.coalesce("label", "node"))
    least = placed.where("n_shingles > 0").groupBy(F.col("part").alias("_p")).agg(F.min("doc_id").alias("component_id"))
    joined = placed.join(least, (F.col("part") == F.col("_p")) & (F.col("n_shingles") > 0), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between nodes as edges between their components."""
    la, lb = (labels.select(F.col("node").alias(f"_{c}"), F.col("label").alias(f"l{c}")) for c in "ab")
    out = edges.join(la, F.col("a") == F.col("_a"), "left").join(lb, F.col("b") == F.col("_b"), "left")
    return out.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))


def _merged(labels: DataFrame, later: DataFrame) -> DataFrame:
    """node, label over both rounds: nodes of the first by the component of their component, new ones by their own."""
    second = later.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    old = labels.join(second, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
    new = later.join(labels.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti")
    return old.unionByName(new)


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component: the one whose doc_id is the component's id.

    Rows that repeat that doc_id stay together; all columns of the input stay as they are.
    """
    name = fresh(documents, "id")
    first = components(documents).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(first, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
