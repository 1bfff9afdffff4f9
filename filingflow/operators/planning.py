"""Batches, contexts and blocks: order-dependent folds over a document's units, and windows.

A greedy fold resets itself by its own running sum, which no window expresses; it runs over the array of one document's
sizes, in Arrow batches and linear time. Texts do not enter it. Units are rows of ``doc_id, ordinal, unit_id, text, source_text`` and, for batches, an optional boolean ``cached``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..session import fresh


def _folded(step: Callable[[], Callable[[int, bool], int | None]]):
    """A column function from arrays of sizes and flags to the array of numbers that a fresh ``step`` gives them in turn."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(sizes: pd.Series, flags: pd.Series) -> pd.Series:
        out = []
        for own, marks in zip(sizes, flags, strict=True):
            number = step()
            out.append([number(int(x), bool(m)) for x, m in zip(own, marks, strict=True)])
        return pd.Series(out)

    return run


def greedy_batches(units: DataFrame, max_units: int = 40, max_chars: int = 20_000) -> DataFrame:
    """``units`` with ``batch_no`` from 1: a batch ends before the unit that would pass either limit; a longer unit stands
    alone. A cached unit has batch_no null and ends the batch before it.

    The fold is sequential by nature, so it runs over one document's lengths; documents run in parallel.
    """
    cached = F.coalesce(F.col("cached"), F.lit(False)) if "cached" in units.columns else F.lit(False)
    item = F.struct("ordinal", F.char_length("text").alias("size"), cached.alias("cached"))
    lists = units.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def start() -> Callable[[int, bool], int | None]:
        no = n = chars = 0

        def number(size: int, skip: bool) -> int | None:
            nonlocal no, n, chars
            if skip:
                n = 0
                return None
            if n == 0 or n >= max_units or chars + size > max_chars:
                no, n, chars = no + 1, 0, 0
            n, chars = n + 1, chars + size
            return no

        return number

    numbered = lists.withColumn("no", _folded(start)(F.transform("items", lambda x: x["size"]), F.transform("items", lambda x: x["cached"])))
    doc, place = fresh(units, "doc"), fresh(units, "place")
    pairs = numbered.select(F.col("doc_id").alias(doc), F.explode(F.arrays_zip(F.transform("items", lambda x: x["ordinal"]).alias("o"), F.col("no"))).alias("b"))
    numbers = pairs.select(doc, F.col("b.o").alias(place), F.col("b.no").alias("batch_no"))
    return units.join(numbers, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("ordinal") == F.col(place)), "left").drop(doc, place)


def shrink_size(size: Column, least: int, factor: float) -> Column:
    """A smaller batch; at the last rung one unit is always allowed, so that a failing batch ends."""
    smaller = F.greatest(F.lit(least), F.floor(size * factor)).cast("int")
    return F.when(smaller < size, smaller).otherwise(F.greatest(F.lit(1), size - 1)).cast("int")


def grow_size(size: Column, most: int, factor: float) -> Column:
    return F.greatest(size, F.least(F.lit(most), F.greatest(size + 1, F.floor(size * factor)))).cast("int")


def context_lines(units: DataFrame) -> DataFrame:
    """doc_id, place, line, line_start, line_end: each unit's line with the characters before and up to it. Prefix sums have
    no reset, so they serve every later choice of batches or blocks. Units are numbered by ``ordinal`` without gaps."""
    line = F.concat(F.col("unit_id"), F.lit(": "), F.col("source_text"))
    rows = units.select("doc_id", F.col("ordinal").alias("place"), line.alias("line"))
    rows = rows.withColumn("line_end", F.sum(F.char_length("line") + 1).over(Window.partitionBy("doc_id").orderBy("place")))
    return rows.withColumn("line_start", F.col("line_end") - F.char_length("line") - 1)


def context_of(lines: DataFrame, spans: DataFrame, key: str, before: bool, budget: int) -> DataFrame:
    """doc_id, key, context: the nearest lines before or behind each span (doc_id, key, first, last: its places) within the
    budget of characters, one at least."""
    edge, name = ("first", "line_start") if before else ("last", "line_end")
    at = lines.select("doc_id", F.col("place").alias(edge), F.col(name).alias("_edge"))
    spans = spans.join(at, ["doc_id", edge])
    other = lines.select(F.col("doc_id").alias("_d"), F.col("place").alias("_o"), F.col("line").alias("_line"), F.col("line_start").alias("_ls"), F.col("line_end").alias("_le"))
    # a line is near if it starts within the budget before the span (or ends within it behind): cells of the budget's width
    # keep the join to neighbours; the next line is near in any case
    own, far = (F.col("_ls"), -1) if before else (F.col("_le"), 1)
    cell, edged = F.floor(F.col("_edge") / budget), F.col("_edge")
    cells = spans.withColumn("_cell", F.explode(F.array(cell, cell + far)))
    inside = (own < edged) & (edged - own <= budget) if before else (own > edged) & (own - edged <= budget)
    met = cells.join(other.withColumn("_own", F.floor(own / budget)), (F.col("doc_id") == F.col("_d")) & (F.col("_cell") == F.col("_own")) & inside).select("doc_id", key, "_o", "_line")
    next_line = F.col("first") - 1 if before else F.col("last") + 1
    met = met.union(spans.join(other, (F.col("doc_id") == F.col("_d")) & (F.col("_o") == next_line)).select("doc_id", key, "_o", "_line"))
    listed = F.sort_array(F.collect_set(F.struct("_o", "_line")))
    return met.groupBy("doc_id", key).agg(F.array_join(F.transform(listed, lambda x: x["_line"]), "\n").alias("context"))


def contexts_of(lines: DataFrame, spans: DataFrame, key: str, before_chars: int, after_chars: int) -> DataFrame:
    """``spans`` (doc_id, key, first, last) with context_before and context_after; no budget means no context, and a document's
    first span has none before it."""
    out = spans
    for before, chars, name in ((True, before_chars, "context_before"), (False, after_chars, "context_after")):
        got = context_of(lines, spans, key, before, chars).withColumnRenamed("context", name) if chars > 0 else None
        out = out.join(got, ["doc_id", key], "left").fillna("", [name]) if got is not None else out.withColumn(name, F.lit(""))
    return out


def with_contexts(units: DataFrame, before_chars: int = 3000, after_chars: int = 2000) -> DataFrame:
    """doc_id, batch_no, context_before, context_after of every batch of ``greedy_batches``; ordinals are consecutive."""
    spans = units.where("batch_no is not null").groupBy("doc_id", "batch_no").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    return contexts_of(context_lines(units), spans, "batch_no", before_chars, after_chars).drop("first", "last")


def input_budget(window: int, max_output: int, ratio: float, system_tokens: int) -> int:
    """Tokens of a block's prompt: a share of the window that leaves room for the answer, 64 at least."""
    window = max(window, 1024)
    return max(64, min(int(window * ratio), window - max_output) - system_tokens)


def block_budgets(budget: int, before: float, body: float, after: float) -> tuple[int, int, int]:
    total = before + body + after
    return int(budget * before / total), max(1, int(budget * body / total)), int(budget * after / total)


def json_size(text: Column, unit_id: Column) -> Column:
    """Characters of ``{"id": …, "text": …}`` with the default separators and unescaped non-ASCII text."""
    compact = F.char_length(F.to_json(F.struct(unit_id.alias("id"), text.alias("text"))))
    return (compact + 3).cast("long")  # one space behind each colon and behind the comma


#: The frame of a batch in a block, and what joins it to the next.
FRAME = len('{"batch_id": "batch_001", "items": []}') + 2


def batch_sizes(units: DataFrame) -> DataFrame:
    """doc_id, batch_no, size: characters of each batch's JSON in a block."""
    rows = units.where("batch_no is not null").groupBy("doc_id", "batch_no")
    return rows.agg((F.sum(json_size(F.col("text"), F.col("unit_id"))) + 2 * F.count("*") - 2 + FRAME).alias("size"))


def _fold_block(sizes: Iterable[int], limit: int, budget: int) -> list[int]:
    no = n = chars = 0
    numbers = []
    for size in sizes:
        if n == 0 or n >= limit or (chars + int(size) + 1) // 2 > budget:
            no, n, chars = no + 1, 0, 0
        n, chars = n + 1, chars + int(size)
        numbers.append(no)
    return numbers


@F.pandas_udf(ArrayType(IntegerType()))
def _fold_blocks(sizes: pd.Series, most: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([_fold_block(*row) for row in zip(sizes, most, tokens, strict=True)])


def number_blocks(sizes: DataFrame, body_tokens: int) -> DataFrame:
    """doc_id, batch_no, block_no for rows doc_id, batch_no, size, most: consecutive batches share a block while their JSON
    fits the body budget and their count the document's limit; the first batch of a block always fits."""
    lists = sizes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("batch_no", "size"))).alias("items"), F.first("most").alias("most"))
    numbered = lists.withColumn("no", _fold_blocks(F.transform("items", lambda x: x["size"]), "most", F.lit(body_tokens)))
    pairs = numbered.select("doc_id", F.explode(F.arrays_zip(F.transform("items", lambda x: x["batch_no"]).alias("batch_no"), F.col("no"))).alias("b"))
    return pairs.select("doc_id", F.col("b.batch_no").alias("batch_no"), F.col("b.no").alias("block_no"))


def plan_blocks(units: DataFrame, body_tokens: int, max_batches: int = 20) -> DataFrame:
    """doc_id, batch_no, block_no of all batches, with one limit for all documents."""
    return number_blocks(batch_sizes(units).withColumn("most", F.lit(max_batches)), body_tokens)


def blocks_from(open_: list[int], sizes: list[int], lines: list[list[int]], most: int, body_tokens: int, before_chars: int, after_chars: int, first_blocks: int) -> list[dict]:
    """The first blocks of the batches that are open: their numbers and how many units each has, and the characters of the
    document's lines at which the text before, the block, and the text behind begin and end.

    ``sizes`` and ``lines`` are of all batches: their JSON, and the lines of their units with what ends them. Text around a
    block are the nearest whole lines within the budget of characters, one at least; no budget means none.
    """
    ends = list(accumulate(n for own in lines for n in own))
    starts, firsts = [0, *ends[:-1]], list(accumulate((len(own) for own in lines), initial=0))
    blocks: dict[int, list[int]] = {}
    for no, block in zip(open_, _fold_block((sizes[n - 1] for n in open_), most, body_tokens), strict=True):
        if block > first_blocks:
            break
        blocks.setdefault(block, []).append(no)
    out = []
    for k, nos in blocks.items():
        a, z = firsts[nos[0] - 1], firsts[nos[-1]] - 1
        first, last = starts[a], ends[z]
        low = starts[min(bisect_left(starts, first - before_chars), a - 1)] if a and before_chars > 0 else first
        high = ends[max(bisect_right(ends, last + after_chars) - 1, z + 1)] if z + 1 < len(ends) and after_chars > 0 else last
        out.append({"block": {"no": k, "nos": nos, "low": low, "first": first, "last": last, "high": high}, "units": [len(lines[n - 1]) for n in nos]})
    return out


def laid_blocks(rows: DataFrame, body_tokens: int, before_chars: int, after_chars: int, first_blocks: int, block: str) -> DataFrame:
    """doc_id, most, block, units: a row for each of the first blocks of a document. ``rows`` (doc_id, most, open, sizes, lines)
    are numbers alone; ``block`` is the type of that column."""
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(f"most int, block {block}, units array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part, at, found = b.slice(k, 200), [], []
                for n, r in enumerate(part.select(["most", "open", "sizes", "lines"]).to_pylist()):
                    own = blocks_from(r["open"], r["sizes"], r["lines"], r["most"], body_tokens, before_chars, after_chars, first_blocks)
                    at += [n] * len(own)
                    found += [{"most": r["most"], **x} for x in own]
                cols = [pa.array([x[c] for x in found], fields.field(c).type) for c in ("most", "block", "units")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int64())), *cols], names=schema.names)

    return rows.select("doc_id", "most", "open", "sizes", "lines").mapInArrow(run, schema)


def mini_blocks(batches: DataFrame, reach: int = 2) -> DataFrame:
    """``batches`` (doc_id, block_no, batch_no, items) with ``near``: the batches up to ``reach`` around each in its block."""
    around = Window.partitionBy("doc_id", "block_no").orderBy("batch_no").rowsBetween(-reach, reach)
    return batches.withColumn("near", F.collect_list(F.struct("batch_no", "items")).over(around))

