"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for a key, and the key goes to the shard with the best draw. A draw depends on the key and the
shard alone, so another shard changes only the keys that it wins, and a shard of weight w gets w times as many keys as one
of weight 1. All of it is DataFrame expressions; only keys, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

#: Hexadecimal digits of md5 that make a draw: below 2**52, so that a draw is exact as a double.
DIGITS = 13


def draw(key: Column, shard: Column) -> Column:
    """A uniform integer in [0, 2**52) for a key and a shard."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, DIGITS), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 .. len(weights)-1) with the largest ``-weight / ln(draw)``; ties go to the larger shard number.

    A null key counts as the empty string. A weight of 0 gives a shard no keys.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must hold a positive weight and none below 0")
    key = F.coalesce(key.cast("string"), F.lit(""))
    equal = len(set(weights)) == 1
    best = []
    for shard, weight in enumerate(weights):
        if weight:
            u = draw(key, F.lit(shard))
            # with equal weights the draws themselves have the same order
            score = u if equal else F.lit(-float(weight)) / F.log((u + F.lit(0.5)) / F.lit(float(16**DIGITS)))
            best.append(F.struct(score.alias("score"), F.lit(shard).alias("shard")))
    return (F.greatest(*best) if len(best) > 1 else best[0])["shard"]


def assign_shards(records: DataFrame, key: str, weights: Sequence[float], grown_weights: Sequence[float] | None = None) -> DataFrame:
    """``records`` with ``shard`` and, if grown weights are given, ``grown_shard``: one narrow transformation, no shuffle.

    Columns of those names that the input has are replaced. Repeated keys go to the same shard; an empty table gives an
    empty table.
    """
    out = records.withColumn("shard", rendezvous(F.col(key), weights))
    return out.withColumn("grown_shard", rendezvous(F.col(key), grown_weights)) if grown_weights else out


#: Rows of a part that is numbered on its own, on average, and copies of a row that one piece of it stands for.
PART_ROWS, PIECE = 1_000_000, 100_000


def numbered(records: DataFrame, shard: str, order: Sequence[str], parts: int, weight: str) -> DataFrame:
    """``records`` with ``slot``: each row takes as many slots as ``weight`` says, and has the first of them. Slots are gapless
    from 0 within each shard, without sorting a shard in one task.

    The rows of a shard are dealt over ``parts`` by a hash of the ordering columns, in which no two rows agree; parts are
    numbered on their own and then shifted by the slots in earlier parts. The table of shifts has at most shards * parts rows.
    """
    part = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])), 1, 8), 16, 10).cast("long")
    p, own_slot, s, q, rest, n = (fresh(records, c) for c in ("part", "rank", "s", "p", "shift", "rows"))
    dealt = records.withColumn(p, (part % parts).cast("int"))
    before = Window.partitionBy(shard).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(shard, p).agg(F.sum(weight).alias(n))
    shift = counts.select(F.col(shard).alias(s), F.col(p).alias(q), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(rest))
    own = Window.partitionBy(shard, p).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = dealt.withColumn(own_slot, F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(weight))
    joined = ranked.join(shift, (F.col(shard) == F.col(s)) & (F.col(p) == F.col(q)))
    return joined.withColumn("slot", (F.col(own_slot) + F.col(rest)).cast("long")).drop(p, own_slot, s, q, rest)


def shard_layout(documents: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``documents``.

    The size is the UTF-8 bytes of the text plus 8; a null text has no bytes and the checksum of none. Repeated rows stay
    and get slots of their own, next to each other; a null doc_id is the empty key. Other columns of the input are not read.
    Rows that agree in all of the result but their slot are counted before they are shuffled and numbered, and made again
    behind that, so that a row that repeats without end is one row on its way.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    distinct = written(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times")), "layout")
    parts = max(64, (distinct.count() // shards) // PART_ROWS)
    out = numbered(assign_shards(distinct, "doc_id", [1.0] * shards, [1.0] * (shards + 1)), "shard", ["doc_id", "text_crc32", "size"], parts, "times")
    # copies in two steps, so that no array holds all of them
    pieces = out.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / PIECE).cast("long"))))
    rest = F.least(F.lit(PIECE).cast("long"), F.col("times") - F.col("piece") * PIECE) - 1
    out = pieces.withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), rest), lambda k: k + F.col("slot") + F.col("piece") * PIECE)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
