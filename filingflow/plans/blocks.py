"""Block mode: batches that share a prompt, in rounds of a table of states.

A document's state is the number of batches its blocks may have and how many blocks in a row went well. A round plans the
next blocks of every document from its state, runs the ladder on them, and settles what was answered. A prompt over the
model's context shrinks the document's blocks, and what is open is planned again; enough good blocks let them grow. A block of
one batch that does not fit goes to the linear mode. Only numbers move from round to round: where a block's text stands in its
document. Prompts are made of the documents where they are asked and never written, as those of a document overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Config, Model
from ..operators import ladder as L
from ..operators import planning as P
from ..operators import prompts
from ..operators.provider import Provider
from ..stages import Stages
from .linear import linear

#: Blocks of a document that one round plans: more make fewer rounds, fewer let sizes follow the answers sooner.
BLOCKS_PER_ROUND = 16


def next_state(state: DataFrame, done: DataFrame, config: Config) -> DataFrame:
    """doc_id, most, good after a round; ``done`` (doc_id, block_no, limited) tells how each of its blocks went.

    Blocks in front of the first that was over the limit count as good ones. A size shrinks by one step at a time, and grows
    by one step when enough blocks in a row were good.
    """
    own, cap = config.batch, config.block.max_batches_per_block
    first = done.groupBy("doc_id").agg(F.min(F.when(F.col("limited"), F.col("block_no"))).alias("_stop"), F.max("block_no").alias("_last"))
    rows = state.join(first, "doc_id", "left").withColumn("_good", F.col("good") + F.coalesce(F.col("_stop") - 1, F.col("_last"), F.lit(0)))
    limited, grown = F.col("_stop").isNotNull() & (F.col("most") > 1), F.col("_good") >= own.grow_after_successes
    most = F.when(limited, P.shrink_size(F.col("most"), 1, own.shrink_factor)).when(F.col("_stop").isNull() & grown, P.grow_size(F.col("most"), cap, own.grow_factor)).otherwise(F.col("most"))
    good = F.when(limited | grown, 0).otherwise(F.col("_good"))
    return rows.select("doc_id", most.cast("int").alias("most"), good.cast("int").alias("good"))


def documents(units: DataFrame) -> DataFrame:
    """doc_id, batches (no, units, sources): the texts of a document, each once; ``units`` have batch_no from 1."""
    each = L.batches_of(units.repartition("doc_id"))
    own = F.struct(F.col("batch").cast("int").alias("no"), "units", "sources")
    return each.groupBy("doc_id").agg(F.sort_array(F.collect_list(own)).alias("batches"))


def batches_of(texts: DataFrame) -> DataFrame:
    """doc_id, batch, no, units, sources of all batches."""
    return texts.select("doc_id", F.explode("batches").alias("b")).select("doc_id", F.col("b.no").cast("string").alias("batch"), "b.*")


def _framed(b: Column) -> Column:
    return prompts.framed(b["no"].cast("string"), b["units"])


def _lines(b: Column) -> Column:
    line = lambda u, s: F.concat(u["id"], F.lit(": "), F.coalesce(L.source_of(u, s), F.lit("")), F.lit("\n"))
    return F.zip_with(b["units"], b["sources"], line)


def sizes_of(texts: DataFrame) -> DataFrame:
    """doc_id, sizes, lines: characters of each batch in a block, and of the line of each of its units."""
    sizes = F.transform("batches", lambda b: F.char_length(_framed(b)) + 2)
    return texts.select("doc_id", sizes.alias("sizes"), F.transform("batches", lambda b: F.transform(_lines(b), F.char_length)).alias("lines"))


def _frames(texts: DataFrame, *more: Column) -> DataFrame:
    return texts.select("doc_id", F.transform("batches", _framed).alias("frames"), *more)


def _own(c: str = "frames") -> Column:
    """The frames of a block's batches."""
    return F.transform("block.nos", lambda n: F.get(F.col(c), n - 1))


def prompted(texts: DataFrame, language: str) -> Callable[[DataFrame], DataFrame]:
    """What adds the prompt of its block to each row."""

    def near(rows: DataFrame) -> DataFrame:
        lines = F.array_join(F.flatten(F.transform("batches", _lines)), "")
        met = rows.join(_frames(texts, lines.alias("lines")), "doc_id")
        part = lambda a, z: F.substring("lines", F.col(f"block.{a}") + 1, F.greatest(F.lit(0), F.col(f"block.{z}") - 1 - F.col(f"block.{a}")))
        body = F.concat(F.lit("["), F.array_join(_own(), ", "), F.lit("]"))
        return met.withColumn("near", prompts.block_prompt(language, part("low", "first"), body, part("last", "high"))).drop("frames", "lines")

    return near


def mini_prompted(texts: DataFrame, language: str) -> Callable[[DataFrame], DataFrame]:
    at = F.array_position("block.nos", L.root().cast("int")).cast("int")
    return lambda rows: L.mini_prompts(rows, _frames(texts), F.struct(_own().alias("frames"), at.alias("at")), language)


def blocks(
    units: DataFrame, primary: Callable[[], Provider], fallback: Callable[[], Provider] | None = None, config: Config | None = None, stages: Stages | None = None, blocks_per_round: int = BLOCKS_PER_ROUND,
) -> tuple[DataFrame, DataFrame]:
    """(results, attempts) of block mode: what is not cached is cut into batches, batches into blocks that share a prompt.

    The token budget of a prompt is dealt to the text before, the block and the text behind; a token is counted as two
    characters. Batches that were answered stay so when their block is planned again. Units that fail alone go to the
    fallback model after all blocks. With ``stages`` of a durable run, what was answered before it stopped is not asked again.
    """
    config = config or Config()
    stages = stages or Stages(units.sparkSession)
    model, own, language = config.model or Model(), config.block, config.target_language
    todo = units.where("not cached").drop("cached") if "cached" in units.columns else units
    batched = P.greedy_batches(todo, min(own.target_batch_units, config.batch.max_units), own.max_batch_chars)
    budget = P.input_budget(model.context_window_tokens, model.max_output_tokens, own.max_input_ratio, max(1, (len(prompts.system(language)) + 1) // 2))
    before, body, after = P.block_budgets(budget, own.before_context_ratio, own.block_body_ratio, own.after_context_ratio)
    key = units.schema["doc_id"].dataType
    schema = L.attempt_schema(key)
    texts = whole = stages.keep(documents(batched), "texts")
    sizes = stages.keep(sizes_of(texts), "sizes")

    second = config.fallback_model or model
    calls, later = (L.Calls(stages, m.max_retries, own.max_workers, language, near=prompted(texts, language)) for m in (model, second))
    start = [F.lit(own.max_batches_per_block).alias("most"), F.lit(0).alias("good"), F.sequence(F.lit(1), F.size("sizes")).alias("open")]
    state = sizes.where("doc_id is not null").select("doc_id", *start)
    turn, n, n_texts = 0, state.count(), None
    while n:
        if n_texts is not None and 2 * n <= n_texts:  # few documents are open: the next rounds read their texts alone
            texts = stages.keep(texts.join(state.select("doc_id"), "doc_id", "left_semi"), "texts")
        if n_texts is None or 2 * n <= n_texts:
            n_texts = n
        calls.near, calls.group = prompted(texts, language), f"attempts/{turn:06d}"
        laid = P.laid_blocks(state.join(sizes, "doc_id"), body, 2 * before, 2 * after, blocks_per_round, L.BLOCK)
        placed = stages.keep(laid.withColumn("turn", F.lit(turn)), "placed")
        asked = F.posexplode(F.transform("block.nos", lambda no: F.struct(no.cast("string").alias("batch"), F.get("batches", no - 1)["units"].alias("units")))).alias("pos", "b")
        rows = placed.join(texts, "doc_id").select("doc_id", "turn", "block", asked).select("doc_id", "b.batch", "b.units", "turn", "block", "pos")
        early = None
        if own.max_workers > 1:
            calls.primed(placed.select("doc_id", "turn", "block"), primary, own.warmup_delay_seconds)
            early = calls.attempt(rows.where("pos = 0"), "primary", primary, replanned=True)
            rows = rows.where("pos > 0")
        climbed = L.climb(rows, calls, primary, True, mini_prompted(texts, language), early)
        singles = stages.keep(climbed.singles, "pending")

        # a limited block keeps the batches whose units are all answered or down to the fallback
        no = L.root().cast("int").alias("no")
        attempts = stages.all(calls.group, schema).where("reason is null and items is not null").select("doc_id", no, F.size("items").alias("n"), F.lit(False).alias("limit"))
        marks = attempts.unionByName(singles.select("doc_id", no, F.lit(1).alias("n"), F.lit(False).alias("limit"))).unionByName(climbed.limited.select("doc_id", F.col("root").cast("int").alias("no"), F.lit(0).alias("n"), F.lit(True).alias("limit")))
        marks = marks.groupBy("doc_id", "no").agg(F.sum("n").alias("n"), F.max("limit").alias("limit"))
        each = placed.select("doc_id", "most", F.col("block.no").alias("block_no"), F.explode(F.arrays_zip(F.col("block.nos").alias("no"), F.col("units").alias("of"))).alias("b")).select("doc_id", "most", "block_no", "b.*")
        each = each.join(marks, ["doc_id", "no"], "left")
        limited = F.max(F.coalesce("limit", F.lit(False))).over(Window.partitionBy("doc_id", "block_no"))
        fate = F.when(F.col("n") == F.col("of"), "answered").when(F.col("limited") & (F.col("most") == 1), "linear")
        settled = stages.keep(each.withColumn("limited", limited).select("doc_id", F.col("no").cast("string").alias("root"), "no", "block_no", "limited", fate.alias("fate"), F.lit(turn).alias("turn")), "settled")
        gone = settled.where("fate is not null").groupBy("doc_id").agg(F.collect_list("no").alias("gone"))
        left = state.join(gone, "doc_id", "left").withColumn("open", F.when(F.col("gone").isNull(), F.col("open")).otherwise(F.array_except("open", "gone"))).where(F.size("open") > 0).drop("gone")
        state = stages.keep(next_state(left, settled.select("doc_id", "block_no", "limited").distinct(), config).join(left.select("doc_id", "open"), "doc_id"), "state")
        turn, n = turn + 1, state.count()

    settled = stages.all("settled", StructType.fromDDL("root string, no int, fate string, turn int").add("doc_id", key))
    good = settled.where("fate = 'answered'").select("doc_id", "root", "turn")
    if fallback is not None:
        pending = stages.all("pending", schema).withColumn("root", L.root()).join(good, ["doc_id", "root", "turn"])
        later.attempt(pending, "fallback", fallback)
    attempts = stages.all("attempts", schema)
    answered = L.results_of(attempts).join(good, ["doc_id", "root", "turn"])
    batches, lost = batches_of(whole), settled.where("fate = 'linear'").select("doc_id", "no")
    if lost.isEmpty():
        return L.with_sources(answered, L.sources_of(batches)), attempts
    unit = lambda u, s: F.struct(u["ordinal"].alias("ordinal"), u["id"].alias("unit_id"), u["text"].alias("text"), L.source_of(u, s).alias("source_text"), F.transform(u["names"], lambda x: F.struct(x.alias("name"))).alias("placeholders"))
    rest = batches.join(lost, ["doc_id", "no"]).select("doc_id", F.explode(F.zip_with("units", "sources", unit)).alias("u")).select("doc_id", "u.*")
    alone, log = linear(stages.keep(rest, "unfit"), primary, fallback, config, stages)
    done = L.sources_of(batches.join(lost, ["doc_id", "no"], "left_anti"))
    return L.with_sources(answered, done).unionByName(alone.select(*L.RESULT)), attempts.unionByName(log, allowMissingColumns=True)
