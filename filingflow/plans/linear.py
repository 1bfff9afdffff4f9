"""Linear mode: a document call by call, in rounds of a table of states.

A document's state is its next place, its batch size and its successes in a row. A round joins each open document's state
with the units in reach of it, makes a bounded number of calls from there, and writes the new state with what was answered
and the log; documents are asked side by side, a bounded number at a time. So no document is ever held whole, a lost task
repeats one round's calls of its documents, and a durable run goes on with the last round that was finished.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config, Model
from ..functions.text import FORMAT_ERRORS
from ..operators import prompts
from ..operators.provider import USAGE, Client, Provider, _Clients, pooled
from ..operators.responses import answered, first_failure
from ..stages import Stages

#: Calls of a document in one round; its fallback and strict ones among them, the last batch may take two more. Later rounds
#: make half as many as all before them, so that a long document takes few rounds, up to a bound on what is held of it.
CALLS_PER_ROUND = 8
MOST_CALLS = 256

LOG = "array<struct<rung:string,model:string,reason:string," + ",".join(f"{c}:bigint" for c in USAGE) + ">>"
FOUND = "array<struct<ordinal:int,unit_id:string,source_text:string,result:string,provider:string,rung:string,batch_size:int,call:int>>"
ROUND = f"next int, size int, good int, calls int, n int, found {FOUND}, log {LOG}"
#: Characters that a context's line takes at least: an id, what joins it to the text, and the line's end.
LEAST_LINE = 4


def shrunk(size: int, batch: int, config: Config) -> int:
    """The next size after a batch failed: a step smaller, and smaller than the batch, so that a failing one ends."""
    own = config.batch
    return max(1, min(max(own.min_units, int(size * own.shrink_factor)), batch - 1))


def grown(size: int, config: Config) -> int:
    own = config.batch
    return max(size, min(own.max_units, max(size + 1, int(size * own.grow_factor))))


def around(units: list[dict], at: int, step: int, budget: int) -> str:
    """The lines next to a place, walking away from it while they fit the budget, one at least; in document order."""
    lines, left = [], budget
    while 0 <= at < len(units) and budget > 0:
        line = f"{units[at]['unit_id']}: {units[at]['source_text']}"
        if lines and len(line) + 1 > left:
            break
        lines.append(line)
        left -= len(line) + 1
        at += step
    return "\n".join(lines[::step])


class Walk:
    """Some calls of one document from its state on; ``units`` are those in reach, and ``base`` is the place of the first."""

    def __init__(self, row: dict[str, Any], primary: Client, fallback: Client | None, config: Config):
        self.units, self.base = row["units"], row["units"][0]["place"]
        self.next, self.size, self.good, self.calls, self.n = (row[c] for c in ("next", "size", "good", "calls", "n"))
        self.primary, self.fallback, self.config = primary, fallback, config
        self.found: list[dict] = []
        self.log: list[dict] = []

    def ask(self, client: Client, batch: list[dict], rung: str, strict: bool = False) -> tuple[list[dict] | None, str | None]:
        """(items, reason) of one call; any failure of the call is its reason."""
        own, at, language = self.config.batch, self.next - self.base, self.config.target_language
        context = prompts.context_prompt(language, around(self.units, at - 1, -1, own.previous_context_chars), around(self.units, at + len(batch), 1, own.next_context_chars))
        units = [{"id": u["unit_id"], "text": u["text"]} for u in batch]
        task = "# Task\n" + "\n".join(f"{u['id']}: {u['text']}" for u in units) + (prompts.REMINDER if strict else "")
        model, response, error, *used = client.ask({"rung": rung, "units": units, "prompt": f"{context}\n{task}", "system": prompts.system(language)})
        items, reason = (None, f"provider_error: {error}") if error else answered(response)
        reason = reason or first_failure(batch, items)
        self.calls += 1
        self.log.append({"rung": rung, "model": model, "reason": reason, **dict(zip(USAGE, used, strict=True))})
        return items, reason

    def keep(self, batch: list[dict], texts: list[str], provider: str, rung: str) -> None:
        self.found += [{**{c: u[c] for c in ("unit_id", "ordinal", "source_text")}, "result": t, "provider": provider, "rung": rung, "batch_size": len(batch), "call": self.calls} for u, t in zip(batch, texts, strict=True)]

    def alone(self, unit: dict) -> None:
        """The fallback's answer to a unit that the primary model failed alone, or its source."""
        if self.fallback is not None:
            items, reason = self.ask(self.fallback, [unit], "fallback")
            if reason is None:
                return self.keep([unit], [items[0]["text"]], self.fallback.provider.model, "fallback")
        return self.keep([unit], [unit["source_text"]], "source", "source")

    def batch(self) -> list[dict]:
        """The next batch: cached units are passed by and end it, as do the size and the characters."""
        at = self.next - self.base
        while at < len(self.units) and self.units[at]["cached"]:
            at += 1
        self.next = at + self.base
        lines = self.config.batch.next_context_chars // LEAST_LINE + 1
        if self.base + len(self.units) < self.n and at + self.size + lines > len(self.units):
            return []  # cached units have used up the reach: the next round goes on from here
        out, chars = [], 0
        for u in self.units[at : at + self.size]:
            if u["cached"] or (out and chars + len(u["text"]) > self.config.batch.max_batch_chars):
                break
            out.append(u)
            chars += len(u["text"])
        return out

    def run(self, most: int) -> dict[str, Any]:
        while self.next < self.n and len(self.log) < most and (batch := self.batch()):
            items, reason = self.ask(self.primary, batch, "primary")
            if reason in FORMAT_ERRORS:
                items, reason = self.ask(self.primary, batch, "strict", True)
            if reason is None:
                self.keep(batch, [x["text"] for x in items], self.primary.provider.model, "primary")
                self.good += 1
                if self.good >= self.config.batch.grow_after_successes:
                    self.size, self.good = grown(self.size, self.config), 0
            elif len(batch) > 1:
                self.size, self.good = shrunk(self.size, len(batch), self.config), 0
                continue
            else:
                self.alone(batch[0])
            self.next += len(batch)
        return {c: getattr(self, c) for c in ("next", "size", "good", "calls", "n", "found", "log")}


def reach(config: Config, calls: int) -> tuple[int, int]:
    """(units before, units behind) a state's place that its next calls can need: batches, and lines of both contexts."""
    own = config.batch
    return own.previous_context_chars // LEAST_LINE + 1, calls * own.max_units + own.next_context_chars // LEAST_LINE + 1


def linear(
    units: DataFrame, primary: Callable[[], Provider], fallback: Callable[[], Provider] | None = None, config: Config | None = None, stages: Stages | None = None, calls_per_round: int = CALLS_PER_ROUND,
) -> tuple[DataFrame, DataFrame]:
    """(results, attempts) of the linear mode: a batch size that shrinks on failure and grows after successes; the next call of
    a document depends on its last one, so documents are what runs side by side.

    Cached units are left out and end a batch. Every answer is validated as in block mode; a format error is retried once,
    a unit that fails alone goes to the fallback model, and one that nothing answers keeps its source. The calls are the
    same for any ``calls_per_round``.
    """
    config = config or Config()
    stages = stages or Stages(units.sparkSession)
    model = config.model or Model(max_retries=1)
    rows = units if "cached" in units.columns else units.withColumn("cached", F.lit(False))
    names = F.transform("placeholders", lambda p: p["name"]) if "placeholders" in units.columns else F.array().cast("array<string>")
    place = F.expr("CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS INT)") - 1
    rows = stages.keep(rows.select("doc_id", place.alias("place"), F.col("ordinal").cast("int").alias("ordinal"), "unit_id", "text", "source_text", "cached", names.alias("names")), "linear-units")
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(ROUND)])
    first, second = _Clients(primary, model.max_retries), _Clients(fallback, (config.fallback_model or model).max_retries) if fallback else None
    workers = config.block.max_workers
    parts = min(workers, stages.spark.sparkContext.defaultParallelism)
    kinds = [pa.int32()] * 5

    def rounds(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def step(row: dict[str, Any]) -> dict[str, Any]:
            return Walk(row, first.own, second.own if second else None, config).run(most)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            fields = to_arrow_schema(schema)
            for part, found in pooled(batches, step, max(1, workers // parts)):
                own = [pa.array([f[n] for f in found], k) for n, k in zip(("next", "size", "good", "calls", "n"), kinds, strict=True)]
                lists = [pa.array([f[n] for f in found], fields.field(n).type) for n in ("found", "log")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *own, *lists], names=schema.names)

        return run

    size = max(config.batch.min_units, min(config.batch.initial_units, config.batch.max_units))
    state = rows.groupBy("doc_id").agg(F.count("*").cast("int").alias("n")).select("doc_id", F.lit(0).alias("next"), F.lit(size).alias("size"), F.lit(0).alias("good"), F.lit(0).alias("calls"), "n")
    made, held = 0, None
    while True:
        most = max(calls_per_round, min(MOST_CALLS, made // 2))
        back, ahead = reach(config, most)
        near = rows.join(state, "doc_id").where((F.col("place") >= F.col("next") - back) & (F.col("place") < F.col("next") + ahead))
        unit = F.struct("place", "ordinal", "unit_id", "text", "source_text", "cached", "names")
        windows = near.groupBy("doc_id", "next", "size", "good", "calls", "n").agg(F.sort_array(F.collect_list(unit)).alias("units"))
        done = stages.keep(windows.repartition(parts).mapInArrow(rounds(most), schema), "linear")
        made += most
        state = done.where("next < n").select("doc_id", "next", "size", "good", "calls", "n")
        before = held
        held, left = state.agg(F.sum("n").cast("long"), F.sum("n") - F.sum("next")).first()
        if not left:
            break
        if before is None or 2 * held <= before:  # few documents are open: the next rounds read their units alone
            rows = stages.keep(rows.join(state.select("doc_id"), "doc_id", "left_semi"), "linear-units")
        else:
            held = before
    ran = stages.all("linear", schema)
    results = ran.select("doc_id", F.explode("found").alias("r")).select("doc_id", "r.*")
    attempts = ran.select("doc_id", F.explode("log").alias("r")).select("doc_id", "r.*")
    return results, attempts
