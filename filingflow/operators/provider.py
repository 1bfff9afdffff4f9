"""Model calls as a stage: requests go to a pluggable provider, a bounded number at a time, and come back in their order.

A provider has ``model`` and ``translate(request) -> str``; it may have ``prime(prompt)`` for a prompt cache and ``usage()``, the
token fields of its last call. A factory makes it on the executor, one for each thread. Calls are costly and not
deterministic: materialise each stage.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Token fields of a usage record.
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens")


class Provider(Protocol):
    model: str

    def translate(self, request: dict[str, Any]) -> str: ...


class KeyedProvider:
    """A deterministic provider for tests and dry runs: answers are looked up by (rung, unit id), else made by ``make``."""

    def __init__(self, model: str = "keyed", answers: dict[tuple[str, str], str] | None = None, make: Callable[[str], str] = str.upper, whole: dict[str, str] | None = None):
        self.model, self.answers, self.make, self.whole = model, answers or {}, make, whole or {}

    def translate(self, request: dict[str, Any]) -> str:
        if request["rung"] in self.whole:
            return self.whole[request["rung"]]
        out = [{"id": u["id"], "text": self.answers.get((request["rung"], u["id"]), self.make(u["text"]))} for u in request["units"]]
        if any(x["text"] == "!error" for x in out):
            raise RuntimeError("provider is down")
        return json.dumps(out, ensure_ascii=False)


def dry_run(model: Any) -> KeyedProvider:
    """A provider that calls nothing: each answer is its source in capitals, placeholders and numbers kept."""
    return KeyedProvider(model.model, make=lambda t: re.sub(r"<[^>]*>|[^<]+", lambda m: m.group() if m.group()[0] == "<" else m.group().upper(), t))


#: Rows that are asked for ahead of the one whose answer is waited for, at least.
AHEAD = 64


def pooled(batches: Iterable[pa.RecordBatch], one: Callable[[dict[str, Any]], Any], workers: int) -> Iterator[tuple[pa.RecordBatch, list[Any]]]:
    """Slices of the batches with what ``one`` makes of each of their rows, in order, ``workers`` rows at a time.

    A slow row does not stop the others; but no more than about ``AHEAD`` rows (or twice the workers) are taken before the
    oldest is answered, so that a partition is never held whole.
    """
    size, most = AHEAD // 4, max(AHEAD, 2 * workers)
    if workers == 1:  # nothing runs beside it
        for b in batches:
            for k in range(0, b.num_rows, size):
                part = b.slice(k, size)
                yield part, [one(r) for r in part.to_pylist()]
        return
    waiting: deque[tuple[pa.RecordBatch, list]] = deque()
    with ThreadPoolExecutor(workers) as pool:
        held = 0
        for b in batches:
            for k in range(0, b.num_rows, size):
                part = b.slice(k, size)
                waiting.append((part, [pool.submit(one, r) for r in part.to_pylist()]))
                held += part.num_rows
                while held > most:
                    part, futures = waiting.popleft()
                    held -= part.num_rows
                    yield part, [f.result() for f in futures]
        for part, futures in waiting:
            yield part, [f.result() for f in futures]


class Client:
    """One provider for each thread, as the tokens of its last call are its own; calls are retried."""

    def __init__(self, factory: Callable[[], Provider], retries: int = 1, pause: Callable[[float], None] = time.sleep):
        self.factory, self.retries, self.pause, self._own = factory, max(1, retries), pause, threading.local()

    @property
    def provider(self) -> Provider:
        if not hasattr(self._own, "provider"):
            self._own.provider = self.factory()
        return self._own.provider

    def used(self) -> tuple[int | None, ...]:
        told = (self.provider.usage() if hasattr(self.provider, "usage") else None) or {}
        return tuple(told.get(c) for c in USAGE)

    def retried(self, attempt: Callable[[], Any]) -> tuple[Any, str | None]:
        """(value, error) of the first attempt that gives something, with pauses of min(2**n, 8) seconds between them."""
        error = None
        for k in range(self.retries):
            try:
                if value := attempt():
                    return value, None
                error = "empty response"
            except Exception as e:  # noqa: BLE001 - any failure of a call is a row's error
                error = str(e) or type(e).__name__
            if k + 1 < self.retries:
                self.pause(min(2**k, 8))
        return None, error

    def ask(self, request: dict[str, Any]) -> tuple:
        """(model, response, error, tokens ...): tokens are those of the call that succeeded; a failed request has none."""
        response, error = self.retried(lambda: self.provider.translate(request))
        return self.provider.model, response, error, *(self.used() if error is None else (None,) * len(USAGE))

    def prime(self, prompt: str) -> tuple:
        """(model, error, tokens ...) of filling the prompt cache; a provider without one is skipped."""
        if not hasattr(self.provider, "prime"):
            return self.provider.model, None, *(None,) * len(USAGE)
        _, error = self.retried(lambda: (self.provider.prime(prompt), True))
        return self.provider.model, error and f"cache_warmup_failed: {error}", *(self.used() if error is None else (None,) * len(USAGE))


def _with(part: pa.RecordBatch, names: list[str], added: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64()}
    new = [pa.array([r[k] for r in rows], kinds[f.dataType]) for k, f in enumerate(added)]
    return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new], names=[*names, *added.names])


def _called(rows: DataFrame, added: T.StructType, one: Callable[[dict[str, Any]], tuple], workers: int, left: tuple[str, ...] = ()) -> DataFrame:
    passed = [f for f in rows.schema if f.name not in (*added.names, *left)]
    names = [f.name for f in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in pooled(batches, one, workers):
            yield _with(part, names, added, found)

    return rows.mapInArrow(run, T.StructType([*passed, *added]))


def call(requests: DataFrame, factory: Callable[[], Provider], retries: int = 1, pause: Callable[[float], None] = time.sleep, workers: int = 1, left: tuple[str, ...] = ()) -> DataFrame:
    """``requests`` without the columns that are ``left`` behind, with model, response, error and the token fields of ``USAGE``, null where a provider does not tell and where
    the request failed. Each partition has ``workers`` calls at a time; a failed or empty call is retried."""
    added = T.StructType([T.StructField(c, T.StringType()) for c in ("model", "response", "error")] + [T.StructField(c, T.LongType()) for c in USAGE])
    clients = _Clients(factory, retries, pause)
    return _called(requests, added, lambda r: clients.own.ask(r), workers, left)


def prime(blocks: DataFrame, factory: Callable[[], Provider], pause_seconds: float = 0.0, retries: int = 1, workers: int = 1, single: bool = False) -> DataFrame:
    """``blocks`` (block_prompt and, it may be, others) with model, error and tokens: one priming call for each
    distinct row, and a pause behind it. Rows that are ``single`` already are not compared, and their prompts left behind."""
    added = T.StructType([T.StructField(c, T.StringType()) for c in ("model", "error")] + [T.StructField(c, T.LongType()) for c in USAGE])
    clients = _Clients(factory, retries, time.sleep)

    def one(r: dict[str, Any]) -> tuple:
        found = clients.own.prime(r["block_prompt"])
        if found[1] is None and hasattr(clients.own.provider, "prime"):
            time.sleep(pause_seconds)
        return found

    if single:
        return _called(blocks, added, one, workers, ("block_prompt",))
    return _called(blocks.distinct(), added, one, workers)


class _Clients:
    """What goes to a task to make its client there: threads and their providers stay behind."""

    def __init__(self, *settings):
        self.settings, self._made = settings, None

    @property
    def own(self) -> Client:
        if self._made is None:
            self._made = Client(*self.settings)
        return self._made

    def __getstate__(self):
        return {"settings": self.settings, "_made": None}


def usage_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Per model (and other columns): requests, token sums and the cache hit ratio to four places. Missing counts are 0; calls without any
    usage are not counted as requests."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in USAGE]
    known = F.greatest(*[F.col(c).isNotNull().cast("int") for c in USAGE])
    out = calls.groupBy(*by, "model").agg(F.sum(known).cast("long").alias("requests"), *sums)
    hit, miss = F.col("prompt_cache_hit_tokens"), F.col("prompt_cache_miss_tokens")
    return out.withColumn("prompt_cache_hit_ratio", F.coalesce(F.round(F.try_divide(hit.cast("double"), (hit + miss).cast("double")), 4), F.lit(0.0)))
