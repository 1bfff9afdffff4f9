"""Answers of a model: parsing in Arrow batches, validation as native columns, first failure first; and the same rules for one
answer in Python, for the linear mode, where the next call depends on the last one."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import text as T

#: Answers whose items are Python objects at a time.
SLICE = 200
ITEMS = ArrayType(StructType([StructField("id", StringType()), StructField("text", StringType())]))


def _payload(response: str | None) -> str | None:
    """The Python twin of ``functions.text.json_payload``."""
    if response is None:
        return None
    t = response.strip()
    if t.startswith("```"):
        t = re.sub(r"\s*```\s*\Z", "", re.sub(r"\A```(?:json)?\s*", "", t, flags=re.IGNORECASE))
    inner = re.search(r"[\[{].*[\]}]", t, re.DOTALL)
    return inner.group() if inner else t


def _items(payload: str | None) -> list[dict[str, str]] | None:
    """The (id, text) items of a payload, or None if it is not a list of them."""
    try:
        data = json.loads(payload or "")
    except ValueError:
        return None
    if isinstance(data, dict) and isinstance(data.get("translations"), list):
        data = data["translations"]
    elif isinstance(data, dict) and {"id", "text"} <= data.keys():
        data = [data]
    if not isinstance(data, list) or not all(isinstance(x, dict) and {"id", "text"} <= x.keys() for x in data):
        return None
    return [{"id": str(x["id"]), "text": str(x["text"])} for x in data]


@F.arrow_udf(ITEMS)
def parse_items(responses: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("id", pa.string()), ("text", pa.string())]))
    for p in responses:
        parts = [pa.array([_items(_payload(x)) for x in p.slice(k, SLICE).to_pylist()], kind) for k in range(0, len(p), SLICE)]
        yield pa.concat_arrays(parts) if parts else pa.array([], kind)


def parse_responses(attempts: DataFrame) -> DataFrame:
    """``attempts`` (response, error) with ``items`` and ``reason``: provider error, refusal, invalid answer or null."""
    rows = attempts.withColumn("_refused", T.looks_like_refusal(F.col("response")))
    rows = rows.withColumn("items", F.when(F.col("error").isNull() & ~F.col("_refused"), parse_items(F.col("response"))))
    failed = F.when(F.col("error").isNotNull(), F.concat(F.lit("provider_error: "), F.col("error"))).when(F.col("_refused"), "model_refusal").when(F.col("items").isNull(), "model_response_invalid")
    return rows.withColumn("reason", failed).drop("_refused")


def unit_failure(source: Column, answer: Column, names: Column) -> Column:
    """Why a unit's answer is rejected, in a fixed order of checks; null if it passes."""


    def checked(t: Column) -> Column:
        return (
            F.when(t == "", "empty_translation")
            .when(T.looks_like_refusal(t), "model_refusal")
            .when(T.has_replacement_character(t), "replacement_character_validation_failed")
            .when(~T.placeholders_match(t, names), "placeholder_validation_failed")
            .when(~T.numbers_preserved(source, t), "number_validation_failed")
        )

    return T.once(T.stripped(answer), checked)


def validate_batches(parsed: DataFrame) -> DataFrame:
    """``parsed`` (units: array of id, text, names; items; reason) with the batch's first failure in ``reason``.

    Ids must agree in number and order; then the first unit that fails rejects the whole batch.
    """
    ids = F.transform("units", lambda u: u["id"]) != F.transform("items", lambda x: x["id"])
    pairs = F.zip_with("units", "items", lambda u, x: unit_failure(u["text"], x["text"], u["names"]))
    first = F.get(F.filter(pairs, lambda r: r.isNotNull()), 0)
    checked = F.when(F.col("reason").isNotNull(), F.col("reason")).when(ids, "id_validation_failed").otherwise(first)
    return parsed.withColumn("reason", checked)


_REFUSED = re.compile("|".join(f"(?:{p})" for p in T.REFUSALS))


def _refused(text: str) -> bool:
    t = text.lower()
    return any(w in t for w in T.REFUSAL_WORDS) and _REFUSED.search(t) is not None


_NUMBER, _PAIR = re.compile(r"\d[\d,]*(?:\.\d+)?"), re.compile(r"<(PH_\d+)>.*?</\1>", re.DOTALL)


def answered(response: str) -> tuple[list[dict[str, str]] | None, str | None]:
    """(items, reason) of one response, as ``parse_responses`` has them."""
    if _refused(response):
        return None, "model_refusal"
    items = _items(_payload(response))
    return items, None if items is not None else "model_response_invalid"


def _numbers(text: str) -> Counter[str]:
    return Counter(n.replace(",", "") for n in _NUMBER.findall(text))


def first_failure(batch: list[dict], items: list[dict[str, str]]) -> str | None:
    """Why the answer to a batch (unit_id, text, names) is rejected, as ``validate_batches`` has it; null if it passes."""
    if [x["id"] for x in items] != [u["unit_id"] for u in batch]:
        return "id_validation_failed"
    for u, x in zip(batch, items, strict=True):
        t = x["text"].strip()
        if not t:
            return "empty_translation"
        if _refused(t):
            return "model_refusal"
        if "\ufffd" in t:
            return "replacement_character_validation_failed"
        if ("<PH_" in t or u["names"]) and Counter(m.group(1) for m in _PAIR.finditer(t)) != Counter(u["names"]):
            return "placeholder_validation_failed"
        if _numbers(u["text"]) - _numbers(t):
            return "number_validation_failed"
    return None
