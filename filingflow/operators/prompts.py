"""Prompt texts as Column expressions; the wording is ours, the sections are what a batch needs to be answered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import once

SYSTEM = "You translate passages of regulatory filings. Keep every <PH_n> tag pair, every number and every id as they are."
#: What follows it in each request; the cache knows the language by itself.
LANGUAGE = " The target language is %s."
REMINDER = "\nAnswer with a JSON array of objects with id and text, and nothing else."


def system(language: str) -> str:
    """The system message of every request."""
    return SYSTEM + LANGUAGE % language


def quoted(text: Column) -> Column:
    """A string as JSON, non-ASCII letters kept; null counts as empty."""
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("v")))
    return once(whole, lambda x: F.substring(x, 6, F.char_length(x) - 6))  # behind {"v": and before }


def items_json(units: Column) -> Column:
    """The units as a JSON list with a space behind each colon and comma, as the planned sizes count them."""
    one = lambda u: F.concat(F.lit('{"id": '), quoted(u["id"]), F.lit(', "text": '), quoted(u["text"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(units, one), ", "), F.lit("]"))


def framed(batch: Column, units: Column) -> Column:
    """A batch as it stands in a block: its id and its items."""
    return F.concat(F.lit('{"batch_id": "batch_'), F.when(F.char_length(batch) < 3, F.lpad(batch, 3, "0")).otherwise(batch), F.lit('", "items": '), items_json(units), F.lit("}"))


def block_prompt(language: str, before: Column, batches: Column, after: Column) -> Column:
    """What all batches of a block share, so that a provider can cache it."""
    return F.concat(F.lit(f"Target language: {language}\n# Text before\n"), before, F.lit("\n# Block\n"), batches, F.lit("\n# Text after\n"), after)


def context_prompt(language: str, before: str, after: str) -> str:
    """The text around a batch that has no block around it."""
    return f"Target language: {language}\n# Text before\n{before}\n# Text after\n{after}"


def bare_prompt(language: str) -> str:
    """What stands in front of a batch with nothing around it."""
    return f"Target language: {language}"


def task_prompt(units: Column, strict: Column, reason: Column, previous: Column) -> Column:
    """The batch to answer now, a reminder of the format, and what was wrong before."""
    reminder = F.when(strict, REMINDER).otherwise("")
    repair = F.when(reason.isNotNull(), F.concat(F.lit("\n# Rejected answer\nReason: "), reason, F.lit("\n"), F.coalesce(previous, F.lit("")))).otherwise("")
    return F.concat(F.lit("# Task\n"), items_json(units), reminder, repair)
