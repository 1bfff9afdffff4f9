"""Reports of a run: counters, failure counts, item lists and their texts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import failure_key, mask_key
from .provider import USAGE, usage_totals

COUNTERS = ("total_units", "cache_hits", "primary_success", "repair_success", "mini_block_success", "fallback_success", "source_retained")


def summary(results: DataFrame, *more: Column) -> DataFrame:
    """Counters per document from rows doc_id, provider, rung, and what is aggregated beside them; rung ``cache`` marks hits."""
    of = lambda *rungs: F.count_if(F.coalesce(F.regexp_replace("rung", "-\\d+$", ""), F.lit("")).isin(*rungs))
    return results.groupBy("doc_id").agg(
        F.count("*").alias("total_units"), of("cache").alias("cache_hits"), of("primary", "strict", "split", "shrunk").alias("primary_success"), of("repair").alias("repair_success"),
        of("mini").alias("mini_block_success"), of("fallback").alias("fallback_success"), of("source").alias("source_retained"), *more,
    )


def failure_histogram(attempts: DataFrame) -> DataFrame:
    """doc_id, reason, n: how many attempts failed for each key, the part of the reason before the first colon."""
    return attempts.where("reason is not null").groupBy("doc_id", failure_key(F.col("reason")).alias("reason")).agg(F.count("*").alias("n"))


def _is(kind: str, x: Column) -> Column:
    return x["kind"] == kind


def _usage(attempts: DataFrame) -> DataFrame:
    """doc_id, usage: token sums of each model, where providers tell them."""
    if "prompt_tokens" not in attempts.columns:
        return attempts.select("doc_id").distinct().withColumn("usage", F.lit(None).cast(f"array<struct<model:string,requests:bigint,{','.join(f'{c}:bigint' for c in USAGE)},prompt_cache_hit_ratio:double>>"))
    each = usage_totals(attempts.where("model is not null"), "doc_id")
    return each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("model", "requests", *USAGE, "prompt_cache_hit_ratio"))).alias("usage"))


def reports(results: DataFrame, attempts: DataFrame, models: list[tuple] | None = None) -> DataFrame:
    """doc_id, report (JSON) and markdown: counters, failure counts sorted by key, the units each late rung answered, token
    sums, and the models: (kind, model, base_url, api_key, context window, output tokens) with masked keys."""
    counts = failure_histogram(attempts).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("reason", "n"))).alias("failure_reasons"))
    late = F.when(F.col("rung").rlike("^(repair|mini|fallback|source)"), F.struct("ordinal", F.col("unit_id").alias("id"), F.regexp_replace("rung", "-\\d+$", "").alias("kind"), F.col("source_text").alias("source")))
    listed = F.sort_array(F.collect_list(late))
    rows = summary(results, F.when(F.size(listed) > 0, listed).alias("listed")).join(counts, "doc_id", "left").join(_usage(attempts), "doc_id", "left")
    title = {"total_units": "Total units", "cache_hits": "Cache hits", "primary_success": "Primary success", "repair_success": "Repair success", "mini_block_success": "Mini-block success", "fallback_success": "Fallback success", "source_retained": "Source retained"}
    parts = [F.lit("# Translation report\n\n"), *[F.concat(F.lit(f"- {title[c]}: "), F.col(c).cast("string"), F.lit("\n")) for c in COUNTERS], F.lit("\n## Failure reasons\n")]
    parts.append(F.coalesce(F.array_join(F.transform("failure_reasons", lambda r: F.concat(F.lit("- "), r["reason"], F.lit(": "), r["n"].cast("string"))), "\n"), F.lit("- none")))
    for kind, heading in (("fallback", "Fallback units"), ("repair", "Repaired units"), ("mini", "Mini-block units"), ("source", "Retained source units")):
        own = F.filter("listed", partial(_is, kind))
        lines = F.array_join(F.transform(own, lambda x: F.concat(F.lit("- "), x["id"], F.lit(": "), x["source"])), "\n")
        parts.append(F.when(F.size(own) > 0, F.concat(F.lit(f"\n\n## {heading}\n"), lines)).otherwise(""))
    used = F.array_join(F.transform("usage", lambda u: F.concat(F.lit("- "), u["model"], F.lit(": "), u["requests"].cast("string"), F.lit(" requests, "), u["total_tokens"].cast("string"), F.lit(" tokens, cache hit ratio "), u["prompt_cache_hit_ratio"].cast("string"))), "\n")
    parts.append(F.when(F.size("usage") > 0, F.concat(F.lit("\n\n## Token usage\n"), used)).otherwise(""))
    listed = [F.struct(F.lit(kind).alias("kind"), F.lit(model).alias("model"), F.lit(url).alias("base_url"), mask_key(F.lit(key)).alias("api_key"), F.lit(window).alias("context_window_tokens"), F.lit(most).alias("max_output_tokens")) for kind, model, url, key, window, most in models or []]
    extra = [F.array(*listed).alias("models")] if listed else []
    body = F.to_json(F.struct(F.struct(*COUNTERS).alias("summary"), "failure_reasons", F.col("listed").alias("units"), "usage", *extra))
    return rows.select("doc_id", body.alias("report"), F.concat(*parts).alias("markdown"))
