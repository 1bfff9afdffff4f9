"""Whole runs: pages to translated pages with reports and cache rows, bundles to files."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import cache as C
from ..operators import html_units as H
from ..operators import report as R
from ..operators import submission as S
from ..operators.ladder import RESULT
from ..operators.prompts import SYSTEM
from ..operators.provider import Provider
from ..session import materialize
from ..sources.files import pretty
from ..stages import Stages, fingerprint
from .blocks import blocks
from .linear import linear

CACHE = "cache_key string, text string, provider string"
#: Names of files that are made beside a bundle's documents.
RESERVED = ("manifest.json", "full-submission.txt")


class Run(NamedTuple):
    pages: DataFrame
    results: DataFrame
    attempts: DataFrame
    reports: DataFrame
    cache_rows: DataFrame
    stages: Stages


def translate(
    pages: DataFrame, primary: Callable[[], Provider], fallback: Callable[[], Provider] | None = None, cache: DataFrame | None = None, config: Config | None = None,
    model: str | None = None, fallback_model: str | None = None, run: int = 0, journal: str | None = None,
) -> Run:
    """Translate ``pages`` (doc_id, html): units, cache lookup, block or linear mode for the misses, and the pages rebuilt.

    A page without units stays as it is and has no report. Answers of the fallback model are highlighted, cached ones too.
    ``run`` numbers the run for the cache log, whose latest run wins. With a ``journal`` folder the stages of calls are kept
    there, each with a commit marker: a run over the same units, settings and models that is started again after it was
    stopped makes none of the calls of the stages that were finished.
    """
    config = config or Config()
    model = model or (config.model.model if config.model else "model")
    fallback_model = fallback_model or (config.fallback_model.model if config.fallback_model else None)
    cache = cache if cache is not None else pages.sparkSession.createDataFrame([], CACHE)
    hashed = pages.select("doc_id", F.sha2("html", 256).alias("file_hash"))
    found = H.extract_units(pages)
    names = F.transform("placeholders", lambda p: p["name"])
    key = C.cache_key(F.col("file_hash"), F.col("unit_id"), F.col("text"), names, C.prompt_hash(SYSTEM), F.lit(config.target_language), F.lit(model))
    units = materialize(C.lookup(found.join(hashed, "doc_id").withColumn("cache_key", key), cache).withColumn("cached", F.col("cached_text").isNotNull()), "units")
    own = f"{journal.rstrip('/')}/{fingerprint(units.where('not cached').select('doc_id', 'ordinal', 'cache_key'), config, model, fallback_model)}" if journal else None
    stages = Stages(pages.sparkSession, own)
    fresh, attempts = (blocks if config.block.enabled else linear)(units, primary, fallback, config, stages)
    fresh = fresh.select(*RESULT)
    hits = units.where("cached").select("doc_id", "ordinal", "unit_id", "source_text", F.col("cached_text").alias("result"), F.col("cached_provider").alias("provider"), F.lit("cache").alias("rung"))
    results = materialize(fresh.unionByName(hits), "results")
    second = F.col("provider") == F.lit(fallback_model) if fallback_model else F.lit(False)
    answers = results.where("provider <> 'source'").select("doc_id", "ordinal", F.col("result").alias("text"), second.alias("is_fallback"))
    new = results.where("rung <> 'cache'").join(units.select("doc_id", "unit_id", "cache_key", "file_hash"), ["doc_id", "unit_id"])
    models = [(kind, m.model, m.base_url, m.api_key, m.context_window_tokens, m.max_output_tokens) for kind, m in (("primary", config.model), ("fallback", config.fallback_model)) if m]
    return Run(H.apply_units(pages, answers), results, attempts, R.reports(results, attempts, models), C.cache_rows(new, C.prompt_hash(SYSTEM), config.target_language, model, run), stages)


def unpack(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, documents): files (name, content) to write for each bundle, its manifest included, and the parsed documents.

    Where ``submissions`` have their ``content`` and ``source_file``, the bundle itself is among the files, byte for byte.
    Documents with an error are listed in neither manifest nor files. Repeated names keep their ordinal in front.
    """
    documents = S.split_documents(submissions)
    good = documents.where("error is null")
    payloads = materialize(S.decode_payloads(good), "payloads")
    named = good.join(payloads, ["filing_id", "doc_ordinal"]).select("filing_id", "doc_ordinal", "filename", "payload")
    first = named.groupBy("filing_id", "filename").agg(F.min("doc_ordinal").alias("_first"))
    named = named.join(first, ["filing_id", "filename"])
    own = F.when((F.col("doc_ordinal") == F.col("_first")) & (~F.col("filename").isin(*RESERVED)), F.col("filename")).otherwise(F.concat(F.col("doc_ordinal").cast("string"), F.lit("-"), "filename"))
    files = named.select(F.concat("filing_id", F.lit("/"), own).alias("name"), F.col("payload").alias("content"))
    listed = S.manifests(submissions, good, payloads).select(F.concat("filing_id", F.lit("/manifest.json")).alias("name"), pretty("manifest").cast("binary").alias("content"))
    files = files.unionByName(listed)
    if {"content", "source_file"} <= set(submissions.columns):
        files = files.unionByName(submissions.select(F.concat("filing_id", F.lit("/"), F.element_at(F.split("source_file", "/"), -1)).alias("name"), "content"))
    return files, documents


def outputs(run: Run, names: DataFrame, config: Config) -> DataFrame:
    """name, content: the translated pages and their reports, named after each page's file (doc_id, name)."""
    stem, suffix = F.regexp_extract("name", r"(?s)\A(.*?)(\.[^./]*)?\z", 1), F.regexp_extract("name", r"(?s)\A(.*?)(\.[^./]*)?\z", 2)
    target = F.concat(stem, F.lit(config.output.suffix))
    named = names.select("doc_id", target.alias("stem"), F.when(suffix == "", ".html").otherwise(suffix).alias("suffix"))
    page = run.pages.join(named, "doc_id").where("html is not null").select(F.concat("stem", "suffix").alias("name"), F.col("html").cast("binary").alias("content"))
    reports = run.reports.join(named, "doc_id")
    if config.output.report_json:
        page = page.unionByName(reports.select(F.concat("stem", F.lit("_translation_report.json")).alias("name"), pretty("report").cast("binary").alias("content")))
    if config.output.report_markdown:
        page = page.unionByName(reports.select(F.concat("stem", F.lit("_translation_report.md")).alias("name"), F.col("markdown").cast("binary").alias("content")))
    return page
