"""The content-keyed cache of answers: keys, lookups as joins, and what is written back."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..stages import Files

PROMPT_VERSION = "1"


def prompt_hash(system_prompt: str, version: str = PROMPT_VERSION) -> Column:
    return F.sha2(F.lit(f"{version}\n{system_prompt}"), 256)


def cache_key(file_hash: Column, unit_id: Column, text: Column, names: Column, prompt: Column, language: Column, model: Column) -> Column:
    """SHA-256 of the newline-joined parts; placeholder names sort as strings and nulls count as empty."""
    parts = [file_hash, unit_id, F.sha2(text, 256), F.array_join(F.array_sort(names), ","), prompt, language, model]
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def last_wins(rows: DataFrame, key: str = "cache_key", seq: str = "seq") -> DataFrame:
    """The latest row of each key; usable rows only: a non-empty key and a text without U+FFFD."""
    usable = rows.where((F.coalesce(F.col(key), F.lit("")) != "") & F.col("text").isNotNull() & ~F.contains(F.col("text"), F.lit("�")))
    names = [c for c in rows.columns if c != key]
    return usable.groupBy(key).agg(F.max_by(F.struct(*names), F.col(seq)).alias("_r")).select(key, "_r.*")


#: What a cache row holds; ``run`` numbers the runs that wrote to one log.
ROW = "cache_key string, file_hash string, unit_id string, source_hash string, prompt_hash string, target_language string, model string, provider string, text string, source_preview string, run long"


@F.arrow_udf(BooleanType())
def _is_object(lines: pa.Array) -> pa.Array:
    """Whether a line is one JSON object and nothing else; Spark's parser would accept text behind it."""

    def one(line: str | None) -> bool:
        try:
            return isinstance(json.loads(line or ""), dict)
        except ValueError:
            return False

    return pa.array(map(one, lines.to_pylist()), pa.bool_())


def parse_lines(lines: DataFrame) -> DataFrame:
    """Cache rows of JSON lines (value, seq); blank lines, bad JSON and lines that are no objects are left out.

    ``seq`` orders first by the run that a row names (0 without one), then by the order of the lines.
    """
    parsed = lines.where(F.startswith(F.ltrim("value"), F.lit("{")) & _is_object("value")).select(F.from_json("value", ROW, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}).alias("r"), "seq")
    return parsed.select("r.*", F.struct(F.coalesce("r.run", F.lit(0)).alias("run"), F.col("seq").alias("line")).alias("seq")).where("cache_key is not null")


def lookup(units: DataFrame, cache: DataFrame) -> DataFrame:
    """``units`` (with cache_key) with cached_text and cached_provider; Spark broadcasts a cache that it knows to be small."""
    hits = cache.select(F.col("cache_key").alias("_k"), F.col("text").alias("cached_text"), F.col("provider").alias("cached_provider"))
    return units.join(hits, F.col("cache_key") == F.col("_k"), "left").drop("_k")


def misses(units: DataFrame, cache: DataFrame) -> DataFrame:
    return units.join(cache.select("cache_key"), "cache_key", "left_anti")


def retained_from_cache(looked_up: DataFrame) -> DataFrame:
    """Hits whose cached answer was the source itself, once per unit, with the reason they are listed under."""
    kept = looked_up.where("cached_provider = 'source'").dropDuplicates(["doc_id", "unit_id"])
    return kept.withColumn("reason", F.lit("cached_source_retained"))


def cache_rows(results: DataFrame, prompt: Column, language: str, model: str, run: int = 0) -> DataFrame:
    """Rows to append for results with cache_key and file_hash: those of all providers, sources that were kept included, so
    that a rerun makes no calls. ``run`` must grow from run to run, for the last one to win."""
    preview = F.when(F.char_length("source_text") <= 160, F.col("source_text")).otherwise(F.concat(F.substring("source_text", 1, 157), F.lit("...")))
    return results.select(
        "cache_key", "file_hash", "unit_id", F.sha2("source_text", 256).alias("source_hash"), prompt.alias("prompt_hash"), F.lit(language).alias("target_language"), F.lit(model).alias("model"),
        "provider", F.col("result").alias("text"), preview.alias("source_preview"), F.lit(run).cast("long").alias("run"),
    )


def read_cache_lines(spark: SparkSession, path: str, shelves: list[str] | None = None) -> DataFrame:
    """value, seq: the lines of JSONL files; later lines of a file, and later files by name, have larger numbers.

    Within a split Spark numbers rows in the order of the file; splits are ordered by file and start, not by when they are read.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path)
    if shelves is not None:  # before lines are numbered, as no filter passes that
        lines = lines.where(F.col(SHELF).isin(shelves))
    return lines.select("value", F.struct(meta["file_name"].alias("file"), meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("line")).alias("seq"))


#: Of a cache folder: the versions of its table, and what marks one as complete. A shelf holds the pages whose hash begins
#: with the same two digits, so there are 256 at most.
VERSION, COMPLETE, SHELF = "version-", "_COMPLETE-", "shelf"


def _version(files: Files) -> int:
    """The latest version that was completed; 0 before the first compaction."""
    return max([int(n.removeprefix(COMPLETE)) for n in files.names() if n.startswith(COMPLETE)], default=0)


def _shelf() -> Column:
    """A letter comes first, as names of digits alone would be read back as numbers."""
    return F.concat(F.lit("h"), F.coalesce(F.substring("file_hash", 1, 2), F.lit("")))


def append(rows: DataFrame, path: str) -> None:
    """Add rows to the log of answers, as JSON lines on the shelf of their page; run numbers order them, whatever the names of
    their files."""
    files = Files(rows.sparkSession, path)
    rows.withColumn(SHELF, _shelf()).repartition(SHELF).write.partitionBy(SHELF).mode("append").json(f"{files}/{VERSION}{_version(files)}")


def read_log(spark: SparkSession, path: str, pages: DataFrame | None = None) -> DataFrame:
    """The log of answers, its latest rows: ``ROW``'s columns and seq. With ``pages`` (file_hash) only the shelves of these
    pages are read: a list of 256 names at most is all that the driver takes of them."""
    files = Files(spark, path)
    name = f"{VERSION}{_version(files)}"
    if not files.exists(name):  # lines that something else has written, on no shelves
        return last_wins(parse_lines(read_cache_lines(spark, str(files))))
    shelves = None if pages is None else [r[0] for r in pages.select(_shelf().alias(SHELF)).distinct().collect()]
    return last_wins(parse_lines(read_cache_lines(spark, f"{files}/{name}", shelves)))


def compact(spark: SparkSession, path: str) -> int:
    """Merge the log's runs: the latest usable row of each key stays, sorted by key, with about one file for each shelf. The
    new version takes over when its marker is made, so a compaction that is stopped changes nothing; returns its number.

    A log has one writer at a time. The version before stays until the next compaction.
    """
    files = Files(spark, path)
    now = _version(files)
    rows = read_log(spark, path).drop("seq").withColumn(SHELF, _shelf())
    rows.repartition(SHELF).sortWithinPartitions(SHELF, "cache_key").write.partitionBy(SHELF).mode("overwrite").json(f"{files}/{VERSION}{now + 1}")
    files.touch(f"{COMPLETE}{now + 1}")
    if now:
        Files(spark, f"{files}/{VERSION}{now - 1}").remove()
    return now + 1


def next_run(cache: DataFrame) -> int:
    """One more than the largest run of a log."""
    return (cache.agg(F.max("run")).first()[0] or 0) + 1
