"""Readers of submissions, pages and cache lines, and the check of a download tree."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import FilingError
from ..operators.submission import as_text, header_fields
from .mirror import open_mirror, wanted_folders


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """filing_id (the file's folder), source_file, submission, content: each bundle below ``path`` as one text and as its bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("filing_id"), F.col("path").alias("source_file"), as_text(F.col("content")).alias("submission"), "content")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), html, file_hash: the hash is of the text after its line breaks are made equal."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{htm,html,xhtml}").load(path)
    return files.select(F.col("path").alias("doc_id"), as_text(F.col("content")).alias("html")).withColumn("file_hash", F.sha2("html", 256))


def read_mirror(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """The submissions of a local mirror ``root/TICKER/FORM/accession/…`` that the requests (ticker, form) name, in any case.

    A request may have ``after`` and ``before``, the first and last day of filing as YYYY-MM-DD, and ``limit``: so many of
    the latest. A null sets no bound; a bundle without a filing date meets no bound of time and counts as the oldest. Only
    the folders of the tickers and forms are listed and opened.
    """
    tickers, forms = wanted_folders(requests)
    rows = open_mirror(spark, root).where(F.col("ticker").isin(tickers) & F.col("form").isin(forms))
    rows = rows.select("filing_id", "source_file", as_text(F.col("content")).alias("submission"), "content", "ticker", "form")
    known = {"after": "string", "before": "string", "limit": "int"}
    bounds = [(F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in known.items()]
    wanted = requests.select(F.upper("ticker").alias("ticker"), F.upper("form").alias("form"), *bounds).distinct()
    filed = F.regexp_replace(F.element_at(header_fields(F.col("submission")), "filed_as_of_date"), "[^0-9]", "")
    day = lambda c: F.regexp_replace(c, "-", "")
    met = rows.join(wanted, ["ticker", "form"]).withColumn("_filed", filed)
    met = met.where((F.col("after").isNull() | (F.col("_filed") >= day("after"))) & (F.col("before").isNull() | (F.col("_filed") <= day("before"))))
    latest = Window.partitionBy("ticker", "form", *known).orderBy(F.desc_nulls_last("_filed"), F.desc("source_file"))
    ranks = met.select("ticker", "form", *known, "_filed", "source_file").withColumn("_n", F.row_number().over(latest)).where(F.col("limit").isNull() | (F.col("_n") <= F.col("limit")))
    return rows.join(ranks.select("source_file").distinct(), "source_file", "left_semi")


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of files without bytes, from a listing: Spark's file sources leave such files out when they plan a scan.

    The driver lists the top folder alone; the folders in it are dealt over tasks, which list what lies below them.
    """
    fs, root = pafs.FileSystem.from_uri(path)
    top = fs.get_file_info(pafs.FileSelector(root))
    folders = [i.path for i in top if i.type == pafs.FileType.Directory]
    own = spark.createDataFrame([(i.path, 0) for i in top if i.type == pafs.FileType.File and not i.size], "path string, length long")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(path)
        for b in batches:
            for folder in b.column("folder").to_pylist():
                found = [i.path for i in files.get_file_info(pafs.FileSelector(folder, recursive=True)) if i.type == pafs.FileType.File and not i.size]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([0] * len(found), pa.int64())], names=["path", "length"])

    if not folders:
        return own
    dealt = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), 1000))
    return own.unionByName(dealt.mapInArrow(below, "path string, length long"))


def check_download(spark: SparkSession, path: str, count: int | None) -> None:
    """Refuse a download of nothing, of no folder, or with empty files (the first three are named)."""
    if count == 0:
        raise FilingError("nothing was downloaded")
    fs, root = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        raise FilingError(f"no such folder: {path}")
    found = [r[0] for r in empty_files(spark, path).orderBy("path").limit(3).collect()]
    if found:
        raise FilingError("empty files: " + ", ".join(found))


@F.arrow_udf(StringType())
def pretty(texts: pa.Array) -> pa.Array:
    """JSON texts with an indent of two and non-ASCII letters kept."""
    return pa.array([None if x is None else json.dumps(json.loads(x), indent=2, ensure_ascii=False) for x in texts.to_pylist()], pa.string())
