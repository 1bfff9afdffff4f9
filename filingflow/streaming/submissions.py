"""New submission files as a stream: each micro-batch is unpacked like a table and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.submission import as_text, decode_payloads, split_documents

FILES = "path string, modificationTime timestamp, length long, content binary"


def submission_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """filing_id, submission of files that arrive below ``path``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select(F.col("path").alias("filing_id"), as_text(F.col("content")).alias("submission"))


def unpack_stream(submissions: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append documents and payloads of each micro-batch; a batch that is run again replaces its own folder."""

    def unpack(batch: DataFrame, number: int) -> None:
        documents = split_documents(batch)
        documents.write.mode("overwrite").parquet(f"{output}/documents/batch={number}")
        decode_payloads(documents.where("error is null")).write.mode("overwrite").parquet(f"{output}/payloads/batch={number}")

    return submissions.writeStream.foreachBatch(unpack).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
