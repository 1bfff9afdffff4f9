"""A sink of files whose names are data: rows (name, content) become files of a folder, all of them or none.

Tasks write into a staging folder of their own and check the names as they go. Spark's commit message then lists the tasks
that count, so what a failed or a second attempt of a task left is never published; an abort takes the staging folder away.
Publishing is a Spark job over those tasks, which moves their files; started again, it goes on with what is left.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..config import FilingError
from ..stages import Files

#: Names that leave their folder.
UNSAFE = re.compile(r"(^|/)\.\.?(/|$)|^/|\\|^$|/$")
STAGING, LISTED = ".staging-", "_tasks.json"


@dataclass
class Staged(WriterCommitMessage):
    task: str
    files: int


class StagedFiles(DataSource):
    """Options: path (the staging folder), folder (where files go), overwrite."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return StagedWriter(dict(self.options))


class StagedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.staging, self.folder, self.overwrite = options["path"], options["folder"], options.get("overwrite") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        context = TaskContext.get()
        task = f"{context.partitionId()}-{context.taskAttemptId()}"
        fs, base = pafs.FileSystem.from_uri(f"{self.staging}/{task}")
        _, target = pafs.FileSystem.from_uri(self.folder)
        seen: set[str] = set()
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name is None or UNSAFE.search(name):
                    raise FilingError(f"unsafe name: {name}")
                if name in seen:  # equal names come to the same task
                    raise FilingError(f"doubled name: {name}")
                if not self.overwrite and fs.get_file_info(f"{target}/{name}").type != pafs.FileType.NotFound:
                    raise FilingError(f"file exists: {name}")
                seen.add(name)
                fs.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{base}/{name}") as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
        return Staged(task, len(seen))

    def commit(self, messages: list[Staged | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.staging)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{LISTED}") as out:
            out.write(json.dumps([[m.task, m.files] for m in messages if m]).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.staging)
        if fs.get_file_info(base).type == pafs.FileType.Directory:
            fs.delete_dir(base)


def publish(spark: SparkSession, staging: str, folder: str) -> int:
    """Move the files of a committed staging folder to their places; returns how many there were. Tasks move what they find,
    so a task that is run again, or a publishing that was stopped, goes on with what is left."""
    fs, base = pafs.FileSystem.from_uri(staging)
    with fs.open_input_stream(f"{base}/{LISTED}") as f:
        tasks = json.loads(f.read())
    wanted = [t for t, n in tasks if n]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, root = pafs.FileSystem.from_uri(staging)
        _, target = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for task in b.column("task").to_pylist():
                for i in own.get_file_info(pafs.FileSelector(f"{root}/{task}", recursive=True, allow_not_found=True)):
                    if i.type == pafs.FileType.File:
                        place = target + i.path.removeprefix(f"{root}/{task}")
                        own.create_dir(place.rpartition("/")[0], recursive=True)
                        own.move(i.path, place)
            yield pa.RecordBatch.from_arrays([b.column("task")], names=["task"])

    if wanted:
        spark.createDataFrame([(t,) for t in wanted], "task string").repartition(min(len(wanted), 1000)).mapInArrow(move, "task string").count()
    fs.delete_dir(base)
    return sum(n for _, n in tasks)


def write_files(rows: DataFrame, folder: str, overwrite: bool = False) -> int:
    """Write rows (name, content binary) as files of ``folder``; returns how many.

    Nothing is written if a name is unsafe, null, doubled or already there, or if any task fails. A null content is an
    empty file. The rows are evaluated once.
    """
    spark = rows.sparkSession
    spark.dataSource.register(StagedFiles)
    target = Files(spark, folder).uri
    staging = f"{target}/{STAGING}{uuid.uuid4().hex[:12]}"
    dealt = rows.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).repartition("name")
    try:
        dealt.write.format("staged_files").mode("append").option("folder", target).option("overwrite", str(overwrite).lower()).save(staging)
    except Exception as e:
        known = re.search(r"FilingError: ((?:unsafe name|doubled name|file exists): [^\n]*)", str(e))
        if known:
            raise FilingError(known[1]) from None
        raise
    return publish(spark, staging, target)
