"""Stages of a run: each is written once, and a durable run that is started again reads what was finished before.

A stage is a Parquet folder with a commit marker that is made after all of its files are in place. A run names its stages in
the same order each time, so a run that was stopped finds the finished ones by their names; what was written without a
marker is replaced. The folder of a durable run is named after a fingerprint of what goes in, so other pages, settings or
models never meet stages that are not theirs.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .session import scratch_root, write_once

MARKER = "_COMMITTED"
#: The order of a run's stages: a change of it makes journals of before meet no run of after.
ORDER = 3


class Files:
    """The file system of a path, whatever its scheme, as Spark itself would reach it."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._jvm, raw = jvm, jvm.org.apache.hadoop.fs.Path(path)
        self._fs = raw.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = self._fs.makeQualified(raw)

    def __str__(self) -> str:
        """The absolute address, also of a relative path."""
        return self.path.toString()

    @property
    def uri(self) -> str:
        """The address as other libraries want it, with an empty authority for local files."""
        text = str(self).rstrip("/")
        return "file://" + text[5:] if text.startswith("file:/") and not text.startswith("file://") else text

    @property
    def real(self) -> str:
        """The address behind links, where files are local."""
        return os.path.realpath(self.uri[7:]) if self.uri.startswith("file://") else self.uri

    def below(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(self.path, name) if name else self.path

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.below(name))

    def names(self) -> list[str]:
        """What lies in the folder; nothing where there is none."""
        return [f.getPath().getName() for f in self._fs.listStatus(self.path)] if self.exists() else []

    def touch(self, name: str) -> None:
        self._fs.create(self.below(name), True).close()

    def remove(self) -> None:
        self._fs.delete(self.path, True)


def fingerprint(rows: DataFrame, *settings: object) -> str:
    """A digest of all rows in any order, and of the settings."""
    each = F.xxhash64(F.to_json(F.struct("*")))
    n, x, total = rows.agg(F.count("*"), F.bit_xor(each), F.sum(F.pmod(each, F.lit(1_000_000_007)))).first()
    return hashlib.sha256(repr((ORDER, n, x, total, settings)).encode()).hexdigest()[:32]


class Stages:
    """Writes stages in one folder. Without a folder they are scratch tables of this run alone."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.durable = spark, folder is not None
        self.base = folder or f"{scratch_root(spark)}/filingflow/run-{uuid.uuid4().hex[:12]}"
        self._n = 0
        #: How many stages were found finished.
        self.resumed = 0

    def keep(self, rows: DataFrame, group: str) -> DataFrame:
        """The rows, written as the next stage of the group and read from there; the plan is not run where it was finished."""
        path = f"{self.base}/{group}/{self._n:06d}"
        self._n += 1
        files = Files(self.spark, path) if self.durable else None
        if files and files.exists(MARKER):
            self.resumed += 1
        else:
            write_once(rows, path)
            if files:
                files.touch(MARKER)
        return self.spark.read.schema(rows.schema).parquet(path)

    def all(self, group: str, schema: StructType) -> DataFrame:
        """The rows of all stages of a group, from one scan however many there are."""
        path = f"{self.base}/{group}"
        if not Files(self.spark, path).exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    def in_waves(self, rows: DataFrame, group: str, key: list[str], most: int | None, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``make`` of the rows as a stage; in a durable run as several, each with about ``most`` rows by a hash of the key, so
        that a stopped run loses no more than one of them."""
        waves = -(-rows.count() // most) if self.durable and most else 1
        if waves <= 1:
            return self.keep(make(rows), group)
        out = None
        for k in range(waves):
            own = self.keep(make(rows.where(F.pmod(F.xxhash64(*key), F.lit(waves)) == k)), group)
            out = own if out is None else out.unionByName(own)
        return out
