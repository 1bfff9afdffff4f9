"""Session helpers: a local session for tests and the bench, and the package's own code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="filingflow-"), "filingflow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(path)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables in between, which the session names in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder; on a cluster, where other machines would not see it, this is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="filingflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: With it Spark deletes the shuffle files of a query when the query ends, and does not wait for the driver's garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """While a table in between is written: nothing later reads the shuffle files of that write."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df``, written to ``path`` in little space and read from there."""
    spark = df.sparkSession
    with tidy(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once under the shared folder and read from there, so that costly work is not repeated when
    executors are lost or a second action runs."""
    return write_once(df, f"{scratch_root(df.sparkSession)}/filingflow/{name}-{uuid.uuid4().hex[:12]}")
