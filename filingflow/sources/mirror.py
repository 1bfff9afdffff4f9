"""A mirror of filings as a data source: ``root/TICKER/FORM/accession/file`` become rows, one partition for each accession.

Filters on ticker, form and filing_id are taken over by the source, which then lists and opens only the folders that can
hold an answer; what it cannot use stays with Spark. How folders are listed and files are read is a transport, so that a
mirror can lie behind anything that lists and reads.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..stages import Files

SCHEMA = "ticker string, form string, filing_id string, source_file string, content binary"
#: Columns whose values are folder names, outermost first.
LEVELS = ("ticker", "form", "filing_id")


class Transport(Protocol):
    def folders(self, path: str) -> list[str]: ...

    def files(self, path: str) -> list[str]: ...

    def read(self, path: str) -> bytes: ...


class FileTransport:
    """Folders and files of any address that Arrow's file systems reach. Names are looked up, not assumed to exist."""

    def _list(self, path: str, kind: pafs.FileType) -> list[str]:
        fs, root = pafs.FileSystem.from_uri(path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == kind)

    def folders(self, path: str) -> list[str]:
        return self._list(path, pafs.FileType.Directory)

    def files(self, path: str) -> list[str]:
        return self._list(path, pafs.FileType.File)

    def read(self, path: str) -> bytes:
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(name) as f:
            return f.read()


def made(name: str | None) -> Transport:
    """The transport that a ``module:function`` makes; files without a name."""
    if not name:
        return FileTransport()
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


@dataclass
class Accession(InputPartition):
    ticker: str
    form: str
    filing_id: str


class MirrorSource(DataSource):
    """Options: path (the root), transport (``module:function``), suffix (of the files that are read, ``.txt``)."""

    @classmethod
    def name(cls) -> str:
        return "filing_mirror"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MirrorReader(dict(self.options))


@dataclass
class MirrorReader(DataSourceReader):
    options: dict[str, str]
    #: Values that a level may have; a level that no filter names may have any.
    wanted: dict[str, set[str]] = field(default_factory=dict)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - the name that Spark calls
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in LEVELS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def _below(self, transport: Transport, path: str, level: str) -> list[str]:
        names = transport.folders(path)
        return [n for n in names if n in self.wanted[level]] if level in self.wanted else names

    def partitions(self) -> list[Accession]:
        root, transport = self.options["path"].rstrip("/"), made(self.options.get("transport"))
        out = []
        for ticker in self._below(transport, root, "ticker"):
            for form in self._below(transport, f"{root}/{ticker}", "form"):
                out += [Accession(ticker, form, x) for x in self._below(transport, f"{root}/{ticker}/{form}", "filing_id")]
        return out or [Accession("", "", "")]

    def read(self, partition: Accession) -> Iterator[Any]:
        if not partition.filing_id:
            return
        transport, suffix = made(self.options.get("transport")), self.options.get("suffix", ".txt")
        folder = "/".join([self.options["path"].rstrip("/"), partition.ticker, partition.form, partition.filing_id])
        names = ["ticker", "form", "filing_id", "source_file", "content"]
        for name in transport.files(folder):
            if name.endswith(suffix):
                path = f"{folder}/{name}"
                row = [partition.ticker, partition.form, partition.filing_id, path, transport.read(path)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if k == 4 else pa.string()) for k, x in enumerate(row)], names=names)


def open_mirror(spark: SparkSession, root: str, transport: str | None = None) -> DataFrame:
    """The files of a mirror as rows of ``SCHEMA``; filter them by ticker, form or filing_id to open only those folders."""
    spark.dataSource.register(MirrorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    frame = spark.read.format("filing_mirror").option("path", Files(spark, root).uri if transport is None else root)
    return (frame.option("transport", transport) if transport else frame).load()


def wanted_folders(requests: DataFrame) -> tuple[list[str], list[str]]:
    """(tickers, forms) that requests name, in capitals: a list of requests is what a user types, so it is small."""
    rows = requests.select(F.upper("ticker"), F.upper("form")).distinct().collect()
    return sorted({r[0] for r in rows if r[0]}), sorted({r[1] for r in rows if r[1]})
