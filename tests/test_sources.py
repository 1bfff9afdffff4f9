"""The mirror as a data source that opens what is asked for, and the log of answers on shelves."""

from __future__ import annotations

import hashlib
import os
import sys

import pytest
from pyspark import cloudpickle
from test_filing import BUNDLE

from filingflow.operators import cache as C
from filingflow.sources import files, mirror

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def root(tmp_path):
    for ticker in ("ACME", "BETA"):
        for form in ("20-F", "6-K"):
            for k in range(3):
                folder = tmp_path / "m" / ticker / form / f"acc{k}"
                folder.mkdir(parents=True)
                (folder / "full-submission.txt").write_text(BUNDLE)
                (folder / "primary.htm").write_text("<p>x</p>")
    return tmp_path / "m"


SEEN: list[str] = []


class Watched(mirror.FileTransport):
    def folders(self, path):
        SEEN.append(path)
        return super().folders(path)


def test_only_the_folders_that_are_asked_for_are_opened(spark, root):
    base = f"file://{root}"
    reader = mirror.MirrorReader({"path": base, "transport": f"{__name__}:Watched"})
    left = list(reader.pushFilters([mirror.EqualTo(("ticker",), "ACME"), mirror.In(("form",), ("20-F", "X")), mirror.EqualTo(("source_file",), "y")]))
    assert [type(f).__name__ + str(f.attribute) for f in left] == ["EqualTo('source_file',)"]
    assert [(p.ticker, p.form, p.filing_id) for p in reader.partitions()] == [("ACME", "20-F", f"acc{k}") for k in range(3)]
    assert [p.removeprefix(base) for p in SEEN] == ["", "/ACME", "/ACME/20-F"]
    frame = mirror.open_mirror(spark, str(root)).where("ticker = 'ACME' AND form IN ('20-F') AND filing_id <> 'acc1'")
    assert frame.rdd.getNumPartitions() == 3 and {r.filing_id for r in frame.collect()} == {"acc0", "acc2"}
    assert {r.source_file.rpartition("/")[2] for r in frame.collect()} == {"full-submission.txt"}
    assert mirror.open_mirror(spark, str(root)).count() == 12 and mirror.open_mirror(spark, str(root)).where("ticker = 'NONE'").count() == 0
    rows = files.read_mirror(spark, str(root), spark.createDataFrame([("beta", "6-k", 2)], "ticker string, form string, limit int"))
    assert sorted(r.filing_id for r in rows.collect()) == ["acc1", "acc2"] and {"ticker", "form", "submission", "content"} <= set(rows.columns)


class Invented:
    """A mirror that is nowhere: one filing of each of two tickers."""

    def folders(self, path):
        return {0: ["AA", "BB"], 1: ["F1"], 2: ["one"]}[path.removeprefix("mem:").count("/")]

    def files(self, path):
        return ["a.txt", "b.bin"]

    def read(self, path):
        return path.encode()


def test_a_transport_is_injected(spark):
    reader = mirror.MirrorReader({"path": "mem:", "transport": f"{__name__}:Invented"})
    list(reader.pushFilters([mirror.EqualTo(("ticker",), "BB")]))
    (own,) = reader.partitions()
    assert [b.to_pylist() for b in reader.read(own)] == [[{"ticker": "BB", "form": "F1", "filing_id": "one", "source_file": "mem:/BB/F1/one/a.txt", "content": b"mem:/BB/F1/one/a.txt"}]]


def rows_of(spark, pages, run, text):
    rows = [(f"k{p}-{n}", hashlib.sha256(str(p).encode()).hexdigest(), f"u{n}", "source", f"{text} {p} {n}", "m") for p in pages for n in range(3)]
    made = spark.createDataFrame(rows, "cache_key string, file_hash string, unit_id string, source_text string, result string, provider string")
    return C.cache_rows(made, C.prompt_hash("p"), "zh-CN", "m", run)


def test_a_lookup_reads_its_shelves_alone(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    C.append(rows_of(spark, range(40), 1, "one"), log)
    C.append(rows_of(spark, range(0, 40, 2), 2, "two"), log)
    asked = spark.createDataFrame([(hashlib.sha256(b"4").hexdigest(),), (hashlib.sha256(b"5").hexdigest(),)], "file_hash string")
    found = C.read_log(spark, log, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shelf" in plan or "PartitionFilters: [shelf" in plan
    got = {r.cache_key: r.text for r in found.collect()}
    assert got["k4-1"] == "two 4 1" and got["k5-0"] == "one 5 0" and len(got) < 40
    assert {r.cache_key: r.text for r in C.read_log(spark, log).collect()} == {f"k{p}-{n}": f"{'one' if p % 2 else 'two'} {p} {n}" for p in range(40) for n in range(3)}


def test_compaction_keeps_the_latest_rows(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    for run, text in ((1, "one"), (2, "two"), (3, "three")):
        C.append(rows_of(spark, range(9), run, text), log)
    before = {(r.cache_key, r.text, r.run) for r in C.read_log(spark, log).collect()}
    half = tmp_path / "log/version-1"  # what a stopped compaction has left is no version
    half.mkdir()
    (half / "x.json").write_text("{}")
    assert {(r.cache_key, r.text, r.run) for r in C.read_log(spark, log).collect()} == before
    assert C.compact(spark, log) == 1 and {(r.cache_key, r.text, r.run) for r in C.read_log(spark, log).collect()} == before
    shelves = [d for d in os.listdir(half) if d.startswith("shelf=")]
    assert shelves and all(len([f for f in os.listdir(half / d) if f.endswith(".json")]) == 1 for d in shelves)
    C.append(rows_of(spark, [3], 4, "four"), log)
    later = {r.cache_key: r.text for r in C.read_log(spark, log).collect()}
    assert later["k3-0"] == "four 3 0" and later["k4-0"] == "three 4 0" and C.next_run(C.read_log(spark, log)) == 5
    assert C.compact(spark, log) == 2 and {r.cache_key: r.text for r in C.read_log(spark, log).collect()} == later and not (tmp_path / "log/version-0").exists()
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.jsonl").write_text('{"cache_key": "k", "text": "t", "provider": "m"}\n')
    assert [r.text for r in C.read_log(spark, f"file://{plain}").collect()] == ["t"]
