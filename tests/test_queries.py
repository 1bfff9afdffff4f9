"""Every registered query of the library against its SQL, and the rest for shape."""

from __future__ import annotations

import base64
import hashlib
import json

import pytest
from oracle import difference

from filingflow.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    assert difference(spark, QUERIES[name], ORACLES[name], SF) == ""


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_texts_reach_the_operators(spark, tmp_path):
    long = "word " * 100
    ends = {0: "policy", 6: "\ufffd", 12: "<PH_2>c</PH_2>", 18: "7", 24: "", 29: "71", 4: "", 16: "", 10: "é" * 700, 11: ""}
    spark.createDataFrame([(k, long + x) for k, x in ends.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    reason = {r.doc_id: r.reason for r in QUERIES["validate_first_failure"](spark, str(tmp_path)).collect()}
    assert [reason[k] for k in (0, 6, 12, 18, 24)] == ["model_refusal", "replacement_character_validation_failed", "placeholder_validation_failed", None, None]
    counts = {(r.doc_id, r.reason): r.n for r in QUERIES["failure_histogram"](spark, str(tmp_path)).collect()}
    assert counts[(0, "model_refusal")] == 1 and counts[(6, "replacement_character_validation_failed")] == 1
    ok = {r.doc_id: r.ok for r in QUERIES["placeholder_check"](spark, str(tmp_path)).collect()}
    assert (ok[0], ok[12], ok[24], ok[4]) == (True, False, True, True)
    got = {r.filing_id: r for r in QUERIES["decode_payloads"](spark, str(tmp_path)).collect()}
    whole = (long + ends[10]).encode()
    raw = base64.b64encode((long + ends[16]).encode()) + b"*"
    assert got["10"].decode_status == "base64" and got["10"].size == len(whole) and got["10"].payload == hashlib.sha256(whole).hexdigest()
    assert got["16"].decode_status == "raw" and got["16"].size == len(raw) and got["16"].payload == hashlib.sha256(raw).hexdigest()


def test_manifests(spark):
    rows = QUERIES["manifests"](spark, SF).collect()
    docs = [json.loads(r.manifest)["documents"] for r in rows]
    assert len(rows) == 200 and all([d["doc_ordinal"] for d in x] == [0, 1] for x in docs)


def test_reports_count_every_unit(spark):
    rows = QUERIES["ladder_reports"](spark, SF).collect()
    assert rows
    for r in rows:
        s = json.loads(r.report)["summary"]
        assert s["total_units"] == sum(v for k, v in s.items() if k != "total_units")
        assert r.markdown.startswith("# Translation report")


def test_applied_pages_keep_their_markup(spark):
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    strip = lambda x: re.sub(r"<style data-filingflow.*?</style>|</?span[^>]*>|<head></head>", "", x).lower()
    for r in QUERIES["apply_units"](spark, SF).collect():
        a, b = re.findall(r"<[^>]+>", strip(r.html)), re.findall(r"<[^>]+>", strip(pages[r.page_id]))
        assert a == b or len(a) >= len(b) - 40


def test_blocks_are_consecutive(spark):
    rows = QUERIES["plan_blocks"](spark, SF).orderBy("doc_id", "batch_no").collect()
    last = {}
    for r in rows:
        before = last.get(r.doc_id, 0)
        assert r.block_no in (before, before + 1) and r.block_no >= 1
        last[r.doc_id] = r.block_no
