"""Scalars, parsing, HTML units, planning, cache, configuration, sources, sinks and streams on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from filingflow import config
from filingflow.functions import text as T
from filingflow.operators import cache as C
from filingflow.operators import html_units as H
from filingflow.operators import ladder as L
from filingflow.operators import planning as P
from filingflow.operators import report as R
from filingflow.operators import submission as S
from filingflow.operators.provider import KeyedProvider, call, prime
from filingflow.sources import files, sink


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text", ["RMB", "2024", "(1,234)", "ABCDEF", "F-12", "ABC-123", "https://a.b", "a@b.co", "年度", ""])
def test_low_value(spark, text):
    assert value(spark, T.is_low_value(F.lit(text))) is True and H.low_value(text)


@pytest.mark.parametrize("text", ["ABCDEFG", "Item 5", "Revenue 2024"])
def test_worth_a_call(spark, text):
    assert value(spark, T.is_low_value(F.lit(text))) is False and not H.low_value(text)


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert v(T.clip(F.lit("x" * 160))) == "x" * 160 and v(T.clip(F.lit("x" * 161))) == "x" * 157 + "..."
    assert v(T.number_tokens(F.lit("Rev 1,234.50 and 20-F 3.D"))) == ["1234.50", "20", "3"]
    for a, b, same in (("a 1 1", "x 1", False), ("1,000", "1000", True), ("1.0", "1", False), ("5", "5 6", True)):
        assert v(T.numbers_preserved(F.lit(a), F.lit(b))) is same
    assert v(T.placeholder_names(F.lit("<PH_0>a</PH_0><PH_1>b</PH_2>"))) == ["PH_0"]
    assert v(T.json_payload(F.lit('Here: [{"id":"a"}] bye'))) == '[{"id":"a"}]' and v(T.json_payload(F.lit("none"))) == "none"
    assert v(T.looks_like_refusal(F.lit("抱歉，我无法协助翻译该内容。"))) and not v(T.looks_like_refusal(F.lit("我们可能无法维持过去的增长率，且不能保证未来经营结果。")))
    assert v(T.is_repairable_error(F.lit("number_validation_failed"))) and not v(T.is_format_error(F.lit("number_validation_failed")))
    assert not v(T.is_repairable_error(F.lit("model_refusal"))) and v(T.is_context_limit_error(F.lit("Maximum context reached")))
    assert [v(T.estimate_tokens(F.lit(x))) for x in ("", "a", "abc")] == [1, 1, 2]
    assert [v(T.mask_key(F.lit(x))) for x in ("", "abcdef", "abcdefg")] == ["", "***", "ab***fg"]
    assert [v(T.duration(F.lit(x))) for x in (59, 60, 3661, None)] == ["59s", "1m00s", "1h01m", "unknown"]
    assert [v(P.shrink_size(F.lit(x), m, 0.5)) for x, m in ((20, 1), (1, 1), (2, 2))] == [10, 1, 1]
    assert [v(P.grow_size(F.lit(x), 80, 1.25)) for x in (20, 1, 80)] == [25, 2, 80]
    assert P.input_budget(350, 4096, 0.95, 10) == 64 and P.block_budgets(64, 0.2, 0.6, 0.2) == (12, 38, 12)


def test_content_kinds(spark):
    rows = [("a.htm", "GRAPHIC", "html"), ("a", "GRAPHIC", "image"), ("a.xml", "EX-101.INS", "xbrl"), ("a.xml", "XML", "xml"), ("a.xsd", "", "xbrl"), ("R1", "", "unknown"), (".htm", "", "unknown")]
    got = spark.createDataFrame(rows, "f string, t string, k string").select(S.content_kind(F.col("f"), F.col("t")).alias("x"), "k").collect()
    assert all(r.x == r.k for r in got)


BUNDLE = "<SEC-HEADER>x\nACCESSION NUMBER: 1\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>20-F\n<SEQUENCE>1\n<FILENAME>a.htm\n<TEXT>\n<p>Hi</p>\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>GRAPHIC\n<SEQUENCE>2\n<FILENAME>../b.png\n<TEXT>\nbegin 644 b.png\n#0V%T garbage\n`\nend\n</TEXT>\n</DOCUMENT>"


def test_bundle(spark):
    s = spark.createDataFrame([("f", BUNDLE), ("none", ""), ("null", None)], "filing_id string, submission string")
    docs = {r.doc_ordinal: r for r in S.split_documents(s).collect()}
    assert docs[0].text == "<p>Hi</p>" and docs[0].error is None and docs[1].error == "unsafe filename"
    payload = S.decode_payloads(S.split_documents(s)).where("doc_ordinal = 1").first()
    assert payload.decode_status == "uuencode" and bytes(payload.payload) == b"Cat" and payload.size == 3
    assert S.manifests(s, S.split_documents(s), S.decode_payloads(S.split_documents(s))).count() == 3


PAGE = '<html><head><title>T</title></head><body><h1>Annual Report</h1><table><tr><th>Revenue<td>1,234</tr><tr><td>Total liabilities</td></tr></table><p>See <a href="#x">Item 5</a> for liquidity.</p><script>var a = "<p>no</p>"</script><div style="display: none"><p>Hidden words</p></div></body></html>'


def test_units_of_a_page():
    units = list(H.units_of(PAGE))
    assert [u[3] for u in units] == ["Annual Report", "Revenue", "Total liabilities", "See <PH_0>Item 5</PH_0> for liquidity."]
    assert [u[0] for u in units] == [1, 2, 3, 4] and units[3][5] == [("PH_0", '<a href="#x">')]
    assert H.splice(PAGE, [(u[0], u[3], False) for u in units]) == PAGE
    out = H.splice(PAGE, [(1, "Bericht <1>", True)])
    assert '<span class="fallback-translation" title="fallback model translation">Bericht &lt;1&gt;</span>' in out and out.count('data-filingflow="fallback"') == 1
    nested = "<p><span><b>Deep text</b></span></p><p>Open one<p>Open two<div>Loose <p>Leaf words</p></div>"
    assert [u[3] for u in H.units_of(nested)] == ["Deep text", "Open one", "Open two", "Leaf words"]
    assert H.splice(nested, [(1, "New", False)]).startswith("<p><span><b>New</b></span></p>")


def test_extract_nulls_and_empty(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, PAGE, "z"), (3, PAGE, "z")], "page_id long, html string, doc_id string")
    assert H.extract_units(pages, "page_id").count() == 8
    assert H.extract_units(pages.limit(0), "page_id").count() == 0


def units(spark, texts, doc_id=1):
    rows = [(doc_id, k + 1, f"u_{k + 1:04d}", t, t, []) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, ordinal int, unit_id string, text string, source_text string, placeholders array<struct<name:string,html:string>>")


def test_batches(spark):
    got = P.greedy_batches(units(spark, ["x" * n for n in (5, 5, 5, 20, 1, 1)]), 2, 10).orderBy("ordinal").collect()
    assert [r.batch_no for r in got] == [1, 1, 2, 3, 4, 4]
    cached = units(spark, ["a", "b", "c", "d"]).withColumn("cached", F.col("ordinal") == 2)
    assert [r.batch_no for r in P.greedy_batches(cached, 9, 99).orderBy("ordinal").collect()] == [1, None, 2, 2]


def test_contexts(spark):
    rows = P.greedy_batches(units(spark, ["aaa", "bbb", "ccc", "ddd"]), 1, 99)
    got = {r.batch_no: r for r in P.with_contexts(rows, 24, 5).collect()}
    assert got[1].context_before == "" and got[4].context_before == "u_0002: bbb\nu_0003: ccc"
    assert got[1].context_after == "u_0002: bbb" and got[4].context_after == ""


def providers():
    """Factories as nested functions, which travel to the workers by value."""
    answers = {("primary", "u_0002"): "", ("repair-0", "u_0002"): "", ("split-1", "u_0002"): "kept", ("strict-0", "u_0002"): ""}
    first = lambda: KeyedProvider("one", answers, make=lambda t: "!error" if t == "down 3" else t.upper())
    second = lambda: KeyedProvider("two", make=lambda t: "no number" if t == "source 4" else t + "!")
    return first, second


def test_ladder(spark):
    rows = P.greedy_batches(units(spark, ["first", "second", "down 3", "fine 5"]), 2, 99)
    results, attempts = L.run_ladder(rows, *providers())
    got = {r.ordinal: (r.result, r.provider) for r in results.collect()}
    assert got == {1: ("FIRST", "one"), 2: ("kept", "one"), 3: ("down 3!", "two"), 4: ("FINE 5", "one")}
    counts = {r.reason: r.n for r in R.failure_histogram(attempts).collect()}
    assert counts["provider_error"] >= 2 and counts["empty_translation"] >= 2 and counts["repair_failed"] >= 1
    assert R.reports(results, attempts).count() == 1


def test_ladder_keeps_the_source(spark):
    results, _ = L.run_ladder(P.greedy_batches(units(spark, ["down 3"]), 2, 99), providers()[0])
    assert [(r.result, r.provider) for r in results.collect()] == [("down 3", "source")]
    assert L.run_ladder(P.greedy_batches(units(spark, ["x"]).limit(0), 2, 99), providers()[0])[0].count() == 0


def test_retries_and_priming(spark):
    rows = spark.createDataFrame([("r", [("u", "!error")])], "rung string, units array<struct<id:string,text:string>>")
    got = call(rows, lambda: KeyedProvider("m", make=str), retries=2, pause=lambda s: None).first()
    assert got.error == "provider is down" and got.response is None
    assert prime(spark.createDataFrame([("p",), ("p",)], "block_prompt string"), KeyedProvider).count() == 1


def test_cache_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('\n{"cache_key":"a","text":"1"}\nnot json\n[1]\n{"cache_key":"a","text":"2"}\n{"cache_key":"b","text":"\\ufffd"}\n{"cache_key":"","text":"x"}\n')
    rows = C.last_wins(C.parse_lines(C.read_cache_lines(spark, str(tmp_path))))
    assert [(r.cache_key, r.text) for r in rows.collect()] == [("a", "2")]


def test_cache_log_orders_runs_and_files(spark, tmp_path):
    line = lambda text, **more: json.dumps({"cache_key": "k", "text": text, "provider": "m", **more}) + "\n"
    for first, second in (("old", "new"), ("old" * 9000, "new"), ("old", "new" * 9000)):  # the order of sizes must not matter
        folder = tmp_path / f"{len(first)}-{len(second)}"
        folder.mkdir()
        (folder / "a.jsonl").write_text(line("older") + line(first))
        (folder / "b.jsonl").write_text(line(second))
        rows = C.last_wins(C.parse_lines(C.read_cache_lines(spark, str(folder)))).collect()
        assert [r.text for r in rows] == [second]
    log = str(tmp_path / "log")
    for run, text in ((1, "one"), (2, "two")):
        results = spark.createDataFrame([("k", "f", 1, "u_0001", "source", text, "m")], "cache_key string, file_hash string, doc_id long, unit_id string, source_text string, result string, provider string")
        C.append(C.cache_rows(results, C.prompt_hash("p"), "zh-CN", "m", run), log)
    found = C.read_log(spark, log)
    assert found.first().text == "two" and C.next_run(found) == 3
    assert {f.name for f in found.schema} >= {"file_hash", "source_hash", "prompt_hash", "target_language", "model", "source_preview"}


def test_mirror_bounds(spark, tmp_path):
    for k, day in enumerate(("20230105", "20230601", "20240201")):
        folder = tmp_path / "ACME" / "20-F" / f"acc{k}"
        folder.mkdir(parents=True)
        (folder / "full-submission.txt").write_text(f"<SEC-HEADER>\nFILED AS OF DATE: {day}\n</SEC-HEADER>\n" + BUNDLE)
    ask = lambda **more: sorted(r.filing_id for r in files.read_mirror(spark, str(tmp_path), spark.createDataFrame([("acme", "20-f", more.get("after"), more.get("before"), more.get("limit"))], "ticker string, form string, after string, before string, limit int")).collect())
    assert ask() == ["acc0", "acc1", "acc2"] and ask(limit=2) == ["acc1", "acc2"]
    assert ask(after="2023-02-01", before="2023-12-31") == ["acc1"]


def test_config():
    c = config.loads('﻿[model]\nmodel = "m"\n[batch]\nmin_units = 2\n[sec]\nemail = "a@b.co"\n')
    assert c.model.model == "m" and c.batch.min_units == 2 and c.fallback_model is None and config.loads(config.TEMPLATE).model is None
    for bad in ("[batch]\nmin_units = 0", "[block]\nmax_input_ratio = 2.0", '[sec]\nemail = "bad@example..com"', "x ="):
        with pytest.raises(config.ConfigError):
            config.loads(bad)
    assert config.default_output("r.htm") == "r_translated.htm" and config.default_output("r") == "r_translated.html"


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "m" / "ACME" / "20-F" / "acc"
    folder.mkdir(parents=True)
    (folder / "full-submission.txt").write_bytes(BUNDLE.replace("\n", "\r\n").encode() + b"\xff")
    wanted = spark.createDataFrame([("acme", "20-f")], "ticker string, form string")
    row = files.read_mirror(spark, str(tmp_path / "m"), wanted).first()
    assert row.filing_id == "acc" and "\r" not in row.submission and row.submission.endswith("�")
    files.check_download(spark, f"file://{tmp_path}/m", None)
    (folder / "zero.txt").write_bytes(b"")
    for path, count in ((f"file://{tmp_path}/m", 1), (f"file://{tmp_path}/m", 0), (f"file://{tmp_path}/none", 1)):
        with pytest.raises(config.FilingError):
            files.check_download(spark, path, count)
    rows = spark.createDataFrame([("a/x.bin", b"1"), ("y.bin", b"2")], "name string, content binary")
    out = f"file://{tmp_path}/out"
    assert sink.write_files(rows, out) == 2 and (tmp_path / "out/a/x.bin").read_bytes() == b"1"
    with pytest.raises(config.FilingError):
        sink.write_files(rows, out)
    assert sink.write_files(rows, out, overwrite=True) == 2
    with pytest.raises(config.FilingError):
        sink.write_files(spark.createDataFrame([("../x", b"")], "name string, content binary"), out)


def test_stream(spark, tmp_path):
    from filingflow.streaming.submissions import submission_stream, unpack_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(BUNDLE)
    for _ in range(2):  # a second run finds nothing new
        unpack_stream(submission_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/documents")).count() == 2 and spark.read.parquet(str(tmp_path / "out/payloads")).count() == 1
