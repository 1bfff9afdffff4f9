"""Whole runs: translation with a cache, unpacking to files, linear mode, the command line."""

from __future__ import annotations

import json

from test_filing import BUNDLE, PAGE

from filingflow.__main__ import main
from filingflow.config import Batch, Block, Config, Model
from filingflow.operators.provider import KeyedProvider
from filingflow.operators.report import reports
from filingflow.plans.translate import blocks, linear, translate, unpack
from filingflow.sources.sink import write_files


def test_translate_and_rerun(spark):
    pages = spark.createDataFrame([("a", PAGE), ("b", "<p>nothing"), ("c", None)], "doc_id string, html string")
    one, two = (lambda: KeyedProvider("one", make=lambda t: "" if "Revenue" in t else t.replace("Annual", "Yearly"))), (lambda: KeyedProvider("two", make=str.lower))
    run = translate(pages, one, two, fallback_model="two")
    out = {r.doc_id: r.html for r in run.pages.collect()}
    assert "<h1>Yearly Report</h1>" in out["a"] and 'title="fallback model translation">revenue</span>' in out["a"]
    assert '<p>See <a href="#x">Item 5</a> for liquidity.</p>' in out["a"] and out["c"] is None
    report = {r.doc_id: json.loads(r.report) for r in run.reports.collect()}["a"]["summary"]
    assert report["total_units"] == 4 and report["fallback_success"] == 1 and report["source_retained"] == 0
    again = translate(pages, lambda: KeyedProvider("one", make=lambda t: "!error"), None, cache=run.cache_rows.select("cache_key", "text", "provider"), fallback_model="two")
    assert {r.doc_id: r.html for r in again.pages.collect()} == out and again.attempts.count() == 0
    changed = spark.createDataFrame([("a", PAGE + " ")], "doc_id string, html string")
    assert translate(changed, one, two, cache=run.cache_rows.select("cache_key", "text", "provider")).attempts.count() > 0


def test_requests_carry_their_context(spark):
    class Echo:
        model = "echo"

        def translate(self, request):
            return json.dumps([{"id": u["id"], "text": request["prompt"]} for u in request["units"]])

    pages = spark.createDataFrame([("a", "<p>alpha words</p><p>beta words</p><p>gamma words</p>")], "doc_id string, html string")
    run = translate(pages, lambda: Echo(), config=Config(batch=Batch(initial_units=1)))
    got = {r.unit_id: r.result for r in run.results.collect()}
    assert "u_0001: alpha words" in got["u_0002"] and "u_0003: gamma words" in got["u_0002"] and "alpha" not in got["u_0001"].split("# Task")[0]


def test_unpack_writes_files(spark, tmp_path):
    s = spark.createDataFrame([("f", BUNDLE.replace("../b.png", "a.htm"))], "filing_id string, submission string")
    files, _ = unpack(s)
    assert write_files(files, f"file://{tmp_path}/o") == 3
    assert (tmp_path / "o/f/a.htm").read_text() == "<p>Hi</p>" and (tmp_path / "o/f/1-a.htm").read_bytes() == b"Cat"
    assert len(json.loads((tmp_path / "o/f/manifest.json").read_text())["documents"]) == 2


def test_linear_mode_adapts(spark):
    rows = [(1, k + 1, f"u{k}", f"text {k}", f"text {k}") for k in range(7)]
    units = spark.createDataFrame(rows, "doc_id long, ordinal int, unit_id string, text string, source_text string")
    factory = lambda: KeyedProvider("one", make=lambda t: "!error" if t == "text 2" else t.upper())
    results, attempts = linear(units, factory, config=Config(batch=Batch(initial_units=4, grow_after_successes=2)))
    got = {r.unit_id: r for r in results.collect()}
    assert got["u2"].provider == "source" and got["u2"].result == "text 2" and got["u6"].result == "TEXT 6"
    assert max(r.call for r in got.values()) > 4 and got["u0"].batch_size == 2
    assert attempts.where("reason is not null").count() >= 3


def block_config(**more):
    return Config(batch=Batch(max_units=2), block=Block(enabled=True, target_batch_units=2, max_batches_per_block=8, warmup_delay_seconds=0.0, **more), model=Model("one", max_retries=1, api_key="secret-key"))


def test_block_mode_shrinks_primes_and_falls_back(spark):
    class Windowed(KeyedProvider):
        """A model whose context holds two batches; it notes what it primes and knows its usage."""

        def translate(self, request):
            if request["prompt"].count('"batch_id"') > 2:
                raise RuntimeError("Maximum context length exceeded")
            return super().translate(request)

        def prime(self, prompt):
            if "text 0" in prompt:
                raise RuntimeError("no cache today")

        def usage(self):
            return {"prompt_tokens": 10, "completion_tokens": 2, "total_tokens": 12, "prompt_cache_hit_tokens": 8, "prompt_cache_miss_tokens": 2}

    rows = [(d, k + 1, f"u_{k + 1:04d}", f"text {k}", f"text {k}", []) for d in (1, 2) for k in range(12)]
    units = spark.createDataFrame(rows, "doc_id long, ordinal int, unit_id string, text string, source_text string, placeholders array<struct<name:string,html:string>>")
    second = lambda: KeyedProvider("two", make=lambda t: t + "!")
    first = lambda: Windowed("one", make=lambda t: "" if t == "text 5" else t.upper())
    results, attempts = blocks(units, first, second, block_config())
    got = {(r.doc_id, r.ordinal): (r.result, r.provider) for r in results.collect()}
    assert len(got) == 24 and got[(1, 6)] == ("text 5!", "two") and got[(2, 1)] == ("TEXT 0", "one")
    reasons = [(r.rung, r.reason) for r in attempts.where("reason is not null").collect()]
    assert any(x[0] == "prime" and x[1].startswith("cache_warmup_failed") for x in reasons)
    assert any("context length" in x[1] for x in reasons) and attempts.agg({"turn": "max"}).first()[0] > 0  # planned again
    report = json.loads(reports(results, attempts, [("primary", "one", "u", "secret-key", 1000, 10)]).where("doc_id = 1").first().report)
    assert report["models"][0]["api_key"] == "se***ey" and report["usage"][0]["prompt_cache_hit_ratio"] == 0.8


def test_mini_blocks_reach_two_batches_to_each_side(spark):
    rows = [(1, k + 1, f"u_{k + 1:04d}", f"word {k}", f"word {k}", []) for k in range(9)]
    units = spark.createDataFrame(rows, "doc_id long, ordinal int, unit_id string, text string, source_text string, placeholders array<struct<name:string,html:string>>")

    class Near:
        model = "near"

        def translate(self, request):
            if request["units"][0]["id"] == "u_0005" and request["rung"] != "mini":
                return json.dumps([{"id": "u_0005", "text": ""}])
            return json.dumps([{"id": u["id"], "text": request["prompt"] if request["rung"] == "mini" else u["text"]} for u in request["units"]])

    results, _ = blocks(units, lambda: Near(), None, Config(batch=Batch(max_units=1), block=Block(enabled=True, target_batch_units=1, max_workers=1), model=Model("near", max_retries=1)))
    text = {r.unit_id: r.result for r in results.collect()}["u_0005"]
    assert [f"word {k}" in text for k in range(9)] == [k in (2, 3, 4, 5, 6) for k in range(9)]


def test_linear_mode_validates(spark):
    rows = [(1, k + 1, f"u{k}", t, t, c) for k, (t, c) in enumerate([("one", False), ("two 2", False), ("three", True), ("four", False), ("five", False)])]
    units = spark.createDataFrame(rows, "doc_id long, ordinal int, unit_id string, text string, source_text string, cached boolean")

    class Odd:
        model = "odd"

        def translate(self, request):
            out = {"one": "```json\n%s\n```", "two 2": "%s", "four": "I cannot do this", "five": "%s"}[request["units"][0]["text"]]
            said = [{"id": u["id"], "text": {"two 2": "zwei", "five": "f\ufffdnf"}.get(u["text"], u["text"].upper())} for u in request["units"]]
            return out % json.dumps(said) if "%s" in out else out

    second = lambda: KeyedProvider("two", make=lambda t: t + "!")
    results, attempts = linear(units, lambda: Odd(), second, Config(batch=Batch(initial_units=1, max_units=1)))
    assert {r.unit_id: (r.result, r.provider) for r in results.collect()} == {"u0": ("ONE", "odd"), "u1": ("two 2!", "two"), "u3": ("four!", "two"), "u4": ("five!", "two")}
    assert sorted(r.reason for r in attempts.where("reason is not null").collect()) == ["model_refusal", "number_validation_failed", "replacement_character_validation_failed"]


def test_translate_command(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.htm").write_text(PAGE)
    (tmp_path / "c.toml").write_text('[model]\nmodel = "one"\nbase_url = "http://x"\napi_key = "k"\n')
    (tmp_path / "p.toml").write_text('[model]\nmodel = "one"\nbase_url = "http://x"\napi_key = "YOUR_API_KEY"\n')
    base = ["translate", str(tmp_path / "in"), f"file://{tmp_path}/out", "--provider", "filingflow.operators.provider:dry_run", "--cache", str(tmp_path / "log")]
    assert main([*base, "--config", str(tmp_path / "p.toml")]) == 2 and "api_key" in capsys.readouterr().err
    assert main(["translate", str(tmp_path / "in"), str(tmp_path / "in"), *base[3:], "--config", str(tmp_path / "c.toml")]) == 2
    assert main([*base, "--config", str(tmp_path / "c.toml")]) == 0
    assert "ANNUAL REPORT" in (tmp_path / "out/a_translated.htm").read_text()
    assert json.loads((tmp_path / "out/a_translated_translation_report.json").read_text())["summary"]["cache_hits"] == 0
    assert "# Translation report" in (tmp_path / "out/a_translated_translation_report.md").read_text()
    assert main([*base, "--config", str(tmp_path / "c.toml")]) == 2 and "exists" in capsys.readouterr().err
    assert main([*base, "--config", str(tmp_path / "c.toml"), "--overwrite"]) == 0
    assert json.loads((tmp_path / "out/a_translated_translation_report.json").read_text())["summary"]["cache_hits"] > 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in/f").mkdir(parents=True)
    (tmp_path / "in/f/full.txt").write_text(BUNDLE)
    assert main(["unpack", str(tmp_path / "in"), f"file://{tmp_path}/out"]) == 0
    assert main(["unpack", str(tmp_path / "in"), f"file://{tmp_path}/out"]) == 2 and "exists" in capsys.readouterr().err
    assert main(["config"]) == 0 and "[model]" in capsys.readouterr().out
