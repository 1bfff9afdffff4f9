"""Durable runs, bounded concurrency, states of linear and block mode, the committed sink, and the command line's addresses."""

from __future__ import annotations

import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_filing import PAGE

from filingflow.__main__ import main
from filingflow.config import Batch, Block, Config, FilingError, Model
from filingflow.functions import text as T
from filingflow.operators import ladder as L
from filingflow.operators import planning as P
from filingflow.operators.provider import KeyedProvider, call, prime, usage_totals
from filingflow.operators.responses import first_failure
from filingflow.plans.blocks import blocks, next_state
from filingflow.plans.linear import linear
from filingflow.plans.translate import translate
from filingflow.sources.sink import write_files
from filingflow.stages import Files, Stages, fingerprint

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests

UNIT = "doc_id long, ordinal int, unit_id string, text string, source_text string, placeholders array<struct<name:string,html:string>>, cached boolean"


def units_of(spark, texts, docs=(1,), cached=()):
    return spark.createDataFrame([(d, k + 1, f"u_{k + 1:04d}", t, t, [], k in cached) for d in docs for k, t in enumerate(texts)], UNIT)


class Noted(KeyedProvider):
    """Notes each call as a file: its model, rung and ids."""

    def __init__(self, folder, model="one", **more):
        super().__init__(model, **more)
        self.folder = folder

    def translate(self, request):
        ids = [u["id"] for u in request["units"]]
        with open(os.path.join(self.folder, f"{time.time_ns()}-{os.getpid()}-{ids[0]}"), "w") as f:
            json.dump([self.model, request["rung"], ids, request["prompt"], request["system"]], f)
        return super().translate(request)


def noted(folder):
    return [json.loads((folder / name).read_text()) for name in sorted(os.listdir(folder))]


# --- durable runs -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("in_blocks", [True, False])
def test_a_stopped_run_asks_nothing_twice(spark, tmp_path, in_blocks):
    pages = spark.createDataFrame([(k, "".join(f"<p>passage {k} of {n}</p>" for n in range(6))) for k in range(3)], "doc_id long, html string")
    calls = tmp_path / "calls"
    calls.mkdir()
    config = Config(batch=Batch(initial_units=2, max_units=2), block=Block(enabled=in_blocks, target_batch_units=2, max_workers=1), model=Model("one", max_retries=1), fallback_model=Model("two", max_retries=1))
    bad = lambda t: "" if "of 3" in t else t.upper()
    one = lambda: Noted(str(calls), make=bad)

    class Dying(KeyedProvider):
        def translate(self, request):
            os._exit(1)

    with pytest.raises(Exception):  # noqa: B017 - the worker is gone
        translate(pages, one, lambda: Dying("two"), config=config, journal=f"file://{tmp_path}/log")[1].count()
    before = noted(calls)
    run = translate(pages, one, lambda: Noted(str(calls), "two", make=str.title), config=config, journal=f"file://{tmp_path}/log")
    assert run.results.where("provider = 'two'").count() == 3 and run.results.count() == 18
    after = noted(calls)
    if in_blocks:  # all the primary model's stages were finished
        assert run.stages.resumed > 0 and [x for x in after if x[0] == "one"] == before and len(after) == len(before) + 3
    else:  # a round is a stage here: the first one was not finished, as it holds the fallback's calls
        assert len({str(x[2:4]) for x in after}) <= len(after)
    done = noted(calls)
    again = translate(pages, one, lambda: Dying("two"), config=config, journal=f"file://{tmp_path}/log")
    assert sorted(map(tuple, again.results.collect())) == sorted(map(tuple, run.results.collect())) and noted(calls) == done
    other = translate(pages.where("doc_id = 0"), one, None, config=config, journal=f"file://{tmp_path}/log")  # other pages: other stages
    assert other.results.count() == 6 and len(noted(calls)) > len(done)


def test_linear_rounds_are_stages(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows, config = units_of(spark, [f"word {k}" for k in range(8)]), Config(batch=Batch(initial_units=1, max_units=1))
    log = f"file://{tmp_path}/log"

    class Stops(Noted):
        def translate(self, request):
            if request["units"][0]["id"] == "u_0006":
                os._exit(1)
            return super().translate(request)

    with pytest.raises(Exception):  # noqa: B017
        linear(rows, lambda: Stops(str(calls)), config=config, stages=Stages(spark, log), calls_per_round=2)
    assert [x[2] for x in noted(calls)] == [[f"u_{k:04d}"] for k in (1, 2, 3, 4, 5)]
    results, _ = linear(rows, lambda: Noted(str(calls)), config=config, stages=Stages(spark, log), calls_per_round=2)
    assert results.count() == 8 and [x[2] for x in noted(calls)][5:] == [[f"u_{k:04d}"] for k in (5, 6, 7, 8)]  # the lost round's calls alone


def test_unfinished_stages_are_replaced(spark, tmp_path):
    log = f"file://{tmp_path}/s"
    first = Stages(spark, log)
    assert first.keep(spark.range(3), "g").count() == 3 and first.keep(spark.range(4), "g").count() == 4
    os.remove(tmp_path / "s/g/000001/_COMMITTED")
    second = Stages(spark, log)
    assert second.keep(spark.range(9), "g").count() == 3 and second.keep(spark.range(5), "g").count() == 5 and second.resumed == 1
    assert sorted(r.id for r in second.all("g", spark.range(1).schema).collect()) == [0, 0, 1, 1, 2, 2, 3, 4]
    assert second.all("none", spark.range(1).schema).count() == 0
    waves = Stages(spark, f"file://{tmp_path}/w")
    assert waves.in_waves(spark.range(100), "g", ["id"], 30, lambda r: r).count() == 100 and len(os.listdir(tmp_path / "w/g")) == 4
    assert fingerprint(spark.range(5), 1) == fingerprint(spark.range(5).repartition(3), 1) != fingerprint(spark.range(6), 1)


# --- calls ------------------------------------------------------------------------------------------------------------


def test_calls_of_a_partition_run_side_by_side_in_order(spark, tmp_path):
    class Slow:
        model = "slow"
        running = None

        def translate(self, request):
            path = os.path.join(str(tmp_path), f"{request['n']}")
            open(path + ".on", "w").close()
            seen = len([x for x in os.listdir(tmp_path) if x.endswith(".on")])
            time.sleep(0.05 if request["n"] % 7 else 0.3)
            os.remove(path + ".on")
            return f"{request['n']} {seen}"

    def told(workers, n=60):
        return [(r.n, *map(int, r.response.split())) for r in call(spark.range(n).selectExpr("id AS n").coalesce(1), lambda: Slow(), workers=workers).collect()]

    rows = told(3)
    assert [r[0] for r in rows] == [r[1] for r in rows] == list(range(60))
    assert 1 < max(r[2] for r in rows) <= 3 and max(r[2] for r in told(1, 5)) == 1


def test_tokens_of_failed_calls_are_not_counted(spark):
    class Told:
        model = "told"

        def translate(self, request):
            if request["n"] % 2:
                raise RuntimeError("down")
            return "x"

        def prime(self, prompt):
            if prompt == "bad":
                raise RuntimeError("no")

        def usage(self):
            return {"prompt_tokens": 7, "completion_tokens": 3, "total_tokens": 10}

    rows = call(spark.range(10).selectExpr("id AS n"), lambda: Told())
    total = usage_totals(rows).first()
    assert (total.requests, total.total_tokens) == (5, 50)
    primed = prime(spark.createDataFrame([("good",), ("bad",), ("good",)], "block_prompt string"), lambda: Told()).collect()
    assert sorted((r.block_prompt, r.error, r.total_tokens) for r in primed) == [("bad", "cache_warmup_failed: no", None), ("good", None, 10)]


def test_requests_name_the_language_and_carry_the_system_message(spark, tmp_path):
    for in_blocks in (True, False):
        folder = tmp_path / str(in_blocks)
        folder.mkdir()
        config = Config(target_language="fr-FR", block=Block(enabled=in_blocks, max_workers=1), model=Model("one", max_retries=1))
        (blocks if in_blocks else linear)(units_of(spark, ["one word"]), lambda folder=folder: Noted(str(folder)), config=config)
        (said,) = noted(folder)
        assert "Target language: fr-FR" in said[3] and "filings" in said[4] and "fr-FR" in said[4]


def test_prompts_are_as_long_as_planned(spark):
    """A block's body is Python's JSON of its batches, and the plan counts the same characters."""
    texts = ['say "hi"', "tab\tline\nend", "日本 é", "back\\slash /", "", "plain"]
    batched = P.greedy_batches(units_of(spark, texts, docs=(1, 2)).drop("cached"), 2, 99)
    rows = L.framed_batches(L.batches_of(batched)).join(P.batch_sizes(batched).withColumnRenamed("batch_no", "no"), ["doc_id", "no"]).collect()
    assert len(rows) == 6
    for r in rows:
        items = [{"id": f"u_{k + 1:04d}", "text": texts[k]} for k in (2 * r.no - 2, 2 * r.no - 1)]
        assert r.framed == json.dumps({"batch_id": f"batch_{r.no:03d}", "items": items}, ensure_ascii=False) and len(r.framed) + 2 == r.size


# --- states -----------------------------------------------------------------------------------------------------------


def test_linear_calls_are_the_same_for_any_round(spark, tmp_path):
    texts = [f"text {k}" if k % 5 else f"bad {k}" for k in range(40)]
    rows = units_of(spark, texts, cached=range(12, 30))
    config = Config(batch=Batch(initial_units=4, max_units=6, grow_after_successes=2, previous_context_chars=40, next_context_chars=30))
    seen = []
    for per_round in (1, 2, 50):
        folder = tmp_path / str(per_round)
        folder.mkdir()
        results, attempts = linear(rows, lambda folder=folder: Noted(str(folder), make=lambda t: "" if t.startswith("bad") else t.upper()), config=config, calls_per_round=per_round)
        seen.append(([x[2:4] for x in noted(folder)], sorted(map(tuple, results.collect())), attempts.count()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][1]) == 22
    sizes = [len(x[0]) for x in seen[0][0]]
    assert sizes[0] == 4 and 1 in sizes and max(sizes[sizes.index(1) :]) > 1  # shrinks and grows again


def test_linear_batch_falls_apart_after_a_failed_check(spark, tmp_path):
    make = {("primary", "u_0001"): "2025"}

    class Wrong(Noted):
        def translate(self, request):
            self.answers = make if len(request["units"]) > 1 else {}
            return super().translate(request)

    results, attempts = linear(units_of(spark, ["Revenue 2024", "Total assets 393,840"]), lambda: Wrong(str(tmp_path)))
    assert [x[2] for x in noted(tmp_path)] == [["u_0001", "u_0002"], ["u_0001"], ["u_0002"]]
    assert [r.reason for r in attempts.where("reason is not null").collect()] == ["number_validation_failed"] and results.count() == 2


def windowed(folder, most):
    class Windowed(Noted):
        def translate(self, request):
            if request["prompt"].count('"batch_id"') > most:
                with open(os.path.join(self.folder, f"{time.time_ns()}-limit"), "w") as f:
                    json.dump(["limit", request["rung"], [u["id"] for u in request["units"]], request["prompt"], ""], f)
                raise RuntimeError("context length exceeded")
            return super().translate(request)

    return lambda: Windowed(str(folder))


def test_blocks_shrink_and_grow_again(spark, tmp_path):
    config = Config(batch=Batch(max_units=1, grow_after_successes=2), block=Block(enabled=True, target_batch_units=1, max_batches_per_block=4, max_workers=1), model=Model("one", max_retries=1))
    results, _ = blocks(units_of(spark, [f"word {k}" for k in range(9)]), windowed(tmp_path, 2), config=config, blocks_per_round=1)
    said = noted(tmp_path)
    assert sorted(x[2][0] for x in said if x[0] != "limit") == [f"u_{k:04d}" for k in range(1, 10)] and results.where("provider = 'one'").count() == 9
    sizes = []
    for x in said:
        n = x[3].count('"batch_id"')
        if x[0] == "limit" or not sizes or sizes[-1][1] != x[3].split("# Task")[0]:
            sizes.append((n, x[3].split("# Task")[0]))
    # four do not fit (each batch asks once), two do twice, so three are tried, which do not fit; ones go well, then two, and one is left
    kinds = [n for n, _ in dict.fromkeys((n, p) for n, p in sizes)]
    assert kinds == [4, 2, 2, 3, 1, 1, 2, 1] and results.count() == 9


def test_a_block_of_one_batch_that_does_not_fit_goes_on_alone(spark, tmp_path):
    config = Config(batch=Batch(max_units=1), block=Block(enabled=True, target_batch_units=1, max_batches_per_block=3, max_workers=1), model=Model("one", max_retries=1))
    results, attempts = blocks(units_of(spark, ["Revenue one", "Revenue two", "Revenue three"]), windowed(tmp_path, 0), config=config)
    assert {r.result for r in results.collect()} == {"REVENUE ONE", "REVENUE TWO", "REVENUE THREE"}
    said = noted(tmp_path)
    assert all('"batch_id"' in x[3] for x in said if x[0] == "limit") and not any('"batch_id"' in x[3] for x in said if x[0] == "one")
    assert attempts.where("reason like '%context length%'").count() == len([x for x in said if x[0] == "limit"])


def test_states_of_blocks(spark):
    config = Config(batch=Batch(grow_after_successes=3), block=Block(max_batches_per_block=8))
    state = spark.createDataFrame([(1, 4, 2), (2, 4, 2), (3, 1, 0), (4, 8, 2), (5, 3, 0)], "doc_id long, most int, good int")
    done = spark.createDataFrame([(1, 1, False), (2, 1, False), (2, 2, True), (3, 1, True), (4, 1, False), (5, 1, False)], "doc_id long, block_no int, limited boolean")
    assert {tuple(r) for r in next_state(state, done, config).collect()} == {(1, 5, 0), (2, 2, 0), (3, 1, 0), (4, 8, 0), (5, 3, 1)}


# --- the check of numbers ---------------------------------------------------------------------------------------------


def test_numbers_are_compared_in_one_pass(spark):
    many = " ".join(str(k % 977) for k in range(40_000))
    cases = [("1 1 2", "2 1 1 9", True), ("1 1", "1", False), ("", "5", True), ("7", "", False), ("1,000", "1000", True), ("1.0", "1", False), (many, many + " 5", True), (many + " 976 1", many + " 1", False)]
    began = time.time()
    rows = spark.createDataFrame(cases, "a string, b string, want boolean").select(T.numbers_preserved(F.col("a"), F.col("b")).alias("got"), "want", "a", "b").collect()
    assert all(r.got is r.want for r in rows) and time.time() - began < 30
    for r in rows[:6]:
        assert (first_failure([{"unit_id": "u", "text": r.a, "names": []}], [{"id": "u", "text": r.b or "x"}]) is None) is r.want


# --- sink and addresses -----------------------------------------------------------------------------------------------


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    rows = spark.range(200).selectExpr("concat('d', id % 7, '/f', id) AS name", "CAST(id AS string) AS content")
    broken = rows.withColumn("name", F.when(F.col("name") == "d3/f150", F.raise_error(F.lit("midway"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="midway"):
        write_files(broken, f"file://{tmp_path}/o")
    assert not [f for _, _, names in os.walk(tmp_path / "o") for f in names]
    assert write_files(rows, f"file://{tmp_path}/o") == 200
    assert {f for _, _, names in os.walk(tmp_path / "o") for f in names} == {f"f{k}" for k in range(200)} and (tmp_path / "o/d3/f150").read_text() == "150"
    for name, said in (("x/../../y", "unsafe"), ("/abs", "unsafe"), (None, "unsafe"), ("d3/f150", "exists")):
        with pytest.raises(FilingError, match=said):
            write_files(spark.createDataFrame([(name, b"1"), ("new", b"2")], "name string, content binary"), f"file://{tmp_path}/o")
    with pytest.raises(FilingError, match="doubled"):
        write_files(spark.createDataFrame([("twice", b"1")] * 2, "name string, content binary").repartition(2), f"file://{tmp_path}/o")
    assert not (tmp_path / "o/new").exists() and write_files(spark.createDataFrame([("none", None)], "name string, content binary"), str(tmp_path / "o")) == 1
    assert (tmp_path / "o/none").read_bytes() == b"" and not [n for n in os.listdir(tmp_path / "o") if n.startswith(".staging")]
    assert write_files(rows.limit(0), f"file://{tmp_path}/e") == 0


def test_addresses(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "in").mkdir()
    os.symlink(tmp_path / "in", tmp_path / "link")
    assert Files(spark, f"file://{tmp_path}/in").exists() and not Files(spark, f"file://{tmp_path}/no").exists()
    assert Files(spark, f"file://{tmp_path}/link").real == Files(spark, str(tmp_path / "in")).real == str(tmp_path / "in")
    assert Files(spark, f"file://{tmp_path}/in").uri == f"file://{tmp_path}/in"


def test_translate_names_files_after_their_place_below_the_source(spark, tmp_path, capsys):
    """The source's own name occurs again in the names below it, and a page stands for itself when it is the source."""
    source = tmp_path / "in"
    (source / "in").mkdir(parents=True)
    (source / "main.htm").write_text(PAGE)
    (source / "in" / "main in.htm").write_text(PAGE)
    config = tmp_path / "c.toml"
    config.write_text('[model]\nmodel = "one"\nbase_url = "http://x"\napi_key = "k"\n')
    more = ["--provider", "filingflow.operators.provider:dry_run", "--config", str(config)]
    base = os.path.relpath(source, os.getcwd())
    assert main(["translate", base, f"file://{tmp_path}/out", *more, "--cache", f"file:{tmp_path}/log"]) == 0
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, names in os.walk(tmp_path / "out") for f in names if not f.endswith(".crc")}
    assert {"main_translated.htm", "in/main in_translated.htm"} <= found and len(found) == 6
    assert not os.listdir(tmp_path / "log/_journal")  # the log of answers has its rows now
    # the same log by another address: everything is known, whatever the scheme
    assert main(["translate", str(source), f"file://{tmp_path}/out", *more, "--cache", f"file://{tmp_path}/log", "--overwrite"]) == 0
    report = json.loads((tmp_path / "out/main_translated_translation_report.json").read_text())
    assert report["summary"]["cache_hits"] == report["summary"]["total_units"] > 0
    assert main(["translate", f"{source}/main.htm", f"file://{tmp_path}/one", *more]) == 0 and (tmp_path / "one/main_translated.htm").exists()
    os.symlink(source, tmp_path / "link")
    for other in (f"{source}/", f"file://{source}", base, str(tmp_path / "link")):
        assert main(["translate", str(source), other, *more]) == 2 and "must not be the source" in capsys.readouterr().err
    config.write_text(config.read_text() + "[cache]\nenabled = false\n")
    assert main(["translate", str(source), f"file://{tmp_path}/off", *more, "--cache", f"file://{tmp_path}/log2"]) == 0 and not (tmp_path / "log2").exists()
