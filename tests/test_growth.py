"""What keeps the work of large tables in proportion to them."""

from __future__ import annotations

import hashlib
import os
import time

import pyarrow as pa
from pyspark.sql import functions as F

from filingflow.config import Batch, Block, Config, Model
from filingflow.functions import text as T
from filingflow.operators import html_units as H
from filingflow.operators import ladder as L
from filingflow.operators import planning as P
from filingflow.operators import responses as V
from filingflow.operators.provider import KeyedProvider, call, pooled
from filingflow.plans.blocks import blocks
from filingflow.plans.linear import linear
from filingflow.stages import Stages


def test_answers_leave_in_batches():
    """A batch of one row costs more than its answer; a slow row still holds back no more than the rows ahead of it."""
    rows = pa.RecordBatch.from_pylist([{"n": n} for n in range(100)])
    for workers in (1, 3):
        parts = [(p.num_rows, found) for p, found in pooled([rows], lambda r: r["n"], workers)]
        assert [n for _, found in parts for n in found] == list(range(100)) and len(parts) <= 10


def test_an_answer_is_stripped_and_checked_once(spark):
    """The costly patterns stand in the plan once, and run on texts alone that can match them."""
    units = "array<struct<id:string,text:string,source_text:string,names:array<string>>>"
    rows = spark.createDataFrame([([("a", "1 b", "s", [])], '[{"id": "a", "text": "1 B"}]', None)], f"units {units}, response string, error string")
    plan = V.validate_batches(V.parse_responses(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cannot comply") <= 4 and plan.count("RLIKE") <= 3  # a pattern and a word for the response and for its texts


def test_shortened_checks_say_what_the_patterns_say(spark):
    spaces = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    assert sorted(spaces) == sorted(T.SPACE_CHARS)
    texts = [*("x".join([s, " a b ", s]) for s in "ab"), *(f"{s}a{s}b{s}" for s in spaces), "​a", "", " ", "I CANNOT", "i cannotx", "Policy.", "my policyholder", "抱歉无法", "不能翻译", "拒绝", "无法", "a", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    strip = F.regexp_replace("t", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    refused = F.lower("t").rlike("(?U)" + "|".join(f"(?:{p})" for p in T.REFUSALS))
    same = rows.select(T.stripped(F.col("t")).eqNullSafe(strip).alias("a"), T.looks_like_refusal(F.col("t")).eqNullSafe(refused).alias("b"), "t").collect()
    assert all(r.a and r.b for r in same), [r.t for r in same if not (r.a and r.b)]
    pairs = [("a", None), (None, "a"), (None, None), ("1", None), ("٣", "3"), ("٣", "٣"), ("a", "1"), ("1", "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select(T.numbers_preserved(F.col("a"), F.col("b")).alias("ok")).collect()
    assert [r.ok for r in got] == [None, None, None, None, False, True, True, False]
    names = [("<PH_0>a</PH_0>", ["PH_0"]), ("a", []), ("a", ["PH_0"]), ("<PH_0>", []), (None, []), ("a", None)]
    got = spark.createDataFrame(names, "t string, n array<string>").select(T.placeholders_match(F.col("t"), F.col("n")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, False, True, None, None]


def test_units_leave_a_large_batch_in_slices():
    """Neither the units nor the rebuilt pages of a whole Arrow batch are Python objects at a time."""
    pages = pa.RecordBatch.from_pydict({"k": pa.array([None, *range(1, 500)], pa.int64()), "p": ["<p>Revenue grew</p><p>Costs <b>fell</b> too</p>"] * 500})
    parts = list(H._units(iter([pages])))
    assert len(parts) == 10 and sum(p.num_rows for p in parts) == 1000 and parts[0].column(0).to_pylist()[:4] == [None, None, 1, 1]
    kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("text", pa.string()), ("is_fallback", pa.bool_())]))
    answers = pa.array([[{"ordinal": 1, "text": "Up", "is_fallback": False}] if k % 2 else None for k in range(500)], kind)
    out = list(H._splice.func(iter([(pages.column(1), answers)])))
    rows = [x for p in out for x in p.to_pylist()]
    assert len(out) == 10 and rows[:2] == [pages.column(1)[0].as_py(), "<p>Up</p><p>Costs <b>fell</b> too</p>"] and len(rows) == 500


def test_a_long_document_takes_few_rounds(spark, tmp_path):
    """Rounds follow the logarithm of a document's calls, and answers are those of any rounds."""
    none = F.array().cast("array<struct<name:string,html:string>>")
    rows = spark.range(200).select(F.expr("id div 100").alias("doc_id"), (F.col("id") % 100 + 1).cast("int").alias("ordinal"), F.concat(F.lit("u_"), F.col("id")).alias("unit_id"), F.concat(F.lit("t "), F.col("id")).alias("text"))
    rows = rows.withColumn("source_text", F.col("text")).withColumn("placeholders", none).where("doc_id = 0 OR ordinal < 9")
    config = Config(batch=Batch(initial_units=1, max_units=1))
    results, attempts = linear(rows, lambda: KeyedProvider("k"), config=config, stages=Stages(spark, f"file://{tmp_path}/s"), calls_per_round=2)
    assert results.count() == attempts.count() == 108 and results.where("result = upper(source_text)").count() == 108
    assert len(os.listdir(tmp_path / "s/linear")) <= 12  # 50 rounds of two calls


def test_a_prompt_does_not_come_back_with_its_answer(spark):
    rows = spark.createDataFrame([(1, "primary", "long", [("a", "x")])], "n int, rung string, prompt string, units array<struct<id:string,text:string>>")
    back = call(rows, lambda: KeyedProvider("k"), left=("prompt",))
    assert "prompt" not in back.columns and back.first().response == '[{"id": "a", "text": "X"}]'


UNIT = "doc_id long, ordinal int, unit_id string, text string, source_text string, placeholders array<struct<name:string,html:string>>"


def parquet_bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_a_ladder_writes_each_text_few_times(spark, tmp_path):
    """Accepted batches hold their answers alone, and a source that is the text is not kept beside it."""
    long = lambda k: "x" + "".join(hashlib.sha256(b"%d %d" % (k, n)).hexdigest() for n in range(8))
    rows = [(k // 20, k % 20 + 1, f"u_{k % 20 + 1:04d}", t, t, []) for k, t in enumerate(map(long, range(400)))]
    odd = [(99, 1, "u_0001", "down", "its source", []), (99, 2, "u_0002", "down", None, []), (99, 3, "u_0003", "fine", "other", [])]
    size = sum(len(r[3]) for r in rows)
    calls = L.Calls(Stages(spark, f"file://{tmp_path}/s"))
    make = lambda t: "!error" if t == "down" else t.upper()
    results, attempts = L.run_ladder(P.greedy_batches(spark.createDataFrame(rows + odd, UNIT), 4, 9999), lambda: KeyedProvider("one", make=make), calls=calls)
    got = {(r.doc_id, r.ordinal): (r.unit_id, r.source_text, r.result, r.provider) for r in results.collect()}
    assert len(got) == results.count() == 403 and all(got[r[:2]] == (r[2], r[3], r[3].upper(), "one") for r in rows)
    assert [got[(99, k)][1:] for k in (1, 2, 3)] == [("its source", "its source", "source"), (None, None, "source"), ("other", "FINE", "one")]
    assert parquet_bytes(tmp_path / "s") < 2 * size  # eight times before
    assert attempts.where("reason is null and (units is not null or response is not null)").count() == 0


def test_a_written_stage_leaves_no_shuffle_files(spark, tmp_path):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    found = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = found()
    Stages(spark, f"file://{tmp_path}/s").keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "g")
    deadline = time.time() + 20
    while found() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not found() - before


def test_text_around_a_block_follows_from_numbers(spark):
    """The same lines as the joins of whole texts find."""
    rows = [(d, k + 1, f"u_{k + 1:04d}", t, t, []) for d in (1, 2) for k, t in enumerate(["é" * (7 * k * d % 23) for k in range(12 * d)])]
    batched = P.greedy_batches(spark.createDataFrame(rows, UNIT), 2, 30)
    numbers = {(r.doc_id, r.ordinal): r.batch_no for r in batched.collect()}
    for before, after in ((24, 5), (0, 60), (90, 1)):
        want = {(r.doc_id, r.batch_no): (r.context_before, r.context_after) for r in P.with_contexts(batched, before, after).collect()}
        for d in (1, 2):
            own = {}
            for r in rows:
                if r[0] == d:
                    own.setdefault(numbers[r[:2]], []).append(f"{r[2]}: {r[4]}\n")
            text, nos = "".join(x for n in sorted(own) for x in own[n]), sorted(own)
            found = P.blocks_from(nos, [9] * len(nos), [[len(x) for x in own[n]] for n in nos], 1, 99, before, after, 99)
            assert [b["units"] for b in found] == [[len(own[n])] for n in nos]
            for n, b in zip(nos, (x["block"] for x in found), strict=True):
                assert b["nos"] == [n] and text[b["first"] : b["last"]] == "".join(own[n])
                assert (text[b["low"] : b["first"]].removesuffix("\n"), text[b["last"] : b["high"]].removesuffix("\n")) == want[(d, n)]


def test_blocks_write_no_prompts(spark, tmp_path):
    """The prompts of a document hold it many times; what is written holds it a few times, also where blocks do not fit."""

    class Narrow(KeyedProvider):
        def translate(self, request):
            if request["prompt"].count('"batch_id"') > 1:
                raise RuntimeError("context length exceeded")
            return super().translate(request)

    long = lambda k: "x" + "".join(hashlib.sha256(b"%d %d" % (k, n)).hexdigest() for n in range(512))
    rows = [(1, k + 1, f"u_{k + 1:04d}", t, t, []) for k, t in enumerate(map(long, range(16)))]
    config = Config(batch=Batch(max_units=1), block=Block(enabled=True, target_batch_units=1, max_batches_per_block=2, max_workers=2, warmup_delay_seconds=0.0), model=Model("one", max_retries=1))
    results, attempts = blocks(spark.createDataFrame(rows, UNIT), lambda: Narrow("one"), config=config, stages=Stages(spark, f"file://{tmp_path}/s"))
    assert {(r.unit_id, r.result) for r in results.collect()} == {(r[2], r[3].upper()) for r in rows} and attempts.where("rung = 'prime'").count() == 24
    limited = attempts.where("reason like '%context length%'")
    assert limited.count() == 16 and limited.where("units is not null").count() == 0  # they are planned again from the document
    assert parquet_bytes(tmp_path / "s") < 2 * sum(len(r[3]) for r in rows)
