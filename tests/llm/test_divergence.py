"""The audit of sources against its definition, on rows with ties, nulls, many groups and several slices."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, odd_rows

from filingflow.llm import divergence


def brute(rows, least=10, top=10):
    """The definition, with Python's integers: rows are (text, lang, source)."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in rows]
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, own in terms:
        groups[lang, source].update(own)
        docs[lang].update(set(own))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter()
        for (x, _), n in groups.items():
            if x == lang:
                whole.update(n)

        def shares(n, kept=kept):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(n) for (x, s), n in groups.items() if x == lang}
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            best = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(best, 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Ärger", "ärger", "日本語", "\U0001f600x", "ZZ", "zz"]
    out = []
    for k in range(900):
        lang, source = rnd.choice(["en", "en", "de", None, ""]), rnd.choice([None, "", "é", "\U0001f600", "z", *(f"s{i}" for i in range(25))])
        mine = rnd.sample(words, 60) if k % 3 else words[: 20 + len(source or "") + (source or "").count("1")]
        out.append((rnd.choice([" ", "-", "\n", "7"]).join(rnd.choice(mine) for _ in range(rnd.randint(0, 60))), lang, source))
    out += [(None, "en", "empty"), ("", "en", "void"), ("12 34", "xx", "a"), ("few", "xx", "b"), (None, "xx", "c"), ("alone", "yy", "a")]
    out += [("same words here", "en", "copies")] * 400 + [("a" * 70_000 + " end", "en", "long")] * 11
    return out


def collected(frame):
    return Counter((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in frame.collect())


@pytest.mark.parametrize("block_groups", [2, 8, 100])
def test_follows_the_definition(spark, rows, block_groups):
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    want = brute(rows)
    assert collected(divergence.audit(frame, block_groups=block_groups)) == want
    assert {"pair", "term"} == {k[2] for k in want} and any(k[0] == "xx" and k[4] == 0 for k in want)


def test_several_slices(spark, rows, monkeypatch):
    """The number of slices is decided on the driver, so a smaller one holds for the whole run."""
    monkeypatch.setattr(divergence, "SLICE_TERMS", 40)
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert collected(divergence.audit(frame, least=3, top=4, block_groups=3)) == brute(rows, 3, 4)


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 7, 16, 31])
def test_each_pair_of_blocks_meets_once(spark, blocks):
    even = blocks + blocks % 2
    turns = spark.range(blocks).select(F.col("id").cast("int").alias("b")).crossJoin(spark.range(even - 1).select(F.col("id").cast("int").alias("t")))
    met = turns.withColumn("o", divergence.partner(F.col("b"), F.lit(blocks), F.col("t"))).where(f"o < {blocks}").collect()
    assert Counter((r.b, r.o) for r in met) == Counter((i, j) for i in range(blocks) for j in range(blocks) if i != j)
    for t in range(even - 1):
        own = {r.b: r.o for r in met if r.t == t}
        assert all(own[o] == b for b, o in own.items())


def test_shares_are_exact_for_large_counts():
    n, total, vocabulary = np.array([0, 1, 10**13, 7 * 10**12 + 11]), 2 * 10**13, 12_345
    assert divergence.share(n, total, vocabulary).tolist() == [1 + 10**9 * (k + 2) // (total + 2 * vocabulary) for k in n.tolist()]


def test_vectors_survive_packing():
    idx, n = np.array([3, 0, 900, 17]), np.array([5, 1, 2**40, 9])
    key = [divergence.pa.scalar(x) for x in ("en", "s", 2)]
    data = divergence._packed(key, divergence.pa.table({"idx": idx, "n": n}))["data"][0].as_py()
    assert [x.tolist() for x in divergence._unpacked(data)] == [[0, 3, 17, 900], [1, 5, 9, 2**40]]
    assert [len(x) for x in divergence._unpacked(None)] == [0, 0]


def test_odd_tables(spark):
    odd = spark.createDataFrame(odd_rows(), ODD).repartition(3).withColumn("term", F.lit(1)).withColumn("idx", F.lit("x"))
    want = brute([(r[1], r[2], r[3]) for r in odd_rows()], 2)
    assert collected(divergence.audit(odd, least=2)) == want
    assert divergence.audit(odd.limit(0)).count() == 0
    none = spark.createDataFrame([(None, None, None)] * 3, "text string, lang string, source string")
    assert divergence.audit(none).count() == 0
