"""One row that stands many thousand times in the table, and what must not grow with it."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest

from filingflow.llm import langid, lm, sharding

SF = "/root/testdata/sf0.01"


def test_language_sample_is_bounded(spark, monkeypatch):
    met = []
    train = langid.train
    monkeypatch.setattr(langid, "train", lambda bags: met.append(bags.num_rows) or train(bags))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    hot = spark.range(200_000).selectExpr("CAST(4 AS long) AS doc_id", "'one and the same row of words' AS text", "'en' AS lang")
    for table in (docs.unionByName(hot), hot):
        model = langid.fit(table)
        assert "en" in model.languages and 0 < met[-1] <= 1.3 * langid.TRAIN_DOCUMENTS
    dirty = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 900) AS lang")
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 5)
    assert len(langid.fit(dirty).languages) == 5


def test_slots_of_copies(spark, monkeypatch):
    rows = spark.range(120_000).selectExpr("CAST(7 AS long) AS doc_id", "'same' AS text").unionByName(spark.range(500).selectExpr("id AS doc_id", "concat('t', id % 9) AS text")).repartition(6)
    monkeypatch.setattr(sharding, "PIECE", 7000)
    got = sharding.shard_layout(rows).collect()
    assert len(got) == 120_500
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got)[(7, 12, zlib.crc32(b"same"))] == 120_000
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_layout(rows.limit(0)).count() == 0


def test_more_parts_of_trigrams_do_not_weaken_the_model(spark, monkeypatch):
    """The number of shards follows the distinct trigrams, whatever the number of tokens behind them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    runs = []
    for tokens in (2_000_000, 20_000, 2_000):  # 1, about 16 and about 157 parts
        monkeypatch.setattr(lm, "PART_TOKENS", tokens)
        runs.append(sorted(map(tuple, lm.score_texts(docs).collect())))
    assert runs[0] == runs[1] == runs[2]
    held = [r for r in runs[0] if r[1]]
    n = sum(r[2] for r in held)
    assert sum(r[6] for r in held) / n == pytest.approx(-3.861, rel=0.02) and sum(r[5] for r in held) / n < -4.1


def test_shards_gather_whole_parts(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_CODES", 100)
    codes = [(k, lm.np.arange(k * 50, k * 50 + 50, dtype=lm.np.uint32).tobytes(), lm.np.full(50, k + 1, lm.np.int64).tobytes()) for k in range(20)]
    shards, n = lm.sharded(spark.createDataFrame(codes, "part int, codes binary, counts binary"))
    rows = shards.collect()
    assert n == 10 and len(rows) == 10
    found = {}
    for r in rows:
        code = lm.np.frombuffer(r.codes, lm.np.uint32)
        assert (lm.np.diff(code.astype(int)) > 0).all() and 40 < len(code) < 180
        found |= dict(zip(code.tolist(), lm.np.frombuffer(r.counts, lm.np.int64).tolist(), strict=True))
    assert found == {c: c // 50 + 1 for c in range(1000)}
    assert lm.sharded(spark.createDataFrame([], "part int, codes binary, counts binary"))[1] == 1


def test_a_text_s_score_is_that_of_the_model(spark, monkeypatch):
    """The score of a few texts from the returned model, by the definition: a softmax over all classes, then the word in its class."""
    made = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda counts, n, vocabulary: made.append((fit(counts, n, vocabulary), vocabulary)) or made[-1][0])
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) between 40 and 400").limit(300)
    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    model, vocabulary = made[0]
    texts = {r.doc_id: r.text for r in docs.collect()}
    np = lm.np
    count = Counter(w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in t.encode().translate(lm.LOWER.tobytes()).split())
    for doc_id in sorted(texts)[:12]:
        raw = texts[doc_id].encode()
        h, s, first = lm.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        classes, begin = vocabulary.classes(h, s, first)
        one, two = lm.contexts(classes, begin)
        total = 0.0
        for t, a, b in zip(classes, one, two, strict=True):
            z = ((model.q[b] * model.c[0] + model.q[a] * model.c[1]) @ model.r.T + model.b).astype(float)
            z[lm.BEGIN] = -np.inf
            total += (z[t] - z.max() - np.log(np.exp(z - z.max()).sum())) / np.log(10)
        for w, c, k in zip(raw.translate(lm.LOWER.tobytes()).split(), classes, s, strict=False):
            if c >= lm.TOP:
                total += np.log10(count[w] + 0.5) - np.log10(vocabulary.suffix_n[k] + 0.5 * (vocabulary.suffix_v[k] + 1))
        assert got[doc_id].score == pytest.approx(total, rel=1e-4)
