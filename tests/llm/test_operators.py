"""The corpus operators against brute force on small fixtures, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import difference
from pyspark.sql import functions as F

from filingflow.llm import decontaminate, jaccard, langid, lines, lm, mixing, quality, sharding, suffix, warc
from filingflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, chunk int, rid string, n int, node double, part string, high string, copies string, _id long, _part int, _rid string, _key string"


def odd_rows():
    prose = "The quick brown fox jumps over the lazy dog near the old stone bridge while rain falls softly on green hills. " * 3
    texts = [None, "", " \n\t ", "a", "é" * 500, prose, prose, prose.replace("fox", "cat"), "word " * 400, "#$%\n\n#$%", "x" * 70_000, "日本語のテキスト " * 80, "Ünïcode straße\r\nline two\x0bthree"]
    rows = [(k, t, ("en", None, "de")[k % 3], "s", 1, 1, "r", 2, 0.5, "p", "h", "c", 1, 1, "r", "k") for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, prose, *[None] * 14), (None,) * 16]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 0, 0), (8, 0, 1), (None, 1, 1), (4, None, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    assert difference(spark, QUERIES[name], ORACLES[name], SF) == ""


def test_odd_tables(spark, odd, labels):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old stone"), (2, None), (None, "straße"), (3, "")], "item_id long, text string")
    runs = {
        "suffix": suffix.remove_repeats, "jaccard": jaccard.components, "quality": quality.judge, "mixing": lambda d: mixing.mix(d, labels), "langid": langid.identify,
        "lines": lines.dedupe_lines, "lm": lm.score_texts, "sharding": sharding.shard_layout, "decontaminate": lambda d: decontaminate.mark(d, bench),
    }
    n = odd.count()
    for name, run in runs.items():
        assert run(odd).count() == n, name
        assert run(odd.limit(0)).count() == 0, name
    for keep in (quality.quality_filter, jaccard.keep_one, lambda d: decontaminate.clean(d, bench), lambda d: mixing.mixed_documents(d, labels)):
        out = keep(odd)
        assert out.columns == odd.columns
        out.count()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_counts(spark, odd):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(odd).collect())
    want = Counter()
    for doc_id, text, *_ in odd_rows():
        w = words(text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        want[(doc_id, len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))] += 1
    assert got == want


def brute_kneser_ney(texts):
    """For each 4-gram of symbols its probability by the definition, the same had it not been seen, and how many different
    texts have it, over the texts of one language. What one text is alone in having is counted as in one of its copies."""
    fold = lambda c: "\x00" if c is None else " " if c in " \t\n\r\x0b\x0c" else "0" if c in "0123456789" else c.lower() if "A" <= c <= "Z" else c
    grams, owners, copies = Counter(), defaultdict(set), Counter(t or "" for t in texts)
    for t in texts:
        s = [None] * 3 + list(t or "") + [None]
        for g in (tuple(map(fold, s[k - 3 : k + 1])) for k in range(3, len(s))):
            grams[g] += 1
            owners[g].add(t or "")
    for g, own in owners.items():
        if len(own) == 1:
            grams[g] //= copies[min(own)]
    orders = [grams]
    for _ in range(3):
        orders.insert(0, Counter(g[1:] for g in orders[0]))
    p = None
    for c in orders:
        n = [0, *(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = [1 - 2 * y * n[2] / n[1] if n[1] else y, 2 - 3 * y * n[3] / n[2] if n[2] else 2 * y, 3 - 4 * y * n[4] / n[3] if n[3] else 3 * y]
        d = [min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.95, 2.95), strict=True)]
        total, rest = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            rest[g[:-1]] += d[min(v, 3) - 1]
        lower = (lambda g, c=c: 1 / (len(c) + 1)) if p is None else (lambda g, p=p: p[g[1:]])
        low = {g: rest[g[:-1]] * lower(g) / total[g[:-1]] for g in c}
        p = {g: (v - d[min(v, 3) - 1]) / total[g[:-1]] + low[g] for g, v in c.items()}
    return p, low, {g: len(own) for g, own in owners.items()}


def test_perplexities_follow_the_definition(spark):
    texts = [("en", "abab abba, ABBA 12"), ("en", "baba, abab.\n"), ("en", None), (None, "ab"), ("zh", "\u65e5\u672c\u8a9e \u65e5\u672c \U0001f600"), ("zh", "\u672c\u65e5"), ("en", ""), ("en", "zq zq!"), ("en", "zq zq!"), ("en", "zq zq!")]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(texts)], "doc_id long, lang string, text string").repartition(3)
    got = {r.doc_id: r.log10_ppl for r in quality.judge(frame).collect()}
    fold = lambda t: "".join(" " if c in " \t\n" else "0" if c in "0123456789" else c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for lang in ("en", None, "zh"):
        p, low, holders = brute_kneser_ney([t for x, t in texts if x == lang])
        for k, (x, t) in enumerate(texts):
            if x == lang:
                s = ["\x00"] * 3 + list(fold(t)) + ["\x00"]
                lettered = sum(any(c.isdigit() or c.isalpha() or ord(c) > 127 for c in w) for w in words(t))
                own = Counter(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
                want = -sum(v * math.log10(low[g] if holders[g] == 1 else p[g]) for g, v in own.items()) / max(lettered, 1)
                assert got[k] == pytest.approx(want, rel=1e-5), (k, t)


def test_planted_junk_leaves_the_band_in_every_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rng, planted = np.random.default_rng(8), []
    for k, lang in enumerate(("en", "de", "fr", "es")):
        planted += [
            (-10 * k - 1, lang, " ".join("zxqj" + chr(97 + i % 26) * 3 + str(i * 7919) for i in range(120))),
            (-10 * k - 2, lang, " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(150))),
            (-10 * k - 3, lang, " ".join(f"{chr(97 + i % 26)}{chr(97 + i * 7 % 26)} ~~^^{i}=={i * 31}" for i in range(90))),
        ]
    rows = [r for r in quality.judge(docs.unionByName(spark.createDataFrame(planted, "doc_id long, lang string, text string"))).collect() if not r.base_failed]
    assert len([r for r in rows if r.doc_id < 0]) == 12 and not any(r.kept for r in rows if r.doc_id < 0)
    good, laden = [r for r in rows if labels.get(r.doc_id) == 1], [r for r in rows if r.doc_id >= 0 and 100 * r.n_symbols > 2 * r.word_chars]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and not any(r.kept for r in laden)


def test_copied_junk_and_word_salad_leave_the_band(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    rng, planted = np.random.default_rng(9), []
    salad = {"en": "the of and to in is that it for on".split(), "de": "der die und in den von zu das mit sich".split(), "fr": "le de un et la les des en du est".split(), "es": "de la que el en y los se del las".split()}
    for k, (lang, common) in enumerate(salad.items()):
        junk = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(150))
        planted += [(-1000 * k - 1 - i, lang, junk) for i in range((5, 50, 5, 50)[k])]
        planted.append((-1000 * k - 900, lang, " ".join(rng.choice(common, 400))))
    rows = {r.doc_id: r for r in quality.judge(docs.unionByName(spark.createDataFrame(planted, "doc_id long, lang string, text string"))).collect()}
    for doc_id, _, _ in planted:
        r = rows[doc_id]
        assert not r.kept, r
        if -doc_id % 1000 < 900:
            assert r.log10_ppl > r.high, r  # copies or not, what only they have is unseen


def test_rows_in_another_order_and_copies_of_whole_chunks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    once = {r.doc_id: r for r in quality.judge(docs).collect()}
    mixed = {r.doc_id: r for r in quality.judge(docs.repartition(5).orderBy(F.rand(3))).collect()}
    assert once.keys() == mixed.keys() and all(once[k].kept == mixed[k].kept and once[k].log10_ppl == pytest.approx(mixed[k].log10_ppl, rel=1e-6) for k in once)
    row = spark.createDataFrame([(1, "en", "one row that stands many times " * 8)], "doc_id long, lang string, text string")
    assert quality.judge(row.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("_n")).groupBy("log10_ppl").count().collect()[0]["count"] == 20_000


def test_symbol_laden_junk_leaves_the_band_and_prose_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    prose = next(r.text for r in docs.where("lang = 'en' and length(text) > 1200").sort("doc_id").collect() if not set("#*$%&|<>") & set(r.text)).split()[:150]
    junk = [" ".join(w + ("***", "%%%", "$$$")[k % 3] for k, w in enumerate(prose)), " | ".join(prose), " ".join(c for w in prose for c in (w, "###"))]
    planted = spark.createDataFrame([(-k - 1, "en", t) for k, t in enumerate(junk)], "doc_id long, lang string, text string")
    rows = [r for r in quality.judge(docs.unionByName(planted)).collect() if not r.base_failed]
    laden = [r for r in rows if 100 * r.n_symbols > 2 * r.word_chars]
    plain = [r for r in rows if not r.n_symbols]
    assert {-1, -2, -3} <= {r.doc_id for r in laden} and not any(r.kept for r in laden if r.doc_id < 0)
    assert len(laden) > 50 and sum(r.kept for r in laden) <= 0.05 * len(laden)
    assert sum(r.kept for r in plain) >= 0.99 * len(plain)


def shingle_set(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(vocabulary, 90)) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(14):
            w = b.split()
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = "z" + str(int(rng.integers(1000)))
            texts.append(" ".join(w))
    line = " ".join(rng.choice(vocabulary, 30))
    texts += [line + " " + " ".join(rng.choice(vocabulary, 25)) for _ in range(40)] + ["", None, "one two", "One two", "one"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = [shingle_set(t) for t in texts]
    top = list(range(len(sets)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(frame).collect()}
    assert got == {k: (len(s), find(k)) for k, s in enumerate(sets)}


def test_mixing_meets_its_targets(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = mixing.mix(docs, labels).toPandas()
    mass = np.array([(rows[f"p_{d}"] * rows.rate * rows.n_tokens).sum() for d in mixing.DOMAINS])
    share = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    assert (rows.rate >= 0).all() and np.abs(mass / mass.sum() - share).max() < 0.01
    known = rows.merge(labels.toPandas(), on="doc_id")
    assert known[(known.toxic == 1)].rate.mean() < 0.5 * known[(known.toxic == 0) & (known.quality == 1)].rate.mean()
    p = np.array([[0.9, 0.1, 0.0]])
    assert mixing.rates(p, [np.array([2.0, 0, 0]), np.array([-1.0, 0, 0])])[0] == pytest.approx(0.9)


def test_a_domain_that_a_filter_has_left_next_to_nothing_of_has_no_target(spark):
    """Else a few documents would be repeated without end: rates stay small, and the other targets are met."""
    rng = np.random.default_rng(9)
    toxic = np.where(rng.random(5000) < 0.08, rng.uniform(0.5, 0.95, 5000), rng.uniform(0.005, 0.05, 5000))
    low = rng.uniform(1e-4, 1e-3, 5000)
    rows = spark.createDataFrame([(float(1 - a - b), float(b), float(a), int(n)) for a, b, n in zip(toxic, low, rng.integers(0, 900, 5000), strict=True)], "p_high double, p_low double, p_toxic double, n_tokens long")
    steps, want, now = mixing.solve(rows, mixing.TARGETS)
    p = np.stack([1 - toxic - low, low, toxic], 1)
    rate = mixing.rates(p, steps)
    assert rate.max() < 4 and (rate > 0).mean() > 0.9
    assert abs(now[0] - want[0]) + abs(now[2] - want[2]) < 1e-3 * want.sum() and now[1] < 4 * want[1]
    assert want[2] / (want[0] + want[2]) == pytest.approx(5 / 92)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 ...", "en"), (3, "abc def", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(odd).collect()} == {1: "und", 2: "und", 3: "en"}


def test_a_prediction_depends_on_its_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    texts = ["I", "ab", "\u00e9", "Das ist ein Haus", "the house of 12", "", "12 3", None, "x" * 3000]

    def predicted(own):
        rows = spark.createDataFrame([(k, False, t) for k, t in own], "doc_id long, held_out boolean, text string").coalesce(1)
        return {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(rows, model).collect()}

    together = predicted(list(enumerate(texts)))
    for k, t in enumerate(texts):
        assert predicted([(k, t)])[k] == together[k]
        assert (together[k][0] == "und") == (not re.search("[a-zA-Z\u00e9]", t or ""))
    fold = lambda t: bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in t.encode())
    for k, t in ((0, "I"), (3, texts[3]), (4, texts[4])):  # the softmax by its definition
        x = b" " + fold(t) + b" "
        keys = [a * 257 + b for a, b in zip(x, x[1:], strict=False)] + [(a * 257 + b) * 257 + c + (1 << 30) for a, b, c in zip(x, x[1:], x[2:], strict=False)]
        rows = [model.table[(q * 0x9E3779B97F4A7C15 % 2**64) >> 51].astype(float) for q in keys]
        z = (sum(rows) / len(rows) + model.bias) / model.temperature
        share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert together[k][1] == pytest.approx(share.max(), rel=1e-4) and together[k][0] == model.languages[int(share.argmax())]


def test_scores_follow_their_definition(spark, odd):
    got = sorted(lm.score_texts(odd).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    rows = sorted(odd_rows(), key=lambda r: (r[0] is None, r[0] or 0, len(words(lower(r[1])))))
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    count = Counter()
    for r, h in zip(rows, held, strict=True):
        if not h:
            count.update([*words(lower(r[1])), None])
    total, size = sum(count.values()), len(count)
    for r, h, g in zip(rows, held, got, strict=True):
        t = [*words(lower(r[1])), None]
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (size + 1))) for x in t)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (h, len(t), sum(count[x] > 0 for x in t), total)
        assert g.base_score == pytest.approx(base) and g.score < 0


def test_model_is_normalised(spark):
    model = lm.LogBilinear(lm.LogBilinear.start(np.ones(lm.CLASSES)))
    sums = np.stack([model.normaliser(k) for k in range(3)])
    every = np.arange(lm.CLASSES - 1)
    for two, one in ((0, 0), (2, 9)):
        logs = model.log10(np.full(len(every), two), np.full(len(every), one), every, sums)
        assert (10.0**logs).sum() == pytest.approx(1, abs=1e-4)


def test_scores_are_the_same_for_any_partitioning_and_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    runs = [sorted(map(tuple, lm.score_texts(docs.repartition(n)).collect())) for n in (1, 8, 64)]
    assert runs[0] == runs[1] == runs[2]
    held = [r for r in runs[0] if r[1]]
    assert sum(r[6] - r[5] for r in held) >= 0.17 * sum(r[2] for r in held)


def test_shards(spark, odd):
    def draw(key, shard):
        return int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16)

    rows = sharding.shard_layout(odd).collect()
    slots = defaultdict(list)
    for r in rows:
        key = "" if r.doc_id is None else r.doc_id
        assert r.shard == max(range(24), key=lambda s: (draw(key, s), s)) and r.grown_shard == max(range(25), key=lambda s: (draw(key, s), s))
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in odd_rows())
    assert Counter((r.size, r.text_crc32) for r in rows) == want
    many = sharding.assign_shards(spark.range(20_000).withColumnRenamed("id", "doc_id"), "doc_id", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    share = {r.shard: r["count"] / 20_000 for r in many}
    assert set(share) == {0, 1} and abs(share[1] - 0.75) < 0.02


def test_decontamination_offsets(spark):
    docs = spark.createDataFrame([(1, "Intro! The QUICK, brown fox -- jumps é over a lazy dog today again."), (2, "nothing here"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "the quick brown fox jumps é over a lazy dog today"), (2, "lazy dog"), (3, "zebra")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.mark(docs, bench).collect()}
    text = "Intro! The QUICK, brown fox -- jumps é over a lazy dog today again.".encode()
    assert [text[s.start : s.end].decode() for s in got[1].hit_spans] == ["The QUICK, brown fox -- jumps é over a lazy dog today"]
    assert (got[1].n_hit, got[1].n_items, got[1].items_sha256) == (11, 2, hashlib.sha256(b"10,2").hexdigest())
    assert not got[2].contaminated and got[3].n_words == 0
    none = decontaminate.mark(docs, bench.limit(0)).collect()
    assert len(none) == 3 and not any(r.contaminated for r in none)


def test_one_scan_whatever_the_number_of_windows(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('w', id, ' x', id, ' said') AS text")
    bench = spark.range(3000).selectExpr("id AS item_id", "concat('w', id, ' x', id) AS text")
    marked = decontaminate.mark(docs, bench)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert {r.doc_id: (r.n_hit, r.n_items) for r in marked.collect()} == {k: (2, 1) for k in range(40)}


def test_archives_round_trip(spark, tmp_path):
    rows = [(k, f"http://h/{k % 3}", ("<p>a</p>", None, "é" * 999, "<p>a</p>", "")[k % 5]) for k in range(40)] + [(None, None, "<p>a</p>"), (7, "u v", "other"), (3, "again", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    out = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, out, 3, file_bytes=2000)
    first = sorted((p.name, p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert len(first) > 3 and not list((tmp_path / "w").glob("_temporary*"))
    got = warc.read_archives(manifest).collect()
    smallest = {}
    for page_id, _, html in rows:
        if page_id is not None:
            smallest[html or ""] = min(page_id, smallest.get(html or "", page_id))
    want = Counter()
    for page_id, _, html in rows:
        revisit = page_id != smallest[html or ""]
        want[(page_id, len((html or "").encode()), "revisit" if revisit else "response", smallest[html or ""] if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == want
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {h or "" for _, _, h in rows}
    warc.write_archives(pages.repartition(2), f"file://{tmp_path}/v", 3, file_bytes=2000)
    assert first == sorted((p.name, p.read_bytes()) for p in (tmp_path / "v").glob("*.gz"))
    assert warc.archive_pages(pages.limit(0), f"file://{tmp_path}/e", 2).count() == 0


def test_shards_of_archives_share_the_bytes_whatever_the_settings(spark, tmp_path):
    rows = [(k, "u", f"{k} " * 5) for k in range(4000)] + [(10**15, "u", "far")] + [(17, "u", f"same page {k}") for k in range(3000)] + [(None, "u", f"no page {k}") for k in range(3000)]
    pages, before, seen = spark.createDataFrame(rows, "page_id long, url string, html string"), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (3, 11):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            manifest = warc.write_archives(pages.repartition(parts), f"file://{tmp_path}/{parts}").collect()
            seen.append(sorted((r.shard, r.file, r.records, r.sha256) for r in manifest))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len(seen[0]) == warc.SHARDS
    assert max(r[2] for r in seen[0]) < 1.5 * len(rows) / warc.SHARDS
    ids = warc.read_archives(spark.createDataFrame(manifest)).groupBy("page_id").count().where("page_id = 17 or page_id is null").collect()
    assert {r.page_id: r["count"] for r in ids} == {17: 3001, None: 3000}


def test_pipeline_agrees_with_its_operators(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    sets = {k: shingle_set(rows[k].text) for k in kept}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard"]
    final = {r.doc_id: r for r in out.collect()}
    assert set(final) <= kept and all(r.text == rows[k].text for k, r in final.items())
    ids = sorted(final)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            assert not 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]), (a, b)
    assert not decontaminate.mark(out.select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    steps = [name for name, _ in corpus_pipeline.STAGES]
    assert steps == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]


def test_pipeline_returns_each_expected_row(spark):
    import corpus_pipeline

    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = sorted(r.doc_id for r in quality.judge(docs).where("kept").collect())
    sets = {k: shingle_set(texts[k]) for k in kept}
    group = {k: k for k in kept}
    for i, a in enumerate(kept):
        for b in kept[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    first = docs.where(docs.doc_id.isin(sorted(set(group.values()))))
    clean = [r.doc_id for r in decontaminate.mark(first.select("doc_id", "text"), bench).where("not contaminated").collect()]
    copies = {r.doc_id: r.copies for r in mixing.mix(docs.where(docs.doc_id.isin(clean)), labels).collect()}
    draw = lambda key, s: int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16)
    want = Counter({(k, texts[k], max(range(corpus_pipeline.SHARDS), key=lambda s: (draw(k, s), s))): n for k, n in copies.items() if n})
    assert len(want) > 50 and Counter((r.doc_id, r.text, r.shard) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_runs_of_repeated_units_keep_the_earliest(spark):
    names = "amber birch cedar dune ember frost grove heron inlet juniper".split()
    passage = " ".join(f"The {a} {b} of winter stood over {a} water." for a, b in zip(names, names[1:], strict=False))
    rows = [
        (1, f"Alone at first. {passage} And then it comes to an end"), (2, f"Something else, said before.\n{passage} Quite another end of all this"), (3, "Alone at first. Nothing more!"),
        (None, f"Last of all. {passage}"), (4, passage), (4, passage), (5, None), (6, ""), (7, "... \n !"),
    ]
    got = lines.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    kept = Counter((r.doc_id, r.kept_text, r.n_repeated) for r in got)
    size = len(passage) + 1
    assert kept == Counter([
        (1, rows[0][1], size), (2, "Something else, said before.\n Quite another end of all this", size - 1), (3, rows[2][1], 0), (None, "Last of all.", size),
        (4, "", size - 1), (4, "", size - 1), (5, "", 0), (6, "", 0), (7, rows[8][1], 0),
    ])
    alone = Counter((r.kept_text, r.n_removed) for r in lines.dedupe_lines(spark.createDataFrame([(4, passage)] * 3, "doc_id long, text string")).collect())
    assert alone == Counter({(passage, 0): 1, ("", len(passage)): 2})


def test_rates_solve_the_least_squares(spark):
    rng = np.random.default_rng(6)
    p, t = rng.dirichlet([2, 1, 0.6], 400), rng.integers(0, 300, 400)
    names = [f"p_{d}" for d in mixing.DOMAINS]
    rows = spark.createDataFrame([(k, int(n), *map(float, x)) for k, (n, x) in enumerate(zip(t, p, strict=True))], "doc_id long, n_tokens long, " + ", ".join(f"{n} double" for n in names))
    steps, want, now = mixing.solve(rows, mixing.TARGETS)
    mine = mixing.rates(p, steps)
    assert (mine >= 0).all() and np.allclose((mine * t) @ p, now, rtol=1e-6) and np.allclose(now, want, rtol=1e-4)
    a, r = p * t[:, None], np.ones(len(t))  # plain projected gradient, document by document
    for _ in range(20_000):
        r = np.maximum(0, r - a @ (r @ a - want) / np.linalg.norm(a, 2) ** 2)
    assert ((r @ a - want) ** 2).sum() <= ((1e-3 * want) ** 2).sum() and ((mine @ a - want) ** 2).sum() <= ((r @ a - want) ** 2).sum() + 1
    with pytest.warns(UserWarning, match="misses"):  # no document of the wanted domain
        mixing.solve(rows.withColumn("p_toxic", rows.p_toxic * 0), {"high": 0.0, "low": 0.0, "toxic": 1.0})
