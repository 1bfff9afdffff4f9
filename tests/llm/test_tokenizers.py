"""Token counts and alignments against the libraries' own encodings of whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from test_operators import ODD, odd_rows
from tokenizers import Tokenizer

from filingflow.llm import alignment, pretokens, tokencount

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = [*"aab the.,'\n\n\t  \x00\x1c 　é日本語\U0001f600<>0x41/_s\r\x85", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", " the", " word", "'s", "▁", "of the "]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(12)
    own = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    words = ["the", "strasse", "über", "x-1", "9,81", "(a)", "\n\n", "日本"]
    long = " ".join(rnd.choice(words) for _ in range(150_000))
    return [None, "", " ", "  ", "\n", "a\n", "a\n\nb", "▁", *own, *own[:200], long, "x" * 70_000, "y " * 300, "\n \n" * 200]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def test_cuts_are_as_the_pattern_says(texts):
    for text in texts:
        units = [u for s in pretokens.pretokens(text) for u in s]
        assert units == (pretokens.CUT.split(" " + text) if text else [])


def test_cuts_are_refused_when_the_vocabulary_has_pieces_over_them():
    model = pretokens.Pieces(pretokens.read_bytes(B))
    assert model.proved_cuts()
    for piece in ("a▁b", "x\n"):
        model.pieces.append((piece, pretokens.NORMAL))
        assert not model.proved_cuts()
        model.pieces.pop()


def test_counts_are_those_of_the_library(spark, texts, libraries):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(rows, B).collect()}
    for k, text in enumerate(texts):
        n = len(libraries[1].encode(text or ""))
        assert got[k] == (len((text or "").encode()), n, n > tokencount.LIMIT), text
    plan = tokencount.count_tokens(rows, B)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the fixture's own


def test_whole_tokens_are_proved(libraries):
    model = pretokens.Pieces(pretokens.read_bytes(B))
    whole = tokencount.whole_tokens(model)
    assert len(whole) > 30_000
    for s in random.Random(1).sample(sorted(s for s in whole if s.startswith(" ") and len(s) > 1), 2000):
        assert len(libraries[1].encode(s[1:])) == 1


def brute_alignment(texts, a, b):
    """Per text: token ids with their byte ranges, by the libraries' tokens of whole texts; then all overlapping pairs."""
    a_bytes, b_bytes = pretokens.ByteMerges(pretokens.read_bytes(A)).bytes_of(), pretokens.Pieces(pretokens.read_bytes(B)).bytes_of()
    sides = []
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(a_bytes[i] for i in x) != raw or b"".join(b_bytes[i] for i in y) != raw:
            x = y = []
        sides.append((x, y))
    pairs, links = Counter(), []
    for x, y in sides:
        i = j = at_a = at_b = 0
        own, groups, ga, gb = [], [], [], []
        while i < len(x):  # two pointers: the token that ends first makes way
            own.append((x[i], y[j]))
            end_a, end_b = at_a + len(a_bytes[x[i]]), at_b + len(b_bytes[y[j]])
            if end_a <= end_b:
                ga.append(x[i])
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                gb.append(y[j])
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        pairs.update(own)
        links.append((own, groups))
    best = {}
    for (i, j), n in pairs.items():
        best[j] = max(n, best.get(j, 0))
    out = []
    for (x, y), (own, groups) in zip(sides, links, strict=True):
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        out.append((len(x), len(y), len(groups), len(own), sum(pairs[p] == best[p[1]] for p in own), sum(pairs[p] for p in own), sha))
    return out


def test_alignments_match_brute_force(spark, texts, libraries, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute_alignment(texts, *libraries)
    assert {r[0]: tuple(r[1:]) for r in alignment.align(rows, A, B).collect()} == dict(enumerate(want))
    assert sum(w[0] for w in want) > 100_000 and any(t and not w[0] for t, w in zip(texts, want, strict=True))
    # many chunks, and a memo that is forgotten, in this process, as workers have their own copy of the module
    aligner = alignment.Aligner(pretokens.ByteMerges(pretokens.read_bytes(A)), pretokens.Pieces(pretokens.read_bytes(B)))
    monkeypatch.setattr(alignment, "MEMO", 50)
    for k in range(0, 300, 20):
        row = aligner.chunk(k, [*range(k, k + 20)], [aligner.read(t) for t in texts[k : k + 20]])
        assert [*zip(*row[2:6], strict=True)] == [w[:4] for w in want[k : k + 20]] and row[6] == [w[6] for w in want[k : k + 20]]


def test_stabbing_finds_the_token_that_holds_a_byte():
    first, last, boundary = alignment.overlaps(alignment.np.array([3, 1, 2, 4]), alignment.np.array([1, 3, 2, 2, 2]))
    assert (first.tolist(), last.tolist(), boundary.tolist()) == ([0, 1, 2, 3], [1, 1, 2, 4], [False, True, True, False, True])


def test_odd_tables(spark):
    odd = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    clash = odd.withColumnsRenamed({"chunk": "code", "n": "n_tokens", "part": "n_bytes"})
    for table in (odd, clash):
        for run in (lambda d: tokencount.count_tokens(d, B), lambda d: alignment.align(d, A, B)):
            out = run(table)
            assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(str(r[0]) for r in odd_rows())
            assert run(table.limit(0)).count() == 0


def test_many_copies_of_one_row(spark, libraries):
    """Equal rows are dealt as they lie, never by what they hold."""
    rows = spark.range(60_000).selectExpr("CAST(7 AS LONG) AS doc_id", "'one and the same row' AS text").repartition(6)
    n = len(libraries[1].encode("one and the same row"))
    assert {tuple(r) for r in tokencount.count_tokens(rows, B).distinct().collect()} == {(7, 20, n, False)}
    got = alignment.align(rows, A, B).groupBy("n_b", "n_links", "n_best", "count_sum").count().collect()
    assert len(got) == 1 and got[0]["count"] == 60_000 and got[0].n_b == n and got[0].n_best == got[0].n_links
    assert got[0].count_sum == 60_000 * brute_alignment(["one and the same row"], *libraries)[0][5]
