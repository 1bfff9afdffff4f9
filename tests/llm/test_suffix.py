"""Suffix arrays and the removal of repeated strings, against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from filingflow.llm import induced
from filingflow.llm.induced import common_prefixes, suffix_array
from filingflow.llm.suffix import LENGTH, STRINGS, remove_repeats, repeated_starts, segments


def sorted_suffixes(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("small", [2048, 0])
def test_suffix_array_and_prefixes(small, monkeypatch):
    monkeypatch.setattr(induced, "SMALL", small)
    rng = random.Random(1)
    for _ in range(400):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 5, 20])
        s = [rng.randint(1, k) for _ in range(n)]
        if rng.random() < 0.3:
            s = (s[:7] * 20)[:n]
        s = [*s, 0]
        order = suffix_array(np.array(s), k + 1)
        assert order.tolist() == sorted_suffixes(s)
        prefix, before = common_prefixes(np.array(s), order)
        for i, j in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
            same = 0
            while s[i + same] == s[j + same]:
                same += 1
            assert (prefix[i], before[i]) == (same, j)


def brute(texts):
    seen = Counter(t[i : i + LENGTH] for t in texts for i in range(len(t) - LENGTH + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - LENGTH + 1):
            if seen[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(70), prose(300)
    texts = [None, "", "a", "a" * 199, "a" * 200, "b" * 201, "xy" * 700, prose(900)]
    texts += [prose(rng.randint(0, 60)) + passage + prose(rng.randint(0, 60)) for _ in range(60)]
    texts += [long] * 5
    for _ in range(40):  # near copies
        w = long.split()
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    t = prose(200)
    texts += [t + t[100:330], prose(30) + t[5:210] + prose(40)]
    return texts


@pytest.mark.parametrize("most", [1000, 3])
def test_removal_matches_brute_force(spark, most):
    texts = corpus()
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, n_bytes string, spans int")
    got = remove_repeats(frame, most=most, chunk_bytes=5_000).collect()
    want = list(brute([(t or "").encode() for t in texts + texts[-1:]]))
    key = lambda d: -1 if d is None else d
    expect = sorted((key(r[0]), *w) for r, w in zip(rows + rows[-1:], want, strict=True))
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == expect
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_within_a_piece():
    text = b"0123456789" * 30
    piece, at = repeated_starts([text, b"z" * 250, b"q" * 200])
    assert at[piece == 0].tolist() == list(range(101)) and at[piece == 1].tolist() == list(range(51)) and not (piece == 2).any()


def test_long_repetitive_texts():
    flat = np.frombuffer(b"ab" * 3_000_000, np.uint8)
    document, start, end, key, digest, check, _ = segments(flat, np.array([0, len(flat)]))
    assert (end - start).max() == STRINGS + LENGTH - 1 and len(set(zip(digest.tolist(), check.tolist(), strict=True))) <= 4
    assert start[0] == 0 and end[-1] == len(flat) and ((start[1:] + LENGTH - 1) == end[:-1]).all()


def test_very_long_document(spark):
    text = "ab" * 2_300_000 + "".join(chr(99 + k * k % 23) for k in range(199)) + "cd" * 100
    got = remove_repeats(spark.createDataFrame([(1, text), (2, "cd" * 120)], "doc_id long, text string"), texts=False).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in got} == {1: (4_600_000 + 200, 2), 2: (240, 1)}
