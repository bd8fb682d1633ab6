"""Periodic runs against a search of every period at every place."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from careflow.llm.coverlce import COVERS, CoverLce, cover_for
from careflow.llm.runs import _closed, find_runs, repeated_tail, run_digests, word_runs
from careflow.llm.queries import QUERIES
from tests.llm.conftest import SMALL

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every stretch with its smallest period, by trying all."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - i + q
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_answer(doc_id, text):
    words = WORD.findall((text or "").encode())
    n = len(words)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (
        doc_id, len(runs), s, m, q, 1000 * m // q if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


@pytest.mark.parametrize("v", sorted(COVERS))
def test_covers_reach_every_pair_and_extensions_are_exact(v):
    cover = COVERS[v]
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    rng = np.random.default_rng(v)
    codes, owner, first = _closed(rng.integers(0, 2, 700), np.array([300, 0, 400]))
    codes[first[2] + 40 : first[2] + 340] = np.tile(codes[first[2] : first[2] + 3], 100)
    lce = CoverLce(codes, owner, v)
    for at, n in ((first[0], 300), (first[2], 400)):
        a, b = rng.integers(at, at + n, (2, 400))
        a, b = a[a != b], b[a != b]
        for i, j, got in zip(a, b, lce.lce(a, b)):
            plain = next(k for k in range(n + 1) if codes[i + k] != codes[j + k])
            assert got == plain


def test_cover_grows_with_the_text():
    assert [cover_for(n) for n in (10**3, 10**6, 3 * 10**6, 5 * 10**6, 10**9)] == [7, 7, 13, 31, 133]


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_all_periods_tried(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(rng.integers(1, 6)):
        words = []
        while len(words) < rng.integers(0, 250):
            piece = rng.integers(0, rng.integers(1, 6), rng.integers(1, 40)).tolist()
            words += piece * int(rng.integers(1, 9)) + piece[: rng.integers(0, len(piece) + 1)]
        texts.append(words)
    codes = np.array([w for t in texts for w in t], np.int64)
    got = find_runs(codes, np.array([len(t) for t in texts], np.int64), v=sorted(COVERS)[seed % len(COVERS)])
    rows = list(zip(*(x.tolist() for x in got)))
    assert rows == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


def test_long_periods_are_found_in_chunks():
    rng = np.random.default_rng(5)
    words = np.concatenate([rng.integers(0, 10**6, 1000), np.tile(rng.integers(0, 10**6, 5000), 5), [1, 2, 3]])
    rows = list(zip(*(x.tolist() for x in find_runs(words, np.array([len(words)])))))
    assert rows == [(0, 1000, 25000, 5000)]


def test_equal_words_of_several_texts_are_no_match():
    # One word at places 70, 80, 90 and 100 of the grid: the last of the first text and three of the second.
    texts = [[*range(1, 70), 0], list(range(100, 130)), [0] * 6]
    texts[1][8::10] = [0] * 3
    got = find_runs(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert list(zip(*(x.tolist() for x in got))) == [(2, 0, 6, 1)]


@pytest.mark.parametrize("seed", range(10))
def test_many_short_texts_beside_long_ones(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 40, rng.integers(0, 600 if i % 8 == 0 else 30)).tolist() for i in range(40)]
    texts += [np.tile(rng.integers(0, 40, rng.integers(1, 9)), 5).tolist()]
    rows = list(zip(*(x.tolist() for x in find_runs(np.concatenate(texts).astype(np.int64), np.array([len(t) for t in texts])))))
    assert rows == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


def test_odd_texts(spark, docs):
    texts = [
        None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a",
        "x " * 3000, ("a b c d " * 30 + "e ") * 6, "a\x0ba\x0ca\ra\na\ta", "a a a a " * 4,
        " ".join(str(i % 7) for i in range(20_000)),
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b b b b b b"), (4, "a a a a a a"), (4, "a a a a a a")]
    got = run_digests(word_runs(docs(*rows), repeated_tail)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((plain_answer(*r) for r in rows), key=key)
    assert word_runs(docs(*rows).limit(0)).count() == 0


def test_real_outputs(spark, docs):
    row = word_runs(docs("so so so so so so much, much, more")).first()
    assert [tuple(r) for r in row.runs] == [(0, 6, 1)]
    assert (row.n_words, row.collapsed) == (9, "so much, much, more")


def test_query_equals_brute_force(spark):
    read = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_periodic_runs"](spark, SMALL)
    assert dict(got.dtypes) == {c: "bigint" for c in got.columns[:-2]} | {c: "string" for c in got.columns[-2:]}
    assert sorted(map(tuple, got.collect())) == sorted(plain_answer(*r) for r in read)
    assert got.where(F.col("n_runs") > 0).count() >= 10


def test_a_text_of_one_word_has_few_matches():
    from careflow.llm import runs

    codes = np.append(np.zeros(20_000, np.int64), 1)
    place, period = runs._grid_matches(codes, 20_000)
    # Each of the 5,000 periods has matches in it, all of the one run.
    assert len(place) < 100
    assert [x.tolist() for x in runs.find_runs(codes[:-1], np.array([20_000]))] == [[0], [0], [20_000], [1]]


def test_stretches_of_small_periods_stand_for_all_their_multiples(monkeypatch):
    from careflow.llm import runs

    rng = np.random.default_rng(3)
    texts = [np.concatenate([np.tile(rng.integers(0, 3, rng.integers(1, 9)), rng.integers(1, 40)) for _ in range(5)]) for _ in range(60)]
    codes, counts = np.concatenate(texts), np.array([len(t) for t in texts])
    monkeypatch.setattr(runs, "MANY", 1 << 62)
    expected = runs.find_runs(codes, counts)
    monkeypatch.setattr(runs, "MANY", 0)
    assert all(np.array_equal(a, b) for a, b in zip(runs.find_runs(codes, counts), expected))
