import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from careflow.llm import rangecoder
from careflow.llm.tokens import encoder
from careflow.llm.idfiles import coded_ids, write_ids
from careflow.llm.packing import best_fit, fix_dominating, pack, solve
from careflow.llm.tokens import Encoder

ODD = ["", "  a", "a  b", "\n\n x", "x \n", "don't I'll  'S", "Ünïcödé ß", "日本 語", "a b", "é x", "\x1c a", "<|endoftext|> x", "1 2345", "²½ ª", "İstanbul ŉ", "   lead", "tail   "]


def ids_of(name, text, end):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_kept_parts_give_the_library_s_ids(name):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(list(" \n\t'stdmlrev aB.9é²ß!$ŉİ́")) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    encoder = Encoder(public_tokenizers.path(name))
    assert encoder.ids(texts) == [encoder.whole(t) for t in texts]


def fewest(items, capacity):
    best = [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {left: j for j, left in enumerate(bins) if left >= items[i]}.values():
            bins[b] -= items[i]
            put(i + 1, bins)
            bins[b] += items[i]
        put(i + 1, [*bins, capacity - items[i]])

    put(0, [])
    return best[0]


def test_dominating_sets_keep_the_optimum():
    for seed in range(300):
        rng = random.Random(seed)
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        counts = np.bincount(items, minlength=capacity + 1)
        fixed = fix_dominating(counts, capacity)
        rest = [x for x in range(capacity, 0, -1) for _ in range(counts[x])]
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(items, capacity)


def test_patterns_use_every_piece_once():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(6, 1.2, 20_000).astype(int) + 1, 4096)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    used = defaultdict(int)
    for runs, times in solve(histogram):
        assert sum(n * each for n, each in runs) <= 4096
        for n, each in runs:
            used[n] += each * times
    assert used == histogram
    assert best_fit(np.zeros(4097, np.int64), 4096) == []


def test_packed_pieces(docs):
    texts = [None, "", "some words", "some words", "long text " * 6000, *ODD, *["word " * n for n in (400, 2000, 4094, 4095, 4096)]]
    table = docs(*texts, (None, "x"), (2, "some words"))
    got = [tuple(r) for r in pack(table, public_tokenizers.path("word_bpe_49k.json")).collect()]
    want = []
    for doc_id, text in [*enumerate(texts), (None, "x"), (2, "some words")]:
        ids = ids_of("word_bpe_49k.json", text, 1)
        want += [(doc_id, i, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for i, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str)
    rows = defaultdict(list)
    for r in got:
        rows[r[5]].append((r[6], r[3]))
    for row in rows.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(rows) <= -(-sum(r[3] for r in got) // 4096) + 1
    assert pack(table.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("vocabulary, n", [(50_257, 0), (50_257, 1), (300, 5000), (50_257, 9000), (2, 9000)])
def test_range_coder_round_trip(monkeypatch, vocabulary, n):
    monkeypatch.setattr(rangecoder, "BLOCK", 1500)
    rng = np.random.default_rng(n)
    ids = np.minimum((rng.pareto(0.6, n) * 20).astype(np.int64), vocabulary - 1)
    data = rangecoder.write_chunk(ids.astype("<u4"), vocabulary)
    assert (rangecoder.read_chunk(data) == ids).all()
    assert len(data) < 2 * n + 200


def test_smaller_than_deflate_and_than_fixed_frequencies(spark):
    """On real texts: below zlib on the same blocks, and below the entropy of single ids."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400).collect()]
    ids = np.frombuffer(b"".join(encoder(public_tokenizers.path("byte_bpe_50k.json")).ids(texts)), "<u4")
    data = rangecoder.write_chunk(ids, 50_257)
    assert (rangecoder.read_chunk(data) == ids).all()
    block = rangecoder.BLOCK
    deflated = sum(len(zlib.compress(ids[i : i + block].tobytes())) for i in range(0, len(ids), block))
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = -(share * np.log2(share)).sum() * len(ids) / 8
    assert len(data) < 0.85 * deflated and len(data) < entropy


def test_learned_repeats_shrink_and_damage_is_noticed():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_257, 300), 40)
    data = rangecoder.write_chunk(ids, 50_257)
    assert len(data) < 0.5 * len(ids)
    damaged = bytearray(data)
    damaged[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        rangecoder.read_chunk(bytes(damaged))
    with pytest.raises(ValueError):
        rangecoder.read_chunk(b"XXXX" + data[4:])


def test_id_files_in_document_order(spark, docs, tmp_path):
    texts = [(5, "five words are in here"), (3, None), (4, ""), (3, "again"), (None, "nobody"), (9, "long text " * 3000), (5, "five words are in here")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = sorted(tuple(r) for r in coded_ids(docs(*texts).where("doc_id is not null").repartition(3), path).collect())
    at, want = 0, []
    order = sorted(((i, t) for i, t in texts if i is not None), key=lambda r: r[0])
    sizes = {(r[0], r[3]): r[2] for r in rows}
    for doc_id, text in order:
        ids = ids_of("byte_bpe_50k.json", text, 2)
        assert sizes[doc_id, crc(ids)] == len(ids)
        want.append(len(ids))
    starts = sorted((r[1], r[2], r[0]) for r in rows)
    for start, n, _ in starts:
        assert start == at
        at += n
    assert at == sum(want) and [r[2] for r in starts] == [i for i, _ in order]
    assert coded_ids(docs(*texts), path).where("doc_id is null").first().start == 0
    assert coded_ids(docs("x").limit(0), path).count() == 0
    write_ids(docs(*texts), str(tmp_path / "ids"), path, chunk=10)
    # Every document of ten ids or more closes a chunk; shorter ones share one.
    assert spark.read.parquet(str(tmp_path / "ids")).where("size(doc_ids) > 0").count() >= 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_words_need_no_regular_expression(name):
    own = Encoder(public_tokenizers.path(name))
    whole = own.library
    texts = ["Word, word. été! Ünder?! word:; a", "İzmir, don't, 'tis x2, ...", "ªº, x. ?! ."]
    expected = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.ids(texts) == expected
    own = Encoder(public_tokenizers.path(name))
    own.cut = None
    assert own.ids(texts[:1]) == expected[:1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("entries", [8, 64, 1 << 12])
def test_full_tables_of_parts_and_texts_by_the_library(name, entries):
    rng = random.Random(entries)
    texts = ODD + ["".join(rng.choice(list(" \n\t  'stdmlrevaB.9é²ß!$ŉ<|日\xa0")) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["x" * 30 + " y", "x" * 24, " " + "é" * 13, "a" * 100 + "\n\n", "", " ", "\n", "a\n", " \n b", *(f"{w}{i}" for i in range(9) for w in ("a ", " b", "é"))]
    own = Encoder(public_tokenizers.path(name), entries)
    expected = [own.whole(t) for t in texts]
    assert own.ids(texts) == expected == own.ids(texts)
    ids, counts = own.arrays(pa.array([None, *texts, None])[1:])
    assert ids.tobytes() == b"".join(expected) and counts.tolist() == [len(e) // 4 for e in expected] + [0]
    assert own.parts.n <= entries


def test_a_long_chunk_takes_little_time_an_id():
    """CPU seconds of coding and reading back, over those of a loop that tells how fast the machine is now."""
    rng = np.random.default_rng(3)
    ids = np.minimum((rng.pareto(0.6, 2_000_000) * 20).astype(np.int64), 50_256).astype("<u4")

    def seconds(work):
        at = time.thread_time()
        return work(), time.thread_time() - at

    unit = min(seconds(lambda: sum(range(50_000)))[1] for _ in range(50))
    data, wrote = seconds(lambda: rangecoder.write_chunk(ids, 50_257))
    back, read = seconds(lambda: rangecoder.read_chunk(data))
    assert (back == ids).all()
    assert (wrote + read) / len(ids) < 2.2e-3 * unit


@pytest.mark.parametrize("n", [1, 5, 6, 7, 12, 13])
def test_lanes_of_every_length(monkeypatch, n):
    monkeypatch.setattr(rangecoder, "BLOCK", 6)
    ids = np.array([7, 7, 50_000, 7, 7, 50_000, 3, 7, 7, 50_000, 3, 3, 0], "<u4")[:n]
    data = rangecoder.write_chunk(ids, 50_257)
    assert (rangecoder.read_chunk(data) == ids).all()
    for i in range(len(data)):
        with pytest.raises(ValueError):
            rangecoder.read_chunk(data[:i] + bytes([data[i] ^ 64]) + data[i + 1 :])
    with pytest.raises(ValueError):
        rangecoder.read_chunk(data[:-1])
