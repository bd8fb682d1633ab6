import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from careflow.llm import additive, toxicity
from careflow.llm.common import read
from careflow.llm.labelled import training_texts
from tests.llm.conftest import SMALL

SF = SMALL.replace("0.001", "0.01")


def test_quality_is_learned_without_the_held_out(spark):
    out = additive.quality(read(spark, SF, "documents"), read(spark, SF, "labels"))
    rows = out.join(read(spark, SF, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.93 * len(held)


def test_toxicity_is_learned_without_the_held_out(spark):
    out = toxicity.toxicity(read(spark, SF, "documents"), read(spark, SF, "labels"))
    rows = out.join(read(spark, SF, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)
    assert not any(r.predicted for r in held if not r.toxic)


def test_labels_of_the_held_out_change_nothing(spark, docs, labels):
    rng = random.Random(3)
    table = docs(*[" ".join(rng.choice(["good", "fine", "bad", "vile"]) for _ in range(30)) for _ in range(120)])
    given = [(i, i % 2, i % 2) for i in range(120)]
    for score, by, held in ((additive.quality, 5, 0), (toxicity.toxicity, 3, 1)):
        turned = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % by == held else (i, q, t) for i, q, t in given]
        a, b = (sorted((r.doc_id, r.score) for r in score(table, labels(*rows)).collect()) for rows in (given, turned))
        assert a == b


def test_nulls_empty_and_long_texts_repeated_rows_and_no_labels(spark, docs, labels):
    table = docs((1, None), (1, ""), (None, "x"), (2, "word " * 40_000), (2, "word " * 40_000), (3, "\0 odd ퟿"))
    some = labels((1, 0, 1), (2, 1, 0), (2, None, None), (None, 1, 1), (3, 5, 7))
    for score in (additive.quality, toxicity.toxicity):
        for given in (some, some.limit(0)):
            got = score(table, given).collect()
            assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
            assert len({r.score for r in got if r.doc_id == 2}) == 1 and len({r.score for r in got if r.doc_id == 1}) == 1
        assert score(table.limit(0), some).count() == 0


def test_tables_and_pairs_add_up():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = additive.fit(x, y, rounds=30, pair_rounds=60, pairs=2)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9


def test_present_ngrams_stay_within_their_text():
    rows, _ = toxicity.present(["ab", "", None, "cd"])
    assert rows.tolist().count(0) == 3 and rows.tolist().count(3) == 3 and 2 not in rows


def test_training_texts_are_bounded_however_many_rows_an_id_has(docs, labels):
    table = docs(*[(1, "copy")] * 300, *[(1, f"text {i}") for i in range(200)], *[(i, f"other {i}") for i in range(2, 30)], (31, None), (31, ""))
    given = labels(*[(1, 1, 0)] * 5, *[(i, i % 2, 0) for i in range(2, 32)], (2, 1, 0))

    def taken(most):
        return [tuple(r) for r in training_texts(table, given, "quality", F.lit(True), most).collect()]

    every = taken(10_000)
    assert len(every) == len(set(every)) == 201 + 28 + 2 + 1
    assert {t for i, t, _ in every if i == 31} == {None, ""} and {v for i, _, v in every if i == 2} == {0, 1}
    some = taken(50)
    assert len(some) == 50 and set(some) <= set(every) and set(some) == set(taken(50))
