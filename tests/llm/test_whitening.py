"""Whitening against a plain computation over all distinct vectors."""

import math

import numpy as np
import pytest

from careflow.llm.queries import QUERIES
from careflow.llm.whitening import _deviation, whiten
from tests.llm.conftest import SMALL

SCHEMA = "vec_id long, embedding array<double>, label int, n int, key string, component string, size string"


def table(spark, *vectors):
    rows = [v if isinstance(v, tuple) else (i, v) for i, v in enumerate(vectors)]
    return spark.createDataFrame([(i, v, 0, 1, "x", "x", "x") for i, v in rows], SCHEMA)


def usable(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


def plain(rows, weights="one", components=4):
    """(vec_id, component) -> n, deviation, |whitened|, explained."""
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v in rows if usable(v)}
    fit = [*x.values()] if weights == "count" else [*dict.fromkeys(x.values())]
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    y = (np.array(fit, object) * n - np.array(total, object)).astype(float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    out = {}
    for i, v in x.items():
        apart = [n * a - s for a, s in zip(v, total)]
        for k in range(1, min(components, len(total)) + 1):
            e, u = values[-k], vectors[:, -k]
            if e > 1e-9 * values.sum():
                white = float(np.array(apart, float) / n @ u / math.sqrt(e))
                out[i, k] = (n, sum(a * a for a in apart), abs(white), e / values.sum())
    return out


def same(got, expected):
    rows = got.collect()
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted(expected)
    for r in rows:
        n, deviation, white, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation if deviation < 2**63 else None)
        assert abs(r["whitened"]) == pytest.approx(white, rel=1e-7, abs=1e-7)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
    for k in {r["component"] for r in rows}:  # one sign for all rows: equal to a whitened axis or its mirror
        white = np.array([r["whitened"] for r in rows if r["component"] == k])
        assert white.min() <= 0 <= white.max()


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(1, 3, d)).round(3).tolist()


@pytest.mark.parametrize("weights", ["one", "count"])
def test_copies_weigh_one_or_their_number(spark, weights):
    some = vectors(1, 40, 5)
    rows = list(enumerate(some + [some[0]] * 60 + [[c + 1e-5 for c in some[1]]]))
    same(whiten(table(spark, *rows), weights=weights), plain(rows, weights))


def test_left_out_rows(spark):
    some = vectors(2, 30, 3)
    odd = [None, [], [1.0, None, 2.0], [float("nan")] * 3, [1.0, float("inf"), 0.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    rows = list(enumerate(some + odd + [[-0.0, 0.0, -1e-9]]))
    expected = plain([r for r in rows if r[1] is not None and len(r[1]) == 3 and r[1][0] != 1e300])
    same(whiten(table(spark, *rows)), expected)


def test_repeated_rows_and_null_ids_are_answered_each(spark):
    some = vectors(3, 10, 2)
    rows = [*enumerate(some), (4, some[4]), (None, some[5])]
    got = whiten(table(spark, *rows))
    assert got.count() == 24 and got.where("vec_id = 4").count() == 4 and got.where("vec_id IS NULL").count() == 2


def test_no_spread_gives_no_component(spark):
    assert whiten(table(spark)).count() == 0
    assert whiten(table(spark, None, [])).count() == 0
    assert whiten(table(spark, [1.0, 2.0], [1.0, 2.0])).count() == 0
    flat = [[a, 2 * a, 0.0] for a in (0.0, 1.0, 3.0)]
    same(whiten(table(spark, *flat)), plain(list(enumerate(flat))))
    with pytest.raises(ValueError):
        whiten(table(spark), weights="rows")


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(i * 10**7 + j), float(j * 10**6)]) for i in range(5) for j in range(3)]
    rows = [(k, v) for k, (_, v) in enumerate(rows)]
    same(whiten(table(spark, *rows)), plain(rows))
    assert _deviation(np.array([[2**40, 0], [3, 4]], object)) == [None, 25]


def test_query_equals_plain_computation(spark):
    read = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op12_weighted_whitening"](spark, SMALL)
    assert dict(got.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double",
    }
    same(got, plain(read))
