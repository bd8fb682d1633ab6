"""Near duplicates among embeddings against all pairs, and the bound behind the 8-bit products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import careflow.llm.tiles as tiles
from careflow.llm.tiles import near_vectors, possible, quantised
from careflow.llm.vectors import merge
from tests.conftest import rows
from tests.llm.conftest import SMALL

SCHEMA = "vec_id long, embedding array<double>, label int, key string, cid string, component string, rows int"


def table(spark, *vectors):
    given = [v if isinstance(v, tuple) else (i, v) for i, v in enumerate(vectors)]
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", 1) for i, v in given], SCHEMA)


def linked(a, b, threshold):
    for v in (a, b):
        if v is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return False
    if len(a) != len(b):
        return False
    a, b = (np.array(v) / max(map(abs, v)) for v in (a, b))
    return np.array_equal(a, b) or (a @ b) / math.sqrt((a @ a) * (b @ b)) >= threshold


def plain(given, threshold=0.95):
    n = len(given)
    near = [[j for j in range(n) if i != j and linked(given[i][1], given[j][1], threshold)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        least = min((given[j][0] for j in seen if given[j][0] is not None), default=None)
        out.append((given[i][0], len(near[i]), least, given[i][0] == least))
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def clustered(seed, n, d, spread):
    """Chains and clumps around few centres, many pairs near the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 8), d))
    return (centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, d))).round(4).tolist()


@pytest.mark.parametrize("d,spread,threshold", [(2, 0.1, 0.95), (8, 0.15, 0.95), (8, 0.3, 0.8), (40, 0.22, 0.95), (5, 0.01, 1.0)])
def test_equals_all_pairs(spark, d, spread, threshold, monkeypatch):
    monkeypatch.setattr(tiles, "GROUP", 32)
    given = list(enumerate(clustered(d, 150, d, spread)))
    got = near_vectors(table(spark, *given), threshold)
    assert rows(got) == plain(given, threshold)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        None, [], [0.0, 0.0], [-0.0, 0.0], [1.0, None], [1.0, nan], [inf, 1.0], [1.0, 2.0], [1.0, 2.0], [2.0, 4.0],
        [1e300, 2e300], [1e-310, 2e-310], [1.0, 2.0, 0.0], [-1.0, -2.0], [0.0, 3.0], [-0.0, 3.0], [5.0],
    ]
    given = [*enumerate(vectors), (7, [1.0, 2.0]), (7, [1.0, 2.01]), (None, [1.0, 2.0]), (None, [7.0, -7.0]), (None, None)]
    assert rows(near_vectors(table(spark, *given))) == plain(given)
    assert near_vectors(table(spark)).count() == 0
    assert near_vectors(table(spark, None, [0.0])).where("kept AND n_links = 0").count() == 2
    with pytest.raises(ValueError):
        near_vectors(table(spark), 0)


def test_copies_are_counted_not_listed(spark):
    """A third of the rows are one vector: the work is on classes, the counts are of rows."""
    given = [(i, [1.0, 0.0, 0.0]) for i in range(500)] + [(500 + i, v) for i, v in enumerate(clustered(3, 60, 3, 0.4))]
    given += [(1000, [1.0, 0.2, 0.0]), (-5, [1.0, 0.45, 0.0])]
    got = near_vectors(table(spark, *given))
    assert rows(got) == plain(given)
    assert got.where("vec_id < 500 AND component_id = -5 AND n_links >= 500").count() == 500


@pytest.mark.parametrize("d", [1, 3, 64, 2500])
def test_bound_holds_for_every_pair(d):
    rng = np.random.default_rng(d)
    centre = rng.normal(size=d)
    a = centre + rng.normal(size=(70, d)) * rng.uniform(0, 0.8, (70, 1))
    b = centre * rng.choice([1, 3e200], (90, 1)) + 0.3 * rng.normal(size=(90, d))
    b[::7, 0] *= 50
    unit = [tiles._scaled(x) for x in (a, b)]
    unit = [x / np.linalg.norm(x, axis=1)[:, None] for x in unit]
    cosine = unit[0] @ unit[1].T
    for threshold in (0.3, 0.9, 0.95, 0.999):
        room = possible(quantised(a), quantised(b), threshold)
        assert room[cosine >= threshold].all()
        far = cosine < threshold - 0.1
        assert not room[far].all() if far.any() and d > 3 else True
    (q, scale, rest) = quantised(a)
    assert q.dtype == np.int8 and np.allclose(np.linalg.norm(unit[0] - q / scale[:, None], axis=1), rest)


def test_merged_components():
    rng = np.random.default_rng(1)
    label, a, b = np.arange(300), rng.integers(0, 300, 140), rng.integers(0, 300, 140)
    merge(label, a, b)
    plain_label = list(range(300))
    for _ in range(300):
        for x, y in zip(a, b):
            plain_label[x] = plain_label[y] = min(plain_label[x], plain_label[y])
    assert label.tolist() == plain_label


def test_query_columns_and_links_between_float_vectors(spark):
    rng = np.random.default_rng(9)
    read = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    near = [(10_000 + i, (np.array(v) + 0.04 * rng.normal(size=len(v))).astype(np.float32).tolist()) for i, v in read[:60]]
    given = spark.createDataFrame(read + near, "vec_id long, embedding array<float>")
    got = near_vectors(given)
    assert dict(got.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert rows(got) == plain(read + near)
    assert 10 < got.where(F.col("n_links") > 0).count() < 120
