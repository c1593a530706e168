"""M-tree search and hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.llm import hard_negatives, metric_search


LONGS = -(1 << 63), (1 << 63) - 1


def brute(rows, k):
    whole = lambda x: math.floor(1024 * x) if abs(x) < 1e15 else int(x) * 1024
    good = sorted({(i, tuple(whole(x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, v in good:
        if i % 100 == 0:
            scores = sorted((-max(LONGS[0], min(LONGS[1], sum(a * b for a, b in zip(v, w, strict=True)))), j) for j, w in good if j != i and len(w) == len(v))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, region string, dim int")


@pytest.mark.parametrize("tree_rows", [16_384, 150])
def test_equals_brute_force(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(metric_search, "TREE_ROWS", tree_rows)
    make = np.random.default_rng(4)
    heads = make.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in heads[i % 6] + make.normal(size=8) * (0.05 if i % 3 else 1.0)]) for i in range(900)]
    rows += [(2000 + i, rows[100][1]) for i in range(60)]  # copies: ties by id
    rows += [(5000, None), (5001, [None] * 8), (5002, [float("nan")] * 8), (5003, [float("inf")] * 8), (None, rows[0][1]), (5100, [0.0] * 8),
             (6000, [1.0, 2.0]), (6001, [1.0, -2.0]), (7000, []), rows[5], rows[5], (7100, [3e38] * 8)]
    got = metric_search.top_k(table(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 10)


def test_large_components_take_part(spark):
    """A component beyond any limit leaves the scores that fit a long as they are."""
    rows = [(0, [1.0, 0.0]), (1, [3e5, 0.0]), (2, [0.5, 0.1]), (3, [-3e5, 1.0]), (4, [1e200, 0.0]), (100, [4e6, 1.0]), (200, [-1e300, 0.25]), (5, [1e-300, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = metric_search.top_k(frame, F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 10)
    assert {(r["vec_id"], r["score"]) for r in got if r["query_id"] == 0} >= {(1, 1024 * 1024 * 300_000), (2, 512 * 1024)}


def test_empty(spark):
    assert metric_search.top_k(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert metric_search.top_k(table(spark, [(100, None)]), F.col("vec_id") % 100 == 0).count() == 0
    assert metric_search.top_k(table(spark, [(100, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_skip_entries():
    """A close cluster is found without comparing the far ones."""
    make = np.random.default_rng(1)
    near, far = make.integers(900, 1000, (400, 4)), make.integers(-1000, -900, (4000, 4))
    vectors = np.unique(np.concatenate([near, far]), axis=0)
    sphere = metric_search.Sphere(int((vectors * vectors).sum(axis=1).max()))
    pages = metric_search.build(vectors, [np.array([i]) for i in range(len(vectors))], sphere)
    import pandas as pd

    tree = metric_search.Tree(pd.DataFrame(pages, columns=["page", "leaf", "vectors", "radii", "to_parent", "children", "ids", "n_ids"]), 4, sphere)
    seen = []
    tree.pages = type("Seen", (dict,), {"__getitem__": lambda s, k: seen.append(k) or dict.__getitem__(s, k)})(tree.pages)
    query = np.array([950, 960, 940, 955])
    got = tree.search(query, -1, 10, metric_search.NOTHING)
    scores = vectors @ query
    assert got == sorted(zip(scores.tolist(), range(len(vectors)), strict=True), key=lambda x: (-x[0], x[1]))[:10]
    assert len(seen) < len(pages) / 2


def brute_negatives(rows):
    """All (anchor, positive, rank, negative, positive score, negative score), with scores cut to a long."""
    def ints(v):
        return tuple(math.floor(256 * x) if abs(x) < 1e15 else int(x) * 256 for x in v)

    good = {(i, c, tuple(v)) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    good = [(i, (c + 1) % 10 if i % 7 == 0 else c, ints(v)) for i, c, v in good]
    out = []
    for i, c, v in good:
        if i % 100:
            continue
        pairs = sorted((-max(LONGS[0], min(LONGS[1], sum(a * b for a, b in zip(v, w, strict=True)))), j, d) for j, d, w in good if j != i and len(w) == len(v))
        for p, j, _ in [x for x in pairs if x[2] == c][:5]:
            fit = [(s, n) for s, n, d in pairs if d != c and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, j, rank + 1, n, -p, -s) for rank, (s, n) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    frame = spark.createDataFrame([(i, v, c, 1, 2, "s") for i, v, c in rows], "vec_id long, embedding array<double>, label int, id int, anchor int, strip string")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, label).collect())


@pytest.mark.parametrize("strip", [4096, 64])
def test_negatives_equal_brute_force(spark, monkeypatch, strip):
    """In one cell and in many, with pages and blocks smaller than the data."""
    monkeypatch.setattr(hard_negatives, "LEAST_STRIP", strip)
    monkeypatch.setattr(hard_negatives, "BLOCK", strip // 16)
    make = np.random.default_rng(7)
    heads = make.normal(size=(4, 11))
    rows = [(i, [float(np.float32(x)) for x in heads[i % 4] + make.normal(size=11) * 0.4], int(make.integers(0, 10))) for i in range(1200)]
    rows += [(3000 + i, rows[300][1], i % 10) for i in range(80)]  # copies: ties by id
    rows += [(5000, None, 1), (5100, [None] * 11, 1), (5200, [float("nan")] * 11, 1), (5300, [float("inf")] * 11, 1), (None, rows[0][1], 1), (5400, rows[0][1], None),
             (6000, [1.0, 2.0], 3), (6001, [1.0, 1.5], 3), (6002, [0.9, 1.5], 4), (6100, [], 1), (6101, [], 1), (6102, [], 2), (6200, [0.0] * 11, 5),
             (6300, [-1.0, -1.0], 3), rows[5], rows[5]]
    got = mined(spark, rows)
    assert got == brute_negatives(rows) and len(got) > 100


def test_negatives_of_large_components(spark):
    """Sums beyond 32 and 64 bits on the way; a score beyond a long counts as the nearest long."""
    rows = [(0, [3e5, 1.0, -2.0], 1), (1, [3e5, 4.0, 1.0], 1), (2, [2.9e5, 0.0, 0.0], 2), (3, [1.0, 0.0, 0.0], 2), (4, [1e300, 0.0, 0.0], 1), (5, [1e300, 1.0, 1e300], 2),
            (100, [1e18, 0.0, 1.0], 1), (6, [2.5, 0.25, 0.0], 1), (7, [2.25, 0.5, 1e-9], 2), (200, [1e5, 2.0, 3.0], 2), (8, [4e9, 7.0, 9.0], 2), (9, [3.5e9, 7.0, 9.0], 3)]
    got = mined(spark, rows)
    assert got == brute_negatives(rows) and got


def test_no_negatives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)]) == []  # a negative score has no window


def test_scores_are_inner_products():
    make = np.random.default_rng(3)
    x, y = make.integers(-300, 300, (50, 19)), make.integers(-300, 300, (7, 19))
    planes, bits = hard_negatives.pack(x)
    assert planes == 10
    assert (hard_negatives.scores(hard_negatives.subset_sums(y, np.int32), bits) == x @ y.T).all()
