"""The robust fit of the quality rules against a search of all subsets, and its shrinkage."""

import itertools

import numpy as np
import pytest

from logspark.llm import quality

NAMES = list(quality.FEATURES)
FLOORS = np.array(list(quality.FEATURES.values()))


def best_subset(x, keep):
    """Mean and covariance of the subset of least determinant, of all subsets of so many rows; floors are added to variances."""
    best = None
    for rows in itertools.combinations(range(len(x)), keep):
        part = x[list(rows)]
        cov = np.cov(part.T, bias=True) + np.diag(FLOORS**2)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = (det, part.mean(axis=0), cov)
    return best[1:]


def distances(x, mean, cov):
    d2 = np.einsum("ij,ij->i", x - mean, np.linalg.solve(cov, (x - mean).T).T)
    middle = np.sort(d2)[-(-len(d2) // 2) - 1]
    return d2 / max(middle / quality.chi2_quantile(0.5), 1.0)


def stats(spark, rows):
    return spark.createDataFrame([(s, l, i, *map(float, x)) for i, (l, s, x) in enumerate(rows)], "group_source string, group_lang string, doc_id long, " + ", ".join(f"{n} double" for n in NAMES))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fit_finds_the_least_determinant(spark, seed):
    """One group: its fit, its language's and that of all rows are the same, so shrinkage changes nothing."""
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(4, 4))
    x = rng.normal(size=(12, 4)) @ mix + 5
    x = np.concatenate([x, x[:3] + rng.choice([-1, 1], size=(3, 4)) * 40])
    got = quality.outliers(stats(spark, [("en", "a", r) for r in x])).orderBy("doc_id").collect()
    want = distances(x, *best_subset(x, 12))
    assert np.allclose([r["d2"] for r in got], want, rtol=1e-6)
    assert [r["d2"] > quality.CUTOFF for r in got] == [False] * 12 + [True] * 3


def test_small_groups_are_drawn_to_wider_fits(spark):
    """The weight of a group's own fit grows with its rows, without a step; a lone row is judged by the others."""
    rng = np.random.default_rng(7)
    wide = [("en", "big", x) for x in rng.normal(size=(400, 4))]
    own = [("en", f"g{n}", rng.normal(size=4) * 0.1 + 6) for n in (1, 19, 20, 21, 60) for _ in range(n)]
    rows = [*wide, *own, ("fr", "alone", np.zeros(4)), ("fr", "odd", np.full(4, 300.0))]
    got = quality.outliers(stats(spark, rows)).collect()
    middle = {s: np.median([r["d2"] for r in got if r["group_source"] == s]) for s in ("g1", "g19", "g20", "g21", "g60", "alone")}
    assert middle["g1"] > middle["g19"] > middle["g20"] > middle["g21"] > middle["g60"] and middle["g21"] > 0.85 * middle["g19"]
    assert middle["alone"] < quality.CUTOFF and len(got) == len(rows)
