"""Operator 6's classifier: verdicts are never turned round, however few or well apart the labels are."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import quality
from leadloom.llm import queries as registered


def verdicts(model, rows, bits):
    z = np.array([(model[c] * v).sum() for c, v in rows]) + model[-3]
    return 1 / (1 + np.exp(-np.clip(model[-2] * z + model[-1], -30, 30))) >= 0.5


def corpus(seed, n_good, n_bad):
    """Sparse rows of prose, and of the same prose with marks on each word."""
    own = random.Random(seed)
    words = ["".join(own.choice("abcdeéß") for _ in range(own.randint(1, 8))) for _ in range(250)]
    prose = lambda n: " ".join(own.choice(words) for _ in range(n))
    texts = [". ".join(prose(12) for _ in range(8)) for _ in range(n_good)] + [" ".join(f"{w}###" for w in prose(90).split()) for _ in range(n_bad)]
    return [quality.sparse(t, 12, 4) for t in texts], np.array([True] * n_good + [False] * n_bad)


@pytest.mark.parametrize(("n_good", "n_bad"), [(80, 40), (30, 3), (5, 60), (40, 1), (1, 1)])
def test_verdicts_over_seeds(n_good, n_bad):
    for seed in range(40):
        rows, good = corpus(seed, n_good + 20, n_bad + 20)
        known = np.r_[0:n_good, n_good + 20 : n_good + 20 + n_bad]
        model = quality.trained([rows[i] for i in known], good[known], np.random.default_rng(seed).permutation(len(known)), 12)
        left = np.setdiff1d(np.arange(len(good)), known)
        got = verdicts(model, [rows[i] for i in left], 12)
        assert model[-2] >= 0 and (got == good[left]).mean() >= (0.9 if min(n_good, n_bad) > 1 else 0.5), seed


def test_calibration_is_a_minimum_and_never_turns():
    rng = np.random.default_rng(3)
    for _ in range(300):
        z, y = rng.normal(0, 10 ** rng.uniform(-4, 4), 60), rng.random(60) < 0.5
        if y.all() or not y.any():
            continue
        z = z + rng.choice([0, 1, 30, -3]) * z.std() * y  # from no to full separation, and the wrong way
        slope, offset = quality.calibrated(z, y)
        assert slope >= 0 and np.isfinite([slope, offset]).all()
        if slope:
            target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
            p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -500, 500)))
            assert abs((p - target).sum()) < 0.1 and abs(((p - target) * (z - np.median(z)) / z.std()).sum()) < 0.1
        elif z[y].mean() > z[~y].mean():
            assert z[y].mean() - z[~y].mean() < z.std()  # only a margin that tells next to nothing has no say


def test_a_fifth_of_each_kind_is_set_aside():
    good = np.array([True] * 100 + [False] * 60)
    held = quality.set_aside(good, np.arange(160))
    assert held[:100].sum() == 20 and held[100:].sum() == 12
    assert not quality.set_aside(good[:110], np.arange(110)).any()  # two bad rows only


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query_keeps_the_good(spark, sf):
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").where("quality IS NOT NULL")
    found = registered.op6_quality(spark, f"/root/testdata/{sf}").where("NOT base_failed").join(labels, "doc_id")
    right = dict(found.groupBy("quality").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).collect())
    print(sf, right)
    assert right[1] >= 0.95 and right[0] >= 0.9
