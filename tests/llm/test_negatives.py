"""Hard negatives against one sort of all scores, with ties, awkward rows and small blocks."""

import math
import random

import pytest

from tracelens.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string"


def vectors(n=330, seed=5):
    rng = random.Random(seed)
    grid = lambda: [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.75]) for _ in range(4)]
    common = grid()
    return [(i, common if i % 3 == 0 else grid(), rng.choice([0, 0, 0, 1, 2]), "x") for i in range(n)]


def plain(rows, every=100, positives=5, negatives=10, low=30, high=90):
    good = [(i, [math.floor(256 * x) for x in v], c) for i, v, c, *_ in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, c in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, d) for j, w, d in good if j != i)
        for s, p, _ in [x for x in scored if x[2] == c][:positives]:
            found = [(j, -t) for t, j, d in scored if d != c and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, r + 1, p, j, -s, t) for r, (j, t) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [None, 50])
def test_against_one_sort(spark, block):
    rows = vectors()
    got = sorted(map(tuple, N.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=20, block=block).collect()))
    assert got == plain(rows, every=20) and got


def test_awkward_rows(spark):
    rows = vectors(60) + [(100, None, 1, "x"), (200, [1.0, None, 0.0, 0.0], 1, "x"), (300, [float("nan")] * 4, 1, "x"), (400, [float("inf")] * 4, 1, "x"), (500, [0.5] * 4, None, "x"), (None, [0.5] * 4, 1, "x"), (600, [0.5] * 4, 9, "x"), (700, [0.75, 0.25], 0, "x")]
    got = sorted(map(tuple, N.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=10).collect()))
    assert got == plain([r if r[0] != 700 else (700, [0.75, 0.25, 0.0, 0.0], 0, "x") for r in rows], every=10)
    assert not {200, 300, 400, 500} & {r[0] for r in got} and 600 not in {r[0] for r in got}
    assert N.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert N.hard_negatives(spark.createDataFrame([(1, [1.0], 1, "x")], SCHEMA)).collect() == []
    twice = spark.createDataFrame(rows + rows, SCHEMA)
    assert sorted(map(tuple, N.hard_negatives(twice, every=10).collect())) == got


def test_limits_are_exact():
    for s in [*range(-40, 41), 2**62, -(2**62), 2**63 - 1]:
        least, largest = N.limits(s)
        assert 30 * s <= 100 * least < 30 * s + 100 and 90 * s - 100 < 100 * largest <= 90 * s
