"""Hard negatives against brute force over whole numbers: ties, repeats, huge components, short vectors, a label with most of the rows."""

import math
import random

import numpy as np
import pytest

from emberlattice.llm import hard_negatives as module
from emberlattice.llm.hard_negatives import bias_of, exact_scores, field_bytes, hard_negatives, packed, weight_of

SCHEMA = "vec_id long, embedding array<double>, label int, v int, anchor string, part int, block int"


def brute(rows, n_pos=5, n_neg=10):
    taking = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * x) for x in v)
        taking.add((i, (label + 1) % 10 if i % 7 == 0 else label, whole))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in sorted(taking):
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, other) for j, other, w in taking if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:n_pos]:
            fit = [(t, j) for t, j, other in scored if other != label and -30 * s <= -100 * t <= -90 * s][:n_neg]
            out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(fit, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 2, 3) for i, v, label in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    for name, small in (("FIELDS", 32), ("ANCHORS", 3), ("BLOCKS", 2)):
        monkeypatch.setattr(module, name, small)
    rows = [(i, [rng.choice([0.25, 0.5, 0.75, rng.random()]) for _ in range(6)], 0 if rng.random() < 0.5 else rng.randrange(10)) for i in range(0, 700, 2)]
    rows += [rows[50], rows[50], (rows[3][0], rows[4][1], 3), (900, [0.5] * 6, 1), (900, [0.25] * 6, 2), (900, [0.5] * 6, 1)]
    rows += [(None, [0.5] * 6, 1), (701, None, 1), (703, [0.5] * 6, None), (705, [0.5, None], 1), (707, [0.5, float("nan")], 1), (709, [float("inf")], 1), (800, [], 4), (711, [0.9], 4)]
    want = brute(rows)
    assert len(want) > 100
    assert got(hard_negatives(frame(spark, rows), "vec_id % 100 = 0")) == want


def test_large_components_and_negative_scores(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**rng.randrange(0, 20) for _ in range(5)], rng.randrange(3)) for i in range(0, 1000, 10)]
    assert got(hard_negatives(frame(spark, rows), "vec_id % 100 = 0")) == brute(rows) != []
    with pytest.raises(Exception, match="too large"):
        hard_negatives(frame(spark, [(100, [1e300], 1), (200, [1.0], 1)]), "vec_id % 100 = 0").collect()


def test_no_rows_and_no_anchors(spark):
    assert got(hard_negatives(frame(spark, []), "vec_id % 100 = 0")) == []
    assert got(hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]), "vec_id % 100 = 0")) == []
    assert got(hard_negatives(frame(spark, [(100, [1.0], 1)]), "vec_id % 100 = 0")) == []


@pytest.mark.parametrize("bits", [3, 9, 20, 31, 45, 58])
def test_fields_are_exact_at_their_bounds(bits):
    top = 1 << bits
    x = np.array([[top, -top, top], [-top, -top, -top], [0, 1, -1], [top - 1, 1 - top, 0]], dtype=np.int64)
    for anchor in ([1, -1, 1], [-3, -3, -3], [7, 0, -7], [0, 0, 0], [3]):
        width = field_bytes(bias_of(x), weight_of(np.array([anchor])))
        want = [sum(a * int(b) for a, b in zip(anchor, row)) for row in x]
        assert exact_scores(anchor, packed(x, bias_of(x), width), len(x), bias_of(x), width).tolist() == want
