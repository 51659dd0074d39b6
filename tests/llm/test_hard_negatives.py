"""Hard negatives against all pairs: nulls, ties, repeats, zero vectors, clashing names, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechjobs.llm import hard_negatives as hn
from speechjobs.llm.hard_negatives import LengthBuckets, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=10, positives=5, negatives=10):
    good = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, y, v in good:
        if i % every:
            continue
        pool = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in good if j != i and len(w) == len(v))
        for s, j, _ in [p for p in pool if p[2] == y][:positives]:
            fits = [(t, k) for t, k, z in pool if z != y and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fits)]
    return sorted(out)


def clustered(n, dims, seed, labels=4):
    """Vectors around a few directions, of very different lengths."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    found = centres[rng.integers(6, size=n)] + rng.normal(size=(n, dims)) * 0.15
    return [(i, (v * 2.0 ** rng.integers(-6, 1)).tolist(), int(y)) for i, (v, y) in enumerate(zip(found, rng.integers(labels, size=n), strict=True))]


@pytest.mark.parametrize(("block", "bucket", "asked"), [(10_000, 2048, 4096), (40, 16, 7), (60, 64, 1000)])
def test_equals_all_pairs(spark, monkeypatch, block, bucket, asked):
    rng = np.random.default_rng(1)
    rows = clustered(260, 5, 2)
    rows += [(300 + k, rng.integers(-2, 3, 5).astype(float).tolist(), k % 3) for k in range(80)]  # many ties
    rows += [(400, [0.0] * 5, 1), (401, [0.0] * 5, 2), (410, None, 1), (420, [1.0] * 5, None), (None, [1.0] * 5, 1), (430, [1.0, None, 1.0, 1.0, 1.0], 1), (431, [float("nan")] * 5, 1), (440, [1.0, 2.0], 1), (441, [2.0, 2.0], 1), (442, [1.0, 1.5], 2)]
    rows += [rows[20], rows[20], (30, [1.0] * 5, 2), (450, [-0.0] * 5, 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "embedding", "label", "1 as part", "2 as dims", "'x' as id", "map(1, 2) as class")
    monkeypatch.setattr(hn, "BUCKET", bucket)
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, block_rows=block, block_queries=asked)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_few_rows(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, [-1.0, -1.0], 2)]):
        got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
        assert sorted(map(tuple, got.collect())) == plain(rows)


def test_focus_ranges_prune(monkeypatch):
    """On vectors near a few directions the lists leave few candidates, and lose none."""
    rows = clustered(6000, 32, 3)
    ids, labels, vectors = (np.array([r[k] for r in rows]) for k in (0, 2, 1))
    vectors = np.floor(256 * vectors)
    held = LengthBuckets.of(ids.astype(np.int64), labels.astype(np.int64), vectors)
    held = LengthBuckets.unpacked(32, *held.packed().values())
    scored = []
    plainly = LengthBuckets._some
    monkeypatch.setattr(LengthBuckets, "_some", lambda self, *a: scored.append(1) or plainly(self, *a))
    q = vectors[:50]
    scores = q @ vectors.T
    kth = np.array([np.sort(np.where((labels == labels[i]) & (ids != i), scores[i], -np.inf))[-5] for i in range(50)])
    asked = {"vector": q, "label": labels[:50], "id": ids[:50], "low": np.full(50, -np.inf), "high": np.full(50, np.inf), "least": kth}
    which, found, score = held.search(asked, 5, True)
    for i in range(50):
        best = sorted((-s, j) for j, s in enumerate(scores[i].tolist()) if labels[j] == labels[i] and j != i)[:5]
        assert [(-s, j) for s, j in zip(score[which == i].tolist(), found[which == i].tolist(), strict=True)] == best
    assert scored
