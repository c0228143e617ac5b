from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ramplake.operators import joins, match


def intervals(rng, n, prefix, span=300):
    start = rng.integers(0, span, n)
    length = np.where(rng.random(n) < 0.05, 200, rng.integers(1, 40, n))
    return pd.DataFrame({"unit": "u", "id": [f"{prefix}{i:03d}" for i in range(n)], "start": start, "end": start + length})


def iou(a, b):
    ov = min(a.end, b.end) - max(a.start, b.start)
    return ov / (a.end - a.start + b.end - b.start - ov) if ov > 0 else 0.0


@pytest.fixture(scope="module")
def sides():
    rng = np.random.default_rng(8)
    return intervals(rng, 60, "a"), intervals(rng, 70, "b")


@pytest.mark.parametrize("cutoff", [0.2, 0.5])
def test_overlap_and_greedy(spark, sides, cutoff):
    left, right = sides
    edges = [(-iou(a, b), abs(a.start - b.start), a.id, b.id) for a in left.itertuples() for b in right.itertuples() if iou(a, b) >= cutoff]
    L, R = spark.createDataFrame(left), spark.createDataFrame(right)
    got = {(r.a_id, r.b_id) for r in joins.overlap_scores(L, R, ["unit"], cutoff).collect()}
    assert got == {(a, b) for *_, a, b in edges}
    used, want = set(), set()
    for _, _, a, b in sorted(edges):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r.a_id, r.b_id) for r in match.match_greedy(L, R, ["unit"], cutoff).collect()} == want


def test_containment(spark, sides):
    left, right = sides
    want = {(a.id, b.id) for a in left.itertuples() for b in right.itertuples()
            if (min(a.end, b.end) - max(a.start, b.start)) / min(a.end - a.start, b.end - b.start) >= 0.8}
    got = joins.overlap_scores(spark.createDataFrame(left), spark.createDataFrame(right), ["unit"], 0.8, "containment")
    assert {(r.a_id, r.b_id) for r in got.collect()} == want


def test_components_of_a_long_chain(spark):
    n = 40
    left = pd.DataFrame({"unit": "u", "id": [f"a{i:02d}" for i in range(n)], "start": [20 * i for i in range(n)], "end": [20 * i + 12 for i in range(n)]})
    right = pd.DataFrame({"unit": "u", "id": [f"b{i:02d}" for i in range(n)], "start": [20 * i + 10 for i in range(n)], "end": [20 * i + 22 for i in range(n)]})
    edges = joins.overlap_scores(spark.createDataFrame(left), spark.createDataFrame(right), ["unit"], 0.05)
    table = match.component_table(edges, ["unit"]).collect()
    assert len(table) == 1 and len(table[0].left_ids) == n and table[0].start == 0 and table[0].end == 20 * (n - 1) + 22


def test_maximum_total(spark, sides):
    left, right = (s.head(25) for s in sides)
    out = match.match_maximum(spark.createDataFrame(left), spark.createDataFrame(right), ["unit"], 0.1).toPandas()
    assert out["a_id"].is_unique and out["b_id"].is_unique
    reward = np.array([[iou(a, b) if iou(a, b) >= 0.1 else 0 for b in right.itertuples()] for a in left.itertuples()])
    assert out["iou"].sum() == pytest.approx(sum(reward[i, j] for i, j in match.assign(reward)))


def test_maximum_total_many_components_a_call(spark, monkeypatch):
    """components of one edge, and several larger ones in one call of the solver"""
    monkeypatch.setattr(match, "EDGES_AT_ONCE", 8)
    left, right, want = [], [], set()
    for k in range(40):
        at = 100.0 * k
        left.append((k % 3, f"a{k}", at, at + 10))
        right.append((k % 3, f"b{k}", at + 1, at + 10))
        want.add((f"a{k}", f"b{k}"))
        if k % 2:
            right.append((k % 3, f"c{k}", at, at + 5))  # lesser overlap with the same one
        if k % 4 == 3:
            left.append((k % 3, f"d{k}", at, at + 4))
            want.add((f"d{k}", f"c{k}"))
    names = "unit int, id string, start double, end double"
    out = match.match_maximum(spark.createDataFrame(left, names), spark.createDataFrame(right, names), ["unit"], 0.3)
    assert sorted((r.a_id, r.b_id) for r in out.collect()) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_by_enumeration(n, m, random):
    reward = np.array([[random.random() if random.random() < 0.6 else 0.0 for _ in range(m)] for _ in range(n)])
    slots = list(range(m)) + [None] * n
    best = max(sum(reward[i, j] for i, j in enumerate(p) if j is not None) for p in set(permutations(slots, n)))
    assert sum(reward[i, j] for i, j in match.assign(reward)) == pytest.approx(best)


@pytest.mark.parametrize("cells,nmi,ari", [([(0, 0, 5.0), (1, 1, 5.0)], 1.0, 1.0), ([(0, 0, 4.0), (0, 1, 4.0), (1, 0, 4.0), (1, 1, 4.0)], 0.0, None), ([(0, 0, 9.0)], None, None)])
def test_agreement(spark, cells, nmi, ari):
    row = match.agreement(spark.createDataFrame(cells, "a int, b int, n double"), []).first()
    assert row.nmi is None if nmi is None else row.nmi == pytest.approx(nmi, abs=1e-9)
    if ari is not None:
        assert row.ari == pytest.approx(ari)
    assert row.informative == (len(cells) > 1)


@pytest.mark.parametrize("metric", ["haversine", "planar"])
def test_nearest_units(spark, metric):
    rng = np.random.default_rng(12)
    pts = np.r_[rng.normal([30, 110], 0.01, (60, 2)), rng.uniform([28, 105], [33, 116], (25, 2))]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(pts)), "lat": pts[:, 0], "lon": pts[:, 1]}))
    p = np.radians(pts)
    h = np.sin((p[:, None, 0] - p[None, :, 0]) / 2) ** 2 + np.cos(p[:, None, 0]) * np.cos(p[None, :, 0]) * np.sin((p[:, None, 1] - p[None, :, 1]) / 2) ** 2
    d = 2 * 6371000 * np.arcsin(np.sqrt(h)) if metric == "haversine" else np.hypot(pts[:, None, 0] - pts[None, :, 0], pts[:, None, 1] - pts[None, :, 1])
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(pts)) for j in np.argsort(d[i])[:4]}
    assert {(r.src, r.dst) for r in joins.nearest_units(df, 4, metric).collect()} == want
