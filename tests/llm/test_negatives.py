import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import negatives as m
from storelens.llm.common import table

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, positives=5, negatives=5):
    """(anchor, positive, rank, negative, positive score, negative score) by comparing all with all."""
    usable = [(k, i, [int(np.floor(256.0 * float(np.float32(c)))) for c in v], label) for k, (i, v, label) in enumerate(rows) if v is not None and label is not None and all(c is not None and np.isfinite(c) for c in v)]
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for k, i, x, label in usable:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=True)), j, other == label) for n, j, y, other in usable if n != k and len(x) == len(y)]
        for score, j, _ in sorted([p for p in scored if p[2]], key=order)[:positives]:
            fits = sorted([p for p in scored if not p[2] and 80 * score <= 100 * p[0] <= 100 * score], key=order)[:negatives]
            out += [(i, j, rank, p[1], score, p[0]) for rank, p in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(df, **options):
    rows = m.mine(df, F.col("vec_id") % 100 == 0, **options).collect()
    return sorted([(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows], key=str)


def clustered(rng, n, d, spread):
    centres = rng.normal(size=(6, d))
    v = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize(("d", "spread"), [(1, 1.0), (3, 1.0), (24, 0.3), (64, 0.2), (70, 0.6)])
def test_bounds_hold_and_get_closer(d, spread):
    rng = np.random.default_rng(d)
    x = np.floor(256 * clustered(rng, 80, d, spread)).astype(np.int64)
    mean, dev = m.summaries(x)
    block = m.Block(np.arange(80), np.arange(80), np.zeros(80, bool), np.zeros(80), x, mean, dev)
    exact = x @ x.T
    width = []
    for level in range(len(block.levels)):
        upper, lower = m.bounds(block, block, level)
        assert (lower <= exact).all() and (exact <= upper).all()
        i, j = np.nonzero(exact > 0)
        assert np.allclose(m.bounds(block, block, level, i, j)[0], upper[i, j])
        width.append((upper - lower).mean())
    assert width == sorted(width, reverse=True) and (d < 4 or width[-1] < width[0])
    assert [len(w) for w, _, _ in block.levels][-1] == min(d, 16)


@pytest.mark.parametrize(("spread", "block", "slice_rows"), [(0.05, 3, 100), (0.3, 4096, 2**20), (2.0, 2, 50)])
def test_against_all_pairs(spark, ws, spread, block, slice_rows):
    rng = np.random.default_rng(int(spread * 100))
    v = clustered(rng, 700, 20, spread)
    rows = [(int(i) * 10, v[i].tolist(), int(rng.integers(0, 3))) for i in range(700)]
    rows[::3] = [(i, x, 0) for i, x, _ in rows[::3]]  # a hot label
    found = mined(spark.createDataFrame(rows, VECTORS).repartition(5), block=block, slice_rows=slice_rows, workspace=ws)
    assert found == plain(rows) and (found or spread > 1)


def test_odd_rows_ties_and_clashing_names(spark, ws):
    rng = np.random.default_rng(8)
    v = np.round(clustered(rng, 60, 6, 0.4), 1)  # coarse, so that scores tie
    rows = [(i * 50, v[i].tolist(), i % 2) for i in range(60)]
    rows += [rows[0], rows[0], rows[3], (None, v[5].tolist(), 1), (None, v[5].tolist(), 0)]  # repeated rows, null ids
    rows += [(5000, None, 1), (5100, [1.0, None] * 3, 1), (5200, [float("inf")] * 6, 1), (5300, v[1].tolist(), None), (5400, [], 1), (5401, [], 0)]
    rows += [(6000, [0.5, 0.5], 1), (6001, [0.5, 0.4], 1), (6002, [0.5, 0.38], 0)]  # another length
    df = spark.createDataFrame(rows, VECTORS).withColumns({"row": F.lit("a"), "x": F.lit(1), "anchor": F.lit(True), "score": F.lit(0)})
    found = mined(df, workspace=ws)
    assert found == plain(rows)
    assert (6000, 6001, 1, 6002) in {r[:4] for r in found} and any(r[3] is None for r in found) and any(r[0] == r[1] for r in found)


def test_no_rows_no_anchors_no_partners(spark, ws):
    v = [0.1, 0.2]
    for rows in ([], [(1, v, 1), (2, v, 1)], [(100, v, 1), (1, v, 2)], [(100, v, 1), (1, v, 1)], [(100, [0.5, 0.1], 1), (1, [-0.5, 0.0], 1), (2, [-0.5, 0.0], 2)]):
        assert mined(spark.createDataFrame(rows, VECTORS), workspace=ws) == []


def test_fewer_pairs_are_scored_than_exist(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.floor(256 * np.sort(clustered(rng, 400, 64, 0.1), axis=1)).astype(np.int64)
    mean, dev = m.summaries(x)
    label = rng.integers(0, 4, 400)
    block = m.Block(np.arange(400), np.arange(400), np.zeros(400, bool), label, x, mean, dev)
    scored = []
    plain_exact = m.exact
    monkeypatch.setattr(m, "exact", lambda a, b, i, j: scored.append(len(i)) or plain_exact(a, b, i, j))
    search = m.Positives(block, None, 5)
    for lo in range(0, 400, 40):
        search.look(block, block.part(lo, lo + 40))
    assert sum(scored) < 0.6 * (label[:, None] == label).sum()


def test_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert mined(df) == plain(rows)
