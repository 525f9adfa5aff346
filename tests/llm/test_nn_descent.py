import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import nn_descent as N
from storelens.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def want(rows, threshold=N.THRESHOLD):
    """n_links and component of every vector by comparing all with all."""
    usable = [k for k, (_, v, y) in enumerate(rows) if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    for a in usable:
        for b in usable:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.asarray(rows[k][1], np.float32).astype(np.float64) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].append(b)
    component = {}
    for k in sorted(links, key=lambda k: rows[k][0]):
        if k not in component:
            todo = [k]
            while todo:
                i = todo.pop()
                if i not in component:
                    component[i] = rows[k][0]
                    todo += links[i]
    return {rows[k][0]: (len(links[k]), component[k]) for k in links}


def check(spark, ws, rows, **options):
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), workspace=ws, **options).collect()
    assert len(got) == len(rows)
    expected = want(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def clusters(rng, sizes, dim=32, spread=0.05, labels=3):
    rows = []
    for size in sizes:
        centre, label = rng.normal(size=dim), int(rng.integers(labels))
        rows += [((centre + spread * rng.normal(size=dim)).astype(np.float32).tolist(), label) for _ in range(size)]
    rng.shuffle(rows)
    return [(k, v, y) for k, (v, y) in enumerate(rows)]


def test_groups_of_many_sizes(spark, ws):
    check(spark, ws, clusters(np.random.default_rng(1), [1] * 300 + [2] * 20 + [5] * 5 + [40, 90]))


def test_a_group_larger_than_a_block(spark, ws, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 30)
    check(spark, ws, clusters(np.random.default_rng(2), [1] * 50 + [150], labels=1))


def twins(rng, size, inside=0.99, across=0.95, dim=64):
    """Two groups; cosine ``inside`` each and ``across`` between them."""
    a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    turn = across / inside
    b = turn * a + np.sqrt(1 - turn * turn) * b
    noise = rng.normal(size=(2 * size, dim))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    v = np.sqrt(inside) * np.repeat([a, b], size, axis=0) + np.sqrt(1 - inside) * noise
    return [(k, x.astype(np.float32).tolist(), 0) for k, x in enumerate(v)]


@pytest.mark.parametrize("ties", [True, False])
def test_full_lists_do_not_part_linked_groups(spark, ws, monkeypatch, ties):
    if not ties:
        monkeypatch.setattr(N, "_between", lambda members, threshold, ws: spark.createDataFrame([], "a long, b long"))
    check(spark, ws, twins(np.random.default_rng(4), 200))


def test_saturated_components_are_compared_with_each_other(spark, ws, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 30)
    nodes = ws.keep(N.nodes_of(spark.createDataFrame([*twins(np.random.default_rng(4), 40), *((80 + k, v, 0) for k, v, _ in twins(np.random.default_rng(5), 40))], SCHEMA), ws))
    comp = F.floor(F.col("least") / 40)
    got = N._between(nodes.withColumn("comp", comp), N.THRESHOLD, ws)
    side = nodes.select(F.col("node"), comp.alias("c"))
    pairs = got.join(side.toDF("a", "ca"), "a").join(side.toDF("b", "cb"), "b").select(F.least("ca", "cb"), F.greatest("ca", "cb")).distinct().collect()
    assert {tuple(r) for r in pairs} == {(0, 1), (2, 3)}


def test_edge_cases(spark, ws):
    v = [1.0, 2.0, 3.0]
    rows = [
        (0, v, 1), (1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1),
        (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1), (10, [1.0, float("inf"), 3.0], 1), (11, [1e38, 2e38, 3e38], 1), (12, [1e-40, 2e-40, 3e-40], 1),
        (13, [1.0, 2.0], 1), (14, [1.0, 2.0], 1), (15, [-1.0, -2.0, -3.0], 1), (16, [3.0, 2.0, 1.0], 1), (17, v, 2), (18, v, 2),
    ]
    check(spark, ws, rows)


def test_repeated_rows_null_ids_and_empty_table(spark, ws):
    v = [1.0, 2.0]
    frame = spark.createDataFrame([(1, v, 1), (1, v, 1), (None, v, 1), (None, [5.0, -1.0], 1), (2, v, 1)], SCHEMA).withColumn("node", F.lit(0)).withColumn("times", F.lit("x"))
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in N.near_duplicates(frame, workspace=ws).collect())
    assert got == [("1", 3, "1", True), ("1", 3, "1", True), ("2", 3, "1", False), ("None", 0, "None", True), ("None", 3, "1", False)]
    assert N.near_duplicates(frame.limit(0), workspace=ws).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_test_data(spark, ws, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, f"/root/testdata/{sf}", "embeddings").collect()]
    check(spark, ws, rows)


def test_audit_counts_missing_links(spark, ws):
    rows = clusters(np.random.default_rng(3), [1] * 10 + [6] * 5, labels=1)
    nodes = N.nodes_of(spark.createDataFrame(rows, SCHEMA), ws)
    assert N.audit(nodes, spark.createDataFrame([], "node long, links long"), N.THRESHOLD) == 0.0


def test_audit_looks_until_it_has_seen_small_groups(spark, ws, monkeypatch):
    # A large group that is whole, and a few pairs that are all missed.
    rows = clusters(np.random.default_rng(6), [1] * 300 + [200] + [2] * 12, labels=1)
    nodes = N.nodes_of(spark.createDataFrame(rows, SCHEMA), ws)
    true = {i: n for i, (n, _) in want(rows).items()}
    whole = spark.createDataFrame([(i, n) for i, n in true.items() if n > 100], "least long, links long")
    links = ws.keep(nodes.join(whole, "least").select("node", "links"))
    assert N.audit(nodes, links, N.THRESHOLD, 16) == 0.0
    # No evidence is no pass.
    monkeypatch.setattr(N, "AUDIT_MOST", 16)
    assert N.audit(nodes, links, N.THRESHOLD, 16) is None


def test_longer_hashes_get_more_tables(spark):
    nodes = lambda n: spark.range(n).select(F.lit(1).alias("label"), F.lit(8).alias("dim"))
    assert [N.tables_for(nodes(n), N.TABLES, N.THRESHOLD) for n in (0, 16, 10_000, 1_000_000)] == [4, 4, 8, 17]


def test_a_forest_joins_what_links_join():
    rng = np.random.default_rng(8)
    for share in (0.0, 0.01, 0.05, 0.5):
        near = np.triu(rng.random((60, 60)) < share, 1)
        near |= near.T
        a, b = N._forest(near)
        assert near[a, b].all()
        reach = lambda m: np.linalg.matrix_power((m | np.eye(60, dtype=bool)).astype(float), 60) > 0
        tree = np.zeros_like(near)
        tree[a, b] = tree[b, a] = True
        assert (reach(tree) == reach(near)).all()
        # A forest: as many edges as vectors less components.
        assert len(a) == 60 - len({tuple(r) for r in reach(near)})


@pytest.mark.parametrize("audited", [0.5, None])
def test_labels_are_compared_whole_where_lists_fall_short(spark, ws, monkeypatch, audited):
    monkeypatch.setattr(N, "audit", lambda *_: audited)
    monkeypatch.setattr(N, "ENLARGEMENTS", 0)
    # Lists that find nothing at all.
    empty = lambda *_: (spark.createDataFrame([], "src long, dst long, sim float"), spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(N, "descend", empty)
    monkeypatch.setattr(N, "BLOCK", 30)
    rows = clusters(np.random.default_rng(9), [1] * 60 + [2] * 20 + [5] * 5 + [90])
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(20)]
    check(spark, ws, rows)
    short = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), exact=False, workspace=ws).collect()
    assert {r["audited_recall"] for r in short} == {audited}
    assert sum(r["n_links"] for r in short) < sum(n for n, _ in want(rows).values())
