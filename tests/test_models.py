import numpy as np
import pytest
from builders import one, rows_of
from pyspark.sql import functions as F

from storelens.models import clusters, curves, risk
from storelens.models import features as feats
from storelens.models import forest as forests
from storelens.operators.mart import order_mart
from storelens.session import materialize


@pytest.fixture(scope="module")
def split(star):
    rows = feats.features(order_mart(star, "2001-08-01", feats.features.columns))
    return materialize(feats.stratified_split(rows))


@pytest.fixture(scope="module")
def train(split):
    return split.filter("is_train = 1")


@pytest.fixture(scope="module")
def test_rows(split):
    return split.filter("is_train = 0")


@pytest.fixture(scope="module")
def forest(train):
    encoding = risk.Encoding.learn(train)
    return risk.fit_rf(train, encoding, {"numTrees": 25, "maxDepth": 6}), encoding


def test_split_is_exact_per_label_and_repeatable(star, split):
    counts = {(x["is_low_review"], x["is_train"]): x["orders"] for x in feats.split_counts(split).collect()}
    for label in (0, 1):
        size = counts[label, 0] + counts[label, 1]
        assert counts[label, 1] == int(size * 0.8)
    folds = [x["count"] for x in split.groupBy("is_low_review", "fold").count().collect()]
    assert len(folds) == 6
    rows = feats.features(order_mart(star, "2001-08-01", feats.features.columns))
    again = feats.stratified_split(rows, buckets=1)
    assert again.exceptAll(split).count() == 0


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 7, "is_low_review int")
    weights = {x["is_low_review"]: x["weight"] for x in feats.class_weights(df).collect()}
    assert weights == {1: pytest.approx(10 / 6), 0: pytest.approx(10 / 14)}
    assert {round(x["weight"], 6) for x in feats.with_weights(df).collect()} == {round(10 / 6, 6), round(10 / 14, 6)}


def test_unreviewed_orders_can_count_as_negative(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "is_low_review int")
    assert sum(x["orders"] for x in feats.class_balance(df).collect()) == 2
    assert dict(rows_of(feats.class_balance(df, "negative"), "is_low_review", "orders")) == {0: 2, 1: 1}


def test_encoding_drops_the_first_level_and_ignores_unseen_values(spark):
    rows = [("a", "card"), ("b", "cash"), ("x.y", "card"), ("x_y", "cash"), ("new", "pix"), (None, None)]
    df = spark.createDataFrame(rows, f"{feats.CATEGORY} string, payment_type string")
    encoding = risk.Encoding(("a", "b", "x.y", "x_y"), ("a", "b", "x.y", "x_y"), ("card", "cash"))
    names = [i.name for i in encoding.indicators()]
    # Levels that differ in a punctuation mark only have indicators of their own.
    assert len(set(names)) == 4
    assert [i.label for i in encoding.indicators()] == ["category_grouped_b", "category_grouped_x.y", "category_grouped_x_y", "payment_type_cash"]
    found = {r[0]: tuple(r[n] for n in names) for r in encoding.stage().transform(df).collect()}
    assert found == {"a": (0, 0, 0, 0), "b": (1, 0, 0, 1), "x.y": (0, 1, 0, 0), "x_y": (0, 0, 1, 1), "new": (0, 0, 0, 0), None: (0, 0, 0, 0)}


def test_too_many_levels_are_an_error(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("x"))
    assert len(feats.levels(df, F.col("x"), most=30)) == 30
    with pytest.raises(ValueError, match="more than 29"):
        feats.levels(df, F.col("x"), most=29)


def test_a_penalty_shrinks_coefficients(train):
    size = lambda model: sum(abs(x) for x in model.stages[-1].coefficients)
    encoding = risk.Encoding.learn(train)
    assert size(risk.fit_lr(train, encoding, strength=1000.0)) < size(risk.fit_lr(train, encoding)) < size(risk.fit_lr(train, encoding, strength=0.0)) + 1e-6


def test_kmeans_runs_to_convergence_or_fails(spark):
    rows = [(f"{i}", i * 37 % 101, i % 7, float(i * 53 % 211)) for i in range(200)]
    rfm = spark.createDataFrame(rows, "customer_unique_id string, recency_days int, frequency int, monetary double")
    assert clusters.kmeans_segments(rfm, seeds=(1,)).count() == 200
    with pytest.raises(RuntimeError, match="no convergence"):
        clusters.kmeans_segments(rfm, seeds=(1,), max_iter=1)


def test_metrics_of_known_predictions(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "is_low_review int, prediction int")
    row = one(risk.evaluate(df, "m"))
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.7, 0.75, 0.6, 0.6667)
    report = {x["class"]: x.asDict() for x in risk.class_report(df).collect()}
    assert report["0"]["precision"] == 0.6667 and report["0"]["support"] == 5
    assert report["macro avg"]["precision"] == round((2 / 3 + 0.75) / 2, 4) and report["macro avg"]["support"] == 10
    assert report["weighted avg"]["recall"] == round((0.8 * 5 + 0.6 * 5) / 10, 4)


def test_report_of_one_class_only(spark):
    df = spark.createDataFrame([(1, 0)] * 3 + [(None, 1), (1, None)], "is_low_review int, prediction int")
    report = {x["class"]: x.asDict() for x in risk.class_report(df).collect()}
    assert report["1"] == {"class": "1", "precision": None, "recall": 0.0, "f1": 0.0, "support": 3}
    assert report["0"]["support"] == 0 and report["0"]["precision"] == 0.0 and report["weighted avg"]["recall"] == 0.0
    empty = {x["class"]: x.asDict() for x in risk.class_report(df.limit(0)).collect()}
    assert set(empty) == {"0", "1", "macro avg", "weighted avg"} and empty["weighted avg"]["f1"] is None


@pytest.mark.parametrize("buckets", [1, 7])
def test_sweep_and_auc_equal_counting_pairs(spark, buckets):
    rng = np.random.default_rng(3)
    rows = [(int(rng.random() < 0.3), float(rng.integers(0, 12))) for _ in range(500)] + [(None, 1.0), (1, None)]
    df = spark.createDataFrame(rows, "y int, s double")
    known = [(y, s) for y, s in rows if y is not None and s is not None]
    pos, neg = [s for y, s in known if y == 1], [s for y, s in known if y == 0]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert curves.roc_auc(df, "y", "s", buckets) == pairs / (len(pos) * len(neg))
    for r in curves.threshold_sweep(df, "y", "s", buckets).collect():
        said = [y for y, s in known if s >= r["threshold"]]
        assert (r["predicted"], r["hits"]) == (len(said), sum(said))
        assert r["recall"] == round(sum(said) / len(pos), 4) and r["precision"] == round(sum(said) / len(said), 4)
    assert curves.roc_auc(df.filter("y = 1"), "y", "s") is None and curves.roc_auc(df.limit(0), "y", "s") is None


def test_choice_by_named_metrics(spark):
    df = spark.createDataFrame(
        [("lr", 0.584, 0.351, 0.714), ("rf", 0.5, 0.454, 0.738)], "model string, recall double, f1 double, roc_auc double"
    )
    assert one(risk.choose(df))["model"] == "rf"
    assert one(risk.choose(df, ("recall", "roc_auc")))["model"] == "lr"


def test_forest_beats_chance_and_delay_matters_most(spark, forest, test_rows):
    model, encoding = forest
    metrics = one(risk.evaluate(risk.with_probability(model, test_rows), "rf", score="probability_low"))
    assert metrics["roc_auc"] > 0.6
    names = risk.feature_names(encoding)
    top = risk.importances(model, names, spark).collect()
    assert top[0]["feature"] == "delivery_delay_days"
    assert len(names) == model.forest.features and sum(model.forest.importances()) == pytest.approx(1)


def test_logistic_models_fit_and_balancing_raises_recall(train, test_rows):
    encoding = risk.Encoding.learn(train)
    plain = one(risk.evaluate(risk.with_probability(risk.fit_lr(train), test_rows), "a"))
    balanced = one(risk.evaluate(risk.with_probability(risk.fit_lr(train, encoding, True), test_rows), "b"))
    assert balanced["recall"] > plain["recall"]


def test_saved_model_scores_identically_and_takes_unseen_categories(tmp_path, forest, test_rows):
    model, _ = forest
    path = str(tmp_path / "risk")
    risk.save_model(model, path)
    loaded = risk.load_model(path)
    assert sorted(rows_of(risk.score_orders(model, test_rows))) == sorted(rows_of(risk.score_orders(loaded, test_rows)))
    assert isinstance(loaded, risk.RiskForest) and (loaded.forest.importances() == model.forest.importances()).all()
    odd = test_rows.withColumns({feats.CATEGORY: F.lit("it's new"), "payment_type": F.lit("pix")})
    assert risk.score_orders(loaded, odd).count() == test_rows.count()


def test_quoted_category_names_are_safe(train):
    renamed = train.withColumn(
        feats.CATEGORY, F.when(F.col("order_dow_num") > 2, F.lit("o'neil \\ co.")).otherwise("plain")
    )
    encoding = risk.Encoding.learn(renamed)
    ready = encoding.stage().transform(renamed)
    name = next(i.name for i in encoding.indicators() if i.label == "category_grouped_plain")
    assert name in ready.columns
    hits = ready.agg(F.sum(F.col(f"`{name}`"))).head()[0]
    assert hits == renamed.filter("order_dow_num <= 2").count()


def test_saved_regressions_score_identically(tmp_path, train, test_rows):
    model = risk.fit_lr(train)
    risk.save_model(model, str(tmp_path / "lr"))
    loaded = risk.load_model(str(tmp_path / "lr"))
    assert sorted(rows_of(risk.score_orders(model, test_rows))) == sorted(rows_of(risk.score_orders(loaded, test_rows)))


def test_grid_search_returns_the_best_point(train):
    encoding = risk.Encoding.learn(train)
    grid = {"numTrees": (3, 5), "maxDepth": (None, 2), "minInstancesPerNode": (1, 4)}
    tuned = risk.tune_rf(train, encoding, grid)
    scores = {(x["numTrees"], x["maxDepth"], x["minInstancesPerNode"]): x["cv_recall"] for x in tuned.scores.collect()}
    assert len(scores) == 8 and scores[tuple(tuned.params.values())] == max(scores.values())
    assert len(tuned.model.forest.trees) == tuned.params["numTrees"]
    assert tuned.model.transform(train).count() == train.count()


def test_grid_scores_are_those_of_forests_fitted_alone(train):
    """The claim behind the shared growth: prefixes and cuts of one forest are the smaller forests."""
    encoding = risk.Encoding.learn(train)
    grid = {"numTrees": (3, 12), "maxDepth": (2, 5, None), "minInstancesPerNode": (1, 3)}
    found = {(x["numTrees"], x["maxDepth"], x["minInstancesPerNode"]): x["cv_recall"] for x in risk.tune_rf(train, encoding, grid).scores.collect()}
    names = ["x", "y", "fold"]
    rows = train.orderBy("order_id").select(risk.feature_array(encoding).alias("x"), F.col("is_low_review").alias("y"), "fold").collect()
    x, y, fold = (np.array([r[n] for r in rows]) for n in names)
    edges = forests.bin_edges(x)
    bins = forests.binned(x, edges)
    for (trees, depth, leaf), recall in found.items():
        recalls = []
        for out in range(3):
            rest, held = fold != out, fold == out
            alone = [forests.grow_tree(bins[rest], y[rest], edges, t, min_leaf=leaf, max_depth=depth) for t in range(trees)]
            said = forests.Forest(tuple(alone), x.shape[1]).predict(x[held]) > 0.5
            recalls.append((said & (y[held] == 1)).sum() / (y[held] == 1).sum())
        assert recall == pytest.approx(np.mean(recalls), abs=1e-12)


def test_tree_splits_are_the_best_of_all():
    """With every feature tried, the root's split is the one an exhaustive search finds."""
    rng = np.random.default_rng(4)
    x = np.round(rng.random((200, 1)) * 20)
    y = (x[:, 0] + rng.normal(size=200) * 4 > 11).astype(int)
    edges = forests.bin_edges(x)
    tree = forests.grow_tree(forests.binned(x, edges), y, edges, 0, max_depth=1)
    counts = np.bincount(np.random.default_rng([forests.SEED, 0]).integers(0, 200, 200), minlength=200)
    w = counts * np.where(y == 1, 200 / 2 / y.sum(), 200 / 2 / (200 - y.sum()))

    def impurity(mask):
        a, b = w[mask & (y == 0)].sum(), w[mask & (y == 1)].sum()
        return 2 * a * b / (a + b) if a + b else 0.0

    best = min(edges[0], key=lambda e: impurity(x[:, 0] <= e) + impurity(x[:, 0] > e))
    assert tree.threshold[0] == best and tree.feature.tolist() == [0, -1, -1]
    right = x[:, 0] > best
    assert tree.value[2] == pytest.approx(w[right & (y == 1)].sum() / w[right].sum(), rel=1e-6)


def test_leaf_size_single_class_and_no_rows():
    rng = np.random.default_rng(5)
    x, y = rng.random((300, 4)), rng.integers(0, 2, 300)
    edges = forests.bin_edges(x)
    bins = forests.binned(x, edges)
    tree = forests.grow_tree(bins, y, edges, 1, min_leaf=7)
    drawn = np.unique(np.random.default_rng([forests.SEED, 1]).integers(0, 300, 300))
    at = np.zeros(len(drawn), int)
    for _ in range(40):
        inner = tree.feature[at] >= 0
        f, row = tree.feature[at], x[drawn]
        at = np.where(inner, tree.left[at] + (row[np.arange(len(row)), np.maximum(f, 0)] > tree.threshold[at]), at)
    sizes = np.bincount(at)
    assert sizes[sizes > 0].min() >= 7
    assert len(forests.grow_tree(bins, np.ones(300, int), edges, 0).feature) == 1
    none = forests.grow_tree(np.zeros((0, 4), np.uint8), np.zeros(0, int), forests.bin_edges(x[:0]), 0)
    assert none.feature.tolist() == [-1] and none.value.tolist() == [0.0]


def test_regressions_score_after_an_observation(spark, train):
    from pyspark.sql import Observation

    seen = Observation("rows")
    train.observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert seen.get["rows"] == len(risk.score_orders(risk.fit_lr(train), train).collect())


def test_forest_scores_equal_walks_tree_by_tree():
    """Also of rows on a threshold, out of all ranges or not a number, in more than one block, and after few or no splits."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(2_000, 5)), 1)
    x[:, 3] = 1.0
    y = (x[:, 0] + rng.normal(size=len(x)) > 0).astype(int)
    edges = forests.bin_edges(x)
    trees = [forests.grow_tree(forests.binned(x, edges), y, edges, t) for t in range(6)]
    trees += [trees[0].cut(0), trees[1].cut(3)]
    rows = np.concatenate([x, rng.normal(0, 9, (forests.WALKERS, 5)), np.repeat(edges[0].astype(float), 5).reshape(-1, 5), [[np.nan] * 5, [np.inf] * 5]])
    want = sum(t.walk(rows, [None])[0] for t in trees) / len(trees)
    assert (forests.Forest(tuple(trees), 5).predict(rows) == want).all()
    assert forests.Forest((), 5).predict(rows[:3]).tolist() == [0.0] * 3 and len(forests.Forest(tuple(trees), 5).predict(rows[:0])) == 0
    walk = forests.Walk.of(trees, 5)
    assert sum(n.nbytes + v.nbytes for n, v in zip(walk.nodes, walk.values, strict=True)) == 12 * sum(len(t.feature) for t in trees)


def test_split_and_scoring_build_the_mart_once(spark, star_dir, monkeypatch):
    from storelens.plans import queries
    from storelens.session import stored

    made, plain = [], queries._mart_for
    monkeypatch.setattr(queries, "_mart_for", lambda *a, **k: made.append(a) or plain(*a, **k))
    grid, tune = {"numTrees": (2,), "maxDepth": (3,), "minInstancesPerNode": (1,)}, risk.tune_rf
    monkeypatch.setattr(risk, "tune_rf", lambda train, encoding: tune(train, encoding, grid, rows=200))
    with stored(spark):
        scored = queries.QUERIES["order_risk_scores"](spark, star_dir)
        every = queries.feats.features(plain(queries.feats.features, queries.tables(spark, star_dir)), unreviewed="negative")
        assert sorted(rows_of(scored, "order_id")) == sorted(rows_of(every, "order_id")) and len(made) == 1
        train, test = queries._split(spark, star_dir)
        alone = queries.feats.stratified_split(queries._feature_rows(queries.tables(spark, star_dir)))
        assert sorted(rows_of(train.unionByName(test))) == sorted(rows_of(alone.select(*train.columns)))


def test_bounded_training_rows(train):
    encoding = risk.Encoding.learn(train)
    small = risk.fit_rf(train, encoding, {"numTrees": 2}, rows=200)
    again = risk.fit_rf(train.repartition(7), encoding, {"numTrees": 2}, rows=200)
    assert len(small.forest.trees[0].feature) < 2 * 300
    assert all((a.threshold == b.threshold).all() for a, b in zip(small.forest.trees, again.forest.trees, strict=True))


def _many_rows(spark, n):
    """Features with many, few and two values, ids out of order that also repeat or are null."""
    x = [(F.xxhash64("id", F.lit(i)) % m).cast("double") / 4 for i, m in enumerate((10_007, 50, 12, 2))]
    noise = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(100))
    key = F.when(F.col("id") % 1000 != 7, F.pmod(F.col("id") * 7919, F.lit(n - n // 10)))
    return spark.range(n).select(
        key.alias("order_id"), F.array(*x).alias("x"), ((x[1] > 4) & (noise < 60) | (noise < 10)).cast("int").alias("y"), F.pmod(F.xxhash64("id"), F.lit(3)).cast("int").alias("fold")
    )


def _in_order(df):
    """Bins of all rows in the order in which forests read them, with edges, labels and folds."""
    rows = df.collect()
    edges = forests.bin_edges(np.array([r["x"] for r in rows]))
    bins = forests.binned(np.array([r["x"] for r in rows]), edges)
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["order_id"] is not None, rows[i]["order_id"] or 0, bytes([*bins[i], rows[i]["y"], rows[i]["fold"]])))
    return bins[order], edges, np.array([rows[i]["y"] for i in order]), np.array([rows[i]["fold"] for i in order])


def test_the_grid_learns_from_all_rows(spark):
    """More rows than the 50,000 that the search once drew."""
    df = materialize(_many_rows(spark, 64_000))
    bins, edges, y, fold = _in_order(df)
    table = forests.packed(df, F.col("x"), "y", "order_id")
    assert table.rows == 64_000 and all((a == b).all() for a, b in zip(table.edges, edges, strict=True))
    hits = materialize(forests.grid_hits(table, trees=(2, 3), depths=(None, 4), leaves=(5,), folds=3))
    # Every held-out row of label 1 is scored at each point of the grid.
    assert {r["n"] for r in hits.groupBy("trees", "depth", "leaf").agg(F.sum("rows").alias("n")).collect()} == {y.sum()}
    found = {(r["trees"], r["depth"]): r["cv_recall"] for r in forests.recalls(hits).collect()}
    for depth in (None, 4):
        alone = []
        for out in range(3):
            rest, held = fold != out, (fold == out) & (y == 1)
            trees = [forests.grow_tree(bins[rest], y[rest], [np.arange(32.0)] * 4, t, min_leaf=5, max_depth=depth) for t in range(3)]
            alone.append([np.mean(sum(t.walk(bins[held], [None])[0] for t in trees[:k]) / k > 0.5) for k in (2, 3)])
        assert [found[k, -1 if depth is None else depth] for k in (2, 3)] == pytest.approx(np.mean(alone, axis=0).tolist(), abs=1e-12)


def test_rows_drawn_and_grown_in_pieces_give_the_same_trees(monkeypatch):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(3_000, 6)), 1)
    x[:, 4:] = rng.random((3_000, 2)) < 0.1
    y = (x[:, 0] + rng.normal(size=len(x)) > 1).astype(int)
    edges = forests.bin_edges(x)
    grown = lambda: [forests.grow_tree(forests.binned(x, edges), y, edges, t, min_leaf=leaf) for t in range(3) for leaf in (1, 5)]
    want = grown()
    for name, value in {"PIECE": 50, "NODES_EACH": 7, "DRAWN": 64, "IN_MEMORY": 1000}.items():
        monkeypatch.setattr(forests, name, value)
    for a, b in zip(want, grown(), strict=True):
        assert all((getattr(a, name) == getattr(b, name)).all() for name in forests._TYPES)


def test_edges_and_folds_of_odd_tables(spark):
    """Constant, infinite and few values; a fold without rows of label 1, and one without rows."""
    rng = np.random.default_rng(12)
    x = np.stack([np.ones(400), rng.choice([0.5, 1.5, np.inf, -np.inf], 400), np.repeat(rng.random(40), 10), rng.random(400).round(2)], axis=1)
    fold, y = np.arange(400) % 2, (rng.random(400) < 0.4).astype(int)
    y[fold == 1] = 0
    df = spark.createDataFrame([(f"{i:03}", [*map(float, v)], int(k), int(f)) for i, (v, k, f) in enumerate(zip(x, y, fold, strict=True))], "id string, x array<double>, y int, fold int")
    table = forests.packed(df.repartition(3), F.col("x"), "y", "id")
    assert [e.tolist() for e in table.edges] == [e.tolist() for e in forests.bin_edges(x)]
    hits = forests.grid_hits(table, trees=(2,), depths=(None,), leaves=(1,), folds=3)
    per_fold = {r["fold"]: (r["rows"], r["hits"]) for r in hits.groupBy("fold").agg(F.sum("rows").alias("rows"), F.sum("hits").alias("hits")).collect()}
    assert per_fold == {0: (y.sum(), 0), 1: (0, 0)} and one(forests.recalls(hits))["cv_recall"] == 0.0
    none = forests.packed(df.limit(0), F.col("x"), "y", "id")
    assert none.rows == 0 and forests.grid_hits(none, trees=(2,), depths=(None,), leaves=(1,), folds=3).count() == 0 and forests.grow(none, trees=2).count() == 0


def _order_rows(spark, n):
    """Rows for the risk model: orders with a category, a payment type, numeric features and a label."""
    part = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m))
    numeric = [(part(i, 997) / 8).cast("double").alias(c) for i, c in enumerate(feats.NUMERIC_V2)]
    text = [F.concat(F.lit("c"), part(20, 3)).alias(feats.CATEGORY), F.concat(F.lit("p"), part(21, 2)).alias("payment_type")]
    return spark.range(n).select(F.col("id").alias("order_id"), *numeric, *text, ((part(4, 997) > 700) & (part(22, 4) > 0)).cast("int").alias(feats.LABEL))


def test_a_finished_forest_learns_from_all_rows(spark):
    df = materialize(_order_rows(spark, 60_000))
    encoding = risk.Encoding.learn(df)
    model = risk.fit_rf(df, encoding, {"numTrees": 2, "maxDepth": 6})
    rows = df.orderBy("order_id").select(risk.feature_array(encoding).alias("x"), feats.LABEL).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r[feats.LABEL] for r in rows])
    edges = forests.bin_edges(x)
    for t, got in enumerate(model.forest.trees):
        want = forests.grow_tree(forests.binned(x, edges), y, edges, t, max_depth=6)
        assert all((getattr(got, name) == getattr(want, name)).all() for name in forests._TYPES)


def test_a_forest_too_large_to_hold_scores_and_weighs_as_a_held_one(spark, tmp_path, monkeypatch):
    df = materialize(_order_rows(spark, 3_000))
    encoding = risk.Encoding.learn(df)
    held = risk.fit_rf(df, encoding, {"numTrees": 5})
    # Also rows that come twice, are not a number, are out of all ranges or of unknown kinds.
    odd = df.limit(4).withColumns({feats.NUMERIC_V2[0]: F.lit(float("nan")), feats.NUMERIC_V2[1]: F.lit(1e9), "payment_type": F.lit("new")})
    rows = materialize(df.unionByName(df.limit(100)).unionByName(odd).repartition(5))
    want = sorted(rows_of(held.transform(rows), "order_id", *feats.NUMERIC_V2[1:], "probability_low", "prediction"))
    monkeypatch.setattr(forests, "HELD_NODES", 10)
    monkeypatch.setattr(forests, "TASK_NODES", 1_500)
    monkeypatch.setattr(forests, "STORED_NODES", 9)
    large = risk.fit_rf(df, encoding, {"numTrees": 5})
    risk.save_model(large, str(tmp_path / "large"), spark)
    for model in (large, risk.load_model(str(tmp_path / "large"), spark)):
        assert isinstance(model.forest, forests.StoredForest)
        got = model.transform(rows)
        assert got.columns == [*rows.columns, "probability_low", "prediction"]
        found = sorted(rows_of(got, "order_id", *feats.NUMERIC_V2[1:], "probability_low", "prediction"))
        assert len(found) == len(want) and all(f == pytest.approx(w, abs=1e-12) for f, w in zip(found, want, strict=True))
        assert model.forest.importances() == pytest.approx(held.forest.importances(), abs=1e-12)
    assert large.transform(rows.limit(0)).count() == 0


def test_cluster_names(spark):
    rows = [(0, 10, 100.0, 1.0, 50.0), (1, 5, 200.0, 1.0, 900.0), (2, 7, 150.0, 2.1, 60.0), (3, 9, 300.0, 1.0, 55.0)]
    columns = "cluster int, customers long, avg_recency double, avg_frequency double, avg_monetary double"
    named = clusters.name_clusters(spark.createDataFrame(rows, columns))
    assert dict(rows_of(named, "cluster", "segment")) == {
        0: "Recent one-time buyers",
        1: "High value buyers",
        2: "Repeat buyers",
        3: "Dormant one-time buyers",
    }
    three = clusters.name_clusters(spark.createDataFrame(rows[:3], columns))
    assert dict(rows_of(three, "cluster", "segment"))[0] == "Cluster 0"


def test_kmeans_separates_clear_groups(spark):
    rows = [(f"{g}-{i}", r + i % 3, f, m + i % 5) for g, (r, f, m) in enumerate([(10, 1, 50.0), (300, 1, 50.0), (100, 5, 60.0), (90, 1, 900.0)]) for i in range(20)]
    rfm = spark.createDataFrame(rows, "customer_unique_id string, recency_days int, frequency int, monetary double")
    clustered = clusters.kmeans_segments(rfm, seeds=(1, 2, 3))
    profile = {x["segment"]: x["customers"] for x in clusters.cluster_profile(clustered).collect()}
    assert set(profile.values()) == {20} and len(profile) == 4
    named = {(x["customer_unique_id"][0], x["segment"]) for x in clusters.named_segments(clustered).collect()}
    assert ("3", "High value buyers") in named and len(named) == 4


def _single_fit(x, start, tolerance):
    centres = start.copy()
    for iteration in range(1, 301):
        near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        moved = np.array([x[near == k].mean(0) if (near == k).any() else c for k, c in enumerate(centres)])
        step = ((moved - centres) ** 2).sum()
        centres = moved
        if step <= tolerance:
            break
    return centres, ((x[:, None] - centres[None]) ** 2).sum(-1).min(1).sum(), iteration


def test_restarts_together_equal_single_fits(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.4, (80, 3)) for c in rng.normal(0, 2, (5, 3))])
    points = spark.createDataFrame([(f"{i}", *map(float, v)) for i, v in enumerate(x)], "id string, x0 double, x1 double, x2 double").repartition(4)
    columns = ["x0", "x1", "x2"]
    starts = x[rng.integers(0, len(x), (10, 4))]
    starts[9] = 100 + np.arange(12).reshape(4, 3)  # clusters that never get a point
    centres, cost, iterations = clusters.lloyd(points, columns, starts)
    for r in range(10):
        want, price, steps = _single_fit(x, starts[r], clusters.TOLERANCE)
        assert np.allclose(centres[r], want, atol=1e-9) and cost[r] == pytest.approx(price) and iterations[r] == steps
    assert len(set(iterations.tolist())) > 1


def test_starts_are_spread_and_repeatable(spark):
    x = np.repeat([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]], 50, axis=0)
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double")
    found = clusters.starts(points, "id", ["a", "b"], 3, range(6))
    assert all({tuple(c) for c in s} == {(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)} for s in found.tolist())
    assert (found == clusters.starts(points.repartition(5), "id", ["a", "b"], 3, range(6))).all()
    # More centres than different points: some coincide. Fewer rows than there are: a sample.
    assert clusters.starts(points, "id", ["a", "b"], 5, [1]).shape == (1, 5, 2)
    assert clusters.starts(points, "id", ["a", "b"], 2, [1], rows=40).shape == (1, 2, 2)


def test_clusters_of_incomplete_and_no_customers(spark):
    schema = "customer_unique_id string, recency_days int, frequency int, monetary double"
    rows = [(f"{i}", i % 50, 1, float(i % 7)) for i in range(60)] + [("x", None, 1, 2.0), ("y", 3, 1, None)]
    found = {r["customer_unique_id"]: r["cluster"] for r in clusters.kmeans_segments(spark.createDataFrame(rows, schema), k=2, seeds=(1, 2)).collect()}
    assert found["x"] is None and found["y"] is None and {found[f"{i}"] for i in range(60)} == {0, 1}
    assert clusters.kmeans_segments(spark.createDataFrame([], schema)).collect() == []


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(1000)
    first = rows_of(clusters.sample_n(df, "id", 50))
    assert first == rows_of(clusters.sample_n(df.repartition(3), "id", 50)) and len(first) == 50
    assert clusters.sample_n(df, "id", 5000).count() == 1000
