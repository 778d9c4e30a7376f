import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import group_stats
from quillspark.operators import importance, metrics, models, paths, sampling, scaling, selection
from quillspark.operators.importance import Trees


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    rows = [(float(a), float(b), float(c), int(a * b > 0.25), float(a * b)) for a, b, c in x]
    return spark.createDataFrame(rows, "a double, b double, c double, y int, t double").cache()


GROUP = [("x", 1.0), ("x", 3.0), ("y", 5.0), (None, 7.0), ("z", None)]
HOLED = [("x", 1.0), ("x", 3.0), ("x", float("nan"))]
CASES = {"mean": {"x": 2, "y": 5, "z": None}, "std": {"x": 1, "y": 0, "z": None}, "sum": {"x": 4, "y": 5, "z": 0}, "len": {"x": 2, "y": 1, "z": 1}, "p25": {"x": 1.5, "y": 5, "z": None}, "mode": {"x": 1, "y": 5, "z": None}, "range": {"x": 2, "y": 0, "z": None}}


@pytest.mark.parametrize("make", [group_stats.group_feature, group_stats.group_feature_windowed])
@pytest.mark.parametrize("how", sorted(CASES))
def test_group_features(spark, make, how):
    df = spark.createDataFrame(GROUP, "k string, v double")
    got = make(df, "k", "v", how, "g").collect()
    assert len(got) == 5
    for r in got:
        assert r.g == (CASES[how][r.k] if r.k else None)


@pytest.mark.parametrize("make", [group_stats.group_feature, group_stats.group_feature_windowed])
def test_group_features_with_missing_values(spark, make):
    df = spark.createDataFrame(HOLED, "k string, v double")
    want = {"mean": 2, "std": 1, "sum": 4, "len": 3, "range": 2, "median": None, "p25": None, "p75": None}
    for how, w in want.items():
        assert {r.g for r in make(df, "k", "v", how, "g").collect()} == {w}


def test_registered_aggregate(spark):
    group_stats.register("first", F.min)
    df = spark.createDataFrame(GROUP, "k string, v double")
    assert group_stats.group_feature(df, "k", "v", "first", "g").where("k = 'x'").first().g == 1.0
    group_stats.AGGREGATES.pop("first")
    assert group_stats.random_aggregate(7) in group_stats.AGGREGATES


def test_scaling_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (float("nan"), 5.0), (None, None)], "a double, `b.c` double")
    scale = scaling.fit_min_max(df, ["a", "b.c"])
    got = [tuple(r) for r in df.select(*scale.of()).collect()]
    assert got == [(0.0, 0.0), (1.0, 0.0), (None, 0.0), (None, None)]
    assert scaling.fit_min_max(df.limit(0), ["a"]).factors == (0.0,)


def test_exact_sample(spark):
    df = spark.range(5000)
    for k in (0, 1, 1666, 5000, 9000):
        got = [r.id for r in sampling.exact_sample(df, k, sampling.row_hash(["id"])).collect()]
        assert len(got) == len(set(got)) == min(k, 5000)
    again = sampling.exact_sample(df.repartition(7), 100, sampling.row_hash(["id"], 3)).collect()
    assert set(again) == set(sampling.exact_sample(df, 100, sampling.row_hash(["id"], 3)).collect())
    copies = spark.createDataFrame([(1,)] * 30, "id long")
    assert sampling.exact_sample(copies, 10, sampling.row_hash(["id"])).count() == 10


@pytest.mark.parametrize("hot", [0, 500, 3000])
def test_copies_are_drawn_one_by_one(spark, hot):
    df = spark.range(9000).select(F.when(F.col("id") < hot, -1.0).otherwise(F.col("id") % 4500).alias("a"), F.lit(None).cast("int").alias("b"))
    every = sampling.each_copy(sampling.count_copies(df)).cache()
    assert every.distinct().count() == 9000 and every.drop("__copy").exceptAll(df).isEmpty()
    drawn = sampling.exact_sample(every, 3000, sampling.row_hash(["a", "b", "__copy"], 1))
    assert abs(drawn.where("a = -1").count() - hot / 3) < 110
    again = sampling.exact_sample(sampling.each_copy(sampling.count_copies(df.repartition(1))), 3000, sampling.row_hash(["a", "b", "__copy"], 1))
    assert drawn.exceptAll(again).isEmpty() and again.count() == 3000


@pytest.mark.parametrize("part_rows", [1_000_000, 100])
def test_dealing_does_not_depend_on_storage(spark, monkeypatch, part_rows):
    monkeypatch.setattr(sampling, "PART_ROWS", part_rows)
    monkeypatch.setattr(sampling, "FEW_ROWS", 300)
    df = spark.range(3000).select(F.when(F.col("id") < 1000, -1).otherwise(F.col("id")).alias("a"))

    def parts(stored):
        every = sampling.each_copy(sampling.count_copies(stored))
        return sampling.dealt(every, 3000, sampling.row_hash(["a", "__copy"], 1)).rdd.glom().map(lambda p: [tuple(r) for r in p]).collect()

    found = parts(df)
    assert found == parts(df.repartition(1)) == parts(df.orderBy(F.desc("a")))
    assert len(found) == max(8, 3000 // part_rows)  # all cores: 3000 rows are worth ten partitions and sum(map(len, found)) == 3000
    assert max(sum(a == -1 for a, _ in p) for p in found) < 1000 / len(found) * 2.5


def test_edge_of_a_sample_is_narrowed(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANKED", 3)
    monkeypatch.setattr(sampling, "SLICE_BITS", 4)
    df = spark.range(3000)
    for hash_ in (sampling.row_hash(["id"]), sampling.row_key(["id"], 4)):
        wanted = [r.id for r in df.orderBy(hash_).limit(1000).collect()]
        assert sorted(wanted) == sorted(r.id for r in sampling.exact_sample(df, 1000, hash_).collect())


def test_few_different_rows_are_sampled_split_and_folded_evenly(spark):
    df = spark.range(24_000).select((F.col("id") % 8).cast("double").alias("a"), F.lit(None).cast("string").alias("b"))
    took = {r.a: r["count"] for r in sampling.drawn(df, 8000, 3).groupBy("a").count().collect()}
    assert len(took) == 8 and sum(took.values()) == 8000 and all(abs(n - 1000) < 120 for n in took.values())
    folds = {(r.a, r.fold): r["count"] for r in sampling.fold_rows(df, 1).groupBy("a", "fold").count().collect()}
    assert len(folds) == 24 and all(abs(n - 1000) < 120 for n in folds.values())
    split = {(r.a, r.split): r["count"] for r in sampling.split_rows(df, 1).groupBy("a", "split").count().collect()}
    assert all(abs(split[a, "test"] - 600) < 100 for a in range(8)) and sum(split.values()) == 24_000
    again = sampling.drawn(df.orderBy(F.desc("a")).repartition(3), 8000, 3)
    assert again.groupBy("a").count().exceptAll(sampling.drawn(df, 8000, 3).groupBy("a").count()).isEmpty()


def test_many_columns_correlate_in_one_pass(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 30))
    x[:, 7] = 2 * x[:, 3] + 0.1 * x[:, 7]
    x[:, 9] = 4.0
    df = spark.createDataFrame(x.tolist(), [f"c{i}" for i in range(30)])
    found = {(r.i, r.j): r["corr"] for r in selection.correlation_pairs(df, df.columns).collect()}
    with np.errstate(invalid="ignore"):
        wanted = np.abs(np.corrcoef(x.T))
    assert len(found) == 435 and found[3, 7] > 0.99 and found[3, 9] is None
    assert all(v is None if np.isnan(wanted[k]) else abs(v - wanted[k]) < 1e-9 for k, v in found.items())
    few = selection.correlation_matrix(df, df.columns[:10])
    assert np.allclose(few[:9, :9], wanted[:9, :9]) and np.isnan(few[0, 9])


def test_f_values_at_their_limits(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 500)
    rows = [(int(c), 0.1 * float(c) + 7.3, 5.3, float(c) + float(e), float(e), 1e9 + float(c) + float(e), None if k % 5 else float(c) + float(e)) for k, (c, e) in enumerate(zip(y, rng.normal(size=500)))]
    df = spark.createDataFrame(rows, "y int, perfect double, constant double, good double, noise double, far double, holed double").repartition(5)
    names = ["perfect", "constant", "good", "noise", "far", "holed"]

    def by_hand(values, labels):
        groups = [values[labels == c] for c in np.unique(labels)]
        between = sum(len(g) * (g.mean() - values.mean()) ** 2 for g in groups) / (len(groups) - 1)
        return between / (sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(values) - len(groups)))

    data = {c: np.array([r[i + 1] for r in rows if r[i + 1] is not None]) for i, c in enumerate(names)}
    labels = {c: np.array([r[0] for r in rows if r[i + 1] is not None]) for i, c in enumerate(names)}
    for test in (selection.anova_f, selection.regression_f):
        found = {r.feature: r.f for r in test(df, names, "y").collect()}
        assert found["perfect"] == math.inf and found["constant"] is None
        assert [names[i] for i in selection.k_best([found[c] for c in names], 2)][0] == "perfect"
        for c in ("good", "noise", "far", "holed"):
            if test is selection.anova_f:
                wanted = by_hand(data[c], labels[c])
            else:
                r2 = np.corrcoef(data[c], labels[c])[0, 1] ** 2
                wanted = r2 / (1 - r2) * (len(data[c]) - 2)
            assert found[c] == pytest.approx(wanted, rel=1e-5)
    one = df.withColumn("y", F.lit(1))
    assert all(r.f is None for f in (selection.anova_f, selection.regression_f) for r in f(one, names, "y").collect())


def test_correlation_edges(spark):
    rows = [(1.0, 1.0, 2.0, 4.0), (2.0, 2.0, 2.0, 3.0), (3.0, 3.0, 2.0, 2.0), (4.0, 4.1, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "c0 double, c1 double, c2 double, c3 double")
    names = df.columns
    assert selection.correlated(selection.correlation_matrix(df, names)) == [1, 3]
    assert sorted(r.j for r in selection.correlated_table(selection.correlation_pairs(df, names)).collect()) == [1, 3]
    chained = np.array([[1, 0.9, 0.1], [0.9, 1, 0.9], [0.1, 0.9, 1]])
    assert selection.correlated(chained) == [1, 2]  # the third goes although the second went


def test_selection_order():
    scores = [0.1, float("nan"), 0.5, 0.3, None, 0.5]
    assert selection.top_ascending(scores, 3) == [3, 2, 5]
    assert selection.k_best(scores, 3) == [2, 3, 5]
    assert selection.top_ascending(scores, 0) == []


def test_metrics_edges(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "y int, p int, s double")
    assert metrics.f1_binary(df, "y", "p").first()[0] == 0.0
    assert metrics.f1_weighted(df, "y", "p").first()[0] == 1.0
    assert metrics.r2(df, "y", "s").first()[0] is None
    assert metrics.roc_auc(df, "y", "s").first()[0] is None
    tied = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.9), (0, 0.9)], "y int, s double")
    assert metrics.roc_auc(tied, "y", "s").first()[0] == 0.5
    holed = spark.createDataFrame([(0, 0.1), (1, 0.9), (1, None), (0, None), (None, 0.95), (1, float("nan"))], "y int, s double")
    assert metrics.roc_auc(holed, "y", "s").first()[0] == 1.0


def test_paths(spark, planted):
    nodes = {0: (0, 1, 4), 1: (1, 2, 3), 2: (-1, -1, -1), 3: (-1, -1, -1), 4: (-1, -1, -1)}
    assert list(paths.leaf_paths(nodes)) == [[0, 1], [0, 1], [0]]
    assert list(paths.leaf_paths({0: (-1, -1, -1)})) == [[]]
    trees = [[[0, 1], [0, 1], [0, 2]], [[3, 0], [0], [3, 0]], [[]]]
    assert [paths.without_repeats(t) for t in trees] == [[[0, 1], [0, 2]], [[0], [3, 0]], []]
    assert paths.split_counts(trees, 4).tolist() == [5, 2, 2, 2]
    _, forest = importance.importances(planted, ["a", "b", "c"], "y", "rf", Trees(trees=4, depth=3))
    found = paths.tree_paths(forest)
    assert [len(t) for t in found] == [(t.numNodes + 1) // 2 for t in forest.trees]
    for saved, tree in zip(found, forest.trees, strict=True):
        assert sum(map(len, saved)) >= tree.depth and max(map(len, saved)) == tree.depth
        assert {c for p in saved for c in p} == set(map(int, re.findall(r"If \(feature (\d+)", tree.toDebugString)))


def test_importances_find_the_planted_columns(spark, planted):
    small = Trees(trees=10, depth=4)
    for estimator in ("rf", "avg"):
        got, forest = importance.importances(planted, ["a", "b", "c"], "y", estimator, small)
        assert got.sum() == pytest.approx(1) and got.argmin() == 2
        assert all(set(p) <= {0, 1, 2} for t in paths.tree_paths(forest) for p in t)
    got, _ = importance.importances(planted, ["a", "b", "c"], "t", "avg", Trees(task="regression", trees=10, depth=4))
    assert got.argmin() == 2
    weighted = importance.weighted_importances(planted, ["a", "b", "c"], "y", Trees(trees=5, depth=4))
    assert weighted.sum() == pytest.approx(1) and weighted.argmin() == 2


def test_importances_edges(spark, planted):
    small = Trees(trees=3, depth=3)
    constant = planted.withColumn("y", F.lit(0))
    got, _ = importance.importances(constant, ["a", "b"], "y", "rf", small)
    assert got.tolist() == [0.0, 0.0]
    many = planted.withColumn("y", F.floor(F.col("a") * 3).cast("int"))
    got, _ = importance.importances(many, ["a", "b", "c"], "y", "avg", small)
    assert got.argmax() == 0
    with pytest.raises(ValueError):
        importance.importances(planted, ["a"], "y", "lgb", small)
    with pytest.raises(ValueError):
        importance.weighted_importances(many, ["a", "b"], "y", small)
    with pytest.raises(ValueError):
        Trees(task="ranking")


def test_estimator_choice(spark, planted):
    name, model = models.select_estimator(planted, ["a", "b", "c"], "y", "classification")
    assert name in ("dt", "lr") and model.transform(importance.assembled(planted, ["a", "b", "c"], "y")).count() == 600
    scores = models.cross_validated(planted, ["a", "b"], "t", "regression", ["lr_reg", "dt_reg"])
    assert all(0.7 < s <= 1 for s in scores.values())
    with pytest.raises(ValueError):
        models.cross_validated(planted, ["a"], "y", "classification", ["svm"])


def test_missing_values_and_dtypes(spark):
    df = spark.createDataFrame([("u", 1, float("nan"), None), ("v", None, 2.0, 3.0)], "s string, i int, x double, y double")
    got = scaling.fill_missing(df, ["x", "y"]).select("x", "y").collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (2.0, 3.0)]
    assert scaling.text_columns(df).columns == ["s"] and scaling.number_columns(df, "y").columns == ["i", "x"]
    codes = scaling.label_encode(spark.createDataFrame([("b",), ("a",), (None,)], "s string"), ["s"]).collect()
    assert sorted((r.s is None, r.s or 0) for r in codes) == [(False, 0), (False, 1), (True, 0)]
    many = spark.range(3000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("s"))
    wanted = {v: k for k, v in enumerate(sorted(f"v{i}" for i in range(3000)))}
    assert {r.value: r.code for r in scaling.label_codes(many, "s", small=10).collect()} == wanted
    assert math.isclose(metrics.mean_squared_error(spark.createDataFrame([(1.0, 2.0)], "y double, p double"), "y", "p").first()[0], 1.0)
