import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import importance
from quillspark.operators.importance import Trees
from quillspark.operators.scaling import Scale
from quillspark.plans import catalogue as queries
from quillspark.plans.benchmarking import SCHEMA, compare, print_scores, report
from quillspark.plans.synthesizer import FeatureModel, FeatureSynthesizer
from quillspark.sources import synthetic
from quillspark.sources.datasets import LINE, catalogue, dataset, externals
from quillspark.sources.readers import prepare, read_csv
from quillspark.streaming.apply import run_available, stream_features

FOLDER = "/root/testdata/sf0.001"
SMALL = dict(iterations=2, gen_size=3)


@pytest.fixture(scope="module")
def table(spark):
    return dataset("line_product").table(spark, FOLDER).cache()


@pytest.fixture(scope="module")
def model(table):
    return FeatureSynthesizer(trees=Trees(trees=10, depth=4), **SMALL).fit(table, LINE, "y")


def test_stability(table, model):
    made = model.transform(table, ["y"])
    assert made.columns == ["y", *model.feature_names] and model.feature_names[-4:] == LINE
    assert made.count() == table.count()
    assert any("l_quantity" in n and "l_discount" in n for n in model.feature_names[:-4])


def test_same_seed_same_model(table, model):
    again = FeatureSynthesizer(trees=Trees(trees=10, depth=4), **SMALL).fit(table.repartition(1), LINE, "y")
    assert again.scale == model.scale and len(again.trees) <= 4


def test_fanova_keeps_the_planted_product(spark):
    data = dataset("line_planted")
    table = data.table(spark, FOLDER)
    maker = FeatureSynthesizer(task="regression", selection="fAnova", gen_size=8, iterations=1, feat_imps=False, random_state=1, trees=Trees(task="regression", trees=10, depth=4))
    model = maker.fit(table, LINE, "y")
    assert len(model.feature_names) == 4
    made = model.transform(table)
    assert made.columns == model.feature_names
    # columns that the test dropped aren't computed
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    unused = [c for c in LINE if not any(c in n for n in model.feature_names)]
    assert all(f"{c}#" not in plan.split("Relation")[0] for c in unused)


@pytest.mark.parametrize("split_feats", [None, "comb", "splits"])
def test_split_modes(table, split_feats):
    made = FeatureSynthesizer(split_feats=split_feats, estimator="rf", iterations=1, gen_size=2, trees=Trees(trees=5, depth=3)).fit(table, LINE, "y")
    assert made.feature_names[-4:] == LINE


def test_options_without_combination(table):
    maker = FeatureSynthesizer(combine_res=False, check_corr=False, estimator="rf", trees=Trees(trees=5, depth=3), **SMALL)
    model = maker.fit(table, LINE, "y")
    assert len(model.trees) == 4 and [h["round"] for h in maker.history] == [0, 1]
    assert sum(maker.history[1]["operators"].values()) > sum(maker.history[0]["operators"].values())
    important = FeatureSynthesizer(corr_keep="important", estimator="rf", trees=Trees(trees=5, depth=3), **SMALL).fit(table, LINE, "y")
    assert len(important.trees) >= 1


def test_multiclass(spark):
    table = dataset("line_flag").table(spark, FOLDER)
    made = FeatureSynthesizer(iterations=1, gen_size=2, trees=Trees(trees=3, depth=3)).fit(table, LINE, "y")
    assert made.feature_names


def test_text_labels(spark, table):
    named = table.withColumn("y", F.when(F.col("y") == 1, "yes").otherwise("no"))
    made = FeatureSynthesizer(iterations=1, gen_size=2, estimator="rf", trees=Trees(trees=3, depth=3)).fit(named, LINE, "y")
    assert made.feature_names


def test_sample_takes_a_third_of_each_group_of_copies(spark, monkeypatch):
    seen = []

    def noted(df, columns, label, *rest, **options):
        seen.append({(r.f0, r.f1, r[label]): r["count"] for r in df.groupBy("f0", "f1", label).count().collect()})
        return np.arange(len(columns), dtype=float), None

    monkeypatch.setattr(importance, "importances", noted)
    coded = spark.range(6000).selectExpr("cast(id % 2 as double) a", "cast(id % 3 = 0 as double) b", "id % 6 = 5 as y").withColumn("y", F.col("y").cast("int"))
    FeatureSynthesizer(iterations=1, gen_size=1, feat_imps=False, check_corr=False).fit(coded, ["a", "b"], "y")
    FeatureSynthesizer(iterations=1, gen_size=1, feat_imps=False, check_corr=False, random_state=1).fit(coded, ["a", "b"], "y")
    assert all(sum(s.values()) == 2000 for s in seen)
    for found in seen:
        positives = sum(n for (_, _, y), n in found.items() if y == 1)
        assert abs(positives - 1000 / 3) < 75


def test_same_features_however_the_table_is_stored(spark, table):
    def made(stored):
        return FeatureSynthesizer(iterations=1, gen_size=2, estimator="rf", trees=Trees(trees=5, depth=3)).fit(stored, LINE, "y").feature_names

    assert made(table) == made(table.repartition(1)) == made(table.orderBy("l_tax"))


def test_summed_samples_and_one_call(spark, table, monkeypatch):
    seen = []

    def noted(df, columns, label, *rest, **options):
        seen.append(df.count())
        return np.arange(len(columns), dtype=float), None

    monkeypatch.setattr(importance, "importances", noted)
    maker = FeatureSynthesizer(iterations=1, gen_size=1, check_corr=False, sample_count=3)
    made = maker.fit_transform(table, LINE, "y", ["y"])
    assert seen == [2000] * 6 and made.columns == ["y", *maker.model.feature_names] and made.count() == table.count()
    with pytest.raises(ValueError):
        FeatureSynthesizer(sample_count=0)


def test_tables_that_users_bring(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), "x", 100 + k) for k, (a, b) in enumerate(rng.random((50, 2)))]
    houses = spark.createDataFrame([*rows, (None, float("nan"), "y", 300)], "area double, `lot.size` double, street string, SalePrice int")
    houses.write.option("header", True).csv(f"file://{tmp_path}/ames_housing.csv")
    cover = spark.createDataFrame([(float(i % 7), i, 1 + i % 3) for i in range(12_000)], "a double, b int, Cover_Type int")
    cover.write.parquet(f"file://{tmp_path}/covertype.parquet")
    found = {d.name: d for d in externals(spark, f"file://{tmp_path}")}
    assert set(found) == {"ames_housing", "covertype"}
    ames = found["ames_housing"].table(spark, "")
    assert ames.columns == ["area", "lot.size", "y"] and ames.count() == 51 and ames.where("area = 0 and `lot.size` = 0").count() == 1
    forest = found["covertype"].table(spark, "")
    assert forest.count() == 10_000 and {r.y for r in forest.select("y").distinct().collect()} == {0, 1}
    assert found["covertype"].task == "classification" and found["ames_housing"].task == "regression"
    spark.createDataFrame([(1,)], "x int").write.parquet(f"file://{tmp_path}/iris.parquet")
    with pytest.raises(ValueError):
        externals(spark, f"file://{tmp_path}")


def test_score_lines(spark, capsys):
    results = spark.createDataFrame([("regression", "b", "lr_reg", "original", "r2", 0.5), ("classification", "a", "lr", "engineered", "f1_weighted", 0.75)], SCHEMA)
    print_scores(results)
    assert capsys.readouterr().out.splitlines() == ["a (classification), lr, engineered: f1_weighted = 0.7500", "b (regression), lr_reg, original: r2 = 0.5000"]


def test_errors(spark, table):
    for bad in (dict(task="ranking"), dict(estimator="lgb"), dict(iterations=0), dict(task="regression", trees=Trees())):
        with pytest.raises(ValueError):
            FeatureSynthesizer(**bad)
    with pytest.raises(ValueError):
        FeatureSynthesizer().fit(table.limit(2), LINE, "y")


def test_saved_model(spark, table, model, tmp_path):
    path = f"file://{tmp_path}/model"
    model.save(spark, path)
    again = FeatureModel.load(spark, path)
    assert again == model
    assert model.transform(table).exceptAll(again.transform(table)).isEmpty()
    programs = model.programs(spark).collect()
    assert len(programs) == len(model.trees) and all(p.depth in (1, 2, 3) for p in programs)


def test_transform_is_one_projection(spark, table, model):
    plan = model.transform(spark.read.parquet(f"{FOLDER}/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_stream(spark, model, tmp_path):
    out = f"file://{tmp_path}"
    got = run_available(model, spark, FOLDER, "lineitem.parquet", out, ("l_orderkey",))
    wanted = model.transform(spark.read.parquet(f"{FOLDER}/lineitem.parquet"), ["l_orderkey"])
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()
    assert run_available(model, spark, FOLDER, "lineitem.parquet", out, ("l_orderkey",)).count() == wanted.count()
    with pytest.raises(ValueError):
        stream_features(model, wanted)


def test_comparison_and_report(spark, tmp_path):
    results = compare(spark, FOLDER, [dataset("line_planted")], {"regression": ["lr_reg"]}, trees=Trees(trees=5, depth=4), iterations=1, gen_size=20)  # enough draws to hold the planted product
    scores = {r.variant: r.score for r in results.collect()}
    assert scores["engineered"] >= scores["original"]
    report(results, f"file://{tmp_path}/report")
    assert read_csv(spark, f"file://{tmp_path}/report").count() == 2


def test_bench_results_cover_the_harness(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "compare", lambda spark, folder, datasets, *rest, **options: seen.append((datasets, rest, options)))
    queries.queries()["bench_results"](spark, FOLDER)
    ((datasets, rest, options),) = seen
    assert [d.name for d in datasets] == [d.name for group in catalogue().values() for d in group] and len(datasets) == 9
    assert not rest and not options  # HARNESS and the fit's defaults


@pytest.mark.parametrize("name", ["fit_stability", "fit_fanova"])
def test_registered_fits_have_the_defaults(spark, monkeypatch, name):
    seen = []

    def noted(maker, df, features, label):
        seen.append(maker)
        return FeatureModel(Scale(tuple(features), (0.0,) * len(features), (1.0,) * len(features)), (), (0,))

    monkeypatch.setattr(FeatureSynthesizer, "fit", noted)
    queries.queries()[name](spark, FOLDER)
    (maker,) = seen
    plain = FeatureSynthesizer(task=maker.task)
    assert (maker.trees, maker.iterations, maker.gen_size) == (plain.trees, plain.iterations, plain.gen_size)


@pytest.mark.parametrize("name", ["rf_importances", "avg_importances", "summed_importances", "weighted_importances", "tree_paths"])
def test_registered_ensembles_have_the_defaults(spark, monkeypatch, name):
    seen = []

    def noted(*given):
        seen.append(next(g for g in given if isinstance(g, Trees)))
        raise InterruptedError

    for f in ("importances", "weighted_importances", "forest_importance"):
        monkeypatch.setattr(importance, f, noted)
    with pytest.raises(InterruptedError):
        queries.queries()[name](spark, FOLDER)
    assert seen == [Trees()]


def test_csv_and_preparation(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2], float(i), i % 3) for i in range(50)], "id int, s string, x double, target int")
    rows.write.option("header", True).csv(f"file://{tmp_path}/csv")
    read = read_csv(spark, f"file://{tmp_path}/csv")
    assert dict(read.dtypes) == {"id": "int", "s": "string", "x": "double", "target": "int"}
    assert read_csv(spark, f"file://{tmp_path}/csv", "id long, s string, x double, target int").schema["id"].dataType.simpleString() == "bigint"
    ready = prepare(read, "target")
    assert set(ready.columns) == {"id", "s", "x", "label", "split"} and dict(ready.dtypes)["s"] == "int"
    assert {r.split for r in ready.select("split").distinct().collect()} == {"train", "test"}


def test_generated_tables(spark):
    f1 = synthetic.friedman1(spark, 200).toPandas()
    assert f1.shape == (200, 12) and f1.y.between(0, 30.1).all()
    f2 = synthetic.friedman2(spark, 200).toPandas()
    assert (f2.y >= f2.x0 - 1e-9).all()
    made = synthetic.classes(spark, 500).toPandas()
    assert made.shape == (500, 22) and set(made.y) == {0, 1}
    line = synthetic.linear(spark, 300, noise=0.0).toPandas()
    assert line.drop(columns=["id", "y"]).iloc[:, :15].shape[1] == 15 and line.y.std() > 1
    assert synthetic.linear(spark, 300).toPandas().equals(line)
    assert {d.task for d in catalogue()["classification"]} == {"classification"}
