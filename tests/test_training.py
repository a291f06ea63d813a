"""The registered training queries use the whole models."""

import inspect

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from skytrace.operators import training as TN
from skytrace.plans import training


def test_forests_have_all_trees_and_folds(spark, monkeypatch):
    fit, cv, seen = training.TN.fit_forest, training.TN.cross_validate, []

    def arguments(f, a, k):
        bound = inspect.signature(f).bind(*a, **k)
        bound.apply_defaults()
        return bound.arguments

    def small_fit(*a, **k):
        seen.append(("trees", arguments(fit, a, k)["trees"]))
        return fit(*a, **k | {"trees": 2})

    def no_folds(*a, **k):
        got = arguments(cv, a, k)
        seen.append(("folds", got["k"], got["trees"]))
        return {"folds": got["k"], "mean_f1": 0.0, "std_f1": 0.0}

    monkeypatch.setattr(training.TN, "fit_forest", small_fit)
    monkeypatch.setattr(training.TN, "cross_validate", no_folds)
    assert training.forest_scores(spark, "/root/testdata/sf0.001").count() > 0
    assert training.training_report(spark, "/root/testdata/sf0.001").count() == 1
    assert seen == [("trees", 100), ("trees", 100), ("folds", 5, 100)]


def test_report_metrics_follow_from_its_scores(spark):
    """Recomputed in SQL from the scores of the test part; the parts are those of training_windows."""
    import duckdb

    folder = "/root/testdata/sf0.01"
    rows = training.labelled_windows(spark, folder).cache()
    r = TN.report(rows, "capture_id", folder, trees=10).first()
    windows = training.training_windows(spark, folder).toPandas()
    parts = TN.split(rows, "capture_id")
    model = TN.fit_forest(TN.assemble(parts.filter("not is_test")), trees=10)
    scores = TN.score(parts.filter("is_test"), model).select("capture_id", "label", "ml_detection_result").toPandas()  # noqa: F841
    got = duckdb.sql("""select count(*) filter (label = 0 and ml_detection_result = 0) as tn, count(*) filter (label = 0 and ml_detection_result = 1) as fp,
        count(*) filter (label = 1 and ml_detection_result = 0) as fn, count(*) filter (label = 1 and ml_detection_result = 1) as tp from scores""").fetchall()[0]
    assert got == (r["tn"], r["fp"], r["fn"], r["tp"])
    assert (r["n_test"], r["n_total"], r["positives"]) == (windows["is_test"].sum(), len(windows), windows["label"].sum()) and r["n"] == r["n_test"]
    assert set(scores["capture_id"]) == set(windows["capture_id"][windows["is_test"]])


def test_folds_fit_side_by_side(spark):
    """The same figures as one fold after the other."""
    rows = spark.createDataFrame([(i, float(i % 7), float(i * i % 11), int(i % 7 + i * i % 11 > 8)) for i in range(60)], "capture_id int, snr_db double, peak_power double, label int")
    whole = TN.assemble(rows, ("snr_db", "peak_power"))
    got = TN.cross_validate(whole, "capture_id", trees=5)
    dealt, f1 = TN.folds(whole, "capture_id", 5), []
    for i in range(5):
        model = TN.fit_forest(dealt.filter(F.col("fold") != i), trees=5)
        f1.append(TN.metrics(model.transform(dealt.filter(F.col("fold") == i)), "label", "prediction").first()["f1"])
    assert got["folds"] == 5 and abs(got["mean_f1"] - sum(f1) / 5) < 1e-12


def test_bundle_status_by_path(spark, tmp_path):
    from skytrace.sources import store

    names = ("snr_db", "peak_power")
    rows = spark.createDataFrame([(float(i % 7), float(i), int(i > 10)) for i in range(24)], "snr_db double, peak_power double, label int")
    model = TN.fit_forest(TN.assemble(rows, names), trees=3)
    path = str(tmp_path / "bundle")
    store.save_bundle(model, path, {"model_version": "v7"}, names)
    r = TN.score_by_path(rows, path, names).first()
    assert (r["ml_status"], r["model_version"]) == ("AVAILABLE", "v7") and r["ml_detection_result"] in (0, 1)
    status = lambda p, n=names: TN.score_by_path(rows, p, n).first()["ml_status"]
    assert status(path, names[::-1]) == "MODEL_INVALID"
    assert status(None) == status(str(tmp_path / "none")) == "MODEL_NOT_AVAILABLE"
    spark.createDataFrame([("{}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")
    assert status(path) == "MODEL_NOT_AVAILABLE"
    spark.createDataFrame([("no json",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")
    assert status(path) == "MODEL_NOT_AVAILABLE"
    found = TN.importance_table(spark, model, names)
    store.save_importance(found, str(tmp_path / "importance"))
    back = spark.read.csv(str(tmp_path / "importance"), header=True, inferSchema=True).collect()
    assert [r["feature"] for r in back] == [r["feature"] for r in found.collect()] and back[0]["importance"] >= back[1]["importance"]


def test_report_counts_and_labelled_append(spark, tmp_path):
    from skytrace.functions import FEATURE_NAMES
    from skytrace.sources import store

    rows = spark.createDataFrame([(f"c{i}", *(float((i * (k + 3)) % 11) + 5 * (i % 2) for k in range(len(FEATURE_NAMES))), i % 2) for i in range(40)], ", ".join(["capture_id string", *(f"{n} double" for n in FEATURE_NAMES), "label int"]))
    r = TN.report(rows, "capture_id", "here", trees=3).first()
    assert (r["n_training"], r["n_test"], r["n_total"], r["positives"], r["trees"], r["dataset"], r["n"]) == (30, 10, 40, 20, 3, "here", 10)
    assert abs(r["accuracy"] - (r["tp"] + r["tn"]) / r["n"]) < 1e-9 and r["cv_folds"] == 5
    odd = rows.drop("label").withColumn("smoothness_score", F.lit(float("inf")))
    made = store.labelled_rows(odd, rows.filter("label = 1").select("capture_id", "label"), {"annotator": "x"})
    store.append_labelled(made, str(tmp_path / "set"))
    store.append_labelled(made, str(tmp_path / "set"))
    from skytrace.sources import scan

    back = scan.training_set(spark, str(tmp_path / "set"))
    assert back.count() == 40 and {(r["smoothness_score"], r["raw_smoothness_score"]) for r in back.collect()} == {("1000000.0", "Infinity")}
    many = spark.createDataFrame([(float(i * i % 13), i % 2) for i in range(300)], "s double, y int")
    got = TN.roc_auc(many, "y", "s").first()["auc"]
    x = [(r["s"], r["y"]) for r in many.collect()]
    wins = [(a > b) + (a == b) / 2 for a, p in x for b, q in x if p == 1 and q == 0]
    assert abs(got - sum(wins) / len(wins)) < 1e-12


def test_windows_are_made_once_and_forests_keep_nodes(spark):
    """Splits and forests read rows that are there, not the tables again; the trees are those of a forest that is sent out with each group of nodes."""
    windows = training.labelled_windows(spark, "/root/testdata/sf0.001")
    assert "FileScan" not in windows._jdf.queryExecution().executedPlan().toString()
    rows = TN.assemble(windows).persist()
    model = TN.fit_forest(rows, trees=5)
    assert model.getCacheNodeIds()
    plain = RandomForestClassifier(numTrees=5, maxDepth=30, featureSubsetStrategy="sqrt", seed=42).fit(rows)
    assert model.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]
    rows.unpersist()
