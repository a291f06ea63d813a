"""Training sets: validation, splits, forests, metrics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.functions import FEATURE_NAMES

from .features import project_features
from .order import numbered

#: Fewest rows of the rarer class for a cross-validation; it isn't the number of folds.
MINORITY = 5
#: Parts of the scores in the rank statistic.
AUC_PARTS = 64
#: Leading hex digits of the hash by which the rows of a class are dealt out for numbering.
HASH_DIGITS = 3


def column_violations(df: DataFrame, names: tuple[str, ...] = (*FEATURE_NAMES, "label")) -> list[str]:
    return [n for n in ("capture_id", *names) if n not in df.columns]


def validate(df: DataFrame, features: tuple[str, ...] = FEATURE_NAMES, order: str | None = None) -> DataFrame:
    """Violations (rule, column, capture_id) of a training set read as strings. A row's faults stay a row each: nothing is gathered.

    Missing columns are reported together with the faults of those that are there; a set without rows has the violation empty.
    """
    missing = column_violations(df, (*features, "label"))
    shape = "rule string, column string, capture_id string"
    found = df.sparkSession.createDataFrame([("missing_column", n, None) for n in missing], shape)
    nothing = df.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    found = found.union(nothing.select(F.lit("empty"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    own = F.col("capture_id").cast("string") if "capture_id" not in missing else F.lit(None).cast("string")
    there = [c for c in (*features, "label") if c not in missing]

    def fault(c: str) -> Column:
        x = F.expr(f"try_cast(`{c}` as double)")
        raw = F.col(c).cast("string")
        rule = F.when(raw.isNull() | (F.trim(raw) == ""), "missing").when(x.isNull() | F.isnan(x), "non_numeric").when(F.abs(x) == float("inf"), "infinite")
        return F.when(rule.isNotNull(), F.struct(rule.alias("rule"), F.lit(c).alias("column")))

    faults = [fault(c) for c in there]
    if "label" in there:
        label = F.expr("try_cast(label as double)")
        faults.append(F.when(label.isNotNull() & ~F.isnan(label) & ~label.isin(0.0, 1.0), F.struct(F.lit("bad_label").alias("rule"), F.lit("label").alias("column"))))
    if faults:
        cells = df.select(own.alias("capture_id"), F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("f"))
        found = found.union(cells.select("f.rule", "f.column", "capture_id"))
    if "capture_id" in missing:
        return found
    twice = duplicates(df, "capture_id", order or "capture_id").select(F.lit("duplicate").alias("rule"), F.lit("capture_id").alias("column"), F.col("capture_id").cast("string"))
    return found.union(twice)


def duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    """Second and later rows of each key; a key seen three times is listed twice."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n > 1").drop("_n")


def synthetic_rows(df: DataFrame) -> Column:
    """Aggregate: rows marked synthetic."""
    return F.count_if(F.coalesce(F.expr("try_cast(is_synthetic as double)"), F.lit(0.0)) != 0)


def guard_synthetic(df: DataFrame, allow: bool) -> bool:
    """Whether synthetic rows are present; refuses them unless allowed."""
    if "is_synthetic" not in df.columns:
        return False
    found = df.agg(synthetic_rows(df)).first()[0] > 0
    if found and not allow:
        raise ValueError("the training set holds synthetic rows")
    return found


def hash_order(key: str, seed: str) -> Column:
    """Order of a row in splits: an MD5 of seed and key, the same in every run."""
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def split(df: DataFrame, key: str, fraction: float = 0.25, seed: str = "42", label: str = "label", stratified: bool = True) -> DataFrame:
    """Adds is_test: the first ceil(fraction * n) rows of each class by hash order, or of all rows where there is one class or one of a single row."""
    if stratified:
        counts = df.groupBy(label).count().agg(F.count(F.lit(1)), F.min("count")).first()
        stratified = counts[0] > 1 and counts[1] >= 2
    h = hash_order(key, seed)
    out = numbered(df, [label] if stratified else [], F.substring(h, 1, HASH_DIGITS), [h, key])
    return out.withColumn("is_test", F.col("_n") <= F.ceil(F.col("_total") * F.lit(fraction))).drop("_n", "_total")


def folds(df: DataFrame, key: str, k: int, seed: str = "42", label: str = "label") -> DataFrame:
    """Adds fold in 0..k-1, dealt in turn within each class."""
    h = hash_order(key, seed)
    out = numbered(df, [label], F.substring(h, 1, HASH_DIGITS), [h, key])
    return out.withColumn("fold", F.pmod(F.col("_n") - 1, F.lit(k)).cast("int")).drop("_n", "_total")


def metrics(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: tn, fp, fn, tp, n, accuracy, precision, recall, f1; 0/0 counts as 0."""
    y, p = F.col(truth) == 1, F.col(guess) == 1
    out = pairs.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = out.withColumn("n", tn + fp + fn + tp).withColumns({"accuracy": ratio(tp + tn, F.col("n")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def roc_auc(scored: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: auc by the Mann-Whitney statistic over distinct scores, ties counted half; null with one class."""
    by = scored.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    # scores are dealt out by quantiles; only the sums of the parts meet in one task
    cuts = sorted(set(by.approxQuantile(score, [i / AUC_PARTS for i in range(1, AUC_PARTS)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col(score))) if cuts else F.lit(0)
    by = by.withColumn("part", part)
    sums = by.groupBy("part").agg(F.sum("neg").alias("own"))
    sums = sums.select("part", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return by.withColumn("inside", inside).join(sums, "part").withColumn("below", F.col("inside") + F.col("earlier")).agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def assemble(df: DataFrame, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """Adds the vector column features, sanitised first."""
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(project_features(df, names))


def fit_forest(train: DataFrame, balanced: bool = False, trees: int = 100, seed: int = 42):
    """Random forest on assembled rows; depth 30 is Spark's deepest. Rows keep their nodes, so the trees aren't sent out again with each group of nodes."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=30, featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True, labelCol="label", featuresCol="features")
    if balanced:
        n = train.groupBy("label").count().collect()
        total = sum(r["count"] for r in n)
        weights = F.create_map(*[F.lit(x) for r in n for x in (float(r["label"]), total / (len(n) * r["count"]))])
        train, forest = train.withColumn("weight", weights[F.col("label").cast("double")]), forest.setWeightCol("weight")
    return forest.fit(train)


def cross_validate(df: DataFrame, key: str, k: int = 5, trees: int = 100) -> dict:
    """Mean and population deviation of F1 over folds of the whole set, or why it was skipped."""
    counts = [r["count"] for r in df.groupBy("label").count().collect()]
    if len(counts) < 2 or min(counts) < MINORITY:
        return {"skipped": "one class only" if len(counts) < 2 else "too few rows of a class"}
    k = min(k, min(counts))
    dealt = folds(df, key, k).persist()

    def fold(i: int) -> float:
        model = fit_forest(dealt.filter(F.col("fold") != i), trees=trees)
        return metrics(model.transform(dealt.filter(F.col("fold") == i)), "label", "prediction").first()["f1"]

    dealt.count()  # once, before the folds ask for it together
    with ThreadPoolExecutor(k) as pool:  # their jobs fill the cluster side by side; each is small
        f1 = list(pool.map(fold, range(k)))
    dealt.unpersist()
    mean = sum(f1) / k
    return {"folds": k, "mean_f1": mean, "std_f1": (sum((x - mean) ** 2 for x in f1) / k) ** 0.5}


def importance(model, names: tuple[str, ...] = FEATURE_NAMES) -> list[tuple[str, float]]:
    """Largest first; ties keep the features' order."""
    return sorted(zip(names, (float(x) for x in model.featureImportances.toArray()), strict=True), key=lambda x: -x[1])


def importance_table(spark, model, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """(feature, importance), a row for each feature, largest first."""
    return spark.createDataFrame(importance(model, names), "feature string, importance double")


def report(rows: DataFrame, key: str, dataset: str, trees: int = 100, seed: int = 42, fraction: float = 0.25, allow_synthetic: bool = True) -> DataFrame:
    """One row: metrics of the test part, cross-validation, most important feature, counts, parameters and where the rows came from."""
    synthetic = guard_synthetic(rows, allow_synthetic)
    whole = assemble(rows).persist()
    parts = split(whole, key, fraction, str(seed)).persist()
    model = fit_forest(parts.filter("not is_test"), trees=trees, seed=seed)
    cv = cross_validate(whole, key, trees=trees)
    counts = parts.agg(F.count_if(~F.col("is_test")), F.count_if("is_test"), F.count_if(F.col("label") == 1)).first()
    found = metrics(model.transform(parts.filter("is_test")), "label", "prediction").first()
    parts.unpersist()
    whole.unpersist()
    own = {
        "cv_folds": cv.get("folds"), "cv_mean_f1": cv.get("mean_f1"), "cv_std_f1": cv.get("std_f1"), "cv_skipped": cv.get("skipped"), "top_feature": importance(model)[0][0],
        "n_training": counts[0], "n_test": counts[1], "n_total": counts[0] + counts[1], "positives": counts[2], "trees": trees, "max_depth": 30, "seed": seed, "test_fraction": fraction, "synthetic": synthetic, "dataset": dataset,
    }
    kinds = "cv_folds int, cv_mean_f1 double, cv_std_f1 double, cv_skipped string, top_feature string, n_training long, n_test long, n_total long, positives long, trees int, max_depth int, seed int, test_fraction double, synthetic boolean, dataset string"
    figures = "tn long, fp long, fn long, tp long, n long, accuracy double, precision double, recall double, f1 double"
    return rows.sparkSession.createDataFrame([(*(found[c.split()[0]] for c in figures.split(", ")), *own.values())], f"{figures}, {kinds}")


def score_by_path(features: DataFrame, path: str | None, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """:func:`score` by the bundle at ``path``: MODEL_NOT_AVAILABLE if there is none or a part is missing or broken, MODEL_INVALID if its features are others or in another order."""
    from skytrace.sources.store import load_bundle

    try:
        model, sidecar = load_bundle(features.sparkSession, path) if path else (None, None)
    except ValueError:
        model, sidecar = None, None
    if model is None:
        return score(features, status="MODEL_NOT_AVAILABLE", names=names)
    fits = list(sidecar["feature_names"]) == list(names)
    return score(features, model, sidecar.get("model_version"), None if fits else "MODEL_INVALID", names)


def score(features: DataFrame, model=None, version: str | None = None, status: str | None = None, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """Adds ml_status, ml_detection_result, ml_confidence_score and model_version; never raises for a missing or unfit model."""
    if status is None:
        status = "MODEL_NOT_AVAILABLE" if model is None else "AVAILABLE"
    if status == "AVAILABLE" and (model.numFeatures != len(names) or any(n not in features.columns for n in names)):
        status = "MODEL_INVALID"
    if status != "AVAILABLE":
        return features.withColumns({"ml_status": F.lit(status), "ml_detection_result": F.lit(None).cast("int"), "ml_confidence_score": F.lit(None).cast("double"), "model_version": F.lit(None).cast("string")})
    raw = features.columns
    out = model.transform(assemble(features, names))
    p = vector_to_array("probability")
    return out.select(*raw, F.lit(status).alias("ml_status"), F.col("prediction").cast("int").alias("ml_detection_result"), F.coalesce(F.get(p, F.lit(1)), F.lit(0.0)).alias("ml_confidence_score"), F.lit(version).alias("model_version"))


def agreement(results: DataFrame) -> DataFrame:
    """Rule against model results: counts and mean confidence difference by model version."""
    return results.groupBy("rule_detection_result", "ml_detection_result", "model_version").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("rule_confidence_score") - F.col("ml_confidence_score")).alias("mean_delta"))
