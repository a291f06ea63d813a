"""Training sets, splits, metrics and models: labels with document figures, and a forest over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.functions import FEATURE_NAMES
from skytrace.operators import catalog as C
from skytrace.operators import features as FT
from skytrace.operators import training as TN
from skytrace.plans.captures import DF, F0, THRESHOLD, WINDOW_FEATURES_SQL, ordered, spectra


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = TN.metrics(table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


def label_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TN.roc_auc(label_join(spark, sf_dir), "quality", "n_chars").select(F.round("auc", 6).alias("auc"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def detector_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = label_join(spark, sf_dir).select(F.col("quality").alias("rule_detection_result"), F.col("toxic").alias("ml_detection_result"), F.lit("v1").alias("model_version"), (F.col("n_chars") % 10 / 10.0).alias("rule_confidence_score"), (F.col("n_chars") % 7 / 7.0).alias("ml_confidence_score"))
    return TN.agreement(x).withColumn("mean_delta", F.round("mean_delta", 6))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TN.duplicates(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TN.split(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TN.folds(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", 5)


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a training set made from parts, with missing, odd and infinite cells, odd labels and repeated ids."""
    k, v = F.col("p_partkey"), F.col("p_retailprice").cast("string")
    cell = F.when(k % 50 == 0, None).when(k % 50 == 1, "n/a").when(k % 50 == 2, "Infinity").otherwise(v)
    rows = table(spark, sf_dir, "part").select(
        (k - F.when(k % 40 == 1, 1).otherwise(0)).cast("string").alias("capture_id"), *[cell.alias(n) if n == "snr_db" else v.alias(n) for n in FEATURE_NAMES],
        F.when(k % 60 == 3, "2").otherwise((k % 2).cast("string")).alias("label"), k.alias("row_idx"),
    )
    return TN.validate(rows, order="row_idx")


def synthetic_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "1").when(F.col("event_type") == "view", "x").otherwise("0").alias("is_synthetic"))
    return rows.agg(TN.synthetic_rows(rows).alias("synthetic"), F.count(F.lit(1)).alias("n"))


#: Slices of a training window; seconds between two vectors.
WINDOW, SECONDS = 5, 20


def labelled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: captures cut in windows of slices, the nine features of each, labelled by the passes (errors of the events) that they overlap. Made once: splits and forests read them many times."""
    rows = FT.peak_rows(spectra(spark, sf_dir), THRESHOLD, F0, DF).withColumn("at", F.col("vec_id"))
    cut = F.expr(f"t_idx div {WINDOW}")
    windows = ordered(rows).withColumns({"satellite": F.concat(F.lit("SAT "), "capture_id"), "capture_id": F.concat_ws("-", "capture_id", cut.cast("string")), "t_idx": F.col("t_idx") % WINDOW, "time_s": F.col("time_s") % WINDOW, "n_slices": F.lit(WINDOW).cast("long")})
    time = lambda x: F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01T00:00:00Z").cast("timestamp")) + x * SECONDS)
    recordings = windows.groupBy("capture_id").agg(F.any_value("satellite").alias("satellite"), time(F.min("at")).alias("start"), time(F.max("at")).alias("stop"))
    ts = F.col("ts").cast("timestamp")
    passes = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.concat(F.lit("SAT "), (F.col("user_id") % 10).cast("string")).alias("satellite"), ts.alias("aos"), F.timestamp_seconds(F.unix_seconds(ts) + 300).alias("los"))
    labels = C.pass_labels(recordings, passes, 60, 120).select("capture_id", "label")
    return FT.peak_features(windows, length="n_slices", longest=WINDOW).join(labels, "capture_id").localCheckpoint()


def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows with their part of the split."""
    return TN.split(labelled_windows(spark, sf_dir), "capture_id").withColumns({n: F.round(n, 6) for n in FEATURE_NAMES})


def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest fitted on the training part, scored on the test part."""
    rows = TN.split(labelled_windows(spark, sf_dir), "capture_id")
    model = TN.fit_forest(TN.assemble(rows.filter("not is_test")), balanced=True)
    return TN.score(rows.filter("is_test").drop("is_test"), model, "v1").select("capture_id", "label", "ml_status", "ml_detection_result", F.round("ml_confidence_score", 6).alias("ml_confidence_score"), "model_version")


def training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: metrics of the test part, cross-validation, the most important feature, row counts, parameters and provenance."""
    return TN.report(labelled_windows(spark, sf_dir), "capture_id", f"{sf_dir}/embeddings.parquet").select(
        "tn", "fp", "fn", "tp", "n", "accuracy", "precision", "recall", "f1", "cv_folds", "cv_mean_f1", "cv_std_f1", "cv_skipped", "top_feature", "n_training", "n_test", "n_total", "positives", "trees", "max_depth", "seed", "test_fraction", "synthetic"
    )


QUERIES = {f.__name__: f for f in (label_join, label_metrics, label_auc, label_counts, detector_agreement, duplicate_ids, train_test_split, fold_assignment, validation_report, synthetic_guard, training_windows, forest_scores, training_report)}

ORACLE_SQL = {
    "label_join": "select d.doc_id, d.source, d.n_chars, l.* exclude (doc_id) from documents d join labels l on l.doc_id = d.doc_id",
    "label_metrics": """with c as (select count(*) filter (quality <> 1 and toxic <> 1) as tn, count(*) filter (quality <> 1 and toxic = 1) as fp, count(*) filter (quality = 1 and toxic <> 1) as fn, count(*) filter (quality = 1 and toxic = 1) as tp from labels),
        m as (select *, tn + fp + fn + tp as n, (tp + tn) / (tn + fp + fn + tp) as accuracy, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall from c)
        select tn, fp, fn, tp, n, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1 from m""",
    "label_auc": """with s as (select n_chars as x, count(*) filter (quality = 1) as p, count(*) filter (quality = 0) as q from documents join labels using (doc_id) group by 1),
        b as (select *, coalesce(sum(q) over (order by x rows between unbounded preceding and 1 preceding), 0) as below from s) select round(sum(p * (below + q / 2.0)) / (sum(p) * sum(q)), 6) as auc from b""",
    "label_counts": "select quality as label, count(*) as n from labels group by 1",
    "detector_agreement": """select quality as rule_detection_result, toxic as ml_detection_result, 'v1' as model_version, count(*) as n, round(avg(n_chars % 10 / 10.0 - n_chars % 7 / 7.0), 6) as mean_delta from documents join labels using (doc_id) group by 1, 2""",
    "duplicate_ids": "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n > 1",
    "train_test_split": """select doc_id, quality as label, row_number() over (partition by quality order by md5('42' || doc_id), doc_id) <= ceil(count(*) over (partition by quality) * 0.25) as is_test from labels""",
    "fold_assignment": "select doc_id, quality as label, cast((row_number() over (partition by quality order by md5('42' || doc_id), doc_id) - 1) % 5 as int) as fold from labels",
    "validation_report": f"""with p as (select p_partkey, cast(p_partkey - case when p_partkey % 40 = 1 then 1 else 0 end as varchar) as capture_id, cast(p_retailprice as varchar) as v from part),
        d as (select capture_id, row_number() over (partition by capture_id order by p_partkey) as n from p)
        select case p_partkey % 50 when 0 then 'missing' when 1 then 'non_numeric' else 'infinite' end as rule, 'snr_db' as "column", capture_id from p where p_partkey % 50 < 3
        union all select 'bad_label', 'label', capture_id from p where p_partkey % 60 = 3
        union all select 'duplicate', 'capture_id', capture_id from d where n > 1""",
    "synthetic_guard": "select count(*) filter (event_type = 'error') as synthetic, count(*) as n from events",
    "training_windows": f"""{WINDOW_FEATURES_SQL},
        rec as (select capture_id, any_value(satellite) as satellite, epoch(timestamp '2024-01-01') + min(vec_id) * {SECONDS} as a, epoch(timestamp '2024-01-01') + max(vec_id) * {SECONDS} as b from s group by 1),
        ps as (select 'SAT ' || (user_id % 10) as satellite, epoch(date_trunc('second', ts)) - 60 as lo, epoch(date_trunc('second', ts)) + 420 as hi from events where event_type = 'error'),
        lb as (select capture_id, cast(exists (select 1 from ps where ps.satellite = rec.satellite and rec.a <= ps.hi and rec.b >= ps.lo) as int) as label from rec)
        select capture_id, {", ".join(f"round({n}, 6) as {n}" for n in FEATURE_NAMES)}, label,
          row_number() over (partition by label order by md5('42' || capture_id), capture_id) <= ceil(count(*) over (partition by label) * 0.25) as is_test from fr join lb using (capture_id)""",
}
