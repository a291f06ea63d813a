"""Result tables, summaries, training appends and model bundles."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.functions import FEATURE_NAMES
from skytrace.operators.features import project_features

RESULT_COLUMNS = {
    "id": "string", "input_file": "string", "timestamp_utc": "string", "detection_result": "int", "confidence_score": "double", "valid_signal_ratio": "double",
    "frequency_drift_hz": "double", "smoothness_score": "double", "spectrogram_image_path": "string", "raw_iq_file_path": "string", "notes": "string",
    "rule_detection_result": "int", "rule_confidence_score": "double", "ml_detection_result": "int", "ml_confidence_score": "double", "model_version": "string",
}
#: Digits of an id by which the result table is dealt into folders.
ID_DIGITS = 1


def result_rows(scored: DataFrame) -> DataFrame:
    """Detected, scored captures (with path and timestamp_utc) as result rows; the id follows from file and time, so a replay gives the same."""
    have = scored.withColumns({
        "id": F.sha2(F.concat_ws("|", "path", "timestamp_utc"), 256), "input_file": F.col("path"), "detection_result": F.col("detected").cast("int"), "confidence_score": F.col("confidence"),
        "rule_detection_result": F.col("detected").cast("int"), "rule_confidence_score": F.col("confidence"),
    })
    return migrate(have)


def migrate(old: DataFrame) -> DataFrame:
    """Any generation of result rows in today's columns; absent ones are null, nothing is filled in."""
    return old.select(*[(F.col(c) if c in old.columns else F.lit(None)).cast(t).alias(c) for c, t in RESULT_COLUMNS.items()])


def append_results(rows: DataFrame, path: str) -> None:
    """Adds result rows whose id isn't in the table yet, one an id, so that a replay changes nothing.

    The table is dealt by the first digit of the ids, sorted, with Bloom filters on them: only the parts that
    the new ids fall in are looked at, and they are read for their ids alone.
    """
    spark = rows.sparkSession
    new = rows.dropDuplicates(["id"]).withColumn("id_part", F.substring("id", 1, ID_DIGITS))
    try:
        old = results(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        new = new.join(old.select("id_part", "id"), ["id_part", "id"], "left_anti")
    new = new.select(*rows.columns, "id_part").repartition("id_part").sortWithinPartitions("id_part", "id")
    new.write.mode("append").option("parquet.bloom.filter.enabled#id", "true").partitionBy("id_part").parquet(path)


def results(spark: SparkSession, path: str) -> DataFrame:
    """The result table; its part is text even where all ids begin with digits."""
    return spark.read.schema(", ".join(f"{c} {t}" for c, t in RESULT_COLUMNS.items()) + ", id_part string").parquet(path)


def get_result(spark: SparkSession, path: str, id_: str) -> DataFrame:
    """One row or none: the id's part is picked by its folder, and within it the filter reaches the Parquet scan."""
    return results(spark, path).filter((F.col("id_part") == id_[:ID_DIGITS]) & (F.col("id") == id_)).drop("id_part")


def summaries(scored: DataFrame) -> DataFrame:
    """The summary of each capture; infinite smoothness is null."""
    rough = F.col("smoothness_score")
    return scored.select(
        F.col("path").alias("input_file"), "timestamp_utc", F.col("detected").alias("rule_detection_result"), F.col("confidence").alias("rule_confidence_score"), "valid_signal_ratio", "frequency_drift_hz",
        F.when(~F.isnan(rough) & (F.abs(rough) < float("inf")), rough).alias("smoothness_score"), "notes", "ml_status", "ml_detection_result", "ml_confidence_score", "model_version",
    )


def write_summaries(scored: DataFrame, path: str) -> None:
    summaries(scored).withColumn("date", F.substring("timestamp_utc", 1, 10)).write.mode("append").option("ignoreNullFields", "false").partitionBy("date").json(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Both generations of summaries: older ones name the rule's result otherwise."""
    schema = "input_file string, timestamp_utc string, detection_result boolean, confidence_score double, rule_detection_result boolean, rule_confidence_score double, valid_signal_ratio double, frequency_drift_hz double, smoothness_score double, notes string, ml_status string, ml_detection_result int, ml_confidence_score double, model_version string"
    raw = spark.read.schema(schema).option("multiLine", "false").json(path)
    return raw.withColumns({"rule_detection_result": F.coalesce("rule_detection_result", "detection_result"), "rule_confidence_score": F.coalesce("rule_confidence_score", "confidence_score")}).drop("detection_result", "confidence_score")


def labelled_rows(features: DataFrame, labels: DataFrame, provenance: dict | None = None) -> DataFrame:
    """Features with their labels, sanitised, as training rows; captures without a label are skipped. The smoothness as measured stays as raw_smoothness_score."""
    out = project_features(features.withColumn("raw_smoothness_score", F.col("smoothness_score"))).join(labels.select("capture_id", F.col("label").cast("int").alias("label")), "capture_id").withColumn("is_synthetic", F.lit(0))
    return out.withColumns({k: F.lit(v) for k, v in (provenance or {}).items()})


def append_labelled(rows: DataFrame, path: str) -> None:
    """Adds rows of :func:`labelled_rows` to a training set of CSV files with a header."""
    rows.write.mode("append").option("header", True).csv(path)


def save_importance(table: DataFrame, path: str) -> None:
    """The importance table (a few rows) as one CSV file, in its order."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_bundle(model, path: str, metadata: dict, names: tuple[str, ...] = FEATURE_NAMES) -> None:
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps({"feature_names": list(names)} | metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")


def load_bundle(spark: SparkSession, path: str):
    """(model, sidecar); a missing or corrupt part, or features that don't fit the model, is a ValueError."""
    try:
        text = "\n".join(r[0] for r in spark.read.text(f"{path}/sidecar").collect())
        sidecar = json.loads(text)
        model = RandomForestClassificationModel.load(f"{path}/model")
    except (AnalysisException, IllegalArgumentException, ValueError) as e:  # no such path, no model of this kind, no JSON
        raise ValueError(f"no usable model at {path}: {e}") from e
    except Py4JJavaError as e:  # MLlib reads a model's parts itself; what isn't a missing or broken part stays an error
        if not any(x in str(e.java_exception) for x in ("InvalidInputException", "FileNotFoundException", "NoSuchElementException", "ParseException", "JsonParseException", "UnsupportedOperationException: empty collection")):
            raise
        raise ValueError(f"no usable model at {path}: {e.java_exception}") from e
    if not isinstance(sidecar, dict):
        raise ValueError("the sidecar is no object")
    names = sidecar.get("feature_names")
    if not isinstance(names, list) or not names or not all(isinstance(n, str) for n in names):
        raise ValueError("the sidecar has no list of feature names")
    if len(names) != model.numFeatures:
        raise ValueError(f"the sidecar names {len(names)} features; the model has {model.numFeatures}")
    return model, sidecar
