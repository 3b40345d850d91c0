"""Dataset files: text series format, catalogs, labelled CSV, JSON logs and cases, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_ts(spark: SparkSession, path: str, has_label: bool = True):
    """(points, labels, headers) of ``.ts`` text files.

    Data lines hold one case: dimensions split by ':', values by ',', '?' for
    missing, the last field the class label.  Header lines start with '@'.  The
    reader splits by line, so one large file spreads over tasks; a case is known
    by its file and a running line number.
    """
    raw = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    lines = raw.where((F.length("line") > 0) & ~F.col("line").startswith("#"))
    head = lines.where(F.col("line").startswith("@")).select(
        "file", F.lower(F.regexp_extract("line", r"^@(\S+)", 1)).alias("name"), F.trim(F.regexp_extract("line", r"^@\S+\s*(.*)$", 1)).alias("value"))
    cases = lines.where(~F.col("line").startswith("@")).select("file", F.monotonically_increasing_id().alias("case_id"), F.split("line", ":").alias("_p"))
    dims = F.slice("_p", 1, F.size("_p") - 1) if has_label else F.col("_p")
    label = F.trim(F.element_at("_p", -1)) if has_label else F.lit("")
    cases = cases.select("file", "case_id", label.alias("label"), dims.alias("_d"))
    chan = cases.select("file", "case_id", F.posexplode("_d").alias("channel", "_v"))
    pts = chan.select("file", "case_id", "channel", F.posexplode(F.split("_v", ",")).alias("t", "_x"))
    points = pts.where(F.trim("_x") != "").select("file", "case_id", "channel", "t", F.trim("_x").try_cast("double").alias("value"))
    return points, cases.select("file", "case_id", "label"), head


def unequal_lengths(points: DataFrame) -> DataFrame:
    """Files whose cases differ in length or channel count; empty when the format rule holds."""
    n = points.groupBy("file", "case_id", "channel").agg((F.max("t") + 1).alias("n"))
    c = n.groupBy("file", "case_id").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("a"), F.max("n").alias("b"))
    return c.groupBy("file").agg(F.min("a").alias("min_length"), F.max("b").alias("max_length"), F.min("k").alias("min_channels"),
                                 F.max("k").alias("max_channels")).where("min_length <> max_length or min_channels <> max_channels")


DATASET = T.StructType([T.StructField("name", T.StringType()), T.StructField("n_channels", T.IntegerType()),
                        T.StructField("series_length", T.IntegerType()), T.StructField("classes", T.ArrayType(T.StringType()))])
ARTIFACT = T.StructType([T.StructField("artifact_id", T.StringType()), T.StructField("family", T.StringType()), T.StructField("dataset", T.StringType()),
                         T.StructField("input_shape", T.ArrayType(T.IntegerType())), T.StructField("label_space", T.ArrayType(T.StringType()))])
FAMILY = T.StructType([T.StructField("family", T.StringType()), T.StructField("supported_datasets", T.ArrayType(T.StringType()))])


def read_catalog(spark: SparkSession, path: str, register: bool = True) -> dict[str, DataFrame]:
    """Catalog tables of a manifest JSON with ``datasets``, ``artifacts`` and ``families`` arrays."""
    schema = T.StructType([T.StructField("datasets", T.ArrayType(DATASET)), T.StructField("artifacts", T.ArrayType(ARTIFACT)),
                           T.StructField("families", T.ArrayType(FAMILY))])
    m = spark.read.schema(schema).option("multiLine", True).json(path)
    out = {k: m.select(F.explode(k).alias("_r")).select("_r.*") for k in ("datasets", "artifacts", "families")}
    if register:
        for k, d in out.items():
            d.createOrReplaceTempView(f"catalog_{k}")
    return out


def compatibility(datasets: DataFrame, artifacts: DataFrame, families: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages of each requested (dataset, artifact) pair; none means compatible."""
    d = datasets.select(F.col("name").alias("dataset_name"), "n_channels", "series_length")
    a = artifacts.select("artifact_id", "family", F.col("dataset").alias("declared_for"), "input_shape")
    j = (requests.join(d, "dataset_name", "left").join(a, "artifact_id", "left").join(families, "family", "left"))
    msg = F.array_compact(F.array(
        F.when(F.col("n_channels").isNull(), "unknown_dataset"), F.when(F.col("declared_for").isNull(), "unknown_artifact"),
        F.when(F.col("declared_for").isNotNull() & F.col("supported_datasets").isNull(), "unsupported_family"),
        F.when(~F.array_contains("supported_datasets", F.col("dataset_name")), "family_does_not_support_dataset"),
        F.when(F.col("declared_for") != F.col("dataset_name"), "artifact_declared_for_other_dataset"),
        F.when(F.get("input_shape", F.lit(0)) != F.col("n_channels"), "channel_mismatch"),
        F.when(F.get("input_shape", F.lit(1)) != F.col("series_length"), "length_mismatch")))
    return j.select("dataset_name", "artifact_id", msg.alias("messages")).withColumn("is_compatible", F.size("messages") == 0)


def split_sample(prepared: DataFrame, split: str, chosen: Column) -> DataFrame:
    """Points of the chosen samples of one split, with the name of their class."""
    names = prepared.select("label").distinct().withColumn("class_name", F.concat(F.lit("class_"), "label"))
    return prepared.where((F.col("split") == split) & chosen).join(names, "label").select("series_id", "channel", "t", "value", "class_name")


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled segments whose cells are JSON arrays: label, values, ctx_pre, ctx_post."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    arr = lambda c: F.from_json(F.coalesce(F.col(c), F.lit("[]")), "array<double>")
    return raw.select("label", arr("values").alias("v"), arr("ctx_pre").alias("pre"), arr("ctx_post").alias("post"))


SESSION = "sessionId string, seriesId string, segmentationId string, startedAt string, endedAt string, events array<struct<" \
    "eventId string, timestamp string, eventType string, operation struct<operationType string, targetSegmentIds array<string>>, " \
    "operationResult struct<status string>, constraintEvaluation struct<status string>, suggestion struct<suggestionId string, decision string, source string>>>"


def read_session_logs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One row per event of exported session logs, 1-based sequence."""
    s = spark.read.schema(SESSION).option("multiLine", multiline).json(path)
    e = s.select("sessionId", "startedAt", "endedAt", F.posexplode_outer("events").alias("_i", "_e"))
    return e.select(F.col("sessionId").alias("session_id"), "startedAt", "endedAt", (F.col("_i") + 1).alias("sequence"),
                    F.to_timestamp("_e.timestamp").alias("ts"), F.col("_e.eventType").alias("event_type"),
                    F.col("_e.operation.operationType").alias("operation_type"), F.col("_e.operation.targetSegmentIds").alias("target_segment_ids"),
                    F.col("_e.operationResult.status").alias("result_status"), F.col("_e.constraintEvaluation.status").alias("evaluation_status"),
                    F.col("_e.suggestion").alias("suggestion"))


CASE = "fixtureId string, seriesId string, segmentationId string, seriesLength int, notes string, prototypeDriftValues array<double>, " \
    "groundTruth struct<segments array<struct<segmentId string, startIndex int, endIndex int, label string>>>, " \
    "prediction struct<segments array<struct<segmentId string, startIndex int, endIndex int, label string>>>"


def read_cases(spark: SparkSession, path: str, multiline: bool = True):
    """(segments of both sides, drift values) of evaluation case files."""
    c = spark.read.schema(CASE).option("multiLine", multiline).json(path)

    def side(col, tag):
        return c.select(F.col("fixtureId").alias("series_id"), F.lit(tag).alias("side"), F.explode(f"{col}.segments").alias("_s")).select(
            "series_id", "side", F.col("_s.segmentId").alias("segment_id"), F.col("_s.startIndex").alias("start_index"),
            F.col("_s.endIndex").alias("end_index"), F.col("_s.label").alias("label"))
    drift = c.select(F.col("fixtureId").alias("series_id"), F.explode("prototypeDriftValues").alias("value"))
    return side("groundTruth", "gt").unionByName(side("prediction", "pred")), drift


# --- sinks ---------------------------------------------------------------------------------

def write_prepared(points: DataFrame, path: str, force: bool = False) -> bool:
    """Prepared points partitioned by (dataset, split); only the partitions at hand are replaced.

    Without ``force`` an existing dataset is left alone.  Returns whether it wrote.
    """
    spark = points.sparkSession
    if not force:
        jvm, sc = spark._jvm, spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        if fs.exists(p):
            have = spark.read.parquet(path).select("dataset").distinct()
            points = points.join(have, "dataset", "left_anti")
            if points.isEmpty():
                return False
    (points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "split").parquet(path))
    return True


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


AUDIT_COLUMNS = ["timestamp", "tier", "op", "segment_id", "pre_shape", "post_shape", "rule_class", "compensation_mode", "plausibility_badge", "constraint_residual"]


def write_audit_csv(rows: DataFrame, path: str) -> None:
    """Ten audit columns; nested residuals become JSON text."""
    nested = isinstance(rows.schema["constraint_residual"].dataType, (T.StructType, T.ArrayType, T.MapType))
    res = F.to_json("constraint_residual") if nested else F.col("constraint_residual")
    rows.select(*AUDIT_COLUMNS[:-1], res.alias("constraint_residual")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_audit_json(rows: DataFrame, path: str) -> None:
    rows.select(*AUDIT_COLUMNS).write.mode("overwrite").json(path)


def dataset_summary(points: DataFrame) -> DataFrame:
    """Shape, class count and missing flag per (dataset, split)."""
    return points.groupBy("dataset", "split").agg(
        F.countDistinct("series_id").alias("n_samples"), F.countDistinct("channel").alias("n_channels"), F.countDistinct("t").alias("series_length"),
        F.countDistinct("label").alias("n_classes"), F.bool_or(F.col("value").isNull() | F.isnan("value")).alias("has_missing"))
