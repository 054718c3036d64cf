"""Baselines and score histories in files, and tables in the folder that the driver and all executors share."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.findings import baseline_entries

VERSION = "lintlake.baseline.v1"
_ENTRY = "fingerprint string, ruleId string, filePath string, line int, symbol string, message string"
_CONF = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
_own: dict[str, str] = {}


def write_baseline(findings: DataFrame, folder: str) -> None:
    """Writes the entries of a findings table as JSON lines, each with the version."""
    rows = baseline_entries(findings).withColumnsRenamed({"rule_id": "ruleId", "file_path": "filePath"})
    rows.withColumn("schemaVersion", F.lit(VERSION)).write.mode("overwrite").json(folder)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries that `write_baseline` wrote to a folder, or of one JSON document with `entries`; another version is an error when the rows are read."""
    whole = f"schemaVersion string, entries array<struct<{_ENTRY.replace(' ', ':').replace(',:', ',')}>>"
    if os.path.isfile(path):
        rows = spark.read.schema(whole).option("multiLine", True).json(path).select("schemaVersion", F.inline("entries"))
    else:
        rows = spark.read.schema(f"{_ENTRY}, schemaVersion string").json(path)
    wrong = F.raise_error(F.concat(F.lit("baseline has version "), F.coalesce("schemaVersion", F.lit("none"))))
    known = F.col("schemaVersion").rlike(r"^[\w-]+\.baseline\.v1$")
    checked = rows.withColumn("fingerprint", F.when(known, F.col("fingerprint")).otherwise(wrong))
    return checked.drop("schemaVersion").withColumnsRenamed({"ruleId": "rule_id", "filePath": "file_path"})


def record_history(path: str, findings: int, score: float, keep: int = 100) -> list[dict]:
    """Appends a run to a history file and keeps the last ones."""
    history = json.load(open(path, encoding="utf-8")) if os.path.exists(path) else []
    history = [*history, {"recordedAt": datetime.now(UTC).isoformat(), "findings": findings, "score": score}][-keep:]
    with open(path, "w", encoding="utf-8") as out:
        json.dump(history, out, indent=2)
    return history


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    found = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_CONF} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lintlake-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet under the shared folder and read back.

    That cuts the lineage: whatever reads it later survives the loss of the executors that made it.
    Meanwhile an Arrow batch holds no more than `BATCH_BYTES`, so that a Python worker never holds 10,000 long texts at once.
    """
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that `written` made and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
