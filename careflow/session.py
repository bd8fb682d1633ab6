"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Input bytes per shuffle partition, small enough to sort in an executor's share of memory.
PARTITION_BYTES = 128 * 1024 * 1024


def get_session(
    app: str = "careflow", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Session with the settings the operators count on.

    `input_bytes` sizes the shuffles for the data; adaptive execution joins
    partitions that turn out small. On a cluster `spark.checkpoint.dir` must name
    a folder every executor sees.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    if input_bytes:
        settings.setdefault("spark.sql.shuffle.partitions", str(max(200, input_bytes // PARTITION_BYTES)))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Rows that Spark hands to a Python worker at once: texts are long, and a worker keeps what it once took.
ARROW_ROWS = 2000
ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, so queries run from any folder, and bounds the rows
    they take at once. Once per session."""
    sc = spark.sparkContext
    if spark.conf.get("careflow.shipped", "") == sc.applicationId:
        return
    if int(spark.conf.get(ARROW_SETTING)) > ARROW_ROWS:
        spark.conf.set(ARROW_SETTING, str(ARROW_ROWS))
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="careflow-ship-")) / "careflow.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    spark.conf.set("careflow.shipped", sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="careflow-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path inside the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder, so later reads see the same rows and
    partitions even after executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once into Parquet files in the shared folder. Later reads take only the
    columns they need, and joins know the size."""
    if "void" in df.schema.simpleString():
        return materialise(df)  # files cannot hold columns without a type
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
