"""Session settings the operators are written for."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on; leave cluster sizing to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Parse a JSON record once; the rewrite would parse it again for every field read.
    spark.conf.set("spark.sql.optimizer.enableJsonExpressionOptimization", "false")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    # The driver serves this file to the executors itself; they do not open the path.
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}-{digest}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in files:
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints. Only a session on one machine may go without naming one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current


#: Whether Spark removes the shuffle files of a finished execution, rather than when the driver next collects garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a frame to a table in the shared checkpoint folder and read it back.

    Used where a frame feeds several branches: the branches then scan a pruned columnar
    table instead of each repeating the work, the plan stays small, and an executor lost
    later costs a re-read only. Once the table is written, the shuffle files behind it go: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/palimpsest-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLES_GO)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)
