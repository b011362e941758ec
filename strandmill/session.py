"""Session helpers: tables, checkpoints and the settings that the operators rely on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


BATCH_SETTING, BATCH_BYTES, SPARK_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, for those that can't import it themselves.

    Batches for Python are also kept to ``BATCH_BYTES`` unless the session has another bound than Spark's own: a batch
    is held by the executor and by its worker, and ten thousand long texts would be gigabytes.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_SETTING, None) == SPARK_BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    if getattr(context, "_strandmill_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="strandmill-code-"), "strandmill_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted([*package.rglob("*.py"), *package.rglob("*.toml")]):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._strandmill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data folder; the path may be in any store Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only in local mode, where one machine is
    all there is, may that be unset: then a folder of this process is made and set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="strandmill-")
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder as parquet and read it back.

    This cuts the lineage as a checkpoint does, stays readable when executors are lost,
    and is columnar, so later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/strandmill-{uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._strandmill_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what ``durable`` wrote for ``frames``; only when nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_strandmill_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
