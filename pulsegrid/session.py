"""Session and shared-folder settings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pulsegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; cluster defaults win where they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, so that tasks find it wherever the driver was started; once a context."""
    context = spark.sparkContext
    if getattr(context, "_pulsegrid_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="pulsegrid-package-")  # the driver's own; Spark copies the file to every worker
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/pulsegrid", "zip", here.parent, here.name))
    context._pulsegrid_shipped = True


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder reliable checkpoints go to.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary folder; on a cluster the absence of a shared folder is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="pulsegrid-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named


#: Estimated bytes beyond which an estimate says nothing; Spark's own for tables of unknown size is the largest long.
VAGUE_SIZE_BITS = 62


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small state table between the passes of an iterative operator.

    A checkpoint keeps the estimated size of the plan it cuts, and a join's estimate is the product of its sides. Over passes that number
    doubles its digits each time until it fills the driver, so a vague estimate is dropped here.
    """
    spark = df.sparkSession
    shared_checkpoint_dir(spark)
    cut = df.checkpoint(eager=True)
    plan = cut._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() <= VAGUE_SIZE_BITS:
        return cut
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), cut._jdf.schema(), False), spark)
