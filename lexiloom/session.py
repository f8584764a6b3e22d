"""Session set-up, table loading and durable cut points."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "lexiloom", **conf: str) -> SparkSession:
    """A session with the settings the operators were written for; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable in the Python workers, once for each application.

    The archive is made on the driver and handed to Spark, whose file server gives it to every executor, also to those
    that join later; executors read no folder of the driver's machine.
    """
    context = spark.sparkContext
    if getattr(context, "_lexiloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    with tempfile.NamedTemporaryFile(prefix="lexiloom-", suffix=".zip", delete=False) as made, zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.join("lexiloom", os.path.relpath(full, root)))
    context.addPyFile(made.name)
    context._lexiloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory: one Parquet file or a folder of them."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir`` and that setting is used as it is. Only where it is unset,
    as in local tests, a folder of this machine is taken.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lexiloom-"))
    return configured or context.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores, for steps that spend long on each row.

    Only an input of fewer partitions than cores, a few files of one row group each, is shuffled for it; at scale the
    scan has more partitions by itself and the frame comes back as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: lineage is cut and losing an executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
