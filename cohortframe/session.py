"""Session helpers shared by the bench, the tests and the iterative estimators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "cohortframe") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared checkpoint folder the session names.

    A throw-away folder is used only when the setting is missing *and* the session is local:
    on a cluster a machine-local folder would not survive the loss of its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before fitting on a cluster")
        configured = tempfile.mkdtemp(prefix="cohortframe-checkpoint-")
    context.setCheckpointDir(configured)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage so that later plans start from it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
