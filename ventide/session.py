"""Session settings, shared-folder checkpoints and driver-side stage timing."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on for right results (UTC clock arithmetic, ANSI errors)
# or for scale (runtime re-planning, skewed-join splitting).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles a method beyond 8,000 bytes: a wide step generated as one such method
    # would be interpreted row by row. Beyond it Spark generates smaller methods, one per operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "ventide", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session for local runs; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app).config(
        # Call-site capture costs several driver round trips per column expression.
        "spark.python.sql.dataFrameDebugging.enabled", "false"
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to a session someone else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the session was started."""
    context = spark.sparkContext
    if getattr(context, "_ventide_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [root, *filter(None, [context.environment.get("PYTHONPATH")])]
    context.environment["PYTHONPATH"] = os.pathsep.join(paths)
    base = os.path.join(tempfile.mkdtemp(prefix="ventide-package-"), "ventide")
    context.addPyFile(shutil.make_archive(base, "zip", root, "ventide"))
    context._ventide_shipped = True


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    # The cluster names a shared folder here. Only a local session without one (tests) gets a
    # folder of its own: on a cluster each executor would write to its own disk.
    named = spark.conf.get("spark.checkpoint.dir", None)
    alone = context.master == "local" or context.master.startswith("local[")
    if not named and not alone:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ventide-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write a stage boundary to the shared folder and read from there on.

    Parquet rather than raw rows: a later stage reads only the columns it needs, and Spark
    knows the size before it chooses a join. The files outlive any executor, so a lost one
    costs the tasks it was running and not the stages before. A frame that already is such
    a boundary is returned.
    """
    if getattr(df, "_ventide_stage", False):
        return df
    path = shared_folder(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._ventide_stage = True
    return written


@contextlib.contextmanager
def stage(name: str, report=print):
    """Time a driver-side stage; a failure is reported and raised again."""
    start = time.monotonic()
    report(f"[{name}] started")
    try:
        yield
    except BaseException as error:
        report(f"[{name}] failed after {time.monotonic() - start:.1f}s: {error!r}")
        raise
    report(f"[{name}] finished in {time.monotonic() - start:.1f}s")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work all cores when the input has fewer splits than cores.

    A large input has more splits than cores and passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, e.g. for stream state."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
