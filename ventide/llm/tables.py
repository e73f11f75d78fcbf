"""Reading, shared-folder boundaries and settings of the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventide.session import prepare, shared_folder
from ventide.sources.testdata import table  # noqa: F401

# Arrow batches are bounded by bytes as well as rows: one batch of long texts must not fill a
# worker's memory.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20

# Paths written inside each `settled` that is under way, innermost last.
_ON_THE_WAY: list[list[str]] = []


def ready(spark: SparkSession) -> SparkSession:
    """Apply the settings that the operators rely on."""
    prepare(spark)
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        if spark.conf.get(key, None) != str(value):
            spark.conf.set(key, str(value))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it from there: the lineage ends here, and a lost
    executor costs only what it was running.

    Shuffle files of the finished job are only removed when the driver's garbage is collected;
    that is asked for here, so that they do not stay beside the written table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark, name)}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    if _ON_THE_WAY:
        _ON_THE_WAY[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def settled(compute: Callable[[], DataFrame], name: str) -> DataFrame:
    """`stored` of what `compute` returns. The tables that it stored on its way are deleted once the result
    is written, so that no later step carries them along; nothing else may read them."""
    _ON_THE_WAY.append([])
    try:
        out = stored(compute(), name)
    finally:
        passed = _ON_THE_WAY.pop()
    last = passed.pop()  # the result itself
    if _ON_THE_WAY:
        _ON_THE_WAY[-1].append(last)
    spark = out.sparkSession
    for path in passed:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return out


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not use yet (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text) -> F.Column:
    """Words of a text column; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
