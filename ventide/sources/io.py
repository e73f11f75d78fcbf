"""Readers and writers for the raw tables, stage artifacts and JSON-line records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventide.sources.schemas import TABLES


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _filesystem(spark, path)
    return fs.exists(where)


def table_path(spark: SparkSession, root: str, table: str) -> str | None:
    """Where a raw CSV lies: root/module/t.csv.gz, root/module/t.csv or with one more
    folder of the file's own name in between. None if it is nowhere."""
    module, _ = TABLES[table]
    for name in (f"{table}.csv.gz", f"{table}.csv"):
        for folder in (f"{root}/{module}", f"{root}/{module}/{name}", root):
            candidate = f"{folder}/{name}"
            if exists(spark, candidate):
                return candidate
    return None


def require_tables(spark: SparkSession, root: str, tables: Iterable[str] = tuple(TABLES)) -> dict:
    """Locate every table before any plan is built; report all missing ones at once."""
    found = {t: table_path(spark, root, t) for t in tables}
    missing = sorted(t for t, path in found.items() if path is None)
    if missing:
        raise FileNotFoundError(f"missing under {root}: {', '.join(missing)}")
    return found


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Quoted CSV in which a doubled quote stands for a quote."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", False)
        .csv(path)
    )


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    path = require_tables(spark, root, [table])[table]
    return read_csv(spark, path, TABLES[table][1])


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_sorted(
    df: DataFrame, path: str, keys: Sequence[str], partitions: int | None = None
) -> None:
    """ZSTD Parquet ordered by `keys` across files and inside each file."""
    by = [partitions, *keys] if partitions else list(keys)
    (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .parquet(path)
    )


def write_json_lines(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("compression", "gzip")
        .option("ignoreNullFields", "false")
        .json(path)
    )


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_document(spark: SparkSession, path: str, document: Mapping) -> None:
    """A small JSON document (a manifest, a report) next to the data."""
    fs, where = _filesystem(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(json.dumps(document, indent=2, default=str).encode()))
    finally:
        stream.close()


def read_document(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0]["value"])


def fingerprint(spark: SparkSession, path: str) -> str:
    """size:mtime of a file, or a digest of the listing of a folder."""
    fs, where = _filesystem(spark, path)
    status = fs.getFileStatus(where)
    if not status.isDirectory():
        return f"{status.getLen()}:{status.getModificationTime()}"
    parts = sorted(
        f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}"
        for s in fs.listStatus(where)
    )
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


def run_stage(
    spark: SparkSession,
    name: str,
    sources: Sequence[str],
    output: str,
    config: str,
    build,
    force: bool = False,
) -> bool:
    """Run `build()` unless the manifest says the output already belongs to these inputs.

    The manifest holds the configuration hash and one fingerprint per source. A failed
    build leaves no output behind.
    """
    manifest = f"{output}.manifest.json"
    wanted = {
        "stage": name,
        "config": config,
        "sources": {s: fingerprint(spark, s) for s in sources},
    }
    if not force and exists(spark, output) and exists(spark, manifest):
        if read_document(spark, manifest) == wanted:
            return False
    try:
        build()
    except BaseException:
        fs, where = _filesystem(spark, output)
        fs.delete(where, True)
        raise
    write_document(spark, manifest, wanted)
    return True


def content_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """SHA-256 per file of a folder, computed where the bytes are read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    )
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def accounting(frames: Mapping[str, DataFrame], stay: str, subject: str) -> DataFrame:
    """Rows, stays and patients of each named frame, in one table."""
    parts = []
    for label, df in frames.items():
        patients = (
            F.countDistinct(subject) if subject in df.columns else F.lit(None).cast("long")
        )
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("rows"),
                F.countDistinct(stay).alias("stays"),
                patients.alias("patients"),
            ).select(F.lit(label).alias("stage"), "rows", "stays", "patients")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
