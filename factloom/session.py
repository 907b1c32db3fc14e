"""Session helpers: reading tables, and written tables that cut lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, read lazily: columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names, or, where none is named, a folder set here.

    A folder of this machine is only set on a local master, where driver and executors are one process, and is removed
    at the end of the process.
    """
    named = spark.conf.get(SHARED, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {SHARED} to a folder that all executors reach")
    own = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(SHARED, "file://" + own)
    return "file://" + own


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a table written once to the shared folder: its lineage ends there, and a lost executor costs no rerun of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table from written() that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def paths(spark: SparkSession, pattern: str) -> list[str]:
    """The files and folders that match a pattern, in the order of their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().toString() for f in found)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of text that is there whole or not at all: it is written under another name first."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new(path + ".part"))
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.rename(new(path + ".part"), new(path))


def latest(df: DataFrame, key: str, version: str = "loaded_at") -> DataFrame:
    """One whole row per key: that of the greatest version, and of rows equal in it the one greatest in its other columns.

    Rows whose key is null are left out. Rows are reduced before the shuffle by a partial max.
    """
    rest = [c for c in df.columns if c not in (key, version)]
    order = F.struct(F.col(version), *[F.col(c) for c in rest])
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("_row"))
    return picked.select(*[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
