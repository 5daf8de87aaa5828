"""Named tables in cycles: every write of a name adds a cycle, and readers see only committed ones.

A store is a folder with Parquet data, one folder a cycle, and a catalog of keys.  A cycle becomes visible when its key
is appended, after its data are committed; what a lost writer left behind has no key and is never read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.codecs import LATEST

KEYS = "name string, cycle int, kind string, title string, path string, entries long, position long"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below ``spark.checkpoint.dir``: what reads it twice sees the same rows, however they were dealt.

    Only a local session without that setting (tests, a laptop) gets a local folder; elsewhere the setting is needed.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keys(spark: SparkSession, store: str) -> DataFrame:
    """The catalog; empty for a new store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/keys")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(KEYS).parquet(f"{store}/keys") if there else spark.createDataFrame([], KEYS)


def write(df: DataFrame, store: str, name: str, title: str = "", kind: str = "table") -> int:
    """Add a cycle of ``name``; returns its number.  One writer a store at a time."""
    spark = df.sparkSession
    path = f"{store}/data/{uuid.uuid4().hex}"
    df.write.parquet(path)
    have = keys(spark, store).agg(F.max(F.when(F.col("name") == name, F.col("cycle"))).alias("cycle"), F.count("*").alias("n")).collect()[0]
    cycle = (have.cycle or 0) + 1
    row = (name, cycle, kind, title or name, path, spark.read.parquet(path).count(), have.n)
    spark.createDataFrame([row], KEYS).coalesce(1).write.mode("append").parquet(f"{store}/keys")
    return cycle


def read(spark: SparkSession, store: str, name: str, cycle: int = LATEST, columns: list[str] | None = None) -> DataFrame:
    """A table's latest or given cycle; ``columns`` reach the scan.  ``name;cycle`` is understood too."""
    if ";" in name:
        head, _, tail = name.rpartition(";")
        if tail == "*" or tail.isdigit():
            name, cycle = head, LATEST if tail == "*" else int(tail)
    from tessera.operators import catalog  # which stores its steps here

    found = catalog.find(keys(spark, store), name, cycle).select("path").collect()
    if not found:
        raise KeyError(f"{name};{cycle}")
    out = spark.read.parquet(found[0].path)
    return out.select(*columns) if columns else out


def chain(tables: list[DataFrame]) -> DataFrame:
    """Tables one after another; a column that one lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
