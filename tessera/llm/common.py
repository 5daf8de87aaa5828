"""What several training-data operators share: the shared folder, written tables and salted joins."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of a word: a run of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: The ASCII white space between words, as characters.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting (tests, a laptop) gets a local folder; elsewhere the setting is needed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables written in the innermost open ``scratch`` of this thread.
_OPEN: ContextVar[list[str] | None] = ContextVar("tessera_scratch", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    if (own := _OPEN.get()) is not None:
        own.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new shared folder for files that tasks write; it goes with the tables of the open ``scratch``."""
    path = shared_dir(spark, name)
    if (own := _OPEN.get()) is not None:
        own.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession, keep: int = 1) -> Iterator[None]:
    """Deletes the tables written inside, when it ends, but the last ``keep``: those hold all that is still wanted of them."""
    outer, own = _OPEN.get(), []
    token = _OPEN.set(own)
    try:
        yield
    finally:
        _OPEN.reset(token)
    deleted(spark, own[:-keep])
    if outer is not None:
        outer += own[-keep:]


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or path and the path in it; works in tasks and on the driver."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, salts: int = 32, parts: int | None = None) -> DataFrame:
    """Left join whose left rows of one key are dealt over ``salts`` tasks by ``spread``.

    ``right`` has a row a key at most; it is repeated once a salt, so keep it narrow.  ``parts`` is the number of
    partitions, where rows have been counted.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if parts:
        salted, repeated = (x.repartition(parts, *keys, "_salt") for x in (salted, repeated))
    return salted.join(repeated, [*keys, "_salt"], "left").drop("_salt")


def utf8(text: str = "text") -> Column:
    """A text column as bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def slices(texts: list[str], most: int) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters, so that a task's arrays stay small; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def exact(name: str) -> Column:
    """A long id column as a decimal, which pandas keeps exact where nulls would turn longs into doubles."""
    return F.col(name).cast("decimal(20,0)").alias(name)


def held_out() -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(documents: DataFrame, labels: DataFrame, label: str, most: int, longest: int) -> list[tuple[str, int]]:
    """At most ``most`` labelled texts of either class outside the held-out fold, chosen by a hash of the id.

    Texts of over ``longest`` characters do not take part.  Of labels that a document has twice the larger holds.
    """
    known = labels.where(~held_out() & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    chosen = [known.where(F.col("_label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    rows = documents.where(F.length("text") <= longest).select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # at most 2 * most ids
    return sorted((r["text"], r["_label"]) for r in rows.select("text", "_label").limit(4 * most).collect())


def text_slices(batch: pa.RecordBatch, most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """An Arrow batch in slices of about ``most`` bytes of text, so that few texts are Python objects at a time."""
    size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def per_worker(name: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in a Python worker: Spark gives a worker many tasks."""
    kept = vars(sys.modules.setdefault("tessera_kept", types.ModuleType("tessera_kept")))
    if name not in kept:
        kept[name] = make()
    return kept[name]
