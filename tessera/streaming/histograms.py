"""Histograms of unbounded tables: each micro-batch adds its cells, and a reader sums them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.binning import Axis
from tessera.operators import histogram


def fill(stream: DataFrame, folder: str, values: list[Column], axes: list[Axis], weight: Column | None = None) -> StreamingQuery:
    """Write each batch's filled cells below ``folder``; a batch that runs again overwrites its own cells."""

    def add(batch: DataFrame, number: int) -> None:
        cells = histogram.histogram(batch, values, axes, weight, sumw2=True).where("content != 0 OR sumw2 != 0")
        cells.write.mode("overwrite").parquet(f"{folder}/cells/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def contents(df: DataFrame, folder: str, axes: list[Axis]) -> DataFrame:
    """Dense cells of all batches so far; ``df`` is any DataFrame of the session."""
    names = ["bx", "by", "bz"][: len(axes)]
    sums = df.sparkSession.read.parquet(f"{folder}/cells").groupBy(*names).agg(F.sum("content").alias("content"), F.sum("sumw2").alias("sumw2"))
    dense = histogram._grid(df, axes).join(sums, names, "left").na.fill(0.0, ["content", "sumw2"])
    return dense.select(*names, "content", "sumw2", F.sqrt("sumw2").alias("error"))
