"""Point lists with no, symmetric or asymmetric errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import columns


def graph(df: DataFrame, order: list[Column], x: Column, y: Column, x_errors: tuple[Column, ...] = (), y_errors: tuple[Column, ...] = ()) -> DataFrame:
    """(idx, x, y, exlow, exhigh, eylow, eyhigh): errors are zero, one column for both sides, or (low, high).

    Points are numbered by ``order``, which needs to be one total order over the points; no task numbers all of them.
    """

    def sides(errors: tuple[Column, ...]) -> tuple[Column, Column]:
        if len(errors) > 2:
            raise ValueError("errors are none, one column, or a low and a high column")
        low, high = (errors[0], errors[-1]) if errors else (F.lit(0.0), F.lit(0.0))
        return low.cast("double"), high.cast("double")

    (xl, xh), (yl, yh) = sides(x_errors), sides(y_errors)
    by = {f"_by{i}": c for i, c in enumerate(order)}
    values = {"x": x.cast("double"), "y": y.cast("double"), "exlow": xl, "exhigh": xh, "eylow": yl, "eyhigh": yh}
    numbered = columns.entries(df.select(*[c.alias(k) for k, c in (by | values).items()]), *by)
    return numbered.select(F.col("entry").cast("int").alias("idx"), *values)


def points(g: DataFrame) -> DataFrame:
    return g.select("idx", "x", "y")


def x_errors(g: DataFrame) -> DataFrame:
    return g.select("idx", F.col("exlow").alias("low"), F.col("exhigh").alias("high"))


def y_errors(g: DataFrame) -> DataFrame:
    return g.select("idx", F.col("eylow").alias("low"), F.col("eyhigh").alias("high"))
