"""Axes of binned aggregates: bins, edges, labels, and the bin of a value as a column expression.

Bin 0 is underflow, bins 1 to n are half-open on the right, bin n + 1 is overflow.  Null and NaN have no bin:
expressions give null for them, and aggregates leave them out (``histogram.unbinned`` counts them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """Equal bins between ``low`` and ``high``, or the bins between ``cuts``."""

    n: int
    low: float
    high: float
    cuts: tuple[float, ...] = ()
    labels: tuple[tuple[str | None, int], ...] = ()  # (name, bin) in list order

    @staticmethod
    def fixed(n: int, low: float, high: float) -> Axis:
        if n <= 0 or not low < high:
            raise ValueError("an axis needs a positive number of bins and low < high")
        return Axis(n, float(low), float(high))

    @staticmethod
    def variable(edges: list[float]) -> Axis:
        """Equal neighbouring edges are allowed: their bin stays empty."""
        if len(edges) < 2 or any(b < a for a, b in zip(edges, edges[1:], strict=False)):
            raise ValueError("an axis needs two edges or more, in ascending order")
        cuts = tuple(map(float, edges))
        return Axis(len(cuts) - 1, cuts[0], cuts[-1], cuts)

    @staticmethod
    def labelled(names: list[str]) -> Axis:
        return Axis(len(names), 0.0, float(len(names)), labels=tuple((name, i + 1) for i, name in enumerate(names)))

    def edges(self) -> list[float]:
        width = (self.high - self.low) / self.n
        return list(self.cuts) or [self.low + width * i for i in range(self.n + 1)]

    def low_edge(self, i: int) -> float:
        """Low edge of bin i; rounds unlike ``edges`` by design."""
        return self.cuts[i - 1] if self.cuts else self.low + (self.high - self.low) * (i - 1) / self.n

    def width(self, i: int) -> float:
        return self.cuts[i] - self.cuts[i - 1] if self.cuts else (self.high - self.low) / self.n

    def centers(self) -> list[float]:
        e = self.edges()
        return [(a + b) / 2 for a, b in zip(e, e[1:], strict=False)]

    def names(self) -> list[str]:
        """Labels in list order, without nulls."""
        return [name for name, _ in self.labels if name is not None]

    def find(self, x: Column) -> Column:
        """The bin of a value."""
        x = x.cast("double")
        known = x.isNotNull() & ~F.isnan(x)
        if not self.cuts:
            return F.when(known, F.width_bucket(x, F.lit(self.low), F.lit(self.high), F.lit(self.n).cast("long"))).cast("int")
        within = F.size(F.filter(F.array(*map(F.lit, self.cuts)), lambda e: e <= x))
        return F.when(known, F.when(x < self.low, 0).when(x >= self.high, self.n + 1).otherwise(F.least(F.greatest(within, F.lit(1)), F.lit(self.n)))).cast("int")

    def find_label(self, name: Column) -> Column:
        """The bin of a label; null for a name that the axis lacks."""
        out = F.lit(None).cast("int")
        for label, i in reversed(self.labels):
            if label is not None:
                out = F.when(name == label, i).otherwise(out)
        return out

    def inside(self, bin_: Column) -> Column:
        return (bin_ >= 1) & (bin_ <= self.n)

    def bins(self, spark: SparkSession, name: str = "bin") -> DataFrame:
        """All n + 2 bins as rows."""
        return spark.range(self.n + 2).select(F.col("id").cast("int").alias(name))

    def table(self, spark: SparkSession) -> DataFrame:
        """(bin, low, high, width, center) of the n inner bins."""
        width = F.lit(self.high - self.low)
        inner = spark.range(1, self.n + 1).select(F.col("id").cast("int").alias("bin"))
        if self.cuts:
            cuts = F.array(*map(F.lit, self.cuts))
            low, high = F.get(cuts, F.col("bin") - 1), F.get(cuts, F.col("bin"))
        else:
            low = F.lit(self.low) + (width / self.n) * (F.col("bin") - 1)
            high = F.lit(self.low) + (width / self.n) * F.col("bin")
        first = low if self.cuts else F.lit(self.low) + width * (F.col("bin") - 1) / self.n
        each = high - low if self.cuts else width / self.n
        return inner.select("bin", low.alias("low"), high.alias("high"), first.alias("low_edge"), each.alias("width"), ((low + high) / 2).alias("center"))


def flat_cell(bins: list[Column], axes: list[Axis]) -> Column:
    """1-based cell number of one to three bins; the first axis runs fastest."""
    out, stride = F.lit(1), 1
    for b, axis in zip(bins, axes, strict=True):
        out, stride = out + b * stride, stride * (axis.n + 2)
    return out
