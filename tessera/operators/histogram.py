"""Histograms and profiles: one grouped aggregation, then a join with the dense grid of bins.

Only bins with rows are shuffled, as partial sums; the grid is as large as the axes say, whatever the data's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.binning import Axis, flat_cell

#: Cell types and the ranges of the whole-number ones.
CELLS = {"byte": 7, "short": 15, "int": 31, "long": 63, "float": 0, "double": 0}


def _binned(df: DataFrame, values: list[Column], axes: list[Axis], weight: Column | None) -> DataFrame:
    names = ("bx", "by", "bz")[: len(axes)]
    named = df.select(*[v.cast("double").alias(f"v{n}") for v, n in zip(values, names, strict=True)], (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    return named.withColumns({n: a.find(F.col(f"v{n}")) for n, a in zip(names, axes, strict=True)}).na.drop(subset=list(names))


def _grid(df: DataFrame, axes: list[Axis]) -> DataFrame:
    """All cells, flow bins included, without a cross join: cell numbers divide into bins."""
    sizes = [a.n + 2 for a in axes]
    total = 1
    for s in sizes:
        total *= s
    out, rest = df.sparkSession.range(total), F.col("id")
    for n, s in zip(("bx", "by", "bz"), sizes, strict=False):
        out, rest = out.withColumn(n, (rest % s).cast("int")), F.floor(rest / s)
    return out


def celled(content: Column, cell: str) -> Column:
    """Contents in the cell's type; a whole-number cell refuses fractions and values beyond its range."""
    if cell not in CELLS:
        raise ValueError(f"cells are one of {', '.join(CELLS)}")
    if not CELLS[cell]:
        return content.cast(cell)
    bad = (content != F.floor(content)) | (F.abs(content) >= float(2 ** CELLS[cell]))
    return F.when(bad, F.raise_error(F.lit(f"content does not fit a {cell} cell"))).otherwise(content).cast(cell)


def histogram(df: DataFrame, values: list[Column], axes: list[Axis], weight: Column | None = None, sumw2: bool = False, cell: str = "double") -> DataFrame:
    """Dense cells of a one- to three-dimensional histogram: bins, flat cell, content and error.

    The error is the root of |content|, or of the sum of squared weights where ``sumw2`` asks for it.
    """
    names = ["bx", "by", "bz"][: len(axes)]
    sums = _binned(df, values, axes, weight).groupBy(*names).agg(F.sum("w").alias("content"), F.sum(F.col("w") * F.col("w")).alias("sumw2"))
    dense = _grid(df, axes).join(sums, names, "left").na.fill(0.0, ["content", "sumw2"])
    content = celled(F.col("content"), cell)
    error = F.sqrt("sumw2") if sumw2 else F.sqrt(F.abs("content"))
    kept = [F.col("sumw2")] if sumw2 else []
    return dense.select(*names, flat_cell([F.col(n) for n in names], axes).alias("cell"), content.alias("content"), *kept, error.alias("error"))


def reset_sumw2(cells: DataFrame) -> DataFrame:
    """Sums of squared weights start anew at |content|."""
    return cells.withColumn("sumw2", F.abs("content").cast("double")).withColumn("error", F.sqrt("sumw2"))


def statistics(df: DataFrame, values: list[Column], axes: list[Axis], weight: Column | None = None) -> DataFrame:
    """One row: entries count every fill; the moments only fills inside all axes."""
    rows = _binned(df, values, axes, weight)
    names = ["bx", "by", "bz"][: len(axes)]
    inside = F.lit(True)
    for n, a in zip(names, axes, strict=True):
        inside = inside & a.inside(F.col(n))
    kept = lambda c: F.coalesce(F.sum(F.when(inside, c)), F.lit(0.0))
    w = F.col("w")
    out = [F.count("*").alias("entries"), kept(w).alias("sumw"), kept(w * w).alias("sumw2")]
    for n in names:
        v, axis = F.col(f"v{n}"), n[1]
        out += [kept(w * v).alias(f"sumw{axis}"), kept(w * v * v).alias(f"sumw{axis}2")]
    for i, n in enumerate(names):
        out += [kept(w * F.col(f"v{n}") * F.col(f"v{m}")).alias(f"sumw{n[1]}{m[1]}") for m in names[i + 1 :]]
    return rows.agg(*out)


def unbinned(df: DataFrame, values: list[Column]) -> DataFrame:
    """How many rows a null or NaN keeps out of every bin."""
    bad = F.lit(False)
    for v in values:
        bad = bad | v.isNull() | F.isnan(v.cast("double"))
    return df.agg(F.count(F.when(bad, 1)).alias("n_unbinned"))


def label_histogram(df: DataFrame, name: Column, axis: Axis, weight: Column | None = None) -> DataFrame:
    """Contents by label, in list order; names that the axis lacks are left out."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    sums = df.select(axis.find_label(name).alias("bin"), w.alias("w")).na.drop(subset=["bin"]).groupBy("bin").agg(F.sum("w").alias("content"))
    return axis.bins(df.sparkSession).join(sums, "bin", "left").na.fill(0.0, ["content"])


#: What a profile's error is: of the mean, the spread, of the mean of whole numbers, of a mean of unit-variance values.
MODES = ("mean", "spread", "integer", "gauss")


def profile(df: DataFrame, keys: list[Column], axes: list[Axis], value: Column, mode: str = "mean", weight: Column | None = None, weighted: bool = True) -> DataFrame:
    """Dense cells of a profile: entries (sum of weights), effective entries, content (mean of ``value``) and error.

    ``weighted=False`` leaves out the sums of squared weights: effective entries are then the sums of weights.
    """
    if mode not in MODES:
        raise ValueError(f"modes are {', '.join(MODES)}")
    names = ["bx", "by", "bz"][: len(axes)]
    rows = _profiled(df, keys, axes, value, weight)
    w, y = F.col("w"), F.col("y")
    sums = rows.groupBy(*names).agg(F.sum("w").alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swy2"))
    dense = _grid(df, axes).join(sums, names, "left").na.fill(0.0, ["sw", "sw2", "swy", "swy2"])
    some = F.col("sw") != 0
    content = F.when(some, F.col("swy") / F.col("sw")).otherwise(0.0)
    effective = F.when(F.col("sw2") > 0, F.col("sw") * F.col("sw") / F.col("sw2")).otherwise(0.0) if weighted else F.col("sw")
    out = dense.withColumns({"content": content, "effective": effective})
    spread = F.sqrt(F.abs(F.col("swy2") / F.col("sw") - F.col("content") * F.col("content")))
    of_mean = F.when(F.col("effective") > 0, spread / F.sqrt("effective")).otherwise(0.0)
    error = {
        "mean": of_mean,
        "spread": spread,
        "integer": F.when((spread == 0) & (F.col("effective") > 0), 1 / F.sqrt(12 * F.col("effective"))).otherwise(of_mean),
        "gauss": 1 / F.sqrt("sw"),
    }[mode]
    cell = flat_cell([F.col(n) for n in names], axes).alias("cell")
    return out.select(*names, cell, F.col("sw").alias("entries"), "effective", "content", F.when(some, error).otherwise(0.0).alias("error"))


def _profiled(df: DataFrame, keys: list[Column], axes: list[Axis], value: Column, weight: Column | None) -> DataFrame:
    names = ["bx", "by", "bz"][: len(axes)]
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(*[a.find(k).alias(n) for n, k, a in zip(names, keys, axes, strict=True)], value.cast("double").alias("y"), w.alias("w"))
    return rows.na.drop(subset=[*names, "y"])


def merged(cells: list[DataFrame]) -> DataFrame:
    """Contents and squared weights of histograms over the same axes, summed cell by cell."""
    keys = [c for c in cells[0].columns if c in ("bx", "by", "bz", "cell")]
    every = cells[0]
    for other in cells[1:]:
        every = every.unionByName(other)
    sums = [F.sum(c).alias(c) for c in ("content", "sumw2") if c in every.columns]
    out = every.groupBy(*keys).agg(*sums)
    return out.withColumn("error", F.sqrt("sumw2") if "sumw2" in out.columns else F.sqrt(F.abs("content")))
