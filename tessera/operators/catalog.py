"""Catalogs as tables: named objects in cycles, class descriptions in versions, and free stretches of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.codecs import LATEST
from tessera.sources import tables

#: A free list ends with an open stretch that reaches this offset.
OPEN_END = 2_000_000_000


def latest(keys: DataFrame, by: list[str], cycle: str = "cycle") -> DataFrame:
    """One row a name: the highest cycle."""
    return keys.groupBy(*by).agg(F.max_by(F.struct(*keys.columns), cycle).alias("k")).select("k.*")


def find(keys: DataFrame, name: str, cycle: int = LATEST) -> DataFrame:
    """The key of a name: the cycle asked for, or the highest."""
    own = keys.where(F.col("name") == name)
    return latest(own, ["name"]) if cycle == LATEST else own.where(F.col("cycle") == cycle)


def names(keys: DataFrame, position: str) -> DataFrame:
    """Distinct names in the order in which they first stand."""
    return keys.groupBy("name").agg(F.min(position).alias("first"))


def appended(keys: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` names with their cycle: one above the highest there is; several new rows of a name count up by ``position``."""
    have = keys.groupBy("name").agg(F.max("cycle").alias("_have"))
    number = F.row_number().over(Window.partitionBy("name").orderBy("position"))
    return new.join(have, "name", "left").withColumn("cycle", (F.coalesce("_have", F.lit(0)) + number).cast("int")).drop("_have")


def coalesced(spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Closed whole-number intervals, overlapping or adjacent ones merged, within each group of ``by``."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(F.col("first") <= reach + 1, 0).otherwise(1))
    grouped = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_island")


def free_bytes(spans: DataFrame) -> DataFrame:
    """One row: bytes of all closed stretches, and where the open one begins."""
    closed = F.col("last") != OPEN_END
    return spans.agg(F.coalesce(F.sum(F.when(closed, F.col("last") - F.col("first") + 1)), F.lit(0)).alias("free_bytes"), F.min(F.when(~closed, F.col("first"))).alias("tail"))


def closure(needs: DataFrame, roots: list[str]) -> DataFrame:
    """(class, level, rank): all classes that the roots need; ``needs`` has class and needs.

    The level is the fewest steps from a root.  Ranks put what is needed first: a class has a higher rank than all that
    it needs, by the longest chain below it; classes of a cycle, and those that need them, share the last rank.  Each
    step is a written table, and steps end when nothing is new, however long a chain is.
    """
    edges = tables.stored(needs.select("class", "needs").where("class IS NOT NULL AND needs IS NOT NULL").distinct(), "edges")
    found = tables.stored(needs.sparkSession.createDataFrame([(r, 0) for r in sorted(set(roots))], "class string, level int"), "closure")
    frontier, level = found, 0
    while not frontier.isEmpty():
        level += 1
        reached = frontier.select("class").join(edges, "class").select(F.col("needs").alias("class")).distinct()
        frontier = tables.stored(reached.join(found, "class", "left_anti").withColumn("level", F.lit(level)), "frontier")
        found = tables.stored(found.unionByName(frontier), "closure")
    left, ranked, rank = found.select("class"), None, 0
    while True:
        unmet = edges.where("class != needs").join(left.select(F.col("class").alias("needs")), "needs", "left_semi").select("class").distinct()
        ready = tables.stored(left.join(unmet, "class", "left_anti").withColumn("rank", F.lit(rank)), "ready")
        if ready.isEmpty():
            break
        ranked = ready if ranked is None else ranked.unionByName(ready)
        left, rank = tables.stored(left.join(ready, "class", "left_anti"), "left"), rank + 1
    rest = left.withColumn("rank", F.lit(rank))
    return found.join(rest if ranked is None else ranked.unionByName(rest), "class")


def described(members: DataFrame) -> DataFrame:
    """One line a member of the latest version of each class: position, type, name, code, size, title."""
    last = F.max("version").over(Window.partitionBy("class"))
    return members.withColumn("_last", last).where("version = _last").select("class", "version", "pos", "type", "name", "code", "size", "title")
