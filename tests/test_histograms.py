import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.binning import Axis
from tessera.operators import graph, histogram

def X():
    return F.col("x")


def frame(spark, rows, schema="x double, w double"):
    return spark.createDataFrame(rows, schema)


def test_axis_of_equal_bins(spark):
    axis = Axis.fixed(4, 0, 2)
    rows = [(-1.0, 0), (0.0, 1), (1.9, 4), (2.0, 5), (99.0, 5), (float("inf"), 5), (float("-inf"), 0), (float("nan"), None), (None, None)]
    got = [r.b for r in frame(spark, [(x, 1.0) for x, _ in rows]).select(axis.find(X()).alias("b")).collect()]
    assert got == [b for _, b in rows]
    assert axis.edges() == [0, 0.5, 1, 1.5, 2] and axis.centers() == [0.25, 0.75, 1.25, 1.75] and axis.width(4) == 0.5


def test_axis_of_cuts(spark):
    axis = Axis.variable([0, 1, 3, 6])
    got = [r.b for r in frame(spark, [(x, 1.0) for x in (-1.0, 0.0, 4.0, 6.0, 5.999)]).select(axis.find(X()).alias("b")).collect()]
    assert got == [0, 1, 3, 4, 3] and axis.width(3) == 3
    assert [r.low for r in axis.table(spark).orderBy("bin").collect()] == [0, 1, 3]
    equal = Axis.variable([0, 1, 1, 2])
    assert [r.b for r in frame(spark, [(1.0, 1.0)]).select(equal.find(X()).alias("b")).collect()] == [3]


def test_axis_refusals():
    for bad in (lambda: Axis.fixed(0, 0, 1), lambda: Axis.fixed(3, 1, 1), lambda: Axis.variable([1]), lambda: Axis.variable([1, 0])):
        with pytest.raises(ValueError):
            bad()


def test_fill_rules(spark):
    """Three fills in one bin, one under, one over, one of weight 4."""
    df = frame(spark, [(1.5, 1.0)] * 3 + [(-1.0, 1.0), (9.0, 1.0), (2.5, 4.0)])
    axis = Axis.fixed(4, 0, 4)
    cells = histogram.histogram(df, [X()], [axis], F.col("w")).orderBy("bx").collect()
    assert [c.content for c in cells] == [1, 0, 3, 4, 0, 1]
    s = histogram.statistics(df, [X()], [axis], F.col("w")).collect()[0]
    assert (s.entries, s.sumw, s.sumwx) == (6, 7, 14.5)


def test_two_dimensions(spark):
    df = spark.createDataFrame([(0.5, 2.5, 1.0), (0.5, 2.5, 2.0)], "x double, y double, w double")
    cells = histogram.histogram(df, [X(), F.col("y")], [Axis.fixed(2, 0, 2), Axis.fixed(3, 0, 3)], F.col("w"), sumw2=True)
    full = cells.where("content > 0").collect()
    assert cells.count() == 20 and [(c.bx, c.by, c.cell, c.content, c.sumw2) for c in full] == [(1, 3, 14, 3, 5)]


def test_cells_refuse_what_they_cannot_hold(spark):
    df = frame(spark, [(0.5, 200.0)])
    histogram.histogram(df, [X()], [Axis.fixed(1, 0, 1)], F.col("w"), cell="short").collect()
    for cell, weight in (("byte", 200.0), ("int", 0.5)):
        with pytest.raises(Exception, match="does not fit"):
            histogram.histogram(frame(spark, [(0.5, weight)]), [X()], [Axis.fixed(1, 0, 1)], F.col("w"), cell=cell).collect()


@pytest.mark.parametrize("mode", histogram.MODES)
def test_profile_against_loops(spark, mode):
    rng = random.Random(1)
    rows = [(rng.uniform(-1, 5), float(rng.randint(0, 4)), float(rng.choice([1, 2, 3]))) for _ in range(200)] + [(3.5, 2.0, 1.0)] * 2
    df = spark.createDataFrame(rows, "x double, y double, w double")
    got = histogram.profile(df, [X()], [Axis.fixed(4, 0, 4)], F.col("y"), mode, F.col("w")).orderBy("bx").collect()
    assert len(got) == 6
    for r in got:
        own = [(y, w) for x, y, w in rows if (0 if x < 0 else 5 if x >= 4 else 1 + int(x)) == r.bx]
        sw, sw2 = sum(w for _, w in own), sum(w * w for _, w in own)
        if not sw:
            assert (r.content, r.error, r.entries) == (0, 0, 0)
            continue
        mean = sum(w * y for y, w in own) / sw
        spread, n = math.sqrt(abs(sum(w * y * y for y, w in own) / sw - mean * mean)), sw * sw / sw2
        error = {"mean": spread / math.sqrt(n), "spread": spread, "integer": spread / math.sqrt(n) if spread else 1 / math.sqrt(12 * n), "gauss": 1 / math.sqrt(sw)}[mode]
        assert r.content == pytest.approx(mean) and r.error == pytest.approx(error) and r.effective == pytest.approx(n)


def test_labels_keep_list_order(spark):
    axis = Axis(3, 0, 3, labels=(("gamma", 3), (None, 2), ("alpha", 1)))
    assert axis.names() == ["gamma", "alpha"]
    df = spark.createDataFrame([("alpha", 1.0), ("gamma", 3.0), ("delta", 9.0)], "name string, w double")
    assert [r.content for r in histogram.label_histogram(df, F.col("name"), axis, F.col("w")).orderBy("bin").collect()] == [0, 1, 0, 3, 0]


def test_empty_input(spark):
    df = frame(spark, [])
    assert [c.content for c in histogram.histogram(df, [X()], [Axis.fixed(2, 0, 1)]).collect()] == [0] * 4
    assert histogram.statistics(df, [X()], [Axis.fixed(2, 0, 1)]).collect()[0].sumw == 0


def test_graph_errors(spark):
    df = frame(spark, [(1.0, 0.1), (2.0, 0.2)])
    g = graph.graph(df, [X()], X(), 2 * X(), (F.col("w"),), (F.lit(0.3), F.lit(0.4)))
    assert [(r.low, r.high) for r in graph.x_errors(g).orderBy("idx").collect()] == [(0.1, 0.1), (0.2, 0.2)]
    assert [(r.low, r.high) for r in graph.y_errors(g).collect()] == [(0.3, 0.4)] * 2
    assert [r.y for r in graph.points(g).orderBy("idx").collect()] == [2, 4]
    with pytest.raises(ValueError):
        graph.graph(df, [X()], X(), X(), (X(), X(), X()))


def test_partial_aggregation_comes_before_the_shuffle(spark):
    plan = histogram.histogram(frame(spark, [(1.0, 1.0)]), [X()], [Axis.fixed(4, 0, 4)])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan and "Cartesian" not in plan
