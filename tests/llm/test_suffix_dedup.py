import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_dedup

DOCS = "doc_id long, text string, key string, n int"


def brute(texts):
    size = suffix_dedup.LENGTH
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    make = lambda n: " ".join(word() for _ in range(n))
    passage, other = make(150), make(140)
    out = [None, "", "short", make(300), "x" * 1500, "ab" * 900, make(20) + "x" * 450]
    out += [make(rng.randint(0, 60)) + passage + make(rng.randint(0, 60)) for _ in range(8)]
    out += [make(30) + passage[:420] + make(20) + other, make(10) + passage[1:400] + make(90), passage[:399] + "Q" + passage[399:]]
    out += [other + make(200) + other, out[7], out[7], "y" * 399, "z" * 400, "z" * 400]
    line = make(30) + "\n"
    out += [line * 12, make(80) + line * 9]
    base = make(400).split(" ")
    for _ in range(8):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], DOCS).repartition(3)
    got = Counter(tuple(r) for r in suffix_dedup.removed(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == Counter((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows])))


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    check(spark, rows + [(3, rows[3][1]), (None, rows[8][1]), (None, rows[8][1]), (None, "z" * 401)])


@pytest.mark.parametrize("widths", [(48, 1), (337,), (5,)])
def test_hot_anchors_and_short_pieces(spark, monkeypatch, widths):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "WIDTHS", widths)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    monkeypatch.setattr(suffix_dedup, "ROWS", 4)
    check(spark, list(enumerate(texts())))


def test_a_range_a_run(spark):
    """Runs whose windows repeat in many places still give one range each, and all covered bytes."""
    rng = random.Random(5)
    make = lambda n: "".join(rng.choices("abcd", k=n))
    core = next(t for t in iter(lambda: make(560), None) if len(list(suffix_dedup.Anchors().runs([t.encode()]))) == 1)
    rows = list(enumerate([core, core[:450] + make(110), make(130) + core[130:]]))  # windows 51 to 129 stand once
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], DOCS)
    runs = suffix_dedup.found_runs(df).cache()
    found = suffix_dedup._spans(suffix_dedup._keyed(df).select("key", "text"), runs).groupBy("key").count().collect()
    assert len(found) == 3 and {r["count"] for r in found} == {1}
    check(spark, rows)


def test_frequent_anchor_is_dealt_out(spark, monkeypatch):
    """Runs around a line that most texts hold do not meet in one task where the shared ones are found."""
    rng = random.Random(12)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line = make(390)
    rows = [(i, make(60) + line + make(60)) for i in range(1200)] + [(1200 + i, make(700)) for i in range(300)]
    tasks = {}

    def written(df, name, f=suffix_dedup.written):
        out = f(df, name)
        if name == "shared":
            tasks[name] = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
        return out

    monkeypatch.setattr(suffix_dedup, "written", written)
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "shuffle.partitions": "12", "files.maxPartitionBytes": "64k", "files.openCostInBytes": "16k", "adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.{k}", v)
        check(spark, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert max(tasks["shared"]) < 0.5 * sum(tasks["shared"])


def test_common_run_is_dealt_out(spark, monkeypatch):
    """The places of a run that most texts hold do not meet in one task to get its range."""
    monkeypatch.setattr(suffix_dedup, "COMMON", 100, raising=False)
    rng = random.Random(13)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = make(2500)
    rows = [(i, make(60) + passage + make(60)) for i in range(300)] + [(300 + i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], DOCS)
    runs = suffix_dedup.found_runs(df).distinct()
    most = runs.groupBy("anchor", "run").count().where("count = 300").first()
    one = runs.where((F.col("anchor") == most["anchor"]) & (F.col("run") == most["run"])).repartition(8).cache()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = suffix_dedup._spans(suffix_dedup._keyed(df).select("key", "text").distinct(), one)
        tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(tasks) == 300 and max(tasks) < 0.5 * sum(tasks)


def test_empty_table(spark):
    assert suffix_dedup.removed(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_sorting_columns(seed):
    """Marks of one collection against comparing all windows."""
    rng = random.Random(seed)
    size, span = suffix_dedup.LENGTH, suffix_dedup.SPAN
    core = bytes(rng.choices(b"ab", k=suffix_dedup.COLUMNS))
    rows = []
    for _ in range(12):
        run = bytearray(core)
        for _ in range(rng.randint(0, 2)):
            run[rng.randrange(len(run))] = rng.choice(b"abc")
        left = rng.randint(0, span - 1)
        n = rng.randint(1, left + 1)
        rows.append((left, n, bytes(run[span - 1 - left : span - 1 - left + n - 1 + size])))
    sink = pa.BufferOutputStream()
    suffix_dedup.built(sink, np.zeros(12, int), np.array([r[0] for r in rows]), [r[2] for r in rows])
    file = sink.getvalue()
    got = suffix_dedup.repeated(pa.BufferReader(file), 12)
    at = [{span - 1 - left + i: run[i : i + size] for i in range(n)} for left, n, run in rows]
    expect = [[c in own and any(own[c] == o.get(c) for j, o in enumerate(at) if j != i) for c in range(span)] for i, own in enumerate(at)]
    assert got.tolist() == expect
    # The rounds in the file: suffixes in order, what stands before them, and what neighbours share.
    padded = [bytes([suffix_dedup.END]) * (span - 1 - left) + run + bytes([suffix_dedup.END]) * suffix_dedup.COLUMNS for left, _, run in rows]
    for column, batch in zip(range(span - 1, -1, -1), pa.ipc.open_stream(file)):
        suffix = [p[column : suffix_dedup.COLUMNS] for p in padded]
        order = batch["order"].to_pylist()
        assert [suffix[i] for i in order] == sorted(suffix)
        assert batch["bwt"].to_pylist() == [padded[i][column - 1] if column else suffix_dedup.END for i in order]
        for before, i, n in zip(order, order[1:], batch["shared"].to_pylist()[1:]):
            common = next((k for k, (x, y) in enumerate(zip(suffix[before], suffix[i])) if x != y or x == suffix_dedup.END), len(suffix[i]))
            assert n == common


def test_real_sizes(spark):
    """A text of several pieces whose middle another one repeats, and more runs of one anchor than ``HOT``."""
    rng = random.Random(11)
    long = "".join(rng.choices("abcdefgh ", k=suffix_dedup.PIECE + 5000))
    passage = "".join(rng.choices("xyz ", k=380))
    rows = [(0, long), (1, "q" * 50 + long[suffix_dedup.PIECE - 700 : suffix_dedup.PIECE + 300]), (2, long[:600])]
    rows += [(i, "".join(rng.choices("mnop", k=60)) + passage + "".join(rng.choices("mnop", k=60))) for i in range(3, 700)]
    rows += [(i, rows[i - 400][1][40:] + "end") for i in range(700, 760)]
    check(spark, rows)
