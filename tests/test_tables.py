import math
import random
import struct
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import blocks, codecs
from tessera.functions.binning import Axis
from tessera.operators import build, catalog, columns, histogram, nested
from tessera.sources import tables
from tessera.streaming import histograms


def values(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def test_entries_number_rows_in_order(spark):
    df = spark.range(0, 1000, 3).withColumn("k", F.pmod(F.col("id") * 37, F.lit(1001))).repartition(5)
    got = columns.entries(df, "k").orderBy("entry").collect()
    assert [r.entry for r in got] == list(range(len(got))) and [r.k for r in got] == sorted(r.k for r in got)


def test_entries_of_many_wide_rows(spark):
    """Ranges that are coalesced keep every row, whatever is read of them."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 200)
        spark.conf.set("spark.sql.adaptive.enabled", True)
        n = 3_000_000
        df = spark.range(n).select(F.pmod(F.col("id") * 1_000_003, F.lit(n)).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
        got = columns.entries(df, "k").agg(F.count("*"), F.count(F.when(F.col("entry") != F.col("k"), 1)), F.count(F.when(F.length("wide") == 64, 1)))
        assert tuple(got.collect()[0]) == (n, 0, n)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_chunks_give_the_whole(spark):
    df = columns.entries_of(spark.range(101), "id")
    folded = columns.fold(df, "id", columns.rows_per_basket(256, 8))
    assert folded.agg(F.sum("total")).collect()[0][0] == sum(range(101)) and folded.count() == 4
    assert columns.visible(df, 7).count() == 7


def test_variable_baskets_restart(spark):
    sizes = [5, 5, 1, 9, 30, 2, 2]
    df = spark.createDataFrame(list(enumerate(sizes)), "entry long, size long")
    assert values(columns.variable_baskets(df, F.col("size"), 10), "basket", "first_entry", "n_entries", "bytes") == [(0, 0, 2, 10), (1, 2, 2, 10), (2, 4, 1, 30), (3, 5, 2, 4)]


@pytest.mark.parametrize("within", [1, 7, 40, 1000])
def test_variable_baskets_run_over_stretches(spark, within):
    rng = random.Random(within)
    sizes = [rng.choice([0, 0, 1, 3, 5, 9, 40]) for _ in range(300)] + [0, None, 0]
    expected, first, n, held = [], 0, 0, 0
    for e, s in enumerate(sizes):
        first, n, held = (first if n else e), n + 1, held + (s or 0)
        if held >= 20:
            expected.append((len(expected), first, n, held))
            n, held = 0, 0
    expected += [(len(expected), first, n, held)] if n else []
    df = spark.createDataFrame(list(enumerate(sizes)), "entry long, size long").repartition(3)
    assert values(columns.variable_baskets(df, F.col("size"), 20, within), "basket", "first_entry", "n_entries", "bytes") == sorted(expected, key=str)
    assert columns.variable_baskets(df.where("entry < 0"), F.col("size"), 20, within).count() == 0


def test_leaf_rules():
    schema = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("pair", T.StructType([T.StructField("b", T.DoubleType()), T.StructField("a", T.IntegerType())]))])
    assert columns.leaf(schema, "x") == "x" and columns.leaf(schema, "pair", "a") == "pair.a"
    assert columns.find(schema, "a") == "pair.a" and columns.fields(schema) == ["x", "pair", "pair.b", "pair.a"]
    with pytest.raises(ValueError, match="b, a"):
        columns.leaf(schema, "pair")
    for bad in (lambda: columns.leaf(schema, "pair", "c"), lambda: columns.find(schema, "zz"), lambda: columns.leaf(schema, "x", "y")):
        with pytest.raises(KeyError):
            bad()


def test_builder_round_trip(spark):
    n = 300
    rows = [(i, 7 * i, i * i, i / 3, i % 2 == 1, f"row-{i}", [float(i)] * (i % 5), [float(3 * i + k) for k in range(3)]) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "i32 int, u32 long, i64 long, f64 double, flag boolean, lab string, jag array<float>, mat array<double>")
    made = build.TableBuilder("t").column("i32", "int32").column("u32", "uint32").column("i64", "int64").column("f64", "float64").column("flag", "bool")
    made.column("lab", "string").column("jag", "float32", jagged=True).column("mat", "float64", length=3).append(df)
    assert made.rows.columns == ["i32", "u32", "i64", "f64", "flag", "lab", "njag", "jag", "mat"]
    assert values(made.rows.drop("njag"), *df.columns) == values(df, *df.columns)
    assert made.titles()[5:] == ["lab/C", "njag/I", "jag[njag]/F", "mat[3]/D"]
    assert made.schema["jag"].metadata["counter"] == "njag" and columns.shape(made.schema["mat"]).length == 3
    store = "file://" + tempfile.mkdtemp(prefix="spark-")
    assert tables.write(made.rows, store, "t") == 1 and tables.write(made.rows.limit(5), store, "t") == 2
    assert tables.read(spark, store, "t;1").count() == n and tables.read(spark, store, "t").count() == 5
    assert tables.read(spark, store, "t;*", columns=["i64"]).columns == ["i64"]
    with pytest.raises(KeyError):
        tables.read(spark, store, "t;7")
    with pytest.raises(KeyError):
        tables.read(spark, store, "u")
    assert tables.chain([made.rows.select("i32"), made.rows.select("i32", "i64")]).count() == 2 * n


def test_shared_counter(spark):
    made = lambda: build.TableBuilder("t").column("n", "int32").column("px", "float32", jagged=True, count="n").column("py", "float32", jagged=True, count="n")
    good = spark.createDataFrame([(2, [1.0, 2.0], [3.0, 4.0]), (0, [], [])], "n int, px array<double>, py array<double>")
    assert made().append(good).rows.count() == 2
    with pytest.raises(Exception, match="another length"):
        made().append(spark.createDataFrame([(2, [1.0, 2.0], [3.0])], good.schema)).rows.collect()


def test_builder_refusals(spark):
    b = lambda: build.TableBuilder("t").column("x", "int32")
    for bad in (
        lambda: b().column("x", "int8"), lambda: b().column("y", "complex"), lambda: b().column("s", "string", length=2), lambda: b().column("s", "string", jagged=True),
        lambda: b().column("a", "int8", length=0), lambda: b().column("v", "int8", jagged=True, count="zz"), lambda: b().column("f", "float32").column("v", "int8", jagged=True, count="f"),
        lambda: b().column("nv", "int32").column("v", "int8", jagged=True), lambda: build.TableBuilder("t", basket_bytes=0), lambda: build.TableBuilder("t").append(spark.range(1)),
        lambda: b().append(spark.range(3)), lambda: b().append(spark.sql("select 1 as x")).column("y", "int32"), lambda: b().append(spark.sql("select array(1) as x")),
    ):
        with pytest.raises(ValueError):
            bad()
    for value in ("1.5D", "3000000000L"):
        with pytest.raises(Exception, match="does not fit"):
            b().append(spark.sql(f"select {value} as x")).rows.collect()
    assert b().append(spark.sql("select 2.0D as x, 5 as other")).rows.collect()[0].x == 2
    assert build.one_shot(spark.sql("select array(1, 2) as v"), {"v": "int8"}).rows.collect()[0].nv == 2


def test_name_cycles(spark):
    """All heads with all tails against a loop."""
    heads, tails = ["run", "x;y", ";", "ü z", ""], ["", ";7", ";007", ";*", ";new", ";1x", "; 3", ";12;*", ";"]

    def plain(text):
        head, sep, tail = text.rpartition(";")
        if sep and (tail == "*" or tail and all(c in "0123456789" for c in tail)):
            return head, 9999 if tail == "*" else int(tail)
        return text, 9999

    texts = [h + t for h in heads for t in tails]
    name, cycle = codecs.name_cycle(F.col("t"))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", name.alias("n"), cycle.alias("c")).collect()
    assert [(r.n, r.c) for r in got] == [plain(r.t) for r in got]


def test_sizes_times_and_ranges(spark):
    df = spark.createDataFrame([("", 1), ("x" * 254, 255), ("x" * 255, 260)], "t string, n int")
    assert all(r.n == r.s for r in df.select("n", codecs.string_size(F.col("t")).alias("s")).collect())
    one = spark.range(1)
    assert one.select(codecs.key_size(F.lit("b"), F.lit(""), F.lit("Entries")).alias("k"), codecs.key_size(F.lit("b"), F.lit(""), F.lit("Entries"), F.lit(True)).alias("b"), codecs.key_size(F.lit("b"), F.lit(""), F.lit("Basket"), F.lit(True), True).alias("t")).collect()[0][:2] == (37, 45)
    assert str(one.select(codecs.unpack_time(F.lit(0)).alias("t")).collect()[0].t) == "1995-01-01 00:00:00"
    assert codecs.range_bits(10.1, 0) == 10 and codecs.range_bits(0, 1) == 12 and codecs.range_bits(20.5, 1) == 12
    t = spark.sql("select timestamp_ntz'2031-12-31 23:59:57' as t")
    assert t.select((codecs.unpack_time(codecs.pack_time(F.col("t"))) == F.col("t")).alias("same")).collect()[0].same
    assert one.select(codecs.pack_time(F.lit("1994-12-31").cast("timestamp_ntz")).alias("t")).collect()[0].t is None
    with pytest.raises(Exception, match="out of the packed range"):
        one.select(codecs.ranged(F.lit(9.0), 10.0, 20.0)).collect()


def test_blocks():
    import random

    import xxhash

    assert xxhash.xxh64_hexdigest(b"", seed=0) == "ef46db3751d8e999" and xxhash.xxh64_hexdigest(b"a", seed=0) == "d24ec4f1a98c6e5b"
    rng, long_ = random.Random(1), b"0123456789" * 60
    noise = bytes(rng.randrange(256) for _ in range(5000))
    for a in blocks.LETTERS:
        packed = blocks.compress_bytes(long_, a, 5)
        assert len(packed) < len(long_) and packed[:2] == blocks.LETTERS[a] and blocks.decompress_bytes(packed, 600) == long_
        assert blocks.compress_bytes(long_[:511], a, 5) == long_[:511] and blocks.compress_bytes(noise, a, 5) == noise
        for bad in (packed[:-3], b"CS" + packed[2:]):
            with pytest.raises(Exception):
                blocks.decompress_bytes(bad, 600)
    assert blocks.compress_bytes(long_, 1, 0) == long_
    with pytest.raises(ValueError):
        blocks.compress_bytes(long_, 9, 1)


def test_round_trips_hold_one_value(spark, tmp_path):
    """Null and long texts come back, and one Python step holds no column of blocks."""
    from tessera.plans import registry

    texts = [None, "", "x" * 511, "é" * 3_000_000, "line " * 9_000_000, "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()["block_round_trip"](spark, str(tmp_path))
    assert values(df, "doc_id", "n_bytes", "same") == [(i, None if t is None else len(t.encode()), True) for i, t in enumerate(texts)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1
    with pytest.raises(Exception, match="algorithms are"):
        blocks.round_trips(df.select(F.lit(b"x" * 600).alias("plain")), "plain", 1, (9,)).collect()


def test_intervals(spark):
    """Generated spans against a set of all their numbers."""
    rng = random.Random(21)
    for _ in range(4):
        rows = [(g, a, a + rng.randint(0, 9)) for g in "xy" for a in rng.sample(range(400), 30)]
        df = spark.createDataFrame(rows, "g string, first long, last long")
        expect = []
        for g in "xy":
            held = {v for h, a, b in rows if h == g for v in range(a, b + 1)}
            expect += [(g, v, next(w for w in range(v, 500) if w + 1 not in held)) for v in held if v - 1 not in held]
        merged = catalog.coalesced(df, ["g"])
        assert values(merged, "g", "first", "last") == sorted(expect, key=str)
        assert catalog.free_bytes(merged).collect()[0].free_bytes == sum(b - a + 1 for _, a, b in expect)
    spans = spark.createDataFrame([(7, 12), (90, catalog.OPEN_END)], "first long, last long")
    assert catalog.free_bytes(spans).collect()[0][:] == (6, 90)


RANGES = {
    "a/d[1,3]": (1, 3, 32), "[0,2*pi,8]": (0, 2 * math.pi, 8), "b/f[ -PI/2 , pi/4 ,31]": (-math.pi / 2, math.pi / 4, 31), "two words/x[-twopi,1e3]": (-2 * math.pi, 1000, 32),
    "[0,0,9]": (9.1, 0, 9), "[5,4,20]": (5, 4, 20), "n[1,2] then/d[3,4]": (3, 4, 32), "see [1,2]": None, "a/dd[1,2]": None, "a/d[1]": None, "a/d[1,2,3,4]": None, "": None, "plain": None,
    "a/d[1,2,1]": None, "a/d[1,2,33]": None, "a/d[1,2,x]": None, "a/d[low,high]": None, "a/d[1,2": None, "a/d]1,2[": None,
}


@pytest.mark.parametrize("title", RANGES)
def test_ranges_in_titles(title):
    assert codecs.parse_range(title) == (RANGES[title] and pytest.approx(RANGES[title]))


@pytest.mark.parametrize("bits", [2, 8, 12, 14])
def test_short_floats(spark, bits):
    """Codes against the float's own bits, and values within half a step."""
    rng = random.Random(bits)
    given = [0.0, 1.0, -1.0, 0.5, 2.0**-126, 1e-40, 3.0e38, -7.25, 1.9999999, 2**-149] + [rng.uniform(-1, 1) * 2.0 ** rng.randint(-130, 120) for _ in range(300)]
    given = [struct.unpack("f", struct.pack("f", x))[0] for x in given]

    def plain(x):
        word = struct.unpack("I", struct.pack("f", x))[0]
        mantissa = (((word & 0x7FFFFF) >> (23 - bits - 1)) + 1) >> 1
        return (word >> 23 & 0xFF) * 65536 + min(mantissa, (1 << bits) - 1) + ((word >> 31) << (bits + 1))

    code = codecs.short_float(F.col("x"), bits)
    got = spark.createDataFrame([(x,) for x in given], "x double").select("x", code.alias("c"), codecs.from_short_float(code, bits).alias("back")).collect()
    assert [r.c for r in got] == [plain(r.x) for r in got]
    assert all(abs(r.back - r.x) <= abs(r.x) * 2.0**-bits + 2.0**-126 for r in got)


def test_exact_limits(spark):
    def fits(value, element):
        df = spark.sql(f"select {value} as x")
        try:
            return df.select(build.exact(F.col("x"), element, df.schema["x"].dataType, "x").alias("x")).collect()[0].x
        except Exception as e:
            assert "does not fit" in str(e)

    assert fits("127.0D", "int8") == 127 and fits("128.0D", "int8") is None and fits("-128", "int8") == -128 and fits("-129", "int8") is None
    assert fits("1.5F", "int32") is None and fits("-1", "uint64") is None and fits("9223372036854775807L", "int64") == 2**63 - 1 == fits("9223372036854775807L", "uint64")
    assert fits("9223372036854775808.0D", "int64") is None and fits("9223372036854774784.0D", "int64") == 9223372036854774784
    assert fits("18446744073709551615BD", "uint64") == 2**64 - 1 and fits("18446744073709551616BD", "uint64") is None and fits("4294967295L", "uint32") == 2**32 - 1


def test_one_shot_of_fixed_length(spark):
    df = spark.sql("select array(1.0D, 2.0D) as m, array(7) as v")
    made = build.one_shot(df, {"m": "float64", "v": "int8"}, lengths={"m": 2})
    assert made.titles() == ["m[2]/D", "nv/I", "v[nv]/B"] and made.rows.collect()[0].nv == 1
    with pytest.raises(Exception, match="another length"):
        build.one_shot(df, {"m": "float64"}, lengths={"m": 3}).rows.collect()
    for bad in (lambda: build.one_shot(df, {"w": "int8"}), lambda: build.one_shot(df, {}), lambda: build.one_shot(spark.range(1), {"id": "int8"}, lengths={"id": 2})):
        with pytest.raises(ValueError):
            bad()


def test_nested(spark):
    df = spark.sql("select array(1, 2, 3) as a, array('x', 'y') as b")
    assert df.select(F.size(nested.transposed("a", "b")).alias("n")).collect()[0].n == 2
    assert nested.member_name("evt.track.px[3]", "evt") == "px"
    assert [tuple(x) for x in df.select(nested.pairs(F.col("a"), F.col("a")).alias("p")).collect()[0].p] == [(1, 1), (2, 2), (3, 3)]
    assert nested.spark_type("std::map<int, std::vector<short> >").simpleString() == "array<struct<first:int,second:array<smallint>>>"
    assert nested.spark_type("bitset<8>").simpleString() == "array<boolean>" and nested.spark_type("unsigned long").simpleString() == "decimal(20,0)"
    assert spark.range(1).select(nested.bits(F.lit(5), 4).alias("b")).collect()[0].b == [True, False, True, False]
    left, right = (columns.entries_of(spark.range(n), "id").select("entry", F.col("id").alias(c)) for n, c in ((5, "a"), (3, "b")))
    assert nested.join_split([left, right]).count() == 3
    with pytest.raises(KeyError):
        nested.spark_type("Unknown")


def test_type_names():
    same = {
        "map<string,vector<int> >": ["std::map<std::string, std::vector<int>>", "class std::__1::map< const std::basic_string<char, std::char_traits<char> > , vector<int>  >&"],
        "unsigned int": ["const  unsigned   int *", "unsigned int const"], "pair<float,pair<int,Double32_t> >": ["std::pair<float, struct std::pair<volatile int,Double32_t>>"],
    }
    for name, others in same.items():
        assert {str(nested.type_name(x)) for x in [name, *others]} == {name}
        assert len({nested.spark_type(x).simpleString() for x in [name, *others]}) == 1
    assert nested.spark_type("vector<Float16_t>").simpleString() == "array<float>"
    for bad in ("vector<int", "vector<int>>", "a,b"):
        with pytest.raises(ValueError):
            nested.type_name(bad)


def test_class_descriptions():
    classes = {"Base": [("id", "int")], "Hit": [("Base", "Base"), ("at[3]", "Double32_t")], "Event": [("name", "std::string"), ("hits", "vector<Hit>"), ("by", "map<int,Hit>")], "Loop": [("next", "vector<Loop>")]}
    hit = "struct<id:int,at:array<double>>"
    assert nested.class_type("Event", classes).simpleString() == f"struct<name:string,hits:array<{hit}>,by:array<struct<first:int,second:{hit}>>>"
    assert nested.spark_type("pair<Base,bool>", classes).simpleString() == "struct<first:struct<id:int>,second:boolean>"
    for bad in ("Loop", "None"):
        with pytest.raises(KeyError):
            nested.class_type(bad, classes)


def test_cycles_and_classes(spark):
    keys = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("a", 2, 2)], "name string, cycle int, position int")
    assert values(catalog.latest(keys, ["name"]), "name", "cycle") == [("a", 2), ("b", 1)]
    assert catalog.find(keys, "a", 1).collect()[0].position == 0 and catalog.find(keys, "zz").count() == 0
    new = spark.createDataFrame([("a", 0), ("c", 1), ("a", 2)], "name string, position int")
    assert values(catalog.appended(keys, new), "name", "cycle") == [("a", 3), ("a", 4), ("c", 1)]
    needs = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("X", "Y")], "class string, needs string")
    assert values(catalog.closure(needs, ["A"]), "class", "level", "rank") == [("A", 0, 0), ("B", 1, 0), ("C", 2, 0)]
    needs = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "C"), ("X", "Y"), *[(f"c{i}", f"c{i + 1}") for i in range(12)], ("B", "B")], "class string, needs string")
    assert values(catalog.closure(needs, ["A"]), "class", "level", "rank") == [("A", 0, 2), ("B", 1, 1), ("C", 1, 0)]
    assert values(catalog.closure(needs, ["c0"]), "class", "level", "rank") == sorted(((f"c{i}", i, 12 - i) for i in range(13)), key=str)


def test_stream_fills_the_same_cells(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    df = spark.range(100).select((F.col("id") % 7).cast("double").alias("x"))
    axis = Axis.fixed(5, 0, 5)
    for part in (df.where("x < 3"), df.where("x >= 3")):
        part.write.mode("append").parquet(f"{folder}/in")
        histograms.fill(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), f"{folder}/out", [F.col("x")], [axis]).awaitTermination()
    got = histograms.contents(df, f"{folder}/out", [axis])
    assert values(got, "bx", "content") == values(histogram.histogram(df, [F.col("x")], [axis]), "bx", "content")
