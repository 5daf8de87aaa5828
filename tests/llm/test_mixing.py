import random

import duckdb
import pytest

from tessera.llm import mixing

DOCS = "doc_id long, text string, source string, n_chars long, quota int, size string"


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(300):
        source = rng.choice(["a", "a", "a", "b", "c", None, "ü", ""])
        out.append((i, " ".join("w%d" % rng.randrange(99) for _ in range(rng.choice([0, 3, 40, 200]))) or rng.choice([None, "", " \n"]), source, 1, 0, "x"))
    return out + [(7, "one two three", "b", 1, 0, "x")] * 2 + [(None, "a b", "tiny", 1, 0, "x"), (None, "long " * 30000, "c", 1, 0, "x"), (900, None, "none", 1, 0, "x")]


def shares(spark, data):
    return mixing.shares(spark.createDataFrame(data, DOCS).repartition(3)).collect()


def test_targets_and_limits(spark):
    data = rows()
    got = shares(spark, data)
    assert len(got) == len(data)
    total = sum(r.size for r in got)
    by_id = {r[0]: r for r in data}
    sources = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = sources.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r.taken
    assert abs(sum(t for _, t in sources) - 1.5 * total) < 1e-6
    for (size, target), (taken, _) in sources.items():
        assert target <= 2 * size + 1e-9
        assert abs(taken - target) <= max(0.05 * target, 1)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, shares(spark, data[::-1])), key=str)
    assert by_id


def test_against_sql(spark):
    data = rows(3)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [r[:3] for r in data])
    assert sorted(map(str, con.sql(mixing.SHARES_SQL).fetchall())) == sorted(str((r.doc_id, r["size"], r.source_size, r.target, r.taken)) for r in shares(spark, data))


def test_documents_hold_what_is_taken(spark):
    data = [r for r in rows() if r[0] is not None and r[0] != 7]
    df = spark.createDataFrame(data, DOCS)
    taken = {r.doc_id: r.taken for r in mixing.shares(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    held, text = {}, {r[0]: (r[1] or "").split() for r in data}
    for r in out.collect():
        words = r.text.split()
        held[r.doc_id] = held.get(r.doc_id, 0) + len(words)
        assert any(text[r.doc_id][i : i + len(words)] == words for i in range(len(text[r.doc_id])))
        assert r.n_chars in (1, len(r.text))
    assert held == {k: v for k, v in taken.items() if v}


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(5)
    groups = {g: (rng.randint(0, 60), [rng.randint(0, 100) * 1.5 for _ in range(rng.randint(1, 9))]) for g in range(25)}
    rows = [(g, i, w, seats) for g, (seats, ws) in groups.items() for i, w in enumerate(ws)]
    got = {(r.g, r.i): r.quota for r in mixing.apportioned(spark.createDataFrame(rows, "g int, i int, w double, seats long"), "g", "i", "w", "seats").collect()}
    for g, (seats, ws) in groups.items():
        if sum(ws) == 0:
            continue
        quota = [0] * len(ws)
        for _ in range(seats):
            i = max(range(len(ws)), key=lambda i: (ws[i] / (2 * quota[i] + 1), -i))
            quota[i] += 1
        assert quota == [got.get((g, i), 0) for i in range(len(ws))]


@pytest.mark.parametrize("data", [[], [(1, None, None, 1, 1, "")], [(1, "", "s", 1, 1, ""), (2, None, "s", 1, 1, "")]])
def test_small_tables(spark, data):
    assert [r.taken for r in shares(spark, data)] == [0] * len(data)
    assert mixing.mixed_documents(spark.createDataFrame(data, DOCS)).count() == 0
