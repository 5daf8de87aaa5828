import random
import re
from collections import Counter

import pytest

from tessera.llm import minhash

DOCS = "doc_id long, text string, class string, bucket int"


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        ids = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return [(d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdEéÉ", k=rng.randint(1, 5)))
    make = lambda n: [word() for _ in range(n)]
    texts = [None, "", " \n", "", "one", "One", "ONE two", "a b c d", "A b\tc  d", "É é", "é é"]
    for size in (8, 30, 120, 400):
        for _ in range(4):
            origin = make(size)
            texts.append(" ".join(origin))
            for _ in range(6):
                w = list(origin)
                for _ in range(rng.randint(0, max(1, size // 12))):
                    i = rng.randrange(len(w))
                    w[i : i + 1] = rng.choice([[word()], [], [w[i], word()]])
                texts.append(" \n".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    chain = make(60)  # each link holds, the ends are far apart
    for k in range(12):
        texts.append(" ".join(chain[k * 2 :] + [f"new{j}" for j in range(k * 2)]))
    passage = make(40)
    texts += [" ".join(make(rng.randint(10, 60)) + passage + make(rng.randint(0, 40))) for _ in range(25)]
    texts += ["long word " * 20000, " ".join(make(5000))]
    out = [(i * 37 % 211, t) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out


def run(spark, data):
    df = spark.createDataFrame([(*r, "c", 1) for r in data], DOCS).repartition(3)
    return [tuple(r) for r in minhash.near_duplicates(df).collect()]


def test_against_brute_force(spark):
    data = rows()
    assert len({i for i, _ in data}) == len(data)
    assert Counter(run(spark, data)) == Counter(brute(data))


@pytest.mark.parametrize("hubs, pairs, piece", [(0, 0.01, 3), (1, 0.3, 2), (0, 50, 1000)])
def test_blocks_of_pivots_lose_no_link(spark, monkeypatch, hubs, pairs, piece):
    """Small blocks over buckets in pieces, with no or one turn of hubs: copies of copies, whose ends are far apart."""
    for name, value in (("HUBS", hubs), ("PAIRS", pairs), ("PIECE", piece)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(31)
    data = []
    for _ in range(2):
        family = [[rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(70)]]
        for _ in range(24):
            w = list(rng.choice(family))
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = "new" + str(rng.random())
            family.append(w)
        data += [(len(data) + i, " ".join(w)) for i, w in enumerate(family)]
    rng.shuffle(data)
    assert Counter(run(spark, data)) == Counter(brute(data))


def test_ties_and_nulls(spark):
    data = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (None, "x y z"), (None, "x y z"), (None, ""), (2, None)]
    assert Counter(run(spark, data)) == Counter([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (2, 0, 2, True)])
    df = spark.createDataFrame([(*r, "c", 1) for r in data], DOCS)
    out = minhash.one_of_each(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, "a b c d e f"), (None, "x y z"), (None, ""), (2, None)])


def test_empty_table(spark):
    assert run(spark, []) == []


def test_pruning_bound():
    least = minhash.least_matches()
    assert least == sorted(least) and all(0 < m < minhash.SIMILAR * minhash.STEP * (i + 1) for i, m in enumerate(least))
