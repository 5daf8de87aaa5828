import itertools
import random
import re

import pytest

from tessera.llm import decontamination as d

DOCS = "doc_id long, text string, text_key string, pos int"
ITEMS = "item_id long, text string, words string"


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def brute(docs, items):
    """Every window of every document against every window of every item, mask by mask."""
    sought = {i: words(t) for i, (_, t) in enumerate(items) if len(words(t)) >= d.LEAST}
    seen = {}
    for i, v in sought.items():
        for m in d.MASKS if len(v) >= d.SPAN else ("1" * len(v),):
            for q in range(len(v) - len(m) + 1):
                seen.setdefault(m, {}).setdefault(tuple(v[q + k] for k, b in enumerate(m) if b == "1"), []).append((i, q))
    out = set()
    for doc_id, text in docs:
        w = words(text)
        diagonals = set()
        for m, windows in seen.items():
            ones = [k for k, b in enumerate(m) if b == "1"]
            for p in range(len(w) - len(m) + 1):
                diagonals |= {(i, p - q) for i, q in windows.get(tuple(w[p + k] for k in ones), ())}
        for i, g in diagonals:
            v = sought[i]
            n = min(d.WINDOW, len(v))
            best = max((sum(w[s + k] == v[s - g + k] for k in range(n)) for s in range(max(0, g), min(len(w), g + len(v)) - n + 1)), default=0)
            if best * d.WINDOW >= n * d.NEEDED:
                out.add((doc_id, items[i][0]))
    return out


def data():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdéÉ", k=rng.randint(1, 3)))
    make = lambda n: [word() for _ in range(n)]
    items = [(i, make(rng.randint(14, 40))) for i in range(20)] + [(90, make(7)), (91, make(3)), (92, make(12))]
    docs = [(1, ""), (2, None), (3, "x"), (None, "y")]
    for i in range(60):
        _, item = rng.choice(items)
        part = list(item[rng.randint(0, 3) :])
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = word()
        docs.append((100 + i, ", ".join(make(rng.randint(0, 50)) + (part if i % 3 else []) + make(rng.randint(0, 400)))))
    docs += [(100, docs[10][1]), (500, " ".join(make(30000) + items[0][1]))]
    texts = [(i, " ".join(w).upper() + ".") for i, w in items] + [(93, None), (94, ""), (95, " ".join(items[0][1])), (None, " ".join(items[1][1]))]
    return docs, texts


def frames(spark, docs, items):
    return spark.createDataFrame([(*r, "k", 1) for r in docs], DOCS).repartition(3), spark.createDataFrame([(*r, "w") for r in items], ITEMS)


def test_against_brute_force(spark):
    docs, items = data()
    got = d.leaks(*frames(spark, docs, items)).collect()
    pairs = [(r.doc_id, r.item_id) for r in got]
    assert set(pairs) == brute(docs, items) and len(pairs) >= 20
    assert all(r.n_equal * d.WINDOW >= r.n_window * d.NEEDED for r in got)
    documents, benchmark = frames(spark, docs, items)
    clean = d.clean_documents(documents, benchmark)
    assert clean.columns == documents.columns
    bad = {i for i, _ in brute(docs, items)}
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(i or -1 for i, t in docs if (i, t) not in [(j, u) for j, u in docs if j in bad])


@pytest.mark.parametrize("n", range(d.LEAST, d.WINDOW + 1))
def test_masks_avoid_any_changed_words(n):
    """Every set of changed words that the verifier accepts leaves some mask whole in some place."""
    most = n - -(-n * d.NEEDED // d.WINDOW)
    places = [{p + k for k, b in enumerate(m) if b == "1"} for m in d.masks_of(n) for p in range(n - len(m) + 1)]
    assert all(any(not seed & set(changed) for seed in places) for changed in itertools.combinations(range(n), most))


def verified(docs, items):
    """Every diagonal of every document and item, whatever the masks."""
    out = set()
    for doc_id, text in docs:
        w = words(text)
        for item_id, t in items:
            v = words(t)
            n = min(d.WINDOW, len(v))
            for g in range(-len(v), len(w)) if len(v) >= d.LEAST else ():
                equal = [w[s] == v[s - g] for s in range(max(0, g), min(len(w), g + len(v)))]
                if any(sum(equal[s : s + n]) * d.WINDOW >= n * d.NEEDED for s in range(len(equal) - n + 1)):
                    out.add((doc_id, item_id))
    return out


def test_against_the_verifier_alone(spark):
    """Overlaps of 5 to 16 words with as many changed words as count, at any places, the ends too."""
    rng = random.Random(5)
    make = lambda n: ["".join(rng.choices("abcdef", k=4)) for _ in range(n)]
    items = [(n, make(n)) for n in range(4, 17)]
    docs = []
    for n, item in items:
        most = len(item) - -(-min(13, n) * d.NEEDED // d.WINDOW) - max(0, n - 13)
        every = list(itertools.combinations(range(n), most))
        for changed in rng.sample(every, min(4, len(every))) + [tuple(range(most)), tuple(range(n - most, n)), tuple(range(most + 1))]:
            docs.append((len(docs), " ".join(make(rng.randint(0, 9)) + ["x" if k in changed else w for k, w in enumerate(item)] + make(rng.randint(0, 9)))))
    texts = [(n, " ".join(item)) for n, item in items]
    found = {(r.doc_id, r.item_id) for r in d.leaks(*frames(spark, docs, texts)).collect()}
    assert found == verified(docs, texts) and len(found) >= 70


def test_full_filter_lets_everything_through(spark, monkeypatch):
    monkeypatch.setattr(d, "BITS", 6)
    docs, items = data()
    docs = docs[:30]
    assert {(r.doc_id, r.item_id) for r in d.leaks(*frames(spark, docs, items)).collect()} == brute(docs, items)


def test_empty_tables(spark):
    docs, items = data()
    assert d.leaks(*frames(spark, [], items)).count() == 0
    assert d.leaks(*frames(spark, docs, [])).count() == 0
    assert d.clean_documents(*frames(spark, docs[:5], [])).count() == 5
