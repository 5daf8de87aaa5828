import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_words string, bin int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    words = WORD.findall(t)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def vector(s):
    n, chars = max(1, s[0]), max(1, s[1])
    return [math.log(n), math.log(chars / n), math.log1p(100 * s[2] / chars), math.log1p(s[3]), math.log1p(100 * s[4] / n)]


def brute(rows):
    """Verdicts with the same estimates, group by group in numpy."""
    stats = [base(r[1]) for r in rows]
    passing = [i for i, s in enumerate(stats) if not s[5]]
    groups = defaultdict(list)
    for i in passing:
        for key in ((), rows[i][2:3], rows[i][2:4]):
            groups[len(key), *key].append(i)
    vectors = {k: np.array([vector(stats[i]) for i in v]) for k, v in groups.items()}
    floors, p = np.array(list(quality.FLOORS.values())), quality.P

    def drawn(raw):
        out = {}
        for k in sorted(raw, key=lambda k: k[0]):
            n, mean, cov = raw[k]
            if k[0]:
                wide, share = out[k[0] - 1, *k[1:-1]], n / (n + quality.PRIOR)
                mean, cov = share * mean + (1 - share) * wide[0], share * cov + (1 - share) * wide[1]
            out[k] = mean, cov
        return {k: (m, c + np.diag(np.maximum(floors**2 - np.diag(c), 0))) for k, (m, c) in out.items()}

    distance = lambda k, m, c: np.einsum("ni,ij,nj->n", vectors[k] - m, np.linalg.inv(c), vectors[k] - m)
    bins = lambda d: np.floor(np.log2(d + 1e-6) * quality.BINS)

    def concentrated(k, m, c, cut=None):
        x, b = vectors[k], bins(distance(k, m, c))
        before, size = np.array([(b < v).sum() for v in b]), np.array([(b == v).sum() for v in b])
        part = np.clip((min(len(x), (len(x) + p + 1) / 2) - before) / size, 0, 1)
        if cut is not None:
            part = np.where(b < bins(cut), 1, part)
        n = part.sum()
        mean = part @ x / n
        factor = quality.WEIGHT_FACTOR if cut is not None else 1 + (quality.SUBSET_FACTOR - 1) * 2 * (1 - n / len(x))
        return n, mean, factor * ((x.T * part) @ x / n - np.outer(mean, mean))

    def first(k):
        x = vectors[k]
        quartile = lambda q: np.sort(x, axis=0)[math.ceil(q * len(x)) - 1]
        middle, wide = quartile(0.5), np.maximum((quartile(0.75) - quartile(0.25)) / 1.349, floors)
        z = (x - middle) / wide
        t, scale = np.tanh(z), np.outer(wide, wide)
        sign = z / np.sqrt(np.maximum((z * z).sum(axis=1), 1e-12))[:, None]
        bent = t.T @ t / len(x) - np.outer(t.mean(axis=0), t.mean(axis=0))
        return [(middle, scale * np.eye(p)), (middle, scale * p * (sign.T @ sign) / len(x)), (middle + wide * t.mean(axis=0), scale * bent / quality.TANH)]

    starts = {k: first(k) for k in vectors}
    raw = [{k: (len(vectors[k]), *starts[k][s]) for k in vectors} for s in range(quality.STARTS)]
    before = None
    for _ in range(quality.STEPS):
        by = [drawn(r) for r in raw]
        now = [{k: np.linalg.slogdet(c)[1] for k, (_, c) in b.items()} for b in by]
        if before and max((abs(n[k] - o[k]) for n, o in zip(now, before) for k in n), default=0) < quality.SETTLED:
            break
        before, raw = now, [{k: concentrated(k, *b[k]) for k in b} for b in by]
    by = [drawn(r) for r in raw]
    best = {k: min((np.linalg.slogdet(b[k][1])[1], s) for s, b in enumerate(by))[1] for k in vectors}
    last = drawn({k: concentrated(k, *by[best[k]][k], quality.WEIGHT_CUT) for k in vectors})
    verdict = [False] * len(rows)
    for k in (k for k in vectors if k[0] == 2):
        for i, d in zip(groups[k], distance(k, *last[k])):
            verdict[i] = d <= quality.CUTOFF
    return [(r[0], *s, bool(v)) for r, s, v in zip(rows, stats, verdict)]


def rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefé", k=rng.randint(1, 8)))
    out = []
    for i in range(420):
        words = [word() for _ in range(rng.randint(55, 300))]
        kind = rng.random()
        if kind < 0.06:
            words = [w + "***" for w in words]
        elif kind < 0.1:
            words = words[:5] * 30
        elif kind < 0.2:
            words = words[:20] + words
        text = " ".join(w + ("\n" if rng.random() < 0.05 else "") for w in words)
        out.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", None]), "n", 1))
    return out + [(500, None, "en", "a", "n", 1), (501, "", None, None, "n", 1), (None, " \t\x0b\x0c\r\n", "xx", "y", "n", 1), (502, "a b c d", "en", "a", "n", 1), (502, "a b c d", "en", "a", "n", 1), (503, "w\x1c|\xa0x " * 6000, "en", "a", "n", 1)]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, DOCS).repartition(3)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = Counter(tuple(r) for r in quality.verdicts(df).select(*names).collect())
    expect = brute(data)
    assert got == Counter(expect)
    assert {True, False} <= {e[-1] for e in expect if not e[-2]}


@pytest.mark.parametrize("share", [0.34, 0.45])
@pytest.mark.parametrize("copies", [True, False])
def test_junk_of_a_third_of_a_group(spark, share, copies):
    """Symbol-ridden junk, copies of one text or varied, is rejected whatever its share below a half."""
    rng = random.Random(6)
    text = lambda tail: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) + tail for _ in range(rng.randint(60, 400)))
    clean, n = 258, round(258 * share / (1 - share))
    one = text("*#$")
    data = [(i, text(""), "en", "a", "n", 1) for i in range(clean)] + [(1000 + i, one if copies else text("*#$"), "en", "a", "n", 1) for i in range(n)]
    kept = {r.doc_id for r in quality.verdicts(spark.createDataFrame(data, DOCS)).where("kept").collect()}
    assert not [i for i in kept if i >= 1000] and len(kept) >= 0.98 * clean


def test_stage_keeps_columns(spark):
    df = spark.createDataFrame(rows(), DOCS)
    out = quality.kept_documents(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {r[0] for r in brute(rows()) if r[-1]}


@pytest.mark.parametrize("data", [[], [(1, None, None, None, None, None)]])
def test_small_tables(spark, data):
    assert [r.kept for r in quality.verdicts(spark.createDataFrame(data, DOCS)).collect()] == [False] * len(data)


def test_plan_is_native(spark):
    out = quality.verdicts(spark.createDataFrame(rows()[:80], DOCS))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
