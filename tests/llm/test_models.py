"""Toxicity, quality and language models: held-out accuracy, gradients and edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import masked_lm, quality_cnn, toxicity
from tessera.llm.common import slices

DOCS = "doc_id long, text string, score string, lang string"
LABELS = "doc_id long, quality int, toxic int"
EDGE = [(9001, None, "x", "en"), (9002, "", "x", "en"), (None, "a b", "x", None), (9003, "word " * 30000, "x", "en"), (9003, "word " * 30000, "x", "en")]


def folds(ids):
    return {i: zlib.crc32(str(i).encode() if i is not None else b"") % 4 == 2 for i in ids}


def accuracy(rows, labels):
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 30
    return sum(r.predicted == labels[r.doc_id] for r in held) / len(held)


@pytest.fixture(scope="module")
def toxic_docs():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(["an", "er", "ti", "on", "sch", "le"], k=rng.randint(1, 4)))
    rows, labels = [], {}
    for i in range(500):
        bad = i % 4 == 0
        w = [word() for _ in range(rng.randint(5, 150))]
        for _ in range(1 + len(w) // 40 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["Vile!", "blurgh" + word()])
        rows.append((i, " ".join(w), "x", "en"))
        labels[i] = int(bad)
    return rows, labels


def label_frame(spark, labels, column):
    out = [(i, y, 0) if column == "quality" else (i, 0, y) for i, y in labels.items()]
    return spark.createDataFrame([*out, (None, 1, 1), (5, None, None), (123456, 1, 1)], LABELS)


def test_toxicity(spark, toxic_docs):
    rows, labels = toxic_docs
    got = toxicity.classified(spark.createDataFrame(rows + EDGE, DOCS).repartition(3), label_frame(spark, labels, "toxic")).collect()
    assert len(got) == len(rows) + len(EDGE)
    assert accuracy(got, labels) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.doc_id: r.held_out for r in got} == folds(r.doc_id for r in got)
    assert len({r.score for r in got if r.doc_id == 9003}) == 1


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], {}
    for i in range(400):
        bad = i % 3 == 0
        w = ["".join(rng.choices("aeinst", k=rng.randint(1, 7))) for _ in range(rng.randint(10, 200))]
        if bad:
            w = [x + rng.choice(["##", "|", "$$"]) for x in w] if i % 2 else w[:6] * 20
        rows.append((i, " ".join(w), "x", "en"))
        labels[i] = int(not bad)
    got = quality_cnn.classified(spark.createDataFrame(rows + EDGE, DOCS).repartition(3), label_frame(spark, labels, "quality")).collect()
    assert accuracy(got, labels) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


@pytest.mark.parametrize("model", [toxicity, quality_cnn])
def test_no_labels_and_no_rows(spark, model):
    docs, labels = spark.createDataFrame(EDGE, DOCS), spark.createDataFrame([], LABELS)
    assert len({r.score for r in model.classified(docs, labels).collect()}) == 1
    assert model.classified(docs.limit(0), labels).count() == 0


def test_windows_cover_whole_texts():
    for n in (0, 1, 31, 32, 33, 55, 56, 57, 500):
        every, owner, begin = toxicity.windows([np.arange(1, n + 1), np.arange(1, 4)])
        assert set(every[owner == 0].ravel()) - {0} == set(range(1, n + 1))
    for n in (0, 1, 127, 128, 129, 224, 225, 1000):
        text = bytes(1 + i % 250 for i in range(n))
        every, first = quality_cnn.chunks([text, b"abc"])
        assert sum(bytes(c[: quality_cnn.STEP]) .count(7) for c in every[: first[1]]) >= text.count(7)
        assert bytes(every[first[1] - 1]).rstrip(b"\0")[-1:] == text[-1:]


def _numeric(f, p, name, at):
    eps = 1e-3
    keep = p[name][at]
    p[name][at] = keep + eps
    up = f()
    p[name][at] = keep - eps
    down = f()
    p[name][at] = keep
    return (up - down) / (2 * eps)


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity._fresh(rng).items() if k not in ("words", "grams")}
    x = rng.standard_normal((6, 5, 2 * toxicity.DIM))
    mask, y = np.ones((6, 5)), np.array([0, 1, 0, 1, 1])
    mask[4:, 2] = 0

    def loss():
        s = toxicity.sigmoid(toxicity.logits(p, (x @ p["wf"] + p["bf"]).astype(np.float64), x @ p["wb"] + p["bb"], mask))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum()

    keep = {}
    out = toxicity.logits(p, x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"], mask, keep)
    g = toxicity.gradients(p, keep, toxicity.sigmoid(out) - y)
    g["wf"] = np.einsum("tni,tnj->ij", x, g["xf"])
    g["wb"] = np.einsum("tni,tnj->ij", x, g["xb"])
    for name, at in (("wf", (3, 5)), ("wf", (1, 20)), ("wb", (2, 9)), ("uf", (1, 4)), ("ub", (2, 18)), ("wa", (3, 2)), ("va", 1), ("wo", 4), ("bo", 0)):
        assert abs(_numeric(loss, p, name, at) - g[name][at]) < 2e-2 * max(1, abs(g[name][at])), name


def test_gradients_of_the_convolution():
    p = {k: v.astype(np.float64) for k, v in quality_cnn._fresh(np.random.default_rng(1)).items()}
    texts, y = [b"hello world " * 40, b"#$%" * 9, b"abcdefgh" * 30], np.array([1.0, 0.0, 1.0])
    every, first = quality_cnn.chunks(texts)

    def loss():
        s = 1 / (1 + np.exp(-quality_cnn.combined(p, quality_cnn.pooled(p, every), first)[0]))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = quality_cnn._step(p, every, first, y)
    for name, at in (("w2", 3), ("b2", 0), ("w1", (5, 2)), ("w1", (20, 1)), ("w1", (40, 3)), ("filters", (3, 2)), ("bias", 4)):
        assert abs(_numeric(loss, p, name, at) - g[name][at]) < 5e-3, name


def test_language_model_prefers_order(spark):
    rng = random.Random(3)
    phrase = "the cat sat on a mat while seven dogs ran past old red barns near our cold green lake".split()
    rows = []
    for i in range(400):
        k = rng.randrange(len(phrase))
        w = (phrase[k:] + phrase[:k]) * rng.randint(3, 12)
        if i % 10 == 0:
            rng.shuffle(w)
        rows.append((i, " ".join(w), "x", "en"))
    got = masked_lm.scored(spark.createDataFrame(rows + EDGE, DOCS).repartition(4)).collect()
    assert len(got) == len(rows) + len(EDGE)
    mean = {r.doc_id: r.mean_log_likelihood for r in got}
    mixed, plain = [mean[i] for i in range(0, 400, 10)], [mean[i] for i in range(400) if i % 10]
    assert np.mean(plain) > np.mean(mixed) + 0.5
    assert mean[9001] is None and mean[9002] is None
    by_id = {r.doc_id: r for r in got}
    assert by_id[9002].n_tokens == 0 and by_id[9002].log_likelihood == 0 and by_id[9003].n_tokens == 30000
    assert masked_lm.scored(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("known", [0, 40, 200_000])
def test_language_model_scores_each_word_within_its_class(spark, monkeypatch, known):
    """Word scores against a count in Python; a rare word scores below a common one of its class in the same place."""
    monkeypatch.setattr(masked_lm, "KNOWN", known)
    small_vocabulary(monkeypatch, 223, 31)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(700)]
    rows = [(i, " ".join(rng.choices(vocabulary, range(1, 701), k=60)), "x", "en") for i in range(80)]
    rows += [(900, "aaaqzz", "x", "en"), *[(i, "bbbqzz", "x", "en") for i in range(901, 906)], (None, None, "x", "en")]
    counts = Counter(w for r in rows for w in masked_lm.pieces(r[1] or ""))
    frequent = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: masked_lm.FREQUENT]}
    inside = defaultdict(list)
    for w, n in counts.items():
        if w not in frequent:
            inside[zlib.crc32(w[-3:]) % masked_lm.RARE].append(n)
    log = lambda w: 0 if w in frequent else math.log((counts[w] + 1) / (sum(x := inside[zlib.crc32(w[-3:]) % masked_lm.RARE]) + len(x) + 1))
    with monkeypatch.context() as m:
        m.setattr(masked_lm, "log_probabilities", lambda p, ends, docs: np.zeros(len(docs)))
        df = spark.createDataFrame(rows, DOCS).repartition(3)
        got = {r.doc_id: r.log_likelihood for r in masked_lm.scored(df).collect()}
    assert len(inside) > 10 and len(got) == len(rows)
    for doc_id, text, *_ in rows:
        assert abs(got[doc_id] - sum(map(log, masked_lm.pieces(text or "")))) < 1e-5
    assert got[900] < got[901] - 0.5


def small_vocabulary(monkeypatch, frequent, classes):
    for name, value in (("FREQUENT", frequent), ("CLASSES", classes), ("V", 1 + frequent + masked_lm.RARE), ("SYMBOLS", classes + masked_lm.RARE)):
        monkeypatch.setattr(masked_lm, name, value)


def random_model(seed=1):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(1, 90, masked_lm.V)).astype(float)[::-1].copy()
    ends = masked_lm.class_ends(counts)
    return {k: v.astype(np.float64) for k, v in masked_lm.fresh(counts, ends).items()}, ends


def plain_log_probability(p, ends, doc, i):
    """One token's log-probability, without batches."""
    padded = [0, 0, *map(int, doc), 0, 0]
    around = [padded[i], padded[i + 1], padded[i + 3], padded[i + 4]]
    h = np.tanh(p["b1"] + sum(p["e"][t] @ p["w1"][k] for k, t in enumerate(around)))
    log_softmax = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    t = int(doc[i])
    if t > masked_lm.FREQUENT:
        return log_softmax(h @ p["w2"] + p["b2"])[masked_lm.CLASSES + t - 1 - masked_lm.FREQUENT]
    c = next(c for c, end in enumerate(ends) if t < end)
    low = ends[c - 1] if c else 1
    inside = log_softmax(p["u"][low : ends[c]] @ h + p["bu"][low : ends[c]])[t - low]
    return log_softmax(h @ p["w2"] + p["b2"])[c] + inside


def test_language_model_sums_all_tokens(monkeypatch):
    """Vectorised sums against one token at a time, over classes of one word, of several and of rare words."""
    small_vocabulary(monkeypatch, 60, 9)
    p, ends = random_model()
    docs = [np.array(d, np.uint16) for d in ([], [5, 9, 77], [1], list(range(1, masked_lm.V)) * 2)]
    got = masked_lm.log_probabilities(p, ends, docs, at_once=7)
    for doc, total in zip(docs, got):
        assert abs(total - sum(plain_log_probability(p, ends, doc, i) for i in range(len(doc)))) < 1e-3 * max(1, abs(total))


def test_language_model_probabilities_sum_to_one(monkeypatch):
    small_vocabulary(monkeypatch, 60, 9)
    p, ends = random_model(2)
    total = sum(math.exp(plain_log_probability(p, ends, [7, t, 9], 1)) for t in range(1, masked_lm.V))
    assert abs(total - 1) < 1e-6


def test_gradients_of_the_language_model(monkeypatch):
    """The first step of training against numeric gradients: Adam's first moment is a tenth of the gradient."""
    small_vocabulary(monkeypatch, 60, 9)
    p, ends = random_model(3)
    doc = np.array([3, 50, 9, 70, 60, 1, 2, 3], np.uint16)
    loss = lambda: -sum(plain_log_probability(p, ends, doc, i) for i in range(0, len(doc), 2)) / 4
    numeric = {(n, at): _numeric(loss, p, n, at) for n, at in (("e", (50, 3)), ("w1", (1, 2, 5)), ("b1", 4), ("w2", (6, 2)), ("b2", 8), ("u", (60, 1)), ("bu", 60), ("bu", 9))}
    q = {k: v.copy() for k, v in p.items()}
    zeros = np.zeros_like
    made = []
    monkeypatch.setattr(masked_lm.np, "zeros_like", lambda x: made.append(zeros(x)) or made[-1])
    masked_lm.train(q, ends, iter([[doc]]), 1e-9, 0)
    monkeypatch.setattr(masked_lm.np, "zeros_like", zeros)
    first = dict(zip(q, made[0 : 2 * len(q) : 2]))
    for (name, at), value in numeric.items():
        assert abs(first[name][at] * 10 - value) < 2e-3 * max(1, abs(value)), name


def test_language_model_is_trained_on_every_position(monkeypatch):
    small_vocabulary(monkeypatch, 60, 9)
    p, ends = random_model()
    docs = [np.array(d, np.uint16) for d in ([], [5], [5, 9, 77], list(range(1, 90)) * 20)]
    seen, kinds = [], masked_lm._by_class
    monkeypatch.setattr(masked_lm, "_by_class", lambda of, ends: seen.append(len(of)) or kinds(of, ends))
    total = sum(masked_lm.train(p, ends, iter([docs]), rate, phase) for phase, rate in enumerate(masked_lm.RATES))
    assert total == sum(map(len, docs)) == sum(seen)


def test_language_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "PART", 900)
    small_vocabulary(monkeypatch, 100, 12)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", range(1, 27), k=rng.randint(0, 90))), "x", "en") for i in range(120)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n_tokens": F.lit("own"), "log_likelihood": F.lit("own")})
    score = lambda d: sorted((r.doc_id, r.n_tokens, round(r.log_likelihood, 6)) for r in masked_lm.scored(d).collect())
    assert score(df.repartition(2)) == score(df.repartition(7, "text"))


def test_language_model_scores_alike_in_any_blocks():
    """Sorting a block's positions by class, and leaving out the shift of small logits, change no score."""
    rng = np.random.default_rng(8)
    for scale in (1, 400):
        z = (rng.standard_normal((50, 9)) * scale).astype(np.float32)
        d, total = masked_lm._weighed(z.copy())
        e = np.exp(z.astype(np.float64) - z.max(axis=1, keepdims=True))
        assert np.allclose(d / total[:, None], e / e.sum(axis=1, keepdims=True), atol=1e-5)
    counts = np.array([0, *range(masked_lm.FREQUENT, 0, -1), *[5] * masked_lm.RARE], float)
    ends = masked_lm.class_ends(counts)
    p = masked_lm.fresh(counts, ends)
    docs = [rng.integers(1, masked_lm.V, n).astype("<u2") for n in (3, 0, 90, 41)]
    whole = masked_lm.log_probabilities(p, ends, docs)
    assert np.allclose(masked_lm.log_probabilities(p, ends, docs, 7), whole, rtol=1e-5)
    assert np.allclose([masked_lm.log_probabilities(p, ends, [d])[0] for d in docs], whole, rtol=1e-5) and whole[1] == 0


def test_language_model_splits_many_texts_at_once(spark, monkeypatch):
    """Words, counts, tokens and scores against ``pieces`` and dictionaries, over batches of several slices and counts that begin anew."""
    rng = random.Random(11)
    odd = ["", " ", "...", "a", " a b", "É x\ty--İ Σας\n", "a,b", "ß" * 70]
    rows = [(i, rng.choice(odd) + " ".join("".join(rng.choices("aébc", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(300, None), (None, ""), *[(400 + i, t) for i, t in enumerate(odd)]]
    for texts in ([], *[[t] for t in odd], odd, odd[::-1]):
        words, n = masked_lm.split(texts)
        assert words.to_pylist() == [w for t in texts for w in masked_lm.pieces(t)] and n.tolist() == [len(masked_lm.pieces(t)) for t in texts]
        assert masked_lm.ending_classes(words.dictionary).tolist() == [zlib.crc32(w[-3:]) % masked_lm.RARE for w in words.dictionary.to_pylist()]
    monkeypatch.setattr(masked_lm, "SLICE", 500)
    monkeypatch.setattr(masked_lm, "KEPT_WORDS", 60)
    small_vocabulary(monkeypatch, 20, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    counts = Counter(w for _, t in rows for w in masked_lm.pieces(t or ""))
    assert {bytes(r.word): r.n for r in masked_lm.word_counts(df).collect()} == counts
    order = sorted(counts, key=lambda w: (-counts[w], w))
    frequent, known = order[:20], {w: -i for i, w in enumerate(order[20:50])}
    token = {w: i + 1 for i, w in enumerate(frequent)}
    got = Counter((r.doc_id, bytes(r.ids), r.score, tuple(map(bytes, r.rest))) for r in masked_lm.tokens(df, frequent, known).collect())
    want = Counter()
    for i, t in rows:
        own = masked_lm.pieces(t or "")
        ids = np.array([token.get(w) or 21 + zlib.crc32(w[-3:]) % masked_lm.RARE for w in own], "<u2").tobytes()
        want[i, ids, sum(known.get(w, 0) for w in own), tuple(w for w in own if w not in token and w not in known)] += 1
    assert got == want
    assert masked_lm.tokens(df.limit(0), [], {}).count() == 0 and masked_lm.word_counts(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1, 100])
def test_language_model_predicts_runs_of_classes(monkeypatch, scale):
    """A step over tables of classes, with classes of no and of one word and with large logits, against one position at a time."""
    small_vocabulary(monkeypatch, 60, 11)
    p, _ = random_model(5)
    p["u"] *= scale
    ends = np.array([2, 2, 9, 10, 11, 30, 31, 31, 44, 60, 61])
    rng = np.random.default_rng(5)
    doc = rng.integers(1, masked_lm.V, 90).astype(np.uint16)
    plain = lambda doc, i: plain_log_probability(p, ends, doc, i)
    assert masked_lm._large(p["u"], p["bu"]) == (scale > 1)
    got = masked_lm.log_probabilities(p, ends, [doc, doc[:0], doc[:7]], 16, 5)
    assert np.allclose(got, [sum(max(plain(d, i), math.log(1e-30)) for i in range(len(d))) for d in (doc, doc[:0], doc[:7])], rtol=1e-4)
    q, zeros, made = {k: v.copy() for k, v in p.items()}, np.zeros_like, []
    monkeypatch.setattr(masked_lm.np, "zeros_like", lambda x: made.append(zeros(x)) or made[-1])
    assert masked_lm.train(q, ends, iter([[doc]]), 1e-9, 1) == 45
    monkeypatch.setattr(masked_lm.np, "zeros_like", zeros)
    first = dict(zip(q, made[0 : 2 * len(q) : 2]))
    loss = lambda: -sum(plain(doc, i) for i in range(1, 90, 2)) / 45
    for t in (1, 2, 8, 20, 59, 60):
        for name, at in (("u", (t, 3)), ("bu", t), ("e", (t, 1))):
            value = _numeric(loss, p, name, at)
            assert abs(first[name][at] * 10 - value) < 2e-3 * max(1, abs(value)), (name, at)
    assert not first["u"][0].any() and not first["u"][61:].any()


def test_language_model_tables_follow_the_rows(monkeypatch):
    """A text of one word does not fill tables up for the classes beside its own; its score is the sum over its positions."""
    small_vocabulary(monkeypatch, 60, 9)
    p, ends = random_model(6)
    monkeypatch.setattr(masked_lm, "UNEVEN", 0)
    for rows in ([0] * 500, [7] * 500, [0] * 300 + [3] * 5 + [8] * 40, [*range(9)] * 20, []):
        of = np.sort(np.array(rows, np.uint8))
        found = list(masked_lm._by_class(of, masked_lm._runs(ends)))
        assert sum(x[1].size for x in found) <= 2 * len(rows)
        assert [i for x in found for i in x[1].ravel()[x[2]]] == list(range(len(rows)))
        assert all(t < ends[of[i]] for x in found for i, t in zip(range(x[0].start, x[0].stop), x[3][x[2] // x[1].shape[1], 0]))
    doc = np.full(700, 59, np.uint16)
    total = sum(plain_log_probability(p, ends, doc, i) for i in range(len(doc)))
    assert abs(masked_lm.log_probabilities(p, ends, [doc])[0] - total) < 1e-3 * abs(total)
    assert masked_lm.train({k: v.copy() for k, v in p.items()}, ends, iter([[doc]]), 1e-3, 0) == 350


def test_models_average_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "FAN_IN", 3)
    rows = [(i, 1 + i % 3, np.full(4, i, "<f4").tobytes()) for i in range(20)]
    got = np.frombuffer(masked_lm.averaged(spark.createDataFrame([(w, m, i) for i, w, m in rows], "weight long, model binary, part long"), 20), "<f4")
    assert np.allclose(got, sum(i * w for i, w, _ in rows) / sum(w for _, w, _ in rows), atol=1e-4)


def test_slices():
    assert [(s.start, s.stop) for s in slices(["ab", "c", "defg", "", "h"], 3)] == [(0, 2), (2, 3), (3, 5)]
    assert list(slices([], 3)) == []
