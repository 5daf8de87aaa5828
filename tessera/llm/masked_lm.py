"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts each token from both sides.

The network sees ``SIDE`` tokens on either side of a masked one and predicts it in two steps: its class, then, among
the corpus's ``FREQUENT`` most frequent words, the word within its class.  These words are dealt to ``CLASSES`` classes
of about equal shares of the square roots of their counts, so that frequent words stand in small classes; all other
words are in ``RARE`` more classes by their endings, and have their share of the class from the counts of all words,
with add-one smoothing.  So a document's score is the sum of the log-probabilities of all its words, each as itself.

Training is where the data are.  Documents are dealt by a hash to parts of about ``PART`` tokens; in each round every
part starts from the shared weights, masks every ``STRIDE``-th position of all its documents, and the parts' weights
are averaged by the positions they saw, in a tree.  A round begins one position further than the one before, so that
every position is a target in one of them.  Parts depend on the documents alone, not on how the input is partitioned.
Words of ``KNOWN`` counts at most are looked up in tasks, all others are joined by word.

Edge cases.  A null or empty text has no tokens, score 0 and no mean; repeated rows count each time and get equal
scores; an empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import exact, scratch, text_slices, written

FREQUENT, CLASSES, RARE, SIDE, DIM, HIDDEN = 8192, 96, 32, 2, 16, 32
V, SYMBOLS = 1 + FREQUENT + RARE, CLASSES + RARE  # token 0 stands beyond a document's ends
RATES, BATCH, PART = (0.01, 0.004), 4096, 2_000_000
STRIDE = len(RATES)
#: Classes whose words are predicted in one step; logits up to which their table may be uneven.
TOGETHER, UNEVEN = 8, 1 << 18
#: Models that one task averages; words that a task counts before it begins anew; bytes of text that it splits at a time.
FAN_IN, KEPT_WORDS, SLICE = 16, 300_000, 2_000_000
#: Words, the most frequent ones, whose log-probabilities within their classes are sent to all tasks; parts of one as whole numbers.
KNOWN, UNIT = 200_000, 1e-9

_TABLE = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
_CRC = np.array([zlib.crc32(bytes([255 - b])) ^ 0xFF000000 for b in range(256)], np.uint32)  # the table of CRC-32


def pieces(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode().translate(_TABLE).split()


def split(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The ``pieces`` of all texts, each distinct word once in the dictionary, and how many each text has."""
    parts = [t.lower().encode().translate(_TABLE) for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin = edges[::2]
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(_offsets(edges[1::2] - begin)), pa.py_buffer(data[inside])])
    stop = np.searchsorted(begin, np.cumsum([1 + len(x) for x in parts]))
    return words.dictionary_encode(), np.diff(stop, prepend=0)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def ending_classes(words: pa.BinaryArray) -> np.ndarray:
    """CRC-32 of each word's last three bytes, modulo ``RARE``."""
    data, ends = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.frombuffer(words.buffers()[1] or bytes(4), np.int32)[words.offset :][: len(words) + 1]
    crc, size = np.full(len(words), 0xFFFFFFFF, np.uint32), np.diff(ends)
    for k in (3, 2, 1):
        has = size >= k
        crc[has] = _CRC[(crc[has] ^ data[ends[1:][has] - k]) & 255] ^ (crc[has] >> 8)
    return (~crc % RARE).astype(np.uint16)


def word_counts(documents: DataFrame) -> DataFrame:
    """How often each word stands in the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for part in text_slices(batch, SLICE):
                words, _ = split(part.column("text").to_pylist())
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)).astype(np.int64)
                held.append(pa.table({"word": words.dictionary, "n": n}))
                size += len(n)
                if size > 2 * KEPT_WORDS:
                    held = [merged()]
                    size = held[0].num_rows
                    if size > KEPT_WORDS:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from merged().to_batches()

    rows = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_scores(counts: DataFrame, frequent: list[bytes]) -> tuple[DataFrame, np.ndarray]:
    """(word, n, score) of the words outside the vocabulary, and the counts of the classes.

    A score is log P(word | class) in ``UNIT``s, so that sums are exact in any order.  Every word counts once more than it
    stands, and so does one word that stands nowhere.
    """
    known = counts.sparkSession.createDataFrame([(w,) for w in frequent], "word binary")
    rare = counts.join(F.broadcast(known), "word", "left_anti").withColumn("class", F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(RARE)).cast("int"))  # FREQUENT words at most
    sums = rare.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()  # RARE rows at most
    total, whole = np.zeros(RARE), np.ones(RARE)
    for c in sums:
        total[c["class"]], whole[c["class"]] = c.n, c.n + c.words + 1
    score = F.round((F.log(F.col("n") + 1) - F.get(F.lit(np.log(whole).tolist()), F.col("class"))) / UNIT).cast("long")
    return rare.select("word", "n", score.alias("score")), total


def known_scores(scores: DataFrame) -> tuple[dict[bytes, int], int]:
    """The scores of words that stand at least so often that ``KNOWN`` words do at most, and that bound as a power of two."""
    sizes = dict(scores.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect())  # 64 rows at most
    power = max(sizes, default=0) + 1
    while power and sum(n for p, n in sizes.items() if p >= power - 1) <= KNOWN:
        power -= 1
    rows = scores.where(F.floor(F.log2("n")) >= power).select("word", "score").toPandas()  # KNOWN rows at most
    return dict(zip(map(bytes, rows["word"]), rows["score"].tolist(), strict=True)), power


def tokens(documents: DataFrame, frequent: list[bytes], known: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids, score, rest): two bytes for each word, the sum of the ``known`` scores, and all words without one."""
    words = pa.array([*frequent, *known], pa.binary())
    # One entry more than words: that of the words which are not among them.
    token = np.concatenate([np.arange(1, len(frequent) + 1), np.zeros(len(known) + 1)]).astype(np.uint16)
    score = np.array([*[0] * len(frequent), *known.values(), 0], np.int64)
    shared = documents.sparkSession.sparkContext.broadcast((words, token, score))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, token, score = shared.value
        for batch in batches:
            parts = [(part.column("doc_id"), *split(part.column("text").to_pylist())) for part in text_slices(batch, SLICE)]
            every = pa.chunked_array([found.dictionary for _, found, _ in parts], pa.binary())
            places, start = pc.index_in(every, value_set=words).fill_null(len(words)).to_numpy(), 0  # one look-up table a batch
            for doc_id, found, n in parts:
                own, at = found.dictionary, found.indices.to_numpy()
                place = places[start : start + len(own)]
                start += len(own)
                ids = token[place]
                ids = np.where(ids > 0, ids, 1 + FREQUENT + ending_classes(own)).astype("<u2")[at]
                sums = np.concatenate([[0], np.cumsum(score[place][at])])
                stop, other = np.cumsum(n), np.flatnonzero((place == len(words))[at])
                rest = pa.ListArray.from_arrays(np.concatenate([[0], np.searchsorted(other, stop)]).astype(np.int32), own.take(pa.array(at[other])))
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(_offsets(2 * n)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_pydict({"doc_id": doc_id, "ids": packed, "score": sums[stop] - sums[stop - n], "rest": rest})

    rows = documents.select(exact("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id decimal(20,0), ids binary, score long, rest array<binary>")


def dealt(rows: DataFrame, total: int) -> DataFrame:
    """The rows with a number ``row``, in parts of about ``PART`` tokens; each part stands in one file, in a fixed order."""
    n = -(-total // PART) or 1
    mixed = F.xxhash64("doc_id", "ids")
    out = rows.withColumn("part", F.pmod(mixed, F.lit(n)).cast("long")).repartition(n, "part").sortWithinPartitions("part", mixed, "doc_id")
    return written(out.withColumn("row", F.monotonically_increasing_id()), "tokens")


def _shapes() -> dict[str, tuple[int, ...]]:
    return {"e": (V, DIM), "w1": (2 * SIDE, DIM, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, SYMBOLS), "b2": (SYMBOLS,), "u": (V, HIDDEN), "bu": (V,)}


def class_ends(counts: np.ndarray) -> np.ndarray:
    """The token at which each class of frequent words ends, from counts by token; a class has no words where words are few."""
    mass = np.cumsum(np.sqrt(counts[1 : 1 + FREQUENT]))
    if not mass[-1]:
        return np.full(CLASSES, 1 + FREQUENT)
    ends = 1 + np.searchsorted(mass, mass[-1] * np.arange(1, CLASSES + 1) / CLASSES, side="left") + 1
    ends[-1] = 1 + FREQUENT
    return np.maximum.accumulate(np.minimum(ends, 1 + FREQUENT))


def class_of(ends: np.ndarray) -> np.ndarray:
    """The class of each token."""
    every = np.arange(V)
    return np.where(every > FREQUENT, CLASSES + every - 1 - FREQUENT, np.searchsorted(ends, every, side="right")).astype(np.uint8)


def pack(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[k].ravel() for k in _shapes()]).astype("<f4").tobytes()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(data, "<f4"), 0, {}
    for k, shape in _shapes().items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).copy()
        at += n
    return out


def fresh(counts: np.ndarray, ends: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Random weights; the outputs start at the frequencies of classes and of words within them."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in _shapes().items()}
    p["w1"] *= 0.5
    p["b1"] *= 0
    p["u"] *= 0.1
    by_class = np.bincount(class_of(ends)[1:], counts[1:], SYMBOLS)
    p["b2"] = np.log((by_class + 1) / (by_class.sum() + SYMBOLS)).astype(np.float32)
    p["bu"] = np.log(counts + 1).astype(np.float32)
    return p


def contexts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens in a row with ``SIDE`` zeros around each document, the places of the tokens, and their counts."""
    gap = np.zeros(SIDE, np.uint16)
    data = np.concatenate([gap, *[x for d in docs for x in (d, gap)]])
    n = np.fromiter(map(len, docs), np.int64, len(docs))
    begin = SIDE + np.cumsum(n + SIDE) - (n + SIDE)
    return data, np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n), n


_AROUND = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


def _large(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether a logit of weights ``w``, a row a symbol, and ``b`` may be beyond 60: hidden values are between -1 and 1."""
    return bool((np.abs(w) @ np.ones(w.shape[1], w.dtype) + np.abs(b)).max() > 60)


def _weighed(z: np.ndarray, large: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of logits, in place, and their sums by row; rows are shifted by their maxima where any logit is large."""
    if large and z.size and (z.max() > 60 or z.min() < -60):
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


Run = tuple[int, int, np.ndarray, np.ndarray]


def _runs(ends: np.ndarray) -> list[Run]:
    """Runs of ``TOGETHER`` classes: first, end, a table with the tokens of one class a row, and which of them are its own."""
    low, out = np.concatenate([[1], ends[:-1]]), []
    for c in range(0, CLASSES, TOGETHER):
        begin, end = low[c : c + TOGETHER, None], ends[c : c + TOGETHER, None]
        tokens = begin + np.arange(max(1, (end - begin).max()))
        out.append((c, c + len(begin), np.minimum(tokens, V - 1), tokens < end))
    return out


def _by_class(of: np.ndarray, runs: list[Run]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of classes that has rows, which are in the order of their classes: these rows, a table with the rows of one
    class a row, the place of each row in it, and the run's tables of tokens.  Tables are filled up with rows and tokens of others;
    where a large table would have over twice as many places as rows, each class of the run is a run of its own.
    """
    edges = np.searchsorted(of, np.arange(CLASSES + 1))
    for first, last, tokens, own in runs:
        n = np.diff(edges[first : last + 1])
        even = n.max() * len(n) <= max(2 * n.sum(), UNEVEN // tokens.shape[1])
        for low, high in [(first, last)] if even else [(c, c + 1) for c in range(first, last) if n[c - first]]:
            begin, stop, most = int(edges[low]), int(edges[high]), int(n[low - first : high - first].max())
            if stop > begin:
                kind, each = of[begin:stop].astype(np.intp) - low, slice(low - first, high - first)
                table = np.minimum(edges[low:high, None] + np.arange(most), stop - 1)
                width = int(own[each].sum(axis=1).max())
                yield slice(begin, stop), table, np.arange(begin, stop) - edges[low:high][kind] + kind * most, tokens[each, :width], own[each, :width]


def _logits(p: dict, h: np.ndarray, tokens: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of tables of hidden rows and of tokens, and the tokens' weights; the probability of others' tokens is 0."""
    u = p["u"].take(tokens, axis=0)
    z = h @ u.swapaxes(1, 2)
    z += np.where(own, p["bu"].take(tokens), -1e4)[:, None].astype(z.dtype)
    return z, u


def _tanh(h: np.ndarray) -> None:
    """In place, by exponentials, which are vectorised on more machines."""
    np.minimum(h, 20, out=h)  # where it is 1
    h *= 2
    np.exp(h, out=h)
    h += 1
    np.divide(-2, h, out=h)
    h += 1


def train(p: dict, ends: np.ndarray, batches: Iterator[list[np.ndarray]], rate: float, phase: int) -> int:
    """Adam over masked positions in place; returns how many positions it saw.

    Softmaxes stay undivided: rows are divided by their sums where they are narrower, before and after the products.
    Gradients are a tenth of a batch's mean, which is what the first moment takes of them; the second takes its square.
    """
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    g, kinds, step, seen = {k: np.zeros_like(v) for k, v in p.items()}, class_of(ends), 0, 0
    every, runs, low = np.arange(BATCH), _runs(ends), np.concatenate([[1], ends[:-1], np.arange(1 + FREQUENT, V)])
    for docs in batches:
        data, places, n = contexts(docs)
        within = np.arange(len(places)) - np.repeat(np.cumsum(n) - n, n)
        masked = places[within % STRIDE == phase]
        order = np.random.default_rng(len(masked)).permutation(masked)
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            at = at[np.argsort(kinds[data[at]], kind="stable")]
            around, target, m = data[at + _AROUND[:, None]].astype(np.intp), data[at].astype(np.intp), len(at)
            of, w1 = kinds[target], p["w1"].reshape(-1, HIDDEN)
            x = p["e"].take(around.T, axis=0).reshape(m, -1)
            h = x @ w1
            h += p["b1"]
            _tanh(h)
            z = h @ p["w2"]
            z += p["b2"]
            d, total = _weighed(z, _large(p["w2"].T, p["b2"]))
            d.reshape(-1)[every[:m] * SYMBOLS + of] -= total
            part = (0.1 / m / total)[:, None]
            g["w2"], g["b2"], dh = (d.T @ (h * part)).T.copy(), part[:, 0] @ d, d @ p["w2"].T
            dh *= part
            g["u"][:], g["bu"][:] = 0, 0
            large, inside = _large(p["u"], p["bu"]), target - low[of]
            for rows, table, place, tokens, own in _by_class(of, runs):
                near = h.take(table, axis=0)
                z, u = _logits(p, near, tokens, own)
                d, total = _weighed(z.reshape(-1, z.shape[2]), large)
                total = total[place]
                d.reshape(-1)[place * d.shape[1] + inside[rows]] -= total
                part = np.zeros((table.size, 1), h.dtype)
                part[place, 0] = own_part = 0.1 / m / total
                dh[rows] += (z @ u).reshape(-1, HIDDEN)[place] * own_part[:, None]
                part = part.reshape(*table.shape, 1)
                near *= part
                words = slice(tokens[0, 0], tokens[0, 0] + np.count_nonzero(own))
                g["u"][words], g["bu"][words] = (z.swapaxes(1, 2) @ near)[own], (part.swapaxes(1, 2) @ z)[:, 0][own]
            h *= h
            np.subtract(1, h, out=h)
            dh *= h
            g["w1"], g["b1"] = (x.T @ dh).reshape(2 * SIDE, DIM, HIDDEN), dh.sum(axis=0)
            dx, to = (w1 @ dh.T).reshape(2 * SIDE, DIM, m).swapaxes(0, 1).astype(np.float64), around.ravel()
            for j in range(DIM):
                g["e"][:, j] = np.bincount(to, dx[j].ravel(), V)
            step, seen = step + 1, seen + m
            scale = float(np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * rate)
            for name, grad in g.items():  # in place: temporaries of this size cost more than the sums
                first, second = moments[name]
                first *= 0.9
                first += grad
                grad *= grad
                second *= 0.99
                second += grad
                np.sqrt(second, out=grad)
                grad += 1e-6
                np.divide(first, grad, out=grad)
                grad *= scale
                p[name] -= grad
    return seen


def log_probabilities(p: dict, ends: np.ndarray, docs: list[np.ndarray], at_once: int = 32768, inner: int = 2048) -> np.ndarray:
    """Sum over each document's tokens of the log-probability given both sides; ``inner`` rows of class logits stay in a cache."""
    data, places, n = contexts(docs)
    kinds, w1 = class_of(ends), p["w1"].reshape(-1, HIDDEN)
    each, every, runs, low = np.empty(len(places)), np.arange(inner), _runs(ends), np.concatenate([[1], ends[:-1], np.arange(1 + FREQUENT, V)])
    large, large_u = _large(p["w2"].T, p["b2"]), _large(p["u"], p["bu"])
    for k in range(0, len(places), at_once):
        at = places[k : k + at_once]
        order = np.argsort(kinds[data[at]], kind="stable")
        at = at[order]
        target = data[at].astype(np.intp)
        of = kinds[target]
        h, right = np.empty((len(at), HIDDEN), w1.dtype), np.empty(len(at), w1.dtype)
        for i in range(0, len(at), inner):
            own = h[i : i + inner]
            np.matmul(p["e"].take(data[at[i : i + inner, None] + _AROUND], axis=0).reshape(len(own), -1), w1, out=own)
            own += p["b1"]
            _tanh(own)
            z = own @ p["w2"]
            z += p["b2"]
            d, total = _weighed(z, large)
            np.divide(d.reshape(-1)[every[: len(own)] * SYMBOLS + of[i : i + inner]], total, out=right[i : i + inner])
        inside = target - low[of]
        for rows, table, place, tokens, own in _by_class(of, runs):
            z, _ = _logits(p, h.take(table, axis=0), tokens, own)
            d, total = _weighed(z.reshape(-1, z.shape[2]), large_u)
            right[rows] *= d.reshape(-1)[place * d.shape[1] + inside[rows]] / total[place]
        each[k + order] = np.log(np.maximum(right, 1e-30).astype(np.float64))
    sums = np.concatenate([[0.0], np.cumsum(each)])
    stop = np.cumsum(n)
    return sums[stop] - sums[stop - n]


def _groups(docs: Iterator[np.ndarray], most: int = 400_000) -> Iterator[list[np.ndarray]]:
    """Runs of documents of about ``most`` tokens; a longer one is a run of its own."""
    held, size = [], 0
    for d in docs:
        if held and size + len(d) > most:
            yield held
            held, size = [], 0
        held.append(d)
        size += len(d)
    if held:
        yield held


def averaged(parts: DataFrame, n: int) -> bytes | None:
    """The mean of (part, weight, model) rows by weight, ``FAN_IN`` models a task, level by level, in the order of the parts."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        total, out = 0, 0.0
        for row in rows.sort_values("part").itertuples(index=False):
            total, out = total + row.weight, out + row.weight * np.frombuffer(row.model, "<f4").astype(np.float64)
        return pd.DataFrame({"part": [int(rows["group"].iloc[0])], "weight": [total], "model": [(out / total).astype("<f4").tobytes()]})

    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = written(parts.withColumn("group", F.pmod("part", F.lit(n))).groupBy("group").applyInPandas(mean, "part long, weight long, model binary"), "models")
    rows = parts.collect()  # FAN_IN models of a fixed size at most
    return mean(pd.DataFrame([(0, r.part, r.weight, bytes(r.model)) for r in rows], columns=["group", "part", "weight", "model"]))["model"][0] if rows else None


def fit(ids: DataFrame, counts: np.ndarray, ends: np.ndarray, n: int) -> bytes:
    """The packed weights after all rounds over the ``n`` parts."""
    model = pack(fresh(counts, ends))
    for phase, rate in enumerate(RATES):

        def local(batches: Iterator[pd.DataFrame], start: bytes = model, phase: int = phase, rate: float = rate) -> Iterator[pd.DataFrame]:
            rows = ((part, x) for b in batches for part, x in zip(b["part"], b["ids"], strict=True))
            for part, own in groupby(rows, key=lambda r: r[0]):
                p = unpack(start)
                if seen := train(p, ends, _groups(np.frombuffer(x, "<u2") for _, x in own), rate, phase):
                    yield pd.DataFrame({"part": [part], "weight": [seen], "model": [pack(p)]})

        with scratch(ids.sparkSession):
            parts = written(ids.select("part", "ids").mapInPandas(local, "part long, weight long, model binary"), "models")
            model = averaged(parts, n) or model
    return model


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_likelihood of every document."""
    counts = written(word_counts(documents), "word_counts")
    top = [(bytes(r.word), r.n) for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    frequent = [w for w, _ in top]
    scores, classes = word_scores(counts, frequent)
    known, power = known_scores(scores)
    ids = dealt(tokens(documents, frequent, known), total)
    by_token = np.array([0, *[n for _, n in top], *[0] * (FREQUENT - len(top)), *classes], float)
    ends = class_ends(by_token)
    model = documents.sparkSession.sparkContext.broadcast(fit(ids, by_token, ends, -(-total // PART) or 1))  # a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = unpack(model.value)
        for batch in batches:
            docs = [np.frombuffer(x, "<u2") for x in batch["ids"]]
            sums = [log_probabilities(p, ends, part) for part in _groups(iter(docs))]
            n = np.fromiter(map(len, docs), np.int64, len(docs))
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "n_tokens": n, "score": batch["score"], "log_likelihood": np.concatenate(sums) if sums else np.zeros(0)})

    out = ids.select("row", "doc_id", "ids", "score").mapInPandas(run, "row long, doc_id decimal(20,0), n_tokens long, score long, log_likelihood double")
    others = scores.where(F.floor(F.log2("n")) < power).select("word", F.col("score").alias("other"))  # of few counts, so that no word is in many rows
    rest = ids.select("row", F.explode("rest").alias("word")).join(others, "word").groupBy("row").agg(F.sum("other").alias("other"))
    words = (F.col("score") + F.coalesce("other", F.lit(0))) * UNIT
    out = out.join(rest, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + words)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))
