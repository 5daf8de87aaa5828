"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is an embedding of the word and the maximum over embeddings of its character n-grams.  The network
reads overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, that cover the whole text; attention pools a
window's states into one logit, and a document's score is that of its highest window.  Training fits the highest
window of each labelled document.  The embeddings' first entry starts at the smoothed log-odds of the word or
n-gram in the labelled documents, the others at random.

Edge cases.  A null or empty text is one window of padding; without labels of both classes every score is the share
of toxic labels (0 without any); repeated rows get equal scores; an empty table gives an empty result.  Only the
text enters a score; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import exact, held_out, slices, training_sample

WINDOW, STRIDE, HIDDEN, DIM, ATTENTION = 32, 24, 8, 8, 8
WORD_ROWS, GRAM_ROWS, GRAMS = 1 << 17, 1 << 18, (4, 6, 8)
#: Labelled documents of either class in the fit at most, their longest text, passes over them.
MOST, LONGEST, EPOCHS, BATCH, RATE = 2000, 60_000, 10, 64, 0.01
THRESHOLD, SEEN, UNKNOWN = 0.3, 6, {"words": 0, "grams": -1}
#: Words that a task keeps prepared at most, before it begins anew.
KEPT_WORDS = 150_000

_TABLE = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def pieces(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode().translate(_TABLE).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words' own embeddings, n-gram rows of all words in a row, and where each word's begin."""
    marked = [b"<" + w + b">" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(marked) + bytes(max(GRAMS)), np.uint8).astype(np.uint64)
    end = np.repeat(begin + size, size)
    at, owner = np.arange(int(size.sum())), np.repeat(np.arange(len(words)), size)
    found, owners = [], []
    with np.errstate(over="ignore"):
        rolled, whole = np.zeros(len(at), np.uint64), np.zeros(len(words), np.uint64)
        for k in range(max(GRAMS)):
            rolled = rolled * np.uint64(0x100000001B3) + data[at + k] + np.uint64(1)
            if k + 1 in GRAMS:
                fits = (at + k + 1 <= end) | ((at == np.repeat(begin, size)) & (k + 1 == GRAMS[0]))
                found.append(((rolled * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) >> np.uint64(46))[fits].astype(np.int64))
                owners.append(owner[fits])
        np.add.at(whole, owner, (data[: len(at)] + np.uint64(7)) * (np.uint64(0xD6E8FEB86659FD93) ** (at - np.repeat(begin, size)).astype(np.uint64)))
        whole = (whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)
    order = np.argsort(np.concatenate(owners), kind="stable")
    rows, owners = np.concatenate(found)[order] % GRAM_ROWS, np.concatenate(owners)[order]
    return whole.astype(np.int64) % WORD_ROWS, rows, np.searchsorted(owners, np.arange(len(words)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    n = lambda *shape, s=0.3: (rng.standard_normal(shape) * s).astype(np.float32)
    p = {"words": n(WORD_ROWS, DIM, s=0.05), "grams": n(GRAM_ROWS, DIM, s=0.05), "wa": n(2 * HIDDEN, ATTENTION), "va": n(ATTENTION), "wo": n(2 * HIDDEN), "bo": np.float32([-1])}
    for d in "fb":
        p |= {f"w{d}": n(2 * DIM, 3 * HIDDEN), f"u{d}": n(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p


def _run(x: np.ndarray, u: np.ndarray, kept: list | None = None) -> np.ndarray:
    """States (T, N, H) of a gated recurrent pass over projected inputs (T, N, 3H)."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((*x.shape[:2], HIDDEN), np.float32)
    for t in range(len(x)):
        g = h @ u
        zr = x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
        np.exp(np.negative(zr, out=zr), out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + r * gn)
        if kept is not None:
            kept.append((h, z, r, gn, c))
        h = c + z * (h - c)
        out[t] = h
    return out


def _back(dh_all: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u``."""
    dx, du, dh = np.empty((*dh_all.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u), 0
    for t in reversed(range(len(dh_all))):
        h, z, r, gn, c = kept[t]
        dh = dh + dh_all[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * gn * r * (1 - r)
        dg = np.concatenate([dz, dr, dc * r], axis=1)
        dx[t] = np.concatenate([dz, dr, dc], axis=1)
        du += h.T @ dg
        dh = dh * z + dg @ u.T
    return dx, du


def logits(p: dict, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Window logits from projected inputs (T, N, 3H) of both directions; ``mask`` (T, N) marks words."""
    kf, kb = ([], []) if keep is not None else (None, None)
    h = np.concatenate([_run(xf, p["uf"], kf), _run(xb[::-1], p["ub"], kb)[::-1]], axis=2)
    a = np.tanh(h @ p["wa"])
    s = a @ p["va"] - 1e4 * (1 - mask)
    e = np.exp(s - s.max(axis=0))
    w = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", w, h)
    if keep is not None:
        keep |= {"kf": kf, "kb": kb, "h": h, "a": a, "w": w, "pooled": pooled}
    return pooled @ p["wo"] + p["bo"]


def gradients(p: dict, keep: dict, dlogit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of all but the embeddings, and of the projected inputs as xf, xb."""
    h, a, w = keep["h"], keep["a"], keep["w"]
    g = {"wo": keep["pooled"].T @ dlogit, "bo": np.array([dlogit.sum()], np.float32)}
    dpool = dlogit[:, None] * p["wo"]
    dw = np.einsum("tnh,nh->tn", h, dpool)
    ds = w * (dw - (w * dw).sum(axis=0))
    da = ds[..., None] * p["va"] * (1 - a * a)
    g |= {"va": np.einsum("tn,tna->a", ds, a), "wa": np.einsum("tnh,tna->ha", h, da)}
    dh = w[..., None] * dpool + da @ p["wa"].T
    g["xf"], g["uf"] = _back(dh[..., :HIDDEN], p["uf"], keep["kf"])
    back, g["ub"] = _back(dh[::-1, :, HIDDEN:], p["ub"], keep["kb"])
    g["xb"] = back[::-1]
    return g


class Reader:
    """Words of texts as rows of a table of their inputs, which each word enters once."""

    def __init__(self, p: dict):
        self.p = p
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {b"": 0}
        self.n, self.tables = 1, {d: np.zeros((4096, 3 * HIDDEN), np.float32) for d in "fb"}
        for d in "fb":
            self.tables[d][0] = self.p[f"b{d}"]

    def rows(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if self.n > KEPT_WORDS:
            self.clear()
        if new := list(set().union(*texts).difference(self.place)):
            own, rows, begin = grams(new)
            x = np.concatenate([self.p["words"][own], np.maximum.reduceat(self.p["grams"][rows], begin, axis=0)], axis=1)
            for d in "fb":
                while len(self.tables[d]) < self.n + len(new):
                    self.tables[d] = np.concatenate([self.tables[d], np.zeros_like(self.tables[d])])
                self.tables[d][self.n : self.n + len(new)] = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
            self.place.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.n += len(new)
        get = self.place.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]

    def scores(self, texts: list[list[bytes]], at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """The highest window logit of each text, and where that window begins."""
        every, owner, begin = windows(self.rows(texts))
        out = np.empty(len(every), np.float32)
        for k in range(0, len(every), at_once):
            part = np.ascontiguousarray(every[k : k + at_once].T)
            out[k : k + at_once] = logits(self.p, self.tables["f"][part], self.tables["b"][part], (part > 0).astype(np.float32))
        first = np.searchsorted(owner, np.arange(len(texts)))
        top = np.maximum.reduceat(out, first)
        best = np.array([f + int(np.argmax(out[f:g])) for f, g in zip(first, [*first[1:], len(out)], strict=True)])
        return top, begin[best]


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows (N, WINDOW) padded with 0, the text of each and its first word."""
    counts = [max(1, -(-(len(t) - WINDOW) // STRIDE) + 1) for t in texts]
    padded = np.zeros(sum((c - 1) * STRIDE + WINDOW for c in counts), np.int64)
    starts, at = [], 0
    for t, c in zip(texts, counts, strict=True):
        padded[at : at + len(t)] = t
        starts.append(at + STRIDE * np.arange(c))
        at += (c - 1) * STRIDE + WINDOW
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = np.concatenate([STRIDE * np.arange(c) for c in counts])
    return padded[np.concatenate(starts)[:, None] + np.arange(WINDOW)], owner, begin


def _log_odds(docs: list[list[bytes]], labels: np.ndarray, p: dict) -> dict[str, np.ndarray]:
    """The first entry of each embedding: smoothed log-odds.

    Words and n-grams of under ``SEEN`` documents say nothing: their embeddings are fixed, at 0 and below all others.
    """
    vocabulary = sorted(set().union(*docs))
    own, rows, begin = grams(vocabulary)
    ends = [*begin[1:], len(rows)]
    place = {w: i for i, w in enumerate(vocabulary)}
    seen = {"words": Counter(), "grams": Counter()}, {"words": Counter(), "grams": Counter()}
    for words, y in zip(docs, labels, strict=True):
        at = [place[w] for w in set(words)]
        seen[y]["words"].update({int(own[i]) for i in at})
        seen[y]["grams"].update(set(np.concatenate([rows[begin[i] : ends[i]] for i in at]).tolist()) if at else ())
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    known = {"words": np.zeros(WORD_ROWS, bool), "grams": np.zeros(GRAM_ROWS, bool)}
    for name in ("words", "grams"):
        for row in seen[0][name].keys() | seen[1][name].keys():
            a, b = seen[1][name][row], seen[0][name][row]
            odds = np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1))
            p[name][row, 0] = np.clip(odds, -3, 3)
            known[name][row] = a + b >= SEEN
        p[name][~known[name]] = UNKNOWN[name]
    return known


def fit(sample: list[tuple[str, int]], seed: int = 5) -> dict[str, np.ndarray]:
    """Train on (text, label) pairs."""
    rng = np.random.default_rng(seed)
    p = _fresh(rng)
    pool: dict[bytes, bytes] = {}  # one object a word
    docs, labels = [[pool.setdefault(w, w) for w in pieces(t)] for t, _ in sample], np.array([y for _, y in sample], np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        p["wo"][:] = 0
        p["bo"][:] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return p
    known = _log_odds(docs, labels, p)
    vocabulary = sorted(set().union(*docs))
    own, rows, begin = grams(vocabulary)
    count = np.diff([*begin, len(rows)])
    gram_owner = np.repeat(np.arange(len(vocabulary)), count)
    place = {w: i for i, w in enumerate(vocabulary)}
    ids = [np.fromiter((place[w] + 1 for w in d), np.int64, len(d)) for d in docs]
    every, owner, starts = windows(ids)
    first = np.searchsorted(owner, np.arange(len(docs)))
    evidence = np.concatenate([[0], p["words"][own, 0] + np.maximum.reduceat(p["grams"][rows, 0], begin)])
    value = evidence[every].max(axis=1)
    top = np.array([f + int(np.argmax(value[f:g])) for f, g in zip(first, [*first[1:], len(value)], strict=True)])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch in (2, 4, 6, 8):
            _, chosen = Reader(p).scores(docs)
            top = first + chosen // STRIDE
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            part = every[top[pick]].T
            mask = (part > 0).astype(np.float32)
            used, local = np.unique(part[part > 0] - 1, return_inverse=True)
            sel = np.isin(gram_owner, used)
            g_rows, g_owner = rows[sel], np.searchsorted(used, gram_owner[sel])
            each = p["grams"][g_rows]
            most = np.maximum.reduceat(each, np.searchsorted(g_owner, np.arange(len(used))), axis=0)
            x = np.zeros((*part.shape, 2 * DIM), np.float32)
            x[part > 0] = np.concatenate([p["words"][own[used]], most], axis=1)[local]
            keep: dict = {}
            out = logits(p, x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"], mask, keep)
            g = gradients(p, keep, ((sigmoid(out) - labels[pick]) / len(pick)).astype(np.float32))
            dx = 0
            for d in "fb":
                gx = g.pop(f"x{d}")
                g |= {f"w{d}": np.einsum("tni,tnj->ij", x, gx), f"b{d}": gx.sum(axis=(0, 1))}
                dx = dx + gx @ p[f"w{d}"].T
            of_word = np.zeros((len(used), 2 * DIM), np.float32)
            np.add.at(of_word, local, dx[part > 0])
            g |= {"words": np.zeros_like(p["words"]), "grams": np.zeros_like(p["grams"])}
            np.add.at(g["words"], own[used], of_word[:, :DIM] * known["words"][own[used], None])
            np.add.at(g["grams"], g_rows, of_word[g_owner, DIM:] * ((each == most[g_owner]) & known["grams"][g_rows, None]))
            step += 1
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p[name] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def scored(documents: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = documents.sparkSession.sparkContext.broadcast(p)  # about 9 MB, fixed by the sizes above

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model.value)
        for batch in batches:
            texts = batch["text"].tolist()
            top = [reader.scores([pieces(t) for t in texts[part]])[0] for part in slices(texts, 1_000_000)]
            score = sigmoid(np.concatenate(top).astype(np.float64)) if top else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    rows = documents.select(exact("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id decimal(20,0), held_out boolean, score double, predicted int").withColumn("doc_id", F.col("doc_id").cast("long"))


def classified(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(documents, fit(training_sample(documents, labels, "toxic", MOST, LONGEST)))
