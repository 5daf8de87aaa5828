"""Quality classifier: a byte-level convolutional network, trained in numpy.

Learned filters of ``WIDTH`` bytes run over overlapping chunks of ``CHUNK`` bytes, ``STEP`` apart, that cover the
whole text; each filter is max-pooled within a chunk.  The chunks' pooled values are combined, as their maximum, mean
and spread, by one hidden layer into one probability, so that text which repeats itself shows as well as odd bytes.

Edge cases.  A null or empty text is one chunk of padding; without labels of both classes every score is the share of
label 1 (0.5 without any); repeated rows get equal scores; an empty table gives an empty result.  Only the text
enters a score; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import exact, held_out, slices, training_sample

CHUNK, STEP, WIDTH, DIM, FILTERS, HIDDEN = 128, 96, 8, 4, 16, 16
#: Labelled documents of either class in the fit at most, their longest text, passes over them, and steps at least.
MOST, LONGEST, EPOCHS, LEAST_STEPS, BATCH, RATE = 2000, 60_000, 14, 500, 64, 0.01
THRESHOLD = 0.7


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping chunks (N, CHUNK), padded with byte 0, and where each text's begin."""
    counts = [max(1, -(-(len(t) - CHUNK) // STEP) + 1) for t in texts]
    data = np.frombuffer(b"".join(t + bytes((c - 1) * STEP + CHUNK - len(t)) for t, c in zip(texts, counts, strict=True)), np.uint8)
    sizes = np.array([(c - 1) * STEP + CHUNK for c in counts])
    base = np.repeat(np.cumsum(sizes) - sizes, counts)
    first = np.cumsum(counts) - counts
    begin = base + STEP * (np.arange(len(base)) - np.repeat(first, counts))
    return data[begin[:, None] + np.arange(CHUNK)], first


def _fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    n = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return {
        "bytes": n(256, DIM, s=0.7), "filters": n(WIDTH * DIM, FILTERS, s=0.3), "bias": np.zeros(FILTERS, np.float32),
        "w1": n(3 * FILTERS, HIDDEN, s=0.2), "b1": np.zeros(HIDDEN, np.float32), "w2": n(HIDDEN, s=0.3), "b2": np.zeros(1, np.float32),
    }


def convolved(p: dict, part: np.ndarray) -> np.ndarray:
    """Filter values (N, positions, FILTERS) of chunks (N, CHUNK)."""
    x = p["bytes"][part].reshape(len(part), CHUNK * DIM)
    seen = np.lib.stride_tricks.sliding_window_view(x, WIDTH * DIM, axis=1)[:, ::DIM]
    return seen.reshape(-1, WIDTH * DIM) @ p["filters"]


def pooled(p: dict, every: np.ndarray, at_once: int = 256) -> np.ndarray:
    n = CHUNK - WIDTH + 1
    out = [convolved(p, every[k : k + at_once]).reshape(-1, n, FILTERS).max(axis=1) for k in range(0, len(every), at_once)]
    return np.maximum(np.concatenate(out) + p["bias"], 0)


def combined(p: dict, v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of texts from their chunks' pooled values; texts' chunks begin at ``first``."""
    count = np.diff([*first, len(v)])
    owner = np.repeat(np.arange(len(first)), count)
    most = np.maximum.reduceat(v, first, axis=0)
    mean = np.add.reduceat(v, first, axis=0) / count[:, None]
    away = v - mean[owner]
    spread = np.sqrt(np.add.reduceat(away * away, first, axis=0) / count[:, None] + 1e-4)
    f = np.concatenate([most, mean, spread], axis=1)
    h = np.tanh(f @ p["w1"] + p["b1"])
    return h @ p["w2"] + p["b2"], (count, owner, most, away, spread, f, h)


def _step(p: dict, part: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    n = CHUNK - WIDTH + 1
    values = convolved(p, part).reshape(-1, n, FILTERS)
    where = values.argmax(axis=1)
    top = np.take_along_axis(values, where[:, None], axis=1)[:, 0] + p["bias"]
    v = np.maximum(top, 0)
    out, (count, owner, most, away, spread, f, h) = combined(p, v, first)
    d = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / len(y)).astype(np.float32)
    dh = d[:, None] * p["w2"] * (1 - h * h)
    df = dh @ p["w1"].T
    g = {"w2": h.T @ d, "b2": np.array([d.sum()]), "w1": f.T @ dh, "b1": dh.sum(axis=0)}
    share = (v == most[owner]).astype(np.float32)
    share /= np.add.reduceat(share, first, axis=0)[owner]
    dv = share * df[owner, :FILTERS] + (df[:, FILTERS : 2 * FILTERS] / count[:, None])[owner] + away * (df[:, 2 * FILTERS :] / spread / count[:, None])[owner]
    dv = np.where(top > 0, dv, 0).astype(np.float32)
    seen = part[np.arange(len(part))[:, None, None], where[..., None] + np.arange(WIDTH)]  # (N, FILTERS, WIDTH) bytes
    x = p["bytes"][seen].reshape(len(part), FILTERS, WIDTH * DIM)
    g |= {"bias": dv.sum(axis=0), "filters": np.einsum("nf,nfi->if", dv, x), "bytes": np.zeros_like(p["bytes"])}
    dx = (dv[..., None] * p["filters"].T).reshape(-1, DIM)
    np.add.at(g["bytes"], seen.reshape(-1), dx)
    return g


def fit(sample: list[tuple[str, int]], seed: int = 3) -> dict[str, np.ndarray]:
    """Train on (text, label) pairs."""
    rng = np.random.default_rng(seed)
    p = _fresh(rng)
    labels = np.array([y for _, y in sample], np.float32)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        p["w2"][:] = 0
        p["b2"][:] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return p
    every, first = chunks([t.encode() for t, _ in sample])
    ends = np.array([*first[1:], len(every)])
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items()}
    step, epochs = 0, max(EPOCHS, -(-LEAST_STEPS // -(-len(sample) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(sample))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            count = ends[pick] - first[pick]
            rows = np.concatenate([np.arange(first[i], ends[i]) for i in pick])
            g = _step(p, every[rows], np.cumsum(count) - count, labels[pick])
            step += 1
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def probabilities(p: dict, texts: list[str]) -> np.ndarray:
    every, first = chunks([t.encode() for t in texts])
    out = combined(p, pooled(p, every), first)[0].astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def scored(documents: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            each = [probabilities(p, texts[part]) for part in slices(texts, 400_000)]
            score = np.concatenate(each) if each else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    rows = documents.select(exact("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id decimal(20,0), held_out boolean, score double, predicted int").withColumn("doc_id", F.col("doc_id").cast("long"))


def classified(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(documents, fit(training_sample(documents, labels, "quality", MOST, LONGEST)))
