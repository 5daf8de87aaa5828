"""Benchmark decontamination by spaced seeds: hashes of masked token windows, then verified overlaps.

Words are lower-cased and cut at ASCII punctuation and white space.  Each mask hashes some positions of a
window and ignores the others, so that a changed word breaks only the masks that look at it.  However the changed words
of an overlap that counts are placed, one mask of the item's length lies between them, so none is missed.  The
benchmark's hashes are set in a bit filter of fixed size, which tasks use to pass over text that cannot match;
what remains is joined by hash with all benchmark windows.  A hit counts once an aligned window of ``WINDOW`` words
near it (the whole item where that is shorter) has at least ``NEEDED`` of ``WINDOW`` words equal.

Edge cases.  Null and empty texts and items match nothing; items of fewer than ``LEAST`` words are not searched for;
shorter items have masks of fewer words; repeated items give a row each, rows with equal doc_id
and text one; an empty table on either side gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import exact, slices, written

#: The seeds, fixed values: of weight 6 for items of 12 words and more, 5 for 9 to 11 words, 4 for 5 to 8 words.  In some
#: place in a window each set avoids any 3 changed words of 13 and 2 of 12, any 2 of 9, 10 or 11, and any 1 of 5 to 8.
LONG = ("1101111", "111010011", "11100001011", "1101000111", "11100111")
MIDDLE = ("111011", "1001111", "11010011", "10110101")
SHORT = ("1111", "10111", "11101", "11011")
MASKS = LONG + MIDDLE + SHORT
#: ``SPAN`` words and more are sought by masks: with those of short items, all that are searched for.
SPAN, WINDOW, NEEDED, LEAST = 5, 13, 10, 5
#: The filter has 2 ** BITS bits (4 MB), whatever the benchmark's size; a fuller one only lets more through.
BITS = 25
SEGMENT = "doc_id long, text_key string, seg_start int, words array<long>, hit_pos array<int>, hit_hash array<long>"
ITEM = "item_id long, item_key long, words array<long>, hit_pos array<int>, hit_hash array<long>"
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Word hashes of many texts at a time."""

    def __init__(self) -> None:
        self.kind = np.zeros(256, bool)
        self.kind[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            size = max(n, 1 << 20)
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.full(size, _BASE, np.uint64))
                self.inverse = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in a row, and the edges of each text's words."""
        parts = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self._grow(len(data) + 1)
        inside = self.kind[data]
        change = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        starts, ends = change[::2], change[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * self.power[: len(data)], dtype=np.uint64)])
            out = _mix((sums[ends] - sums[starts]) * self.inverse[starts])
        begin = np.cumsum([0, *[len(p) + 1 for p in parts]])
        return out, np.searchsorted(starts, begin)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked window at each start; a window must fit."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, len(mask) * 1_000_003 + int(mask, 2), np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return _mix(total)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks that find every overlap with an item of ``n`` words."""
    return LONG if n >= 12 else MIDDLE if n >= 9 else SHORT if n >= LEAST else ()


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def seeds(benchmark: DataFrame) -> DataFrame:
    """Every item with its word hashes and the positions and hashes of all its masked windows."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Words()
        for batch in batches:
            rows = []
            for item_id, text in zip(batch["item_id"], batch["text"], strict=True):
                words, _ = reader.hashes([text])
                found = [seed_hashes(words, m) for m in masks_of(len(words))]
                if not found:
                    continue
                pos = np.concatenate([np.arange(len(f)) for f in found])
                key = int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)
                rows.append((None if pd.isna(item_id) else int(item_id), key, words.astype(np.int64), pos.astype(np.int32), np.concatenate(found).astype(np.int64)))
            yield pd.DataFrame(rows, columns=["item_id", "item_key", "words", "hit_pos", "hit_hash"]).astype({"item_id": "Int64", "item_key": "int64"})

    rows = benchmark.select(exact("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(make, ITEM)


def bit_filter(items: DataFrame) -> np.ndarray:
    """The benchmark's hashes as ``2 ** BITS`` bits: Spark sets the bits, at most 2 ** BITS / 64 longs come back."""
    hashes = items.select(F.explode("hit_hash").alias("h"))
    low = (1 << BITS) - 1
    bits = hashes.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - BITS), F.col("h").bitwiseAND(low))).alias("bit"))
    longs = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("set")).toPandas()
    out = np.zeros((1 << BITS) // 64, np.int64)
    out[longs["at"].to_numpy(np.int64)] = longs["set"].to_numpy(np.int64)
    return out


def segments(documents: DataFrame, bits: np.ndarray, masks: list[str]) -> DataFrame:
    """The stretches of documents around windows that pass the filter, with their word hashes."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def passes(h: np.ndarray) -> np.ndarray:
        first, second = _bits(h)
        test = lambda at: (shared.value[at >> 6] >> (at & 63)) & 1
        maybe = np.flatnonzero(test(first))
        return maybe[test(second[maybe]).astype(bool)]

    def cut(words: np.ndarray) -> Iterator[tuple]:
        found = [(h, passes(h)) for h in (seed_hashes(words, m) for m in masks)]
        pos = np.concatenate([p for _, p in found]) if found else ()
        if not len(pos):
            return
        order = np.argsort(pos, kind="stable")
        pos, h = pos[order], np.concatenate([x[p] for x, p in found])[order]
        for run in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos) > 2 * WINDOW) + 1):
            low, high = max(0, pos[run[0]] - WINDOW), min(len(words), pos[run[-1]] + 2 * WINDOW)
            yield int(low), words[low:high].astype(np.int64), pos[run].astype(np.int32), h[run].astype(np.int64)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Words()
        for batch in batches:
            rows, texts = [], batch["text"].tolist()
            for part in slices(texts, 1_000_000):
                words, edges = reader.hashes(texts[part])
                for i in range(len(edges) - 1):
                    at = part.start + i
                    rows += [(None if pd.isna(batch["doc_id"].iloc[at]) else int(batch["doc_id"].iloc[at]), batch["text_key"].iloc[at], *x) for x in cut(words[edges[i] : edges[i + 1]])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SEGMENT.split(", ")]).astype({"doc_id": "Int64", "seg_start": "int32"})

    rows = documents.select(exact("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("text_key", F.md5("text")).mapInPandas(make, SEGMENT)


def overlap(words: np.ndarray, seg_start: int, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Start of the best aligned window in the document, its length, and its equal words."""
    low = max(seg_start, diagonal)
    high = min(seg_start + len(words), diagonal + len(item))
    equal = words[low - seg_start : high - seg_start] == item[low - diagonal : high - diagonal]
    n = min(WINDOW, len(item))
    if len(equal) < n:
        return low, n, 0
    sums = np.concatenate([[0], np.cumsum(equal)])
    each = sums[n:] - sums[:-n]
    best = int(each.argmax())
    return low + best, n, int(each[best])


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id) of each verified overlap, with place and equal words of its best window."""
    items = written(seeds(benchmark), "seeds")
    lengths = [r.n for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).distinct().collect()]  # WINDOW values at most
    found = written(segments(documents, bit_filter(items), sorted({m for n in lengths for m in masks_of(n)})), "segments")
    once = found.dropDuplicates(["text_key", "seg_start"])
    hits = once.select("text_key", "seg_start", F.explode(F.arrays_zip("hit_pos", "hit_hash")).alias("hit")).select("text_key", "seg_start", F.col("hit.hit_pos").alias("pos"), F.col("hit.hit_hash").alias("hash"))
    # Equal items are verified once; a mask's hits on one item and diagonal count once.
    of_items = items.select("item_key", F.explode(F.arrays_zip("hit_pos", "hit_hash")).alias("hit")).select("item_key", F.col("hit.hit_pos").alias("item_pos"), F.col("hit.hit_hash").alias("hash")).distinct()
    salt = F.pmod(F.xxhash64("text_key"), F.lit(8))
    joined = hits.withColumn("salt", salt).join(of_items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7)))), ["hash", "salt"])
    pairs = joined.select("text_key", "seg_start", "item_key", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    item_words = items.select("item_key", F.col("words").alias("item_words")).dropDuplicates(["item_key"])
    checked = pairs.join(once.select("text_key", "seg_start", "words"), ["text_key", "seg_start"]).join(item_words, "item_key")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                start, n, equal = overlap(np.asarray(row.words), row.seg_start, np.asarray(row.item_words), row.diagonal)
                if equal * WINDOW >= n * NEEDED:
                    rows.append((row.text_key, row.item_key, start, n, equal))
            yield pd.DataFrame(rows, columns=["text_key", "item_key", "start", "n_window", "n_equal"])

    real = checked.mapInPandas(verify, "text_key string, item_key long, start int, n_window int, n_equal int")
    best = real.groupBy("text_key", "item_key").agg(F.max(F.struct("n_equal", (-F.col("start")).alias("before"), "n_window")).alias("best"))
    named = best.join(items.select("item_key", "item_id"), "item_key")
    docs = found.select("doc_id", "text_key").distinct()
    return docs.join(named, "text_key").select("doc_id", "text_key", "item_id", (-F.col("best.before")).alias("word_start"), F.col("best.n_window").alias("n_window"), F.col("best.n_equal").alias("n_equal"))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document and item it holds."""
    return contaminated(documents, benchmark).drop("text_key").withColumn("contaminated", F.lit(True))


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a verified overlap, with their own columns."""
    bad = written(contaminated(documents, benchmark).select(F.col("text_key").alias("_d_key")).distinct(), "contaminated")
    return documents.join(bad, F.md5(F.coalesce("text", F.lit(""))) == F.col("_d_key"), "left_anti")
