"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct 5-word shingles.  Equal sets form one class, which one document stands for.
``BANDS`` bands of ``ROWS`` minima deal the classes into buckets; candidates are pairs within a bucket.  A pair's
signatures are compared batch by batch, and the pair is pruned once the posterior probability of a similarity of
``SIMILAR`` or more falls below ``MISS``; survivors are verified on their full sets.

No bucket is expanded into all its pairs.  In the first turns a bucket's members meet its hub, the class that shares
most buckets with others: near copies are linked through what they were copied from.  Links join classes into
components, and only members of one bucket that are still in different components meet afterwards, block by block:
the pivots of a block, none of them in their bucket's largest component, meet all such members and leave the bucket.
Their signatures are compared inside the tasks that hold a bucket, and only pairs that are not pruned become rows.
Blocks double.  A pair that never met is in one component already, so that no component depends on it.

Edge cases.  Null and empty texts, and texts without words, have empty sets and are linked with nothing, not even each
other; a null id counts as larger than any other, and a component of null ids only has a null id; rows that repeat an
id are documents of their own; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import exact, salted_left_join, scratch, slices, written

SHINGLE, SIMILAR = 5, 0.75
#: 1 - (1 - 0.75 ** 7) ** 80: a pair at the threshold shares no bucket with probability 1e-5.
BANDS, ROWS = 80, 7
#: Minima kept for verification, a byte each; compared so many at a time; least posterior probability of a link.
KEPT, STEP, MISS = 512, 32, 1e-6
#: Turns of a hub a bucket, at most; pairs for each row of a bucket with which the blocks of pivots begin; members of a piece.
HUBS, PAIRS, PIECE = 3, 50, 1000
#: Links of a partition where they are joined into components.
LINKS = 100_000
SETS = "doc_id decimal(20,0), text_key long, class binary, n_shingles long, bands array<long>, signature binary"
EDGES = "a binary, b binary"
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sets of shingle hashes of many texts at a time; A-Z are lowered, words end at ASCII white space only."""

    def __init__(self) -> None:
        self.lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        parts = [t.encode().translate(self.lower) for t in texts]
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        if len(data) >= len(self.power):
            size = max(len(data) + 1, 1 << 20)
            with np.errstate(over="ignore"):
                self.power, self.inverse = (np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        change = np.flatnonzero(np.diff((~self.space[data]).astype(np.int8), prepend=0, append=0))
        starts, ends = change[::2], change[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)])
            words = _mix((sums[ends] - sums[starts]) * self.inverse[starts])
            edges = np.searchsorted(starts, np.cumsum([0, *[len(p) + 1 for p in parts]]))
            whole = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
            for k in range(SHINGLE):
                whole = whole * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(whole)]
            whole, out = _mix(whole + np.uint64(SHINGLE)), []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if high - low >= SHINGLE:
                    out.append(np.unique(whole[low : high - SHINGLE + 1]))
                else:
                    short = np.uint64(high - low)
                    for w in words[low:high]:
                        short = short * np.uint64(0xA0761D6478BD642F) + w
                    out.append(_mix(np.array([short], np.uint64)) if high > low else np.zeros(0, np.uint64))
        return out


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)


def minima(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minima of a set under all hash functions."""
    a, b = factors
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):
        out = np.minimum(out, (x[k : k + 256, None] * a + b).min(axis=0))
    return out


def banded(minimum: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for row in minimum.reshape(BANDS, ROWS).T:
            h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + row)
    return h.view(np.int64)


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(exact("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def signed(documents: DataFrame) -> DataFrame:
    """Class, set size, buckets and signature of every document; null where the set is empty."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, factors, seen = Shingles(), _factors(), {}
        for batch in batches:
            texts, rows = batch["text"].tolist(), []
            for part in slices(texts, 1_000_000):
                for s in reader.sets(texts[part]):
                    if not len(s):
                        rows.append((None, 0, None, None))
                        continue
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if key not in seen:
                        if len(seen) > 2000:
                            seen.clear()
                        m = minima(s, factors)
                        seen[key] = banded(m), (m[:KEPT] >> np.uint32(7)).astype(np.uint8).tobytes()
                    rows.append((key, len(s), *seen[key]))
            out = pd.DataFrame(rows, columns=["class", "n_shingles", "bands", "signature"])
            yield pd.concat([batch[["doc_id", "text_key"]].reset_index(drop=True), out], axis=1)

    return _keyed(documents).mapInPandas(make, SETS)


def least_matches() -> list[int]:
    """Matches below which a pair is pruned after each batch: the posterior, from a uniform prior, is under MISS."""
    p = SIMILAR + (1 - SIMILAR) / 256  # equal bytes of unequal minima
    out = []
    for n in range(STEP, KEPT + 1, STEP):
        below, m = 0.0, -1
        while below < MISS:  # P(similarity >= p | m of n) = P(Binomial(n + 1, p) <= m)
            m += 1
            below += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append(m)
    return out


def unpruned(signatures: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Places of the pairs (i, j) of rows that no batch of their signatures prunes."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, bound in enumerate(least):
        cut = signatures[:, k * STEP : (k + 1) * STEP]
        matches[alive] += (cut[i[alive]] == cut[j[alive]]).sum(axis=1)
        alive = alive[matches[alive] >= bound]
    return alive


def survivors(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that no batch of their signatures prunes."""
    least = least_matches()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 20_000):
                part = batch.iloc[k : k + 20_000]
                both = np.frombuffer(b"".join([*part["sa"], *part["sb"]]), np.uint8).reshape(-1, KEPT)
                at = np.arange(len(part))
                yield part.iloc[unpruned(both, at, at + len(part), least)][["a", "b"]]

    side = lambda x: classes.select(F.col("class").alias(x), F.col("signature").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInPandas(compare, EDGES)


def full_sets(wanted: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """(class, shingles) of the ``wanted`` classes, built again from one document of each."""

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Shingles()
        for batch in batches:
            texts = batch["text"].tolist()
            for part in slices(texts, 1_000_000):
                sets = [s.tobytes() for s in reader.sets(texts[part])]
                yield pd.DataFrame({"class": [hashlib.blake2b(s, digest_size=16).digest() for s in sets], "shingles": sets})

    places = wanted.join(classes.select("class", "stands"), "class").select(F.col("stands.text_key").alias("text_key"), F.col("stands.doc_id").alias("_id")).distinct()
    texts = _keyed(documents).alias("d").join(places.alias("p"), (F.col("d.text_key") == F.col("p.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("p._id")))
    return texts.select("text").mapInPandas(rebuild, "class binary, shingles binary").dropDuplicates(["class"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["xa"], batch["xb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)) else 0
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield batch[["a", "b"]][np.array(keep, bool)]

    side = lambda x: sets.select(F.col("class").alias(x), F.col("shingles").alias(f"x{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb").mapInPandas(check, EDGES)


def components(edges: DataFrame, parts: int) -> DataFrame:
    """(class, root) of every class on an edge: the smallest class of its component, by large-star and small-star steps."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        lows = both.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(8))).repartition(parts, "a", "_salt").groupBy("a", "_salt").agg(F.min("b").alias("b"))
        least = lows.repartition(parts, "a").groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        kept = salted_left_join(both, least, ["a"], F.col("b"), 8, parts)
        if large:
            return kept.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).repartition(parts, "a").distinct()
        down = kept.where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        return down.unionByName(least.select("a", F.col("least").alias("b"))).where("a != b").repartition(parts, "a").distinct()

    down = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).repartition(parts, "a").distinct(), "edges")
    before = None
    while True:
        down = written(star(written(star(down, True), "stars"), False), "stars")
        state = down.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if state == before:
            break
        before = state
    roots = down.select(F.col("a").alias("class"), F.col("b").alias("root"))
    return roots.unionByName(down.select(F.col("b").alias("class"), F.col("b").alias("root")).distinct())


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(class, root) of all linked classes, after further links."""
    few = links.count()
    parts, most = (max(8, n // LINKS) for n in (few, few + roots.count()))
    of = lambda x: roots.select(F.col("class").alias(x), F.col("root").alias(f"r{x}")).repartition(most, x)
    ends = links.repartition(most, "a").join(of("a"), "a", "left").repartition(most, "b").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = written(components(ends, parts).select(F.col("class").alias("root"), F.col("root").alias("onto")), "joined")
    fresh = joined.repartition(most, "root").join(roots.select(F.col("class").alias("root")).repartition(most, "root"), "root", "left_anti")
    every = roots.unionByName(fresh.select(F.col("root").alias("class"), "root"))
    return written(salted_left_join(every, joined, ["root"], F.col("class"), 8, most).select("class", F.coalesce("onto", "root").alias("root")), "roots")


def named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets with the roots that their classes have now."""
    found = rows.drop("root").join(roots, "class", "left")
    return found.select("bucket", "class", "central", F.coalesce("root", "class").alias("root"))


def apart(rows: DataFrame) -> DataFrame:
    """The rows of the buckets whose members are in several components, with the bucket's most central class and its root."""
    hub = F.max(F.struct("central", F.col("class").alias("hub"), F.col("root").alias("onto"))).alias("h")
    several = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), hub).where("low != high")
    return rows.join(several.select("bucket", "h.hub", "h.onto"), "bucket")


def meet_hubs(rows: DataFrame, signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unpruned pairs of each bucket's hub with its members of other components, and the rows without it."""
    pairs = rows.where("root != onto").select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    return survivors(pairs, signatures), rows.where("class != hub").drop("hub", "onto")


def survivors_within(rows: DataFrame) -> DataFrame:
    """Unpruned pairs of a pivot and a member of another component in one (bucket, piece), whose signatures meet in the task.

    A pivot stands in all pieces of its bucket, at home in one, other members in one.  A pair is given in the first bucket
    that it shares, and in no other: ``before`` has a class's buckets before this one.
    """
    least = least_matches()

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        group = (part["bucket"].ne(part["bucket"].shift()) | part["piece"].ne(part["piece"].shift())).cumsum().to_numpy()
        signatures = np.frombuffer(b"".join(part["signature"]), np.uint8).reshape(-1, KEPT)
        root, own = (pd.factorize(part[c], sort=True)[0] for c in ("root", "class"))
        pivot, home, before = part["pivot"].to_numpy(bool), part["home"].to_numpy(bool), [set(x) for x in part["before"]]
        names, found = part["class"].to_numpy(), []

        def compared(i: np.ndarray, j: np.ndarray) -> None:
            for k in unpruned(signatures, i, j, least):
                if before[i[k]].isdisjoint(before[j[k]]):
                    x, y = names[i[k]], names[j[k]]
                    found.append((min(x, y), max(x, y)))

        held, size = [], 0
        for k in range(1, len(part)):
            i = np.flatnonzero(group[:-k] == group[k:])
            if not len(i):
                break
            j = i + k
            meet = lambda x, y: pivot[x] & home[y] & (~pivot[y] | (own[x] < own[y]))
            keep = (root[i] != root[j]) & (meet(i, j) | meet(j, i))
            held.append((i[keep], j[keep]))
            size += int(keep.sum())
            if size > 50_000:
                compared(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            compared(*map(np.concatenate, zip(*held, strict=True)))
        return pd.DataFrame(found, columns=["a", "b"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held.iloc[-1]
            open_ = int(((held["bucket"] == last["bucket"]) & (held["piece"] == last["piece"])).sum())  # of a group that may go on
            if len(held) - open_ >= 2048:
                yield pairs(held.iloc[: len(held) - open_].reset_index(drop=True))
                held = held.iloc[len(held) - open_ :].reset_index(drop=True)
        if held is not None and len(held):
            yield pairs(held)

    return rows.repartition("bucket", "piece").sortWithinPartitions("bucket", "piece").mapInPandas(compare, EDGES)


def meet_all(rows: DataFrame, signatures: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Unpruned pairs of each bucket's pivots with its members of other components, and the rows that are no pivots.

    All members outside a bucket's largest component are pivots where this makes ``most`` pairs at most, else a share of
    them.  Large buckets are cut into pieces, so that no bucket's members all meet in one task.
    """
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket")
    largest = sizes.agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    largest = written(largest.select("bucket", F.col("top.root").alias("top"), "all", (F.col("all") * (F.col("all") - F.col("top.n"))).alias("pairs")), "largest")
    share = min(1.0, most / max(1, largest.agg(F.sum("pairs")).collect()[0][0] or 0))
    chosen = (F.col("root") != F.col("top")) & (F.pmod(F.xxhash64("class", F.lit("pivot")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    marked = written(rows.join(largest.drop("pairs"), "bucket").select("bucket", "class", "central", "root", chosen.alias("pivot"), F.ceil(F.col("all") / PIECE).cast("int").alias("pieces")), "marked")
    own = marked.groupBy("class").agg(F.sort_array(F.collect_list("bucket")).alias("own"))  # BANDS at most
    at = F.pmod(F.xxhash64("class"), F.col("pieces")).cast("int")
    wide = marked.withColumn("at", at).withColumn("piece", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array("at"))))
    wide = wide.join(own, "class").join(signatures, "class")
    wide = wide.select("bucket", "piece", "class", "root", "pivot", (F.col("at") == F.col("piece")).alias("home"), F.filter("own", lambda x: x < F.col("bucket")).alias("before"), "signature")
    return survivors_within(wide), marked.where("NOT pivot").select("bucket", "class", "central", "root")


def linked_classes(signed_docs: DataFrame, documents: DataFrame) -> DataFrame:
    """(class, root, first) of all classes: the component's smallest class, and its smallest document."""
    spark = documents.sparkSession
    stands = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("stands")
    classes = written(signed_docs.where("n_shingles > 0").groupBy("class").agg(stands, F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")
    members = classes.select(F.explode("bands").alias("bucket"), "class")
    buckets = members.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).where("low != high")
    shared = written(members.join(buckets.select("bucket", "n"), "bucket"), "shared")
    central = written(shared.groupBy("class").agg(F.sum("n").alias("central")), "central")
    sets = written(full_sets(central.select("class"), classes, documents), "sets")
    signatures = written(classes.join(central, "class", "left_semi").select("class", "signature"), "signatures")
    roots = written(central.limit(0).select("class", F.col("class").alias("root")), "roots")
    rows = written(apart(shared.join(central, "class").select("bucket", "class", "central", F.col("class").alias("root"))), "apart")
    turn, most = 0, 0
    while rows.head(1):
        with scratch(spark, keep=2):
            if turn >= HUBS:
                most = 2 * most or max(1, int(PAIRS * rows.count()))
            pairs, rest = meet_hubs(rows, signatures) if turn < HUBS else meet_all(rows, signatures, most)
            links = written(verified(written(pairs, "pairs"), sets), "links")
            if links.head(1):
                roots = merged(roots, links)
                rest = named(rest, roots)
            else:
                turn = HUBS  # blocks of pivots find what is left sooner
            rows = written(apart(rest), "apart")
        turn += 1
    of_root = roots.join(classes.select("class", "stands"), "class").groupBy("root").agg(F.min("stands").alias("first"))
    placed = salted_left_join(roots, of_root, ["root"], F.col("class"), 8)
    return classes.select("class", "stands").join(placed, "class", "left").select("class", F.coalesce("root", "class").alias("root"), F.coalesce("first", "stands").alias("first"))


def decided(documents: DataFrame) -> DataFrame:
    """One row a document: set size, component, and the component's smallest document."""
    docs = written(signed(documents), "signed")
    with scratch(documents.sparkSession):
        links = written(linked_classes(docs, documents), "components")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    return docs.select("doc_id", "text_key", "n_shingles", "class").join(links, "class", "left").withColumn("first", F.coalesce("first", own))


def near_duplicates(documents: DataFrame) -> DataFrame:
    out = decided(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "n_shingles", F.col("first.doc_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without near-duplicates of an earlier one, with their own columns; equal rows count as one."""
    with scratch(documents.sparkSession):
        rows = decided(documents)
        own = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.text_key") == F.col("text_key"))
        keep = written(rows.where(own).select(F.col("doc_id").alias("_n_id"), F.col("text_key").alias("_n_key"), (F.col("n_shingles") > 0).alias("_n_some")).distinct(), "kept")
    keyed = documents.withColumn("_n_key0", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = keyed.join(keep, (F.col("_n_key0") == F.col("_n_key")) & exact("doc_id").eqNullSafe(F.col("_n_id")))
    some = out.where("_n_some").dropDuplicates(["_n_key0", "doc_id"])
    return some.unionByName(out.where("NOT _n_some")).select(*documents.columns)


def _words() -> str:
    return "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


#: The same relation for DuckDB: every pair that shares a shingle, then the closure.
NEAR_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_words()} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id != b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN least ON doc_id = a
"""
