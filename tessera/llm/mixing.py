"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating; they share ``SHARE`` of all words,
none above ``MOST`` times its own, the excess reshared by weight.  The mix is counted in blocks of
``BLOCK_WORDS`` words; the blocks go to the sources, and a source's blocks to its shards, by the highest
quotients weight / (2k + 1).  A shard lays its documents in seeded order on a ring and takes its quota as
whole rounds and a run of blocks from a seeded block on, so whole documents are taken but for the two ends.

Edge cases.  Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own;
repeated rows are documents of their own that get equal shares up to the run's ends; a source without
words has target 0; an empty table gives an empty result.  Internal columns start with ``_m``; other columns are
carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, WORD_GAP, written

#: Weights in turn, share of all words that is mixed, most times that a source is taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Words of a block (fewer where the smallest target has under 32 such blocks), words and documents of a shard at most.
BLOCK_WORDS, SHARD_WORDS = 64, 250_000
SEED = "mix-1"


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def _sized(df: DataFrame) -> DataFrame:
    """``df`` with source key, size and seeded place of each document; the place follows from id and text."""
    seeded = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))  # "=" sorts below "~": null last
    return df.withColumns({"_m_source": key, "_m_size": F.size(words(F.col("text"))).cast("long"), "_m_place": seeded})


def targets(sizes: DataFrame) -> DataFrame:
    """A row a source: words, documents, and the words to take.  ``sizes``: _m_source, source_size, n_docs."""
    every, filled = Window.partitionBy(), Window.orderBy("ratio", "_m_source")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy("_m_source")) - 1) % len(WEIGHTS)).cast("int"))
    out = sizes.withColumn("weight", weight).withColumn("most", MOST * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    out = out.withColumn("wanted", SHARE * F.sum("source_size").over(every))
    before = F.sum("most").over(filled) - F.col("most")
    behind = F.sum("weight").over(every) - F.sum("weight").over(filled) + F.col("weight")
    out = out.withColumn("level", (F.col("wanted") - before) / behind).withColumn("rank", F.row_number().over(filled))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(every)["level"]
    target = F.least(F.col("most").cast("double"), F.coalesce(level, F.col("level")) * F.col("weight"))
    return out.withColumn("target", target).select("_m_source", "source_size", "n_docs", "wanted", "target")


def apportioned(shares: DataFrame, group: str, member: str, weight: str, seats: str) -> DataFrame:
    """Sainte-Laguë: ``seats`` of each group go to its members by the highest quotients, ties by ``member``.

    The divisor lies between the total over seats + half the members and over seats - half the members, so only
    a few seats a member are open; the others are held for sure.  Adds the column ``quota``.
    """
    whole = Window.partitionBy(group)
    half, total = F.count("*").over(whole) / 2 + 1, F.sum(weight).over(whole)
    held = F.greatest(F.lit(0), F.floor(F.col(weight) * (F.col(seats) - half) / total) - 1)
    least = shares.where(F.col(weight) > 0).withColumns({"_m_held": held.cast("long"), "_m_up": (F.ceil(F.col(weight) * (F.col(seats) + half) / total) + 1).cast("long")})
    least = least.withColumn("_m_open", F.col(seats) - F.sum("_m_held").over(whole))
    tried = least.withColumn("_m_k", F.explode(F.sequence(F.col("_m_held"), F.col("_m_up"))))
    order = Window.partitionBy(group).orderBy((F.col(weight) / (2 * F.col("_m_k") + 1)).desc(), member)
    won = tried.withColumn("_m_won", (F.row_number().over(order) <= F.col("_m_open")).cast("long"))
    keep = [c for c in shares.columns]
    return won.groupBy(*keep).agg((F.max("_m_held") + F.sum("_m_won")).alias("quota"))


def plan(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources and the shards of a mix: one row each.  ``sized`` needs only the ``_m`` columns."""
    sizes = sized.groupBy("_m_source").agg(F.sum("_m_size").alias("source_size"), F.count("*").alias("n_docs"))
    every = Window.partitionBy()
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(smallest / 32))).cast("long")
    sources = targets(sizes).withColumn("block", F.coalesce(block, F.lit(1)))
    sources = sources.withColumn("seats", F.round(F.col("wanted") / F.col("block")).cast("long")).withColumn("mix", F.lit(0))
    quotas = apportioned(sources, "mix", "_m_source", "target", "seats").select("_m_source", "quota")
    sources = sources.join(quotas, "_m_source", "left").na.fill(0, ["quota"])
    n_shards = F.ceil((F.col("source_size") + F.col("n_docs")) / SHARD_WORDS).cast("long")
    sources = written(sources.select("_m_source", "source_size", "target", "block", F.col("quota").alias("source_quota"), n_shards.alias("n_shards")), "sources")
    cells = placed(sized, sources).groupBy("_m_source", "_m_shard", "block", "source_quota").agg(F.sum("_m_size").alias("shard_size"))
    shards = apportioned(cells, "_m_source", "_m_shard", "shard_size", "source_quota")
    taken = F.least(F.col("quota") * F.col("block"), MOST * F.col("shard_size"))
    shards = shards.withColumn("rounds", F.floor(taken / F.col("shard_size")).cast("long")).withColumn("run", taken - F.col("rounds") * F.col("shard_size"))
    lot = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), "_m_source", F.col("_m_shard").cast("string"))), 1, 8), 16, 10).cast("long")
    start = F.pmod(lot, F.ceil(F.col("shard_size") / F.col("block"))).cast("long") * F.col("block")
    return sources, written(shards.select("_m_source", "_m_shard", "shard_size", "rounds", "run", start.alias("start")), "shards")


def placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their source's row and their shard."""
    lot = F.conv(F.substring("_m_place", 1, 8), 16, 10).cast("long")
    return sized.join(sources, "_m_source").withColumn("_m_shard", F.floor(lot * F.col("n_shards") / F.lit(4294967296)).cast("long"))


def mixed(sized: DataFrame, sources: DataFrame, shards: DataFrame) -> DataFrame:
    """Documents with ``_m_rounds`` whole copies and the word ranges [from, to) of the run that fall into them."""
    ring = Window.partitionBy("_m_source", "_m_shard").orderBy("_m_place", "_m_size")
    narrow = sources.select("_m_source", "source_size", "target", "n_shards").toDF("_m_source", "_m_source_size", "_m_target", "n_shards")
    out = placed(sized, narrow).drop("n_shards").withColumn("_m_before", F.sum("_m_size").over(ring.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m_size"))
    of_shard = shards.toDF("_m_source", "_m_shard", "_m_shard_size", "_m_rounds", "_m_run", "_m_start")
    out = out.join(of_shard, ["_m_source", "_m_shard"], "left").na.fill(0, ["_m_rounds", "_m_run", "_m_start", "_m_shard_size"])
    end = F.col("_m_start") + F.col("_m_run")

    def cut(low: Column, high: Column) -> Column:
        start = F.least(F.greatest(low - F.col("_m_before"), F.lit(0)), F.col("_m_size"))
        return F.struct(start.alias("start"), F.least(F.greatest(high - F.col("_m_before"), start), F.col("_m_size")).alias("end"))

    ranges = F.array(cut(F.col("_m_start"), F.least(end, F.col("_m_shard_size"))), cut(F.lit(0), end - F.col("_m_shard_size")))
    return out.withColumn("_m_ranges", F.filter(ranges, lambda r: r["end"] > r["start"]))


def taken() -> Column:
    return F.col("_m_rounds") * F.col("_m_size") + F.aggregate("_m_ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def shares(documents: DataFrame) -> DataFrame:
    """One row a document: size, its source's size and target, words taken."""
    sized = written(_sized(documents).select("doc_id", "_m_source", "_m_size", "_m_place"), "sizes")
    out = mixed(sized, *plan(sized))
    return out.select("doc_id", F.col("_m_size").alias("size"), F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"), taken().alias("taken"))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix as documents: a row for each round, and one for each cut of the run, whose words a space joins."""
    sized = _sized(documents)
    narrow = written(sized.select("_m_source", "_m_size", "_m_place"), "sizes")
    out = mixed(sized, *plan(narrow))
    whole = lambda r: (r["start"] == 0) & (r["end"] == F.col("_m_size"))
    part = F.transform("_m_ranges", lambda r: F.when(whole(r), F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")), " ")))
    texts = F.concat(F.array_repeat("text", F.when(F.col("_m_size") > 0, F.col("_m_rounds").cast("int")).otherwise(0)), part)
    out = out.where(F.size("_m_ranges") + F.col("_m_rounds") > 0).withColumn("_m_text", F.explode(texts))
    again = {"text": F.col("_m_text")} | ({"n_chars": F.length("_m_text").cast("long")} if "n_chars" in documents.columns else {})
    return out.select(*[again[c].alias(c) if c in again else c for c in documents.columns])


#: The same mix for DuckDB.
SHARES_SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '~') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS place FROM documents),
sizes AS (SELECT k, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY k),
weighted AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY k) - 1) % 3] AS weight, {MOST} * source_size AS most,
             {SHARE}::DOUBLE * sum(source_size) OVER () AS wanted FROM sizes),
filled AS (SELECT *, most / weight AS ratio FROM weighted),
levelled AS (SELECT *, row_number() OVER o AS rank,
             (wanted - (sum(most) OVER o - most)::BIGINT) / (sum(weight) OVER () - sum(weight) OVER o + weight)::BIGINT AS level
             FROM filled WINDOW o AS (ORDER BY ratio, k ROWS UNBOUNDED PRECEDING)),
targets AS (SELECT *, least(most::DOUBLE, (SELECT arg_min(level, rank) FROM levelled WHERE level <= ratio) * weight) AS target FROM levelled),
blocks AS (SELECT *, greatest(1, least({BLOCK_WORDS}, floor((SELECT min(target) FROM targets WHERE target > 0) / 32)))::BIGINT AS block FROM targets),
seated AS (SELECT *, round(wanted / block)::BIGINT AS seats, (SELECT count(*) FROM blocks WHERE target > 0) / 2 + 1 AS half, (SELECT sum(target) FROM blocks) AS total FROM blocks WHERE target > 0),
tried AS (SELECT k, target, seats, unnest(range(0, ceil(target * (seats + half) / total)::BIGINT + 2)) AS seat FROM seated),
quotas AS (SELECT k, sum(CASE WHEN r <= seats THEN 1 ELSE 0 END)::BIGINT AS source_quota
           FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, k) AS r FROM tried) GROUP BY k),
sources AS (SELECT b.k, source_size, target, block, coalesce(source_quota, 0) AS source_quota, ceil((source_size + n_docs) / {SHARD_WORDS})::BIGINT AS n_shards
            FROM blocks b LEFT JOIN quotas q ON b.k = q.k),
placed AS (SELECT d.*, s.* EXCLUDE (k), floor(('0x' || substr(place, 1, 8))::BIGINT * n_shards / 4294967296)::BIGINT AS shard FROM sized d JOIN sources s ON d.k = s.k),
cells AS (SELECT k, shard, block, source_quota, sum(size)::BIGINT AS shard_size FROM placed GROUP BY ALL HAVING sum(size) > 0),
offered AS (SELECT *, unnest(range(0, ceil(shard_size * (source_quota + n / 2 + 1) / whole)::BIGINT + 2)) AS seat
            FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n, sum(shard_size) OVER (PARTITION BY k) AS whole FROM cells)),
won AS (SELECT k, shard, block, shard_size, sum(CASE WHEN r <= source_quota THEN 1 ELSE 0 END)::BIGINT AS quota
        FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY shard_size / (2 * seat + 1) DESC, shard) AS r FROM offered) GROUP BY ALL),
runs AS (SELECT *, least(quota * block, {MOST} * shard_size) AS words FROM won),
shards AS (SELECT k, shard, shard_size, words // shard_size AS rounds, words % shard_size AS run,
           (('0x' || substr(md5('{SEED}|' || k || '|' || shard), 1, 8))::BIGINT % ceil(shard_size / block)::BIGINT) * block AS start FROM runs),
ring AS (SELECT *, (sum(size) OVER (PARTITION BY k, shard ORDER BY place, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before FROM placed)
SELECT doc_id, size, source_size, target,
       (CASE WHEN s.shard IS NULL THEN 0 ELSE rounds * size
        + greatest(0, least(before + size, start + run, shard_size) - greatest(before, start))
        + greatest(0, least(before + size, start + run - shard_size) - before) END)::BIGINT AS taken
FROM ring r LEFT JOIN shards s ON r.k = s.k AND r.shard = s.shard
"""
