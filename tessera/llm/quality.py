"""Quality rules: base rules, then robust multivariate outliers per language and source.  DataFrame functions only.

Every text gives a statistic vector.  For each (lang, source), each language and the whole, the minimum covariance
determinant is sought by concentration steps: moments of the half of the documents that lie nearest under the last
estimate.  Several deterministic starts run side by side until no determinant falls any more, the least one is taken,
and one reweighted step follows.  A document whose Mahalanobis distance exceeds the cutoff is rejected.

A group is estimated whatever its size: its moments are drawn toward those of its language, as if ``PRIOR`` documents
of the language were part of it, and a language's likewise toward the whole.  A step is one aggregation: sums by group,
start and bin of the distance, so that the nearest half is found by a running count over bins, the last bin counting
in part, and no group is ever sorted or gathered.

Edge cases.  A null text has no words and fails the base rules; null lang or source form groups of their own; a group
of one document is judged by its language's estimate in all but name; repeated rows count each time and get equal
verdicts; an empty table gives an empty result.  Internal columns start with ``_q``; other columns are carried along
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, WORD_GAP, scratch, written

#: Statistics of the vector, each with the least standard deviation that an estimate may have.
FLOORS = {"length": 0.8, "word_length": 0.12, "symbols": 0.35, "dup_lines": 0.35, "repeats": 0.7}
P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Documents' worth of the wider estimate in each; starts; steps at most, and the change of a log-determinant that ends them.
PRIOR, STARTS, STEPS, SETTLED = 20, 3, 30, 0.01
#: Consistency factors of the nearest half and of the 97.5 % reweighting, that quantile, and the 99.999 % cutoff: chi-square with 5 degrees of freedom.
SUBSET_FACTOR, WEIGHT_FACTOR, WEIGHT_CUT, CUTOFF = 1.912, 1.055, 12.833, 30.856
#: Variance of the hyperbolic tangent of a normal value.
TANH = 0.394
#: Bins of the distance, in each power of two.
BINS = 16
#: Estimates up to which they are broadcast, 22 numbers each.
FEW = 30_000
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: A group: 0 and nothing, 1 and a language, 2 and a language with a source.
KEY = ["_q_level", "_q_l", "_q_s"]
MEANS, COVARIANCES = [f"_q_m{i}" for i in range(P)], [f"_q_c{i}{j}" for i, j in PAIRS]
#: What a distance needs: means and the inverse of the covariances' Cholesky factor.
ESTIMATE = [*MEANS, *[f"_q_w{i}{j}" for i, j in PAIRS]]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, wherever the optimizer puts the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in ``words``."""
    n = F.size(words)

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeated(pairs: Column) -> Column:
        same = lambda s, k: F.coalesce(s["h"] == F.get(pairs, k)["h"], F.lit(False))
        found = F.filter(pairs, lambda s, k: same(s, k - 1) | same(s, k + 1))
        return F.sort_array(F.transform(found, lambda s: s["i"]))

    def by_hash(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(_let(pairs, repeated), covered)).otherwise(0)

    windows = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n > 3, _let(F.slice(windows, F.lit(1), F.greatest(n - 2, F.lit(0))), by_hash)).otherwise(0)


def statistics() -> Column:
    """The base statistics of the whole ``text`` and the base verdict, as one struct of ``NAMES``."""

    def described(text: Column, words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
        n, repeats = F.size(words).cast("long"), _repeat_words(words).cast("long")
        each = (
            n,
            F.length(F.array_join(words, "")).cast("long"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            repeats,
        )
        counts = F.struct(*[c.alias(k) for c, k in zip(each, NAMES, strict=False)])
        return _let(counts, lambda s: F.struct(*[s[k].alias(k) for k in NAMES[:-1]], ((s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])).alias(NAMES[-1])))

    def split(text: Column) -> Column:
        words = _let(F.btrim(text, F.lit(SPACE_CHARS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP)))
        return _let(words, lambda w: described(text, w))

    return _let(F.coalesce(F.col("text"), F.lit("")), split)


def vector(s: Column) -> list[Column]:
    """The transformed statistics, in the order of ``FLOORS``."""
    n, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    return [F.log(n), F.log(chars / n), F.log1p(100 * s["n_symbols"] / chars), F.log1p(s["n_dup_lines"]), F.log1p(100 * s["n_repeat_words"] / n)]


def _key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def distance(x: list[Column]) -> Column:
    """The squared Mahalanobis distance of a vector under the estimate beside it."""
    z = [sum((F.col(f"_q_w{i}{j}") * (x[j] - F.col(f"_q_m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((F.pow(v, 2) for v in z), F.lit(0.0))


def _columns() -> list[Column]:
    return [F.col(f"_q_x{i}") for i in range(P)]


def _covariances(products: list[Column], scale: list[Column]) -> dict[str, Column]:
    return {f"_q_c{i}{j}": products[k] * scale[i] * scale[j] for k, (i, j) in enumerate(PAIRS)}


def members(passing: DataFrame) -> DataFrame:
    """The vectors, once for each group that they belong to."""
    keys = [F.struct(F.lit(level).alias("level"), (F.col("_q_lang") if level else F.lit("")).alias("l"), (F.col("_q_source") if level > 1 else F.lit("")).alias("s")) for level in range(3)]
    out = passing.select(F.explode(F.array(*keys)).alias("key"), *_columns())
    return out.select(*[F.col(f"key.{k[3:]}").alias(k) for k in KEY], *_columns())


def starts(rows: DataFrame, few: bool) -> DataFrame:
    """Where concentration starts: medians with quartile ranges, with spatial signs, and with tanh-bent values."""
    quartiles = rows.groupBy(*KEY).agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, x in enumerate(_columns())])
    at = lambda i, k: F.get(f"q{i}", F.lit(k))
    wide = {f"_q_d{i}": F.greatest((at(i, 2) - at(i, 0)) / 1.349, F.lit(floor)) for i, floor in enumerate(FLOORS.values())}
    center = written(quartiles.select(*KEY, *[at(i, 1).alias(f"_q_m{i}") for i in range(P)], *[c.alias(k) for k, c in wide.items()]), "estimates")
    z = [f"_q_z{i}" for i in range(P)]
    away = rows.join(F.broadcast(center) if few else center, KEY).withColumns({z[i]: (F.col(f"_q_x{i}") - F.col(f"_q_m{i}")) / F.col(f"_q_d{i}") for i in range(P)})
    norm2 = sum((F.col(c) * F.col(c) for c in z), F.lit(0.0))
    away = away.select(*KEY, F.greatest(norm2, F.lit(1e-12)).alias("norm2"), *z, *[F.tanh(c).alias(f"t{i}") for i, c in enumerate(z)])
    signs = [F.avg(F.col(z[i]) * F.col(z[j]) / F.col("norm2")).alias(f"s{i}{j}") for i, j in PAIRS]
    bent = [F.avg(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"t{i}{j}") for i, j in PAIRS]
    both = away.groupBy(*KEY).agg(F.count("*").alias("_q_n"), *signs, *bent, *[F.avg(f"t{i}").alias(f"t{i}") for i in range(P)])
    both = written(both.join(center, KEY), "estimates")
    scale, zero = [F.col(f"_q_d{i}") for i in range(P)], F.lit(0.0)
    own = [(MEANS, [F.lit(float(i == j)) for i, j in PAIRS])]
    own += [(MEANS, [P * F.col(f"s{i}{j}") for i, j in PAIRS])]
    own += [([F.col(f"_q_m{i}") + scale[i] * F.col(f"t{i}") for i in range(P)], [(F.col(f"t{i}{j}") - F.col(f"t{i}") * F.col(f"t{j}")) / TANH for i, j in PAIRS])]
    each = [F.struct(F.lit(k).alias("_q_start"), *[(F.col(m) if isinstance(m, str) else m).alias(n) for m, n in zip(mean, MEANS, strict=True)], *[c.alias(n) for n, c in _covariances(cov, scale).items()]) for k, (mean, cov) in enumerate(own)]
    return both.select(*KEY, F.col("_q_n").cast("double").alias("_q_n"), zero.alias("_q_before"), F.explode(F.array(*each)).alias("e")).select(*KEY, "_q_n", "_q_before", "e.*")


def estimates(raw: DataFrame) -> DataFrame:
    """Moments drawn toward the wider group's, with variances of their floors at least, ready for distances."""
    kept, moments = [*KEY, "_q_start", "_q_n", "_q_before"], [*MEANS, *COVARIANCES]

    def drawn(level: int, wider: DataFrame, on: list[str]) -> DataFrame:
        beside = wider.select(*on, *[F.col(c).alias(f"wide{c}") for c in moments])
        own = F.col("_q_n") / (F.col("_q_n") + PRIOR)
        return raw.where(F.col("_q_level") == level).join(beside, on).select(*kept, *[(own * F.col(c) + (1 - own) * F.col(f"wide{c}")).alias(c) for c in moments])

    whole = raw.where("_q_level = 0").select(*kept, *moments)
    langs = drawn(1, F.broadcast(whole), ["_q_start"])  # a row a start
    out = whole.unionByName(langs).unionByName(drawn(2, langs, ["_q_l", "_q_start"]))
    least = [v * v for v in FLOORS.values()]
    out = out.withColumns({f"_q_c{i}{i}": F.greatest(f"_q_c{i}{i}", F.lit(v)) for i, v in enumerate(least)})
    l, w = (lambda i, j: F.col(f"_q_l{i}{j}")), (lambda i, j: F.col(f"_q_w{i}{j}"))  # noqa: E731, E741
    for j in range(P):
        rest = lambda i, j=j: F.col(f"_q_c{i}{j}") - sum((l(i, k) * l(j, k) for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"_q_l{j}{j}", F.sqrt(F.greatest(rest(j), F.lit(0.01 * least[j]))))
        out = out.withColumns({f"_q_l{i}{j}": rest(i) / l(j, j) for i in range(j + 1, P)}) if j + 1 < P else out
    for i in range(P):
        out = out.withColumns({f"_q_w{i}{j}": (F.lit(float(i == j)) - sum((l(i, k) * w(k, j) for k in range(j, i)), F.lit(0.0))) / l(i, i) for j in range(i + 1)})
    return out.withColumn("_q_det", 2 * sum((F.log(l(i, i)) for i in range(P)), F.lit(0.0))).select(*kept[:-1], *ESTIMATE, "_q_before", "_q_det")


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * BINS).cast("int")


def concentrated(rows: DataFrame, by: DataFrame, few: bool, cut: float | None = None) -> DataFrame:
    """Moments of the half of each group that lies nearest under its estimate, or of all within ``cut`` where those are more."""
    key = [*KEY, "_q_start"]
    sums = {"n": F.count("*")} | {f"s{i}": F.sum(x) for i, x in enumerate(_columns())} | {f"s{i}{j}": F.sum(F.col(f"_q_x{i}") * F.col(f"_q_x{j}")) for i, j in PAIRS}
    near = rows.join(F.broadcast(by) if few else by, KEY).groupBy(*key, _bin(distance(_columns())).alias("bin")).agg(F.first("_q_det").alias("_q_before"), *[c.alias(k) for k, c in sums.items()])
    group = Window.partitionBy(*key)
    near = near.withColumn("before", F.sum("n").over(group.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(group))
    part = F.least(F.greatest((F.least(F.col("all"), (F.col("all") + P + 1) / 2) - F.col("before")) / F.col("n"), F.lit(0.0)), F.lit(1.0))
    if cut is not None:
        part = F.when(F.col("bin") < _bin(F.lit(cut)), 1.0).otherwise(part)
    total = near.withColumn("part", part).groupBy(*key).agg(F.max("_q_before").alias("_q_before"), F.max("all").alias("all"), *[F.sum(F.col("part") * F.col(k)).alias(k) for k in sums])
    total = total.withColumns({m: F.col(f"s{i}") / F.col("n") for i, m in enumerate(MEANS)})
    factor = F.lit(WEIGHT_FACTOR) if cut is not None else 1 + (SUBSET_FACTOR - 1) * 2 * (1 - F.col("n") / F.col("all"))
    cov = [factor * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"_q_m{i}") * F.col(f"_q_m{j}")) for i, j in PAIRS]
    return total.select(*key, F.col("n").cast("double").alias("_q_n"), "_q_before", *MEANS, *[c.alias(k) for k, c in zip(COVARIANCES, cov, strict=True)])


def estimated(table: DataFrame) -> DataFrame:
    """A row for each (lang, source) of a described table, with the estimate that holds for it."""
    passing = table.where(~F.col("_q_base_failed")).select("_q_lang", "_q_source", *_columns())
    few = STARTS * passing.select("_q_lang", "_q_source").distinct().count() + 2 * STARTS <= FEW // 2  # languages are no more than sources
    rows = members(passing)
    raw = written(starts(rows, few), "moments")
    for step in range(STEPS):
        by = written(estimates(raw), "estimates")
        if step and (by.agg(F.max(F.abs(F.col("_q_det") - F.col("_q_before")))).collect()[0][0] or 0) < SETTLED:
            break
        raw = written(concentrated(rows, by, few), "moments")
    else:
        by = written(estimates(raw), "estimates")
    best = by.groupBy(*KEY).agg(F.min_by(F.struct("_q_start", *ESTIMATE, "_q_det"), F.struct("_q_det", "_q_start")).alias("e"))
    best = best.select(*KEY, F.lit(0).alias("_q_start"), *[F.col(f"e.{c}").alias(c) for c in [*ESTIMATE, "_q_det"]])
    last = estimates(written(concentrated(rows, written(best, "best"), few, WEIGHT_CUT), "moments"))
    return written(last.where("_q_level = 2").select(F.col("_q_l").alias("_q_lang"), F.col("_q_s").alias("_q_source"), *ESTIMATE), "by_group")


def described(df: DataFrame, carried: list[str]) -> DataFrame:
    """The ``carried`` columns of ``df`` with group keys, statistics and vector; ``df`` needs text, lang and source."""
    out = df.select(*carried, _key("lang").alias("_q_lang"), _key("source").alias("_q_source"), statistics().alias("_q"))
    return out.select(*carried, "_q_lang", "_q_source", *[F.col(f"_q.{c}").alias(f"_q_{c}") for c in NAMES], *[x.alias(f"_q_x{i}") for i, x in enumerate(vector(F.col("_q")))])


def beside(df: DataFrame, by_group: DataFrame) -> DataFrame:
    """``df`` with its group's estimate, null where the group has none."""
    return df.join(F.broadcast(by_group) if by_group.count() <= FEW else by_group, ["_q_lang", "_q_source"], "left")


def verdicts(documents: DataFrame) -> DataFrame:
    """One row a document: statistics, base verdict and verdict."""
    table = written(described(documents, ["doc_id"]), "statistics")
    with scratch(documents.sparkSession):
        by_group = estimated(table)
    d2 = F.when(~F.col("_q_base_failed"), distance(_columns()))
    out = beside(table, by_group).select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in NAMES], d2.alias("distance2"))
    return out.select("doc_id", *NAMES, F.coalesce(F.col("distance2") <= CUTOFF, F.lit(False)).alias("kept"), "distance2")


def kept_documents(documents: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only.

    Texts are read and described twice, once for the estimates and once for the verdicts, rather than written beside them.
    The verdict is one expression, in which each text is described once.
    """
    with scratch(documents.sparkSession):
        by_group = estimated(written(described(documents, []), "statistics"))
    near = lambda s: _let(F.array(*vector(s)), lambda x: distance([F.get(x, F.lit(i)) for i in range(P)]) <= CUTOFF)
    kept = _let(statistics(), lambda s: ~s["base_failed"] & near(s))
    out = documents.withColumns({"_q_lang": _key("lang"), "_q_source": _key("source")})
    return beside(out, by_group).where(kept).select(*documents.columns)
