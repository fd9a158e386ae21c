"""Quality rules: robust multivariate outliers [native].

Only DataFrame and SQL functions. Statistics of every text are computed in one
projection; then, per (language, source), a minimum-covariance-determinant
estimate of location and scatter is found by concentration steps, and documents
whose transformed statistics lie too far from it by Mahalanobis distance are
rejected. All the steps are partial aggregations over groups, so a group with a
third of the rows is summed map-side and no group is ever gathered.

Defined results: a null or empty text has no words and fails the base rule; a
null language or source is a group of its own; repeated rows count as rows each;
a group under ``MIN_GROUP`` rows is judged by an estimate over all rows of its
language or, where these are too few, over all rows; a table of fewer rows rejects
nothing by distance; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: Groups with fewer rows are judged by their language, then by all rows.
MIN_GROUP = 50
#: Concentration steps from the median/MAD start go on until no group's location or
#: scatter moves by more than this share of its standard deviations; steps never raise
#: the determinant, so MOST_STEPS only ends steps that turn on ties of the quantile.
SETTLED = 0.01
MOST_STEPS = 25
#: Share of a group's rows in the h-subset.
SUBSET = 0.75
#: Squared distance beyond which a document is an outlier: the 0.999 quantile of
#: chi-square with five degrees of freedom, raised by the factor by which the
#: group's own TAIL quantile exceeds that of chi-square, as text statistics have
#: heavier tails. The estimate bears outliers up to a share of 1 - SUBSET, but with more
#: than 1 - TAIL of them in one group they raise that group's own cut-off.
CUTOFF, TAIL, TAIL_VALUE = 20.515, 0.9, 9.236
#: Least standard deviation of each coordinate, so that a statistic that is
#: constant within a group cannot make its covariance singular: one symbol for
#: every ten words or one repeated line alone, at log 2, is no outlier.
FLOOR = (0.3, 0.08, 0.16, 0.16, 0.16)
DIM = len(FLOOR)

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in five-word windows found twice or more, the first included."""

    def covered(windows: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            n = F.size(s)
            same = lambda a, b: s[a]["h"] == s[b]["h"]
            twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.when(k > 0, same(k, F.greatest(k - 1, F.lit(0)))).otherwise(F.lit(False)) | F.when(k < n - 1, same(k, F.least(k + 1, n - 1))).otherwise(F.lit(False)))
            at = F.array_sort(F.transform(twice, lambda k: s[k]["i"]))
            start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("e"))
            step = lambda a, p: F.struct((a["c"] + p + WINDOW - F.greatest(a["e"], p)).alias("c"), (p + WINDOW).alias("e"))
            return F.aggregate(at, start, step, lambda a: a["c"])

        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, from_sorted))

    def of_hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return let(F.transform(at, lambda i: F.xxhash64(*[w[i + j] for j in range(WINDOW)])), covered)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text; one row for each input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    stats = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "lang", "source", stats.alias("s"), dup.alias("l"), symbols.cast("long").alias("n_symbols"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(F.col("n_symbols") * 10.0 / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.log1p(F.col("n_repeat_words") * 10.0 / n),
    ]


X, M, L = [f"x{i}" for i in range(DIM)], [f"m{i}" for i in range(DIM)], {(i, j): f"l{i}{j}" for i in range(DIM) for j in range(i + 1)}


def _with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Adds d2; solved coordinate by coordinate so that each is computed once."""
    out = rows.join(params, "g", "left")
    for i in range(DIM):
        s = F.col(X[i]) - F.col(M[i])
        for j in range(i):
            s = s - F.col(L[i, j]) * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", s / F.col(L[i, i]))
    d2 = reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIM)])
    return out.select(*rows.columns, d2.alias("d2"))


def _factor(params: DataFrame) -> DataFrame:
    """Cholesky factor, column by column, of the covariances c{i}{j} with the floors on its diagonal."""
    out = params
    for j in range(DIM):
        s = F.greatest(F.col(f"c{j}{j}"), F.lit(FLOOR[j] ** 2))
        for k in range(j):
            s = s - F.col(L[j, k]) * F.col(L[j, k])
        out = out.withColumn(L[j, j], F.sqrt(F.greatest(s, F.lit((FLOOR[j] / 4) ** 2))))
        for i in range(j + 1, DIM):
            s = F.col(f"c{i}{j}")
            for k in range(j):
                s = s - F.col(L[i, k]) * F.col(L[j, k])
            out = out.withColumn(L[i, j], s / F.col(L[j, j]))
    return out.select("g", *M, *L.values())


def _groups(per_group: DataFrame, scratch: Scratch) -> DataFrame:
    """A row per group, written as one file: so Spark knows how small it is and need not deal all rows by group to join it."""
    return scratch.save(per_group.repartition(1))


def _concentrate(d2: DataFrame, consistency: float, scratch: Scratch) -> DataFrame:
    """Location and scatter of the h rows of each group with the smallest distances."""
    cut = _groups(d2.groupBy("g").agg(F.percentile_approx("d2", SUBSET, 1000).alias("cut")), scratch)
    inside = d2.join(cut, "g").where(F.col("d2") <= F.col("cut"))
    cov = [(F.covar_pop(X[i], X[j]) * consistency).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)]
    return _factor(inside.groupBy("g").agg(*[F.avg(X[i]).alias(M[i]) for i in range(DIM)], *cov))


def _moved(old: DataFrame, new: DataFrame) -> float:
    """The largest move of any group's location or scatter, in standard deviations."""
    before = old.select("g", *[F.col(c).alias(f"o_{c}") for c in old.columns if c != "g"])
    deviation = [F.col(f"o_{L[i, i]}") for i in range(DIM)]
    moves = [F.abs(F.col(m) - F.col(f"o_{m}")) / s for m, s in zip(M, deviation)]
    moves += [F.abs(F.col(c) - F.col(f"o_{c}")) / deviation[i] for (i, _), c in L.items()]
    return new.join(before, "g").agg(F.max(F.greatest(*moves))).first()[0] or 0.0


def _consistency() -> float:
    """Factor that makes the scatter of the central share SUBSET that of all rows, for normal coordinates.

    P(chi2_{p+2} <= q) where q is the SUBSET quantile of chi2_p, both by the series of the incomplete gamma function.
    """

    def cdf(q: float, p: int) -> float:
        a, x = p / 2, q / 2
        term = math.exp(-x + a * math.log(x) - math.lgamma(a + 1))
        total = term
        for k in range(1, 400):
            term *= x / (a + k)
            total += term
        return total

    low, high = 1e-6, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, DIM) < SUBSET else (low, mid)
    return SUBSET / cdf(low, DIM + 2)


def quality(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Per row: the statistics, base_failed, squared robust distance d2 (null without an estimate) and kept."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    flat = statistics(docs).select("doc_id", "text_hash", "lang", "source", "s.*", "l.*", "n_symbols")
    stats = scratch.save(flat)
    rows = stats.withColumn("base_failed", base_failed())
    # A row per (language, source), which are few; levels: 0 its own rows, 1 those of its language, 2 all rows, null too few.
    sizes = _groups(rows.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("size")), scratch)
    by_lang, over_all = Window.partitionBy("lang"), Window.partitionBy()
    enough = lambda n: n >= MIN_GROUP
    level = F.when(enough(F.col("size")), 0).when(enough(F.sum("size").over(by_lang)), 1).when(enough(F.sum("size").over(over_all)), 2)
    levels = sizes.withColumn("level", level)
    named = F.array(*[F.concat(F.lit(f"{k}"), F.to_json(F.struct(*c))) if c else F.lit(f"{k}") for k, c in enumerate((("lang", "source"), ("lang",), ()))])
    used = lambda k, w: F.max(F.when(F.col("level") == k, F.lit(1)).otherwise(F.lit(0))).over(w) == 1
    fits = F.array_compact(F.array(F.when(F.col("level") == 0, named[0]), F.when(used(1, by_lang), named[1]), F.when(used(2, over_all), named[2])))
    groups = _groups(levels.select("lang", "source", F.when(F.col("level").isNotNull(), named[F.col("level")]).alias("g"), fits.alias("fits")), scratch)
    on = [rows[c].eqNullSafe(groups[c]) for c in ("lang", "source")]
    placed = rows.join(groups, on, "left").select("doc_id", *[rows[c] for c in rows.columns if c != "doc_id"], "g", "fits", *[c.alias(X[i]) for i, c in enumerate(_features())])
    placed = scratch.save(placed)
    # Rows that estimates are made of: a row may count for its own group, its language and all rows.
    fit = placed.where(~F.col("base_failed")).select(F.explode("fits").alias("g"), *X)
    placed = placed.drop("fits")
    start = _groups(fit.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 1000).alias(m) for x, m in zip(X, M)]), scratch)
    around = fit.join(start, "g").groupBy("g").agg(*[F.first(m).alias(m) for m in M], *[F.percentile_approx(F.abs(F.col(x) - F.col(m)), 0.5, 1000).alias(f"s{i}") for i, (x, m) in enumerate(zip(X, M))])
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i in range(DIM) for j in range(i)]
    params = _groups(_factor(around.select("g", *M, *[(F.col(f"s{i}") * F.col(f"s{i}") * 2.2).alias(f"c{i}{i}") for i in range(DIM)], *zero)), scratch)
    factor = _consistency()
    for _ in range(MOST_STEPS):
        last, params = params, _groups(_concentrate(_with_distance(fit, params), factor, scratch), scratch)
        if _moved(last, params) <= SETTLED:
            break
    out = _with_distance(placed, params)
    tail = F.percentile_approx("d2", TAIL, 1000) / F.lit(TAIL_VALUE)
    cuts = _groups(_with_distance(fit, params).groupBy("g").agg((F.greatest(tail, F.lit(1.0)) * CUTOFF).alias("cut")), scratch)
    out = out.join(cuts, "g", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("d2") > F.col("cut"), F.lit(False)))


def keep(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, all their columns."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    id_, text_ = fresh(docs, "__id", "__text")
    passed = quality(docs, scratch).where("kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(text_)).distinct()
    return docs.join(passed, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(text_)), "left_semi")
