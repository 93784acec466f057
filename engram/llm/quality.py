r"""Quality rules: text statistics, and robust multivariate outliers by minimum-covariance-determinant estimates.

DataFrame functions only. A document's statistics are computed in its own row, without a shuffle. The estimates are
made for each language and source, each language and all documents: from three deterministic starts, concentration
steps go on until no determinant changes, and the start with the least determinant wins. Quantiles and the moments of
the nearest documents come from sums in fine bins, so a group of any size is summed before it is shuffled, and what
meets in one task is bounded by the bins. A group's estimate is shrunk towards its language's, and that one towards all
documents', the more the fewer documents it has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialize

#: Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD, BLANK, SYMBOL = r"[^ \t-\r]+", r"[ \t-\r]", r"[#*$%&|<>]"
WINDOW_WORDS = 8
#: Statistics of the vector with the least standard deviation that each is given, so that a group in which nearly all
#: documents agree does not reject a document for a trifle. In a group without symbols, a text of one symbol to five
#: words is far; public filters commonly set the bound at one to ten.
FEATURES = (("log_words", 0.5), ("log_word_chars", 0.08), ("symbol_share", 0.05), ("dup_line_share", 0.1), ("repeat_share", 0.12))
GROUP = ("lang", "source")
#: Share of a group that the estimates are made from, starts, most concentration steps, change of the logarithm of a
#: determinant that counts as none, and the number of documents at which a group's own estimate weighs half.
SUBSET, STARTS, STEPS, STILL, HALF_WEIGHT = 0.75, 3, 12, 1e-9, 50
#: Bins of a quantile: so many to each factor of e, and what is added so that 0 has a bin.
BINS, FLOOR = 92, 1e-6


def gamma_p(a: float, x: float) -> float:
    """Regularized lower incomplete gamma function, by its series."""
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_quantile(p: float, df: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(df / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


#: Squared distance beyond which a document is rejected: the chance of a larger one is 1e-12 if a group is normal, as
#: statistics of clean text have longer tails than that.
CUT = chi_square_quantile(1 - 1e-12, len(FEATURES))


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (longs) of the whole text.

    Repeated windows are found by 64-bit hashes within one text. A null text has no words and lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    df = docs.withColumns({"_hashes": F.transform(words, lambda w: F.xxhash64(w)), "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_hashes").cast("long"),
            "_windows": F.when(
                F.size("_hashes") >= WINDOW_WORDS,
                F.transform(F.sequence(F.lit(1), F.greatest(F.size("_hashes") - (WINDOW_WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_hashes", i, F.lit(WINDOW_WORDS)))),
            ),
        }
    )
    df = df.withColumns(
        {
            "word_chars": (F.char_length(text) - F.regexp_count(text, F.lit(BLANK))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_sorted": F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))),
        }
    )

    def repeated(x: Column, k: Column) -> Column:
        before, after = F.get(F.col("_sorted"), k - 1), F.get(F.col("_sorted"), k + 1)
        return F.coalesce(before["w"] == x["w"], F.lit(False)) | F.coalesce(after["w"] == x["w"], F.lit(False))

    df = df.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", repeated), lambda x: x["i"])))
    begin = F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate("_starts", begin, lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(WINDOW_WORDS), i - a["last"])).alias("total")), lambda a: a["total"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_hashes", "_lines", "_windows", "_sorted", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_vector(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics x0, x1, ... as doubles; finite for every text."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = (
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return stats.withColumns({f"x{i}": v for i, v in enumerate(values)})


def _group(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(f"_{name}")


KEYS = [f"_{g}" for g in GROUP]
#: Keys of the estimates: _level is 0 for a group, 1 for a language (_source empty), 2 for all documents (both empty).
LEVEL_KEYS = ["_level", *KEYS]


def bin_of(value: str) -> Column:
    """Bin of a value that is not negative."""
    return F.floor(F.log(F.col(value) + FLOOR) * BINS)


def first_bin(bins: Column, rows: Column, share: float) -> Column:
    """Of sorted (bin, count) of so many rows the first bin at which the share is reached."""
    # what the steps compare with goes along in the state, as a lambda's free expression is computed at each element
    begin = F.struct(F.lit(0).cast("long").alias("t"), F.lit(None).cast("long").alias("b"), F.ceil(rows * share).alias("need"))
    step = lambda a, x: F.struct((a["t"] + x["n"]).alias("t"), F.when(a["t"] < a["need"], x["b"]).otherwise(a["b"]).alias("b"), a["need"].alias("need"))
    return F.aggregate(bins, begin, step, lambda a: a["b"])


def sums_of_nearest(bins: Column, rows: Column, share: float, size: int) -> Column:
    """Of sorted (bin, count, array of so many sums) of so many rows, the sums of the first bins that reach the share."""
    begin = F.struct(F.lit(0).cast("long").alias("t"), F.ceil(rows * share).alias("need"), F.array(*[F.lit(0.0)] * size).alias("v"))
    added = lambda a, x: F.struct((a["t"] + x["n"]).alias("t"), a["need"].alias("need"), F.zip_with(a["v"], x["v"], lambda p, q: p + q).alias("v"))
    return F.aggregate(bins, begin, lambda a, x: F.when(a["t"] < a["need"], added(a, x)).otherwise(a), lambda a: a["v"])


def quantile_by_bins(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """keys and q: the upper edge of the first bin at which the share of a group's rows is reached; value is not negative."""
    counts = df.groupBy(*keys, bin_of(value).alias("b")).agg(F.count("*").alias("n"))
    sorted_bins = F.sort_array(F.collect_list(F.struct("b", "n")))  # bounded by the number of bins
    held = counts.groupBy(*keys).agg(sorted_bins.alias("bins"), F.sum("n").alias("rows"))
    return held.select(*keys, (F.exp((first_bin(F.col("bins"), F.col("rows"), share) + 1) / BINS) - FLOOR).alias("q"))


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def factored(moments: DataFrame, p: int) -> DataFrame:
    """Adds the Cholesky factor l_i_j of covariances c_i_j (i >= j), and logdet, the logarithm of their determinant."""
    made = []
    for j in range(p):
        rest = [" - ".join([f"c_{i}_{j}", *[f"l_{i}_{k} * l_{j}_{k}" for k in range(j)]]) for i in range(j, p)]
        made.append(f"sqrt(greatest({rest[0]}, 1e-12D)) AS l_{j}_{j}")
        made += [f"({r}) / l_{j}_{j} AS l_{i}_{j}" for i, r in enumerate(rest[1:], j + 1)]
    return moments.selectExpr("*", *made, f"2 * ({' + '.join(f'ln(l_{i}_{i})' for i in range(p))}) AS logdet")


def with_distance(df: DataFrame, p: int, name: str) -> DataFrame:
    """Adds the gaps g_i of x0, x1, ... from m0, m1, ..., and the squared Mahalanobis distance under the factor l_i_j."""
    gaps = [f"x{i} - m{i} AS g{i}" for i in range(p)]
    solved = [f"({' - '.join([f'g{i}', *[f'l_{i}_{k} * _z{k}' for k in range(i)]])}) / l_{i}_{i} AS _z{i}" for i in range(p)]
    return df.selectExpr("*", *gaps, *solved, f"{' + '.join(f'_z{i} * _z{i}' for i in range(p))} AS {name}").drop(*[f"_z{i}" for i in range(p)])


def leveled(vectors: DataFrame) -> DataFrame:
    """Each vector three times, under the LEVEL_KEYS of its group, of its language and of all documents."""
    lang, source = (_group(g) for g in GROUP)
    none = F.lit("")
    keys = F.array(*[F.struct(F.lit(i).alias("_level"), a.alias("_lang"), b.alias("_source")) for i, (a, b) in enumerate(((lang, source), (lang, none), (none, none)))])
    return vectors.withColumn("_k", F.explode(keys)).select("_k.*", *[f"x{i}" for i in range(len(FEATURES))])


def starts(df: DataFrame) -> DataFrame:
    """A centre and a covariance of each group and start: medians, and median absolute deviations with no correlation,
    with that of the directions from the centre, and with that of the deviations' hyperbolic tangents."""
    p, floors = len(FEATURES), [f for _, f in FEATURES]
    long = df.select(*LEVEL_KEYS, F.posexplode(F.array(*[f"x{i}" for i in range(p)])).alias("_j", "_x"))
    medians = materialize(quantile_by_bins(long, [*LEVEL_KEYS, "_j"], "_x", 0.5), "medians")
    spread = long.join(medians, [*LEVEL_KEYS, "_j"]).withColumn("_gap", F.abs(F.col("_x") - F.col("q")))
    mads = quantile_by_bins(spread, [*LEVEL_KEYS, "_j"], "_gap", 0.5).withColumnRenamed("q", "mad")
    of = lambda j, c: F.max(F.when(F.col("_j") == j, c))
    centre = medians.join(mads, [*LEVEL_KEYS, "_j"]).groupBy(*LEVEL_KEYS).agg(
        *[of(i, F.col("q")).alias(f"m{i}") for i in range(p)],
        *[of(i, F.greatest(F.col("mad") * 1.4826, F.lit(floors[i]))).alias(f"s{i}") for i in range(p)],
    )
    centre = materialize(centre, "centres")
    scaled = [f"(x{i} - m{i}) / s{i} AS z{i}" for i in range(p)]
    z = df.join(centre, LEVEL_KEYS).selectExpr(*LEVEL_KEYS, *scaled, f"greatest(sqrt({' + '.join(f'z{i} * z{i}' for i in range(p))}), {FLOOR!r}D) AS len")
    sums = z.groupBy(*LEVEL_KEYS).agg(
        *[F.expr(f"avg(z{i} / len * z{j} / len) AS r1_{i}_{j}") for i, j in _pairs(p)],
        *[F.expr(f"avg(tanh(z{i}) * tanh(z{j})) AS r2_{i}_{j}") for i, j in _pairs(p)],
    )

    def correlation(k: int, i: int, j: int) -> str:
        if i == j or not k:
            return f"{float(i == j)}D"
        both = f"r{k}_{i}_{i} * r{k}_{j}_{j}"
        return f"CASE WHEN {both} > 0 THEN 0.9D * r{k}_{i}_{j} / sqrt({both}) ELSE 0D END"

    each = ", ".join(f"named_struct('_start', {k}, {', '.join(f"'c_{i}_{j}', {correlation(k, i, j)} * s{i} * s{j}" for i, j in _pairs(p))})" for k in range(STARTS))
    return centre.join(sums, LEVEL_KEYS).selectExpr(*LEVEL_KEYS, *[f"m{i}" for i in range(p)], f"explode(array({each})) AS _s").select(*LEVEL_KEYS, "_s._start", *[f"m{i}" for i in range(p)], *[f"_s.c_{i}_{j}" for i, j in _pairs(p)])


class Step:
    """A concentration step: takes the SUBSET of each group with the least distances and makes centre and covariance anew
    from it, made consistent for a normal group and with the least deviations added.

    One pass over the vectors gives a step of all groups and starts: rows are summed in bins of their distance, and the
    bins up to the subset's are added. Its expressions are made once for all steps.
    """

    def __init__(self, p: int, floors: Sequence[float]):
        self.p, self.keys = p, [*LEVEL_KEYS, "_start"]
        self.centre, self.factor = [f"m{i}" for i in range(p)], [f"l_{i}_{j}" for i, j in _pairs(p)]
        self.spread = [f"c_{i}_{j}" for i, j in _pairs(p)]
        scale = SUBSET / gamma_p(p / 2 + 1, chi_square_quantile(SUBSET, p) / 2)
        # moments about the last centre, so that no digits cancel: count, sums of gaps, sums of their products
        moments = ["cast(count(*) AS double)", *[f"sum(g{i})" for i in range(p)], *[f"sum(g{i} * g{j})" for i, j in _pairs(p)]]
        constant = [F.expr(f"max({c}) AS {c}") for c in (*self.centre, "logdet")]
        self.binned = [F.expr("count(*) AS n"), F.expr(f"array({', '.join(moments)}) AS v"), *constant]
        self.held = [F.sort_array(F.collect_list(F.struct("b", "n", "v"))).alias("bins"), F.sum("n").alias("n"), *constant]
        self.bin, self.sums = bin_of("_d").alias("b"), sums_of_nearest(F.col("bins"), F.col("n"), SUBSET, len(moments))
        self.means = [*[f"v[{1 + i}] / v[0] AS a{i}" for i in range(p)], *[f"v[{1 + p + k}] / v[0] AS s_{i}_{j}" for k, (i, j) in enumerate(_pairs(p))]]
        self.anew = [f"m{i} + a{i} AS m{i}" for i in range(p)]
        self.anew += [f"{scale!r}D * (s_{i}_{j} - a{i} * a{j}) + {floors[i] ** 2 if i == j else 0.0!r}D AS c_{i}_{j}" for i, j in _pairs(p)]
        self.columns = [*self.keys, "n", *self.centre, *self.spread, *self.factor, "logdet"]

    def __call__(self, df: DataFrame, model: DataFrame) -> DataFrame:
        placed = with_distance(df.join(model.select(*self.keys, *self.centre, *self.factor, "logdet"), LEVEL_KEYS), self.p, "_d")
        near = placed.groupBy(*self.keys, self.bin).agg(*self.binned).groupBy(*self.keys).agg(*self.held).withColumn("v", self.sums)
        made = near.selectExpr(*self.keys, "n", "logdet AS was", *self.centre, *self.means).selectExpr(*self.keys, "n", "was", *self.anew)
        return factored(made, self.p).selectExpr(*self.columns, "abs(logdet - was) AS moved")


def fit(vectors: DataFrame, most: int = STEPS) -> DataFrame:
    """Of each group of vectors (lang, source, x0, ...), each language and all documents: n, centre m_i, covariance c_i_j.

    Steps are taken by twos. Groups and starts whose determinant no longer moves are left as they are, the others go on,
    up to most steps; where a determinant still moves then, the estimate is that of the last step.
    """
    step = Step(len(FEATURES), [f for _, f in FEATURES])
    df = leveled(vectors)
    first = factored(starts(df), step.p).withColumns({"n": F.lit(0).cast("long"), "moved": F.lit(math.inf)})
    model = materialize(first.select(*step.columns, "moved"), "model")
    for _ in range(0, most, 2):
        moving = f"moved > {STILL!r}D"
        seen, before = Observation(), model
        made = step(df, step(df, model.where(moving))).unionByName(model.where(f"NOT {moving}"))
        model = materialize(made.observe(seen, F.max("moved").alias("most")), "model")
        discard(before)
        if (seen.get["most"] or 0.0) <= STILL:
            break
    values = F.struct("n", *step.centre, *step.spread)
    return materialize(model.groupBy(*LEVEL_KEYS).agg(F.min_by(values, F.struct(F.round("logdet", 6), "_start")).alias("v")).select(*LEVEL_KEYS, "v.*"), "fit")


def chosen(stats: DataFrame, model: DataFrame) -> DataFrame:
    """Centre and factored covariance that judge each group of stats, written.

    A group's own estimate has the weight n / (n + HALF_WEIGHT), the rest goes to its language's, which is mixed in the
    same way with that of all documents. So a group of any size is judged, and no size switches the estimate.
    """
    p = len(FEATURES)
    names = [*[f"m{i}" for i in range(p)], *[f"c_{i}_{j}" for i, j in _pairs(p)]]

    def level(i: int, prefix: str, *keys: str) -> DataFrame:
        return model.where(F.col("_level") == i).select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in ("n", *names)])

    groups = stats.select(*[_group(g) for g in GROUP]).distinct().withColumn("_level", F.lit(2))
    found = groups.join(level(0, "g_", *KEYS), KEYS, "left").join(level(1, "l_", "_lang"), "_lang", "left").join(level(2, "a_", "_level"), "_level", "left")

    def mixed(prefix: str, c: str, rest: str) -> str:
        n = f"coalesce({prefix}n, 0L)"
        return f"({n} * coalesce({prefix}{c}, 0D) + {HALF_WEIGHT} * {rest}) / ({n} + {HALF_WEIGHT})"

    shrunk = found.selectExpr(*KEYS, *[f"{mixed('g_', c, mixed('l_', c, f'a_{c}'))} AS {c}" for c in names])
    return materialize(factored(shrunk, p).select(*KEYS, *names[:p], *[f"l_{i}_{j}" for i, j in _pairs(p)]), "chosen")


def judged(stats: DataFrame, model: DataFrame) -> DataFrame:
    """Adds base_failed, distance and kept to rows with statistics; model is that of chosen()."""
    row = stats.select(F.struct(*stats.columns).alias("_stats"), *[c for c in stats.columns if c != "_row"])
    placed = with_vector(row).withColumns({f"_{g}": F.coalesce(F.col(g).cast("string"), F.lit("")) for g in GROUP}).join(model, KEYS, "left")
    out = with_distance(placed, len(FEATURES), "_d2").select("_stats", "_d2", base_failed().alias("base_failed"))
    return out.select("_stats.*", "base_failed", F.sqrt("_d2").alias("distance"), (~F.col("base_failed") & ~F.coalesce(F.col("_d2") > CUT, F.lit(False))).alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) to doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    One row per row of docs, repeated identifiers included. Documents that fail a base rule take no part in the
    estimates. Null languages and sources count as empty ones. Every document is judged, whatever the size of its group.
    An empty table gives no row.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    stats = materialize(with_statistics(docs.select("doc_id", "text", *GROUP)).select("doc_id", *GROUP, *names), "statistics")
    model = chosen(stats, fit(with_vector(stats.where(~base_failed()))))
    return judged(stats, model).select("doc_id", *[n for n in names if n != "n_lines"], "base_failed", "distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with the columns of docs.

    Each row goes or stays by its own verdict, whatever its doc_id, null or repeated ones included. Rows are written once
    with their statistics, so that texts are read once and no identifier is joined. An empty table gives no row.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text", *GROUP)
    stats = materialize(with_statistics(rows).select("_row", *GROUP, *names), "rows")
    numbers = stats.drop("_row")
    model = chosen(numbers, fit(with_vector(numbers.where(~base_failed()))))
    return judged(stats, model).where("kept").select("_row.*")
