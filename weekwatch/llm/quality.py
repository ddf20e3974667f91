"""Quality rules: base rules and robust multivariate outliers, by Column expressions and aggregates only.

Statistics of each text are turned into a vector of four: log mean word length, and the square roots of
symbols per word, of the share of repeated words and of the share of repeated lines. For every
(language, source), every language and the whole table a minimum-covariance-determinant estimate is
found: from several starts, medians with median deviations and subsets of about SUBSET vectors drawn by hash, concentration steps keep the
`share` of vectors nearest by Mahalanobis distance and take mean and covariance of those. After FIRST_STEPS the start of
least determinant goes on alone, until the determinant of the group no longer falls. The covariance is made consistent
for normal data and gets a floor for each statistic, as in clean text most of these rates are exactly zero.
A document is rejected if its distance by the narrowest group of at least `least` documents is beyond the
cutoff. Base rules come first; documents that fail them take no part in the estimates.

All estimates are grouped sums and mergeable quantile sketches, so a source with a third of all rows is
merged before it is shuffled; what is joined back is one row per group, broadcast while there are few, so that the vectors
themselves are not shuffled. Each step is written as a table: its plan ends there, and the next one reads files. Medians and the share are exact for
groups of up to ACCURACY documents and within 1 / ACCURACY of the rank beyond.

Defined cases: a null text has no words and fails the base rules; null languages and sources are groups
of their own; a document without any group of `least` documents is judged by the base rules alone. Equal
rows get equal verdicts, an empty table gives no row, and texts of any length are counted whole. Only doc_id, text, lang and source are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from weekwatch.llm.chat import let
from weekwatch.llm.registry import query, table
from weekwatch.llm.shared import store
from weekwatch.session import cut_lineage

MIN_WORDS, MOST_REPEATED = 50, 50  # words; per cent of words
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
VECTOR = ("x_length", "x_symbols", "x_repeats", "x_lines")
#: Least standard deviation of each statistic: differences below it are not held against a text. All are small enough
#: for one statistic to reject a text by itself where the rest of its group has none.
FLOORS = {"x_length": 0.05, "x_symbols": 0.08, "x_repeats": 0.12, "x_lines": 0.16}
SHARE, TAIL, LEAST, ACCURACY = 0.75, 1e-6, 50, 10_000
STARTS, SUBSET, FIRST_STEPS, SETTLED = 4, 10, 2, 1e-9  # at most five starts: one md5 sum draws four subsets
MOST_BROADCAST = 100_000  # rows of 16 numbers


def chi2_below(x: float, df: int) -> float:
    """Distribution function of chi squared for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, df) < p else (low, mid)
    return high


CUTOFF = chi2_quantile(1 - TAIL, len(VECTOR))
#: Covariance of the nearest SHARE of normal vectors times this is that of all.
CONSISTENCY = SHARE / chi2_below(chi2_quantile(SHARE, len(VECTOR)), len(VECTOR) + 2)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(
                s, lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False))
            )
            return let(
                F.sort_array(F.transform(twice, lambda e: e["i"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, i - 1)))),
                    F.lit(0).cast("long"), lambda a, x: a + x,
                ),
            )

        path = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(path)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(windows(words), covered))


def text_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a text."""
    filled = F.coalesce(text.cast("string"), F.lit(""))

    def long(c: Column, name: str) -> Column:
        return c.cast("long").alias(name)

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
        return let(
            F.struct(words_of(t).alias("words"), lines.alias("lines")),
            lambda s: F.struct(
                long(F.size(s["words"]), "n_words"),
                long(F.length(F.translate(t, SPACE, "")), "word_chars"),
                long(F.length(t) - F.length(F.translate(t, SYMBOLS, "")), "n_symbols"),
                long(F.size(s["lines"]) - F.size(F.array_distinct(s["lines"])), "n_dup_lines"),
                long(_repeated_words(s["words"]), "n_repeat_words"),
                long(F.size(s["lines"]), "n_lines"),
            ),
        )

    return let(filled, of_text)


def base_failed(s) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


def vector(s) -> list[Column]:
    """The transformed statistics of a text that has words."""
    n = F.greatest(s["n_words"], F.lit(1))
    return [
        F.log(F.greatest(s["word_chars"] / n, F.lit(1.0))).alias("x_length"),
        F.sqrt(s["n_symbols"] / n).alias("x_symbols"),
        F.sqrt(s["n_repeat_words"] / n).alias("x_repeats"),
        F.sqrt(s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1))).alias("x_lines"),
    ]


KEY = ("level", "g_lang", "g_source")
ROUND = (*KEY, "start")


def _keyed(vectors: DataFrame) -> DataFrame:
    """Each vector under its (language, source), its language and the whole table."""
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("g_lang"), F.col("source").alias("g_source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("g_lang"), F.lit(None).cast("string").alias("g_source")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("g_lang"), F.lit(None).cast("string").alias("g_source")),
    )
    return vectors.select(*VECTOR, "lot", F.explode(levels).alias("k")).select("k.*", *VECTOR, "lot")


def _cholesky() -> list[Column]:
    """Columns l_i_j of the triangle of v_i_j; a floor on the diagonal keeps it positive."""
    p, cell, out = len(VECTOR), {}, []
    for j in range(p):
        for i in range(j, p):
            rest = F.col(f"v_{i}_{j}")
            for k in range(j):
                rest = rest - cell[i, k] * cell[j, k]
            cell[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / cell[j, j]
            out.append(cell[i, j].alias(f"l_{i}_{j}"))
    return out


def distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance of a vector by columns m_i and l_i_j."""
    y: list[Column] = []
    for i in range(len(VECTOR)):
        rest = x[i] - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * y[k]
        y.append(rest / F.col(f"l_{i}_{i}"))
    return sum((c * c for c in y[1:]), y[0] * y[0])


def _join(rows: DataFrame, estimates: DataFrame, on: tuple[str, ...] = KEY, small: bool = False) -> DataFrame:
    """Few rows per group are joined; they are broadcast if they are `small`, else AQE splits large groups."""
    e = estimates.select(*[F.col(c).alias(f"e_{c}") for c in on], *[c for c in estimates.columns if c not in on and c not in rows.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    return rows.join(F.broadcast(e) if small else e, same).drop(*[f"e_{c}" for c in on])


def _quantile(c: Column, q: float) -> Column:
    return F.percentile_approx(c, F.lit(q), F.lit(ACCURACY))


def _estimates(near: DataFrame, consistency: float = CONSISTENCY) -> DataFrame:
    """Mean, triangle and log determinant of each group and start from the vectors chosen for it."""
    p = len(VECTOR)
    sums = near.groupBy(*ROUND, "n").agg(
        *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(VECTOR)],
        *[F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c_{i}_{j}") for j in range(p) for i in range(j, p)],
    )
    floor = [F.lit(FLOORS[x] ** 2) for x in VECTOR]
    v = [(F.col(f"c_{i}_{j}") * consistency + (floor[i] if i == j else F.lit(0.0))).alias(f"v_{i}_{j}") for j in range(p) for i in range(j, p)]
    m = [f"m_{i}" for i in range(p)]
    return _with_determinant(sums.select(*ROUND, "n", *m, *v).select(*ROUND, "n", *m, *_cholesky()))


def _with_determinant(estimates: DataFrame) -> DataFrame:
    return estimates.withColumn("det", sum((2 * F.log(f"l_{i}_{i}") for i in range(1, len(VECTOR))), 2 * F.log("l_0_0")))


def _concentrated(rows: DataFrame, estimates: DataFrame, share: float, small: bool) -> DataFrame:
    """One step: the `share` of each group's vectors nearest by each of its estimates gives a new one, of no larger determinant."""
    d = distance([F.col(x) for x in VECTOR])
    near = _join(rows, estimates, KEY, small)
    carried = [F.first(c).alias(c) for c in estimates.columns if c not in ROUND]  # one value in each group
    limits = store(near.groupBy(*ROUND).agg(_quantile(d, share).alias("limit"), *carried))
    return _estimates(_join(rows, limits, KEY, small).where(d <= F.col("limit")))


def fit(vectors: DataFrame, share: float = SHARE, starts: int = STARTS, first_steps: int = FIRST_STEPS) -> DataFrame:
    """(level, g_lang, g_source, n, m_i, l_i_j, det) from vectors with lang, source and lot: the least determinant found for each group."""
    p = len(VECTOR)
    rows = store(_keyed(vectors))
    middle = store(rows.groupBy(*KEY).agg(F.count("*").alias("n"), *[_quantile(F.col(x), 0.5).alias(f"m_{i}") for i, x in enumerate(VECTOR)]))
    small = middle.count() * starts <= MOST_BROADCAST
    spread = _join(rows, middle, KEY, small).groupBy(*KEY, "n", *[f"m_{i}" for i in range(p)]).agg(
        *[_quantile(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5).alias(f"s_{i}") for i, x in enumerate(VECTOR)]
    )
    diagonal = [
        (F.greatest(1.4826 * F.col(f"s_{i}"), F.lit(FLOORS[VECTOR[i]])) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for j in range(p) for i in range(j, p)
    ]
    medians = _with_determinant(spread.select(*KEY, F.lit(0).alias("start"), "n", *[f"m_{i}" for i in range(p)], *diagonal))
    # about SUBSET vectors for each of the other starts, by eight digits of the row's md5 sum
    lots = _join(rows, middle.select(*KEY, "n"), KEY, small).withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(starts - 1))))
    number = F.conv(F.substr("lot", F.col("start") * 8 - 7, F.lit(8)), 16, 10).cast("bigint")
    drawn = lots.where(F.pmod(number, F.greatest(F.lit(1), F.floor(F.col("n") / SUBSET))) == 0)
    estimates = store(medians.unionByName(_estimates(drawn, 1.0)))
    for _ in range(first_steps):
        estimates = store(_concentrated(rows, estimates, share, small))
    found = [c for c in estimates.columns if c not in KEY]
    best = estimates.groupBy(*KEY).agg(F.min_by(F.struct(*found), F.struct("det", "start")).alias("b"))
    active, done = store(best.select(*KEY, "b.*")), None
    while not active.isEmpty():
        after = _concentrated(rows, active, share, small).select(*KEY, F.struct(*found).alias("after"))
        both = _join(active.withColumnRenamed("det", "det_before"), after, KEY, small)
        both = store(both.withColumn("falls", F.col("after.det") < F.col("det_before") - SETTLED))
        still = both.where(~F.col("falls")).withColumnRenamed("det_before", "det").select(*KEY, *found)
        done = still if done is None else done.unionByName(still)
        active = both.where("falls").select(*KEY, "after.*")
    return store((active if done is None else done).drop("start"))


def verdict(rows: DataFrame, estimates: DataFrame, least: int = LEAST, cutoff: float = CUTOFF) -> DataFrame:
    """`rows` (with lang, source, base_failed and the vector) and a column `kept`.

    Estimates are one row per group; they are broadcast up to MOST_BROADCAST of them, else joined by key.
    """
    out, small = rows, estimates.count() <= MOST_BROADCAST
    for level in (0, 1, 2):
        e = estimates.where((F.col("level") == level) & (F.col("n") >= least)).select(
            F.col("g_lang").alias("e_lang"), F.col("g_source").alias("e_source"), *[c for c in estimates.columns if c[:2] in ("m_", "l_")]
        )
        on = F.lit(True)
        if level < 2:
            on = F.col("lang").eqNullSafe(F.col("e_lang"))
        if level < 1:
            on = on & F.col("source").eqNullSafe(F.col("e_source"))
        if level == 2:
            # one row; a scalar subquery instead of a join
            whole = e.agg(F.first(F.struct(*[c for c in e.columns if c[:2] in ("m_", "l_")])).alias("e"))
            out = out.withColumn("e_all", whole.select("e").scalar())
            out = out.select(*[c for c in out.columns if c != "e_all"], "e_all.*")
        else:
            out = out.join(F.broadcast(e) if small else e, on, "left")
        names = [c for c in e.columns if c[:2] in ("m_", "l_")] + ([] if level == 2 else ["e_lang", "e_source"])
        out = out.withColumn(f"d_{level}", distance([F.col(x) for x in VECTOR])).drop(*names)
    d = F.coalesce("d_0", "d_1", "d_2", F.lit(0.0))
    return out.withColumn("kept", ~F.col("base_failed") & (d <= cutoff)).drop("d_0", "d_1", "d_2")


def judged(docs: DataFrame, *carry: Column, cut=cut_lineage, **limits) -> DataFrame:
    """doc_id, statistics, base_failed, vector and kept of each row, with the columns of `carry`; `cut` writes the statistics."""
    s = docs.select(
        *carry, F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        text_statistics(F.col("text")).alias("s"),
    )
    rows = cut(s.select(*[c for c in s.columns if c != "s"], "s.*", base_failed(F.col("s")).alias("base_failed"), *vector(F.col("s"))))
    lot = F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in STATISTICS])).alias("lot")
    estimates = fit(rows.where(~F.col("base_failed")).select("lang", "source", *VECTOR, lot))
    return verdict(rows, estimates, **limits)


def kept_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of `docs` that the rules keep."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return judged(docs, whole, cut=store, **limits).where("kept").select("doc.*")


@query("op7_quality_rules")
def op7(spark, sf_dir):
    """All documents with their statistics and verdict."""
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
