"""Quality rules by robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Everything is a DataFrame plan. The statistics of a text are array expressions on its own row; the estimates are
grouped sums over the table of statistics, which is written once; the models are one row per (language, source).
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gradus.session import written

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

VECTOR = ("log_word_chars", "log_symbols", "log_dup_lines", "log_repeat_words")
#: Spread that a clean short text has by chance in each coordinate; no estimate goes below it.
FLOOR = (0.06, 0.02, 0.08, 0.07)
SUBSET = 0.75
STEPS = 4
MIN_ROWS = 50
CUT_TAIL = 1e-3
#: Models up to this many are sent to every executor (about 200 bytes each); beyond it rows meet them by a shuffle.
BROADCAST_ROWS = 100_000


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-square > x) for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_point(tail: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, dof) > tail else (low, mid)
    return low


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of whole texts.

    A null text counts as empty. Repeated three-word windows are found by sorting the windows' hashes within the row,
    so a text's cost is n log n and nothing is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", F.xxhash64("doc_id", "lang", "source", "text").alias("row"), text.alias("t"))
    rows = rows.withColumns({
        "w": F.filter(F.split(F.translate("t", BLANKS, " " * len(BLANKS)), " "), lambda x: x != ""),
        "lines": F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, BLANKS, "") != ""),
        "word_chars": F.length(F.translate("t", BLANKS, "")).cast("bigint"),
        "n_symbols": (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint"),
    })
    rows = rows.select(
        "doc_id", "lang", "source", "row", "word_chars", "n_symbols", "w", F.size("w").cast("bigint").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    windows = F.transform(
        F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)).alias("v"), i.alias("i")),
    )
    rows = rows.select(*[c for c in rows.columns if c not in ("w", "h")], F.sort_array(windows).alias("s"))
    value = lambda i: F.get("s", i)["v"]
    twice = F.filter("s", lambda x, i: ((i > 0) & (value(i - 1) == x["v"])) | F.coalesce(value(i + 1) == x["v"], F.lit(False)))
    rows = rows.select(*[c for c in rows.columns if c != "s"], F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"))
    step = F.transform("at", lambda x, i: F.least(F.coalesce(F.get("at", i + 1) - x, F.lit(3)), F.lit(3)))
    rows = rows.select(*[c for c in rows.columns if c != "at"], F.aggregate(step, F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def with_vector(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistic vector: log mean word length and logs of the symbol, line and window shares."""
    n = F.greatest("n_words", F.lit(1))
    return stats.withColumns(dict(zip(VECTOR, [
        F.log((F.col("word_chars") + 1) / n), F.log1p(F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines") / F.sqrt(n.cast("double"))), F.log1p(F.col("n_repeat_words") / n),
    ])))


def _determinant(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    minors = [m[0][j] * _determinant([[r[k] for k in range(len(m)) if k != j] for r in m[1:]]) for j in range(len(m))]
    return reduce(lambda a, x: a + x, [x if j % 2 == 0 else -x for j, x in enumerate(minors)])


def _inverse(m: list[list[Column]]) -> dict[str, Column]:
    """Upper triangle of a symmetric matrix's inverse by cofactors."""
    p, det = len(m), _determinant(m)
    minor = lambda i, j: _determinant([[m[r][c] for c in range(p) if c != j] for r in range(p) if r != i])
    return {f"p{i}{j}": minor(i, j) * (-1.0) ** (i + j) / det for i in range(p) for j in range(i, p)}


def _distance(p: int) -> Column:
    d = [F.col(VECTOR[i]) - F.col(f"m{i}") for i in range(p)]
    return reduce(lambda a, x: a + x, [F.col(f"p{i}{j}") * d[i] * d[j] * (1.0 if i == j else 2.0) for i in range(p) for j in range(i, p)])


def _models(rows: DataFrame, group: list[str], scale: float) -> DataFrame:
    """Mean, inverse covariance and count of each group; covariances times `scale`, variances at least FLOOR squared."""
    p = len(VECTOR)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.groupBy(*group).agg(
        F.count("*").alias("n"), *[F.avg(VECTOR[i]).alias(f"m{i}") for i in range(p)],
        *[F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}{j}") for i, j in pairs],
    )
    cell = lambda i, j: F.coalesce(F.col(f"c{min(i, j)}{max(i, j)}"), F.lit(0.0)) * scale + (FLOOR[i] ** 2 if i == j else 0.0)
    sums = sums.select(*group, "n", *[f"m{i}" for i in range(p)], *[cell(i, j).alias(f"c{i}{j}") for i, j in pairs])
    m = [[F.col(f"c{min(i, j)}{max(i, j)}") for j in range(p)] for i in range(p)]
    return sums.select(*group, "n", *[f"m{i}" for i in range(p)], *[e.alias(k) for k, e in _inverse(m).items()])


def _sendable(table: DataFrame) -> DataFrame:
    """A written table of one row a group, broadcast if its counted rows allow it, so that hot groups are not shuffled."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def estimates(rows: DataFrame, group: list[str]) -> DataFrame:
    """Minimum-covariance-determinant models, one row per group (mean m*, inverse scatter p**, rows n).

    The start are medians and mean absolute deviations; each concentration step takes the mean and covariance of the
    SUBSET of rows nearest to the last model, whose determinant never grows. Thresholds are mergeable quantile sketches
    and sums partial aggregates, so a hot group costs no more than others. The covariance is scaled to be right for a
    normal core. Thresholds and models are written, one row per group, counted, and broadcast up to BROADCAST_ROWS.
    """
    p = len(VECTOR)
    keep = [F.col(g) for g in group]
    medians = rows.groupBy(*group).agg(F.count("*").alias("n"), *[F.percentile_approx(v, 0.5, 10000).alias(f"m{i}") for i, v in enumerate(VECTOR)])
    medians = written(medians, "medians")
    near = rows.join(_sendable(medians.drop("n")), group)
    spread = near.groupBy(*group).agg(*[F.percentile_approx(F.abs(F.col(v) - F.col(f"m{i}")), 0.5, 10000).alias(f"s{i}") for i, v in enumerate(VECTOR)])
    variance = lambda i: F.pow(F.col(f"s{i}") * 1.4826, F.lit(2)) + FLOOR[i] ** 2
    start = medians.join(spread, group).select(
        *keep, "n", *[f"m{i}" for i in range(p)],
        *[(1 / variance(i) if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i in range(p) for j in range(i, p)])
    models = written(start, "models")
    inner = chi2_point(1 - SUBSET, p)
    scale = SUBSET / (1 - chi2_tail(inner, p + 2))
    for _ in range(STEPS):
        scored = rows.join(_sendable(models.drop("n")), group).select(*keep, *VECTOR, _distance(p).alias("d"))
        bounds = written(scored.groupBy(*group).agg(F.percentile_approx("d", SUBSET, 10000).alias("bound")), "bounds")
        core = scored.join(_sendable(bounds), group).filter("d <= bound")
        models = written(_models(core, group, scale), "models")
    return models


def quality(docs: DataFrame, cut_tail: float = CUT_TAIL) -> DataFrame:
    """Statistics, squared robust distance and verdict of every document.

    Models come from rows that pass the base rules, grouped by (lang, source), a null being a group of its own; a
    group below MIN_ROWS rows takes its language's model, a language below that the model of all rows. A document is
    rejected if it fails the base rules or its squared distance exceeds the chi-square point of `cut_tail`. Without
    any model (no row passes the base rules) nothing else is rejected. Rows are judged one by one, so null or
    repeated ids and equal texts get equal verdicts; `row` is the hash of a row's id, language, source and text.
    """
    stats = written(with_vector(text_statistics(docs)), "statistics")
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    levels = [F.concat_ws("\n", key("lang"), key("source")), key("lang"), F.lit("")]
    base = stats.filter(~F.col("base_failed")).select(F.explode(F.array(*levels)).alias("group"), *VECTOR)
    p = len(VECTOR)
    parts = [f"m{i}" for i in range(p)] + [f"p{i}{j}" for i in range(p) for j in range(i, p)]
    enough = (F.col("n") >= MIN_ROWS * SUBSET) | (F.col("group") == "")
    models = estimates(base, ["group"]).filter(enough).select("group", F.struct(*parts).alias("model"))
    few, chosen = models.count() <= BROADCAST_ROWS, stats
    for k, level in enumerate(levels):
        one = models.select(F.col("group").alias(f"group_{k}"), F.col("model").alias(f"model_{k}"))
        chosen = chosen.withColumn(f"level_{k}", level).join(F.broadcast(one) if few else one, F.col(f"level_{k}") == F.col(f"group_{k}"), "left")
    chosen = chosen.withColumn("model", F.coalesce(*[f"model_{k}" for k in range(len(levels))]))
    scored = chosen.select(*stats.columns, *[F.col("model")[c].alias(c) for c in parts]).withColumn("distance", _distance(p))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_point(cut_tail, p))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance", "row")
