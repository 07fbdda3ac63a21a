"""Quality rules whose cutoffs are certified on labelled documents.

Every rule compares one measure of a text with a cutoff from a fixed grid. For a stratum of documents (by
default a language), a rule and a cutoff, the labelled documents that are good form a binomial sample of the
rule's false rejections. A cutoff is certified if the exact binomial tail says that a false-rejection rate of
``risk / rules`` or more would show so few false rejections with probability ``delta / tests`` at most, where
``tests`` counts all strata, rules and cutoffs (Bonferroni). This is the one-sided Clopper-Pearson bound. So
with probability ``1 - delta``, no stratum loses more than ``risk`` of its good documents to all its rules
together, whichever certified cutoffs are taken. Of a rule's certified cutoffs that one is taken which gains
most: rejected share of bad documents less ``cost`` times that of good ones; a rule without a gain, or
without enough labels to certify anything, stays off in that stratum.

For that, the grids and the measures are fixed beforehand and nothing else is fitted, so all labels serve as
holdout. It takes thousands of good labels a stratum at a small risk.

:func:`joint_cutoffs` spends risk and delta better and is what the queries use. A fixed quarter of the good labels
and all bad ones, which say nothing of false rejections, lay out a path for each stratum: rules by falling gain,
each from its most lenient useful cutoff to that of the best gain, on top of the rules before. So each step rejects
all that the step before does. The other good labels then test the steps in that order, each for the documents
that any of its rules rejects, against the whole ``risk`` and at ``delta / strata``, up to the first that fails.
Such a fixed sequence needs no division by its length: a first false step would have to pass, which it does with
probability ``delta / strata`` at most. At a risk of 2 % and four strata, 217 good labels without a false rejection
are enough for a step.
Statistics cover all labelled documents, measures cover whole texts.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small, whole_text

SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\x0c\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

COUNTS = (
    "n_words LONG, word_chars LONG, n_symbols LONG, n_dup_lines LONG, n_repeat_words LONG, n_lines LONG, "
    "n_upper LONG, n_marks LONG"
)

_SHARES = (0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: Measure, and cutoffs from strict to lenient; a document is rejected if its measure is at least the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / word_chars", _SHARES),
    "capitals": ("n_upper / word_chars", _SHARES),
    "marks": ("n_marks / word_chars", _SHARES),
    "repeated_words": ("n_repeat_words / n_words", _SHARES),
    "repeated_lines": ("n_dup_lines / n_lines", _SHARES),
    "long_words": ("word_chars / n_words", (6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0, 20.0, 30.0)),
    "short_words": ("n_words / word_chars", (0.15, 0.18, 0.2, 0.22, 0.25, 0.28, 0.3, 0.35, 0.4, 0.5)),
}


def counts_of(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of :data:`COUNTS`."""
    raw = text.encode()
    words = raw.split()  # of bytes: ASCII white space only
    n_lines = n_dup = 0
    seen: set[str] = set()
    for line in text.split("\n"):
        if line.strip(_WHITE):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, _WHITE)),
        sum(map(text.count, SYMBOLS)),
        n_dup,
        _repeated(words),
        n_lines,
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _MARKS)),
    )


def _repeated(words: list[bytes], n: int = 5) -> int:
    """Words that lie in a window of ``n`` words which the text has twice or more."""
    windows = list(zip(*(words[k:] for k in range(n))))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero([times[window] > 1 for window in windows])
    np.add.at(covered, at, 1)
    np.add.at(covered, at + n, -1)
    return int((np.cumsum(covered) > 0).sum())


def _counts(texts: pd.Series) -> pd.DataFrame:
    rows = [counts_of(text) for text in texts]
    return pd.DataFrame(rows, columns=[part.split()[0] for part in COUNTS.split(", ")], dtype="int64")


def text_counts(texts: Column | str) -> Column:
    """:func:`counts_of` as a column."""
    return F.pandas_udf(_counts, COUNTS)(texts)


def base_failed(counts: str = "counts") -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    few = F.col(f"{counts}.n_words") < 10
    return few | (100 * F.col(f"{counts}.n_repeat_words") > 20 * F.col(f"{counts}.n_words"))


def _measure(formula: str, counts: str) -> Column:
    above, below = formula.split(" / ")
    return F.coalesce(F.try_divide(F.col(f"{counts}.{above}").cast("double"), F.col(f"{counts}.{below}")), F.lit(0.0))


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n draws of probability p, to double precision.

    The terms are summed from the largest downwards until they no longer count, so the work does not grow
    with ``n`` beyond its square root.
    """
    if k >= n:
        return 1.0
    if n <= 0:
        return 1.0
    top = min(k, int((n + 1) * p))
    log_top = math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1)
    log_top += top * math.log(p) + (n - top) * math.log1p(-p)
    odds = p / (1 - p)
    total = term = 1.0
    for i in range(top, 0, -1):
        term *= i / ((n - i + 1) * odds)
        total += term
        if term < total * 1e-18:
            break
    term = 1.0
    for i in range(top + 1, k + 1):
        term *= (n - i + 1) / i * odds
        total += term
        if term < total * 1e-18:
            break
    return min(1.0, math.exp(log_top + math.log(total)))


def _tails(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)], dtype="float64")


def certified_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    risk: float = 0.02,
    delta: float = 0.05,
    cost: float = 10.0,
    id_col: str = "doc_id",
) -> DataFrame:
    """One row a stratum with the cutoffs of its active rules: ``stratum, cutoffs MAP<STRING, DOUBLE>``.

    ``measured`` has ``id_col, stratum, counts``; ``labels`` has ``id_col, quality`` (1 is good). Documents
    that the base rules reject are left out of the holdout. A document labelled several times is good if all
    its labels say so; null ids and null labels are ignored.
    """
    judged = labels.where(F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("good"))
    held = measured.where(~base_failed()).join(judged, id_col)
    levels = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                # Number of cutoffs that reject the document; cutoffs rise, so these are the first ones.
                sum((_measure(formula, "counts") >= c).cast("int") for c in grid).alias("level"),
            )
            for name, (formula, grid) in RULES.items()
        ]
    )
    seen = held.select("stratum", "good", F.explode(levels).alias("at")).groupBy("stratum", "at.rule", "at.level")
    seen = seen.agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    whole = Window.partitionBy("stratum", "rule")  # of at most one row a cutoff
    grid_rows = [(name, i, float(c)) for name, (_, grid) in RULES.items() for i, c in enumerate(grid)]
    totals = seen.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    grid = measured.sparkSession.createDataFrame(grid_rows, "rule STRING, i INT, cutoff DOUBLE")
    cells = totals.join(F.broadcast(grid), "rule")
    cells = cells.join(seen.select("stratum", "rule", (F.col("level") - 1).alias("i"), "good", "bad"), ["stratum", "rule", "i"], "left")
    beyond = whole.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select(
        "stratum",
        "rule",
        "cutoff",
        "n_good",
        "n_bad",
        F.coalesce(F.sum("good").over(beyond), F.lit(0)).alias("false_rejected"),
        F.coalesce(F.sum("bad").over(beyond), F.lit(0)).alias("caught"),
    )
    strata = max(1, seen.select("stratum").distinct().count())
    tests = strata * len(grid_rows)
    tail = F.pandas_udf(_tails, "double")("false_rejected", "n_good", F.lit(risk / len(RULES)))
    gain = F.try_divide("caught", "n_bad") - cost * F.try_divide("false_rejected", "n_good")
    certified = cells.withColumn("tail", tail).withColumn("gain", gain).where(F.col("tail") <= delta / tests)
    best = certified.where("gain > 0").groupBy("stratum", "rule").agg(
        F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff")
    )
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def joint_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    risk: float = 0.02,
    delta: float = 0.05,
    cost: float = 10.0,
    id_col: str = "doc_id",
) -> DataFrame:
    """Like :func:`certified_cutoffs`, by a fixed sequence of joint rule sets.

    Labels belong to the path or to the tests by a hash of the id.
    """
    spark = measured.sparkSession
    judged = labels.where(F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("good"))
    level = [sum((_measure(formula, "counts") >= c).cast("int") for c in grid).alias(name) for name, (formula, grid) in RULES.items()]
    part = F.pmod(F.xxhash64(F.lit("path"), F.col(id_col)), F.lit(4)) == 0
    held = measured.where(~base_failed()).join(judged, id_col).select("stratum", "good", part.alias("path"), *level)
    # A row for each stratum and rule and cutoff at most, and for each combination of levels that occurs.
    held = saved(held, "judged-levels")
    strata = max(1, held.select("stratum").distinct().count())
    first = held.where("path OR good = 0")
    levels = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("level")) for name in RULES])
    seen = first.select("stratum", "good", F.explode(levels).alias("at")).groupBy("stratum", "at.rule", "at.level")
    seen = seen.agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    # A stratum's rows are at most one a cutoff and rule.
    rows = seen.groupBy("stratum").applyInPandas(lambda group: _path(group, cost), "stratum STRING, step INT, rule STRING, level INT")
    path = saved(rows, "path")
    steps = path.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("step", "rule", "level"))).alias("steps"))
    own = F.create_map(*[x for name in RULES for x in (F.lit(name), F.col(name))])
    tested = held.where("NOT path AND good = 1").join(small(steps), "stratum")
    hit = F.filter("steps", lambda step: F.element_at(F.col("own"), step["rule"]) >= step["level"])
    tested = tested.select("stratum", "steps", own.alias("own")).select("stratum", F.coalesce(F.get(hit, F.lit(0))["step"], F.lit(-1)).alias("step"))
    counted = tested.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    both = path.withColumn("n", F.lit(0).cast("long")).unionByName(counted, allowMissingColumns=True)
    return both.groupBy("stratum").applyInPandas(
        lambda group: _accepted(group, risk, delta / strata), "stratum STRING, cutoffs MAP<STRING, DOUBLE>"
    )


def _path(group: pd.DataFrame, cost: float) -> pd.DataFrame:
    """The steps of a stratum: rules by falling gain, each from lenient to the cutoff of the best gain."""
    found = []
    for rule, rows in group.groupby("rule"):
        n_good, n_bad = rows["good"].sum(), rows["bad"].sum()
        if not n_bad:
            continue
        cells = []
        for level in range(1, len(RULES[rule][1]) + 1):
            beyond = rows[rows["level"] >= level]
            caught, false = beyond["bad"].sum(), beyond["good"].sum()
            if caught:
                cells.append((caught / n_bad - cost * (false / n_good if n_good else 0.0), level))
        best = max(cells, default=(0.0, 0))
        if best[0] > 0:
            found.append((-best[0], rule, [level for _, level in cells[::-1] if level >= best[1]]))
    steps = [(rule, level) for _, rule, levels in sorted(found) for level in levels]
    out = pd.DataFrame(steps, columns=["rule", "level"])
    return out.assign(stratum=group["stratum"].iloc[0], step=range(len(out)))[["stratum", "step", "rule", "level"]]


def _accepted(group: pd.DataFrame, risk: float, delta: float) -> pd.DataFrame:
    """The cutoffs of the last step before the first that fails."""
    steps = group[group["rule"].notna()].sort_values("step")
    counted = group[group["rule"].isna()]
    n_good, cutoffs = int(counted["n"].sum()), {}
    for step, rule, level in zip(steps["step"], steps["rule"], steps["level"]):
        false = int(counted.loc[(counted["step"] >= 0) & (counted["step"] <= step), "n"].sum())
        if binomial_tail(false, n_good, risk) > delta:
            break
        cutoffs[rule] = RULES[rule][1][int(level) - 1]
    return pd.DataFrame({"stratum": [group["stratum"].iloc[0]], "cutoffs": [cutoffs]})


def verdict(counts: str = "counts", cutoffs: str = "cutoffs") -> Column:
    """True unless the base or one of the stratum's rules rejects."""
    rejected = base_failed(counts)
    for name, (formula, _) in RULES.items():
        cutoff = F.try_element_at(F.col(cutoffs), F.lit(name))
        rejected = rejected | F.coalesce(_measure(formula, counts) >= cutoff, F.lit(False))
    return ~rejected


def judge(
    docs: DataFrame,
    labels: DataFrame,
    risk: float = 0.02,
    delta: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    joint: bool = False,
) -> DataFrame:
    """One row a document: ``id_col, stratum, counts, base_failed, kept``.

    A null text is empty and fails the base. A null stratum and an empty one are the same. Without labels the
    base alone decides. ``joint`` takes :func:`joint_cutoffs`. Other columns are ignored; an empty table gives no rows.
    """
    measured = saved(
        docs.select(
            F.col(id_col), _stratum(stratum_col).alias("stratum"), text_counts(whole_text(text_col)).alias("counts")
        ),
        "text-counts",
    )
    certify = joint_cutoffs if joint else certified_cutoffs
    cutoffs = saved(certify(measured, labels, risk, delta, id_col=id_col), "cutoffs")
    joined = measured.join(small(cutoffs), "stratum", "left")
    return joined.select(id_col, "stratum", "counts", base_failed().alias("base_failed"), verdict().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, joint: bool = False) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    measured = saved(
        docs.select("doc_id", _stratum("lang").alias("stratum"), text_counts(whole_text()).alias("counts")), "text-counts"
    )
    cutoffs = saved((joint_cutoffs if joint else certified_cutoffs)(measured, labels, risk, delta), "cutoffs")
    lookup = cutoffs.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs"))
    # The counts are taken again instead of being joined: the texts then need no shuffle.
    rows = docs.withColumn("_stratum", _stratum("lang")).join(small(lookup), "_stratum", "left")
    rows = rows.withColumn("_counts", text_counts(whole_text()))
    return rows.where(verdict("_counts", "_cutoffs")).select(*[F.col(name) for name in docs.columns])
