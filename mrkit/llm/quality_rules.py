"""Quality rules whose cutoffs carry a guarantee on how many good documents they reject.

Every rule rejects documents with a statistic above a cutoff. A cutoff comes from a fixed ladder, from lenient to
strict. For each stratum and rule the labelled good documents test, step by step, the hypothesis "this cutoff rejects
more than the allowed share"; an exact binomial tail decides, and the first hypothesis that stands ends the walk
(fixed sequence testing, so the steps of one ladder need no correction). Over strata and rules the error level is
divided (Bonferroni), and so is the allowed share over the rules, as a document may fall to any of them. With
probability ``1 - error`` no stratum loses more than ``false_rejection`` of its good documents.

This holds for all certified cutoffs at once, so any of them may be chosen. The labelled bad documents choose: rule by
rule, those that reject most good documents first, a cutoff becomes as lenient as it can while it still rejects the
bad documents that no other rule rejects, and a rule without such documents gets none. What the strictest cutoffs
reject of the labelled bad documents is still rejected. A stratum without labelled bad documents keeps the strictest.

Defined results: a NULL or empty text has no words and fails the base rule. NULL as stratum is a stratum of its own.
Strata without enough labelled good documents get no cutoff and lose nothing to the rules. Repeated rows are judged
row by row; of repeated labels of a document the lowest counts. Labels that are NULL are not used. Extra columns are
ignored by ``quality_rules`` and passed on by ``filter_documents``.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mrkit.llm.common import CONTINUATION, SPACES, free_name, texts
from mrkit.session import checkpoint

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

FALSE_REJECTION = 0.04
ERROR = 0.05
LADDER = 48

# Cutoffs, some 50 bytes each, that are broadcast; with more, rows and cutoffs are joined by shuffling.
BROADCAST_CUTOFFS = 20_000

MIN_WORDS = 50

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def text_statistics(text: bytes) -> tuple[int, ...]:
    """The values of ``STATISTICS`` for one text in UTF-8. ``n_lines`` counts lines with a word."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, SPACES + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list[bytes]) -> int:
    """The words inside windows of three words that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def statistics(text: str | Column) -> Column:
    """``STATISTICS`` of a text column as a struct."""

    @F.arrow_udf("struct<" + ", ".join(f"{name}: long" for name in STATISTICS) + ">")
    def measured(text: pa.Array) -> pa.Array:
        columns = zip(*map(text_statistics, texts(text))) if len(text) else [()] * len(STATISTICS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], STATISTICS)

    return measured.asNondeterministic()(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def rules(s: Column) -> dict[str, Column]:
    """The statistic of every rule, scaled so that the ladder spans 0 to 1; larger is worse."""
    words = F.greatest(s["n_words"], F.lit(1))
    length = s["word_chars"] / words
    return {
        "symbols": F.least(s["n_symbols"] / words, F.lit(1.0)),
        "dup_lines": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "repeats": s["n_repeat_words"] / words,
        "long_words": F.least(length / 40, F.lit(1.0)),
        "short_words": 1 - F.least(length / 10, F.lit(1.0)),
        "few_words": F.least(MIN_WORDS / words, F.lit(1.0)),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), as a sum of exact terms with the largest factored out."""
    if k >= n:
        return 1.0
    if n == 0 or k < 0:
        return 0.0
    odds, log_top = p / (1 - p), _log_term(k, n, p)
    total = term = 1.0
    if k > n * p:
        return 1.0 - binomial_tail(n - k - 1, n, 1 - p)
    for i in range(k, 0, -1):
        term *= i / ((n - i + 1) * odds)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, math.exp(log_top) * total)


def _log_term(k: int, n: int, p: float) -> float:
    choose = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    return choose + k * math.log(p) + (n - k) * math.log1p(-p)


def learn_cutoffs(
    labelled: DataFrame,
    stratum: str,
    statistic: str,
    good: str,
    false_rejection: float = FALSE_REJECTION,
    error: float = ERROR,
    ladder: int = LADDER,
) -> DataFrame:
    """``(stratum, rule, cutoff)`` for the strata and rules with a certified cutoff that serves.

    ``labelled`` has a stratum, the struct of ``statistics`` and whether the document is good. Only counts per stratum,
    rule and step are gathered.
    """
    bad = labelled.where(~F.col(good) & ~base_failed(F.col(statistic)))
    bad = bad.select(F.col(stratum).alias("stratum"), F.col(statistic).alias("s"))
    certified = _certified_cutoffs(labelled, stratum, statistic, good, false_rejection, error, ladder)
    return _chosen_cutoffs(certified, bad, ladder)


def _chosen_cutoffs(certified: DataFrame, bad: DataFrame, ladder: int) -> DataFrame:
    """The certified cutoffs ``(stratum, rule, cutoff, lost)``, as lenient as the bad documents ``(stratum, s)`` allow."""
    bad, some = checkpoint(bad), F.lit(True).alias("some")
    costly = Window.partitionBy("stratum").orderBy(F.desc("lost"), "rule")
    with_bad = bad.select(F.col("stratum").alias("of"), some).distinct()
    cutoffs = certified.withColumn("turn", F.row_number().over(costly))
    cutoffs = cutoffs.join(with_bad, F.col("stratum").eqNullSafe(F.col("of")), "left")
    cutoffs = checkpoint(cutoffs.select("stratum", "rule", "cutoff", "turn", F.coalesce("some", F.lit(False)).alias("some")))
    last = cutoffs.where("some").agg(F.max("turn")).first()[0] or 0
    for turn in range(1, last + 1):
        both = cutoffs.select("stratum", "rule", F.struct("cutoff", "turn").alias("cutoff"))
        rows = _with_cutoffs(bad, F.col("stratum"), both, "cutoffs").where(F.col("cutoffs").isNotNull())
        rejecting = []
        for rule, value in rules(F.col("s")).items():
            at = F.element_at("cutoffs", rule)
            rejecting.append(F.when(value > at["cutoff"], F.struct(F.lit(rule).alias("rule"), value.alias("value"), at["turn"].alias("turn"))))
        rows = rows.select("stratum", F.array_compact(F.array(*rejecting)).alias("by"))
        alone = rows.where((F.size("by") == 1) & (F.col("by")[0]["turn"] == turn)).select(F.col("stratum").alias("of"), F.col("by")[0]["value"].alias("value"))
        least = alone.groupBy("of").agg(F.min("value").alias("least"))
        # The highest step below the least value to reject; the second case is for rounding.
        step = F.ceil(F.col("least") * ladder) - 1
        lenient = F.when(F.col("least") > step / ladder, step / ladder).otherwise((step - 1) / ladder)
        found = least.select("of", F.greatest(lenient, F.lit(0.0)).alias("lenient"))
        cutoffs = cutoffs.join(found, F.col("stratum").eqNullSafe(F.col("of")), "left")
        now = F.col("some") & (F.col("turn") == turn)
        cutoffs = cutoffs.withColumn("cutoff", F.when(now, F.when(F.col("lenient").isNotNull(), F.greatest("cutoff", "lenient"))).otherwise(F.col("cutoff")))
        cutoffs = checkpoint(cutoffs.where("cutoff IS NOT NULL").drop("of", "lenient"))
    return cutoffs.select("stratum", "rule", "cutoff")


def _certified_cutoffs(
    labelled: DataFrame, stratum: str, statistic: str, good: str, false_rejection: float, error: float, ladder: int
) -> DataFrame:
    """``(stratum, rule, cutoff, lost)``: the strictest certified cutoffs and how many labelled good documents they reject."""
    values = rules(F.col(statistic))
    share = false_rejection / len(values)

    @F.arrow_udf("boolean")
    def certified(rejected: pa.Array, n: pa.Array, level: pa.Array) -> pa.Array:
        rows = zip(rejected.to_pylist(), n.to_pylist(), level.to_pylist())
        return pa.array([binomial_tail(k, m, share) <= limit for k, m, limit in rows], pa.bool_())

    # A step is the number of cutoffs i / ladder, i = 0 ... ladder - 1, that lie below the value and so reject it.
    step = lambda value: F.least(F.ceil(value * ladder), F.lit(ladder)).cast("int")
    good_ones = labelled.where(F.col(good) & ~base_failed(F.col(statistic)))
    each = F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), step(v).alias("step")) for r, v in values.items()]))
    steps = good_ones.select(F.col(stratum).alias("stratum"), each)
    counts = steps.groupBy("stratum", "rule", "step").agg(F.count("*").alias("n"))
    strata = counts.select(F.coalesce(F.hash("stratum"), F.lit(0)).alias("s"), "stratum").distinct()
    tests = len(values) * F.greatest(strata.agg(F.count("*")).scalar(), F.lit(1))
    # All steps of a ladder, as most hold no document.
    ladders = counts.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("at")
    )
    above = lambda i: F.aggregate(
        F.map_entries("at"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] > i, e["value"]).otherwise(0)
    )
    tested = (
        ladders.select("stratum", "rule", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(ladder - 1)),
                       lambda i: F.struct(i.alias("i"), above(i).alias("rejected")))).alias("t"))
        .select("stratum", "rule", "t.i", "t.rejected", certified("t.rejected", "n", F.lit(error) / tests).alias("ok"))
    )
    # The strictest cutoff such that it and all more lenient ones are certified.
    lenient = Window.partitionBy("stratum", "rule").orderBy(F.desc("i"))
    walked = tested.withColumn("ok", F.min("ok").over(lenient)).where("ok")
    return walked.groupBy("stratum", "rule").agg((F.min("i") / F.lit(ladder)).alias("cutoff"), F.max("rejected").alias("lost"))


def _with_cutoffs(rows: DataFrame, stratum: Column, cutoffs: DataFrame, out: str) -> DataFrame:
    """Adds the map from rule to cutoff of the row's stratum, without a shuffle of the rows if there are few cutoffs."""
    name = free_name(rows, "stratum")
    entries = F.map_from_entries(F.collect_list(F.struct("rule", "cutoff")))
    by_stratum = cutoffs.groupBy(F.col("stratum").alias(name)).agg(entries.alias(out))
    if cutoffs.count() <= BROADCAST_CUTOFFS:
        by_stratum = F.broadcast(by_stratum)
    rows = rows.withColumn(name + "_row", stratum)
    return rows.join(by_stratum, F.col(name + "_row").eqNullSafe(F.col(name)), "left").drop(name, name + "_row")


def _passes(s: Column, cutoffs: Column) -> Column:
    """Whether no rule with a cutoff rejects."""
    passes = F.lit(True)
    for rule, value in rules(s).items():
        passes &= F.coalesce(value <= F.element_at(cutoffs, rule), F.lit(True))
    return passes


def _cutoffs_from(measured: DataFrame, labels: DataFrame, statistic: str, **limits) -> DataFrame:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    labelled = measured.select("doc_id", "stratum", statistic).join(known, "doc_id")
    return checkpoint(learn_cutoffs(labelled, "stratum", statistic, "good", **limits))


def quality_rules(documents: DataFrame, labels: DataFrame, stratum: str = "lang", **limits) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` per document.

    ``labels`` is ``(doc_id, quality)``. The statistics are written down once, as cutoffs and verdicts both read them.
    """
    measured = checkpoint(documents.select("doc_id", F.col(stratum).alias("stratum"), statistics("text").alias("s")))
    cutoffs = _cutoffs_from(measured, labels, "s", **limits)
    judged = _with_cutoffs(measured, F.col("stratum"), cutoffs, "cutoffs")
    s, failed = F.col("s"), base_failed(F.col("s"))
    shown = [F.col("s")[name].alias(name) for name in STATISTICS if name != "n_lines"]
    kept = ~failed & _passes(s, F.col("cutoffs"))
    return judged.select("doc_id", *shown, failed.alias("base_failed"), kept.alias("kept"))


def filter_documents(documents: DataFrame, labels: DataFrame, stratum: str = "lang", **limits) -> DataFrame:
    """The rows of ``documents`` that ``quality_rules`` keeps, with all their columns and without a shuffle of texts.

    Texts are measured a second time instead of joining them with the verdicts.
    """
    brief = documents.select("doc_id", F.col(stratum).alias("stratum"), statistics("text").alias("s"))
    cutoffs = _cutoffs_from(checkpoint(brief), labels, "s", **limits)
    s, c = free_name(documents, "statistics"), free_name(documents, "cutoffs")
    rows = _with_cutoffs(documents.withColumn(s, statistics("text")), F.col(stratum), cutoffs, c)
    return rows.where(~base_failed(F.col(s)) & _passes(F.col(s), F.col(c))).select(*documents.columns)
