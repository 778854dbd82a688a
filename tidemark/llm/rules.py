"""Quality rules whose cutoffs carry a guarantee against rejecting good text (built-in functions only).

``measure`` counts per document, ``calibrate`` chooses cutoffs, ``judge`` applies them.

A rule rejects a document whose value is above the rule's cutoff. Labelled documents are
halved by a hash of their id. One half proposes a path of sets of cutoffs per stratum (language):
at each step of ``LEVELS`` a rule's cutoff is a quantile of good documents, the one that separates the
half best among those up to that step; a rule that separates nothing has none. The other half tests
the sets as a whole, the most lenient first: with n good documents of which k are rejected by any
rule, a set is certified if a binomial count with rate ``risk`` would be k or less with a
probability of at most ``doubt / strata``. That is the exact upper confidence bound for the rate of
false rejection by all rules together; dividing by the strata makes the bounds of all of them
hold together. Testing stops at the first set that fails, so the number of sets needs no further
correction, and the last certified one is in force. With risk and doubt 0.05 and five strata this takes
90 good documents in the testing half. A stratum with fewer, or with none, has no cutoff: only
the base rule applies, and ``judge`` says so in ``certified``.

Null or empty text has no words and fails the base rule. Rows are judged one by one, so
repeated rows and null or repeated ids give a row each. Labels that contradict each other
or are null count for nothing. A null language is a stratum of its own.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

SPACES = " \t\n\x0b\f\r"
_SPACE = r"[\x20\x09-\x0D]"
_NOT_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 5
LEVELS = (0.9999, 0.999, 0.998, 0.995, 0.99, 0.98)  # of good documents, lenient first
GOOD_COST = 10.0  # a good document rejected weighs as much as so many bad ones caught


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda total, x: total + x)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every document of ``docs``.

    Words that lie in a repeated window of five words are found by sorting the hashes of the
    document's windows, and only where hashing has seen a repeat.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_NOT_SPACE))
    out = docs.select(
        "doc_id", "lang",
        F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, _SPACE + "+")).alias("words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[!?=]")).cast("long").alias("n_marks"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.when(F.contains(text, F.lit("\n")), lines).otherwise(F.array().cast("array<string>"))
        .alias("lines"))
    counts = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    counts_more = ["n_marks", "n_upper"]
    n_words = F.size("words").cast("long")
    at = lambda i, k: F.get("words", i + F.lit(k))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    out = out.select(
        "doc_id", "lang", n_words.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        *counts_more,
        F.when(F.size("words") >= WINDOW, windows)
        .otherwise(F.array().cast("array<bigint>")).alias("windows"))
    keyed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.select(
        *counts, *counts_more,
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), keyed)
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("keyed"))
    beside = lambda r, k: F.get("keyed", r + F.lit(k))["h"]
    found = F.filter(
        "keyed", lambda x, r: x["h"].eqNullSafe(beside(r, -1)) | x["h"].eqNullSafe(beside(r, 1)))
    out = out.select(*counts, *counts_more,
                     F.sort_array(F.transform(found, lambda x: x["i"])).alias("found"))
    covered = F.transform("found", lambda i, r: F.least(
        F.lit(WINDOW), F.coalesce(F.get("found", r + F.lit(1)) - i, F.lit(WINDOW))).cast("long"))
    return out.select(*counts, _total(covered).alias("n_repeat_words"), *counts_more)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _ratio(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


RULES = {
    "symbols": ("n_symbols", "n_words"),
    "marks": ("n_marks", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
}


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(count <= k) for n draws with ``rate``; 1 where k is above the mean, which no test needs."""
    odds, start = math.log(rate) - math.log1p(-rate), math.log1p(-rate)
    zero = F.struct((n * F.lit(start)).alias("log"), F.lit(0.0).alias("sum"))
    summed = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k), zero,
        lambda a, i: F.struct(
            (a["log"] + F.log((n - i).cast("double") / (i + 1)) + F.lit(odds)).alias("log"),
            (a["sum"] + F.exp(a["log"])).alias("sum")),
        lambda a: a["sum"])
    return F.when((k < n * F.lit(rate)) & (k < n), summed).otherwise(1.0)


def proposing_half(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.concat(F.lit("half:"), F.col(doc_id).cast("string"))) % 2 == 0


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = 0.05,
              doubt: float = 0.05) -> DataFrame:
    """One row per cutoff in force: lang, rule, cutoff, and of the stratum's certified set n, k and tail.

    ``labels``: doc_id and quality, 1 good and 0 bad.
    """
    verdicts = labels.where("quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("low"), F.max("quality").alias("high"))
    verdicts = verdicts.where("low = high").select("doc_id", (F.col("low") == 1).alias("good"))
    known = written(
        measured.where(~base_failed()).join(verdicts, "doc_id")
        .select("lang", "good", proposing_half().alias("proposing"),
                *[_ratio(*counts).alias(rule) for rule, counts in RULES.items()]), "labelled")
    path = _proposed(known.where("proposing"))
    good = known.where("good and not proposing")
    over = reduce(Column.__or__, [F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES])
    tested = written(
        path.join(good, F.col("stratum").eqNullSafe(F.col("lang")), "left")
        .groupBy("stratum", "step").agg(
            F.count("good").alias("n"), F.count_if(over & F.col("good")).alias("k"),
            *[F.first(f"cut_{r}").alias(f"cut_{r}") for r in RULES]), "tested-cutoffs")
    strata = max(tested.select("stratum").distinct().count(), 1)
    tested = tested.withColumn("tail", binomial_tail(F.col("k"), F.col("n"), risk))
    passes = (F.col("n") > 0) & (F.col("tail") <= F.lit(doubt / strata))
    sound = F.min(passes).over(Window.partitionBy("stratum").orderBy("step"))
    cuts = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"cut_{r}").alias("cutoff")) for r in RULES])
    return (
        tested.withColumn("sound", sound).where("sound").groupBy("stratum")
        .agg(F.max_by(F.struct("n", "k", "tail", cuts.alias("cuts")), "step").alias("set"))
        .select(F.col("stratum").alias("lang"), F.explode("set.cuts").alias("cut"), "set.n", "set.k", "set.tail")
        .where("cut.cutoff is not null").select("lang", "cut.rule", "cut.cutoff", "n", "k", "tail"))


def _proposed(half: DataFrame) -> DataFrame:
    """stratum, step and the cutoffs ``cut_<rule>`` of that step's set, from the proposing half."""
    values = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])
    rows = half.select("lang", "good", F.explode(values).alias("v")).select("lang", "good", "v.*")
    quantiles = F.percentile_approx(F.when(F.col("good"), F.col("value")), list(LEVELS), 100_000)
    steps = (
        rows.groupBy("lang", "rule").agg(quantiles.alias("cutoffs")).where("cutoffs is not null")
        .select(F.col("lang").alias("stratum"), F.col("rule").alias("of"), F.posexplode("cutoffs").alias("step", "cutoff")))
    above = F.col("value") > F.col("cutoff")
    share = lambda who: F.count_if(who & above) / F.greatest(F.count_if(who), F.lit(1))
    gains = (
        rows.join(steps, F.col("lang").eqNullSafe(F.col("stratum")) & (F.col("rule") == F.col("of")))
        .groupBy("stratum", "of", "step", "cutoff")
        .agg((share(~F.col("good")) - GOOD_COST * share(F.col("good"))).alias("gain")))
    best = F.max(F.struct("gain", (-F.col("step")).alias("lenient"), "cutoff")).over(
        Window.partitionBy("stratum", "of").orderBy("step"))
    sets = gains.withColumn("best", best).withColumn("chosen", F.when(F.col("best.gain") > 0, F.col("best.cutoff")))
    return sets.groupBy("stratum", "step").agg(*[
        F.max(F.when(F.col("of") == r, F.col("chosen"))).alias(f"cut_{r}") for r in RULES])


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with base_failed, rules_failed (names), certified (whether cutoffs are in force for
    the document's language) and kept."""
    columns = [F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]
    limits = cutoffs.groupBy(F.col("lang").alias("stratum")).agg(F.lit(True).alias("found"), *columns)
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    failed = F.filter(F.array(*[
        F.when(_ratio(*c) > F.col(f"cut_{r}"), F.lit(r)) for r, c in RULES.items()]), F.isnotnull)
    return (
        joined.withColumn("base_failed", base_failed()).withColumn("rules_failed", failed)
        .withColumn("certified", F.coalesce("found", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rules_failed") == 0))
        .drop("stratum", "found", *[f"cut_{r}" for r in RULES]))
