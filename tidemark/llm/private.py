"""Personal data: what plain rules find, and what boosted trees add to it.

Base spans follow four patterns, leftmost and without overlap per kind; matches that fail their
check (range, digits, check digit) are dropped and not tried again. So a base rule is blind where two
findings run into one match. Beside them, generous generators propose spans of the four kinds
that may overlap the base and each other: addresses with letters beyond ASCII or spelt with "(at)", numbers in the
groupings of cards and phones, dotted quads inside longer ones. Spark's gradient-boosted trees judge each
candidate by its format (digits, groups, separators, check digit, range) and its context (characters
and hashed words beside it). Thresholds per kind are calibrated on documents that training has not seen: the
lowest score above which the lower confidence bound (Wilson, ``Z``) of the share of true candidates is at least
``PRECISION``, and at least ``LEAST``. A kind without enough examples has no threshold and adds nothing; ``Judge.thresholds`` names
the others. Selected candidates that overlap are joined; those that overlap a base span are not needed.

Without labelled findings, the base labels the candidates: equal to a base span, true; crossing one, apart from all
matches, or equal to a match that failed its check, false; part of a failed match, unknown. The last are
those the trees are asked about: nobody has looked at them yet. ``train(rows, findings)`` takes real labels instead. Trees are fitted on a
bounded draw of ``SAMPLE`` candidates of a kind and label; thresholds and results use all rows.

Everything is column functions: one pass over the texts writes spans and candidates, and no text is
shuffled. Patterns are possessive or bounded, so that their time is linear in the text.

Positions count code points, ends are exclusive. Null text counts as empty and has no spans. Rows that share id
and text share their results, one row each; a null id is an id of its own. Without candidates, labels
or thresholds the base is all there is. An empty table gives no rows; other columns pass through ``redact``
untouched and are not read elsewhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rows import computed_once
from tidemark.session import written

SAMPLE = 20_000
PRECISION, Z = 0.95, 1.645
LEAST = 0.5  # no lower score counts
TREES, DEPTH = 12, 4
BESIDE = 24  # characters of context on either side
WORDS = 12  # buckets of hashed words on either side
BINS = 200  # of scores, for thresholds

# --- fixed values: kinds in their order, patterns of the base rules, bounds of their checks ---
KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
DIGITS = {"card": (14, 19), "phone": (10, 15)}
# --- end of fixed values ---

_PART = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_WORD = r"[\p{L}\p{N}._%+'-]"
_NAME = r"[\p{L}\p{N}-]"
# (kind, pattern, a cheap sign that it can match at all)
GENERATORS = (
    ("email", rf"(?<!{_WORD}){_WORD}++@{_NAME}++(?:\.{_NAME}++)*+", "@"),
    ("email", rf"(?<!{_WORD}){_WORD}++ ?[(\[] ?(?i:at) ?[)\]] ?{_NAME}++"
              rf"(?: ?(?:\.|[(\[] ?(?i:dot) ?[)\]]) ?{_NAME}++)++", r"(?i)[(\[] ?at ?[)\]]"),
    ("ip", r"(?<![0-9])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}(?![0-9])", r"[0-9]\.[0-9]"),
    ("ip", rf"(?<![0-9]){_PART}(?:\.{_PART}){{3}}(?![0-9])", r"[0-9]\.[0-9]"),
    ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){4,7}(?![0-9A-Fa-f:])",
     r"[0-9A-Fa-f]:[0-9A-Fa-f:]"),
    ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])", "[0-9]{13}"),
    ("card", r"(?<![0-9])[0-9]{4}[ .-][0-9]{4,6}[ .-][0-9]{4,5}(?:[ .-][0-9]{1,7})?(?![0-9])",
     "[0-9]{4}[ .-][0-9]{4}"),
    ("phone", r"(?<![0-9+])\+?[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
     r"[0-9][ .()-]{0,2}[0-9]{2}"),
    ("phone", r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])", r"\+[0-9]"),
)

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
_BLOCK = 128


def _sums_before(values: Column) -> Column:
    """For each value the sum of those before it. Blocks are summed first, as growing one array by one value
    at a time would copy it each time."""
    zero = F.lit(0).cast("bigint")

    def running(numbers: Column) -> Column:
        return F.aggregate(numbers, F.array(zero), lambda done, x: F.concat(
            done, F.array(F.element_at(done, -1) + x)))

    starts = F.sequence(F.lit(1), F.size(values), F.lit(_BLOCK))
    inner = F.transform(starts, lambda a: running(F.slice(values, a, F.lit(_BLOCK))))
    totals = running(F.transform(inner, lambda block: F.element_at(block, -1)))
    whole = F.zip_with(inner, F.slice(totals, F.lit(1), F.size(inner)), lambda block, before: F.transform(
        F.slice(block, F.lit(1), F.size(block) - 1), lambda x: x + before))
    return F.when(F.size(values) > 0, F.flatten(whole)).otherwise(F.array().cast("array<bigint>"))


def _matches(text: Column, pattern: str, sign: str | None = None) -> Column:
    """All matches as (start, end, body), leftmost and without overlap."""
    kind = "array<struct<start:bigint,end:bigint,body:string>>"
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    apart = F.split(text, pattern, -1)
    widths = F.zip_with(F.slice(apart, F.lit(1), F.size(bodies)), bodies,
                        lambda gap, body: (F.length(gap) + F.length(body)).cast("bigint"))
    gaps = F.transform(F.slice(apart, F.lit(1), F.size(bodies)), lambda gap: F.length(gap).cast("bigint"))
    starts = F.zip_with(_sums_before(widths), gaps, lambda before, gap: before + gap)
    found = F.zip_with(starts, bodies, lambda start, body: F.struct(
        start.alias("start"), (start + F.length(body)).alias("end"), body.alias("body")))
    can = F.rlike(text, F.lit(sign)) if sign else F.lit(True)
    return F.when(can, found.cast(kind)).otherwise(F.array().cast(kind))


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _passes(kind: str, body: Column) -> Column:
    """The check of a base rule, of a match of its pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.rlike(body, F.lit(rf"^0*{_PART}(?:\.0*{_PART}){{3}}$"))
    low, high = DIGITS[kind]
    fits = F.length(_digits(body)).between(low, high)
    return fits & F.call_function("luhn_check", _digits(body)) if kind == "card" else fits


_SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}


def _key() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")))


def searched(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` without its text: doc_id, key, base spans, matches that base rules
    dropped, and candidates. Only rows with a sign of a kind run its patterns.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    tried = F.struct(*[_matches(text, BASE[k], _SIGNS[k]).alias(k) for k in KINDS],
                     *[_matches(text, pattern, sign).alias(f"g{i}")
                       for i, (_, pattern, sign) in enumerate(GENERATORS)])
    met = computed_once(rows.withColumn("key", _key()), tried, "doc_id", "key", "text")

    def matched(kind: str, passing: bool) -> Column:
        return F.transform(F.filter(F.col(kind), lambda m: _passes(kind, m["body"]) == passing), lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))).cast(_SPAN)

    def proposed(i: int, kind: str) -> Column:
        return F.transform(F.col(f"g{i}"), lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"),
            F.substring(text, F.greatest(m["start"] - BESIDE + 1, F.lit(1)).cast("int"),
                        F.least(m["start"], F.lit(BESIDE)).cast("int")).alias("before"),
            m["body"].alias("body"),
            F.substring(text, (m["end"] + 1).cast("int"), F.lit(BESIDE)).alias("after")))

    found = F.struct(
        F.sort_array(F.flatten(F.array(*[matched(k, True) for k in KINDS]))).alias("base"),
        F.flatten(F.array(*[matched(k, False) for k in KINDS])).alias("dropped"),
        F.array_distinct(F.flatten(F.array(*[proposed(i, g[0]) for i, g in enumerate(GENERATORS)]))).alias("candidates"))
    return computed_once(met, found, "doc_id", "key")


def _overlapping(spans: str, kind_too: bool) -> Column:
    """Spans of the array column that meet the candidate of the row."""
    def meets(s: Column) -> Column:
        over = (s["start"] < F.col("end")) & (s["end"] > F.col("start"))
        return over & (s["kind"] == F.col("kind")) if kind_too else over

    return F.filter(F.col(spans), meets)


def candidates(rows: DataFrame) -> DataFrame:
    """Distinct candidates of the searched rows, with the label that the base gives them (null: unknown)
    and ``needed``, false where a base span covers a part already."""
    one = rows.where(F.size("candidates") > 0).dropDuplicates(["key"]).select(
        "doc_id", "key", "base", "dropped", F.explode("candidates").alias("c")).select(
        "doc_id", "key", "base", "dropped", "c.*")
    equal = lambda s: (s["start"] == F.col("start")) & (s["end"] == F.col("end"))
    met = computed_once(one, F.struct(
        _overlapping("base", True).alias("own"), _overlapping("dropped", True).alias("failed"),
        (F.size(_overlapping("base", False)) == 0).alias("needed")),
        "doc_id", "key", "kind", "start", "end", "before", "body", "after")
    label = (
        F.when(F.size("own") > 0, F.exists("own", equal))
        .when(F.size("failed") == 0, False)
        .when(F.exists("failed", equal), False))
    return met.withColumn("label", label.cast("double")).drop("own", "failed")


def _word_bucket(words: Column, side: str) -> list[Column]:
    bucket = F.pmod(F.xxhash64(F.lower(words)), F.lit(WORDS))
    return [F.when((words != "") & (bucket == i), 1.0).otherwise(0.0).alias(f"{side}_word_{i}") for i in range(WORDS)]


def _features() -> list[Column]:
    """Numbers that speak of a candidate's format and of its context."""
    body, digits = F.col("body"), _digits(F.col("body"))
    groups = F.transform(F.regexp_extract_all(body, F.lit("[0-9]+"), F.lit(0)), F.length)
    parts = F.split(body, r"\.")
    host = F.substring_index(body, "@", -1)

    def count(pattern: str) -> Column:
        return F.length(body) - F.length(F.regexp_replace(body, pattern, ""))

    def side(name: str, sign: Column) -> list[Column]:
        return [F.rlike(sign, F.lit(p)).alias(f"{name}_{kind}") for kind, p in (
            ("digit", "[0-9]"), ("letter", r"\p{L}"), ("blank", r"\s"), ("stop", "[.,;:!?]"),
            ("sign", r"[^\p{L}0-9\s.,;:!?]"))] + [(sign == "").alias(f"{name}_none")]

    format_ = [
        F.length(body).alias("length"), F.length(digits).alias("digits"), F.size(groups).alias("groups"),
        F.coalesce(F.array_max(groups), F.lit(0)).alias("longest_group"),
        F.coalesce(F.try_element_at(groups, F.lit(1)), F.lit(0)).alias("first_group"),
        F.coalesce(F.try_element_at(groups, F.lit(-1)), F.lit(0)).alias("last_group"),
        count(r"\p{L}").alias("letters"), count(r"[^\x00-\x7F]").alias("beyond_ascii"), count(" ").alias("blanks"),
        count(r"\.").alias("dots"), count("-").alias("hyphens"), count(r"[()\[\]]").alias("brackets"),
        count("@").alias("at_signs"), count(":").alias("colons"), body.startswith("+").alias("plus"),
        F.coalesce(F.try_to_number(F.substring(digits, 1, 1), F.lit("9")).cast("double"), F.lit(-1.0)).alias("first_digit"),
        F.size(F.array_distinct(F.split(digits, ""))).alias("different_digits"),
        (F.length(digits).between(1, 30) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))).alias("check_digit"),
        F.forall(parts, lambda p: F.rlike(p, F.lit(rf"^{_PART}$"))).alias("in_range"),
        F.size(F.split(host, r"\.")).alias("host_names"),
        F.length(F.substring_index(host, ".", -1)).alias("last_name"),
    ]
    context = [
        *side("before", F.substring(F.col("before"), -1, 1)), *side("after", F.substring(F.col("after"), 1, 1)),
        F.rlike("before", F.lit(r"[:=]\s*$")).alias("assigned"),
        *_word_bucket(F.regexp_extract("before", r"(\p{L}+)[^\p{L}]*$", 1), "before"),
        *_word_bucket(F.regexp_extract("after", r"^[^\p{L}]*(\p{L}+)", 1), "after"),
    ]
    kinds = [(F.col("kind") == i).alias(f"is_{k}") for i, k in enumerate(KINDS)]
    return kinds + format_ + context


def _vectors(rows: DataFrame) -> DataFrame:
    columns = _features()
    plain = rows.select("doc_id", "key", "kind", "start", "end", "body", "label", "needed", *[c.cast("double") for c in columns])
    names = plain.columns[8:]
    return VectorAssembler(inputCols=names, outputCol="features").transform(plain).drop(*names)


@dataclass
class Judge:
    """Boosted trees and the least score per kind that counts; without trees nothing is added."""

    trees: Model | None = None
    thresholds: dict[str, float] = field(default_factory=dict)


def _bound(true: int, of: int) -> float:
    """Lower bound of a share, by Wilson."""
    if not of:
        return 0.0
    share, z2 = true / of, Z * Z
    return (share + z2 / (2 * of) - Z * math.sqrt(share * (1 - share) / of + z2 / (4 * of * of))) / (1 + z2 / of)


def _scored(rows: DataFrame, trees: Model) -> DataFrame:
    return trees.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def train(rows: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE) -> Judge:
    """Trees from half of the documents, thresholds from the other half. ``rows`` are the candidates;
    ``findings`` (doc_id, kind by name, start, end, label) replaces the labels of the base."""
    if findings is not None:
        number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
        told = findings.select(F.col("doc_id").alias("told_id"), number.cast("int").alias("told_kind"), F.col("start").alias("told_start"),
                               F.col("end").alias("told_end"), F.col("label").cast("double").alias("told"))
        rows = rows.join(told, F.col("doc_id").eqNullSafe(F.col("told_id")) & (F.col("kind") == F.col("told_kind"))
                         & (F.col("start") == F.col("told_start")) & (F.col("end") == F.col("told_end"))).withColumn(
            "label", F.col("told")).drop("told", "told_id", "told_kind", "told_start", "told_end")
    known = _vectors(rows.where(F.col("label").isNotNull()))
    fitting = F.substring("key", 1, 1) < "8"
    counts = {(r.kind, r.label): r["count"] for r in known.where(fitting).groupBy("kind", "label").count().collect()}
    if len({label for _, label in counts}) < 2:
        return Judge()
    draw = F.pmod(F.xxhash64("key", "start", "end"), F.lit(1_000_000))
    taken = F.lit(False)
    for (kind, label), n in sorted(counts.items()):
        share = min(1_000_000, sample * 1_000_000 // n)
        taken = taken | ((F.col("kind") == kind) & (F.col("label") == label) & (draw < share))
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, featuresCol="features", labelCol="label")
    trees = learner.fit(written(known.where(fitting & taken).drop("before", "after"), "labelled"))
    held = _scored(known.where(~fitting), trees)
    bins = held.groupBy("kind", F.floor(F.col("score") * BINS).alias("bin")).agg(
        F.sum("label").alias("true"), F.count("*").alias("all")).collect()  # kinds x bins at most
    thresholds = {}
    for i, kind in enumerate(KINDS):
        true = total = 0
        for r in sorted((r for r in bins if r.kind == i), key=lambda r: -r.bin):
            true, total = true + int(r.true), total + r["all"]
            if r.bin >= LEAST * BINS and _bound(true, total) >= PRECISION:
                thresholds[kind] = r.bin / BINS
    return Judge(trees, thresholds)


def _added(rows: DataFrame, judge: Judge) -> DataFrame:
    """Spans that the trees add, joined where they overlap: key, start, kind, end, score."""
    wanted = F.lit(False)
    for kind, least in judge.thresholds.items():
        wanted = wanted | ((F.col("kind") == KINDS.index(kind)) & (F.col("score") >= least))
    chosen = _scored(_vectors(rows.where("needed")), judge.trees).where(wanted)
    order = Window.partitionBy("key").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))
    ran = chosen.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by("kind", F.struct("score", F.col("end") - F.col("start"), -F.col("kind")))
    return ran.groupBy("key", "run").agg(
        F.min("start").alias("start"), best.alias("kind"), F.max("end").alias("end"), F.max("score").alias("score"))


def find(rows: DataFrame, judge: Judge, found: DataFrame | None = None) -> DataFrame:
    """``rows`` (searched) with all their spans: doc_id, key, base, spans, both in order. ``found`` are their
    candidates, if at hand."""
    if judge.trees is None or not judge.thresholds:
        return rows.select("doc_id", "key", "base", F.col("base").alias("spans"))
    added = _added(candidates(rows) if found is None else found, judge).groupBy("key").agg(
        F.collect_list(F.struct("start", "kind", "end")).cast(_SPAN).alias("more"))
    both = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))
    return rows.join(added, "key", "left").select("doc_id", "key", "base", both.alias("spans"))


def named(spans: str) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.col(spans), lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, key, base and all spans, by trees trained on ``docs``."""
    rows = written(searched(docs), "searched")
    proposed = written(candidates(rows), "candidates")
    return find(rows, train(proposed), proposed)


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans per kind, the hash of their list, and the list of all spans."""
    def count(kind: int) -> Column:  # a second parameter of the lambda would be the span's place in the array
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(named("base"), 256).alias("base_sha256"), named("spans").alias("spans"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, by the
    kind of the first. Texts meet their spans by key, and only texts with spans change."""
    listed = found.where(F.size("spans") > 0).dropDuplicates(["key"]).select(
        F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    joined = F.aggregate("__spans", F.array().cast(_SPAN), lambda done, s: F.when(
        (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > s["start"]),
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
            F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.try_element_at(done, F.lit(-1))["kind"].alias("kind"),
            F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end")))).cast(_SPAN)
    ).otherwise(F.concat(done, F.array(s)).cast(_SPAN)))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    with_spans = docs.withColumn("__key", _key()).join(listed, "__key", "left").withColumn(
        "__spans", F.when(F.col("__spans").isNotNull(), joined))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("__spans", lambda s: s["end"]))
    pieces = F.transform("__spans", lambda s, i: F.concat(
        F.substring(F.col("text"), (F.get(ends, i) + 1).cast("int"), (s["start"] - F.get(ends, i)).cast("int")),
        F.get(kinds, s["kind"])))
    tail = F.substring(F.col("text"), (F.element_at(ends, -1) + 1).cast("int"), F.length("text"))
    masked = F.when(F.col("__spans").isNotNull(), F.concat(F.concat_ws("", pieces), tail)).otherwise(F.col("text"))
    return with_spans.withColumn("text", masked).select(*docs.columns)
