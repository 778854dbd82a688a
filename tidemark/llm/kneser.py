"""A quality classifier: character n-grams under interpolated modified Kneser-Ney smoothing.

Training counts every 4-gram of the trusted texts; lower orders count distinct continuations.
Each order has three discounts, for counts of one, two and more, from its own counts of counts.

Scoring never holds the model in one place. Texts are gathered into compressed blocks; each
block lists its distinct n-grams; the distinct ones of all blocks meet the count tables of
every order in joins on the n-gram, its suffixes and its contexts; log probabilities go back
to the blocks that asked. So only distinct n-grams per block travel, not every position.

A document's perplexity is that of its characters and an end mark. What counts is its mean log loss
less ``SLACK`` standard errors of that mean, so that short texts are neither judged by chance nor
set the limit. Per language, the limit is the ``QUANTILE`` of that among documents labelled good,
toxic ones included: the model does not learn their words, but they are no junk. A document is
rejected if it is above the limit by more than ``MARGIN``. Where a language has no good documents,
the highest limit counts.

Null or empty text has only the end mark and is kept. Rows are judged one by one; repeated rows
and null ids give a row each. Labels that contradict each other count for nothing. Without
trusted text every document is kept, with null perplexity. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import gather, opened
from tidemark.session import written

ORDER = 4
QUANTILE = 0.995
MARGIN = 0.05  # nats a character
SLACK = 3.0
BLOCK_CHARS = 1 << 23  # of text in a block
CHUNK_CHARS = 1 << 19  # looked at together
BROADCAST_IDS = 2_000_000  # good ids of eight bytes; beyond it the planner joins by shuffle
START, END = "\u0002", "\u0003"


def _grams(texts: list[str]):
    """For chunks of whole texts: the n-grams of all positions as numbers into a list of
    distinct n-grams, that list, and where each text's positions begin."""
    import pandas as pd

    start = size = 0
    bounds = []
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_CHARS:
            bounds.append((start, i))
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        bounds.append((start, len(texts)))
    pad = START * (ORDER - 1)
    for a, b in bounds:
        joined = "".join(f"{pad}{t}{END}" for t in texts[a:b])
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        used = np.flatnonzero(np.bincount(points))
        if len(used) > 1 << 16:  # no text has that many characters; keep the numbers exact all the same
            names, codes = None, points.astype(object)
            key = sum(codes[k:len(codes) - ORDER + 1 + k] << (21 * (ORDER - 1 - k)) for k in range(ORDER))
            number, distinct = pd.factorize(key)
            grams = ["".join(chr(int(x) >> (21 * (ORDER - 1 - k)) & 0x1FFFFF) for k in range(ORDER)) for x in distinct]
        else:
            names = np.zeros(int(points.max()) + 1, np.uint64)
            names[used] = np.arange(len(used), dtype=np.uint64)
            codes = names[points]
            key = codes[:len(codes) - ORDER + 1].copy()
            for k in range(1, ORDER):
                key = (key << np.uint64(16)) | codes[k:len(codes) - ORDER + 1 + k]
            number, distinct = pd.factorize(key)
            parts = np.stack([used[(distinct >> np.uint64(16 * (ORDER - 1 - k))).astype(np.uint64) & np.uint64(0xFFFF)]
                              for k in range(ORDER)], axis=1).astype(np.uint32)
            flat = parts.tobytes().decode("utf-32-le")
            grams = [flat[i:i + ORDER] for i in range(0, len(flat), ORDER)]
        length = np.array([len(t) + ORDER for t in texts[a:b]])
        begins = np.concatenate([[0], np.cumsum(length)])
        yield a, number, grams, begins


def _counts(texts: DataFrame) -> DataFrame:
    """(gram, n): how often each n-gram occurs in ``texts`` (text)."""

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            total: dict[str, int] = {}
            for _, number, grams, begins in _grams([t or "" for t in batch.column("text").to_pylist()]):
                inside = np.ones(len(number), bool)  # positions that straddle two texts are none
                for k in range(1, ORDER):
                    at = begins[1:-1] - k
                    inside[at] = False
                n = np.bincount(number[inside], minlength=len(grams))
                for gram, c in zip(grams, n.tolist()):
                    if c:
                        total[gram] = total.get(gram, 0) + c
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    return texts.select("text").mapInArrow(counted, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of an order for counts of one, two and three or more."""
    row = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] or 0 for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    ratio = (2 * n2 / n1, 3 * n3 / n2, 4 * n4 / n3 if n3 else 0.0)
    return [min(max(k - y * r, 0.05 * k), float(k)) for k, r in zip((1, 2, 3), ratio)]


def _discount(count: Column, d: list[float]) -> Column:
    return F.when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


def train(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame, list[float]]]:
    """For each order from 1 on: counts (gram, n), contexts (gram, total, back) and discounts.

    ``back`` is the weight of the lower order after the context.
    """
    tables = [written(_counts(trusted), "grams")]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.substring("gram", -order, order).alias("gram")
        tables.append(written(tables[-1].groupBy(suffix).agg(F.count("*").alias("n")), "grams"))
    model = []
    for order, counts in enumerate(reversed(tables), 1):
        d = _discounts(counts)
        context = F.substring("gram", 1, order - 1).alias("gram")
        sums = counts.groupBy(context).agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d)).alias("cut"))
        model.append((counts, written(
            sums.select("gram", "total", (F.col("cut") / F.col("total")).alias("back")), "contexts"), d))
    return model


def log_probabilities(grams: DataFrame, model) -> DataFrame:
    """(gram, log_p) of the last character of each of ``grams`` after the others."""
    letters = model[0][0].count() + 1  # one for all unseen
    out = grams.withColumn("p", F.lit(1.0 / letters))
    for order, (counts, contexts, d) in enumerate(model, 1):
        out = out.withColumn("own", F.substring("gram", -order, order)).withColumn(
            "after", F.expr(f"substring(gram, {ORDER - order + 1}, {order - 1})"))
        out = (
            out.join(counts.select(F.col("gram").alias("own"), "n"), "own", "left")
            .join(contexts.select(F.col("gram").alias("after"), "total", "back"), "after", "left"))
        seen = F.when(F.col("n").isNotNull(), (F.col("n") - _discount(F.col("n"), d)) / F.col("total")).otherwise(0.0)
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise(seen + F.col("back") * F.col("p"))
        out = out.select("gram", p.alias("p"))
    return out.select("gram", F.log("p").alias("log_p"))


def _asked(blocks: DataFrame) -> DataFrame:
    """(block, gram): the distinct n-grams of each block."""

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                texts = [t or "" for t in opened(data.as_py()).column("text").to_pylist()]
                found: set[str] = set()
                for _, _, grams, _ in _grams(texts):
                    found.update(grams)
                grams = sorted(found)
                for a in range(0, len(grams), 50_000):
                    part = grams[a:a + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * len(part), pa.int64()), pa.array(part, pa.string())], names=["block", "gram"])

    return blocks.mapInArrow(listed, "block bigint, gram string")


def score(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, tie (hash of the text), n (characters and end), loss (mean, nats) and
    deviation (of a character's loss) of every row of ``docs``, by a model of ``trusted`` (text)."""
    model = train(trusted)
    if model[0][0].isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("tie"),
                           (F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long").alias("n"),
                           F.lit(None).cast("double").alias("loss"), F.lit(None).cast("double").alias("deviation"))
    # Both exchanges are read twice in one plan, so texts and n-grams move once.
    parts = max(1, math.ceil((docs.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("tie"), "text")
    blocks = gather(rows, BLOCK_CHARS).repartition(parts, "block")
    asked = _asked(blocks).repartition("gram")
    known = log_probabilities(asked.select("gram").distinct(), model)
    answers = asked.join(known, "gram").select("block", "gram", "log_p")

    def scored(left, right):
        import pyarrow as pa

        answers = dict(zip(right.column("gram").to_pylist(), right.column("log_p").to_pylist()))
        parts = []
        for data in left.column("data"):
            table = opened(data.as_py())
            texts = [t or "" for t in table.column("text").to_pylist()]
            mean, deviation = np.empty(len(texts)), np.empty(len(texts))
            for first, number, grams, begins in _grams(texts):
                loss = -np.fromiter(map(answers.__getitem__, grams), float, len(grams))[number]
                loss = np.concatenate([loss, np.zeros(ORDER - 1)])
                n = np.diff(begins) - ORDER + 1
                # The last positions of a text reach into the next one and are left out.
                ends = begins[1:] - ORDER + 1
                bounds = np.stack([begins[:-1], ends], axis=1).ravel()
                total = np.add.reduceat(loss, bounds)[0::2] / n
                square = np.add.reduceat(loss * loss, bounds)[0::2] / n
                mean[first:first + len(n)] = total
                deviation[first:first + len(n)] = np.sqrt(np.maximum(square - total * total, 0))
            sizes = [len(t) + 1 for t in texts]
            parts.append(pa.table({
                "doc_id": table.column("doc_id"), "lang": table.column("lang"), "tie": table.column("tie"),
                "n": pa.array(sizes, pa.int64()), "loss": mean, "deviation": deviation}))
        return pa.concat_tables(parts)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        scored, "doc_id bigint, lang string, tie bigint, n bigint, loss double, deviation double")


def good_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, trusted) of documents that every label calls good; trusted if none calls them toxic."""
    return labels.groupBy("doc_id").agg(
        F.min("quality").alias("good"), F.max("quality").alias("high"), F.max("toxic").alias("toxic")).where(
        "doc_id is not null and good = 1 and high = 1").selectExpr("doc_id", "coalesce(toxic, 0) = 0 as trusted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, tie, n, perplexity, limit (of the loss less its slack, as a perplexity) and kept of every row of ``docs``
    (doc_id, text, lang), with ``labels`` (doc_id, quality, toxic)."""
    ids = written(good_ids(labels), "good")
    narrow = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.where("text is not null").select("doc_id", "text").join(narrow, "doc_id").where("trusted")
    rows = written(score(docs, texts.select("doc_id", "text")), "scores")
    sure = F.col("loss") - SLACK * F.col("deviation") / F.sqrt(F.col("n"))
    limits = rows.where("n > 1").join(narrow, "doc_id").groupBy(F.col("lang").alias("of")).agg(
        F.percentile_approx(sure, QUANTILE, 100_000).alias("limit"))
    limits = written(limits, "limits")
    highest = limits.agg(F.max("limit")).first()[0]
    out = rows.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left")
    limit = F.coalesce("limit", F.lit(highest))
    over = sure > limit + MARGIN
    return out.select("doc_id", "lang", "tie", "n", F.exp("loss").alias("perplexity"), F.exp(limit).alias("limit"),
                      (~F.coalesce(over, F.lit(False)) | (F.col("n") <= 1)).alias("kept"))
