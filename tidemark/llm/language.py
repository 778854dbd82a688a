"""Language identification by cross-parsing with suffix automata.

``train`` builds, from labelled text, the suffix automaton of a bounded sample per language.
``identify`` parses every whole text with each of them: a phrase is the longest match of
the text ahead in the language's sample, and the next phrase starts where it ends. Few
phrases mean that the text is made of the language's own pieces. The count is normalised by
the text's length and the logarithm of the sample's, which makes it an estimate of the
cross entropy; the least one wins, ties go to the smaller name.

Texts are lower-cased UTF-8 bytes in which runs of ASCII characters other than letters count
as one blank. They are parsed in stretches of ``STRETCH`` bytes, thousands of stretches
side by side, each step a table look-up for all of them.

Null text or text without a letter is ``und`` with score 0, as is every text if there is
nothing to learn from. Rows are judged one by one: repeated rows and null ids give a row each.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 96  # per language: the documents whose id hashes lowest
SAMPLE_CHARS = 192  # from each, at a place drawn by its hash
STRETCH = 1024
BATCH_BYTES = 1 << 22
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out() -> Column:
    """Documents that are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


class Automaton:
    """Suffix automaton of one byte string over codes below ``width``, as a flat table.

    ``next[state + code]`` is the state after the code, states being multiples of ``width``;
    -1 where the sample has no such continuation.
    """

    def __init__(self, codes: list[int], width: int) -> None:
        edges, link, length = [{}], [-1], [0]
        last = 0
        for c in codes:
            new = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(edges)
                    edges.append(dict(edges[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = link[p]
            last = new
        table = np.full((len(edges), width), -1, np.int32)
        for state, out in enumerate(edges):
            for c, to in out.items():
                table[state, c] = to * width
        self.next = table.ravel()
        self.first = np.maximum(table[0], 0)  # after a phrase ended; unknown codes stay at the root
        self.bits = float(np.log2(max(len(codes), 2)))

    def phrases(self, steps: np.ndarray, active: list[int]) -> np.ndarray:
        """Phrase ends per column of ``steps``; in row t only the first ``active[t]`` columns count."""
        state = np.zeros(steps.shape[1], np.int32)
        ended = np.zeros(steps.shape[1], np.int32)
        for codes, n in zip(steps, active):
            codes, now = codes[:n], state[:n]
            to = self.next.take(now + codes)
            miss = to < 0
            ended[:n] += miss
            state[:n] = np.where(miss, self.first.take(codes), to)
        return ended


class Model:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str]) -> None:
        """``samples``: language and its text."""
        folded = {lang: _folded(text) for lang, text in sorted(samples.items())}
        used = sorted({b for text in folded.values() for b in text if b >= 128 or chr(b).isalpha()})
        table = bytearray(256)
        self.width = len(used) + 2  # code 0: blank; the last: bytes of no sample
        for b in range(256):
            if b >= 128 or chr(b).isalpha():
                table[b] = self.width - 1
        for i, b in enumerate(used):
            table[b] = i + 1
        self.table = bytes(table)
        self.languages = list(folded)
        self.automata = [Automaton(self.codes([text])[0].tolist(), self.width) for text in folded.values()]

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, one after the other and each ended by a blank, and where each begins."""
        data = np.frombuffer(b"\n".join(texts).translate(self.table) + b"\0", np.uint8)
        keep = np.concatenate([[True], (data[1:] != 0) | (data[:-1] != 0)])
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        kept = np.concatenate([[0], np.cumsum(keep)])
        return data[keep].astype(np.int32), kept[np.minimum(begins, len(data))]

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Bits per code for each text (row) and language (column)."""
        codes, begins = self.codes(texts)
        size = np.diff(begins)
        per_text = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(texts)), per_text)
        first = np.concatenate([[0], np.cumsum(per_text)])
        start = begins[:-1][owner] + (np.arange(len(owner)) - first[owner]) * STRETCH
        length = np.minimum(STRETCH, begins[1:][owner] - start)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        longest = int(length[0]) if len(length) else 0
        steps = codes.take(start[None, :] + np.arange(longest)[:, None], mode="clip")
        active = np.searchsorted(-length, -np.arange(longest), "left").tolist()
        out = np.empty((len(texts), len(self.automata)))
        for k, automaton in enumerate(self.automata):
            ended = automaton.phrases(steps, active)
            total = np.bincount(owner, ended, minlength=len(texts)) + 1
            out[:, k] = total * automaton.bits / np.maximum(size, 1)
        return out


def train(labelled: DataFrame) -> Model | None:
    """A model from (doc_id, text, lang); null texts and languages count for nothing. The driver
    holds SAMPLE_ROWS * SAMPLE_CHARS characters per language."""
    known = labelled.where("text is not null and lang is not null").select("lang", "doc_id", "text")
    draw = F.xxhash64("doc_id")
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")),
                   F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)).cast("long"))
    parts = known.select("lang", "doc_id", draw.alias("draw"), F.substring(
        F.col("text"), place.cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("part"))
    ranked = parts.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy("draw", "doc_id", "part"))).where(F.col("rank") <= SAMPLE_ROWS)
    samples = {r.lang: "\n".join(r.parts) for r in ranked.groupBy("lang").agg(
        F.sort_array(F.collect_list("part")).alias("parts")).collect()}
    return Model(samples) if samples else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. The score is the share by which the
    winner's cost lies below the second's."""
    if model is None:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"),
                           F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # bounded by the sample

    def judged(batches):
        import pyarrow as pa
        import pyarrow.compute

        model = pickle.loads(shared.value)
        for batch in batches:
            column = batch.column("text")
            for a, b in _ranges(pyarrow.compute.binary_length(column).fill_null(0).to_pylist()):
                texts = column.slice(a, b - a).to_pylist()
                sound = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if sound:
                    costs = model.costs([_folded(texts[i]) for i in sound])
                    best = costs.argmin(1)
                    low = np.sort(costs, 1)
                    sure = 1 - low[:, 0] / low[:, 1] if low.shape[1] > 1 else np.ones(len(sound))
                    for i, k, s in zip(sound, best.tolist(), sure.tolist()):
                        lang[i], score[i] = model.languages[k], s
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a),
                     pa.array(lang), pa.array(score, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(judged, "doc_id bigint, held_out boolean, lang_pred string, score double")


def _ranges(lengths: list[int]):
    """Ranges of rows of about BATCH_BYTES bytes."""
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > BATCH_BYTES:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
