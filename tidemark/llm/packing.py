"""Order-preserving packing of token ids into windows by dynamic programming.

Documents stay in the order in which Spark reads them. Their tokens, each document ended by
id 0, form a stream that is cut into windows of at most ``length`` tokens. A window is padded
to ``length`` unless its length is a power of two. The cuts minimise the padding plus a
penalty per cut: none after a document, ``SENTENCE`` inside a document after a sentence or
line, ``HARD`` elsewhere (at every ``GRID``-th token, so that long sentences can be cut).

With f the least cost up to a cut at p, a padded window from q costs f(q) + length - (p - q),
so the best q has the least f(q) + q among the cuts at most ``length`` back: the head of a
monotone queue, which each cut enters and leaves once. A window of ``EXACT`` tokens needs no
padding; for it, the one cut at that distance is looked at.

Each task packs its own rows in blocks of ``BLOCK`` tokens, without a shuffle; what a block
loses is part of its last window. Null or empty text is a document of the end token alone.
Repeated rows and ids are documents of their own; null ids stay null. An empty table gives
no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import Encoder, token_blocks

LENGTH = 1024
SENTENCE = 4
HARD = 28
GRID = 256
BLOCK = 1 << 19
EXACT = 512  # the power of two that is tried as an exact length
CELL = 1  # grain of sentence ends in tokens: each can be a cut


def cuts(ends: np.ndarray, sentences: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Where to cut a stream: positions from 0 to its end. ``ends``: after each document;
    ``sentences``: after each sentence."""
    total = int(ends[-1])
    at = np.unique(np.concatenate([[0], ends, sentences, np.arange(0, total, GRID)]))
    price = np.full(len(at), HARD)
    price[np.searchsorted(at, sentences)] = SENTENCE
    price[np.searchsorted(at, ends)] = 0
    exact = np.searchsorted(at, at - EXACT)
    exact = np.where(at[exact] == at - EXACT, exact, -1).tolist()
    at, price = at.tolist(), price.tolist()
    n = len(at)
    best, back, worth = [0] * n, [0] * n, [0] * n  # worth: best + position
    queue, head = [0], 0
    for j in range(1, n):
        here = at[j]
        while at[queue[head]] < here - length:
            head += 1
        i = queue[head]
        cost = worth[i] + length - here
        k = exact[j]
        if k >= 0 and best[k] < cost:
            cost, i = best[k], k
        cost += price[j]
        best[j], back[j] = cost, i
        worth[j] = cost = cost + here
        while len(queue) > head and worth[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return np.array([at[i] for i in reversed(out)])


def pack(docs: DataFrame, length: int = LENGTH, ids: bool = False, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``ids`` the token ids, little-endian 32-bit."""
    schema = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint" + (", ids binary" if ids else ""))

    def packed(batches):
        import pyarrow as pa

        encoder = Encoder(vocabulary)
        stops = encoder.sentence_ends()
        number = 0
        for stream, begins, columns in token_blocks(batches, encoder, BLOCK, ["doc_id", "part"]):
            sentences = np.flatnonzero(stops[stream]) + 1
            at = cuts(begins[1:], sentences, length)
            pieces = np.union1d(at, begins)
            first, last = pieces[:-1], pieces[1:]
            doc = np.searchsorted(begins, first, "right") - 1
            window = np.searchsorted(at, first, "right") - 1
            data = stream.astype("<u4", copy=False)
            base = (columns["part"][0] << 33) + number
            number += len(at) - 1
            out = {
                "doc_id": pa.array(columns["doc_id"], pa.int64()).take(pa.array(doc)),
                "start": first - begins[doc], "length": last - first,
                "ids_crc32": [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), last.tolist())],
                "doc_tokens": np.diff(begins)[doc],
                "sequence_id": base + window, "offset": first - at[window]}
            if ids:
                out["ids"] = [data[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist())]
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.spark_partition_id().cast("long").alias("part"))
    return rows.mapInArrow(packed, schema)
