"""Best-fit-decreasing packing of token ids into rows of a matrix, written as binary.

Documents, each ended by id 0, that are longer than a row give full rows first; what is left
of them and all others are placed by falling length into the fullest row that still holds
them. Free capacities live in a segment tree with a leaf per capacity, so the search costs
the logarithm of the row length, however many rows are open. Nothing is cut off: the pieces
of a document are its ids without gap.

Each task packs its own rows of the table in blocks of ``BLOCK`` tokens, without a shuffle.
Null or empty text is a document of the end token alone. Repeated rows and ids are documents
of their own; null ids stay null. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import Encoder, token_blocks

LENGTH = 2048
BLOCK = 1 << 21


class Capacities:
    """Open rows by free capacity; finds the least capacity that is large enough."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._change(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The free capacity and number of the fullest row with room for ``need``; it is removed."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                node += not self.count[node]
        free = node - self.size
        self._change(free, -1)
        return free, self.rows[free].pop()

    def _change(self, free: int, by: int) -> None:
        node = free + self.size
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(lengths: list[int], row_length: int) -> tuple[list[int], int]:
    """The row of each piece, and the number of rows. No length is above ``row_length``."""
    open_rows, rows, row_of = Capacities(row_length), 0, [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_rows.take(lengths[i])
        free, row = found if found else (row_length, rows)
        rows += not found
        row_of[i] = row
        if free > lengths[i]:
            open_rows.add(free - lengths[i], row)
    return row_of, rows


def packed_rows(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """One row per matrix row: sequence_id, n_tokens, ids (``length`` little-endian unsigned
    32-bit ids, zeros after the tokens), cu_seqlens (segment borders from 0 on),
    position_resets (where positions start at 0 again), doc_ids and starts (of each segment,
    and its first token's number in its document), ids_crc32 (of the ids, padding included)."""
    schema = ("sequence_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, "
              "position_resets array<int>, doc_ids array<bigint>, starts array<bigint>, ids_crc32 bigint")

    def packed(batches):
        import pyarrow as pa

        encoder, number = Encoder(vocabulary), 0
        for stream, begins, columns in token_blocks(batches, encoder, BLOCK, ["doc_id", "part"]):
            doc = np.repeat(np.arange(len(begins) - 1), -(-np.diff(begins) // length))
            fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
            turn = np.arange(len(doc)) - np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))
            start = turn * length
            size = np.minimum(length, np.diff(begins)[doc] - start)
            row_of, n = best_fit(size.tolist(), length)
            order = np.lexsort((np.arange(len(doc)), row_of))
            bounds = np.searchsorted(np.asarray(row_of)[order], np.arange(n + 1))
            base = (columns["part"][0] << 33) + number
            number += n
            ids_of = columns["doc_id"]
            table = {name: [] for name in ("sequence_id", "n_tokens", "ids", "cu_seqlens",
                                           "position_resets", "doc_ids", "starts", "ids_crc32")}
            for r in range(n):
                members = order[bounds[r]:bounds[r + 1]]
                borders = [0, *np.cumsum(size[members]).tolist()]
                row = np.zeros(length, "<u4")
                for m, to in zip(members, borders):
                    a = begins[doc[m]] + start[m]
                    row[to:to + size[m]] = stream[a:a + size[m]]
                values = (base + r, borders[-1], row.tobytes(), borders, borders[:-1],
                          [ids_of[doc[m]] for m in members], start[members].tolist(), zlib.crc32(row))
                for name, value in zip(table, values):
                    table[name].append(value)
                if len(table["ids"]) == 1000:
                    yield _batch(pa, table)
                    table = {name: [] for name in table}
            if table["ids"]:
                yield _batch(pa, table)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.spark_partition_id().cast("long").alias("part"))
    return rows.mapInArrow(packed, schema)


def _batch(pa, table: dict):
    kinds = {"sequence_id": pa.int64(), "n_tokens": pa.int32(), "ids": pa.binary(),
             "cu_seqlens": pa.list_(pa.int32()), "position_resets": pa.list_(pa.int32()),
             "doc_ids": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()), "ids_crc32": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(table[c], k) for c, k in kinds.items()], names=list(kinds))


def write(rows: DataFrame, path: str) -> None:
    """The packed rows as Parquet files: ``ids`` is the matrix, a binary row each."""
    rows.write.mode("error").parquet(path)
