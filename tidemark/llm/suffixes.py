"""Removing repeated byte strings: a distributed difference-cover suffix sort, to a fixed depth.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts in a document of
a smaller id. Suffixes need sorting only by their first LENGTH bytes, so the sort of a
difference cover needs one level of names and no recursion below it:

1. Sample the positions whose remainder modulo ``PERIOD`` is in ``COVER``. Every difference of
   remainders occurs in the cover, so two equal strings have sampled positions at the same
   place, at most PERIOD - 1 bytes in. Sampled suffixes get a name: a fingerprint of
   their first LENGTH - PERIOD + 1 bytes. Names are sorted in shards; those that neighbours
   share live on, all others are unique, and so is every string that contains no shared name.
2. Merge in the remaining suffixes: positions up to PERIOD - 1 bytes before a shared name are
   sorted by the fingerprint of all their LENGTH bytes; equal neighbours are equal
   strings, and the smallest document among them keeps its own. Documents whose whole text a
   smaller one has are found beforehand in the same way; they lose everything and take no part.

Texts move once, in compressed blocks. Blocks send each shard their distinct names (then
strings) as sorted lists, and get a bit per entry back. Strings travel with the smallest id that
has them, unless the ids of a block lie apart from those of all others, where one id serves for
all. A string that a third of all documents hold is one entry per block. Fingerprints of names may collide (harmless: step 2 decides);
those of strings have 64 bits.

Null text is empty. Rows without an id neither lose bytes nor cause a loss. Rows of the same id
do not count as smaller than each other, repeated rows included. Texts shorter than LENGTH
lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import gather, opened, packed, steps, summed, unpacked
from tidemark.llm.words import Powers, digest, mixed

LENGTH = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # a perfect difference set
NAME = LENGTH - PERIOD + 1
BLOCK_CHARS = 1 << 22
SHARD_CHARS = 1 << 24  # of text per shard of the sort


class Texts:
    """The texts of a block as one array of bytes, with fingerprints of its strings."""

    def __init__(self, data: bytes, powers: Powers) -> None:
        table = opened(data)
        self.ids = table.column("doc_id").to_pylist()
        texts = [t.encode("utf-8", "replace") if t else b"" for t in table.column("text").to_pylist()]
        self.begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.bytes)
        powers.reach(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        part = self.sums[1:]
        np.add(self.bytes, np.uint64(1), out=part, dtype=np.uint64, casting="unsafe")
        part *= powers.up[:n]
        np.cumsum(part, out=part)
        self.down = powers.down
        self.order = np.array([i or 0 for i in self.ids], np.int64)
        size = np.diff(self.begins)
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        # Rows without an id are left out of the comparison: nothing has room in them.
        ends = np.where([i is not None for i in self.ids], self.begins[1:], 0)
        self.end = np.repeat(ends, size)

    def inside(self, at: np.ndarray, length: int) -> np.ndarray:
        """Those of the positions ``at`` from which ``length`` bytes lie in one document with an id."""
        return at[at + length <= self.end[at]]

    def prints(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mixed((self.sums[at + length] - self.sums[at]) * self.down[at])

    def sampled(self) -> np.ndarray:
        n = len(self.bytes)
        at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
        return self.inside(at[at < n], NAME)

    def wholes(self):
        """Texts that can lose something, by number, and the entries of their digests. Texts are too long for the
        fingerprints of short strings, in which powers of the base could cancel."""
        long = np.flatnonzero((np.diff(self.begins) >= LENGTH) & np.array([i is not None for i in self.ids], bool))
        prints = np.fromiter(
            (digest(self.bytes[self.begins[i]:self.begins[i + 1]].tobytes()) for i in long), np.uint64, len(long))
        return long, _entries(prints, self.order[long])


def _entries(prints: np.ndarray, order: np.ndarray):
    """Distinct fingerprints, rising, with the smallest and largest id of each and the entry of each position."""
    by = np.argsort(prints, kind="stable")
    sorted_ = prints[by]
    fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(by) else np.zeros(0, bool)
    start = np.flatnonzero(fresh)
    entry = np.empty(len(by), np.int64)
    entry[by] = np.cumsum(fresh) - 1
    if not len(start):
        return sorted_, order[:0], order[:0], entry
    ids = order[by]
    return sorted_[start], np.minimum.reduceat(ids, start), np.maximum.reduceat(ids, start), entry


def _shards(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Borders of the shards, which are ranges of the leading ``bits``, in rising fingerprints."""
    if not bits:
        return np.array([0, len(distinct)])
    firsts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(distinct, firsts), [len(distinct)]])


def _sent(block: int, distinct, extra, borders, cut: int):
    """A row per shard that gets something: its entries without their last ``cut`` bits."""
    import pyarrow as pa

    rows = [(block, s, steps(distinct[a:b] >> np.uint64(cut)), extra(a, b))
            for s, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())) if b > a]
    block_, shard, keys, more = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(block_, pa.int64()), pa.array(shard, pa.int32()), pa.array(keys, pa.binary()),
         pa.array(more, pa.binary())], names=["block", "shard", "keys", "more"])


_SENT = "block bigint, shard int, keys binary, more binary"
_ANSWER = "block bigint, step int, shard int, bits binary"
_CUT = 24  # bits of a name that do not travel


def _names(blocks: DataFrame, bits: int) -> DataFrame:
    """Step 1: the distinct names of each block, and which of them several of its documents
    share. In shards of their own, numbered from 2 ** bits on, also the whole texts."""

    def listed(batches):
        import pyarrow as pa
        import pyarrow.compute

        powers = Powers()
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                texts = Texts(data.as_py(), powers)
                distinct, multi = _block_names(texts)[:2]
                yield _sent(block, distinct, lambda a, b, m=multi: np.packbits(m[a:b]).tobytes(), _shards(distinct, bits), _CUT)
                _, (distinct, low, _, _) = texts.wholes()
                rows = _with_ids(block, distinct, low, bits)
                shard = pyarrow.compute.add(rows.column("shard"), pa.scalar(1 << bits, pa.int32()))
                yield rows.set_column(1, "shard", shard)
                ids = [i for i in texts.ids if i is not None]
                if ids:
                    span = np.array([min(ids), max(ids)], "<i8").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([span], pa.binary()),
                         pa.array([b""], pa.binary())], names=["block", "shard", "keys", "more"])

    return blocks.mapInArrow(listed, _SENT)


def _block_names(texts: Texts):
    """Distinct names, rising, which of them several documents of the block have, and the
    sampled positions with theirs."""
    at = texts.sampled()
    prints = texts.prints(at, NAME) >> np.uint64(_CUT) << np.uint64(_CUT)
    # The bits that a name does not use take the document's number, so one sort does for both.
    # (Blocks hold fewer documents than that unless nearly all are empty, and those have no name.)
    both = np.sort(prints | (texts.doc[at] % (1 << _CUT)).astype(np.uint64))
    name = both >> np.uint64(_CUT) << np.uint64(_CUT)
    fresh = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.zeros(0, bool)
    start = np.flatnonzero(fresh)
    last = np.concatenate([start[1:], [len(name)]]) - 1 if len(start) else start
    return name[start], both[start] != both[last], at, prints


def _shared_names(sent: DataFrame, bits: int) -> DataFrame:
    """For each name, whether several documents have it; for each whole text, whether a smaller
    one has it; for each block, whether its ids lie apart from all others' (shard -1: a span of
    ids per block)."""

    def sorted_(table):
        if table.column("shard")[0].as_py() == -1:
            spans = np.stack([np.frombuffer(k, "<i8") for k in table.column("keys").to_pylist()])
            order = np.lexsort((spans[:, 1], spans[:, 0]))
            low, high = spans[order].T
            after = np.concatenate([low[1:] > np.maximum.accumulate(high)[:-1], [True]])
            apart = np.empty(len(order), bool)
            apart[order] = after & np.concatenate([[True], after[:-1]])
            return _answer(table, list(apart[:, None]), 4, -1)
        lists = [summed(k) for k in table.column("keys").to_pylist()]
        if table.column("shard")[0].as_py() >= 1 << bits:
            return _answer(table, _lower_elsewhere(lists, table), 3, 1 << bits)
        multi = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool)
                 for m, k in zip(table.column("more").to_pylist(), lists)]
        every = np.sort(np.concatenate(lists))
        shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(k[m] for k, m in zip(lists, multi))]))
        return _answer(table, [_among(k, shared) for k in lists], 1)

    return sent.groupBy("shard").applyInArrow(sorted_, _ANSWER)


def _lower_elsewhere(lists: list[np.ndarray], table) -> list[np.ndarray]:
    """For each entry of each block, whether another block has it with a smaller id."""
    ids = [unpacked(m[8:]).astype(np.int64) + int.from_bytes(m[:8], "little", signed=True)
           for m in table.column("more").to_pylist()]
    own = np.concatenate(ids)
    _, low, _, entry = _entries(np.concatenate(lists), own)
    return np.split(low[entry] < own, np.cumsum([len(k) for k in lists])[:-1])


def _answer(table, flags: list[np.ndarray], step: int, less: int = 0):
    import pyarrow as pa

    shards = [s - less for s in table.column("shard").to_pylist()]
    return pa.table({"block": table.column("block"), "step": pa.array([step] * len(flags), pa.int32()),
                     "shard": pa.array(shards, pa.int32()),
                     "bits": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})


def _among(keys: np.ndarray, shared: np.ndarray) -> np.ndarray:
    if not len(shared):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
    return shared[at] == keys


def _answered(answers, step: int, borders: np.ndarray) -> np.ndarray:
    """The bits for a block's entries, shard by shard."""
    out = np.zeros(borders[-1], bool)
    for kind, shard, bits in zip(*(answers.column(c).to_pylist() for c in ("step", "shard", "bits"))):
        if kind == step:
            a, b = borders[shard], borders[shard + 1]
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def _block_strings(texts: Texts, answers, bits: int):
    """Step 2: positions at or before a shared name, and their strings."""
    distinct, _, at, prints = _block_names(texts)
    live = at[_among(prints, distinct[_answered(answers, 1, _shards(distinct, bits))])]
    long, (distinct, low, _, entry) = texts.wholes()
    copies = np.zeros(len(texts.ids), bool)
    copies[long] = _answered(answers, 3, _shards(distinct, bits))[entry] | (texts.order[long] > low[entry])
    mark = np.zeros(len(texts.bytes) + 1, np.int32)
    np.add.at(mark, np.maximum(live - PERIOD + 1, 0), 1)
    np.add.at(mark, live + 1, -1)
    starts = texts.inside(np.flatnonzero((np.cumsum(mark[:-1]) > 0) & ~copies[texts.doc]), LENGTH)
    order = texts.order[texts.doc[starts]]
    return copies, starts, order, _entries(texts.prints(starts, LENGTH), order)


def _strings(blocks: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    def listed(left, right):
        import pyarrow as pa

        powers, parts = Powers(), []
        for block, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist()):
            texts = Texts(data, powers)
            *_, (distinct, low, _, _) = _block_strings(texts, right, bits)
            if _answered(right, 4, np.array([0, 1]))[0]:
                # Any id of a block that lies apart compares with other blocks' as all do.
                low = np.full(len(low), texts.order[[i is not None for i in texts.ids]].min())
            parts.append(_with_ids(block, distinct, low, bits))
        return pa.Table.from_batches(parts)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(listed, _SENT)


def _with_ids(block: int, distinct: np.ndarray, low: np.ndarray, bits: int):
    """The rows for the shards of a block's strings, with the smallest id of each."""
    base = int(low.min()) if len(low) else 0

    def ids(a, b):
        return base.to_bytes(8, "little", signed=True) + packed((low[a:b] - base).astype(np.uint64))

    return _sent(block, distinct, ids, _shards(distinct, bits), 0)


def _smaller(sent: DataFrame) -> DataFrame:
    """Step 2: for each block's string, whether a document of another block with a smaller id has it."""

    def sorted_(table):
        lists = [summed(k) for k in table.column("keys").to_pylist()]
        return _answer(table, _lower_elsewhere(lists, table), 2)

    return sent.groupBy("shard").applyInArrow(sorted_, _ANSWER)


_RESULT = ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
           "span_starts array<bigint>, span_ends array<bigint>")


def _removed(blocks: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    def cut(left, right):
        import hashlib

        import pyarrow as pa

        powers, parts = Powers(), []
        for data in left.column("data").to_pylist():
            texts = Texts(data, powers)
            copies, starts, order, (distinct, low, _, entry) = _block_strings(texts, right, bits)
            gone = _answered(right, 2, _shards(distinct, bits))[entry] | (order > low[entry])
            mark = np.zeros(len(texts.bytes) + LENGTH + 1, np.int32)
            mark[starts[gone]] += 1
            mark[starts[gone] + LENGTH] -= 1
            out = (np.cumsum(mark)[:len(texts.bytes)] > 0) | copies[texts.doc]
            rows = {name.split()[0]: [] for name in _RESULT.split(", ")}
            for i, (a, b) in enumerate(zip(texts.begins[:-1].tolist(), texts.begins[1:].tolist())):
                here = out[a:b]
                edge = np.flatnonzero(np.diff(here.astype(np.int8), prepend=0, append=0))
                values = (texts.ids[i], b - a, int(here.sum()), len(edge) // 2,
                          hashlib.sha256(texts.bytes[a:b][~here]).hexdigest(), edge[0::2].tolist(), edge[1::2].tolist())
                for column, value in zip(rows.values(), values):
                    column.append(value)
            many = pa.list_(pa.int64())
            kinds = [pa.int64()] * 4 + [pa.string(), many, many]
            parts.append(pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows)))
        return pa.concat_tables(parts)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, _RESULT)


def repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_starts and span_ends of every row of
    ``docs`` (doc_id, text)."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, chars // SHARD_CHARS)
    bits = max(0, math.ceil(math.log2(shards)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(1, math.ceil(chars / BLOCK_CHARS))
    blocks = gather(rows, BLOCK_CHARS).repartition(parts, "block")
    first = _shared_names(_names(blocks, bits), bits)
    smaller = _smaller(_strings(blocks, first, bits))
    return _removed(blocks, first.unionByName(smaller), bits)
