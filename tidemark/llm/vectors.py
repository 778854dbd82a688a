"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Two unit vectors of cosine c are sqrt(2 - 2c) apart, so their difference, projected on a
Gaussian direction, is normal with that deviation. Around every vector, each projection has
a window of ``SPREAD`` deviations of a pair at the threshold; such a pair misses a window with
a small, known probability. ``needed`` is the number of collisions, out of ``PROJECTIONS``,
that a pair at the threshold reaches but for a chance of ``LOSS``; nearer pairs reach it
more surely. Pairs that reach it are verified by their cosine in double precision.

Pairs are found by sorting: a pair that may miss m windows hits all of at least one of m + 1
groups of projections, so only pairs that collide throughout a group are looked at, and each is
counted in the first such group. Labels of more than ``BLOCK`` vectors are cut into cells of two
windows along one axis of the group after the other, as many as the label's size asks for; a vector
also goes to the cells that its window reaches, and a pair is met in the cell of its larger
coordinates. Cells that are still large, such as those of near copies, are cut into blocks, and blocks meet
in pairs. Inside a cell, vectors are sorted along the first axis and gathered by window along the others.

Equal vectors of a label are one class with a weight, so copies are not expanded. Tasks
return counts per class and a spanning forest of the links they found, never all pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and those without a
label, link with nothing. Vectors of different lengths do not link. Repeated rows are vectors
of their own; rows without an id count as links, and a component made of such rows only has a
null id. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.graph import components
from tidemark.llm.groups import sorted_groups
from tidemark.session import written

PROJECTIONS = 16
SPREAD = 2.5
LOSS = 1e-4
BLOCK = 2048
PAIRS = 1 << 21  # compared at once
SHRINK = 0.55  # of a label's vectors, about the part that one more axis leaves in a cell
ROOM = 1 + 1e-6  # rounding of projections loses no pair at the edge of a window
BROADCAST_ROWS = 100_000
NARROWEST = 1e-4  # window of thresholds next to 1


def allowed_misses(projections: int = PROJECTIONS, spread: float = SPREAD, loss: float = LOSS) -> int:
    """The windows a pair at the threshold may miss so that no more than ``loss`` of such pairs are lost."""
    miss, total = math.erfc(spread / math.sqrt(2)), 0.0
    for m in range(projections + 1):
        total += math.comb(projections, m) * miss**m * (1 - miss) ** (projections - m)
        if 1 - total <= loss:
            return m
    return projections


def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, PROJECTIONS))


def _units(raw: list[bytes], kind: str = "<f8") -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype("<f8")
    # Scaled first, so that squares neither vanish nor overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kind(vectors: DataFrame) -> str:
    """How components travel: as they come, in four bytes or in eight."""
    kind = vectors.schema["embedding"].dataType
    return "<f4" if isinstance(getattr(kind, "elementType", None), T.FloatType) else "<f8"


def _classes(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id, label, node, vector of every row; node is null where the vector cannot link."""

    def read(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = {"node": [], "vector": []}
            labels, vectors = batch.column("label").to_pylist(), batch.column("embedding").to_pylist()
            for label, vector in zip(labels, vectors):
                node = raw = None
                if label is not None and vector and None not in vector:
                    x = np.array(vector, "<f8") + 0.0
                    if np.isfinite(x).all() and x.any():
                        raw = x.astype(kind).tobytes()
                        whole = hashlib.sha256(str(label).encode()).digest()
                        name = hashlib.blake2b(raw, digest_size=8, key=whole)
                        node = int.from_bytes(name.digest(), "little", signed=True)
                out["node"].append(node)
                out["vector"].append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(out["node"], pa.int64()),
                 pa.array(out["vector"], pa.binary())], names=["vec_id", "label", "node", "vector"])

    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                        F.col("embedding").cast("array<double>").alias("embedding"))
    return known.mapInArrow(read, "vec_id bigint, label string, node bigint, vector binary")


def groups(misses: int) -> list[list[int]]:
    """Projections by group; those that are left over only count."""
    size = PROJECTIONS // (misses + 1)
    return [list(range(g * size, (g + 1) * size)) for g in range(misses + 1)]


def _beside(rows: DataFrame, few: DataFrame, on: list[str], label: str) -> DataFrame:
    """``rows`` with what ``few``, rows of numbers, says of some of their keys; broadcast up to a counted length."""
    few = written(few, label)
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, "left")


def _cells(classes: DataFrame, window: float, of: list[list[int]], kind: str) -> DataFrame:
    """(label, size, part, c0, c1 ..., home, node, weight, vector) of every class, group of projections and cell.

    ``home`` has a bit for each axis along which the vector lies in the cell itself, not before it.
    Axes that are not needed have one cell.
    """
    width = len(of[0])
    names = [f"c{k}" for k in range(width)]
    classes = classes.withColumn("label", F.xxhash64("label"))
    large = classes.groupBy("label").agg(F.count("*").alias("many")).where(F.col("many") > BLOCK)
    axes = F.ceil(F.log(F.col("many") / BLOCK) / -math.log(SHRINK))
    axes = F.least(F.lit(width), axes).cast("int")
    sized = _beside(classes, large.select("label", axes.alias("axes")), ["label"], "large-labels")

    def placed(batches):
        from itertools import product

        import pyarrow as pa

        for batch in batches:
            raw, axes = batch.column("vector").to_pylist(), batch.column("axes").to_numpy()
            lengths = np.array([len(v) for v in raw])
            for n, used in sorted(set(zip(lengths.tolist(), axes.tolist()))):
                at = np.flatnonzero((lengths == n) & (axes == used))
                along = _units([raw[i] for i in at], kind)
                along = along @ _directions(along.shape[1])
                for part, mine in enumerate(of):
                    place = along[:, mine[:used]]
                    low = np.floor(place / (2 * window)).astype(np.int32)
                    reaches = np.floor((place + window * ROOM) / (2 * window)) > low
                    for ahead in product((0, 1), repeat=used):
                        there = np.flatnonzero((reaches | ~np.array(ahead, bool)).all(axis=1))
                        cell = np.zeros((len(there), width), np.int32)
                        cell[:, :used] = low[there] + np.array(ahead, np.int32)
                        home = (1 << width) - 1 - sum(1 << k for k, x in enumerate(ahead) if x)
                        taken = batch.take(pa.array(at[there]))
                        same = lambda x, m=len(there): pa.array(np.full(m, x, np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [*(taken.column(c) for c in ("label", "node", "weight", "vector")), same(n),
                             same(part), same(home), *(pa.array(cell[:, k].copy()) for k in range(width))],
                            names=["label", "node", "weight", "vector", "size", "part", "home", *names])

    return sized.select("label", "node", "weight", "vector", F.coalesce("axes", F.lit(0)).alias("axes")).mapInArrow(
        placed, "label bigint, node bigint, weight bigint, vector binary, size int, part int, home int, "
        + ", ".join(f"{c} int" for c in names))


def neighbours(place: np.ndarray, window: float):
    """Pairs (i, j) of rows of ``place``, each pair once: at most a window apart on the first axis, and in the
    same cell of a window's width or in neighbouring ones on each other axis. In parts of about ``PAIRS``."""
    from itertools import product

    reach = window * ROOM
    cell = np.floor(place[:, 1:] / reach).astype(np.int64)
    cell -= cell.min(axis=0) - 1
    sides = cell.max(axis=0) + 2  # a step beyond a side meets no cell
    strides = np.append(np.cumprod(sides[::-1])[::-1][1:], 1) if len(sides) else sides
    code = cell @ strides
    known, rank = np.unique(code, return_inverse=True)
    x = place[:, 0] - place[:, 0].min()
    span = x.max() + 3 * reach
    order = np.lexsort((x, rank))
    key, code, rank, x = (rank * span + x)[order], code[order], rank[order], x[order]
    own = np.arange(len(key))
    first, size = [], []
    for step in product((-1, 0, 1), repeat=place.shape[1] - 1):
        if not any(step):
            first.append(own + 1)
            size.append(np.searchsorted(key, key + reach, "right") - own - 1)
        elif step > (0,) * len(step):
            wanted = code + np.array(step) @ strides
            there = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            middle = there * span + x
            low = np.searchsorted(key, middle - reach, "left")
            first.append(low)
            size.append(np.where(known[there] == wanted, np.searchsorted(key, middle + reach, "right") - low, 0))
    first, size = np.concatenate(first), np.concatenate(size)
    some = np.flatnonzero(size)
    first, size, row = first[some], size[some], some % len(key)
    done = np.concatenate([[0], np.cumsum(size)])
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(done, done[start] + PAIRS, "right")) - 1)
        part = size[start:stop]
        i = np.repeat(row[start:stop], part)
        j = np.repeat(first[start:stop] - done[start:stop] + done[start], part) + np.arange(len(i))
        start = stop
        yield order[i], order[j]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node reachable over the links (a, b)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return low


def _compared(cells: DataFrame, threshold: float, window: float, misses: int, kind: str) -> DataFrame:
    """(a, b, links): counts of a class (b null) and links between classes (links null)."""
    of = groups(misses)
    width = len(of[0])
    place = ["label", "size", "part", *(f"c{k}" for k in range(width))]
    large = cells.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = large.select(*place, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = _beside(cells, large, place, "large-cells")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    # Blocks of a cell meet each other (first <= second).
    meet = F.transform(F.sequence(F.lit(0), blocks - 1), lambda y: F.struct(
        F.least(y, "own").alias("first"), F.greatest(y, "own").alias("second"),
        (y <= F.col("own")).cast("int").alias("guest")))
    rows = rows.withColumn("own", own).withColumn("t", F.explode(meet)).select(
        *place, "t.first", "t.second", "t.guest",
        "home", "node", "weight", "vector")
    keys = [*place, "first", "second"]

    def linked(batches):
        import pyarrow as pa

        for group in sorted_groups(batches, keys):
            mine, first, second = (group.column(c)[0].as_py() for c in ("part", "first", "second"))
            node, weight, guest, home = (group.column(c).to_numpy() for c in ("node", "weight", "guest", "home"))
            unit = _units(group.column("vector").to_pylist(), kind)
            along = unit @ _directions(unit.shape[1])
            found = []
            for i, j in neighbours(along[:, of[mine]], window):
                keep = (home[i] | home[j]) == (1 << width) - 1
                if first != second:
                    keep &= guest[i] != guest[j]
                i, j = i[keep], j[keep]
                for k in of[mine]:
                    keep = np.abs(along[i, k] - along[j, k]) <= window
                    i, j = i[keep], j[keep]
                missed = np.zeros(len(i), np.int8)
                rest = [[k] for k in range(len(of) * width, PROJECTIONS)]
                for g, axes in enumerate(of + rest):
                    if g == mine:
                        continue
                    out = sum((np.abs(along[i, k] - along[j, k]) > window).astype(np.int8) for k in axes)
                    missed += out
                    keep = missed <= misses
                    if g < mine:
                        keep &= out > 0
                    i, j, missed = i[keep], j[keep], missed[keep]
                sound = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                found.append((i[sound], j[sound]))
            if not any(len(i) for i, _ in found):
                continue
            i, j = (np.concatenate(x) for x in zip(*found))
            links = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
            low = _forest(i, j, len(node))
            has = np.flatnonzero(links)
            tied = np.flatnonzero(low != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[has], node[tied]])),
                 pa.array([None] * len(has) + node[low[tied]].tolist(), pa.int64()),
                 pa.array(links[has].astype(np.int64).tolist() + [None] * len(tied), pa.int64())],
                names=["a", "b", "links"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(linked, "a bigint, b bigint, links bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    misses = allowed_misses()
    window = max(NARROWEST, SPREAD * math.sqrt(2 - 2 * threshold))
    kind = _kind(vectors)
    rows = written(_classes(vectors, kind), "vectors")
    classes = written(rows.where("node is not null").groupBy("node", "label").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.any_value("vector").alias("vector")), "classes")
    found = written(_compared(_cells(classes, window, groups(misses), kind), threshold, window, misses, kind), "found")
    places = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    placed = written(
        classes.select("node", "rep", "weight").join(places, "node", "left").join(counts, "node", "left")
        .select("node", "rep", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                F.coalesce("root", "node").alias("root")), "placed")
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component"))
    named = placed.join(smallest, "root").select("node", "links", "component")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return (
        rows.select("vec_id", "node").join(named, "node", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                component.alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
