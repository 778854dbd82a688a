"""Near-duplicate texts: b-bit MinHash signatures and a multi-index Hamming join.

A document's set holds the hashes of its distinct runs of ``words`` words. Its signature has
``SYMBOLS`` symbols of 16 bits, one per hash function: the lowest hash of the set, cut to 16
bits. Two signatures differ in a symbol with a probability of at most one minus the
similarity, so documents of similarity 0.8 or more differ in at most ``DISTANCE`` symbols, but for a
chance of 6 in 100,000.

The join finds *all* pairs of signatures within that distance. Signatures are split into
``CHUNKS`` chunks; DISTANCE errors leave one chunk with at most ``ERRORS`` (pigeonhole). Each
signature is listed under every chunk with every choice of ERRORS symbols left out, so such
a pair shares a list.

A list is not expanded into its pairs. (1) Documents with equal sets are one class from the
start. (2) In ``ROUNDS`` rounds, each list has a leader, drawn anew, and every class is compared
with the ``LEADERS`` leaders of other components that it shares most lists with; components grow. (3) Lists
that still hold several components are gone through pair by pair, across components, by
signatures inside tasks; long ones are cut into blocks, and a pair counts in the first list it
shares. What passes the distance has a second, wider signature compared, and then the full
sets, recomputed from the texts. A large group of copies is one component after step 2,
so its size does not square.

Result: the smallest doc_id reachable over links. Null, empty or wordless text links with
nothing. Documents with fewer words than a run are one run. Rows are judged as they are:
repeated rows share class and component; rows without an id take part by equal sets only, and
a class that has no id at all gets a null component and is kept.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.groups import matrix, sorted_groups
from tidemark.llm.words import Powers, chunks, mixed, word_numbers
from tidemark.session import written

CHUNKS, WIDTH, ERRORS = 15, 5, 1
SYMBOLS = CHUNKS * WIDTH
DISTANCE = (ERRORS + 1) * CHUNKS - 1
ROUNDS, LEADERS = 2, 8
WIDE, WIDE_DISTANCE = 256, 77  # symbols of 8 bits; exceeded at similarity 0.8 with a chance of 4 in 100,000
SHELF = 1000  # texts against which askers are confirmed in one group
BLOCK = 1500  # classes of a list compared with each other in one group

_SLOTS = 7  # low bits of a list's number: its chunk and choice
_CHOICES = [list(c) for c in combinations(range(WIDTH), WIDTH - ERRORS)]


def _hashes(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(seed, seed + 2 * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n], seeds[n:] | np.uint64(1)


_NARROW_HASHES, _WIDE_HASHES = _hashes(SYMBOLS, 1), _hashes(WIDE, 10_000)


def shingles(texts: list[bytes], words: int, powers: Powers) -> list[np.ndarray]:
    """The sorted set of each text, lower-cased in A-Z, as 64-bit numbers."""
    numbers, at = word_numbers([t.lower() for t in texts], powers)
    times = np.uint64(0xC2B2AE3D27D4EB4F)
    run = numbers.copy()
    for k in range(1, words):
        run[:-k or None] = run[:-k or None] * times + numbers[k:]
    run = mixed(run)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(run[a:b - words + 1]))
        elif b > a:
            total = np.uint64(b - a)
            for x in numbers[a:b].tolist():
                total = mixed(np.array([int(total) ^ x], np.uint64) * times)[0]
            out.append(np.array([total], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_number(values: np.ndarray) -> int:
    """A number of the whole set; equal sets have equal ones."""
    total = mixed(values ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(values))], np.uint64)).astype(np.int64)[0])


def _lowest(values: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    xor, times = hashes
    low = np.full(len(xor), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(values), 4096):
        part = (values[a:a + 4096, None] ^ xor) * times
        low = np.minimum(low, part.min(axis=0))
    return mixed(low)


def signature(values: np.ndarray) -> bytes:
    return _lowest(values, _NARROW_HASHES).astype("<u2").tobytes()


def wide_signature(values: np.ndarray) -> bytes:
    return _lowest(values, _WIDE_HASHES).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, node (number of the set; null if empty) and sig of each row."""

    def signed(batches):
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            size, node, sig = [], [], []
            for a, b in chunks(texts):
                for values in shingles(texts[a:b], words, powers):
                    size.append(len(values))
                    node.append(set_number(values) if len(values) else None)
                    sig.append(signature(values) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(node, pa.int64()),
                 pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "node", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(signed, "doc_id bigint, n_shingles bigint, node bigint, sig binary")


def listed(classes: DataFrame) -> DataFrame:
    """(list, node): every class under each of its lists."""
    choices, salt = _CHOICES, mixed(np.arange(1, CHUNKS * len(_CHOICES) + 1, dtype=np.uint64) << np.uint64(7))

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = matrix(batch.column("sig"), "<u2", SYMBOLS).astype(np.uint64)
            symbols = symbols.reshape(-1, CHUNKS, WIDTH)
            node = batch.column("node").to_numpy()
            keys = []
            for slot in range(CHUNKS * len(choices)):
                key = np.full(len(node), salt[slot])
                for s in choices[slot % len(choices)]:
                    key = mixed(key ^ symbols[:, slot // len(choices), s])
                keys.append(key >> np.uint64(_SLOTS) << np.uint64(_SLOTS) | np.uint64(slot))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.tile(node, len(keys)))],
                names=["list", "node"])

    return classes.select("node", "sig").mapInArrow(keyed, "list bigint, node bigint")


def _first_slot(same: np.ndarray) -> np.ndarray:
    """The first slot that pairs share, from which symbols (columns) they have in common."""
    same = same.reshape(-1, CHUNKS, WIDTH)
    chunk = (same.sum(axis=2) >= WIDTH - ERRORS).argmax(axis=1)
    inside = same[np.arange(len(same)), chunk]
    # The first choice that leaves out the symbol in which they differ, if there is one.
    fits = np.stack([inside[:, c].all(axis=1) for c in _CHOICES], axis=1)
    return chunk * len(_CHOICES) + fits.argmax(axis=1)


def _shared(lists: DataFrame) -> DataFrame:
    """(list, node) for lists of two classes or more."""

    def marked(batches):
        import pyarrow as pa

        held = None  # the last row, if it may be alone in its list
        before = None  # the last list seen
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("list").to_numpy(), batch.column("node").to_numpy()
            same = key[1:] == key[:-1]
            goes_on = before is not None and before == key[0]
            out = np.concatenate([[goes_on], same]) | np.concatenate([same, [False]])
            keys, nodes = key[out], node[out]
            if held is not None and goes_on:
                keys, nodes = np.concatenate([[held[0]], keys]), np.concatenate([[held[1]], nodes])
            held = None if out[-1] else (key[-1], node[-1])
            before = key[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64)), pa.array(nodes.astype(np.int64))], names=["list", "node"])

    dealt = lists.repartition("list").sortWithinPartitions("list")
    return dealt.mapInArrow(marked, "list bigint, node bigint")


def _led(shared: DataFrame, places: DataFrame, turn: int) -> DataFrame:
    """(a, b): each class and the ``LEADERS`` leaders, of other components, that it shares most lists with."""
    held = _placed(shared, places)
    draw = F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "root")
    leads = held.groupBy("list").agg(
        F.min(draw).alias("lead"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    met = held.join(leads.select("list", "lead"), "list").where("root <> lead.root")
    often = met.groupBy("node", F.col("lead.node").alias("lead")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("node").orderBy(F.desc("n"), "lead")
    best = often.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= LEADERS)
    return best.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def _placed(shared: DataFrame, places: DataFrame) -> DataFrame:
    return shared.join(places, "node", "left").select("list", "node", F.coalesce("root", "node").alias("root"))


def _near(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and wide signatures allow a link."""
    sized = texts.select("node", "wide").join(classes.select("node", "size"), "node")
    side = lambda c: sized.select(
        F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("wide").alias(f"wide_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(
        100 * F.least("size_a", "size_b") >= 80 * F.greatest("size_a", "size_b"))

    def close(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (matrix(batch.column(f"wide_{c}"), np.uint8, WIDE) for c in "ab")
                near = (a != b).sum(axis=1) <= WIDE_DISTANCE
                yield batch.select(["a", "b"]).filter(near)

    return both.select("a", "b", "wide_a", "wide_b").mapInArrow(close, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those of ``pairs`` whose sets, from the texts (node, text), have a similarity of 0.8 or more."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def checked(batches):
        powers, known = Powers(), {}

        def values(node, text):
            if node not in known:
                if len(known) >= 64:
                    known.pop(next(iter(known)))
                known[node] = shingles([text.encode("utf-8", "replace")], words, powers)[0]
            return known[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("text_a"), batch.column("text_b")
            sound = []
            for i in range(batch.num_rows):
                x, y = values(a[i], ta[i].as_py()), values(b[i], tb[i].as_py())
                common = len(x) + len(y) - len(np.union1d(x, y))
                sound.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(np.array(sound, bool))

    return both.mapInArrow(checked, "a bigint, b bigint")


def _across(shared: DataFrame, places: DataFrame, classes: DataFrame, shelves: int) -> DataFrame:
    """Pairs of classes in a common list but in different components, within the distance, as
    (shelf, a, partners): of a pair, the class of the component that is smaller in the list
    asks for the other one, which stands on a shelf by its number."""
    held = _placed(shared, places)
    several = held.groupBy("list").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    rows = held.join(several.select("list", "n"), "list").join(classes.select("node", "size", "sig"), "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                       "own", "node", "root", "size", "sig")
    keys = ["list", "low", "high"]

    def compared(batches):
        import pyarrow as pa

        for group in sorted_groups(batches, keys):
            node, root, size, own = (group.column(c).to_numpy() for c in ("node", "root", "size", "own"))
            order = np.argsort(size, kind="stable")
            node, root, size, own = node[order], root[order], size[order], own[order]
            sig = matrix(group.column("sig"), "<u2", SYMBOLS)[order]
            upto = np.searchsorted(size, size * 100 // 80, "right").tolist()
            inside = bool((own[0] == own).all())
            slot = group.column("list")[0].as_py() & ((1 << _SLOTS) - 1)
            _, component, times = np.unique(root, return_inverse=True, return_counts=True)
            weight = times[component]
            a, b = [], []
            for i in range(len(node) - 1):
                j = np.flatnonzero(root[i + 1:upto[i]] != root[i]) + i + 1
                if not inside:
                    j = j[own[j] != own[i]]
                if len(j):
                    same = sig[j] == sig[i]
                    near = same.sum(axis=1) >= SYMBOLS - DISTANCE
                    near[near] = _first_slot(same[near]) == slot
                    j = j[near]
                    asks = weight[i] <= weight[j]
                    a.append(np.where(asks, node[i], node[j]))
                    b.append(np.where(asks, node[j], node[i]))
            if not sum(map(len, a)):
                continue
            a, b = np.concatenate(a), np.concatenate(b)
            shelf = b % shelves
            order = np.lexsort((a, shelf))
            a, b, shelf = a[order], b[order], shelf[order]
            fresh = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (shelf[1:] != shelf[:-1])]))
            partners = [x.astype("<i8").tobytes() for x in np.split(b, fresh[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shelf[fresh]), pa.array(a[fresh]), pa.array(partners, pa.binary())],
                names=["shelf", "a", "partners"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(compared, "shelf bigint, a bigint, partners binary")


def _confirmed_on_shelves(asked: DataFrame, texts: DataFrame, places: DataFrame, shelves: int,
                          words: int) -> DataFrame:
    """(a, b): for each asking class a link to each component in which it has one, a shelf at a
    time. Partners are tried by their wide signatures, nearest first, until one is confirmed on
    the full sets; pairs that fail leave no row."""
    gathered = asked.groupBy("shelf", "a").agg(F.collect_list("partners").alias("partners"))
    asking = gathered.join(texts.select(
        F.col("node").alias("a"), F.col("text").alias("text_a"), F.col("wide").alias("wide_a")), "a")
    held = texts.join(places, "node", "left").select(
        F.pmod("node", F.lit(shelves)).alias("shelf"), "node", "text", "wide",
        F.coalesce("root", "node").alias("root"))

    def linked(left, right):
        import pyarrow as pa

        powers, sets = Powers(), {}
        node, root = right.column("node").to_numpy(), right.column("root").to_numpy()
        order = np.argsort(node)
        texts_of, a, b = right.column("text"), [], []
        wide = matrix(right.column("wide"), np.uint8, WIDE) if len(node) else np.zeros((0, WIDE), np.uint8)

        def values(text):
            return shingles([text.encode("utf-8", "replace")], words, powers)[0]

        for asker, parts, text, mark in zip(*(left.column(c) for c in ("a", "partners", "text_a", "wide_a"))):
            partners = np.unique(np.frombuffer(b"".join(parts.as_py()), "<i8"))
            at = order[np.searchsorted(node, partners, sorter=order)]
            far = (wide[at] != np.frombuffer(mark.as_py(), np.uint8)).sum(axis=1)
            at = at[np.argsort(far, kind="stable")][:int((far <= WIDE_DISTANCE).sum())]
            mine, found = None, set()
            for k in at.tolist():
                if root[k] in found:
                    continue
                mine = values(text.as_py()) if mine is None else mine
                if k not in sets:
                    if len(sets) >= BLOCK:
                        sets.clear()
                    sets[k] = values(texts_of[k].as_py())
                other = sets[k]
                total = len(mine) + len(other)
                if 100 * min(len(mine), len(other)) < 80 * max(len(mine), len(other)):
                    continue
                common = total - len(np.union1d(mine, other))
                if 100 * common >= 80 * (total - common):
                    found.add(root[k])
                    a.append(asker.as_py())
                    b.append(int(node[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return asking.groupBy("shelf").cogroup(held.groupBy("shelf")).applyInArrow(linked, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    rows = written(signatures(docs, words), "signatures")
    classes = written(rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("size"),
        F.any_value("sig").alias("sig")), "classes")
    shared = written(_shared(listed(classes.where("rep is not null"))), "lists")
    wanted = shared.select("node").distinct().join(classes.select("node", "rep"), "node")
    texts = written(
        docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep")
        .transform(lambda d: _of_class(d, words)), "texts")
    nothing = shared.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    places, links, tried = nothing.toDF("node", "root"), nothing, nothing
    for turn in range(ROUNDS):
        pairs = _led(shared, places, turn)
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        links = links.unionByName(written(_confirmed(_near(pairs, classes, texts), texts, words), "links"))
        places = components(links)
    shelves = 1 + texts.count() // SHELF
    asked = _across(shared, places, classes, shelves)
    links = links.unionByName(written(_confirmed_on_shelves(asked, texts, places, shelves, words), "links"))
    places = components(links)
    found = written(classes.join(places, "node", "left").select(
        "node", "rep", F.coalesce("root", "node").alias("root")), "found")
    smallest = found.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = found.join(smallest, "root").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", component.alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def row_key() -> Column:
    """A number of a row's id and text; only repeated rows share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def survivors(docs: DataFrame, words: int = 5) -> DataFrame:
    """row (by ``row_key``), n (rows of ``docs`` that share it) and kept of every text with a word.

    Rows without an id, and rows of different texts under one id, are compared like all others.
    One key of each component is kept: that of the smallest id, nulls last, then the smallest key.
    """
    keyed = docs.select(row_key().alias("doc_id"), "text")
    found = near_duplicates(keyed, words).where("n_shingles > 0").select(
        F.col("doc_id").alias("row"), "component_id").distinct()
    counted = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row")).agg(
        F.count("*").alias("n"))
    rows = written(counted.join(found, "row"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    first = rows.groupBy("component_id").agg(F.min(order)["row"].alias("first"))
    return rows.join(first, "component_id").select("row", "n", (F.col("row") == F.col("first")).alias("kept"))


def _of_class(rows: DataFrame, words: int) -> DataFrame:
    """(node, text, wide), one a class: of rows that share an id, only one whose set is the class's."""

    def fitting(batches):
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            nodes, wide = batch.column("node").to_pylist(), []
            for a, b in chunks(texts):
                for node, values in zip(nodes[a:b], shingles(texts[a:b], words, powers)):
                    fits = len(values) and set_number(values) == node
                    wide.append(wide_signature(values) if fits else None)
            out = pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("text"), pa.array(wide, pa.binary())], names=["node", "text", "wide"])
            yield out.filter(np.array([w is not None for w in wide], bool))

    fits = rows.select("node", "text").mapInArrow(fitting, "node bigint, text string, wide binary")
    return fits.dropDuplicates(["node"])
