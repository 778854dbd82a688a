"""Repair of conversations: the cheapest edits that give their turns a legal order of roles.

Every row of a conversation becomes one sign: the initial of its role and its fault. The signs of a
conversation are read from the end, so conversations that end alike share all they have in
common there: the automaton over them has one node per distinct ending. For each node and
each state of the role grammar, the cost to go and the edit that begins the best way on are
worked out once. Spark sorts the sign strings from their ends and deals ranges of them to tasks; a
task then meets the endings in order and holds only the path of nodes of the string at hand. A string that
a large part of all conversations share may span several ranges, as the conversation's id is part
of the order, so it needs no task of its own.

Roles must read ``(s?(ua)+)?`` by their initials. Keep costs 0, Rerole (to user or assistant) 1, Delete 2,
Insert (an empty turn of user or assistant) 5; a truncated row that stays costs 5 more; blank and duplicate rows
must go. Of edits of equal cost those whose initials sort first win. Two edits of one state never
share an initial, so the first one settles a tie and no audit strings are compared.

What moves: rows without their texts twice (once to find duplicates by digest, once per conversation), signs
once, and for ``repaired`` the rows with texts once. A task holds one byte per row of the conversation
at hand, as many as its audit has, and never its texts; the digest of a conversation reads them in order.
Finding duplicates and ordering rows are sorts, which Spark spills.

Rows are ordered by turn, nulls first, then by role and by a digest of role and text. Null role or
text counts as one space, so such a text is blank. A null conversation id is a conversation of its own.
Repeated rows are duplicates of the first. ``turn`` may be null everywhere. Conversations without any rows left have
no faults, an empty audit and the hash of nothing. Empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

# --- fixed values: costs, role grammar and blank characters ---
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK = " \t\n\x0b\x0c\r"
START, AFTER_SYSTEM, AFTER_USER, AFTER_PAIR = range(4)
STEPS = {"s": {START: AFTER_SYSTEM}, "a": {AFTER_USER: AFTER_PAIR},
         "u": {START: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_PAIR: AFTER_USER}}
LEGAL_PAIRS = ("su", "ua", "au")
# --- end of fixed values ---

STATES = (START, AFTER_SYSTEM, AFTER_USER, AFTER_PAIR)
ACCEPTED = (START, AFTER_PAIR)
# The role a state goes on with, other than by a system row, and the state that follows.
NEXT = {q: ("assistant", AFTER_PAIR) if q == AFTER_USER else ("user", AFTER_USER) for q in STATES}

# Signs: the initial (``o`` for any other) of a sound row, in capitals if truncated; ``x`` must go.
MUST_GO, OTHER = "x", "o"
SIGNS = "suaoSUAOx"

_FAR = 1 << 60
_ORDER = ("turn", "role", "digest", "copy")

SIGNED = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "signs binary, ending binary")
JUDGED = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "cost bigint, audit string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as a faulty export would leave them, by a checksum of conversation and turn;
    ``lost`` marks rows that are gone."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        shown("role").alias("role"), shown("text").alias("text"))
    return rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), (fate == 0).alias("lost"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def as_read(conversations: DataFrame) -> DataFrame:
    """The rows of a table of conversations (conv_id, turn, role, text) as they are."""
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.lit(False).alias("lost"), F.lit(0).alias("copy"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256))


def faults(rows: DataFrame) -> DataFrame:
    """Rows without their texts: place, initial, and the first fault of each."""
    ended = F.rtrim("text", F.lit(BLANK))
    facts = rows.select(
        "conv_id", "turn", "role", "lost", "copy", _digest().alias("digest"),
        (ended == "").alias("is_blank"), F.substring(ended, -1, 1).isin(".", "!", "?").alias("ends"))
    alike = Window.partitionBy("conv_id", "digest", "lost").orderBy(F.col("turn").asc_nulls_first(), "copy")
    fault = (
        F.when(F.col("lost"), "lost").when(F.col("is_blank"), "blank")
        .when(F.row_number().over(alike) > 1, "duplicate").when(~F.col("ends"), "truncated").otherwise(""))
    return facts.select("conv_id", "turn", "role", "digest", "copy", F.substring("role", 1, 1).alias("initial"),
                        fault.alias("fault"))


def signed(rows: DataFrame, name: str = "conv_id") -> DataFrame:
    """A row per conversation: what is wrong with it, its signs, and its signs from the end."""
    def run(batches):
        import pyarrow as pa

        def closed(key, turns, seen, signs, illegal):
            low, high, distinct = turns
            sizes = 0 if low is None else high - low + 1 - distinct
            signs = bytes(signs)
            return (key, sizes, *seen, illegal, signs, signs[::-1])

        def table(found):
            kinds = [pa.int64()] * 6 + [pa.binary()] * 2
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signs", "ending"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names=names)

        known = {f: i for i, f in enumerate(("blank", "duplicate", "truncated"))}
        open_, key, found = False, None, []
        turns, seen, signs, illegal, last = (None, None, 0), [0, 0, 0], bytearray(), 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")]
            for conv, turn, initial, fault in zip(*columns):
                if not open_ or conv != key:
                    if open_:
                        found.append(closed(key, turns, seen, signs, illegal))
                    open_, key = True, conv
                    turns, seen, signs, illegal, last = (None, None, 0), [0, 0, 0], bytearray(), 0, None
                if fault == "lost":
                    continue
                if turn is not None and turn != turns[1]:  # turns rise
                    turns = (turn if turns[0] is None else turns[0], turn, turns[2] + 1)
                if last is not None and last + initial not in LEGAL_PAIRS:
                    illegal += 1
                last = initial
                if fault:
                    seen[known[fault]] += 1
                sign = initial if initial in ("s", "u", "a") else OTHER
                sign = MUST_GO if fault in ("blank", "duplicate") else sign.upper() if fault else sign
                signs += sign.encode()
            if len(found) >= 4096:
                yield table(found)
                found = []
        if open_:
            found.append(closed(key, turns, seen, signs, illegal))
        if found:
            yield table(found)

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "copy"]
    dealt = faults(rows).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "initial", "fault").mapInArrow(run, SIGNED)


class Endings:
    """Nodes of the automaton on the way of one string of signs, from its end. Strings must come
    sorted from their ends: a node is then worked out once, when first met."""

    def __init__(self) -> None:
        self.string = b""
        self.cost = [array("q", [_FAR]) for _ in STATES]
        self.edit = [bytearray(b" ") for _ in STATES]
        for q in ACCEPTED:
            self.cost[q][0] = 0
        self.nodes = 0
        self._insert(0)

    def _insert(self, node: int) -> None:
        """Ways that begin with inserted turns; two in a row are the most that can pay."""
        for _ in range(2):
            for q in STATES:
                way = self.cost[NEXT[q][1]][node] + INSERT
                if (way, b"I"[0]) < (self.cost[q][node], self.edit[q][node]):
                    self.cost[q][node], self.edit[q][node] = way, b"I"[0]

    def _node(self, sign: str) -> None:
        after = len(self.cost[0]) - 1
        for q in STATES:
            ways = [(DELETE + self.cost[q][after], b"D"[0])]
            if sign != MUST_GO:
                stays = TRUNCATED if sign.isupper() else 0
                if (to := STEPS.get(sign.lower(), {}).get(q)) is not None:
                    ways.append((stays + self.cost[to][after], b"K"[0]))
                ways.append((stays + REROLE + self.cost[NEXT[q][1]][after], b"R"[0]))
            cost, edit = min(ways)
            self.cost[q].append(cost)
            self.edit[q].append(edit)
        self.nodes += 1
        self._insert(after + 1)

    def meet(self, ending: bytes) -> None:
        """Go to the node of ``ending``, from the one it has in common with the string before."""
        shared, most = 0, min(len(ending), len(self.string))
        if self.string[:most] == ending[:most]:
            shared = most
        else:
            low = 0  # the borders of a match, halved
            while low < most:
                half = (low + most + 1) // 2
                low, most = (half, most) if self.string[:half] == ending[:half] else (low, half - 1)
            shared = low
        for q in STATES:
            del self.cost[q][shared + 1:]
            del self.edit[q][shared + 1:]
        for sign in ending[shared:].decode():
            self._node(sign)
        self.string = ending

    def best(self) -> tuple[int, str]:
        """Cost and audit of the string at hand."""
        q, node, audit = START, len(self.string), bytearray()
        while node or q not in ACCEPTED:
            edit = self.edit[q][node]
            audit.append(edit)
            if edit == b"K"[0]:
                q = STEPS[chr(self.string[node - 1]).lower()][q]
            elif edit != b"D"[0]:
                q = NEXT[q][1]
            node -= edit != b"I"[0]
        return self.cost[START][len(self.string)], audit.decode()


def judged(signs: DataFrame) -> DataFrame:
    """``signs`` with cost and audit. ``signs`` should be a written table, as ranges are sampled."""
    def run(batches):
        import pyarrow as pa

        automaton, best = Endings(), (0, "")
        for batch in batches:
            found = []
            for ending in batch.column("ending").to_pylist():
                if ending != automaton.string:
                    automaton.meet(ending)
                    best = automaton.best()
                found.append(best)
            columns = [batch.column(i) for i in range(6)]
            columns += [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())]
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = signs.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "ending")
    dealt = kept.repartitionByRange("ending", "conv_id").sortWithinPartitions("ending", "conv_id")
    return dealt.mapInArrow(run, JUDGED)


def judge(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows``: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    return judged(written(signed(rows), "signs"))


def _edited(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of a conversation after its audit, conversation by conversation, in order."""
    told = verdicts.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("copy"), F.col("audit").alias("text"))
    turns = rows.where(~F.col("lost")).select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "copy", "text")
    order = [F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "digest", "copy"]
    both = told.unionByName(turns).repartition("conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "kind", "role", "text")


class Edits:
    """Turns of one conversation after its audit, from its rows in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = NEXT[self.state]
            self.at += 1
            yield role, ""

    def row(self, role: str, text: str):
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[role[:1]][self.state]
            yield role, text
        elif edit == "R":
            role, self.state = NEXT[self.state]
            yield role, text

    def end(self):
        yield from self._inserted()


def repaired(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""
    def run(batches):
        import pyarrow as pa

        edits = key = None
        place = 0
        for batch in batches:
            out = []

            def add(turns):
                nonlocal place
                for role, text in turns:
                    out.append((key, place, role, text))
                    place += 1

            for conv, kind, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if kind == 0:
                    if edits:
                        add(edits.end())
                    edits, key, place = Edits(text), conv, 0
                else:
                    add(edits.row(role, text))
            if out:
                yield _turns(pa, out)
        if edits:
            out = [(key, place + i, role, text) for i, (role, text) in enumerate(edits.end())]
            if out:
                yield _turns(pa, out)

    return _edited(rows, verdicts).mapInArrow(run, "conv_id bigint, place bigint, role string, text string")


def _turns(pa, rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "role", "text"])


def digests(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: the hash of the repaired ``role:text``, newline-joined, read in order."""
    def run(batches):
        import pyarrow as pa

        edits = key = state = None
        first = True

        def add(turns):
            nonlocal first
            for role, text in turns:
                state.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        def table(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())],
                names=["conv_id", "repaired_sha256"])

        for batch in batches:
            found = []
            for conv, kind, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if kind == 0:
                    if edits:
                        add(edits.end())
                        found.append((key, state.hexdigest()))
                    edits, key, state, first = Edits(text), conv, hashlib.sha256(), True
                else:
                    add(edits.row(role, text))
            if found:
                yield table(found)
        if edits:
            add(edits.end())
            yield table([(key, state.hexdigest())])

    return _edited(rows, verdicts).mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def with_digests(rows: DataFrame) -> DataFrame:
    """``judge`` with repaired_sha256. Both sides hold a conversation once and meet by its id."""
    verdicts = written(judge(rows), "verdicts")
    hashes = digests(rows, verdicts).withColumnRenamed("conv_id", "hashed_id")
    met = verdicts.join(hashes, F.col("conv_id").eqNullSafe(F.col("hashed_id")))
    return met.drop("hashed_id")
