import hashlib
import itertools
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repair
from tidemark.session import written

BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    """Rows of one conversation, as the operator's ``damaged`` states them, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else text.translate(str.maketrans("", "", ".!?")) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    digest = lambda r, t: hashlib.sha256(f"{r}\0{t}".encode()).digest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ended = text.rstrip(BLANK)
        out.append("blank" if not ended else "duplicate" if (role, text) in seen
                   else "truncated" if ended[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def legal(initials):
    body = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (body != "" and body == "ua" * (len(body) // 2))


def search(rows, found, inserts=3):
    """Every way of editing, by its audit; the cheapest, then the one that sorts first."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(found, edits)):
            continue
        cost = sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (f == "truncated" and e != "D") for f, e in zip(found, edits))
        for count in range(inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), count):
                audit, turns = "", []
                for i in range(len(rows) + 1):
                    here = places.count(i)
                    audit += "I" * here
                    turns += [("?", "")] * here
                    if i < len(rows):
                        audit += edits[i]
                        if edits[i] != "D":
                            turns.append((rows[i][1] if edits[i] == "K" else "?", rows[i][2]))
                system = bool(turns) and turns[0][0][:1] == "s"
                roles = [r if r != "?" else ("user", "assistant")[(i - system) % 2] for i, (r, _) in enumerate(turns)]
                if legal("".join(r[:1] or "-" for r in roles)):
                    way = (cost + 5 * count, audit, [(r, t) for r, (_, t) in zip(roles, turns)])
                    best = way if best is None or way[:2] < best[:2] else best
    return best


def expected(conv, rows):
    left = damage(rows)
    found = faults(left)
    turns = [t for t, _, _ in left if t is not None]
    initials = [r[:1] for _, r, _ in left]
    cost, audit, turns_out = search(left, found)
    return {
        "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: found.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns_out).encode()).hexdigest()}


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r)[:4])
    return out


ROWS = [
    (1, 0, "system", "Rules."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes!"), (1, 3, "user", "More"),
    (2, 0, "assistant", "First."), (2, 1, "assistant", "Second."), (2, 2, "user", "Third?"),
    (3, None, "user", "No turn."), (3, None, "assistant", "None."), (3, 5, "tool", "Out."), (3, 9, "assistant", "In."),
    (4, 0, None, "No role."), (4, 1, "", "Empty role."), (4, 2, "user", None), (4, 3, "user", ""),
    (None, 0, "user", "Lost id."), (None, 1, "assistant", "So is this."), (None, None, None, None),
    (5, 1, "user", "Same."), (5, 2, "user", "Same."), (5, 2, "user", "Same."), (5, 4, "user", "Same!  \n"),
    (6, 7, "system", "Alone."), (7, 1, "user", "x" * 5000), (7, 2, "assistant", "y" * 5000 + "."),
] + [(100 + c, t, ("user", "assistant", "system")[(c * t + t // 2) % 3], f"Words {c % 4} {t % 3}" + "." * (t % 2))
     for c in range(40) for t in range(c % 6)]


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(
        [(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, signs string, kind int"
    ).repartition(3)


def test_every_way_of_editing_was_tried(conversations):
    found = {r.conv_id: r.asDict() for r in repair.with_digests(repair.damaged(conversations)).collect()}
    due = {c: expected(c, rows) for c, rows in by_conversation(ROWS).items()}
    assert found == due


def test_repaired_rows_read_legally_and_match_their_digest(spark, conversations):
    rows = repair.damaged(conversations)
    verdicts = written(repair.judge(rows), "verdicts")
    turns = {}
    for r in repair.repaired(rows, verdicts).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(r)
    for r in repair.with_digests(rows).collect():
        mine = turns.get(r.conv_id, [])
        assert [t.place for t in mine] == list(range(len(mine)))
        assert legal("".join(t.role[:1] for t in mine))
        text = "\n".join(f"{t.role}:{t.text}" for t in mine)
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256


def test_undamaged_reading(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")],
                                 "conv_id long, turn long, role string, text string")
    (only,) = repair.judge(repair.as_read(rows)).collect()
    assert (only.cost, only.audit) == (0, "KK")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from(repair.SIGNS), max_size=4), max_size=8))
def test_automaton(strings):
    automaton, nodes = repair.Endings(), set()
    for ending in sorted(s.encode()[::-1] for s in strings):
        automaton.meet(ending)
        nodes |= {ending[:i] for i in range(1, len(ending) + 1)}
        signs = ending.decode()[::-1]
        roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
        rows = [(i, roles.get(x.lower(), "user"), "") for i, x in enumerate(signs)]
        found = ["blank" if x == "x" else "truncated" if x.isupper() else "" for x in signs]
        assert automaton.best() == search(rows, found)[:2]
    assert automaton.nodes == len(nodes)  # each ending once


def test_long_conversation_holds_no_texts(spark):
    rows = spark.range(20_000).selectExpr(
        "7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role",
        "concat('turn ', id, IF(id % 97 = 0, '', '.')) AS text")
    (only,) = repair.with_digests(repair.as_read(rows)).collect()
    assert len(only.audit) >= 20_000 and only.truncated == 207 and only.illegal == 0 and only.cost == 207 * 4


def test_empty(conversations):
    assert repair.with_digests(repair.damaged(conversations.limit(0))).count() == 0
