"""SQL for the operators that SQL can state, over the same tables."""

from __future__ import annotations

# Smallest id reachable over the links (a, b) among nodes (id); both directions are listed.
_REACH = """reach(id, seen) AS (
  SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen),
named AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A checksum of short ASCII text, for the query below.
_CRC = """list_reduce(list_transform(string_split({key}, ''), lambda ch: CAST(ord(ch) AS BIGINT)),
  lambda acc, b: xor(acc // 256, steps256[xor(acc % 256, b) + 1]), 4294967295)"""
_CRC_STEPS = """(SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, n)) AS steps256)"""


def _repair() -> str:
    """The cheapest edits by a recursion over the turns from the last one. A way is text: its cost in
    ten digits, its audit, a sign below all letters, the repaired turns; so the least text is the best way."""
    follows = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    kept = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}

    def way(value: str, cost: str, edit: str, turn: str | None = None) -> str:
        body = f"substr({value}, instr({value}, chr(1)) + 1)"
        if turn is not None:
            body = f"{turn} || CASE WHEN {body} = '' THEN '' ELSE chr(10) || {body} END"
        return (f"(printf('%010d', CAST(left({value}, 10) AS BIGINT) + {cost}) || '{edit}' || "
                f"substr({value}, 11, instr({value}, chr(1)) - 10) || {body})")

    def row(q: int) -> str:
        role, to = follows[q]
        keep = " ".join(f"""WHEN initial = '{i}' THEN {way(f"v{n}", "stays", "K", "role || ':' || text")}"""
                        for i, n in kept[q])
        rerole = way(f"v{to}", "stays + 1", "R", f"'{role}:' || text")
        return (f"least({way(f'v{q}', '2', 'D')}, CASE WHEN goes THEN 'none' ELSE {rerole} END, "
                f"CASE WHEN goes THEN 'none' {keep} ELSE 'none' END) AS g{q}")

    def inserted(source: str, target: str) -> str:
        ways = {q: way(f"{source}{to}", "5", "I", f"'{role}:'") for q, (role, to) in follows.items()}
        return ", ".join(f"least(g{q}, {w}) AS {target}{q}" for q, w in ways.items())

    first = ("printf('%010d', 0) || chr(1)",
             "printf('%010d', 10) || 'II' || chr(1) || 'user:' || chr(10) || 'assistant:'",
             "printf('%010d', 5) || 'I' || chr(1) || 'assistant:'", "printf('%010d', 0) || chr(1)")
    crc = _CRC.format(key="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, (4294967295 - {crc}) % 20 AS fate
  FROM conversations, {_CRC_STEPS}),
rows_left AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, copy,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM base, (VALUES (0), (1)) c(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
seen AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, {blanks}) AS ended,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM rows_left),
faulty AS (
  SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS breaks
  FROM seen),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (breaks) AS illegal
  FROM faulty GROUP BY conv_id),
signs AS (
  SELECT conv_id, i, role, text, initial, fault IN ('blank', 'duplicate') AS goes,
    CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS stays FROM faulty),
ways(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n, {', '.join(first)} FROM counts
  UNION ALL
  SELECT conv_id, i, {inserted('h', 'v')} FROM (
    SELECT conv_id, i, g0, g1, g2, g3, {inserted('g', 'h')} FROM (
      SELECT w.conv_id, w.i - 1 AS i, {', '.join(row(q) for q in follows)}
      FROM ways w JOIN signs s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i))),
best AS (SELECT conv_id, v0 FROM ways WHERE i = 0)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(v0, 10) AS BIGINT), 0) AS cost, coalesce(substr(v0, 11, instr(v0, chr(1)) - 11), '') AS audit,
  sha256(coalesce(substr(v0, instr(v0, chr(1)) + 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE = {
    "op1_vectors": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
{_REACH}
SELECT n.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = n.id) AS n_links, component_id,
  n.id = component_id AS kept
FROM named n""",
    "op4_minhash": f"""WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM worded),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y
    ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
{_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN named ON id = doc_id""",
    "op10_suffixes": """WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS string FROM (
    SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM bytes)),
firsts AS (SELECT string, min(doc_id) AS low FROM starts GROUP BY string),
gone AS (SELECT doc_id, i FROM starts JOIN firsts USING (string) WHERE low < doc_id),
marked AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER w > 50, true) AS fresh FROM gone
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span),
pieces AS (
  SELECT doc_id, a, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS piece
  FROM spans JOIN bytes USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS head FROM pieces GROUP BY doc_id),
removed AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS spans, max(b) AS last FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_repair": _repair(),
    "op13_fim": r"""WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, t, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(t) + 1) AS x,
    CAST('0x' || h[9:16] AS BIGINT) % (len(t) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:least(x, y)], '') AS p,
    array_to_string(t[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(t[greatest(x, y) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts""",
}
