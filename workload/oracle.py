"""Plain SQL that states what each query must return, without any of the encoding.

The change relation is written out here a second time, straight from the tables, so the
jobs are compared with an independent description.
"""

from __future__ import annotations

from tidemark.schemas import ENTITIES, ORDERS, PAYMENTS, REFUNDS, Entity

_DELETED_IN = {"orders": 12, "payments": 11, "refunds": 10}

_TRAITS = """
  SELECT o_orderkey AS k, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    o_orderstatus AS kind, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS depth,
    o_orderdate AS day, (o_orderstatus = 'P' AND month(o_orderdate) = {month}) AS deleted,
    month(o_orderdate) = 6 AS redelivered, month(o_orderdate) = 3 AS mirrored
  FROM orders"""

_LIVES = {
    "orders": """
  SELECT t.*, CAST(k AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS ref FROM ({traits}) t""",
    "payments": """
  SELECT t.*, 'P' || CAST(k AS VARCHAR) AS id, CAST(k AS VARCHAR) AS ref FROM ({traits}) t""",
    "refunds": """
  SELECT t.* REPLACE (r.refund_cents AS cents), 'R' || CAST(k AS VARCHAR) AS id,
    'P' || CAST(k AS VARCHAR) AS ref
  FROM ({traits}) t JOIN (
    SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS refund_cents
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) r ON r.l_orderkey = t.k""",
}


def _lives(entity: Entity) -> str:
    traits = _TRAITS.format(month=_DELETED_IN[entity.name])
    return _LIVES[entity.name].format(traits=traits)


# A normalised event, in the column order of the jobs.
_EVENT = """{key}, {ref}, {status}, amount, created_at, updated_at, cdc_operation, source_lsn,
  source_tx_id, source_sequence, source_ts_ms, cdc_ts_ms, topic, kafka_partition, "offset",
  kafka_timestamp_utc"""


def _states(entity: Entity) -> str:
    return "[" + ", ".join(f"'{s}'" for s in entity.states) + "]"


def records(entity: Entity) -> str:
    """Every record of the topic; ``tombstone`` marks the ones without a value."""
    return f"""(
SELECT '{entity.topic}' AS topic, CAST(k % 6 AS INTEGER) AS kafka_partition,
  (k // 6) * 8 + CASE WHEN mirrored THEN 7 - slot ELSE slot END AS "offset",
  day + to_hours(CAST(slot AS BIGINT)) + INTERVAL 1 SECOND AS kafka_timestamp_utc,
  CAST(date_trunc('quarter', day) AS DATE) AS ingestion_date_utc,
  '{{"{entity.key}":"' || id || '"}}' AS key_raw, slot = 6 AS tombstone, kind <> 'F' AS wrapped,
  id AS {entity.key}, ref AS {entity.ref}, ({_states(entity)})[img + 1] AS {entity.status},
  CASE WHEN src > 0 THEN ({_states(entity)})[CASE WHEN src = 5 THEN depth ELSE src - 1 END + 1]
    END AS before_status,
  CASE WHEN src <> 5 THEN ({_states(entity)})[src + 1] END AS after_status,
  CASE WHEN src <> 5 THEN id END AS after_id,
  (cents + img * 100) / CAST(100 AS DOUBLE) AS amount,
  day AS created_at, day + to_hours(CAST(img AS BIGINT)) AS updated_at,
  CASE WHEN src = 5 THEN 'd' WHEN src > 0 THEN 'u' WHEN kind = 'F' THEN 'r' ELSE 'c' END
    AS cdc_operation,
  k * 1000 + src AS source_lsn, k * 10 + src AS source_tx_id,
  '[null,"' || CAST(k * 1000 + src AS VARCHAR) || '"]' AS source_sequence,
  epoch_ms(day) + src * 3600000 AS source_ts_ms, epoch_ms(day) + src * 3600000 + 250 AS cdc_ts_ms
FROM (
  SELECT *, CASE WHEN src = 5 THEN depth ELSE src END AS img FROM (
    SELECT *, CASE WHEN slot = 7 THEN CASE WHEN deleted THEN 5 ELSE depth END ELSE slot END AS src
    FROM ({_lives(entity)}
    ) lives, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS slot) slots
    WHERE slot <= depth OR (slot IN (5, 6) AND deleted) OR (slot = 7 AND redelivered))))"""


def events(entity: Entity) -> str:
    columns = _EVENT.format(key=entity.key, ref=entity.ref, status=entity.status)
    return f"(SELECT {columns} FROM {records(entity)} WHERE NOT tombstone)"


def current(entity: Entity) -> str:
    columns = _EVENT.format(key=entity.key, ref=entity.ref, status=entity.status)
    return f"""(SELECT {columns} FROM (
  SELECT *, row_number() OVER (
    PARTITION BY {entity.key} ORDER BY source_lsn DESC NULLS LAST, "offset" DESC) AS rn
  FROM {events(entity)}) WHERE rn = 1)"""


def _all(template: str) -> str:
    """``template`` for every entity, united."""
    return " UNION ALL ".join(template.format(records=records(e), events=events(e))
                              for e in ENTITIES.values())


def _identity(entity: Entity) -> str:
    return (f'SELECT topic, kafka_partition, "offset", kafka_timestamp_utc, key_raw '
            f"FROM {records(entity)}")


_VERDICT = """SELECT '{name}' AS dataset, ingestion_date_utc AS partition_date, 'COMPLETED' AS status,
  '{operation}' AS operation, {files} AS input_files, CAST(1 AS BIGINT) AS output_files,
  count(*) AS input_rows, count(*) AS output_rows, 'PASSED' AS validation, true AS published
FROM {records} GROUP BY ALL"""

# A quarter in which an order was deleted loses tombstones in the lossy publication.
_REJECTED = f"""SELECT ingestion_date_utc AS partition_date, count(*) AS input_rows,
  count(*) FILTER (NOT tombstone) AS output_rows, bool_or(tombstone) AS lossy
FROM {records(ORDERS)} GROUP BY ALL"""

_AMOUNTS = {"orders": ("o_orderkey", "o_totalprice"), "customer": ("c_custkey", "c_acctbal"),
            "supplier": ("s_suppkey", "s_acctbal")}


def _amounts() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS source, {key} AS id,
  CAST(CAST({amount} AS DECIMAL(10,2)) AS VARCHAR) AS amount,
  CAST(CAST({amount} AS DECIMAL(10,2)) AS VARCHAR) AS wide_amount FROM {name}"""
        for name, (key, amount) in _AMOUNTS.items())


_FINGERPRINT = """SELECT topic, kafka_partition, count(*) AS row_count, min("offset") AS min_offset,
  max("offset") AS max_offset FROM {source} GROUP BY topic, kafka_partition"""


def _fingerprint_diff() -> str:
    sent = " UNION ALL ".join(_FINGERPRINT.format(source=records(e)) for e in ENTITIES.values())
    kept = f"(SELECT * FROM {records(ORDERS)} WHERE NOT tombstone)"
    doubled = f"(SELECT * FROM {records(REFUNDS)} UNION ALL SELECT * FROM {records(REFUNDS)})"
    arrived = " UNION ALL ".join(
        _FINGERPRINT.format(source=s) for s in (kept, records(PAYMENTS), doubled))
    return f"""SELECT topic, kafka_partition, i.row_count AS input_row_count,
  i.min_offset AS input_min_offset, i.max_offset AS input_max_offset,
  o.row_count AS output_row_count, o.min_offset AS output_min_offset,
  o.max_offset AS output_max_offset
FROM ({sent}) i FULL JOIN ({arrived}) o USING (topic, kafka_partition)
WHERE i.row_count IS DISTINCT FROM o.row_count OR i.min_offset IS DISTINCT FROM o.min_offset
  OR i.max_offset IS DISTINCT FROM o.max_offset"""


def _admission() -> str:
    return """WITH states AS (
  SELECT 'user' || CAST(user_id AS VARCHAR) AS dataset, CAST(ts AS DATE) AS partition_date,
    event_id AS seq, ts AS started_at,
    CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED'
      WHEN 'view' THEN 'PAUSED' ELSE 'RUNNING' END AS status
  FROM events),
wanted AS (
  SELECT dataset, partition_date FROM states
  UNION SELECT dataset, CAST(partition_date + INTERVAL 1 DAY AS DATE) FROM states),
in_force AS (
  SELECT * FROM states
  QUALIFY row_number() OVER (PARTITION BY dataset, partition_date ORDER BY seq DESC) = 1)
SELECT w.dataset, w.partition_date, s.status, coalesce(s.seq, 0) AS seq,
  CASE WHEN s.seq IS NULL THEN 'RUN' WHEN s.status = 'COMPLETED' THEN 'SKIP_COMPLETED'
    WHEN s.status = 'FAILED' THEN 'RETRY_FAILED'
    WHEN s.status = 'RUNNING' AND s.started_at > TIMESTAMP '2024-01-30 19:30:00'
      THEN 'SKIP_RUNNING'
    WHEN s.status = 'RUNNING' THEN 'RETRY_STALE' ELSE 'UNKNOWN_STATUS' END AS verdict
FROM wanted w LEFT JOIN in_force s USING (dataset, partition_date)"""


def _domain_audit(with_customers: bool) -> str:
    states = ", ".join(f"'{s}'" for s in ORDERS.states)
    others = """ UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, c_acctbal, NULL, NULL, 'x',
    'customer', c_nationkey, c_custkey FROM customer""" if with_customers else ""
    mixed = f"""(SELECT id_order, id_client, status_order, amount, created_at, updated_at,
    cdc_operation, topic, kafka_partition, "offset" FROM {events(ORDERS)}{others})"""
    rules = {
        "status_domain": f"status_order NOT IN ({states})",
        "amount_bound": "amount < 0",
        "operation_domain": "cdc_operation NOT IN ('c', 'r', 'u', 'd')",
    } | {f"{c}_not_null": f'"{c}" IS NULL' for c in (
        "id_order", "id_client", "status_order", "amount", "created_at", "updated_at",
        "topic", "kafka_partition", "offset")}
    counts = ", ".join(f"count(*) FILTER ({cond}) AS {name}" for name, cond in rules.items())
    listed = " UNION ALL ".join(
        f"SELECT '{name}' AS rule, {name} AS violations FROM counted" for name in rules)
    return f"WITH counted AS (SELECT {counts} FROM {mixed}) {listed}"


def _table_types() -> str:
    types = {f.name: f.dataType.simpleString() for f in ORDERS.event_schema}
    rows = [("history", c, f"'{t}'", f"'{t}'", "ok", f'count("{c}")') for c, t in types.items()]
    rows += [("copy", c, f"'{t}'", f"'{t}'", "ok", f'count("{c}")') for c, t in types.items()
             if c not in ("amount", "updated_at")]
    rows += [("copy", "amount", f"'{types['amount']}'", "'string'", "retyped", "count(amount)"),
             ("copy", "updated_at", f"'{types['updated_at']}'", "CAST(NULL AS VARCHAR)", "missing", "0 * count(*)"),
             ("copy", "note", "CAST(NULL AS VARCHAR)", "'string'", "unexpected", "count(*)")]
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {stated} AS stated, {found} AS found, "
        f"'{verdict}' AS verdict, {n} AS held_values FROM {events(ORDERS)}"
        for t, c, stated, found, verdict, n in rows)


def _referential_audit() -> str:
    o, p, r = (f"(SELECT * FROM {current(e)} WHERE cdc_operation <> 'd')"
               for e in (ORDERS, PAYMENTS, REFUNDS))
    return f"""SELECT 'payments' AS child, id_payment AS child_id, id_order AS parent_id
FROM {p} x WHERE NOT EXISTS (SELECT 1 FROM {o} y WHERE y.id_order = x.id_order)
UNION ALL SELECT 'refunds', id_refund, id_payment
FROM {r} x WHERE NOT EXISTS (SELECT 1 FROM {p} y WHERE y.id_payment = x.id_payment)"""


def _events_sql(entity: Entity, extra: str = "") -> str:
    columns = _EVENT.format(key=entity.key, ref=entity.ref, status=entity.status)
    return f"SELECT {columns}{extra} FROM {records(entity)} WHERE NOT tombstone"


# Blocks of 256 offsets, some of which lose records or hold them twice.
_BLOCK = '("offset" // 256)'


def _damaged(source: str) -> str:
    kept = f"""(SELECT * FROM {source} WHERE NOT ({_BLOCK} % 5 = 2 AND "offset" % 3 = 0))"""
    return f"""(SELECT * FROM {kept} UNION ALL
  SELECT * FROM {kept} WHERE {_BLOCK} % 7 = 3 AND "offset" % 8 = 0)"""


def _copies(source: str, name: str) -> str:
    return f"""(SELECT topic, kafka_partition, "offset", count(*) AS {name} FROM {source} GROUP BY ALL)"""


def _fingerprint_blocks() -> str:
    columns = 'topic, kafka_partition, "offset"'
    sent = f"(SELECT {columns} FROM {records(ORDERS)} UNION ALL SELECT {columns} FROM {records(PAYMENTS)})"
    return f"""SELECT topic, kafka_partition, block * 256 AS from_offset, block * 256 + 255 AS to_offset,
  input_rows, output_rows
FROM (SELECT topic, kafka_partition, {_BLOCK} AS block, CAST(sum(coalesce(a, 0)) AS BIGINT) AS input_rows,
    CAST(sum(coalesce(b, 0)) AS BIGINT) AS output_rows, bool_or(a IS DISTINCT FROM b) AS unlike
  FROM {_copies(sent, 'a')} FULL JOIN {_copies(_damaged(sent), 'b')} USING ({columns}) GROUP BY ALL) WHERE unlike"""


def _layer_reconcile_blocks() -> str:
    sent = f"(SELECT * FROM {records(ORDERS)} WHERE NOT tombstone)"
    return f"""SELECT topic, kafka_partition, "offset", coalesce(a, 0) AS left_copies, coalesce(b, 0) AS right_copies,
  CASE WHEN b IS NULL THEN 'lost' WHEN a IS NULL THEN 'unexpected' WHEN b > a THEN 'doubled' ELSE 'fewer' END AS verdict
FROM {_copies(sent, 'a')} FULL JOIN {_copies(_damaged(sent), 'b')} USING (topic, kafka_partition, "offset")
WHERE a IS DISTINCT FROM b"""


_EVERY_OFFSET = " UNION ALL ".join(
    f'SELECT topic, kafka_partition, "offset" FROM {records(e)}' for e in (ORDERS, PAYMENTS, REFUNDS, REFUNDS))

_OFFSET_GAPS = f"""SELECT topic, kafka_partition, "offset" + 1 AS from_offset, following - 1 AS to_offset,
  following - "offset" - 1 AS missing
FROM (SELECT *, lead("offset") OVER (PARTITION BY topic, kafka_partition ORDER BY "offset") AS following
  FROM (SELECT DISTINCT * FROM ({_EVERY_OFFSET}))) WHERE following - "offset" > 1"""

# Of copies of one change the one of the latest offset stays.
_CHANGES = f"""(SELECT * FROM {events(ORDERS)}
  QUALIFY row_number() OVER (PARTITION BY id_order, source_lsn ORDER BY "offset" DESC) = 1)"""

_VERSIONS = f"""SELECT id_order, status_order, cdc_operation, source_lsn, "offset",
  lead(source_lsn) OVER (PARTITION BY id_order ORDER BY source_lsn) AS valid_to_lsn FROM {_CHANGES}"""

_AT_POSITION = f"""SELECT id_order, status_order, cdc_operation, source_lsn FROM (
  SELECT * FROM {_CHANGES} WHERE source_lsn <= (SELECT max(o_orderkey) * 500 + 2 FROM orders)
  QUALIFY row_number() OVER (PARTITION BY id_order ORDER BY source_lsn DESC) = 1) WHERE cdc_operation <> 'd'"""

_AS_OF = f"""SELECT p.id_payment, p.id_order, p.status_payment, p.source_lsn, p."offset", o.status_order,
  o.source_lsn AS order_lsn, o."offset" AS order_offset
FROM {events(PAYMENTS)} p ASOF LEFT JOIN (SELECT * FROM {_CHANGES} WHERE source_lsn % 1000 <> 0) o
  ON p.id_order = o.id_order AND p.source_lsn >= o.source_lsn"""


def _envelope_drift() -> str:
    found = [  # partition, path, found, expected, condition
        *[(1, f"$.{side}.state_order", "STRING", None, given) for side, given in (
            ("before", "before_status IS NOT NULL"), ("after", "after_id IS NOT NULL"))],
        *[(2, f"$.{side}.amount", "DECIMAL", "STRING", given) for side, given in (
            ("before", "before_status IS NOT NULL"), ("after", "after_id IS NOT NULL"))],
        (3, "$.source.lsn", "STRING", "BIGINT", "true"),
        *[(4, "$.extra.a[]", kind, None, "true") for kind in ("BIGINT", "STRING", "OBJECT")]]
    parts = [f"""SELECT topic, '{path}' AS path, '{kind}' AS found,
  {f"'{expected}'" if expected else 'CAST(NULL AS VARCHAR)'} AS expected,
  '{'retyped' if expected else 'unknown'}' AS verdict, count(*) AS occurrences, min(kafka_timestamp_utc) AS first_seen
FROM {records(ORDERS)} WHERE NOT tombstone AND kafka_partition = {partition} AND {given} GROUP BY topic"""
             for partition, path, kind, expected, given in found]
    parts.append("""SELECT 'documents', '$', NULL, 'OBJECT', 'unreadable', count(*), CAST(NULL AS TIMESTAMP)
FROM documents WHERE text IS NOT NULL""")
    return " UNION ALL ".join(parts)


ORACLE = {
    "raw_landing_projection": f"""SELECT topic, kafka_partition, "offset", kafka_timestamp_utc,
  key_raw, NOT tombstone AS has_value FROM {records(ORDERS)}""",
    "raw_landing_stream": _identity(ORDERS),
    "stream_available_now": _identity(PAYMENTS),
    "stream_restart_no_dup": f"""SELECT topic, kafka_partition, "offset",
  CAST(1 AS BIGINT) AS copies FROM {records(ORDERS)}""",
    "stream_killed_before_commit": f"""SELECT topic, kafka_partition, "offset",
  CAST(1 AS BIGINT) AS copies FROM {records(ORDERS)}""",
    "landing_root_scan": f"""SELECT topic, kafka_partition, "offset", kafka_timestamp_utc,
  date_trunc('quarter', kafka_timestamp_utc) AS ingested_at_utc, ingestion_date_utc
FROM {records(ORDERS)}""",
    "landing_partition_scan": f"""SELECT ingestion_date_utc, count(*) AS records,
  count(*) FILTER (NOT tombstone) AS changes FROM {records(PAYMENTS)} GROUP BY 1""",
    "cdc_decode": f"""SELECT topic, kafka_partition, "offset", kafka_timestamp_utc,
  key_raw AS key_json, wrapped, cdc_operation AS op, CAST(source_lsn AS VARCHAR) AS lsn
FROM {records(ORDERS)} WHERE NOT tombstone""",
    "cdc_parse": f"""SELECT topic, kafka_partition, "offset", kafka_timestamp_utc, cdc_operation,
  source_lsn, source_tx_id, source_sequence, source_ts_ms, cdc_ts_ms, before_status,
  after_status, after_id FROM {records(ORDERS)} WHERE NOT tombstone""",
    "cdc_before_after": f"""SELECT topic, kafka_partition, "offset", cdc_operation, id_order,
  id_client, status_order FROM {records(ORDERS)} WHERE NOT tombstone""",
    "cdc_normalize": _events_sql(ORDERS),
    "cdc_quarantine": """SELECT 'documents' AS topic, 'unreadable' AS reject_reason,
  count(*) AS records FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'events', 'unreadable', count(*) FROM events WHERE props IS NOT NULL
""" + " ".join(
        f"UNION ALL SELECT '{topic}', '{reason}', count(*) FROM {records(ORDERS)} WHERE NOT tombstone"
        for topic, reason in (("no_position", "missing_position"), ("no_key", "missing_key"),
                              ("no_time", "bad_timestamp"), ("no_amount", "bad_amount"))),
    "envelope_drift": _envelope_drift(),
    "connect_decimal_decode": _amounts(),
    "op_profile": _all("SELECT topic, cdc_operation, count(*) AS events FROM {events} GROUP BY 1, 2"),
    "orders_current": f"SELECT * FROM {current(ORDERS)}",
    "orders_current_active": f"SELECT * FROM {current(ORDERS)} WHERE cdc_operation <> 'd'",
    "orders_current_shuffled": f"SELECT * FROM {current(ORDERS)}",
    "orders_current_incremental": f"SELECT * FROM {current(ORDERS)}",
    "consolidated_current": f"SELECT * FROM {current(ORDERS)}",
    "payments_current": f"SELECT * FROM {current(PAYMENTS)}",
    "refunds_current": f"SELECT * FROM {current(REFUNDS)}",
    "orders_history": _events_sql(ORDERS),
    "history_reprocess_date": _events_sql(ORDERS, ", ingestion_date_utc"),
    "fingerprint": _all(_FINGERPRINT.replace("{source}", "{records}").replace(
        "AS max_offset", "AS max_offset, true AS hash_agrees")),
    "file_layout": f"""SELECT ingestion_date_utc, CAST(6 AS BIGINT) AS files, true AS sized,
  count(*) AS file_rows FROM {records(ORDERS)} GROUP BY 1""",
    "output_layout": f"""SELECT ingestion_date_utc, CAST(1 AS BIGINT) AS files, true AS sized,
  count(*) AS file_rows FROM {records(ORDERS)} GROUP BY 1""",
    "orders_current_table": f"SELECT * FROM {current(ORDERS)}",
    "orders_versions": _VERSIONS,
    "orders_at_position": _AT_POSITION,
    "orders_as_of": _AS_OF,
    "history_side_by_side": _events_sql(ORDERS, ", ingestion_date_utc"),
    "current_rebuilt_partial_history": f"SELECT * FROM {current(ORDERS)}",
    "history_unique": _events_sql(ORDERS, ", ingestion_date_utc"),
    "current_value_audit": f"""SELECT 'altered' AS verdict, count(*) AS keys
FROM {current(ORDERS)} WHERE status_order = 'CANCELLED' HAVING count(*) > 0""",
    "current_audit": f"""SELECT 'differs' AS verdict, count(*) AS keys
FROM {current(ORDERS)} WHERE cdc_operation = 'd' HAVING count(*) > 0""",
    "publish_doubled": f"""SELECT 'payments' AS dataset, partition_date,
  CASE WHEN doubled > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, 'DO_COMPACTION' AS operation,
  input_rows, input_rows + doubled AS output_rows,
  CASE WHEN doubled > 0 THEN 'FAILED' ELSE 'PASSED' END AS validation, doubled = 0 AS published
FROM (SELECT ingestion_date_utc AS partition_date, count(*) AS input_rows,
  count(*) FILTER ("offset" % 8 = 0) AS doubled FROM {records(PAYMENTS)} GROUP BY 1)""",
    "publish_no_data": f"""SELECT DISTINCT 'payments' AS dataset,
  CAST(ingestion_date_utc + INTERVAL 1 DAY AS DATE) AS partition_date, 'COMPLETED' AS status,
  CAST(NULL AS VARCHAR) AS operation, CAST(0 AS BIGINT) AS input_rows, CAST(0 AS BIGINT) AS output_rows,
  false AS published FROM {records(PAYMENTS)}""",
    "publish_error_captured": f"""SELECT 'refunds' AS dataset, partition_date, 'FAILED' AS status,
  'storage went away' AS error, false AS published
FROM (SELECT DISTINCT ingestion_date_utc AS partition_date FROM {records(REFUNDS)} ORDER BY 1 LIMIT 2)""",
    "orphan_runs": f"""SELECT partition_date, CAST(2 AS BIGINT) AS runs, true AS sized
FROM (SELECT DISTINCT ingestion_date_utc AS partition_date FROM {records(REFUNDS)} ORDER BY 1 LIMIT 2)""",
    "published_after_failed_republish": _identity(PAYMENTS),
    "published_after_late_files": _identity(PAYMENTS),
    "ledger_tie_break": """SELECT 'user' || CAST(user_id AS VARCHAR) AS dataset, CAST(ts AS DATE) AS partition_date,
  CAST(1 AS BIGINT) AS seq, ts AS started_at, CAST(event_id AS VARCHAR) AS run_id, event_type AS status
FROM events QUALIFY row_number() OVER (
  PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) = 1""",
    "landing_backfill": _identity(PAYMENTS),
    "fingerprint_diff": _fingerprint_diff(),
    "fingerprint_blocks": _fingerprint_blocks(),
    "layer_reconcile_blocks": _layer_reconcile_blocks(),
    "offset_gaps": _OFFSET_GAPS,
    "offset_coverage": f"""SELECT topic, kafka_partition, count(*) AS rows, count(DISTINCT "offset") AS offsets,
  min("offset") AS from_offset, max("offset") AS to_offset FROM ({_EVERY_OFFSET}) GROUP BY ALL""",
    "raw_uniqueness": """SELECT l_returnflag AS topic, l_linenumber AS kafka_partition,
  l_orderkey AS "offset", count(*) AS copies FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "layer_reconcile": f"""SELECT topic, kafka_partition, "offset", CAST(1 AS BIGINT) AS left_copies,
  CAST(CASE WHEN tombstone THEN 0 ELSE 2 END AS BIGINT) AS right_copies,
  CASE WHEN tombstone THEN 'lost' ELSE 'doubled' END AS verdict
FROM {records(ORDERS)} WHERE tombstone OR cdc_operation = 'u'""",
    "compaction_policy": """WITH grouped AS (
  SELECT source, lang, count(*) AS input_files, CAST(sum(n_chars * 4096) AS BIGINT) AS input_bytes,
    count(*) FILTER (n_chars * 4096 < 96 * 1024 * 1024) AS small_files
  FROM documents GROUP BY 1, 2),
sized AS (SELECT *, greatest(1, CAST(ceil(input_bytes / CAST(134217728 AS DOUBLE)) AS BIGINT))
  AS expected_files FROM grouped)
SELECT *, input_files / CAST(expected_files AS DOUBLE) AS fragmentation_ratio,
  CASE WHEN small_files >= 5 AND input_files / CAST(expected_files AS DOUBLE) >= 4
    THEN 'DO_COMPACTION' ELSE 'NO_NEED' END AS operation FROM sized""",
    "publish_run": _VERDICT.format(
        name="orders", operation="DO_COMPACTION", records=records(ORDERS),
        files="CAST(6 AS BIGINT)"),
    "publish_rejected": f"""SELECT 'orders' AS dataset, partition_date,
  CASE WHEN lossy THEN 'FAILED' ELSE 'COMPLETED' END AS status, 'DO_COMPACTION' AS operation,
  input_rows, output_rows, CASE WHEN lossy THEN 'FAILED' ELSE 'PASSED' END AS validation,
  NOT lossy AS published FROM ({_REJECTED})""",
    "publish_compacted": _identity(ORDERS),
    "publish_passthrough": _identity(PAYMENTS),
    "publish_materialized": _identity(REFUNDS),
    "published_read": f"""SELECT topic, ingestion_date_utc, count(*) AS records
FROM {records(PAYMENTS)} GROUP BY 1, 2
UNION ALL SELECT '{ORDERS.topic}', partition_date, input_rows FROM ({_REJECTED}) WHERE NOT lossy""",
    "publication_ledger": f"""SELECT 'payments' AS dataset, ingestion_date_utc AS partition_date,
  CAST(seq AS BIGINT) AS seq, CASE WHEN seq = 3 THEN 'COMPLETED' ELSE 'RUNNING' END AS status,
  CASE WHEN seq > 1 THEN 'NO_NEED' END AS operation,
  CASE WHEN seq = 3 THEN input_rows END AS input_rows
FROM (SELECT ingestion_date_utc, count(*) AS input_rows FROM {records(PAYMENTS)} GROUP BY 1),
  (SELECT unnest([1, 2, 3]) AS seq)""",
    "control_documents": f"""SELECT 'payments' AS dataset, ingestion_date_utc AS partition_date,
  'COMPLETED' AS status, 'NO_NEED' AS operation, count(*) AS input_rows, 'PASSED' AS validation
FROM {records(PAYMENTS)} GROUP BY 2""",
    "publication_admission": _admission(),
    "run_identifiers": """SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S%fZ') AS run_id FROM events""",
    "domain_audit": _domain_audit(with_customers=True),
    "history_audit": _domain_audit(with_customers=False),
    "history_profile": f"SELECT topic, cdc_operation, count(*) AS events FROM {events(ORDERS)} GROUP BY 1, 2",
    "history_estimates": f"""SELECT DISTINCT topic, true AS keys_near, true AS median_near, true AS p99_near
FROM {events(ORDERS)}""",
    "table_types": _table_types(),
    "referential_audit": _referential_audit(),
    "referential_audit_bucketed": f"""SELECT id_payment, id_order FROM {current(PAYMENTS)} x
WHERE cdc_operation <> 'd' AND NOT EXISTS (
  SELECT 1 FROM {current(ORDERS)} y WHERE y.cdc_operation <> 'd' AND y.id_order = x.id_order)""",
    "table_roundtrip": "SELECT c_custkey AS id, c_name AS description FROM customer",
    "catalog_describe": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS table_rows FROM {t}"
        for t in ("orders", "lineitem", "customer", "supplier", "nation", "region")),
}
