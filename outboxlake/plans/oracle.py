"""The registered queries as DuckDB SQL over the given tables."""

from __future__ import annotations

from outboxlake.plans import fixtures

NOW = f"TIMESTAMP '{fixtures.AS_OF}'"
LIMIT = fixtures.PAYLOAD_LIMIT
D_COLUMNS = (
    "id, event_id, callback_name, completion_mode, attempts, last_error, last_attempt_at, "
    "available_at, locked_until, dispatched_at, processed_at, completion_cycles, dead_letter, "
    "created_at"
)
E_COLUMNS = (
    "id, event_id, kind, aggregate_type, aggregate_id, payload, metadata, callbacks, actor_id, "
    "correlation_id, causation_id, created_at"
)
OPEN = "(processed_at IS NULL AND NOT dead_letter)"
PENDING = f"(dispatched_at IS NULL AND {OPEN})"
WAITING = f"(completion_mode = 'external' AND dispatched_at IS NOT NULL AND {OPEN})"
DUE = f"({PENDING} AND available_at <= {NOW} AND (locked_until IS NULL OR locked_until < {NOW}))"
NAME = "^[a-z][a-z0-9_]{2,63}$"
RESERVED = (
    "'authorization','cookie','host','content-length','content-type','transfer-encoding',"
    "'connection','upgrade','expect','te','trailer','proxy-authorization'"
)


def ctes(*names: str, events: str = "outbox_events") -> str:
    """WITH clause of the named tables and the judged callbacks of ``events``."""
    parts = [
        f"{n} AS ({fixtures.duckdb_sql(n)})"
        for n in dict.fromkeys(
            ["outbox_events", events, "outbox_deliveries", "attempts", "commands", *names]
        )
    ]
    return "WITH " + ",\n".join(parts) + judged(events)


def _integer(path: str) -> str:
    return f"coalesce(json_type(el, '$.{path}') = 'UBIGINT', false)"


def _range(path: str, label: str, high: int) -> list[tuple[str, str, str]]:
    present = f"json_type(el, '$.{path}') IS NOT NULL"
    text = f"el->>'$.{path}'"
    return [
        (
            f"{present} AND NOT {_integer(path)}",
            f"{label}_not_integer",
            f"'{path} must be a positive integer'",
        ),
        (
            f"{present} AND CAST({text} AS HUGEINT) NOT BETWEEN 1 AND {high}",
            f"{label}_out_of_range",
            f"'{path} must be between 1 and {high}; got ' || ({text})",
        ),
    ]


_PRIVATE_URL = (
    r"^https?://(\[::1\]|\[fd12::9\]|127\.|10\.|192\.168\.|169\.254\.|"
    r"([^/]*\.)?localhost\.?(/|$)|[^/]*\.(local|internal|lan|home\.arpa)\.?(/|$))"
)


def judged(events: str) -> str:
    h = "json_extract(el, '$.headers')"
    hv = f"json_extract({h}, '$.\"' || k || '\"')"
    header_code = (
        "CASE WHEN NOT regexp_full_match(k, '[!#$%&''*+\\-.^_`|~0-9A-Za-z]+') THEN 1 "
        f"WHEN lower(k) IN ({RESERVED}) OR starts_with(lower(k), 'x-outbox-') THEN 2 "
        f"WHEN list_position(list_transform(list_sort(json_keys({h})), lambda z: lower(z)), lower(k)) "
        f"< list_position(list_sort(json_keys({h})), k) THEN 3 "
        f"WHEN json_type({hv}) <> 'VARCHAR' THEN 4 "
        f"WHEN NOT regexp_full_match({hv}->>'$', '[\\t\\x20-\\x7e]*') THEN 5 END"
    )
    bad_header = (
        f"CASE WHEN json_type(el, '$.headers') = 'OBJECT' THEN list_filter(list_transform("
        f"list_sort(json_keys({h})), lambda k: {{'k': k, 'c': {header_code}}}), "
        "lambda s: s.c IS NOT NULL)[1] END"
    )
    bad_backoff = (
        "CASE WHEN json_type(el, '$.backoff_seconds') = 'ARRAY' THEN list_filter(list_transform("
        "from_json(json_extract(el, '$.backoff_seconds'), '[\"JSON\"]'), lambda b: {'v': CAST(b AS VARCHAR), "
        "'c': CASE WHEN json_type(b) <> 'UBIGINT' THEN 1 WHEN CAST(CAST(b AS VARCHAR) AS HUGEINT) = 0 THEN 2 "
        "WHEN CAST(CAST(b AS VARCHAR) AS HUGEINT) > 604800 THEN 3 END}), lambda s: s.c IS NOT NULL)[1] END"
    )
    url = "(el->>'$.url')"
    rules = [
        ("json_type(el) <> 'OBJECT'", "not_an_object", "'element is not an object'"),
        ("json_type(el, '$.name') IS NULL", "missing_name", "'missing required field ''name'''"),
        ("json_type(el, '$.name') <> 'VARCHAR'", "name_not_string", "'''name'' must be a string'"),
        (
            f"NOT regexp_full_match(el->>'$.name', '{NAME}')",
            "name_invalid",
            f"'name must match {NAME}'",
        ),
        ("json_type(el, '$.url') IS NULL", "missing_url", "'missing required field ''url'''"),
        ("json_type(el, '$.url') <> 'VARCHAR'", "url_not_string", "'''url'' must be a string'"),
        (
            f"NOT regexp_matches({url}, '^[a-z]+://[^/]')",
            "url_malformed",
            f"'url ''' || {url} || ''' is structurally malformed'",
        ),
        (
            f"regexp_matches({url}, '^[a-z]+://[^/]+@')",
            "url_has_userinfo",
            f"'url ''' || {url} || ''' must not contain userinfo (username/password)'",
        ),
        (
            f"NOT starts_with({url}, 'https://')",
            "url_bad_scheme",
            f"'url must use https:// scheme; got ''' || {url} || ''''",
        ),
        (
            f"regexp_matches({url}, '{_PRIVATE_URL}')",
            "url_private_host",
            f"'url ''' || {url} || ''' targets a private or loopback address "
            "(set allow_private_ip_targets=true to allow local targets)'",
        ),
        (
            "mode0 NOT IN ('managed', 'external')",
            "invalid_mode",
            "'mode must be ''managed'' or ''external''; got ''' || mode0 || ''''",
        ),
        (
            "coalesce(json_type(el, '$.signing_key_id'), '') <> 'VARCHAR'",
            "missing_signing_key_id",
            "'missing required field ''signing_key_id'' (set allow_unsigned_callbacks=true to omit)'",
        ),
        (
            "json_type(el, '$.headers') IS NOT NULL AND json_type(el, '$.headers') <> 'OBJECT'",
            "headers_not_object",
            "'headers must be a JSON object'",
        ),
        (
            "bh.c = 1",
            "header_name_invalid",
            "'header name ''' || bh.k || ''' contains invalid characters'",
        ),
        (
            "bh.c = 2",
            "header_reserved",
            "'header ''' || bh.k || ''' is reserved and cannot be set'",
        ),
        (
            "bh.c = 3",
            "header_duplicate",
            "'header ''' || bh.k || ''' is a duplicate (header names are case-insensitive)'",
        ),
        (
            "bh.c >= 4",
            "header_value_invalid",
            "CASE WHEN bh.c = 4 THEN 'header ''' || bh.k || ''' value must be a string' ELSE "
            "'header ''' || bh.k || ''' value contains illegal characters "
            "(control characters and non-ASCII bytes are not allowed)' END",
        ),
        *_range("max_attempts", "max_attempts", 50),
        (
            "json_type(el, '$.backoff_seconds') <> 'ARRAY'",
            "backoff_not_array",
            "'backoff_seconds must be an array'",
        ),
        (
            "json_array_length(el, '$.backoff_seconds') = 0 AND json_type(el, '$.backoff_seconds') = 'ARRAY'",
            "backoff_empty",
            "'backoff_seconds must not be empty'",
        ),
        (
            "bb.c <= 2",
            "backoff_element_invalid",
            "CASE WHEN bb.c = 2 THEN 'backoff_seconds elements must be > 0' "
            "ELSE 'backoff_seconds elements must be positive integers' END",
        ),
        (
            "bb.c = 3",
            "backoff_element_out_of_range",
            "'backoff_seconds elements must be <= 604800; got ' || bb.v",
        ),
        *_range("timeout_seconds", "timeout", 300),
        *_range("external_completion_timeout_seconds", "external_timeout", 604800),
        *_range("max_completion_cycles", "max_completion_cycles", 1000),
        (
            "mode0 = 'external' AND json_type(el, '$.external_completion_timeout_seconds') IS NULL",
            "external_missing_timeout",
            "'mode=''external'' requires ''external_completion_timeout_seconds'''",
        ),
    ]
    reason = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in rules)
    message = " ".join(f"WHEN reason0 = '{r}' THEN {m}" for _, r, m in rules)
    return f""",
arrays AS (SELECT *, strlen(payload) AS size,
  CASE WHEN json_valid(callbacks) THEN CASE WHEN json_type(callbacks) = 'ARRAY' THEN CAST(json_array_length(callbacks) AS BIGINT) END END AS n
  FROM {events}),
el0 AS (SELECT a.id, a.event_id, a.kind, a.created_at, a.size, a.n, p.pos, json_extract(a.callbacks, '$[' || p.pos || ']') AS el
  FROM arrays a, LATERAL (SELECT unnest(range(coalesce(a.n, 0))) AS pos) p),
el1 AS (SELECT *, CASE WHEN json_type(el, '$.name') = 'VARCHAR' THEN el->>'$.name' END AS name,
  coalesce(CASE WHEN json_type(el, '$.mode') = 'VARCHAR' THEN el->>'$.mode' END, 'managed') AS mode0,
  {bad_header} AS bh, {bad_backoff} AS bb FROM el0),
el2 AS (SELECT *, CASE {reason} END AS reason0 FROM el1),
el3 AS (SELECT *, 'invalid_callback: ' || CASE {message} END AS message0, coalesce(name, '[' || pos || ']') AS label FROM el2),
branches AS (SELECT id, CASE WHEN size > {LIMIT} THEN 'oversized' WHEN n IS NULL THEN 'corrupt' WHEN n > 32 THEN 'too_many'
  WHEN n = 0 OR (SELECT bool_and(coalesce(x.name = '<root>', false)) FROM el1 x WHERE x.id = arrays.id) THEN 'unlisted' ELSE 'checked' END AS branch FROM arrays),
el4 AS (SELECT el3.*, b.branch, b.branch IN ('checked', 'unlisted') AS checked,
  row_number() OVER (PARTITION BY el3.id, label, reason0 IS NULL ORDER BY pos) > 1 AND reason0 IS NULL AS twin
  FROM el3 JOIN branches b ON b.id = el3.id),
judged AS (SELECT id, event_id, kind, created_at, n, pos, branch, label, el, mode0,
  CASE WHEN branch = 'too_many' THEN 'too_many_callbacks' WHEN NOT checked THEN NULL WHEN twin THEN 'duplicate_name' ELSE reason0 END AS reason,
  CASE WHEN branch = 'too_many' THEN 'invalid_callback: too many callbacks in event (' || n || '); max is 32'
   WHEN branch = 'oversized' THEN 'source_payload_too_large: ' || size || ' bytes > {LIMIT} bytes (rejected by dispatcher before send)'
   WHEN twin THEN 'invalid_callback: duplicate callback name within event' ELSE message0 END AS message,
  checked AND NOT twin AND reason0 IS NULL AS valid FROM el4),
candidates AS (SELECT id AS seq, event_id, label, CASE WHEN valid THEN pos ELSE n + pos END AS ordinal,
  CASE WHEN valid THEN mode0 ELSE 'managed' END AS mode, NOT valid AS dead, message FROM judged
  QUALIFY row_number() OVER (PARTITION BY event_id, label ORDER BY valid DESC, pos) = 1),
named AS (SELECT x.event_id, x.name, x.n, min_by(struct_pack(el := x.el, reason0 := x.reason0, message0 := x.message0, mode0 := x.mode0), x.pos) AS m
  FROM el3 x WHERE x.name IS NOT NULL GROUP BY ALL),
checked_rows AS (SELECT d.*, e.kind, e.aggregate_type, e.aggregate_id, e.payload, e.metadata, e.actor_id, e.correlation_id, e.causation_id,
  e.created_at AS event_created_at, m.el AS el, m.mode0 AS mode0, m.el->>'$.url' AS url, m.el->>'$.signing_key_id' AS key_id,
  coalesce(CAST(m.el->>'$.max_attempts' AS INT), 6) AS max_attempts,
  coalesce(CAST(m.el->>'$.timeout_seconds' AS BIGINT), 30) AS timeout_s,
  coalesce(from_json(json_extract(m.el, '$.backoff_seconds'), '["BIGINT"]'), [30, 120, 600, 3600, 21600, 86400]) AS backoff,
  CASE WHEN nm.event_id IS NULL THEN 'Callback target missing: callback ''' || d.callback_name || ''' not found in event callbacks array'
   WHEN m.reason0 IS NOT NULL THEN 'Invalid data: callback ''' || d.callback_name || ''' failed structural revalidation at dispatch time: ' || m.message0 END AS spec_error
  FROM outbox_deliveries d JOIN outbox_events e USING (event_id) LEFT JOIN named nm ON nm.event_id = d.event_id AND nm.name = d.callback_name),
timed AS (SELECT a.*, c.*, c.attempts + 1 AS attempt,
  CASE WHEN a.failure_kind = 'timeout' THEN 'timeout' WHEN a.failure_kind IS NOT NULL THEN 'transient'
   WHEN a.status_code BETWEEN 200 AND 299 THEN 'ok' ELSE 'transient' END AS result,
  CASE WHEN a.failure_kind = 'timeout' THEN 'callback timeout' WHEN a.failure_kind = 'connection' THEN 'connection error: ' || a.error_detail
   WHEN NOT a.status_code BETWEEN 200 AND 299 THEN 'POST ' || c.url || ' returned ' || a.status_code END AS error,
  CASE WHEN regexp_full_match(trim(a.retry_after), '[0-9]+') THEN CAST(trim(a.retry_after) AS DOUBLE)
   WHEN a.retry_after IS NOT NULL THEN greatest(0.0, epoch(strptime(a.retry_after, '%a, %d %b %Y %H:%M:%S GMT') - {NOW})) END AS after_s
  FROM attempts a JOIN checked_rows c ON c.id = a.delivery_id WHERE c.spec_error IS NULL),
scheduled_times AS (SELECT *, greatest(CAST(coalesce(backoff[greatest(attempt, 1)], backoff[-1], 60) AS DOUBLE), coalesce(after_s, 0.0)) AS delay_s FROM timed),
outcomes AS (SELECT *, {NOW} + to_microseconds(CAST(delay_s * 1000000 AS BIGINT)) AS next_at, attempt >= max_attempts AS exhausted FROM scheduled_times),
log AS (SELECT * FROM outcomes WHERE {DUE.replace("dispatched_at", "outcomes.dispatched_at")}),
hung AS (SELECT d.*, CAST(m.el->>'$.external_completion_timeout_seconds' AS INT) AS timeout_s,
  coalesce(CAST(m.el->>'$.max_completion_cycles' AS INT), 20) AS max_cycles
  FROM outbox_deliveries d JOIN named nm ON nm.event_id = d.event_id AND nm.name = d.callback_name
  WHERE {WAITING} AND json_type(m.el, '$.external_completion_timeout_seconds') IS NOT NULL
   AND dispatched_at + to_seconds(CAST(m.el->>'$.external_completion_timeout_seconds' AS INT)) < {NOW}),
flags AS (SELECT event_id, bool_or({OPEN}) AS open, bool_or(dead_letter) AS dead FROM outbox_deliveries GROUP BY 1),
terminal AS (SELECT e.id, e.event_id, e.created_at, CASE WHEN coalesce(dead, false) THEN 'dead_letter' ELSE 'processed' END AS reason
  FROM outbox_events e LEFT JOIN flags f USING (event_id)
  WHERE NOT coalesce(open, false) AND e.created_at < CASE WHEN coalesce(dead, false) THEN TIMESTAMP '2024-01-10' ELSE TIMESTAMP '2024-01-25' END)
"""


def histogram(source: str, value: str, by: str, bounds: list[str]) -> str:
    values = ", ".join(f"('{b}', {'1e308' if b == '+Inf' else b})" for b in bounds)
    return (
        f"SELECT {by}, b.le AS le, count(*) FILTER (WHERE {value} <= b.v) AS cumulative_count, "
        f"sum(CAST(round({value} * 1e6) AS BIGINT)) / 1e6 AS sum, count({value}) AS count "
        f"FROM ({source}) s CROSS JOIN (VALUES {values}) b(le, v) GROUP BY {by}, b.le"
    )


DURATIONS = "0.005 0.01 0.025 0.05 0.1 0.25 0.5 1 2.5 5 10 30 +Inf".split()
AGES = "5 30 60 300 900 3600 21600 86400 259200 604800 +Inf".split()
NEW_ROW = (
    "0 AS attempts, message AS last_error, CAST(NULL AS TIMESTAMP) AS last_attempt_at, "
    f"{NOW} AS available_at, CAST(NULL AS TIMESTAMP) AS locked_until, CAST(NULL AS TIMESTAMP) AS dispatched_at, "
    "CAST(NULL AS TIMESTAMP) AS processed_at, 0 AS completion_cycles, dead AS dead_letter, "
    f"{NOW} AS created_at"
)


def scheduled(cursor: str = "0", highest: str = "(SELECT max(id) FROM outbox_deliveries)", where: str = "true") -> str:
    """Rows to insert, numbered behind the highest id in the order of events and of rows within one."""
    return f"""SELECT {highest} + row_number() OVER (ORDER BY seq, ordinal) AS id,
 c.event_id, label AS callback_name, mode AS completion_mode, {NEW_ROW}
 FROM candidates c ANTI JOIN outbox_deliveries d ON d.event_id = c.event_id AND d.callback_name = c.label
 WHERE seq > {cursor} AND {where}"""
