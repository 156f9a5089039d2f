"""ANSI SQL counterparts of the registered queries, for an independent engine.

They use plain global windows, which are right but need one sorted partition;
the Spark queries must give the same rows without it.
"""

from __future__ import annotations

from tidelog.plans.queries import (
    BAD_IDS,
    BATCH_SIZE,
    CAPTURE_MB,
    CAPTURE_SECONDS,
    DAY_MS,
    EVENT_STREAMS,
    FETCH_ROWS,
    LIMIT_PARTS,
    MANY_ROWS,
    MAX_DELAY,
    NEW_STREAM,
    REISSUE_BASE_MS,
    RENAMED,
    RENAMED_ORDERS,
    ROTATE_EVERY,
    SKIPPED_STREAM,
    SPEED,
    WEEK_END,
    WEEK_START,
)

E = """
e0 AS (
  SELECT 'events:' || event_type AS stream_name, epoch_us(ts) // 1000 AS ms,
         event_id AS pos, user_id, value, 'events' AS recording,
         CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k
  FROM events),
e AS (
  SELECT *, row_number() OVER (PARTITION BY stream_name, ms ORDER BY pos) - 1 AS seq
  FROM e0)"""

O = """
o0 AS (
  SELECT 'orders:' || o_orderpriority AS stream_name,
         epoch_us(o_orderdate) // 1000 AS ms, o_orderkey AS pos,
         'orders' AS recording, o_custkey AS custkey, o_orderstatus AS status,
         o_totalprice AS totalprice
  FROM orders),
o AS (
  SELECT *, row_number() OVER (PARTITION BY stream_name, ms ORDER BY pos) - 1 AS seq
  FROM o0)"""

FIRSTS = """
firsts AS (
  SELECT stream_name, count(*) AS messages,
         arg_min(ms, pos) AS first_ms, arg_min(seq, pos) AS first_seq,
         arg_max(ms, pos) AS last_ms, arg_max(seq, pos) AS last_seq
  FROM o GROUP BY stream_name)"""

ORDERED = f"""
kept AS (
  SELECT *, (row_number() OVER (ORDER BY pos) - 1) // {BATCH_SIZE} AS batch
  FROM o WHERE stream_name <> '{SKIPPED_STREAM}'),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY batch, ms, seq, pos) - 1 AS replay_no
  FROM kept)"""

SCHEDULED = f"""
gaps AS (
  SELECT *, lag(ms) OVER (ORDER BY replay_no) AS prev_ms FROM ordered),
delayed AS (
  SELECT *, CASE WHEN ms > prev_ms THEN CAST(round(least(
      (ms - prev_ms) * 1000.0::DOUBLE / {SPEED}::DOUBLE, {MAX_DELAY * 1e6}::DOUBLE))
      AS BIGINT) ELSE 0 END AS delay_us,
    CASE WHEN ms > prev_ms OR replay_no % {BATCH_SIZE} = 0 THEN 1 ELSE 0 END AS flag
  FROM gaps),
scheduled AS (
  SELECT *,
    CAST(sum(delay_us) OVER (ORDER BY replay_no) AS BIGINT) AS due_us,
    CAST(sum(flag) OVER (ORDER BY replay_no) AS BIGINT) - 1 AS flush_group
  FROM delayed)"""

EVENT_ROW = "stream_name, ms, seq, pos, user_id, value, k"
AFTER_START = (
    f"(ms > {WEEK_START.ms} OR (ms = {WEEK_START.ms} AND seq >= {WEEK_START.seq}))"
)
BEFORE_END = f"(ms < {WEEK_END.ms} OR (ms = {WEEK_END.ms} AND seq <= {WEEK_END.seq}))"
LISTED = ", ".join(f"'{name}'" for name in EVENT_STREAMS)


def _renaming(names: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in names.items())
    return f"CASE stream_name {arms} ELSE stream_name END"


RAW_IDS = """
raw AS (
  SELECT stream_name, pos,
    CASE WHEN pos % 97 = 0 THEN 'bad-' || ms WHEN pos % 5 = 0 THEN CAST(ms AS VARCHAR)
         ELSE ms || '-' || seq END AS raw_id
  FROM e),
parsed AS (
  SELECT *, regexp_matches(raw_id, '^[0-9]+(-[0-9]+)?$') AS ok,
    TRY_CAST(regexp_extract(raw_id, '^([0-9]+)', 1) AS BIGINT) AS ms0,
    coalesce(TRY_CAST(regexp_extract(raw_id, '-([0-9]+)$', 1) AS BIGINT), 0) AS seq0
  FROM raw)"""

UTC = "strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S.%g')"


def _entry(text: str) -> str:
    """Bytes of a text in a recording file, for the lengths that occur here."""
    return f"(octet_length(encode({text})) + CASE WHEN octet_length(encode({text})) < 32 THEN 1 ELSE 2 END)"


SIZED = f"""
sized AS (
        SELECT stream_name, ms, seq, pos,
          2 + {_entry("stream_name")} + {_entry("(ms || '-' || seq)")}
          + {_entry("'user_id'")} + {_entry("CAST(user_id AS VARCHAR)")}
          + {_entry("'value'")} + {_entry("CAST(value AS VARCHAR)")}
          + {_entry("'k'")} + {_entry("CAST(k AS VARCHAR)")} AS bytes
        FROM e)"""

ORACLES: dict[str, str] = {
    "truncate_range": f"WITH {E} SELECT {EVENT_ROW} FROM e WHERE {AFTER_START} AND {BEFORE_END}",
    "truncate_from": f"WITH {E} SELECT {EVENT_ROW} FROM e WHERE {AFTER_START}",
    "truncate_to": f"WITH {E} SELECT {EVENT_ROW} FROM e WHERE {BEFORE_END}",
    "auto_start_id": f"""WITH {O}, {FIRSTS}
      SELECT first_ms AS ms, first_seq AS seq FROM firsts
      ORDER BY first_ms DESC, first_seq DESC LIMIT 1""",
    "truncate_auto_start": f"""WITH {O}, {FIRSTS}, start AS (
        SELECT first_ms, first_seq FROM firsts
        ORDER BY first_ms DESC, first_seq DESC LIMIT 1)
      SELECT stream_name, ms, seq, pos FROM o, start
      WHERE ms > first_ms OR (ms = first_ms AND seq >= first_seq)""",
    "truncate_time": f"""WITH {O}, {FIRSTS}, span AS (
        SELECT greatest(min(first_ms), least(820454400000, max(last_ms))) AS lo,
               greatest(min(first_ms), least(946684800000, max(last_ms))) AS hi
        FROM firsts), modes AS (
        SELECT unnest(['parity', 'whole_ms']) AS end_mode)
      SELECT end_mode, stream_name, ms, seq, pos FROM o, span, modes
      WHERE ms >= lo AND (ms < hi OR (ms = hi AND (end_mode = 'whole_ms' OR seq = 0)))""",
    "truncate_counts": f"""WITH {E}
      SELECT count(*) FILTER (WHERE {AFTER_START} AND {BEFORE_END}) AS written,
             count(*) FILTER (WHERE NOT ({AFTER_START} AND {BEFORE_END})) AS skipped
      FROM e""",
    "stream_stats": f"""WITH {O}, {FIRSTS}
      SELECT stream_name, messages, first_ms || '-' || first_seq AS first_id,
             last_ms || '-' || last_seq AS last_id,
             last_ms - first_ms AS duration_ms,
             (last_ms - first_ms)::DOUBLE / 1000 AS duration_s
      FROM firsts""",
    "log_totals": f"""WITH {E}
      SELECT count(DISTINCT stream_name) AS streams, count(*) AS messages FROM e""",
    "volume_totals": """
      SELECT count(DISTINCT l_returnflag || l_linestatus) AS streams,
             count(*) AS messages FROM lineitem""",
    "timeline_streams": f"""WITH {O}, {FIRSTS}
      SELECT stream_name, messages, first_ms, last_ms FROM firsts""",
    "timeline_global": f"""WITH {O}, {FIRSTS}
      SELECT min(first_ms) AS first_ms, max(last_ms) AS last_ms,
             CAST(sum(messages) AS BIGINT) AS messages FROM firsts""",
    "estimate_window": f"""WITH {E}, t AS (
        SELECT stream_name, count(*) AS n, arg_min(ms, pos) AS a, arg_max(ms, pos) AS b
        FROM e GROUP BY stream_name)
      SELECT CAST(sum(CASE
          WHEN b <= a THEN CASE WHEN a >= {WEEK_START.ms} AND b <= {WEEK_END.ms}
                                THEN n ELSE 0 END
          WHEN least(b, {WEEK_END.ms}) <= greatest(a, {WEEK_START.ms}) THEN 0
          ELSE greatest(1, CAST(round_even(n::DOUBLE * ((least(b, {WEEK_END.ms})
               - greatest(a, {WEEK_START.ms}))::DOUBLE / (b - a)), 0) AS BIGINT))
        END) AS BIGINT) AS estimated
      FROM t""",
    "field_keys": """
      SELECT unnest(json_keys(props::JSON)) AS field_key FROM events
      UNION SELECT unnest(['user_id', 'value']) FROM events
      UNION SELECT unnest(['custkey', 'status', 'totalprice']) FROM orders""",
    "last_ids": f"""WITH {O}, ranked AS (
        SELECT *, row_number() OVER (
          PARTITION BY stream_name ORDER BY ms DESC, seq DESC) AS r FROM o)
      SELECT stream_name, ms, seq FROM ranked WHERE r = 1""",
    "batch_summary": f"""WITH {O}, b AS (
        SELECT *, (row_number() OVER (ORDER BY pos) - 1) // {BATCH_SIZE} AS batch FROM o)
      SELECT batch, stream_name, count(*) AS messages FROM b GROUP BY ALL""",
    "parse_message_id": f"""WITH {E}, {RAW_IDS}
      SELECT stream_name, pos, raw_id, CASE WHEN ok THEN ms0 END AS ms,
             CASE WHEN ok THEN seq0 END AS seq,
             CASE WHEN NOT ok THEN raw_id END AS _corrupt_record
      FROM parsed""",
    "drop_malformed": f"""WITH {E}, {RAW_IDS}
      SELECT stream_name, pos, raw_id, ms0 AS ms, seq0 AS seq FROM parsed WHERE ok""",
    "format_message_id": f"WITH {O} SELECT pos, ms || '-' || seq AS message_id FROM o",
    "stringify_fields": """
      SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS user_id,
             CAST(event_id AS VARCHAR) AS event_id FROM events""",
    "drop_undecodable": f"""WITH {E}
      SELECT stream_name, ms || '-' || seq AS id, pos, user_id FROM e
      WHERE pos % 83 <> 0 AND pos % 89 <> 0 AND pos % 97 <> 0""",
    "include_streams": f"WITH {E} SELECT stream_name, ms, pos FROM e WHERE stream_name IN ({LISTED})",
    "exclude_streams": f"WITH {E} SELECT stream_name, ms, pos FROM e WHERE stream_name NOT IN ({LISTED})",
    "dropped_streams": f"""WITH {E}
      SELECT stream_name, count(*) AS dropped FROM e
      WHERE stream_name NOT IN ({LISTED}) GROUP BY stream_name""",
    "rename_streams": f"WITH {E} SELECT {_renaming(RENAMED)} AS stream_name, ms, pos FROM e",
    "read_after": f"""WITH {O}, seen AS (
        SELECT stream_name AS s, max(ms) AS m, arg_max(seq, ms * 1000000 + seq) AS q
        FROM o WHERE ms < 915148800000 OR (ms = 915148800000 AND seq <= 2)
        GROUP BY stream_name), ranked AS (
        SELECT stream_name, ms, seq, pos, row_number() OVER (
          PARTITION BY stream_name ORDER BY ms, seq, pos) AS r
        FROM o JOIN seen ON stream_name = s
        WHERE ms > m OR (ms = m AND seq > q))
      SELECT stream_name, ms, seq, pos FROM ranked WHERE r <= {FETCH_ROWS}""",
    "flatten_fields": f"""WITH {E}, {O}
      SELECT stream_name, ms || '-' || seq AS message_id, ms AS timestamp_ms,
             NULL AS custkey, CAST(k AS VARCHAR) AS k, NULL AS status,
             CAST(NULL AS DOUBLE) AS totalprice, CAST(user_id AS VARCHAR) AS user_id,
             value FROM e
      UNION ALL
      SELECT stream_name, ms || '-' || seq, ms, CAST(custkey AS VARCHAR), NULL, status,
             totalprice, NULL, NULL FROM o""",
    "flatten_typed": f"""WITH {E}
      SELECT stream_name, ms || '-0' AS message_id, ms AS timestamp_ms, user_id,
             user_id % 2 = 0 AS even,
             CASE user_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR)
               WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END
               ELSE substr(stream_name, 8) END AS mixed,
             CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS DOUBLE) ELSE value END AS number,
             value FROM e""",
    "csv_roundtrip": f"""WITH {E}
      SELECT stream_name, ms || '-' || seq AS message_id,
             CAST(ms AS VARCHAR) AS timestamp_ms, CAST(k AS VARCHAR) AS k,
             CAST(user_id AS VARCHAR) AS user_id, value FROM e""",
    "recording_roundtrip": f"WITH {E} SELECT stream_name, ms, seq, user_id, value, k FROM e",
    "append_union": f"""WITH {E}, {O}
      SELECT stream_name, ms, seq, recording, pos FROM e
      UNION ALL SELECT stream_name, ms, seq, recording, pos FROM o""",
    "rotate_by_time": f"""WITH {E}
      SELECT ms // {DAY_MS} AS rotation, count(*) AS messages, min(ms) AS min_ms,
             max(ms) AS max_ms FROM e GROUP BY ms // {DAY_MS}""",
    "replay_order": f"""WITH {O}, {ORDERED}
      SELECT replay_no, batch, {_renaming(RENAMED_ORDERS)} AS stream_name, ms, seq, pos
      FROM ordered""",
    "replay_delay": f"""WITH {O}, {ORDERED}, {SCHEDULED}
      SELECT replay_no, ms, prev_ms, delay_us, pos FROM scheduled""",
    "replay_due": f"""WITH {O}, {ORDERED}, {SCHEDULED}
      SELECT replay_no, stream_name, ms, seq, pos, due_us FROM scheduled""",
    "flush_groups": f"""WITH {O}, {ORDERED}, {SCHEDULED}
      SELECT flush_group, count(*) AS messages, min(replay_no) AS first_no,
             max(replay_no) AS last_no, max(due_us) AS due_us
      FROM scheduled GROUP BY flush_group""",
    "replay_reissue": f"""WITH {O}, {ORDERED}, {SCHEDULED}, issued AS (
        SELECT {_renaming(RENAMED_ORDERS)} AS stream_name, pos, replay_no,
               {REISSUE_BASE_MS} + due_us // 1000 AS new_ms FROM scheduled)
      SELECT *, row_number() OVER (
        PARTITION BY stream_name, new_ms ORDER BY replay_no) - 1 AS new_seq
      FROM issued""",
    "replay_batches": f"""WITH {O}, {ORDERED}, b AS (
        SELECT batch, count(*) AS messages, min(ms) AS lo, max(ms) AS top
        FROM ordered GROUP BY batch), r AS (
        SELECT batch, messages, top,
          CAST(sum(messages) OVER (ORDER BY batch) AS BIGINT) AS replayed,
          first_value(lo) OVER (ORDER BY batch) AS first_ms,
          max(top) OVER (ORDER BY batch) AS last_ms FROM b)
      SELECT batch, messages, replayed, first_ms, last_ms,
             top - first_ms AS elapsed_ms, greatest(last_ms - first_ms, 1) AS total_ms,
             strftime(make_timestamp(top * 1000), '%d-%m-%Y %H:%M:%S') AS current_utc,
             strftime(make_timestamp(last_ms * 1000), '%d-%m-%Y %H:%M:%S') AS last_utc
      FROM r""",
    "bounded_capture": f"""WITH {E}, {SIZED}, totals AS (
        SELECT *, sum(bytes) OVER (ORDER BY pos) - bytes AS before FROM sized)
      SELECT stream_name, ms, seq, pos FROM totals
      WHERE before < {int(CAPTURE_MB * 1024 * 1024)}""",
    "capture_limits": f"""WITH {E}, {SIZED}, parts AS (
        SELECT pos // ((SELECT count(*) FROM e) // {LIMIT_PARTS} + 1) AS part, sum(bytes) AS bytes
        FROM sized GROUP BY 1), totals AS (
        SELECT part, sum(bytes) OVER (ORDER BY part) - bytes AS before FROM parts)
      SELECT stream_name, ms, seq, pos FROM sized
      JOIN totals ON part = pos // ((SELECT count(*) FROM e) // {LIMIT_PARTS} + 1)
      WHERE before < {int(CAPTURE_MB * 1024 * 1024)}""",
    "log_bytes": f"""WITH {E}, {SIZED}
      SELECT count(DISTINCT stream_name) AS streams, count(*) AS messages,
             CAST(sum(bytes) AS BIGINT) AS bytes FROM sized""",
    "bounded_duration": f"""WITH {E}, start AS (SELECT arg_min(ms, pos) AS first FROM e),
      late AS (SELECT min(pos) AS stop FROM e, start WHERE ms >= first + {CAPTURE_SECONDS * 1000})
      SELECT stream_name, ms, seq, pos FROM e, late WHERE stop IS NULL OR pos < stop""",
    "fmt_hms": f"""WITH {E}, d AS (
        SELECT pos, greatest(ms - {WEEK_START.ms}, 0) AS t FROM e)
      SELECT pos, printf('%02d:%02d:%02d.%03d', t // 3600000, t // 60000 % 60,
                         t // 1000 % 60, t % 1000) AS duration FROM d""",
    "fmt_utc": f"WITH {E} SELECT pos, {UTC} AS utc FROM e",
    "fmt_utc_dmy": f"""WITH {E}
      SELECT pos, strftime(make_timestamp(ms * 1000), '%d-%m-%Y %H:%M:%S') AS utc
      FROM e""",
    "parse_hms": f"""WITH {E}, s AS (
        SELECT pos, ms % {DAY_MS} AS t, substr({UTC}, 12, 12) AS c FROM e)
      SELECT pos,
        CASE pos % 5 WHEN 0 THEN c WHEN 1 THEN substr(c, 4, 7)
                     WHEN 2 THEN '  ' || substr(c, 1, 8) WHEN 3 THEN c || '99'
                     ELSE '1:' || c END AS shown,
        CASE pos % 5 WHEN 0 THEN t WHEN 1 THEN t % 3600000 // 100 * 100
                     WHEN 2 THEN t // 1000 * 1000 WHEN 3 THEN t END AS ms
      FROM s""",
    "parse_utc": f"""WITH {E}
      SELECT pos,
        CASE pos % 3 WHEN 0 THEN {UTC} WHEN 1 THEN substr({UTC}, 1, 10)
                     ELSE replace({UTC}, '2024-01', '2024-13') END AS shown,
        CASE pos % 3 WHEN 0 THEN ms WHEN 1 THEN ms // {DAY_MS} * {DAY_MS} END AS ms
      FROM e""",
    "parse_utc_inferred": f"""WITH {E}, s AS (
        SELECT pos, ms, ms // {DAY_MS} * {DAY_MS} AS day,
          CASE WHEN pos % 3 = 0 THEN '12:00:00.5' ELSE
            substr(strftime(make_timestamp((ms + 21600000) * 1000),
                            '%Y-%m-%d %H:%M:%S.%g'), 12, 12) END AS shown,
          CASE WHEN pos % 3 = 0 THEN 43200500 ELSE (ms + 21600000) % {DAY_MS} END AS t
        FROM e)
      SELECT pos, ms, shown,
        CASE WHEN day + t BETWEEN ms AND ms + 43200000 THEN day + t
             WHEN day + {DAY_MS} + t BETWEEN ms AND ms + 43200000 THEN day + {DAY_MS} + t
             WHEN day - {DAY_MS} + t BETWEEN ms AND ms + 43200000 THEN day - {DAY_MS} + t
             ELSE day + t END AS found_ms
      FROM s""",
    "stream_capture": f"WITH {E} SELECT {EVENT_ROW} FROM e WHERE stream_name IN ({LISTED})",
    "stream_resume": f"""WITH {E}, early AS (
        SELECT * FROM e WHERE ms < {WEEK_START.ms} AND stream_name <> '{NEW_STREAM}'),
      ranked AS (
        SELECT *, row_number() OVER (PARTITION BY stream_name ORDER BY ms DESC, seq DESC) AS r
        FROM early),
      seen AS (SELECT stream_name AS s, ms AS m, seq AS q FROM ranked WHERE r = 1)
      SELECT stream_name, ms, seq, pos FROM e LEFT JOIN seen ON stream_name = s
      WHERE s IS NULL OR ms > m OR (ms = m AND seq > q)""",
    "stream_stats_live": f"""WITH {E}, f AS (
        SELECT stream_name, count(*) AS messages, arg_min(ms, pos) AS a, arg_min(seq, pos) AS p,
               arg_max(ms, pos) AS b, arg_max(seq, pos) AS q FROM e GROUP BY stream_name)
      SELECT stream_name, messages, a || '-' || p AS first_id, b || '-' || q AS last_id,
             b - a AS duration_ms, (b - a)::DOUBLE / 1000 AS duration_s FROM f""",
    "capture_restart": f"WITH {E} SELECT {EVENT_ROW} FROM e",
    "capture_quarantine": f"""WITH {E}, judged AS (
        SELECT pos, ms, CASE WHEN pos % 89 = 0 THEN 'stream name'
          WHEN stream_name NOT IN ({LISTED}) THEN 'unlisted stream'
          WHEN pos % 97 = 0 THEN 'message ID text' WHEN pos % 83 = 0 THEN 'fields'
          WHEN pos % {BAD_IDS} = 0 THEN 'message ID' END AS reason FROM e)
      SELECT pos, CASE WHEN reason IS NULL THEN ms END AS ms, reason FROM judged""",
    "rotate_at": f"""WITH {E}, times AS (SELECT DISTINCT ms AS at_ms FROM e WHERE pos % {ROTATE_EVERY} = 0),
      turns AS (SELECT at_ms, row_number() OVER (ORDER BY at_ms) AS turn FROM times),
      placed AS (SELECT coalesce(turn, 0) AS rotation, ms FROM e ASOF LEFT JOIN turns ON e.ms >= turns.at_ms)
      SELECT rotation, count(*) AS messages, min(ms) AS min_ms, max(ms) AS max_ms
      FROM placed GROUP BY rotation""",
    "capture_status": f"""WITH {E}
      SELECT count(*) FILTER (WHERE stream_name IN ({LISTED})) AS kept,
             count(*) FILTER (WHERE stream_name NOT IN ({LISTED})) AS dropped FROM e""",
    "read_after_many": f"""WITH {O}, ranked AS (
        SELECT stream_name, ms, seq, pos, row_number() OVER (
          PARTITION BY stream_name ORDER BY ms, seq, pos) AS r
        FROM o WHERE ms > 800000000000)
      SELECT stream_name, ms, seq, pos FROM ranked WHERE r <= {MANY_ROWS}""",
    "include_streams_many": f"""WITH {E}
      SELECT stream_name, ms, pos FROM e WHERE pos % 101 <> 0 AND stream_name IN ({LISTED})""",
    "exclude_streams_many": f"""WITH {E}
      SELECT CASE WHEN pos % 101 <> 0 THEN stream_name END AS stream_name, ms, pos FROM e
      WHERE pos % 101 = 0 OR stream_name NOT IN ({LISTED})""",
    "rename_streams_many": f"""WITH {E}
      SELECT CASE WHEN pos % 101 <> 0 THEN {_renaming(RENAMED)} END AS stream_name, ms, pos
      FROM e""",
    "recording_order": f"""WITH {E}, {O}, both_logs AS (
        SELECT 0 AS part, stream_name, ms, seq, pos FROM e
        UNION ALL SELECT 1, stream_name, ms, seq, pos FROM o)
      SELECT row_number() OVER (ORDER BY part, pos) - 1 AS arrival, stream_name, ms, seq
      FROM both_logs""",
    "recording_cuts": """
      SELECT 'documents:' || source AS stream_name, doc_id, lang, md5(text) AS text_md5
      FROM documents""",
    "recording_range": f"""WITH {E} SELECT stream_name, ms, seq, user_id, value, k FROM e
      WHERE {AFTER_START} AND {BEFORE_END} AND stream_name IN ({LISTED})""",
    "recording_large_records": """
      SELECT 'documents:' || source AS stream_name, doc_id, md5(text) AS text_md5
      FROM documents""",
    "replay_order_big_batch": f"""WITH {O}, b AS (
        SELECT *, (row_number() OVER (ORDER BY pos) - 1) // {MANY_ROWS} AS batch FROM o)
      SELECT row_number() OVER (ORDER BY batch, ms, seq, pos) - 1 AS replay_no, batch,
             stream_name, ms, seq, pos FROM b""",
}
# The same rows whatever the buckets, and in one pass or two.
ORACLES |= {
    f"{name}_many": ORACLES[name]
    for name in (
        "replay_order",
        "replay_delay",
        "replay_due",
        "flush_groups",
        "batch_summary",
        "format_message_id",
    )
}
ORACLES |= {
    "truncate_observed": ORACLES["truncate_counts"],
    "capture_rotated_at": ORACLES["rotate_at"],
    "recording_source": ORACLES["recording_range"],
    "stream_recordings": ORACLES["recording_roundtrip"],
    "capture_rotated": ORACLES["rotate_by_time"],
}
