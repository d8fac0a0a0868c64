"""The views of the catalogue in SQL, as common table expressions."""

from __future__ import annotations

TW = """
e0 AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, epoch_us(ts) AS start_us,
  epoch_us(ts) + round(value * 1000000)::BIGINT AS end_us, json_extract_string(props, '$.k')::BIGINT AS k,
  CASE event_type WHEN 'click' THEN 'aligned' WHEN 'view' THEN 'aligned_low_confidence' WHEN 'signup' THEN 'adaptive_consensus'
    WHEN 'purchase' THEN 'tempo_energy_rescue' WHEN 'error' THEN 'interpolated' END AS origin FROM events),
tw AS (SELECT track_id, seq, seq // 6 AS line_idx, seq % 6 AS word_idx, start_us, end_us, k, k / 100.0 AS conf, origin FROM e0)"""

SW = (
    TW
    + """,
sw AS (SELECT track_id, seq, line_idx, word_idx, seq * 400 + (k * 37) % 600 AS start_ms, seq * 400 + (k * 37) % 600 + 60 + (k * 13) % 500 AS end_ms, k, conf, origin,
  translate((k * 7919 + 11)::VARCHAR, '0123456789', 'aeioumnlrs') AS word FROM tw)"""
)

SL = (
    SW
    + """,
sl AS (SELECT track_id, line_idx, min(seq) * 400 AS anchor_ms, min(start_ms) AS start_ms, max(end_ms) AS end_ms, round(avg(conf), 9) AS conf, count(*) AS n_words FROM sw GROUP BY track_id, line_idx)"""
)

STAMP = "printf('[%02d:%02d.%03d]', ms // 60000, ms // 1000 % 60, ms % 1000)"

#: lt: the text of each conversation; ln: its timed lines, offset applied.
LT = f"""
c0 AS (SELECT conv_id, turn, turn * 4000 + (turn * 137) % 1000 AS ms, regexp_replace(coalesce(text, ''), '[\\r\\n\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g') AS line FROM conversations),
lt AS (SELECT conv_id AS track_id, '[ar:Conversation ' || conv_id || ']' || chr(10) || '[offset:' || (conv_id % 3 * 250) || ']' || chr(10) || '[Verse: 1]' || chr(10) || 'plain opening' || chr(10) || chr(10)
  || string_agg({STAMP} || line, chr(10) ORDER BY turn) AS raw FROM c0 GROUP BY conv_id),
ln AS (SELECT conv_id AS track_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_idx, ms + conv_id % 3 * 250 AS start_ms, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text FROM c0)"""


def with_(views: str, query: str) -> str:
    return f"WITH RECURSIVE {views.strip()}\n{query.strip()}"


def stamp(ms: str, digits: int = 3) -> str:
    """SQL for a time in milliseconds as text."""
    if digits == 3:
        return f"printf('%02d:%02d.%03d', ({ms}) // 60000, ({ms}) // 1000 % 60, ({ms}) % 1000)"
    return f"printf('%02d:%02d.%02d', (({ms}) + 5) // 10 // 6000, (({ms}) + 5) // 10 // 100 % 60, (({ms}) + 5) // 10 % 100)"
